"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments, not single tokens: digit counts, checksums,
separators and shape of a span, and what stands beside it. Dynamic programming over segments
of bounded length chooses all boundaries and types of a window together.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections import defaultdict
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import frugal, small_batches, table, text_column

KINDS = ("email", "ip", "card", "phone")
#: Tokens and characters in an entity of the field, at most.
MOST_TOKENS, MOST_CHARACTERS = 32, 120
#: Digits and groups of digits in a number of the field, at most.
MOST_DIGITS, MOST_GROUPS = 19, 7
#: Characters between triggers that still belong to one window; words and characters of context around it, at most.
REACH, CONTEXT, CONTEXT_CHARACTERS = 48, 3, 64
#: Characters of a window that are decoded at once; what its last tokens hold is decided with the next ones.
STRETCH = 1 << 14
#: Synthetic windows that the field is trained on, and passes over them.
WINDOWS, PASSES = 900, 4

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9]+|@|[\[(] ?at ?[\])]", re.ASCII)
_NEXT_WORD, _DOT_AHEAD, _DOT_BEHIND = re.compile(r" [\w-]+"), re.compile(r"(?: (?:[\[(] ?dot ?[\])]|dot) [\w-]+)+"), re.compile(r" (?:[\[(] ?dot ?[\])]|dot)\Z")
_TOKEN = re.compile(r"[^\W_]+|\s|_|[^\w\s]")
_LABEL, _NEXT_LABEL = re.compile(r"[^\W_]+(?:-+[^\W_]+)*"), re.compile(r"(?:\.| ?[\[(] ?(?:dot|\.) ?[\])] ?| dot )([^\W_]+(?:-+[^\W_]+)*)")
_NUMBER_MARKS = frozenset(" ().-/+[]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        after = domain.end() if domain else at + 1
        at = text.find("@", after)


def _addresses(text: str):
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        at, parts = m.start(), m.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            own = parts[k : k + 4]
            size = sum(map(len, own)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in own):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, each kind's matches leftmost and not overlapping, by start, then kind."""
    found = [(s, e, "email") for s, e in _emails(text)] if "@" in text else []
    found += [(s, e, "ip") for s, e in _addresses(text)]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2])))


def _is_number(token: str) -> bool:
    return token.isascii() and token.isdigit()


def _class(token: str) -> str:
    if not token:
        return "edge"
    if _is_number(token):
        return f"d{min(len(token), 6)}"
    if token.isalpha():
        return "at" if token == "at" else "dot" if token == "dot" else "a"
    if token.isalnum():
        return "mixed"
    return "space" if token.isspace() else token


def _beside(classes: list[str], k: int, step: int) -> str:
    """What stands next to a segment: the class of the token at ``k``, and of a mark also what comes after it."""
    own = classes[k] if 0 <= k < len(classes) else "edge"
    if len(own) > 1 or own.isalnum():
        return own
    after = classes[k + step] if 0 <= k + step < len(classes) else "edge"
    return own + after[:1]


@lru_cache(maxsize=1 << 16)
def _span_features(key: str) -> tuple[str, ...]:
    """Features of all segments with this key: what ``segments`` says of their shape and checks."""
    shape, _, checks = key.partition("|")
    marks = "".join(sorted({c for c in re.sub(r"<[0-9]>", "", shape) if not c.isalnum()}))
    return (f"shape={shape[:60]}", f"marks={marks}", *filter(None, checks.split("|")), "bias")


def _number_key(numbers: list[str], shape: str) -> str:
    """Shape and checks of a number whose groups of digits are ``numbers``."""
    digits = "".join(numbers)
    out = [shape, f"digits={len(digits)}", f"groups={len(numbers)}", f"zeros={min(2, len(digits) - len(digits.lstrip('0')))}", f"plus={shape[:1] == '+'}"]
    if 12 <= len(digits) <= 19:
        out.append(f"checksum={luhn(digits)}{len(set(map(len, numbers[:-1])))}")
    if len(numbers) == 4:
        out.append(f"octets={all(len(g) <= 3 and int(g) <= 255 for g in numbers)}{shape.count('.')}")
    return "|".join(out)


class Field:
    """A semi-Markov conditional random field over the tokens of a window."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}
        self._known: dict[str, tuple[float, ...]] = {}

    @staticmethod
    def segments(tokens: list[str]) -> list[list[tuple[int, str]]]:
        """For every end, the (start, key) of the segments that may be an entity.

        A segment is a number, groups of digits with marks and single spaces between them, or an address, a name, an at sign
        and labels with dots, signs and dots also spelt out. Other text is in no segment.
        """
        out: list[list[tuple[int, str]]] = [[] for _ in range(len(tokens) + 1)]
        number = [_is_number(t) for t in tokens]
        for j in range(1, len(tokens) + 1):
            if not number[j - 1]:
                continue
            shape, numbers, digits, dots = "", [], 0, 0
            for i in range(j - 1, max(-1, j - 1 - MOST_TOKENS), -1):
                t = tokens[i]
                if number[i]:
                    digits += len(t)
                    if digits > MOST_DIGITS or len(numbers) == MOST_GROUPS:
                        break
                    numbers.insert(0, t)
                    shape = f"<{min(len(t), 6)}>{shape}"
                elif t not in _NUMBER_MARKS or t == " " and shape[0] == " ":
                    break
                else:
                    dots += t == "."
                    shape = t + shape
                if (number[i] or t in "+(") and (digits >= 7 or len(numbers) == 4 and dots >= 3):
                    out[j].append((i, _number_key(numbers, shape)))
        for p, t in enumerate(tokens):
            if t == "@" or t == "at" and p and tokens[p - 1] in ("(", "[", " "):
                Field._addresses(tokens, p, out)
        return out

    @staticmethod
    def _addresses(tokens: list[str], p: int, out: list[list[tuple[int, str]]]) -> None:
        a, b, sign = p, p + 1, "@"
        if tokens[p] != "@":
            if tokens[a - 1] == " ":
                a -= 1
            if a == 0 or tokens[a - 1] not in "([":
                return
            a -= 1
            b += b < len(tokens) and tokens[b] == " "
            if b >= len(tokens) or tokens[b] not in ")]":
                return
            b, sign = b + 1, tokens[a]
            a -= a > 0 and tokens[a - 1] == " "
            b += b < len(tokens) and tokens[b] == " "
        starts, size = [], 0
        for i in range(a - 1, max(-1, a - 1 - MOST_TOKENS // 2), -1):
            size += len(tokens[i])
            if not (tokens[i].isalnum() or tokens[i] in "._%+-") or size > MOST_CHARACTERS:
                break
            if tokens[i].isalnum():
                starts.append((i, "".join(tokens[i:a])))
        text = "".join(tokens[b : b + MOST_TOKENS])
        at = _LABEL.match(text)
        labels, end = 1, at.end() if at else 0
        while at and starts and (at := _NEXT_LABEL.match(text, end, MOST_CHARACTERS)):
            labels += 1
            spelt = at.start(1) - end > 1
            end, j, size = at.end(), b, 0
            while size < end:
                size += len(tokens[j])
                j += 1
            if size != end:
                break
            last = tokens[j - 1]
            for i, name in starts:
                if j - i <= MOST_TOKENS:
                    whole = i == 0 or not (tokens[i - 1].isalnum() or tokens[i - 1] in "._%+-")
                    out[j].append((i, f"a{sign}|whole={whole}|labels={min(labels, 5)}|spelt={spelt}|top={'a' if last.isalpha() else '0'}{min(len(last), 5)}|more={bool(_NEXT_LABEL.match(text, end))}|name={name.isdigit()}"))

    def _scored(self, tokens: list[str]):
        w = self.weights
        classes = [_class(t) for t in tokens]
        outside = [w.get(f"O|{c}", 0.0) for c in classes]
        own = []
        for j, spans in enumerate(self.segments(tokens)):
            right = _beside(classes, j, 1) if spans else ""
            row = []
            for i, key in spans:
                features = (*_span_features(key), f"left={_beside(classes, i - 1, -1)}", f"right={right}")
                for kind in KINDS:
                    row.append((i, kind, sum([w.get(f"{kind}|{f}", 0.0) for f in features]), features))
            own.append(row)
        return classes, outside, own

    def _scores(self, name: str, key: str) -> tuple[float, ...]:
        """Each kind's weight of one feature, or of a segment's key."""
        found = self._known.get(name + key)
        if found is None:
            features = _span_features(key) if not name else (f"{name}{key}",)
            found = self._known[name + key] = tuple(sum([self.weights.get(f"{kind}|{f}", 0.0) for f in features]) for kind in KINDS)
            if len(self._known) > 1 << 16:
                self._known.clear()
        return found

    def decode(self, tokens: list[str]) -> list[tuple[int, int, str]]:
        """The best segmentation's entities as (first token, end token, kind)."""
        classes = [_class(t) for t in tokens]
        outside = {c: self.weights.get(f"O|{c}", 0.0) for c in set(classes)}
        best, back = [0.0] * (len(tokens) + 1), [(-1, "")] * (len(tokens) + 1)
        for j, spans in enumerate(self.segments(tokens)):
            if not j:
                continue
            best[j], back[j] = best[j - 1] + outside[classes[j - 1]], (j - 1, "")
            right = self._scores("right=", _beside(classes, j, 1)) if spans else ()
            for i, key in spans:
                left = self._scores("left=", _beside(classes, i - 1, -1))
                for kind, x, y, z in zip(KINDS, self._scores("", key), left, right, strict=True):
                    if best[i] + (x + y + z) > best[j]:
                        best[j], back[j] = best[i] + (x + y + z), (i, kind)
        out, j = [], len(tokens)
        while j:
            i, kind = back[j]
            if kind:
                out.append((i, j, kind))
            j = i
        return out[::-1]

    def _gradient(self, tokens: list[str], gold: list[tuple[int, int, str]]) -> dict[str, float]:
        """Observed minus expected features, by the forward and backward sums over all segmentations."""
        classes, outside, own = self._scored(tokens)
        n = len(tokens)
        ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            ahead[j] = _log_sum([ahead[j - 1] + outside[j - 1], *(ahead[i] + s for i, _, s, _ in own[j])])
        into: list[list[float]] = [[] for _ in range(n + 1)]
        for j in range(n, 0, -1):
            behind[j] = _log_sum(into[j]) if j < n else 0.0
            into[j - 1].append(behind[j] + outside[j - 1])
            for i, _, s, _ in own[j]:
                into[i].append(behind[j] + s)
        grad: dict[str, float] = defaultdict(float)
        covered = {k for i, j, _ in gold for k in range(i, j)}
        for k, c in enumerate(classes):
            grad[f"O|{c}"] += (k not in covered) - math.exp(ahead[k] + outside[k] + behind[k + 1] - ahead[n])
        real = set(gold)
        for j in range(1, n + 1):
            for i, kind, s, features in own[j]:
                g = ((i, j, kind) in real) - math.exp(ahead[i] + s + behind[j] - ahead[n])
                if abs(g) > 1e-6:
                    for f in features:
                        grad[f"{kind}|{f}"] += g
        return grad

    def train(self, windows: list[tuple[list[str], list[tuple[int, int, str]]]], passes: int = PASSES, rate: float = 0.5, penalty: float = 1e-3) -> Field:
        squares: dict[str, float] = defaultdict(float)
        for _ in range(passes):
            for tokens, gold in windows:
                for f, g in self._gradient(tokens, gold).items():
                    g -= penalty * self.weights.get(f, 0.0)
                    squares[f] += g * g
                    self.weights[f] = self.weights.get(f, 0.0) + rate * g / math.sqrt(squares[f] + 1e-6)
        self._known.clear()
        return self


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _valid_card(rng: random.Random) -> str:
    body = [rng.choice("3456"), *(rng.choice("0123456789") for _ in range(rng.choice((13, 14, 14, 14, 14))))]
    return next("".join(body) + c for c in "0123456789" if luhn("".join(body) + c))


def synthetic_window(rng: random.Random) -> tuple[list[str], list[tuple[int, int, str]]]:
    """Prose around entities in their written forms, and around numbers, codes and secrets that are none."""
    letters = "abcdefghijklmnoprstuvw"

    def name() -> str:
        return "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))

    def number(n: int) -> str:
        return str(rng.randint(1, 9)) + "".join(rng.choice("0123456789") for _ in range(n - 1))

    def entity() -> tuple[str, str]:
        kind = rng.choice((*KINDS, "phone", "", "", "", ""))
        if kind == "email":
            user = rng.choice((name(), f"{name()}.{name()}", f"{name()}.{number(2)}", f"{name()}_{number(1)}", f"{name()}+{name()}"))
            host = [rng.choice((name(), f"{name()}{number(1)}", f"{name()}-{name()}")) for _ in range(rng.randint(1, 2))] + [rng.choice(("com", "org", "net", "de"))]
            at, dot = rng.choice((("@", "."), ("@", "."), (" (at) ", "."), (" [at] ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]")))
            return kind, user + at + dot.join(host)
        if kind == "ip":
            return kind, rng.choice((".", ".", "[.]")).join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            digits = _valid_card(rng)
            return kind, rng.choice(("", "", " ", "-", ".", "/")).join((digits[:4], digits[4:8], digits[8:12], digits[12:]))
        if kind == "phone":
            form = rng.choice((
                "+{c} ({a}) {b}-{d}", "+{c} {a} {b} {d}", "({a}) {b}-{d}", "{a}-{b}-{d}", "+{c}-{a}-{b}-{d}", "00{c} {a} {b}{d}", "+{c}/{a}/{b}{d}", "({a}) {b} {d}",
                "({z}) {b}-{d}", "{z}-{b}-{d}", "{z}/{b}{d}", "{z} {b} {d}", "({z}) {b}{d}", "{y} {e} {e} {e} {e}", "{y}.{e}.{e}.{e}.{e}", "1-{a}-{b}-{d}", "{a}.{b}.{d}", "{z} {d} {d}",
            ))
            return kind, form.format(c=number(rng.randint(1, 2)), a=number(3), b=number(3), d=number(4), z="0" + number(rng.randint(2, 3)), y="0" + number(1), e=number(2))
        false_card = _valid_card(rng)
        false_card = false_card[:-1] + str((int(false_card[-1]) + rng.randint(1, 9)) % 10)
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((32, 40))))
        rows = " ".join(number(rng.randint(1, 4)) for _ in range(rng.randint(3, 8)))
        return "", rng.choice((
            f"20{number(2)}-0{number(1)}-1{number(1)}", f"{number(2)}/{number(2)}/20{number(2)}", f"0{number(1)}.1{number(1)}.20{number(2)}", f"{number(2)}:{number(2)}:{number(2)}", f"{number(1)}.{number(1)}.{number(2)}", f"{number(1)},{number(3)}.{number(2)}", f"#{number(5)}", f"v{number(1)}.{number(2)}",
            number(rng.randint(1, 11)), f"{number(2)}-{number(2)}", false_card, f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}", f"{number(3)} {number(3)}", f"AKIA{name().upper()}{number(3)}{name().upper()}", f"password={number(4)}{name()}{number(2)}", f"300.{number(3)}.999.{number(3)}", f"{name()}@ {number(2)}", f"meet at {number(2)}", f"{number(4)}-{number(4)}", f"{number(6)}{name()}{number(8)}{name()}",
            f'token = "{secret}"', secret, rows, rows, f"20{number(2)}-0{number(1)}-1{number(1)} {number(2)}:{number(2)}:{number(2)}.{number(3)}", f"{number(3)}-{number(7)}-{number(7)}", f"{number(4)} {number(4)} {number(4)}", f"{number(2)}.{number(3)}.{number(3)}", f"{number(3)} {name()} {number(3)} {name()} {number(4)}", f"{number(1)}. {name()} {number(1)}. {name()}", f"{number(4)}-{number(4)}, {number(4)}-{number(4)}", f"{number(5)} {name()} {number(5)}", f"({number(4)}) {name()} {number(4)}", f"{number(1)}.{number(5)}, {number(2)}.{number(6)}", f"{number(3)} + {number(4)} - {number(3)}",
        ))

    tokens: list[str] = []
    gold: list[tuple[int, int, str]] = []
    for _ in range(rng.choice((1, 1, 2, 2, 3))):
        for _ in range(rng.randint(0 if gold else 1, 4)):
            tokens += [name(), rng.choice((" ", " ", " ", ", ", ". ", "\n"))[:1], *([" "] if rng.random() < 0.1 else [])]
            if tokens[-1] in ",.":
                tokens.append(" ")
        kind, text = entity()
        own = _TOKEN.findall(text)
        if kind:
            gold.append((len(tokens), len(tokens) + len(own), kind))
        tokens += own
        tokens += rng.choice(([" "], [" "], [".", " "], [",", " "], ["\n"], [";", " "]))
    return tokens + [name()], gold


def trained_field(windows: int = WINDOWS, seed: int = 5) -> Field:
    rng = random.Random(seed)
    return Field().train([synthetic_window(rng) for _ in range(windows)])


def added_spans(text: str, field: Field, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that the field finds in windows around digits and at signs and that overlap no base span."""
    first = _TRIGGER.search(text)
    if not first:
        return []
    starts, ends = [], []
    for a, e, _ in base:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(a), ends.append(e)

    def touched(lo: int, hi: int) -> bool:
        k = bisect.bisect_left(starts, hi) - 1
        return k >= 0 and ends[k] > lo

    out: list[tuple[int, int, str]] = []
    for lo, hi in _windows(text):
        if base and all(touched(*m.span()) for m in _TRIGGER.finditer(text, lo, hi)):
            continue
        out += [span for span in _decoded(text, lo, hi, field) if not touched(span[0], span[1])]
    return out


def _decoded(text: str, lo: int, hi: int, field: Field):
    """The field's (start, end, kind) of one window, STRETCH characters at a time; each span is decided once."""
    while lo < hi:
        end = min(hi, lo + STRETCH)
        tokens = _TOKEN.findall(text, lo, end)
        if end < hi:
            # the last token may go on; what the ones before it hold is decided with what follows
            tokens.pop()
            if len(tokens) <= 2 * MOST_TOKENS:
                lo = _TOKEN.match(text, lo + sum(map(len, tokens))).end()
                continue
        bounds = list(accumulate(map(len, tokens), initial=lo))
        settled = len(tokens) if end == hi else len(tokens) - MOST_TOKENS
        for i, j, kind in field.decode(tokens):
            if j > settled:
                settled = min(settled, i)
                break
            yield bounds[i], bounds[j], kind
        lo = bounds[settled]


def _windows(text: str):
    """(start, end) around runs of triggers, in order and apart from each other."""
    lo = hi = None
    last = None
    for m in chain(_TRIGGER.finditer(text), (None,)):
        if m and hi is not None and m.start() - hi <= REACH:
            hi = m.end()
            continue
        if hi is not None:
            a, b = _widened(text, lo, hi)
            if last and a <= last[1]:
                last = last[0], max(b, last[1])
            else:
                if last:
                    yield last
                last = a, b
        if m:
            lo, hi = m.span()
    if last:
        yield last


def _widened(text: str, lo: int, hi: int) -> tuple[int, int]:
    """The window with up to CONTEXT words on both sides, within CONTEXT_CHARACTERS."""
    least, most = max(0, lo - CONTEXT_CHARACTERS), min(len(text), hi + CONTEXT_CHARACTERS)
    for _ in range(CONTEXT):
        lo = max(text.rfind(" ", least, max(least, lo - 1)), text.rfind("\n", least, max(least, lo - 1)), least - 1) + 1
        hi = min((x for x in (text.find(" ", hi + 1, most), text.find("\n", hi + 1, most)) if x >= 0), default=most)
    # an address with spelt dots is not cut
    for pattern in (_NEXT_WORD if _DOT_BEHIND.search(text, max(0, hi - 8), hi) else None, _DOT_AHEAD):
        if pattern and (m := pattern.match(text, hi, hi + MOST_CHARACTERS)):
            hi = m.end()
    return lo, hi


def find_personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, base and spans, arrays of (start, end, kind) in code points, end exclusive.

    ``base`` holds the exact patterns' matches, ``spans`` those and the field's. A null or empty text has none.
    Every row is kept, also repeated ones and those without doc_id. Texts are read whole.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((field or trained_field()).weights)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def find(batches):
        own = Field(shared.value)
        for batch in batches:
            base, spans = [], []
            for text in batch.column(1).to_pylist():
                if not _TRIGGER.search(text):
                    base.append([]), spans.append([])
                    continue
                exact = base_spans(text)
                every = sorted(exact + added_spans(text, own, exact), key=lambda f: (f[0], KINDS.index(f[2])))
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in exact])
                spans.append([{"start": s, "end": e, "kind": k} for s, e, k in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(spans, span)], ["doc_id", "base", "spans"])

    kind = "array<struct<start:int,end:int,kind:string>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column().alias("text"))
    return rows.mapInArrow(frugal(find), f"doc_id long, base {kind}, spans {kind}")


def redacted(text: str, field: Field) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in angle brackets."""
    if not _TRIGGER.search(text):
        return text
    exact = base_spans(text)
    out, at = [], 0
    for s, e, kind in sorted(exact + added_spans(text, field, exact), key=lambda f: (f[0], -f[1])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None = None, column: str = "text") -> DataFrame:
    """``docs`` with personal data in ``column`` replaced; null stays null."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((field or trained_field()).weights)
    at, schema = docs.columns.index(column), docs.schema

    def replace(batches):
        own = Field(shared.value)
        for batch in batches:
            texts = pa.array([t if t is None else redacted(t, own) for t in batch.column(at).to_pylist()], batch.column(at).type)
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(frugal(replace), schema)


def _joined(spans):
    each = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", each)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
