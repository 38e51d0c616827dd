"""Line dedup, the audit of sources and lexical search against brute force, on odd rows and in their parts."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chunkloom.llm import divergence, lexical_search, line_dedup

SPACES = " \t\n\x0b\x0c\r"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# Line dedup


def reference_lines(rows):
    """[(doc_id, kept text, lines, dropped)] of (doc_id, text) rows."""
    holders = collections.defaultdict(set)
    keyed = [(d, [(line, lowered(line.strip(SPACES))) for line in (t or "").split("\n")]) for d, t in rows]
    for d, lines in keyed:
        for _, key in lines:
            if len(key) >= 10:
                holders[key].add(d)
    first = {k: min(ids, key=lambda d: (d is None, d)) for k, ids in holders.items() if len(ids) > 1}
    out = []
    for d, lines in keyed:
        kept = [line for line, key in lines if first.get(key, d) == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


ODD = [
    (1, "one line here\nshared boilerplate line\n\nshort"),
    (2, "  SHARED boilerplate LINE\r\nown line of two\nshort"),
    (2, "own line of two\nown line of two"),  # a repeated doc_id is one document
    (None, "shared boilerplate line\nonly without an id"),
    (None, "only without an id\nheld by eight too!"),
    (3, None), (4, ""), (5, "\n\n\n"), (6, " \t shared boilerplate line"),
    (7, "Ünïcode schön ähm\nÜNÏCODE schön ähm\nÜnïcode schön ähm"), (8, "Ünïcode schön ähm\nheld by eight too!"), (9, "123456789\n1234567890"), (10, "123456789\n1234567890"),
    (11, "x" * 300_000 + "\nshared boilerplate line"), (12, "\n".join(["x" * 300_000] * 3)), (-4, "held by eight too!\nheld by eight too!"),
]


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    pool = [f"pool line number {i} of many" for i in range(40)]
    rows = ODD + [(100 + i, "\n".join(rng.choice([*pool, f"own {i} {j} line of text", "", "tiny"]) for j in range(rng.randrange(1, 12)))) for i in range(300)]
    docs = spark.createDataFrame([(*r, i, "kept") for i, r in enumerate(rows)], "doc_id long, text string, n_lines int, digests string").repartition(7)
    got = line_dedup.deduplicated(docs, "n_before", "n_gone")
    assert set(got.columns) == {*docs.columns, "n_before", "n_gone"}
    assert {r["digests"] for r in got.collect()} == {"kept"}
    wanted = sorted((*r[:2], i, *r[2:]) for i, r in ((i, (repr(d), t, n, m)) for i, (d, t, n, m) in enumerate(reference_lines(rows))))
    assert sorted((repr(r["doc_id"]), r["text"], r["n_lines"], r["n_before"], r["n_gone"]) for r in got.collect()) == wanted
    plain = line_dedup.deduplicated(docs)
    assert plain.columns == docs.columns
    assert sorted(r["text"] for r in plain.collect()) == sorted(w[1] for w in wanted)
    clash = line_dedup.deduplicated(docs, "n_lines", "digests")  # columns of these names are replaced
    assert sorted((r["n_lines"], r["digests"]) for r in clash.collect()) == sorted((w[3], w[4]) for w in wanted)


def test_lines_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.deduplicated(empty, "a", "b").collect() == []
    nulls = spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string")
    assert [r["text"] for r in line_dedup.deduplicated(nulls).collect()] == ["", ""]


def test_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_IDS", 0)
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    got = sorted((repr(r["doc_id"]), r["text"], r["b"]) for r in line_dedup.deduplicated(docs, "a", "b").collect())
    assert got == sorted((repr(d), t, m) for d, t, _, m in reference_lines(ODD))


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(5)
    for bits in (1 << 12, 1 << 16):  # the smaller one fills up
        parts = [rng.integers(0, 3000, 500).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(4)]
        once, twice = np.zeros(bits // 64, np.uint64), np.zeros(bits // 64, np.uint64)
        for part in parts:
            a, b = np.zeros_like(once), np.zeros_like(once)
            for half in np.array_split(part, 2):
                line_dedup._seen(a, b, half, bits)
            twice |= b | (once & a)
            once |= a
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        held = line_dedup._held(twice, line_dedup._bits(keys, bits))
        assert held[counts > 1].all()
        assert bits < 1 << 16 or held[counts == 1].mean() < 0.2


# Audit of sources

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def reference_audit(rows):
    rows = [(lang or "", source or "", TERM.findall(lowered(text or ""))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        held = collections.Counter(t for own, _, ts in rows if own == lang for t in set(ts))
        kept = {t for t, n in held.items() if n >= 30}
        of_lang = collections.Counter(t for own, _, ts in rows if own == lang for t in ts if t in kept)
        groups = {s: collections.Counter() for own, s, _ in rows if own == lang}
        for own, s, ts in rows:
            if own == lang:
                groups[s].update(t for t in ts if t in kept)

        def p(counter, t):
            return 1 + 10**9 * (counter[t] + 5) // (counter.total() + 5 * len(kept))

        for s, mine in groups.items():
            pairs = [(sum(abs(p(mine, t) - p(other, t)) for t in kept), o) for o, other in groups.items() if o != s]
            words = [(p(mine, t) - p(of_lang, t), t) for t in kept if mine[t] and p(mine, t) > p(of_lang, t)]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", words, 50)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def audited(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_audit_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"{a}{b}{'lang' * 6 if a == 'pre' else ''}" for a in ("pre", "ö", "tun", "Zu", "ñandu") for b in "abcdefghijklmnopqrst"]
    rows = [(rng.choice(["de", "en", None]), rng.choice(["s0"] * 6 + [f"s{i}" for i in range(9)] + [None]), " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for _ in range(400)]
    rows += [("de", "wordless", "123 !!"), ("de", "null text", None), ("xx", "few", "only a few words"), ("xx", "others", ""), ("yy", "alone", "word"), ("de", "s1", "prea " * 30_000)]
    rows += rows[:5]
    docs = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, item string").repartition(6)
    assert audited(divergence.audit(docs)) == reference_audit(rows)


def test_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES", 3)
    monkeypatch.setattr(divergence, "TERMS", 7)
    rng = random.Random(9)
    rows = [("en", f"s{i % 11}", " ".join(rng.choices([f"w{chr(97 + k)}" for k in range(26)], k=20))) for i in range(200)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert audited(divergence.audit(docs)) == reference_audit(rows)


def test_sources_that_lack_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES", 2)
    monkeypatch.setattr(divergence, "TERMS", 3)
    words = [f"w{chr(97 + k)}" for k in range(26)]
    rows = [("en", f"s{i % 3}", " ".join(words)) for i in range(60)] + [("en", f"t{k}", f"{w} {w}") for k, w in enumerate(words)]
    rows += [("en", "wordless", ""), ("en", "null text", None), ("en", "rare", "unkept words"), ("de", "wordless", "")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert audited(divergence.audit(docs)) == reference_audit(rows)


def test_many_terms_and_a_source_of_few(spark):
    words = ["w" + chr(97 + k // 26) + chr(97 + k % 26) for k in range(600)]
    rows = [("en", f"s{i % 2}", " ".join(words)) for i in range(60)] + [("en", "few", "waa wab"), ("en", None, None)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert audited(divergence.audit(docs)) == reference_audit(rows)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []
    assert divergence.audit(spark.createDataFrame([(None, None, None)], "lang string, source string, text string")).collect() == []


def test_shares_beyond_long_integers(spark):
    count, total = 9 * 10**17, 10**18
    got = spark.range(1).select(divergence.share(F.lit(count), F.lit(total), F.lit(1000)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (count + 5) // (total + 5000)


def test_radix_selection_breaks_ties_by_bytes(spark):
    rng = random.Random(4)
    rows = []
    for group in "abcdef":
        items = {rng.choice(["", "shared start of many", "é", "日本", "zz\U0001f600"]) + rng.choice(["", "a", "b", "ab", "ü"]) + str(rng.randrange(60)) for _ in range(150)}
        values = [0, 1, 2**29, 2**29 + 1, (1 << 30) - 1, 1024, 1025]
        rows += [(group, i, rng.choice(values[: 1 + "abcdef".index(group)])) for i in sorted(items)]
    rows += [("few", "only", 7)]
    for most in (1, 7, 50):
        got = sorted(tuple(r) for r in divergence.top_ranked(spark.createDataFrame(rows, "k string, item string, value long"), ["k"], most).collect())
        wanted = [r for k in {r[0] for r in rows} for r in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1].encode()))[:most]]
        assert got == sorted(wanted)


# Lexical search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def reference_search(docs, items, best=20):
    bags = [(d, collections.Counter(WORD.findall(lowered(t or "")))) for d, t in docs]
    n_docs, length = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    held = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, b in bags:
            m = 75 + 25 * b.total() * n_docs // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in WORD.findall(lowered(text or "")) if b[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(found)[:best], 1)]
    return sorted(out, key=repr)


def some_documents(n, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)] + ["Éa", "ÉA", "straße"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 80))) + rng.choice([".", "!", ""])) for i in range(n)]
    docs += [(None, docs[5][1]), (None, docs[5][1]), (7, docs[3][1]), (n, None), (n + 1, ""), (n + 2, "--- !"), (n + 3, "w1 W2 " * 40_000), (-1, docs[3][1]), (n + 4, docs[3][1])]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for k in range(25)] + [(100, docs[3][1]), (101, docs[5][1]), (102, ""), (103, None), (104, "w1 w1 w1 w2"), (105, "nowhere to be found"), (106, "w1")]
    return docs, items


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_search_against_brute_force(spark, monkeypatch):
    docs, items = some_documents(400, 1)
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(5)
    queries = spark.createDataFrame([*items, (None, "w1"), (5, "zzz")], "item_id long, text string")  # of item 5 the lesser text counts
    items = [(k, min(t, "zzz") if k == 5 else t) for k, t in items]
    assert rows_of(lexical_search.search(table, queries)) == reference_search(docs, items)
    monkeypatch.setattr(lexical_search, "BLOCK", 10)
    assert rows_of(lexical_search.search(table, queries, best=3)) == reference_search(docs, items, 3)


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(docs, items).collect() == []
    assert lexical_search.search(items.selectExpr("item_id AS doc_id", "text"), items.limit(0)).collect() == []
    assert lexical_search.search(spark.createDataFrame([(1, None)], "doc_id long, text string"), items).collect() == []


def test_windows_skip_documents_and_lose_none():
    docs, items = some_documents(3000, 2)
    docs = [(d, t) for d, t in docs if len(t or "") < 10_000]
    queries = lexical_search.Queries(pa.array([t or "" for _, t in items], pa.large_string()))
    windows = [docs[a : a + 250] for a in range(0, len(docs), 250)]
    parsed = []
    for window in windows:
        for _, rows, *postings in queries.postings(pa.array([t or "" for _, t in window], pa.large_string())):
            parsed.append((pa.array([d for d, _ in window], pa.int64()), rows, postings))
    queries.documents = sum(int(np.count_nonzero(p[0])) for _, _, p in parsed)
    queries.length = sum(int(p[0].sum()) for _, _, p in parsed)
    held = sum(np.bincount(p[2], minlength=len(queries.terms)) for _, _, p in parsed)
    queries.weights = np.floor(1000 * np.log((2 * queries.documents + 2) / (2 * held + 1))).astype(np.int64)
    heaps, scored = lexical_search.Heaps(queries, 20), []
    whole = heaps._whole
    heaps._whole = lambda at, *rest: scored.append(len(at)) or whole(at, *rest)
    for ids, rows, postings in parsed:
        heaps.add(ids, rows, *postings)
    got = [(items[k][0], n, None if w else d, s) for k, h in enumerate(heaps.kept) for n, (s, w, d) in enumerate(zip(*(x.tolist() for x in h), strict=True), 1)]
    assert sorted(got, key=repr) == reference_search(docs, items)
    assert scored and sum(scored) < 0.5 * len(items) * len(docs)


def test_kept_lines_digest(spark):
    docs = spark.createDataFrame([(1, "a line of text\nb"), (2, "a line of text\nb")], "doc_id long, text string")
    got = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in line_dedup.deduplicated(docs).collect()}
    assert got == {1: hashlib.sha256(b"a line of text\nb").hexdigest(), 2: hashlib.sha256(b"b").hexdigest()}
