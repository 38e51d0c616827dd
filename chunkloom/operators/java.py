"""A structural scanner of Java sources and the chunks, edges and names that it gives.

Supported: package, imports, top-level and nested classes, interfaces, enums, records and annotation
types with generics, annotations, fields, methods and doc comments; strings, text blocks,
characters and comments never count as code. Bodies are skipped by matching brackets. A file in
which brackets do not match, or without any type, gives one row of its error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.split import split_content
from ..schema import SECTION_KEY
from .chunk_maps import chunk_columns

# The mime type, sizes and the line that stands before a method.
MIME_TYPE = "text/x-java-code"
SIZE, OVERLAP = 1300, 100
METHOD_PREFIX = "//Methode {} in class {}:"

_TOKEN = re.compile(r'"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|/\*.*?\*/|//[^\n]*|[A-Za-z_$\u0080-￿][\w$]*|\d[\w.]*|\.\.\.|::|->|[^\s\w]', re.DOTALL)
_TYPE_WORDS = {"class", "interface", "enum", "record"}
_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "strictfp", "default", "transient", "volatile", "sealed"}


@dataclass
class Token:
    text: str
    start: int
    end: int


@dataclass
class Method:
    signature: str
    start: int
    end: int
    annotations: list[str]
    returns: str
    parameters: list[str]
    doc: tuple[int, int] | None


@dataclass
class Type:
    name: str
    fqn: str
    start: int
    end: int
    doc: tuple[int, int] | None
    header: str
    extends: list[str] = field(default_factory=list)
    implements: list[str] = field(default_factory=list)
    fields: list[tuple[str, str]] = field(default_factory=list)
    methods: list[Method] = field(default_factory=list)
    types: list[Type] = field(default_factory=list)


@dataclass
class Source:
    package: str
    package_text: str
    imports: list[tuple[str, bool, int, int]]
    types: list[Type]


class JavaError(ValueError):
    """A source that is not understood."""


class _Scanner:
    def __init__(self, text: str):
        self.text, self.at, self.doc = text, 0, None
        self.tokens, self.docs = [], {}
        doc = None
        for m in _TOKEN.finditer(text):
            own = m.group()
            if own.startswith("/*") or own.startswith("//"):
                if own.startswith("/**") and len(own) > 4:
                    doc = m.span()
                continue
            if doc:
                self.docs[len(self.tokens)] = doc
                doc = None
            self.tokens.append(Token(own, *m.span()))

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead].text if self.at + ahead < len(self.tokens) else ""

    def closing(self, at: int) -> int:
        """The token that closes the bracket at ``at``."""
        pairs, depth = {"(": ")", "{": "}", "[": "]"}, []
        for k in range(at, len(self.tokens)):
            own = self.tokens[k].text
            if own in pairs:
                depth.append(pairs[own])
            elif own in ")}]":
                if not depth or depth.pop() != own:
                    break
                if not depth:
                    return k
        raise JavaError(f"unmatched {self.tokens[at].text} at character {self.tokens[at].start}")

    def annotation(self) -> str:
        first = self.at
        self.at += 2
        while self.peek() == ".":
            self.at += 2
        if self.peek() == "(":
            self.at = self.closing(self.at) + 1
        return self.text[self.tokens[first].start : self.tokens[self.at - 1].end]

    def joined(self, tokens: list[Token]) -> str:
        """Source text of a type, with one space after commas and around words."""
        out = ""
        for k, t in enumerate(tokens):
            before = tokens[k - 1].text if k else ""
            gap = k and (before in (",", "&") or t.text in ("&", "?", "extends", "super") and before != "<" or before in ("?", "extends", "super")) or (k and re.match(r"[\w$]", t.text) and re.match(r"[\w$]", before[-1:]))
            out += (" " if gap else "") + t.text
        return out


def parse(text: str) -> Source:
    s = _Scanner(text)
    package, package_text, imports, types = "", "", [], []
    while s.at < len(s.tokens):
        own = s.peek()
        if own in ("package", "import"):
            first = s.at
            while s.at < len(s.tokens) and s.peek() != ";":
                s.at += 1
            if s.at >= len(s.tokens):
                raise JavaError(f"no end of {own}")
            words = [t.text for t in s.tokens[first + 1 : s.at]]
            span = (s.tokens[first].start, s.tokens[s.at].end)
            if own == "package":
                package, package_text = "".join(words), text[slice(*span)]
            else:
                words = words[1:] if words[0] == "static" else words
                name = "".join(words)
                imports.append((name.removesuffix(".*"), name.endswith(".*"), *span))
            s.at += 1
        elif own == ";":
            s.at += 1
        else:
            types.append(_member(s, package, None))
    if not types:
        raise JavaError("no type in the file")
    return Source(package, package_text, imports, types)


def _member(s: _Scanner, home: str, owner: Type | None) -> Type | None:
    """A type (returned), or a method or field of ``owner``."""
    first, doc, annotations = s.at, s.docs.get(s.at), []
    while True:
        own = s.peek()
        if own == "@" and s.peek(1) != "interface":
            annotations.append(s.annotation())
        elif own in _MODIFIERS or own == "non" and s.peek(1) == "-":
            s.at += 3 if own == "non" else 1
        else:
            break
        doc = doc or s.docs.get(s.at)
    start = s.tokens[first].start
    own = s.peek()
    if own == "@" or own in _TYPE_WORDS and re.match(r"[\w$]", s.peek(1)) and not (own == "record" and s.peek(2) not in ("(", "<")):
        return _type(s, home, start, doc)
    if owner is None:
        raise JavaError(f"{own!r} where a type was expected, character {start}")
    if own == "{":
        s.at = s.closing(s.at) + 1
        return None
    if own == ";":
        s.at += 1
        return None
    _method_or_field(s, owner, start, doc, annotations)
    return None


def _skip_generics(s: _Scanner, at: int) -> int:
    """The token after the angle brackets that open at ``at``."""
    depth = 0
    for k in range(at, len(s.tokens)):
        depth += {"<": 1, ">": -1}.get(s.tokens[k].text, 0)
        if depth == 0:
            return k + 1
    raise JavaError("unmatched <")


def _type_end(s: _Scanner, at: int) -> int:
    """The token after a type's name, generics and brackets."""
    while s.tokens[at].text == "@":
        keep, s.at = s.at, at
        s.annotation()
        at, s.at = s.at, keep
    at += 1
    while at < len(s.tokens):
        own = s.tokens[at].text
        if own == "<":
            at = _skip_generics(s, at)
        elif own == "." and re.match(r"[\w$]", s.tokens[at + 1].text):
            at += 2
        elif own == "[" and s.tokens[at + 1].text == "]":
            at += 2
        else:
            return at
    raise JavaError("a type at the end of the file")


def _types_list(s: _Scanner, at: int) -> tuple[list[str], int]:
    out = []
    while True:
        end = _type_end(s, at)
        out.append(s.joined(s.tokens[at:end]))
        if s.tokens[end].text != ",":
            return out, end
        at = end + 1


def _type(s: _Scanner, home: str, start: int, doc: tuple[int, int] | None) -> Type:
    kind = s.peek()
    s.at += 2 if kind == "@" else 1
    name = s.peek()
    out = Type(name, f"{home}.{name}" if home else name, start, 0, doc, "")
    at = s.at + 1
    if at < len(s.tokens) and s.tokens[at].text == "<":
        at = _skip_generics(s, at)
    if kind == "record" and s.tokens[at].text == "(":
        at = s.closing(at) + 1
    while at < len(s.tokens) and s.tokens[at].text != "{":
        word = s.tokens[at].text
        if word not in ("extends", "implements", "permits"):
            raise JavaError(f"{word!r} in the header of {name}")
        names, at = _types_list(s, at + 1)
        if word != "permits":
            (out.extends if word == "extends" else out.implements).extend(names)
    if at >= len(s.tokens):
        raise JavaError(f"no body of {name}")
    out.header = s.text[start : s.tokens[at].end]
    close = s.closing(at)
    out.end = s.tokens[close].end
    s.at = at + 1
    if kind == "enum":
        while s.at < close and s.peek() != ";":
            s.at = s.closing(s.at) + 1 if s.peek() in "({[" else s.at + 1
        s.at += s.at < close
    while s.at < close:
        nested = _member(s, out.fqn, out)
        if nested:
            out.types.append(nested)
    s.at = close + 1
    return out


def _method_or_field(s: _Scanner, owner: Type, start: int, doc: tuple[int, int] | None, annotations: list[str]) -> None:
    at = _skip_generics(s, s.at) if s.peek() == "<" else s.at
    generics = s.joined(s.tokens[s.at : at])
    if s.tokens[at].text == owner.name and s.tokens[at + 1].text in ("(", "{"):
        body = at + 1
        while s.tokens[body].text != "{":
            body = s.closing(body) + 1 if s.tokens[body].text == "(" else body + 1
        s.at = s.closing(body) + 1
        return
    end = _type_end(s, at)
    returns = s.joined(s.tokens[at:end])
    name, after = s.tokens[end].text, s.tokens[end + 1].text
    if after != "(":
        k = end
        while s.tokens[k].text != ";":
            k = s.closing(k) + 1 if s.tokens[k].text in "({[" else k + 1
            if k >= len(s.tokens):
                raise JavaError(f"no end of field {name}")
        owner.fields.append((returns.removesuffix("[]"), s.text[start : s.tokens[k].end]))
        s.at = k + 1
        return
    close = s.closing(end + 1)
    parameters, k = [], end + 2
    while k < close:
        while s.tokens[k].text in ("final", "@"):
            if s.tokens[k].text == "@":
                keep, s.at = s.at, k
                s.annotation()
                k, s.at = s.at, keep
            else:
                k += 1
        stop = _type_end(s, k)
        text = s.joined(s.tokens[k:stop])
        if s.tokens[stop].text == "...":
            text, stop = text + "...", stop + 1
        k = stop + 1
        while k < close and s.tokens[k].text == "[":
            text, k = text + "[]", k + 2
        parameters.append(text)
        k += 1
    k = close + 1
    while s.tokens[k].text not in ("{", ";"):
        k = s.closing(k) + 1 if s.tokens[k].text in "([" else k + 1
        if k >= len(s.tokens):
            raise JavaError(f"no end of method {name}")
    k = s.closing(k) if s.tokens[k].text == "{" else k
    signature = f"{generics + ' ' if generics else ''}{returns} {name}({', '.join(parameters)})"
    owner.methods.append(Method(signature, start, s.tokens[k].end, annotations, returns, parameters, doc))
    s.at = k + 1


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at)


def _lines(lines: list[str], first: int, last: int) -> str:
    return "".join(x + "\n" for x in lines[first : last + 1])


def _all_types(types: list[Type]) -> Iterator[Type]:
    for t in types:
        yield t
        yield from _all_types(t.types)


def scanned(path: str, text: str) -> list[dict]:
    """Rows of one file: its pieces of text (kind piece), edges, imports, names and methods without doc, or its error."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    try:
        source = parse(text)
    except Exception as e:  # whatever one file holds, the others are scanned
        return [{"file": path, "kind": "error", "a": str(e) or "unexpected end of file"}]
    name = path.rsplit("/", 1)[-1].removesuffix(".java")
    primary = next((t for t in source.types if t.name == name), source.types[0])
    lines, rows = text.split("\n"), []
    lines = lines[:-1] if lines[-1] == "" else lines

    def piece(section, ident, parent, prefix, content, first, last):
        rows.append({"file": path, "kind": "piece", "a": ident, "b": parent, "section": section, "prefix": prefix, "text": content, "first": first, "last": last})

    block, first, last = "", 0, 0
    if source.imports:
        first, last = _line(text, min(i[2] for i in source.imports)), _line(text, max(i[3] for i in source.imports)) + 1
        block = _lines(lines, first, last)
    piece("imports", f"{primary.fqn}.imports", primary.fqn, "", block, first, last)
    for t in [primary, *(t for t in source.types if t is not primary)]:
        for m in t.methods:
            ident, prefix = f"{t.fqn}.{m.signature}", METHOD_PREFIX.format(m.signature, t.fqn)
            if m.doc:
                a, b = _line(text, m.doc[0]), _line(text, m.doc[1])
                piece("methodDoc", f"{ident}.javadoc", ident, prefix, _lines(lines, a, b), a, b + 1)
            a, b = _line(text, m.start), _line(text, m.end)
            piece("method", ident, t.fqn, prefix, _lines(lines, a, b), a, b + 1)
    for t in source.types:
        frame = source.package_text + "\n" if source.package_text else ""
        frame += block + (text[slice(*t.doc)] + "\n" if t.doc else "") + t.header + "\n"
        frame += "".join(f"    {f}\n" for _, f in t.fields) + "\n"
        for m in t.methods:
            frame += "".join(f"    {a}\n" for a in m.annotations) + f"    {m.signature}\n"
        piece("classFrame", t.fqn, None, "", frame + "}\n", _line(text, t.start), _line(text, t.end) + 1)
    for imported, whole, *_ in source.imports:
        rows.append({"file": path, "kind": "import", "a": imported, "whole": whole})
    for t in _all_types([primary]):
        for imported, _, *_ in source.imports:
            rows.append({"file": path, "kind": "edge", "a": t.fqn, "b": imported, "section": "import", "prefix": source.package})
        used = [("extends", x) for x in t.extends] + [("implements", x) for x in t.implements] + [("field", x) for x, _ in t.fields]
        used += [("returns", m.returns) for m in t.methods] + [("parameter", p.removesuffix("...")) for m in t.methods for p in m.parameters]
        rows.extend({"file": path, "kind": "edge", "a": t.fqn, "b": x, "section": k, "prefix": source.package} for k, x in used)
    for t in _all_types(source.types):
        rows.append({"file": path, "kind": "name", "a": t.name, "b": t.fqn})
        rows.extend({"file": path, "kind": "undocumented", "a": f"{t.fqn}.{m.signature}", "b": t.fqn, "text": m.signature, "first": _line(text, m.start)} for m in t.methods if not m.doc)
    return rows


_ROW = "file string, kind string, a string, b string, section string, prefix string, text string, first int, last int, whole boolean"
_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _ROW.split(", ")])


def scan(files: DataFrame) -> DataFrame:
    """The scanner's rows of ``files`` (path, content); read it once, checkpointed, and take from it what is needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist(scanned(path, text or ""), schema=_ARROW)

    return files.filter(F.col("path").endswith(".java")).select("path", "content").mapInArrow(run, _ROW)


def code_chunks(rows: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of imports, methods, doc comments and class frames."""
    pieces = rows.filter("kind = 'piece'").withColumnRenamed("section", "__section").withColumnRenamed("file", "__file")
    parts = split_content(pieces.withColumnRenamed("prefix", "__head"), "text", size, overlap, F.coalesce("__head", F.lit("")), F.col("first"), F.col("last"))
    given = {c: F.col(c) for c in ("part", "total", "size", "overlap", "fromLine", "toLine", "content")}
    metadata = F.create_map(F.lit(SECTION_KEY), F.col("__section"))
    return parts.select(*chunk_columns(id=F.col("a"), parent=F.col("b"), mimeType=F.lit(MIME_TYPE), file=F.col("__file"), metadata=metadata, **given))


def symbols(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'name'").select(F.col("a").alias("name"), F.col("b").alias("fqn")).distinct()


def imports(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'import'").select("file", F.col("a").alias("import"), F.col("whole").alias("is_wildcard")).distinct()


def raw_edges(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(source, target) with the names of types resolved, by the symbols ``known`` if given, else by those of ``rows``."""
    from .graph import resolve_names

    edges = rows.filter("kind = 'edge'").select("file", F.col("a").alias("source"), F.col("b").alias("name"), F.col("section").alias("use"), F.col("prefix").alias("package"))
    named = edges.filter("use <> 'import'")
    found = resolve_names(named, imports(rows), symbols(rows) if known is None else known).select("file", "package", "name", "fqn")
    return edges.filter("use = 'import'").select("source", F.col("name").alias("target")).union(named.join(found, ["file", "package", "name"]).select("source", F.col("fqn").alias("target")))


def undocumented_methods(rows: DataFrame) -> DataFrame:
    """(id, class, signature, file, line) of methods at any depth without a doc comment."""
    return rows.filter("kind = 'undocumented'").select(F.col("a").alias("id"), F.col("b").alias("class"), F.col("text").alias("signature"), "file", F.col("first").alias("line"))


def errors(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'error'").select("file", F.col("a").alias("error"))


def documented(files: DataFrame, comments: DataFrame) -> DataFrame:
    """``files`` (path, content) with comments (file, line, comment) put before the lines of their methods; changed files only."""
    lines = files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("line", "text"))
    given = comments.select(F.col("file").alias("path"), "line", "comment").groupBy("path", "line").agg(F.min("comment").alias("comment"))
    changed = lines.join(given.select("path").distinct(), "path", "left_semi").join(given, ["path", "line"], "left")
    text = F.when(F.col("comment").isNotNull(), F.concat("comment", F.lit("\n"), "text")).otherwise(F.col("text"))
    grouped = changed.select("path", "line", text.alias("text")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))
    return grouped.select("path", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("content"))



