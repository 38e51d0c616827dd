"""Chunkers of single files as a table function of SQL, and registries found in packages."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .registry import Registry
from .schema import CHUNK_COLUMNS, CHUNK_SCHEMA, FILE_TYPES

#: A chunker of one file: (path, content) -> chunks, each a dict of some of a chunk's attributes.
FileChunker = Callable[[str, str], Iterable[dict]]
_NUMBERS = {"part": 0, "total": 1, "size": 0, "overlap": 0}


def _row(chunk: dict) -> dict:
    """All attributes of a chunk: numbers that are missing are 0, one part in all, size the content's length."""
    content = chunk.get("content") or ""
    return {c: None for c in CHUNK_COLUMNS} | _NUMBERS | {"size": len(content), "metadata": {}} | chunk


def as_chunker(chunk: FileChunker):
    """The chunker of tables of files that applies ``chunk`` to each file."""
    schema = to_arrow_schema(CHUNK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(batch.column(k) for k in (0, 1)), strict=True):  # a file's chunks at a time
                rows = [_row(c) for c in chunk(path.as_py(), content.as_py() or "")]
                yield pa.RecordBatch.from_pylist(rows, schema)

    def chunker(files: DataFrame) -> DataFrame:
        return files.select("path", "content").mapInArrow(run, CHUNK_SCHEMA)

    return chunker


class FileChunkers:
    """Chunkers of single files by type: add them to a registry, or call them from SQL."""

    def __init__(self):
        self.known: list[tuple[tuple[str, ...], FileChunker]] = []

    def add(self, *file_types: str):
        def own(chunk: FileChunker) -> FileChunker:
            self.known.append((file_types, chunk))
            return chunk

        return own

    def registry(self) -> Registry:
        out = Registry()
        for types, chunk in self.known:
            out.chunker(*types)(as_chunker(chunk))
        return out

    def register(self, spark: SparkSession, name: str = "chunk") -> None:
        """Make ``SELECT * FROM chunk(TABLE(files))`` give the chunks of a table with path and content; more columns are let be.

        Every chunker that matches a file's type runs on it. Files are taken where they lie, without a shuffle; ``PARTITION BY`` may deal them anew.
        """
        known = list(self.known)

        class Chunk:
            @staticmethod
            def analyze(files: AnalyzeArgument) -> AnalyzeResult:
                missing = {"path", "content"} - set(files.dataType.fieldNames() if files.isTable else ())
                if missing:
                    raise ValueError(f"a table with {' and '.join(sorted(missing))} is needed")
                return AnalyzeResult(CHUNK_SCHEMA)

            def eval(self, files):
                kind = next((n for n, suffix in FILE_TYPES if files["path"].endswith(suffix)), "UNKNOWN")
                for types, chunk in known:
                    if kind in types:
                        for own in chunk(files["path"], files["content"] or ""):
                            row = _row(own)
                            yield tuple(row[c] for c in CHUNK_COLUMNS)

        spark.udtf.register(name, udtf(Chunk))


def scanned(package: str) -> Registry:
    """All registries and sets of file chunkers that stand in the modules of ``package``, and of packages below it, each once."""
    top = importlib.import_module(package)
    names = [package, *(m.name for m in pkgutil.walk_packages(getattr(top, "__path__", []), f"{package}."))]
    found, seen = Registry(), set()
    for name in sorted(names):
        for _, own in sorted(vars(importlib.import_module(name)).items()):
            if isinstance(own, Registry | FileChunkers) and id(own) not in seen:
                seen.add(id(own))
                found = found.merged(own.registry() if isinstance(own, FileChunkers) else own)
    return found
