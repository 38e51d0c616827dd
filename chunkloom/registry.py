"""Registries of vetoes, chunkers and steps that follow, and the run from a folder to chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import file_type
from .operators import graph, java
from .operators.numbering import checkpointed
from .operators.retrieval import Embedder
from .operators.store import ChunkStore
from .operators.vetoes import Veto, allowed, standard_vetoes
from .schema import CHUNK_COLUMNS
from .sources.files import contents, source_files
from .sources.snapshots import ADDED, CHANGED, FolderLog, REMOVED, changes

#: Entry points under which packages offer registries.
ENTRY_POINTS = "chunkloom.registries"
#: A chunker: (path, content) rows of its file types -> chunks.
Chunker = Callable[[DataFrame], DataFrame]


@dataclass
class Registry:
    """What a run uses; every chunker whose file type matches a file runs on it."""

    vetoes: list[Veto] = field(default_factory=list)
    chunkers: list[tuple[tuple[str, ...], Chunker]] = field(default_factory=list)
    post_steps: list[Callable[[], DataFrame]] = field(default_factory=list)
    before: list[Callable[[DataFrame], None]] = field(default_factory=list)
    scans: list[Callable[[DataFrame], None]] = field(default_factory=list)

    def veto(self, condition: Veto) -> Veto:
        self.vetoes.append(condition)
        return condition

    def chunker(self, *file_types: str):
        """Register a function, or a class whose instances are called, for file types by name."""

        def add(own):
            self.chunkers.append((file_types, own() if isinstance(own, type) else own))
            return own

        return add

    def post_step(self, step: Callable[[], DataFrame]):
        self.post_steps.append(step)
        return step

    def pre_step(self, step: Callable[[DataFrame], None]):
        self.before.append(step)
        return step

    def scan_step(self, step: Callable[[DataFrame], None]):
        self.scans.append(step)
        return step

    def merged(self, other: Registry) -> Registry:
        return Registry(self.vetoes + other.vetoes, self.chunkers + other.chunkers, self.post_steps + other.post_steps, self.before + other.before, self.scans + other.scans)


def discovered(group: str = ENTRY_POINTS) -> Registry:
    """All registries that installed packages offer: entry points of ``group``, each a registry or a function that gives one."""
    found = Registry()
    for point in sorted(metadata.entry_points(group=group), key=lambda p: p.name):
        own = point.load()
        found = found.merged(own if isinstance(own, Registry) else own())
    return found


def java_registry(prefix: str = "", size: int | None = None, overlap: int | None = None) -> Registry:
    """Code chunks, and after all files the dependency reports of classes under ``prefix``.

    Names are those of all Java files, also of vetoed ones, so that imports of these resolve.
    """
    own = Registry()
    seen: dict[str, DataFrame] = {}

    @own.scan_step
    def names(files: DataFrame) -> None:
        seen["names"] = checkpointed(java.symbols(java.scan(files)))

    @own.chunker("JAVA_CODE")
    def code(files: DataFrame) -> DataFrame:
        seen["rows"] = checkpointed(java.scan(files))
        return java.code_chunks(seen["rows"], size or java.SIZE, overlap or java.OVERLAP)

    @own.post_step
    def reports() -> DataFrame:
        edges = graph.dependency_edges(java.raw_edges(seen["rows"], seen.get("names")), prefix)
        return graph.dependency_chunks(edges, size or graph.REPORT_SIZE, overlap or graph.REPORT_OVERLAP)

    return own


def chunk_folder(spark: SparkSession, root: str, registry: Registry | None = None, white_list: str | None = None, standard: bool = True, done: DataFrame | None = None) -> DataFrame:
    """All chunks of the files below ``root``: scan, vetoes, chunkers, then the steps that need all files.

    Scan steps get all files below ``root``, vetoed or not, the steps before chunkers those that no veto keeps out.
    """
    registry = registry or java_registry()
    files = source_files(spark, root, [*standard_vetoes(white_list, enabled=standard), *registry.vetoes], done=done)
    if registry.scans:
        every = source_files(spark, root, [])
        for step in registry.scans:
            step(every)
    return chunk_files(files, registry)


def chunk_files(files: DataFrame, registry: Registry) -> DataFrame:
    """All chunks of ``files`` (path, length, content): chunkers by file type, then the steps that need all files."""
    for step in registry.before:
        step(files)
    out = [chunk(files.filter(file_type(files["path"]).isin(*types))).select(*CHUNK_COLUMNS) for types, chunk in registry.chunkers]
    out += [step().select(*CHUNK_COLUMNS) for step in registry.post_steps]
    return reduce(DataFrame.unionByName, out)


def update_store(spark: SparkSession, root: str, registry: Registry, log: FolderLog, store: ChunkStore, embedder: Embedder, white_list: str | None = None, standard: bool = True) -> DataFrame:
    """Bring ``store`` to the state of the files below ``root``; returns what has changed, as ``snapshots.changes`` does.

    Only new and changed files are read and cut; the chunks of changed files and of those that are gone leave the store first. Chunks are
    told by their ``file``, the path below ``root``. Steps over all files see those that changed. A run that fails is repeated by the next one.
    """
    found = changes(spark, root, log)
    new = found.filter(F.col("change").isin(ADDED, CHANGED)).select("path", "length")
    new = allowed(new, [*standard_vetoes(white_list, enabled=standard), *registry.vetoes])
    files = contents(new, root).select("path", "length", F.decode("content", "UTF-8").alias("content"))
    store.retract(found.filter(F.col("change").isin(CHANGED, REMOVED)).select(F.col("path").alias("file")))
    store.add(chunk_files(checkpointed(files), registry), embedder)
    log.write(found)
    return found
