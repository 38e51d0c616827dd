"""A store of embedded chunks: folders of Parquet files, named by numbered manifests, cut by a hash of the id.

A manifest is written whole and under its number or not at all, so readers see the store as one version of it, writers at the same time
take turns by trying the next number, and a reset is one more version. Each folder has a Bloom filter for each of its cuts: what is
new is found out by the filters and the ids of those cuts only that may hold one of a batch's.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import has_text
from . import retrieval
from .numbering import checkpointed

#: Cuts of a new store, bits of a filter for each row of its cut, and bits set for an id.
CUTS, BITS_EACH, PROBES = 16, 10, 6
#: Tries to write a manifest before giving up.
TRIES = 100


class ChunkStore:
    """Chunks with their embeddings below ``path``; any number of readers and writers may use it at once.

    ``cuts`` counts when the store is new. Folders that no manifest names, of writers that failed or from before a reset, are left where they are.
    """

    def __init__(self, spark: SparkSession, path: str, cuts: int = CUTS):
        self.spark, self.path, self.cuts = spark, path.rstrip("/"), cuts
        #: (folder, cut) whose ids were read by the last look for known ids.
        self.cuts_read: list[tuple[str, int]] = []

    # Manifests

    def _hadoop(self, path: str):
        own = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return own.getFileSystem(self.spark._jsc.hadoopConfiguration()), own

    def manifest(self) -> dict | None:
        """The latest one: version, cuts, schema and folders."""
        fs, log = self._hadoop(f"{self.path}/log")
        if not fs.exists(log):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(log)]
        versions = sorted(n for n in names if re.fullmatch(r"\d{12}\.json", n))
        return json.loads(self.spark.read.text(f"{self.path}/log/{versions[-1]}", wholetext=True).first()[0]) if versions else None

    def _commit(self, manifest: dict) -> bool:
        """Write ``manifest`` under its version; false if there is one already."""
        fs, target = self._hadoop(f"{self.path}/log/{manifest['version']:012}.json")
        part = self._hadoop(f"{self.path}/log/.{uuid.uuid4().hex}")[1]
        out = fs.create(part, True)
        out.write(json.dumps(manifest).encode())
        out.close()
        try:
            if fs.getUri().getScheme() != "file":
                return not fs.exists(target) and fs.rename(part, target)  # fails where the target exists
            files = self.spark._jvm.java.nio.file.Files  # a local rename would replace the target
            files.createLink(*(self.spark._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (target, part)))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(part, False)

    def exists(self) -> bool:
        return self.manifest() is not None

    # Reading

    def read(self) -> DataFrame | None:
        """All rows of the latest version; None where nothing was ever written."""
        return self._rows(self.manifest())

    def _rows(self, manifest: dict | None) -> DataFrame | None:
        rows = self._with_cuts(manifest)
        return None if rows is None else rows.drop("__cut")

    def _with_cuts(self, manifest: dict | None, keep_folder: bool = False) -> DataFrame | None:
        if manifest is None:
            return None
        schema = T.StructType.fromJson(manifest["schema"])
        if not manifest["folders"]:
            return self.spark.createDataFrame([], schema).withColumn("__cut", F.lit(None).cast("int"))
        whole = T.StructType([*schema.fields, T.StructField("__folder", T.StringType()), T.StructField("__cut", T.IntegerType())])
        rows = self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/__folder={f}" for f in manifest["folders"]))
        return rows if keep_folder else rows.drop("__folder")

    def find_by_id(self, chunk_id: str) -> DataFrame:
        """The chunk's parts, read from its own cut."""
        manifest = self.manifest()
        rows = self._with_cuts(manifest).filter(F.col("__cut") == F.pmod(F.xxhash64(F.lit(chunk_id)), F.lit(manifest["cuts"])))
        return retrieval.find_by_id(rows.drop("__cut"), chunk_id)

    def find_by_metadata(self, wanted: dict[str, str]) -> DataFrame:
        return retrieval.find_by_metadata(self.read(), wanted)

    def find_relevant(self, question: str, embedder: retrieval.Embedder, k: int, min_score: float) -> DataFrame:
        rows = self.read()
        if not question.strip():
            return rows.withColumn("score", F.lit(0.0)).limit(0)
        return retrieval.similar(rows, embedder([question])[0], k, min_score)

    # Writing

    def add(self, chunks: DataFrame, embedder: retrieval.Embedder, batch: int = retrieval.BATCH) -> None:
        """Embed and append the chunks with text whose id is not stored; rows that failed are left for the next time.

        If another writer was first, what it has added is taken out of the own rows before the next try.
        """
        base = self.manifest()
        rows = chunks.filter(has_text(F.col("content")))
        if base is not None and base["folders"]:
            rows = checkpointed(rows)
            rows = rows.join(self.known(rows.select("id"), base, base["folders"]), "id", "left_anti").select(*chunks.columns)
        rows = retrieval.embedded(rows, embedder, batch).filter("embedding is not null").drop("embed_error")
        schema, cuts = rows.schema, base["cuts"] if base else self.cuts
        folder = self._write(rows, cuts)
        for _ in range(TRIES):
            if base is not None and folder is None:
                return
            if self._commit({"version": base["version"] + 1 if base else 0, "cuts": cuts, "schema": json.loads(schema.json()), "folders": [*(base["folders"] if base else []), *([folder] if folder else [])]}):
                return
            latest = self.manifest()
            added = [f for f in latest["folders"] if base is None or f not in base["folders"]]
            base = latest
            if folder is None:
                continue
            own = self.spark.read.schema(schema).parquet(f"{self.path}/data/__folder={folder}")
            again = checkpointed(self.known(own.select("id"), base, added)) if added and base["cuts"] == cuts else None
            if base["cuts"] != cuts:
                cuts = base["cuts"]
                again = checkpointed(own.select("id").join(self._rows({**base, "folders": added}).select("id"), "id", "left_semi").distinct())
                folder = self._write(own.join(again, "id", "left_anti").select(*schema.names), cuts)
            elif again is not None and not again.isEmpty():
                folder = self._write(own.join(again, "id", "left_anti").select(*schema.names), cuts)
        raise RuntimeError(f"no manifest could be written in {TRIES} tries")

    def reset(self) -> None:
        """Make the store empty, in one step."""
        for _ in range(TRIES):
            base = self.manifest()
            if base is None or self._commit({**base, "version": base["version"] + 1, "folders": []}):
                return
        raise RuntimeError(f"no manifest could be written in {TRIES} tries")

    def retract(self, files: DataFrame) -> None:
        """Take out the chunks whose ``file`` is among ``files`` (file); only folders that hold some are written anew."""
        files = checkpointed(files.select("file").filter("file is not null").distinct())
        for _ in range(TRIES):
            base = self.manifest()
            rows = self._with_cuts(base, keep_folder=True) if base and base["folders"] else None
            hit = [] if rows is None else sorted(r[0] for r in rows.select("file", "__folder").join(files, "file", "left_semi").select("__folder").distinct().collect())
            if not hit:
                return
            rest = self._rows({**base, "folders": hit}).join(files, "file", "left_anti").select(*T.StructType.fromJson(base["schema"]).names)
            folder = self._write(rest, base["cuts"])
            kept = [f for f in base["folders"] if f not in hit]
            if self._commit({**base, "version": base["version"] + 1, "folders": [*kept, *([folder] if folder else [])]}):
                return
        raise RuntimeError(f"no manifest could be written in {TRIES} tries")

    def compact(self) -> bool:
        """Bring all rows into one folder; false, and nothing changed, if another writer came in between."""
        base = self.manifest()
        if base is None or len(base["folders"]) < 2:
            return True
        folder = self._write(self._rows(base), base["cuts"])
        return self._commit({**base, "version": base["version"] + 1, "folders": [folder]})

    def _write(self, rows: DataFrame, cuts: int) -> str | None:
        """Write ``rows`` and their filters as a new folder; None if there are no rows."""
        folder = uuid.uuid4().hex
        cut = F.pmod(F.xxhash64("id"), F.lit(cuts)).cast("int")
        # a cut is dealt to several tasks by its parts, so that many parts of one id are not one task
        rows.withColumn("__cut", cut).repartition(F.col("__cut"), F.pmod(F.xxhash64("id", "part"), F.lit(4))).write.partitionBy("__cut").parquet(f"{self.path}/data/__folder={folder}")
        written = self.spark.read.schema("id string, __cut int").parquet(f"{self.path}/data/__folder={folder}")
        sizes = {r["__cut"]: r["n"] for r in written.groupBy("__cut").agg(F.count("*").alias("n")).collect()}
        if not sizes:
            return None
        bits = {c: 1 << max(10, (BITS_EACH * n - 1).bit_length()) for c, n in sizes.items()}

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, None
            for batch in batches:
                cut, hashes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                for c in np.unique(cut).tolist():
                    if c != at:
                        if at is not None:
                            yield _filter(at, held)
                        at, held = c, np.zeros(bits[c], bool)
                    held[_probes(hashes[cut == c], bits[c])] = True
            if at is not None:
                yield _filter(at, held)

        ids = written.select("__cut", F.xxhash64("id").alias("h")).distinct().repartition("__cut").sortWithinPartitions("__cut")
        ids.mapInArrow(fill, "cut int, bits binary").write.parquet(f"{self.path}/filters/{folder}")
        return folder

    def known(self, ids: DataFrame, manifest: dict, folders: list[str]) -> DataFrame:
        """(id): those of ``ids`` that the folders hold; of the stored ids only those in cuts are read that a filter does not rule out.

        Filters come before ids in the order of a partition, so a task holds the filters of one cut and sees the ids one batch at a time.
        """
        ids = ids.filter("id is not null").distinct().withColumn("cut", F.pmod(F.xxhash64("id"), F.lit(manifest["cuts"])).cast("int"))
        stored = [self.spark.read.schema("cut int, bits binary").parquet(f"{self.path}/filters/{f}").withColumn("folder", F.lit(f)) for f in folders]
        filters = stored[0]
        for more in stored[1:]:
            filters = filters.unionByName(more)
        both = filters.select("cut", F.lit(0).alias("kind"), "folder", "bits", F.lit(None).cast("string").alias("id"), F.lit(0).cast("long").alias("h"))
        both = both.unionByName(ids.select("cut", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("folder"), F.lit(None).cast("binary").alias("bits"), "id", F.xxhash64("id").alias("h")))

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, []
            for batch in batches:
                cut, kind = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                hashes = batch.column(5).to_numpy(zero_copy_only=False)
                for c in np.unique(cut).tolist():
                    if c != at:
                        at, held = c, []
                    for row in np.flatnonzero((cut == c) & (kind == 0)).tolist():
                        held.append((batch.column(2)[row].as_py(), np.unpackbits(np.frombuffer(batch.column(3)[row].as_py(), np.uint8)).view(bool)))
                    own = np.flatnonzero((cut == c) & (kind == 1))
                    for folder, bits in held:
                        may = own[bits[_probes(hashes[own], len(bits))].all(axis=0)]
                        if len(may):
                            yield pa.RecordBatch.from_arrays([batch.column(4).take(pa.array(may)), pa.array([folder] * len(may), pa.string()), pa.array([c] * len(may), pa.int32())], ["id", "folder", "cut"])

        may = both.repartition("cut").sortWithinPartitions("cut", "kind").mapInArrow(test, "id string, folder string, cut int")
        may = checkpointed(may)
        self.cuts_read = sorted((r["folder"], r["cut"]) for r in may.select("folder", "cut").distinct().collect())
        if not self.cuts_read:
            return may.select("id")
        there = self.spark.read.schema("id string").parquet(*(f"{self.path}/data/__folder={f}/__cut={c}" for f, c in self.cuts_read))
        return there.select("id").join(may.select("id").distinct(), "id", "left_semi").distinct()


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash in a filter of ``bits``, a power of two; one row for each probe."""
    h = hashes.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    h = h ^ (h >> np.uint64(29))  # ids of a cut agree in the hash's remainder
    return np.stack([(h + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)]).astype(np.int64)


def _filter(cut: int, held: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([cut], pa.int32()), pa.array([np.packbits(held).tobytes()], pa.binary())], ["cut", "bits"])
