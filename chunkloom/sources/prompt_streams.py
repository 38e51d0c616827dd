"""Data sources of Spark for prompts: lines that people append to files, and events of enriched prompts.

``spark.readStream.format("prompts").load(folder)`` and ``events.writeStream.format("prompt_events").start(folder)``, after
``register(spark)``. Both reach any store that pyarrow's file systems do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, SimpleDataSourceStreamReader, WriterCommitMessage

#: Bytes of prompts that one batch takes, about; a line is never cut.
MOST_BYTES = 1 << 20
# Fixed value: the line, in any case, that ends a session.
LAST_WORD = "exit"


def register(spark: SparkSession) -> None:
    for source in (Prompts, PromptEvents):
        spark.dataSource.register(source)


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri("file:///" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path)


class Prompts(DataSource):
    """Lines of the files of a folder (or of one file), in order of the files' names, up to a line ``exit``.

    A batch takes up to ``mostBytes`` bytes; its end, a file and a place in it, is what a restart goes on from. Files may grow: a line counts when its
    line break is there, unless ``whole`` is true or a later file has been begun. After ``exit`` nothing is read any more. Names that
    begin with a dot or an underscore are no prompts. New files need names after those that were read.
    """

    @classmethod
    def name(cls) -> str:
        return "prompts"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _BatchReader(self.options)

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        return PromptReader(self.options)


class _BatchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def read(self, partition) -> Iterator[tuple]:
        own = PromptReader(self.options | {"whole": "true"})
        at = own.initialOffset()
        while True:
            lines, end = own.read(at)
            yield from lines
            if end == at:
                return
            at = end


class PromptReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.most = int(options.get("mostBytes", MOST_BYTES))
        self.whole = str(options.get("whole", "false")).lower() == "true"

    def initialOffset(self) -> dict:
        return {"file": "", "place": 0, "ended": False}

    def _files(self, fs: pafs.FileSystem, top: str) -> list[str]:
        info = fs.get_file_info(top)
        if info.type == pafs.FileType.File:
            return [top]
        found = fs.get_file_info(pafs.FileSelector(top, allow_not_found=True))
        return sorted(f.path for f in found if f.is_file and f.base_name[:1] not in "._")

    def _lines(self, start: dict, end: dict | None) -> Iterator[tuple[str, dict]]:
        """Each line with the place after it."""
        if start["ended"]:
            return
        fs, top = _at(self.path)
        files = [f for f in self._files(fs, top) if f.rsplit("/", 1)[-1] >= start["file"]]
        for k, file in enumerate(files):
            name = file.rsplit("/", 1)[-1]
            place = start["place"] if name == start["file"] else 0
            if end is not None and name > end["file"]:
                return
            with fs.open_input_stream(file) as stream:
                stream.read(place) if place else None
                rest = b""
                while True:
                    block = stream.read(1 << 16)
                    rest += block
                    closed = not block and (self.whole or k + 1 < len(files))
                    *lines, rest = rest.split(b"\n") if not closed or not rest or rest.endswith(b"\n") else [rest + b"\n", b""]
                    for line in lines:
                        place += len(line) + (not line.endswith(b"\n"))
                        text = line.decode("utf-8", "replace").rstrip("\r\n")
                        last = text.strip().lower() == LAST_WORD
                        at = {"file": name, "place": place, "ended": last}
                        if end is not None and (name, place) > (end["file"], end["place"]):
                            return
                        yield text, at
                        if last:
                            return
                    if not block:
                        break

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        out, taken, end = [], 0, start
        for text, at in self._lines(start, None):
            end = at
            if at["ended"]:
                break
            out.append((text,))
            taken += len(text.encode()) + 1
            if taken >= self.most:
                break
        return iter(out), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for text, at in self._lines(start, end):
            if at["ended"]:
                return
            yield (text,)


@dataclass
class _Written(WriterCommitMessage):
    file: str
    rows: int


class PromptEvents(DataSource):
    """A sink that keeps each batch of a stream once: its tasks write parts, and one list for each batch number names those that count."""

    @classmethod
    def name(cls) -> str:
        return "prompt_events"

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return EventWriter(self.options["path"])


class EventWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, top = _at(self.path)
        fs.create_dir(f"{top}/parts", recursive=True)
        name, rows = f"{uuid.uuid4().hex}.jsonl", 0
        with fs.open_output_stream(f"{top}/parts/{name}") as out:
            for batch in iterator:
                rows += batch.num_rows
                out.write("".join(json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in batch.to_pylist()).encode())
        if not rows:
            fs.delete_file(f"{top}/parts/{name}")
        return _Written(name, rows)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        fs, top = _at(self.path)
        fs.create_dir(f"{top}/batches", recursive=True)
        target = f"{top}/batches/{batchId:012}.txt"
        if fs.get_file_info(target).type != pafs.FileType.NotFound:
            return self.abort(messages, batchId)  # a batch that runs again has been kept already
        part = f"{top}/batches/.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            out.write("".join(f"{m.file}\n" for m in messages if m is not None and m.rows).encode())
        fs.move(part, target)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        fs, top = _at(self.path)
        for m in messages:
            if m is not None and m.rows:
                fs.delete_file(f"{top}/parts/{m.file}")


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The events of all batches that were kept, and their ``batch``."""
    listed = spark.read.schema("value string").text(f"{path}/batches").select(F.regexp_extract(F.input_file_name(), r"(\d+)\.txt$", 1).cast("long").alias("batch"), F.col("value").alias("__part"))
    rows = spark.read.schema(schema).json(f"{path}/parts").withColumn("__part", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.join(listed, "__part").drop("__part")
