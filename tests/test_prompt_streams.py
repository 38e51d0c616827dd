"""Prompts as a data source, and events of prompts as a sink."""

import shutil

from pyspark.sql import functions as F

from chunkloom.sources import prompt_streams


def values(df):
    return [r["value"] for r in df.collect()]


def run(spark, folder, out, state, **options):
    lines = spark.readStream.format("prompts").options(**options).load(str(folder))
    lines.select("value", F.length("value").alias("chars")).writeStream.format("prompt_events").option("checkpointLocation", str(state)).trigger(availableNow=True).start(str(out)).awaitTermination()
    got = prompt_streams.read_events(spark, str(out), "value string, chars int")
    return sorted((r["value"], r["chars"]) for r in got.collect())


def test_lines_as_a_table(spark, tmp_path):
    prompt_streams.register(spark)
    (tmp_path / "a.txt").write_bytes("first\r\n\nzweite ü".encode())
    (tmp_path / "b.txt").write_text("third\n Exit \nnever\n")
    (tmp_path / "c.txt").write_text("never\n")
    (tmp_path / "_SUCCESS").write_text("no prompt\n")
    assert values(spark.read.format("prompts").load(str(tmp_path))) == ["first", "", "zweite ü", "third"]
    assert values(spark.read.format("prompts").load(f"file://{tmp_path}/c.txt")) == ["never"]
    assert values(spark.read.format("prompts").load(f"{tmp_path}/absent")) == []


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    prompt_streams.register(spark)
    folder, out, state = (tmp_path / n for n in ("in", "out", "state"))
    folder.mkdir()
    (folder / "a.txt").write_text("one\ntwo\nunfinish")
    assert run(spark, folder, out, state) == [("one", 3), ("two", 3)]
    with (folder / "a.txt").open("a") as f:
        f.write("ed\n")
    (folder / "b.txt").write_text("\n".join(f"more {k}" for k in range(500)) + "\nEXIT\nlost\n")
    wanted = sorted([("one", 3), ("two", 3), ("unfinished", 10), *((f"more {k}", len(f"more {k}")) for k in range(500))])
    for _ in range(20):  # a run ends with what was there at its first batch
        if (got := run(spark, folder, out, state, mostBytes="2000")) == wanted:
            break
    assert got == wanted and len(list((out / "batches").glob("*.txt"))) > 2
    (folder / "c.txt").write_text("after the end\n")
    assert run(spark, folder, out, state) == wanted


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    prompt_streams.register(spark)
    folder, out, state = (tmp_path / n for n in ("in", "out", "state"))
    folder.mkdir()
    (folder / "a.txt").write_text("one\ntwo\n")
    before = run(spark, folder, out, state)
    for name in (state / "commits").iterdir():  # as if the driver was lost between the sink's commit and the stream's own
        name.unlink()
    parts = len(list((out / "parts").iterdir()))
    assert run(spark, folder, out, state) == before == [("one", 3), ("two", 3)]
    assert len(list((out / "parts").iterdir())) == parts
    (folder / "b.txt").write_text("three\n")
    assert run(spark, folder, out, state) == [("one", 3), ("three", 5), ("two", 3)]
    shutil.rmtree(state)


def test_offsets():
    reader = prompt_streams.PromptReader({"path": "/nowhere/at/all"})
    assert list(reader.read(reader.initialOffset())[0]) == [] and reader.read({"file": "x", "place": 3, "ended": True})[1]["ended"]


def test_reading_again_gives_the_same_lines(tmp_path):
    (tmp_path / "a").write_text("1\n22\n333\n")
    (tmp_path / "b").write_text("4444\n55555")
    reader = prompt_streams.PromptReader({"path": str(tmp_path), "mostBytes": "4"})
    at, seen = reader.initialOffset(), []
    while True:
        lines, end = reader.read(at)
        lines = list(lines)
        assert list(reader.readBetweenOffsets(at, end)) == lines
        seen += lines
        if end == at:
            break
        at = end
    assert seen == [("1",), ("22",), ("333",), ("4444",)]
