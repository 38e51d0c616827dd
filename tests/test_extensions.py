"""Table functions, scanned packages and throttled calls."""

import sys
import time

import pytest

from chunkloom import registry, table_functions
from chunkloom.streaming import throttle


def test_table_function_gives_what_the_registry_gives(spark, tmp_path):
    for name, text in {"a.html": "one\ntwo", "b.xml": "three", "c.txt": "none", "d.html": "ü"}.items():
        (tmp_path / name).write_text(text)
    own = table_functions.FileChunkers()

    @own.add("HTML", "XML")
    def lines_of(path, content):
        for k, line in enumerate(content.split("\n")):
            yield {"id": f"{path}#{k}", "file": path, "part": k, "content": line, "metadata": {"kind": "line"}}

    own.add("HTML")(lambda path, content: [{"id": path}])
    own.register(spark, "chunk_for_test")
    wanted = registry.chunk_folder(spark, str(tmp_path), own.registry())
    from chunkloom.sources.files import source_files

    source_files(spark, str(tmp_path)).createOrReplaceTempView("files_for_test")
    got = spark.sql("SELECT * FROM chunk_for_test(TABLE(files_for_test))")
    key = lambda r: (r["id"], r["part"], r["content"] or "", r["size"], tuple(sorted(r["metadata"].items())))
    assert sorted(map(key, got.collect())) == sorted(map(key, wanted.collect())) and got.columns == wanted.columns
    assert got.count() == 4 + 2 and "Exchange hashpartitioning" not in spark.sql("SELECT * FROM chunk_for_test(TABLE(SELECT 'x.xml' AS path, 'y' AS content, 1 AS more))")._jdf.queryExecution().toString()
    with pytest.raises(Exception, match="content is needed"):
        spark.sql("SELECT * FROM chunk_for_test(TABLE(SELECT 'x.xml' AS path))").collect()


def test_packages_are_scanned(tmp_path, monkeypatch):
    (tmp_path / "own_pack/deep").mkdir(parents=True)
    head = "from chunkloom.registry import Registry\nfrom chunkloom.table_functions import FileChunkers\n"
    (tmp_path / "own_pack/__init__.py").write_text(head + "a = Registry()\nb = a\na.veto(lambda p, n: p.contains('x'))\n")
    (tmp_path / "own_pack/deep/__init__.py").write_text("")
    (tmp_path / "own_pack/deep/more.py").write_text(head + "from own_pack import a\nc = FileChunkers()\nc.add('HTML')(lambda p, t: [])\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    found = table_functions.scanned("own_pack")
    assert len(found.vetoes) == 1 and [t for t, _ in found.chunkers] == [("HTML",)]
    for name in [n for n in sys.modules if n.startswith("own_pack")]:
        del sys.modules[name]


class Cell:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Cells(list):
    def get(self):
        return iter(list(self))

    def appendList(self, rows):
        self.extend(rows)

    def put(self, rows):
        self[:] = rows


class Clock:
    """Stands for a state store's handle and its timers."""

    def __init__(self):
        self.now, self.timers, self.cells = 1000, [], {}

    def getListState(self, name, schema):
        return self.cells.setdefault(name, Cells())

    def getValueState(self, name, schema):
        return self.cells.setdefault(name, Cell())

    def registerTimer(self, at):
        self.timers.append(at)

    def listTimers(self):
        return iter(self.timers)

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_calls_are_apart_by_a_fake_clock():
    import pandas as pd

    clock, calls = Clock(), []
    own = throttle.Throttle(lambda p: p.upper(), 5.0)
    own.init(clock)

    def step(frames=None):
        out = own.handleInputRows(("m",), iter(frames), clock) if frames is not None else own.handleExpiredTimer(("m",), clock, None)
        calls.extend((r.called_ms, r.prompt, r.answer) for f in out for r in f.itertuples())

    step([pd.DataFrame({"prompt": ["a", "b"]}), pd.DataFrame({"prompt": ["c"]})])
    clock.now = 3000
    step([pd.DataFrame({"prompt": ["d"]})])
    own = throttle.Throttle(lambda p: p.upper(), 5.0)  # after a restart
    own.init(clock)
    while clock.timers:
        clock.now = max(clock.now, min(clock.timers)) + 7
        clock.timers.remove(min(clock.timers))
        step()
    clock.now += 100
    step([pd.DataFrame({"prompt": ["e"]})])
    assert [c[1:] for c in calls] == [(x, x.upper()) for x in "abcd"]
    assert all(b[0] - a[0] >= 5000 for a, b in zip(calls, calls[1:], strict=False))
    clock.now = min(clock.timers)
    clock.timers.clear()
    step()
    assert calls[-1][1] == "e" and not clock.timers


def test_calls_of_a_stream_are_apart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("m", "p1"), ("m", "p2"), ("n", "q1"), ("m", "p3"), ("m", None)], "model string, prompt string").coalesce(1).write.mode("overwrite").json(str(tmp_path / "in"))
    lines = spark.readStream.schema("model string, prompt string").json(str(tmp_path / "in"))
    out = throttle.throttled(lines, lambda p: p + "!", wait=1.0)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    ended = time.time() + 120
    rows = []
    while len(rows) < 4 and time.time() < ended and query.isActive:
        time.sleep(2)
        if (tmp_path / "out/_spark_metadata").exists():
            rows = spark.read.schema(throttle.ANSWERS).parquet(str(tmp_path / "out")).collect()
    query.stop()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted((r["model"], r["prompt"], r["answer"]) for r in rows) == [("m", "p1", "p1!"), ("m", "p2", "p2!"), ("m", "p3", "p3!"), ("n", "q1", "q1!")]
    times = sorted(r["called_ms"] for r in rows if r["model"] == "m")
    assert all(b - a >= 1000 for a, b in zip(times, times[1:], strict=False))
