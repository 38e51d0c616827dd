"""The store of chunks under several writers, and the store of vectors against a scan."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.operators import retrieval, vector_search
from chunkloom.operators.store import ChunkStore

EMBED = retrieval.hashing_embedder(8)


def chunks(spark, numbers):
    return spark.createDataFrame([(f"id{n}", 0, f"text of {n}") for n in numbers], "id string, part int, content string")


def stored(store):
    return sorted(r["id"] for r in store.read().collect())


def test_only_cuts_that_may_hold_ids_are_read(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store", cuts=8)
    store.add(chunks(spark, range(400)), EMBED)
    store.add(chunks(spark, [1000, 1001]), EMBED)
    assert len(store.cuts_read) <= 1  # new ids: nothing is read but for a false positive
    store.add(chunks(spark, [7, 1000, 2000]), EMBED)
    assert 1 <= len(store.cuts_read) <= 4
    assert stored(store) == sorted(f"id{n}" for n in [*range(400), 1000, 1001, 2000])
    manifest = store.manifest()
    plan = store.find_by_id("id7")
    assert [r["content"] for r in plan.collect()] == ["text of 7"]
    assert "PartitionFilters: [isnotnull(__cut" in plan._jdf.queryExecution().toString() and manifest["version"] == 2 and len(manifest["folders"]) == 3
    assert all(store.known(chunks(spark, [n]).select("id"), manifest, manifest["folders"]).count() == 1 for n in (0, 399, 2000))


def test_filters_lose_nothing(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store", cuts=4)
    store.add(chunks(spark, range(2000)), EMBED)
    manifest = store.manifest()
    asked = chunks(spark, range(1500, 4000)).select("id")
    assert sorted(r["id"] for r in store.known(asked, manifest, manifest["folders"]).collect()) == sorted(f"id{n}" for n in range(1500, 2000))


def test_writers_that_race_add_each_id_once(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store", cuts=2)
    store.add(chunks(spark, [0]), EMBED)
    met = threading.Barrier(2)

    class Slow(ChunkStore):
        def _write(self, rows, cuts):
            folder = super()._write(rows, cuts)
            if not vars(self).setdefault("waited", False):
                self.waited = True
                met.wait(60)  # both have looked and written before either commits
            return folder

    failed = []

    def add(numbers):
        try:
            Slow(spark, store.path, cuts=2).add(chunks(spark, numbers), EMBED)
        except Exception as e:
            failed.append(e)

    writers = [threading.Thread(target=add, args=(range(a, a + 30),)) for a in (0, 15)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not failed
    assert stored(store) == sorted(f"id{n}" for n in range(45))
    assert store.manifest()["version"] == 2


def test_first_writers_that_race_with_other_cuts(spark, tmp_path, monkeypatch):
    one, two = (ChunkStore(spark, f"file://{tmp_path}/store", cuts=c) for c in (2, 3))
    real = two.manifest
    seen = iter([None])
    monkeypatch.setattr(two, "manifest", lambda: next(seen, False) or real())
    one.add(chunks(spark, range(10)), EMBED)
    two.manifest = iter_first_none(real)
    two.add(chunks(spark, range(5, 20)), EMBED)
    assert stored(one) == sorted(f"id{n}" for n in range(20)) and one.manifest()["cuts"] == 2


def iter_first_none(real):
    calls = []

    def manifest():
        calls.append(0)
        return None if len(calls) == 1 else real()

    return manifest


def test_reset_is_one_step_and_readers_keep_their_version(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store", cuts=2)
    assert store.read() is None and not store.exists()
    store.reset()
    assert not store.exists()
    store.add(chunks(spark, range(5)), EMBED)
    before = store.read()
    store.reset()
    assert store.exists() and store.read().count() == 0 and before.count() == 5
    store.add(chunks(spark, range(3)), EMBED)
    store.add(chunks(spark, range(4)), EMBED)
    assert store.compact() and len(store.manifest()["folders"]) == 1 and stored(store) == [f"id{n}" for n in range(4)]
    assert store._commit(store.manifest()) is False  # a version is written once
    store.add(chunks(spark, []), EMBED)
    store.add(spark.createDataFrame([(None, 0, "no id"), ("x", 0, None)], "id string, part int, content string"), EMBED)
    assert store.read().filter("id is null").count() == 1 and store.read().count() == 5


def reference(vectors, queries, k, least):
    out = []
    for q, v in queries:
        if v is None or not np.linalg.norm(v):
            continue
        found = []
        for key, w in vectors:
            if key is None or w is None or len(w) != len(v) or not all(x is not None and np.isfinite(x) for x in w) or not np.linalg.norm(w):
                continue
            w = np.float32(w).astype(float)
            score = (1 + np.sum(w * v) / (np.sqrt(np.sum(w * w)) * np.sqrt(np.sum(np.square(v))))) / 2
            if score >= least:
                found.append((-round(score, 9), key))
        out += [(q, key, n) for n, (_, key) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def family_vectors(n, families, seed):
    rng = np.random.default_rng(seed)
    heart = rng.normal(size=(families, 12))
    return [(f"v{i:04}", np.float32(heart[i % families] + 0.05 * rng.normal(size=12)).tolist()) for i in range(n)]


@pytest.mark.parametrize("least", [0.0, 0.8])
def test_vector_store_finds_what_a_scan_finds(spark, tmp_path, least):
    rows = family_vectors(900, 30, 1)
    rows += [("dup1", rows[0][1]), ("dup0", rows[0][1]), (None, rows[1][1]), ("null", None), ("zero", [0.0] * 12), ("short", [1.0]), ("nan", [float("nan")] * 12), ("hole", [None] * 12)]
    queries = [(i, [float(x) for x in rows[i * 7][1]]) for i in range(20)] + [(97, None), (98, [0.0] * 12), (99, [float(x) for x in range(12)])]
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    wanted = reference(rows, queries, 6, least)
    for k in (6,):
        scan = vector_search.nearest(vectors, asked, k, least)
        assert sorted((r["query_id"], r["id"], r["rank"]) for r in scan.collect()) == wanted
        store = vector_search.VectorStore(spark, f"file://{tmp_path}/v{least}", "id")
        store.create(vectors.filter("id is null or id < 'v0600'"), centres=30)
        store.add(vectors.filter("id >= 'v0600'"))
        assert sorted((r["query_id"], r["id"], r["rank"]) for r in store.search(asked, k, least).collect()) == wanted
        assert store.folders_read[0] <= 25
        one = store.search(asked.filter("query_id = 3"), k, least)
        assert one.count() == sum(w[0] == 3 for w in wanted) and sum(store.folders_read) < 6  # of some 30


def test_vector_store_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert vector_search.nearest(none, asked, 3, 0.0).collect() == []
    assert vector_search.nearest(none, asked.limit(0), 3, 0.0).collect() == []
    store = vector_search.VectorStore(spark, f"file://{tmp_path}/none")
    store.create(none)
    assert store.search(asked, 3, 0.0).collect() == []
    store.add(spark.createDataFrame([("a", [1.0])], "id string, embedding array<float>"))
    assert store.search(spark.createDataFrame([(1, [2.0])], "query_id long, embedding array<double>"), 3, 0.0).first()["id"] == "a"


def test_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 7)
    rows = family_vectors(100, 5, 2)
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>")
    asked = vectors.filter(F.col("id") < "v0030").select(F.col("id").alias("query_id"), "embedding")
    got = vector_search.nearest(vectors, asked, 1, 0.5)
    assert {(r["query_id"], r["id"]) for r in got.collect()} == {(f"v{i:04}", f"v{i:04}") for i in range(30)}


def test_many_queries_are_one_plan(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vector_search, "SLICE", 12 * 300, raising=False)
    monkeypatch.setattr(vector_search, "ASKED", 12 * 20, raising=False)
    rows = family_vectors(900, 30, 3)
    rows += [("dup1", rows[0][1]), ("dup0", rows[0][1]), (None, rows[1][1]), ("null", None), ("zero", [0.0] * 12), ("short", [1.0]), ("nan", [float("nan")] * 12), ("hole", [None] * 12)]
    queries = [(i, [float(x) for x in rows[i * 7][1]]) for i in range(90)] + [(97, None), (98, [0.0] * 12), (99, [float(x) for x in range(12)])]
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    found = vector_search.nearest(vectors, asked, 6, 0.8)
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in found.collect()) == reference(rows, queries, 6, 0.8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 1 and "Union" not in plan
    short = asked.unionByName(spark.createDataFrame([(100, [2.0])], asked.schema))
    assert [r["id"] for r in vector_search.nearest(vectors, short, 6, 0.8).filter("query_id = 100").collect()] == ["short"]
    assert vector_search.nearest(vectors.limit(0), asked, 6, 0.8).collect() == []
