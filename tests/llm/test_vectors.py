import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.llm import ann, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, score double, pivot int, id long"
ODD = [(901, None, 1), (902, [0.0] * 8, 1), (903, [float("nan")] + [1.0] * 7, 1), (904, [None] + [1.0] * 7, 1), (905, [float("inf")] * 8, 1), (906, [1.0, 2.0], 1), (907, [1.0] + [0.0] * 7, None), (None, [1.0] + [0.0] * 7, 1)]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, c, 0.5, 1, 2) for a, b, c in rows], SCHEMA)


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    for k in range(0, n - 4, 10):
        x[k + 1 : k + 4] = x[k] + rng.normal(size=(3, 8)) * 0.05
    return x.astype(np.float32)


@pytest.fixture(scope="module")
def vectors(spark):
    x = clustered(800, 1)
    x[700:720] = x[5]
    x[720] = 2 * x[5]
    return x, frame(spark, [(k, v.tolist(), k // 10 % 3) for k, v in enumerate(x)] + ODD)


def test_search_recall_and_ties(spark, vectors):
    x, df = vectors
    got = collections.defaultdict(list)
    for r in ann.search(df, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    y = np.vstack([x, [1.0] + [0.0] * 7]).astype(np.float64)
    ids = np.append(np.arange(800), 907)
    hits = 0
    for q in range(0, 800, 20):
        s = (y * y[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((ids, -s))[:20]
        assert len(got[q]) == 20 and [v for v, _ in sorted(got[q], key=lambda g: (-g[1], g[0]))] == [v for v, _ in got[q]]
        assert all(abs(score - s[list(ids).index(v)]) < 1e-12 for v, score in got[q])
        hits += len({v for v, _ in got[q]} & set(ids[want].tolist()))
    assert hits / (40 * 20) > 0.95
    assert not {q for q in got if q >= 800} and set(got) == set(range(0, 800, 20))
    for own in got.values():
        scores = [score for _, score in own]
        assert scores == sorted(scores, reverse=True)


def test_search_by_blocks_and_chunks_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTORS", 300)
    monkeypatch.setattr(ann, "QUERIES", 64)
    rng = np.random.default_rng(7)
    x = np.vstack([clustered(2500, 7), rng.normal(size=(500, 8)).astype(np.float32) * 3])
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)] + [(40, x[40].tolist(), 1), (41, x[7].tolist(), 2)]
    got = collections.defaultdict(list)
    for r in ann.search(frame(spark, rows), F.col("vec_id") % 20 == 0, 20, sample=500, rerank=2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ids, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    assert set(got) == set(range(0, 3000, 20))
    for q, own in got.items():
        s = np.cumsum(y * x[q].astype(np.float64), axis=1)[:, -1]
        s[ids == q] = -np.inf
        assert own == [(int(ids[k]), float(s[k])) for k in np.lexsort((ids, -s))[:20]]


def test_search_of_few_and_none(spark):
    few = frame(spark, [(0, [1.0, 0.0], 1), (20, [0.5, 0.5], 1), (3, [0.5, 0.5], 1)])
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(few, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 20), (20, 1, 0), (20, 2, 3)]
    assert ann.search(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(frame(spark, ODD[:2]), F.col("vec_id") % 20 == 0).count() == 0


def test_parallel_error_weighs_more():
    x = clustered(600, 2).astype(float)
    plain, own = ann.Quantiser(8, parallel=1.0).fit(x), ann.Quantiser(8, parallel=6.0).fit(x)

    def parallel(q):
        codes = q.assign(x)
        near = np.stack([q.centres[m][codes[:, m]] for m in range(q.parts)], axis=1).reshape(len(x), -1)[:, :8]
        return (((x - near) * x).sum(axis=1) ** 2 / (x * x).sum(axis=1)).mean()

    assert parallel(own) < parallel(plain)


def reference(rows, cosine):
    good = [(i, np.array(v, np.float64), lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    root = {i: i for i, _, _ in good}
    links = collections.Counter()

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, (i, v, lab) in enumerate(good):
        for j, w, other in good[k + 1 :]:
            if lab == other and (v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum())) >= cosine:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in root}


@pytest.mark.parametrize("tile", [1024, 16])
def test_near_duplicates(spark, vectors, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    x, df = vectors
    rows = [(k, v.tolist(), k // 10 % 3) for k, v in enumerate(x)] + ODD
    want = reference(rows, 0.98)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == 808
    total = sum(n for n, _ in want.values())
    assert all(got[i]["n_links"] <= want[i][0] for i in want)
    assert sum(got[i]["n_links"] for i in want) / total > 0.95
    assert sum(got[i]["component_id"] == want[i][1] for i in want) / len(want) > 0.98
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, _, _ in ODD if i is not None and i != 904)
    assert got[None]["component_id"] is None


def with_family(n, seed, dimension=64, cosine=0.985):
    """Spread vectors, every third of one dense family."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dimension))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0] * cosine**0.5 + x[::3] * (1 - cosine) ** 0.5
    return x.astype(np.float32)


@pytest.mark.parametrize(("prefix", "fewest", "few"), [(1, 16, 0.0), (3, 64, 1.0), (16, 16, 0.05)])
def test_no_link_is_lost_at_any_prefix(spark, monkeypatch, prefix, fewest, few):
    for name, value in (("PREFIX", prefix), ("FEWEST_PIVOTS", fewest), ("FEW", few), ("TILE", 128)):
        monkeypatch.setattr(embedding_dedup, name, value)
    x = np.vstack([clustered(1500, 8), with_family(600, 9, 8, 0.982)])
    rows = [(k, v.tolist(), k % 2) for k, v in enumerate(x)]
    want = reference(rows, 0.98)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == want and sum(n for n, _ in want.values()) > 10_000


@pytest.mark.parametrize("cosine", [0.981, 0.985])
def test_near_duplicates_of_a_large_family(spark, cosine):
    x = with_family(6000, 5, cosine=cosine)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(frame(spark, [(k, v.tolist(), 1) for k, v in enumerate(x)])).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    linked = u @ u.T >= 0.98
    np.fill_diagonal(linked, False)
    assert linked.sum() > 1_000_000
    assert [got[k]["n_links"] for k in range(len(x))] == linked.sum(axis=1).tolist()
    assert {got[k]["component_id"] for k in range(0, len(x), 3) if linked[k].any()} == {0}


@pytest.mark.parametrize("cosine", [0.95, 0.985])
def test_search_in_a_large_family(spark, cosine):
    x = with_family(6000, 6, cosine=cosine)
    df = frame(spark, [(k, v.tolist(), 1) for k, v in enumerate(x)])
    got = collections.defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 100 == 0, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    y = x.astype(np.float64)
    for q in range(0, 6000, 100):
        s = (y * y[q]).sum(axis=1)
        s[q] = -np.inf
        assert got[q] == np.lexsort((np.arange(6000), -s))[:20].tolist()


def test_near_duplicates_of_nothing(spark):
    assert embedding_dedup.near_duplicates(frame(spark, ODD).limit(0)).count() == 0
    assert {r["n_links"] for r in embedding_dedup.near_duplicates(frame(spark, ODD[:3])).collect()} == {0}
