"""Many questions at once, deep chains and budgets over all partitions."""

import random
from unittest import mock

import pytest
from pyspark.sql import functions as F

from chunkloom.operators import forest, numbering, prompt, retrieval
from chunkloom.operators.chunk_maps import chunk_columns
from chunkloom.streaming import streams


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    n = 10_000
    chunks = spark.range(n + 1).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") < n, F.concat(F.lit("n"), (F.col("id") + 1).cast("string"))).alias("parent"), F.lit("method").alias("section"))
    rounds = []
    real = forest.checkpointed
    monkeypatch.setattr(forest, "checkpointed", lambda df: rounds.append(df) or real(df))
    closure = forest.ancestor_closure(spark.createDataFrame([("n0",), (f"n{n - 2}",)], "id string"), chunks)
    got = closure.groupBy("hit_id").agg(F.count("*").alias("n"), F.max("depth").alias("deep"), F.countDistinct("depth").alias("depths"), F.max_by("node_id", "depth").alias("root"), F.sum(F.col("parent_id").isNull().cast("int")).alias("ends"))
    assert {tuple(r) for r in got.collect()} == {("n0", n + 1, n, n + 1, f"n{n}", 1), (f"n{n - 2}", 3, 2, 3, f"n{n}", 1)}
    assert sum("depth" in df.columns and "parent_id" not in df.columns for df in rounds) <= 17


def test_long_cycles_end(spark):
    ring = [(f"r{k}", f"r{(k + 1) % 9}", "method") for k in range(9)] + [(f"t{k}", f"t{k + 1}" if k < 6 else "r4", "method") for k in range(7)] + [("self", "self", "imports"), ("none", "", "imports"), ("a", "b", "x"), ("b", "a", "x")]
    chunks = spark.createDataFrame(ring, "id string, parent string, section string")
    above = {i: p for i, p, _ in ring}
    wanted = set()
    for hit in ("r0", "t0", "t6", "self", "none", "a"):
        node, seen = hit, []
        while node in above and node not in seen:
            seen.append(node)
            node = above[node]
        wanted |= {(hit, x, d) for d, x in enumerate(seen)}
    hits = spark.createDataFrame([("r0",), ("t0",), ("t6",), ("self",), ("none",), ("a",), ("absent",)], "id string")
    closure = forest.ancestor_closure(hits, chunks)
    assert {(r["hit_id"], r["node_id"], r["depth"]) for r in closure.collect()} == wanted


@pytest.mark.parametrize("most", [0, 3, 250, 10**6])
def test_amounts_are_summed_over_partitions(spark, most):
    rows = [(k * 37 % 101, k % 3 if k % 10 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "o int, a int").repartition(6)
    got = [(r["o"], r["a"]) for r in numbering.until(df.withColumn("x", F.lit(1)), F.col("a"), most, "o", F.col("a").asc_nulls_first()).collect()]
    wanted, total = [], 0
    for o, a in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        if total > most:
            break
        wanted.append((o, a))
        total += a or 0
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_equal_rows_spread(spark):
    df = spark.range(0, 4000, numPartitions=4).select(F.lit(None).cast("int").alias("k"))
    assert numbering._ordered(df, "k").groupBy("__partition").count().agg(F.max("count")).first()[0] < 2500
    assert numbering.row_numbers(df, "k").agg(F.countDistinct("row"), F.max("row")).first()[:] == (4000, 3999)


def code_store(spark):
    rows = [("K", None, "classFrame", "\nclass K m()", [1.0, 0.0]), ("K.m()", "K", "method", "\nm() { body }", [0.9, 0.1]), ("K.dependencies", "K", "dependenciesInfo", "\nreport", [-1.0, 0.0]), ("L", None, "classFrame", "\nclass L", [0.0, 1.0]), ("U", None, "other", "\nnothing", [-1.0, 0.02])]
    df = spark.createDataFrame(rows, "i string, p string, s string, c string, embedding array<float>")
    return df.select(*chunk_columns(id=F.col("i"), parent=F.col("p"), part=F.lit(0), total=F.lit(1), size=F.length("c"), overlap=F.lit(0), content=F.col("c"), metadata=F.create_map(F.lit("java_code_section"), F.col("s"))), "embedding")


def test_many_questions_are_as_each_alone(spark):
    store = code_store(spark)
    vectors = {"one": [1.0, 0.0], "two": [0.0, 2.0], "diagonal": [0.6, 0.7], "behind": [-1.0, 0.1], "far": [-0.3, -1.0]}
    asked = [(q, f"what is {q}?", v) for q, v in vectors.items()] + [("blank", " \t", [1.0, 0.0]), ("no vector", "text", None), ("null", None, [1.0, 0.0])]
    questions = spark.createDataFrame(asked, "question_id string, question string, embedding array<double>")
    got = {r["question_id"]: (r["prompt"], r["level"], r["trees"]) for r in prompt.enrich_many(questions, store, template="{}|{}").collect()}
    assert set(got) == {q for q, _, _ in asked}
    for q, v in [(q, vectors[q]) for q in ("diagonal", "behind")]:
        assert got[q][0] == prompt.enrich(spark, store, f"what is {q}?", lambda texts, v=v: [v], template="{}|{}")
    assert got["one"][1:] == (0, 1) and "m() { body }" in got["one"][0] and "report" in got["one"][0]
    assert got["two"][1:] == (0, 1) and got["diagonal"][2] == 2
    assert got["behind"][0] == prompt.NO_CONTEXT  # what is near has rank 0
    assert all(got[q] == (prompt.NO_CONTEXT, None, None) for q in ("blank", "no vector", "null", "far"))
    more = spark.createDataFrame([("far", "L"), ("blank", "L")], "question_id string, id string")
    with_more = {r["question_id"]: r["prompt"] for r in prompt.enrich_many(questions, store, template="{}|{}", prefetched=more).collect()}
    assert "class L" in with_more["far"] and with_more["blank"] == prompt.NO_CONTEXT and with_more["one"] == got["one"][0]
    short = {r["question_id"]: r["trees"] for r in prompt.enrich_many(questions, store, budget=0).collect()}
    assert short["diagonal"] == 1


def test_levels_with_the_same_hits_are_tried_once(spark, monkeypatch):
    seen = []
    real = prompt.context_of
    monkeypatch.setattr(prompt, "context_of", lambda hits, *rest, **how: seen.append(hits.select("question_id", "level").distinct().count()) or real(hits, *rest, **how))
    questions = spark.createDataFrame([(1, "q", [1.0, 0.0]), (2, "q", [0.0, 1.0])], "question_id long, question string, embedding array<double>")
    prompt.enrich_many(questions, code_store(spark)).collect()
    assert seen[0] <= 4 < 2 * len(retrieval.ladder(*retrieval.CONTEXT_START))


def test_budget_has_no_window_over_all(spark):
    contexts = spark.createDataFrame([(f"t{k}", "x" * 10) for k in range(50)], "root_id string, context string")
    kept = prompt.within_budget(contexts, [], [F.col("root_id")], 95)
    assert kept.count() == 10
    assert "SinglePartition" not in kept._jdf.queryExecution().toString()


@pytest.mark.parametrize("partitions", [1, 5, 0])
def test_running_sums_go_on_over_partitions(spark, partitions, monkeypatch):
    if partitions:
        monkeypatch.setattr(numbering, "KEY_ROWS", 100)
    partitions = partitions or 3
    rng = random.Random(partitions)
    rows = [(rng.choice(["hot"] * 20 + list("abcdef")), n, rng.choice([0, 0, 1, 5, None])) for n in range(600)] + [("zero", n, 0) for n in range(40)]
    got = numbering.running_sums(spark.createDataFrame(rows, "k string, n int, a int").repartition(partitions), F.col("a"), ["k"], ["n"], "before")
    sums, wanted = {}, []
    for k, n, a in sorted(rows, key=lambda r: r[:2]):
        wanted.append((k, n, sums.get(k, 0)))
        sums[k] = sums.get(k, 0) + (a or 0)
    assert sorted((r["k"], r["n"], r["before"]) for r in got.collect()) == sorted(wanted)


def test_a_stream_of_prompts_is_searched_under_numbers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("a long question\nanother one\na long question\n \nexit\n")
    store = spark.createDataFrame([], "id string, part int, total int, parent string, content string, metadata map<string,string>, embedding array<float>")
    kinds = []

    def search(vectors, queries, *how):
        kinds.append(queries.schema["query_id"].dataType.simpleString())
        return retrieval.similar_per_query(vectors, queries, *how)

    def stand_in(asked, store, search):
        found = search(store, asked.select(F.col("question_id").alias("query_id"), "embedding"), 3, 0.5)
        assert found.isEmpty()
        return asked.select("question_id", F.upper("question").alias("prompt"), F.lit(0).alias("level"), F.lit(1).cast("long").alias("trees"))

    with mock.patch("chunkloom.operators.prompt.enrich_many", stand_in):
        streams.enrich_batches(spark.readStream.text(f"file://{tmp_path}/in"), store, retrieval.hashing_embedder(4), f"{tmp_path}/out", f"{tmp_path}/state", search=search).awaitTermination()
    rows = spark.read.schema("question string, prompt string, level int, trees long").parquet(f"{tmp_path}/out").collect()
    assert sorted((r["question"], r["prompt"]) for r in rows) == [("a long question", "A LONG QUESTION")] * 2 + [("another one", "ANOTHER ONE")]
    assert kinds == ["bigint"]  # the texts themselves are not repeated for each of their hits
