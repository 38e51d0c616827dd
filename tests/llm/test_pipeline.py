import collections
import os
import random

import pytest

import corpus_pipeline
from chunkloom.llm import pii

WORDS = [a + b + c for a in ("ta", "re", "mo", "li") for b in ("no", "si", "ve", "ru") for c in ("k", "l", "n", "s", "t")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    rows, toxic = [], []
    for k in range(260):
        text = " ".join(rng.choice(WORDS) + str(rng.randrange(30)).replace("0", "") .translate(str.maketrans("123456789", "abcdefghi")) for _ in range(rng.randrange(30, 90)))
        bad = k % 6 == 0
        if bad:
            text += f" you {rng.choice(['zorkish', 'blarg'])} thing"
        if k % 10 == 7:
            text += " mail bob.x@site.org today"
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
        toxic.append((k, 1, int(bad)))
    rows += [(300 + k, rows[2 * k + 1][1] + " extra", "en", "s0", 1) for k in range(10)]
    rows += [(400, None, "en", None, None), (401, "", None, "s1", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, steps = docs.columns, {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = os.path.join(folder, name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        steps[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {n: collections.Counter(r["doc_id"] for r in d.select("doc_id").collect()) for n, d in steps.items()}
    clean = {k for k in ids["start"] if k >= 260 or k % 6}
    caught = set(ids["start"]) - set(ids["toxicity"])
    assert len(caught - {k for k in range(260) if k % 6 == 0}) <= 5 and len(caught) >= 38
    assert len(clean & set(ids["toxicity"])) >= len(clean) - 5
    copies = {300 + k for k in range(10) if 2 * k + 1 in ids["toxicity"]}
    assert not copies & set(ids["near_duplicates"])
    assert set(ids["toxicity"]) - copies == set(ids["near_duplicates"]) and max(ids["near_duplicates"].values()) == 1
    texts = {r["doc_id"]: r for r in steps["personal_data"].collect()}
    assert set(texts) == set(ids["near_duplicates"]) and not any("@" in (r["text"] or "") for r in texts.values())
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in texts.values())
    assert max(ids["mixing"].values()) <= 2
    packed = steps["packing"].filter("piece = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in packed} == dict(ids["mixing"])


def test_a_document_listed_twice_stays_once(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id < 5")
    out = corpus_pipeline.drop_near_duplicates(spark, docs.union(docs), folder)
    assert out.count() == docs.count()


def test_of_rows_that_share_a_doc_id_the_same_one_stays(spark, folder):
    rows = [(1, f"some text that is number {k} " + " ".join(WORDS[k : k + 30]), "en", f"s{k}", k) for k in range(8)] + [(2, None, "en", "a", 1), (2, None, "de", "b", 2), (3, "", None, None, None), (None, "x", "en", "s", 1), (None, None, None, None, None)]
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    for order in (rows, rows[::-1]):
        out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(order, schema).repartition(3), folder).collect()
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out) == [(0, ""), (0, "x"), (1, rows[0][1]), (2, ""), (3, "")]


@pytest.fixture(scope="module")
def odd(spark, folder):
    """Documents with nulls in every column, ties and columns whose names the operators use."""
    rows = [(1, "plain text of the first one", "en", "a"), (1, "plain text of the first one", "en", "a"), (2, None, None, None), (None, "no id", "en", "a"), (None, None, None, None), (3, "", "de", ""), (4, "w " * 30_000, "en", "a"), (5, "mail x@y.org", "en", None)]
    names = ["size", "copies", "key", "hash", "group", "whole", "__size", "__block", "class", "component_id", "piece", "length", "id", "row", "__label", "kept"]
    columns = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *range(len(names))) for r in rows], columns)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_every_stage_takes_odd_and_empty_tables(spark, folder, odd, name, stage):
    out = stage(spark, odd, folder)
    if name != "packing":
        assert out.columns == odd.columns and {r["hash"] for r in out.collect()} == {3}
    counts = collections.Counter(r["doc_id"] for r in out.collect())
    wanted = {"toxicity": {1: 2, 2: 1, None: 2, 3: 1, 4: 1, 5: 1}, "near_duplicates": {1: 1, 2: 1, None: 2, 3: 1, 4: 1, 5: 1}, "personal_data": {1: 2, 2: 1, None: 2, 3: 1, 4: 1, 5: 1}}
    assert name not in wanted or dict(counts) == wanted[name]
    if name == "packing":
        assert counts[1] == 2 and counts[4] > 1 and counts[None] == 2
    assert stage(spark, odd.limit(0), folder).count() == 0


def test_run_is_the_stages_one_after_the_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).checkpoint()
    wanted = collections.Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.pack(spark, docs, folder).collect())
    assert collections.Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect()) == wanted


def test_redaction_leaves_clean_text(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id % 10 = 1")
    field = pii.trained_field()
    assert sorted(map(str, pii.redact(docs, field).collect())) == sorted(map(str, docs.collect()))
