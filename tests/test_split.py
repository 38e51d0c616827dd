import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.functions.split import combine, split_content, split_pieces, unsplit
from chunkloom.operators import numbering
from chunkloom.operators.chunk_maps import chunk_columns, chunk_from_map, flat_map
from chunkloom.schema import CHUNK_COLUMNS


def rows_of(spark, texts, size, overlap, prefix=""):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return split_content(df, "text", size, overlap, prefix)


def test_round_trip_of_lines(spark):
    text = "1234567890 1234567890 1234567890 1234567890\n" * 4
    parts = rows_of(spark, [text], 37, 13, "SOME OLD PREFIX")
    kept = parts.orderBy("part").collect()
    assert len(kept) == 22 and {r["total"] for r in kept} == {22} and len(kept[-1]["content"]) == 24
    assert unsplit(parts, "id").first()["content"] == text


def test_part_counts_at_the_edges(spark):
    lengths = [0, 1, 1298, 1299, 1300, 2398, 2399, 2400]
    parts = rows_of(spark, ["x" * n for n in lengths], 1300, 100).groupBy("id").count().orderBy("id").collect()
    assert [r["count"] for r in parts] == [1, 1, 1, 2, 2, 2, 3, 3]


def test_window_not_larger_than_overlap(spark):
    with pytest.raises(ValueError):
        rows_of(spark, ["abc"], 14, 13)
    df = spark.createDataFrame([("abc", "long prefix")], "text string, p string")
    with pytest.raises(Exception, match="window not larger"):
        split_content(df, "text", 14, 5, F.col("p")).collect()


def test_lines(spark):
    df = spark.createDataFrame([("ab\ncd\nef\ngh",)], "text string")
    rows = split_content(df, "text", 7, 2, from_line=12).orderBy("part").collect()
    assert [(r["fromLine"], r["toLine"]) for r in rows] == [("12", "14"), ("14", "16"), ("16", "17")]
    compat = split_content(df, "text", 7, 2, from_line=12, compat_lines=True).orderBy("part").first()
    assert compat["toLine"] == "122"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="ab\n é", max_size=80), min_size=1, max_size=6), overlap=st.integers(0, 5), prefix=st.sampled_from(["", "//p"]))
def test_round_trip(spark, texts, overlap, prefix):
    parts = rows_of(spark, texts, 12 + len(prefix), overlap, prefix)
    assert {r["id"]: r["content"] for r in unsplit(parts, "id").collect()} == dict(enumerate(texts))


def chunks(spark, rows):
    df = spark.createDataFrame(rows, "i string, p int, t int, o int, c string, par string")
    metadata = F.create_map(F.lit("a.b"), F.lit("v"))
    return df.select(*chunk_columns(id=F.col("i"), part=F.col("p"), total=F.col("t"), overlap=F.col("o"), content=F.col("c"), parent=F.col("par"), metadata=metadata))


def test_combine(spark):
    rows = [("u", 2, 3, 2, "h\nij", None), ("u", 0, 3, 2, "h\nabcdef", None), ("u", 1, 3, 2, "h\nefghij", None), ("u", 1, 3, 2, "h\nefghij", None), ("s", 0, 1, 0, "\nalone", "u"), (None, 0, 1, 0, "x", None)]
    got = {r["id"]: r for r in combine(chunks(spark, rows)).collect()}
    assert set(got) == {"u", "s"}
    assert got["u"]["content"] == "abcdefghij" and got["u"]["part"] == got["u"]["total"] == 0 and got["u"]["size"] == 8
    assert got["s"]["parent"] == "u" and got["s"]["metadata"] == {"a.b": "v"}


def test_flat_map_and_back(spark):
    df = chunks(spark, [("u", 0, 1, 0, "\nx", None)])
    flat = df.select(flat_map().alias("m"), "content")
    keys = flat.first()["m"]
    assert "chunk_parent" not in keys and keys["chunk_metadata.a.b"] == "v" and keys["chunk_part"] == "0"
    assert flat.select(*chunk_from_map("m", "content")).collect() == df.select(*CHUNK_COLUMNS).collect()
    with pytest.raises(Exception, match="needs an id"):
        spark.createDataFrame([({"chunk_part": "1"}, "x")], "m map<string,string>, content string").select(*chunk_from_map("m", "content")).collect()


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, text string")
    assert split_content(df, "text", 20, 2).count() == 0


@pytest.mark.parametrize("most", [100, 1 << 17])
def test_pieces_give_the_windows_of_the_whole_text(spark, monkeypatch, most):
    monkeypatch.setattr(numbering, "KEY_ROWS", most)
    rng = random.Random(2)
    rows = [(f"k{k}", n, rng.choice(["", "x", "ab\n", "line of text\n", "\n\n", "longer than a window " * 4])) for k in range(30) for n in range(rng.choice([1, 2, 9, 60]))]
    rows += [("hot", n, f"user {n}\n") for n in range(1500)] + [("edge", 0, "y" * 39), ("short", 0, "y" * 38), ("one", 0, "z")]
    rows += [(f"k{k}", -1, "h") for k in range(30)]
    whole = {}
    for key, _, text in sorted(rows, key=lambda r: (r[0], r[1])):
        whole[key] = whole.get(key, "") + text
    pieces = spark.createDataFrame(rows, "key string, nr int, text string").repartition(5)
    columns = ["key", "part", "total", "size", "overlap", "fromLine", "toLine", "content"]
    got = sorted(tuple(r) for r in split_pieces(pieces, ["key"], ["nr"], 40, 7, from_line=0).select(*columns).collect())
    texts = spark.createDataFrame(list(whole.items()), "key string, t string")
    wanted = sorted(tuple(r) for r in split_content(texts, "t", 40, 7, from_line=0, to_line=F.length("t")).select(*columns).collect())
    assert got == wanted
    with pytest.raises(ValueError, match="overlap"):
        split_pieces(pieces, ["key"], ["nr"], 8, 7)
