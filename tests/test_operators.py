import io

import pytest
from pyspark.sql import functions as F

from chunkloom import registry
from chunkloom.functions import scalars
from chunkloom.operators.store import ChunkStore
from chunkloom.operators import chunk_maps, forest, graph, numbering, prompt, retrieval, vetoes
from chunkloom.operators.numbering import batches, row_numbers
from chunkloom.sources import jsonl
from chunkloom.sources.files import text_lines


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_vetoes(spark):
    rows = [("build.gradle", 1), ("src/target/x.java", 1), (".hidden", 1), ("a.PNG", 1), ("a.png", 1), ("b.java", 1_000_000), ("b.java", 1_000_001), ("noDot", 1), (None, 1)]
    df = spark.createDataFrame(rows, "path string, length long").select("path", "length", vetoes.vetoed(vetoes.standard_vetoes()).alias("v"))
    assert [r["v"] for r in df.collect()] == [True, True, True, False, True, False, True, False, False]
    listed = spark.createDataFrame([("x.java",), ("x.jav",), ("x.py",)], "path string").withColumn("length", F.lit(1))
    assert [r["path"] for r in vetoes.allowed(listed, [vetoes.not_listed("java,xml")]).collect()] == ["x.java"]
    assert [r["path"] for r in vetoes.allowed(listed, [vetoes.not_listed("java,xml", compat=True)]).collect()] == ["x.java", "x.jav"]
    assert vetoes.allowed(listed, [vetoes.not_listed(" ")]).count() == 3
    assert vetoes.unprocessed(listed.union(listed), listed.limit(1)).count() == 2


def test_jsonl(spark):
    lines = ['{"id":"a","part":1,"metadata":{"k":"v"},"more":2}', "  ", '{"id":"b"', '{"id":null,"part":null}', "nonsense"]
    got = jsonl.decode(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r["id"] for r in got] == ["a", None] and got[0]["metadata"] == {"k": "v"}
    back = jsonl.to_lines(spark.createDataFrame(got, jsonl.CHUNK_SCHEMA)).collect()
    assert '"parent":null' in back[0]["value"]
    assert text_lines(spark, "-", io.StringIO("x\ny\n")).count() == 2


def test_ladders():
    assert len(retrieval.ladder(8, 0.85)) == 11 and len(retrieval.ladder(20, 0.75)) == 5
    assert retrieval.ladder(8, 0.85)[5] == (5, 16, 0.7999999999999999)


def test_metadata_search_needs_a_condition(spark):
    df = spark.createDataFrame([("a", {"k": "v"}), ("b", {})], "id string, metadata map<string,string>")
    assert retrieval.find_by_metadata(df, {}).count() == 0
    assert [r["id"] for r in retrieval.find_by_metadata(df, {"k": "v"}).collect()] == ["a"]


def test_failed_batches_are_reported(spark):
    def picky(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[1.0, 0.0]] * len(texts)

    df = spark.createDataFrame([("a", "ok"), ("b", "bad")], "id string, content string").repartition(1)
    got = {r["id"]: (r["embedding"], r["embed_error"]) for r in retrieval.embedded(df, picky, batch=1).collect()}
    assert got["a"][1] is None and got["b"] == (None, "no")


def test_store(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("a", 0, "red apple"), ("b", 0, " \n"), ("c", 0, "green tree")], "id string, part int, content string")
    embed = retrieval.hashing_embedder(32)
    store.add(rows, embed)
    store.add(rows, embed)
    assert sorted(r["id"] for r in store.read().collect()) == ["a", "c"]
    assert store.find_relevant("red apple", embed, 1, 0.9).first()["id"] == "a"
    assert store.find_relevant("  ", embed, 1, 0.0).count() == 0
    store.reset()
    assert store.read().count() == 0


def test_names(spark):
    uses = spark.createDataFrame([("f", "p", n) for n in ("A", "B", "C", "D", "E")] + [("g", None, "A")], "file string, package string, name string")
    imports = spark.createDataFrame([("f", "x.A", False), ("f", "w", True)], "file string, import string, is_wildcard boolean")
    symbols = spark.createDataFrame([("A", "x.A"), ("A", "p.A"), ("B", "p.B"), ("B", "q.B"), ("C", "w.C"), ("D", "q.D")], "name string, fqn string")
    got = {(r["file"], r["name"]): r["fqn"] for r in graph.resolve_names(uses, imports, symbols).collect()}
    assert got == {("f", "A"): "x.A", ("f", "B"): "p.B", ("f", "C"): "w.C", ("f", "D"): "D", ("f", "E"): "", ("g", "A"): "A"}


CHUNKS = [("K", None, "classFrame"), ("K.m", "K", "method"), ("K.m.javadoc", "K.m", "methodDoc"), ("lost.m", "lost", "method"), ("x", "y", "imports"), ("y", "x", "imports"), ("K.dependencies", "K", "dependenciesInfo")]


def test_forest(spark):
    chunks = spark.createDataFrame(CHUNKS, "id string, parent string, section string")
    hits = spark.createDataFrame([("K.m",), ("K.m.javadoc",), ("lost.m",), ("x",), ("none",), ("K.m",)], "id string")
    closure = forest.ancestor_closure(hits, chunks)
    assert {r["hit_id"]: r["root_id"] for r in forest.roots(closure).collect()} == {"K.m": "K", "K.m.javadoc": "K", "lost.m": "lost.m", "x": "y"}
    assert {r["root_id"]: r["rank"] for r in forest.tree_ranks(closure).collect()} == {"K": 10, "lost.m": 5, "y": 1}
    only = forest.ancestor_closure(spark.createDataFrame([("K.dependencies",)], "id string"), chunks)
    assert forest.tree_ranks(only).first()["rank"] == 0


def test_budget_and_rank_zero(spark):
    contexts = spark.createDataFrame([("a", "x" * 30000), ("b", "y" * 30000), ("c", "z"), ("d", "w")], "root_id string, context string")
    ranks = spark.createDataFrame([("a", 9), ("b", 5), ("c", 2), ("d", 0)], "root_id string, rank long")
    got = prompt.assembled(contexts, ranks).first()
    assert got["trees"] == 2 and len(got["context"]) == 60000
    assert prompt.assembled(contexts, ranks, [prompt.mentions("z")]).first()["context"] == "z"


def test_doc_comments(spark):
    c = F.col("a")
    assert one(spark, scalars.doc_comment(c), a="x /** one */ y /** two */ z") == "/** one */ y /** two */"
    assert one(spark, scalars.doc_comment(c), a="none") == "none"
    assert [one(spark, scalars.is_doc_comment(c), a=x) for x in ("/** a */", "a", "")] == [True, False, False]


def test_strings(spark):
    a, b, d = F.col("a"), F.col("b"), F.col("d")
    assert one(spark, scalars.insert_before(a, b, d), a="one two two", b="two", d="X ") == "one X two two"
    assert one(spark, scalars.insert_before(a, b, d), a="one", b="two", d="X ") == "one"
    assert one(spark, scalars.after_first_line(a), a="no break") == "no break"
    assert one(spark, scalars.path_from_source_root(a), a="/x/src/a/B.java") == "src/a/B.java"
    assert one(spark, scalars.path_from_source_root(a), a="/x/B.java") == "B.java"
    assert one(spark, scalars.method_name(a, b), a="p.K.void m(a.B...)", b="p.K") == "void m(a.B...)"
    assert one(spark, scalars.simple_method_name(a), a="public void m(int x)") == " m("
    assert one(spark, scalars.line_range(a, F.lit(1), F.lit(9)), a="p\nq\nr") == "q\nr\n"
    assert one(spark, scalars.section_of(a), a="odd") == "unknown"


def test_numbers(spark):
    df = spark.range(0, 1003, numPartitions=7).select((F.col("id") * 7919 % 1003).alias("k"))
    assert [r["row"] for r in row_numbers(df, "k").orderBy("k").collect()] == list(range(1003))
    assert batches(df, 50, "k").groupBy("batch").count().count() == 21


@pytest.mark.parametrize("chat", [prompt.silent_chat, lambda p: p])
def test_ask(spark, chat):
    embed = retrieval.hashing_embedder(64)
    rows = [("K", None, "classFrame", "\nclass K {\n    void m()\n}\n"), ("K.void m()", "K", "method", "//Methode void m() in class K:\n    void m() { go(); }\n")]
    from chunkloom.operators.chunk_maps import chunk_columns

    df = spark.createDataFrame(rows, "i string, p string, s string, c string")
    metadata = F.create_map(F.lit("java_code_section"), F.col("s"))
    chunks = df.select(*chunk_columns(id=F.col("i"), parent=F.col("p"), content=F.col("c"), metadata=metadata, total=F.lit(1)))
    store = retrieval.embedded(chunks, embed)
    answer = prompt.ask(spark, store, "void m() { go(); }", embed, chat)
    assert answer == "" if chat is prompt.silent_chat else "void m() { go(); }" in answer and "class K" in answer
    assert prompt.enrich(spark, store, "zzz", embed, validators=[prompt.mentions("absent")]) == prompt.NO_CONTEXT


def test_chains_of_any_depth_and_cycles(spark):
    chain = [(f"n{k}", f"n{k + 1}", "method") for k in range(90)] + [("n90", None, "classFrame"), ("a", "b", "method"), ("b", "a", "method"), ("lone", "absent", "method")]
    chunks = spark.createDataFrame(chain, "id string, parent string, section string")
    hits = spark.createDataFrame([("n0",), ("a",), ("lone",), ("not there",)], "id string")
    closure = forest.ancestor_closure(hits, chunks)
    assert {(r["hit_id"], r["root_id"]) for r in forest.roots(closure).collect()} == {("n0", "n90"), ("a", "b"), ("lone", "lone")}
    assert closure.filter("hit_id = 'n0'").count() == 91


def test_registries_of_installed_packages(spark, monkeypatch):
    class Point:
        def __init__(self, name, own):
            self.name, self.load = name, lambda: own

    one, two = registry.Registry(), registry.Registry()
    one.veto(lambda path, length: path.contains("a"))
    two.chunker("XML")(lambda files: files)
    asked = []
    monkeypatch.setattr(registry.metadata, "entry_points", lambda group: asked.append(group) or [Point("b", lambda: two), Point("a", one)])
    found = registry.discovered()
    assert len(found.vetoes) == 1 and len(found.chunkers) == 1 and asked == ["chunkloom.registries"]


def test_names_of_vetoed_files_resolve(spark, tmp_path):
    for name, text in {"src/p/A.java": "package p;\nimport q.B;\nclass A { B b; }\n", "build/q/B.java": "package q;\nclass B {}\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    chunks = registry.chunk_folder(spark, str(tmp_path), registry.java_registry("q"))
    got = {r["id"]: r["content"] for r in chunks.collect()}
    assert "  * q.B\n" in got["p.A.dependencies"] and "q.B" not in got


def test_sources_are_written_once(spark, tmp_path):
    files = spark.createDataFrame([(f"/x/src/p/F{k}.java", f"text {k} \u00fc\n" * k) for k in range(20)] + [("/x/src/p/F1.java", "other"), ("/y/src/q/N.java", None)], "path string, content string").repartition(4)
    root = f"file://{tmp_path}/out"
    assert jsonl.unwritten(files, root).count() == 22 and jsonl.write_sources(files, root) == 21
    assert jsonl.write_sources(files, root) == 0 and jsonl.unwritten(files, root).isEmpty()
    assert (tmp_path / "out/src/p/F7.java").read_text() == "text 7 \u00fc\n" * 7 and (tmp_path / "out/src/q/N.java").read_text() == ""
    assert not [p for p in (tmp_path / "out").rglob(".*") if not p.name.endswith(".crc")]


def test_checkpoints_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="checkpoint"):
        numbering.shared_folder(Session)


def test_many_prefetched_chunks_are_kept(spark):
    embed = retrieval.hashing_embedder(16)
    rows = [(f"c{k}", f"\nbody of {k}") for k in range(1200)]
    chunks = spark.createDataFrame(rows, "id string, content string").select(*chunk_maps.chunk_columns(id=F.col("id"), part=F.lit(0), total=F.lit(1), size=F.lit(1), overlap=F.lit(0), content=F.col("content"), metadata=F.create_map(F.lit("java_code_section"), F.lit("classFrame"))))
    store = retrieval.embedded(chunks, embed).drop("embed_error").cache()
    text = prompt.enrich(spark, store, "body of 7", embed, template="{}|{}", prefetched=store.select("id"))
    assert text.count("## Hier ein Rumpf der Klasse") > 500 and len(text) > 50_000


def test_checkpoints_go_with_their_frames(spark):
    import gc
    import glob
    import time

    folder = numbering.shared_folder(spark).removeprefix("file:")

    def files():
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
        return set(glob.glob(f"{folder}/rdd-*"))

    before = files()
    kept = numbering.checkpointed(spark.range(1000).repartition(3))
    assert row_numbers(spark.range(1000), "id").count() == 1000 and kept.count() == 1000
    left = files() - before
    for _ in range(40):
        if len(left) <= 1:
            break
        left = files() - before
    assert len(left) == 1 and kept.count() == 1000
