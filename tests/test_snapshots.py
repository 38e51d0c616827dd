"""States of folders, a store that follows them, and tables in buckets."""

import os

import pytest
from pyspark.sql import functions as F

from chunkloom import registry
from chunkloom.functions.split import combine, split_content
from chunkloom.operators import prompt, retrieval
from chunkloom.operators.chunk_maps import chunk_columns
from chunkloom.operators.store import ChunkStore
from chunkloom.sources import chunk_table, files, snapshots

EMBED = retrieval.hashing_embedder(8)


def own_registry(seen):
    own = registry.Registry()
    own.pre_step(lambda files: seen.append(sorted(r["path"] for r in files.select("path").collect())))

    @own.chunker("HTML")
    def whole(files):
        return files.select(*chunk_columns(id=F.concat("path", F.lit("#1")), file=F.col("path"), content=F.col("content")))

    return own


def states(df):
    return {r["path"]: r["change"] for r in df.select("path", "change").collect()}


def test_a_store_follows_a_folder(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub dir").mkdir(parents=True)
    for name, text in {"a.html": "one", "sub dir/b.html": "two ü", "c.png": "picture", "d.html": "gone soon"}.items():
        (root / name).write_text(text)
    seen, log, store = [], snapshots.FolderLog(spark, f"file://{tmp_path}/log"), ChunkStore(spark, f"file://{tmp_path}/store", cuts=2)
    own = own_registry(seen)

    def update():
        return states(registry.update_store(spark, str(root), own, log, store, EMBED)), {r["file"]: r["content"] for r in store.read().collect()}

    assert update() == ({"a.html": "added", "sub dir/b.html": "added", "c.png": "added", "d.html": "added"}, {"a.html": "one", "sub dir/b.html": "two ü", "d.html": "gone soon"})
    (root / "a.html").write_text("one!")
    (root / "d.html").unlink()
    (root / "e.html").write_text("new")
    os.utime(root / "sub dir/b.html", (1, 1))  # another time, the same bytes
    versions = store.manifest()["version"]
    assert update() == ({"a.html": "changed", "sub dir/b.html": "same", "c.png": "same", "d.html": "removed", "e.html": "added"}, {"a.html": "one!", "sub dir/b.html": "two ü", "e.html": "new"})
    assert seen[1] == ["a.html", "e.html"] and store.manifest()["version"] == versions + 2
    assert update()[0] == {"a.html": "same", "sub dir/b.html": "same", "c.png": "same", "e.html": "same"}
    assert seen[2] == [] and store.manifest()["version"] == versions + 2


def odd_folder(root):
    for name in ("a b.txt", "50%41.txt", "ü/ö+.html", "deep/er/and deeper/x.xml", "deep/empty.txt", "_hidden/x.txt", "_own=1/x.txt", ".git/x.txt", "deep/_x.txt", "deep/.x.txt", "src/[1]{2}.txt", "_metadata.txt", "_metadata/x.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if "empty" in name else f"text of {name}".encode())
    (root / "no file").mkdir()


def test_executors_list_what_readers_list(spark, tmp_path):
    root = tmp_path / "some folder"
    odd_folder(root)
    found = files.walk(spark, str(root))
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, read.select("path", "length", "modificationTime").collect()))
    texts = files.source_files(spark, str(root), [])
    assert sorted((r["path"], r["length"], r["content"]) for r in texts.collect()) == sorted((r["path"], r["length"], r["content"].decode()) for r in read.collect())
    for rows in (found, texts):  # a scan of Spark's keeps every name on the driver
        assert "binaryFile" not in rows._jdf.queryExecution().executedPlan().toString()
    done = read.filter("path like '%a b.txt'").select("path")
    assert texts.count() - files.source_files(spark, str(root), [], done=done).count() == 1
    assert files.source_files(spark, str(root), [lambda path, length: path.startswith("deep/")]).count() == texts.count() - 1


def test_changes_of_a_folder_with_odd_names(spark, tmp_path):
    root = tmp_path / "some folder"
    odd_folder(root)
    log = snapshots.FolderLog(spark, f"file://{tmp_path}/log")
    found = snapshots.changes(spark, str(root), log)
    assert "binaryFile" not in found._jdf.queryExecution().executedPlan().toString()
    names = {"a b.txt", "50%41.txt", "ü/ö+.html", "deep/er/and deeper/x.xml", "_own=1/x.txt", "src/[1]{2}.txt", "_metadata/x.txt"}
    assert states(found) == dict.fromkeys(names, "added")
    log.write(found)
    assert states(snapshots.changes(spark, str(root), log)) == dict.fromkeys(names, "same")


def test_a_run_that_fails_is_repeated(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.html").write_text("one")
    log, store = snapshots.FolderLog(spark, f"file://{tmp_path}/log"), ChunkStore(spark, f"file://{tmp_path}/store")
    broken = registry.Registry()
    broken.chunker("HTML")(lambda files: files.select("no such column"))
    with pytest.raises(Exception, match="no such column"):
        registry.update_store(spark, str(root), broken, log, store, EMBED)
    assert log.state().isEmpty()
    assert states(registry.update_store(spark, str(root), own_registry([]), log, store, EMBED)) == {"a.html": "added"} and store.read().count() == 1


def test_retract_writes_only_folders_that_hold_the_files(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store", cuts=2)
    store.retract(spark.createDataFrame([("f0",)], "file string"))
    for a in range(3):
        store.add(spark.createDataFrame([(f"id{a}{k}", f"f{k}" if a else "other", 0, "text") for k in range(4)], "id string, file string, part int, content string"), EMBED)
    first = store.manifest()["folders"][0]
    store.retract(spark.createDataFrame([("f1",), ("f1",), (None,), ("absent",)], "file string"))
    assert store.manifest()["folders"][0] == first and len(store.manifest()["folders"]) == 2
    assert sorted(r["id"] for r in store.read().collect()) == sorted(f"id{a}{k}" for a in range(3) for k in range(4) if not a or k != 1)
    before = store.manifest()
    store.retract(spark.createDataFrame([("absent",)], "file string"))
    assert store.manifest() == before
    store.retract(store.read().select("file"))
    assert store.read().count() == 0


def test_units_of_a_stored_table_are_not_shuffled(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"line of {k}\n" * (k % 40)) for k in range(120)], "k long, text string")
    cut = split_content(docs, "text", 100, 10)
    chunks = cut.select(*chunk_columns(id=F.concat(F.lit("d"), F.col("k").cast("string")), **{c: F.col(c) for c in ("part", "total", "size", "overlap", "fromLine", "toLine", "content")}))
    table = chunk_table.save(chunks, "stored_for_test", f"file://{tmp_path}/table", buckets=4)
    whole = combine(table)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    hits = spark.createDataFrame([("d39",), ("d7",)], "id string")
    done = retrieval.complete_hits(hits, table)
    assert {r["id"]: r["content"] for r in whole.collect()} == {f"d{r['k']}": r["text"] for r in docs.collect()}
    assert {r["id"] for r in done.collect()} == {"d39", "d7"}
    spark.sql("DROP TABLE stored_for_test")


def test_answers_are_made_by_the_executors(spark):
    rows = spark.createDataFrame([("a",), (None,), ("b",)], "p string")
    assert [r[0] for r in rows.select(prompt.answered(F.col("p"), lambda text: text * 2)).collect()] == ["aa", None, "bb"]
    assert [r[0] for r in rows.select(prompt.answered(F.col("p"), prompt.silent_chat)).collect()] == ["", None, ""]
