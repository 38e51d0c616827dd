import pytest
from pyspark.sql import functions as F

from chunkloom.documentation import document_project
from chunkloom.operators import graph, java, retrieval
from chunkloom.registry import Registry, chunk_folder, java_registry
from chunkloom.schema import CHUNK_COLUMNS, SECTION_KEY

BODY = 'class TestClass {\n    public void testMethod(%s s) {\n        System.out.println("Hello, World!");\n    }\n}\n'


def chunked(spark, text, path="TestClass.java"):
    files = spark.createDataFrame([(path, text)], "path string, content string")
    return {r["id"]: r for r in java.code_chunks(java.scan(files)).collect()}


def test_class_without_package(spark):
    got = chunked(spark, BODY % "String")
    assert "\nclass TestClass {\n\n    void testMethod(String)\n}\n" in got["TestClass"]["content"]
    assert got["TestClass.imports"]["content"] == "\n"
    method = got["TestClass.void testMethod(String)"]
    assert method["content"] == "//Methode void testMethod(String) in class TestClass:\n" + "".join(x + "\n" for x in (BODY % "String").split("\n")[1:4])
    assert method["parent"] == "TestClass" and method["metadata"][SECTION_KEY] == "method"


def test_package_and_wildcard(spark):
    got = chunked(spark, "package a.b;\n\nimport a.util.*;\n\n" + BODY % "Odd")
    frame = got["a.b.TestClass"]["content"]
    assert all(x in frame for x in ("package a.b;", "import a.util.*;", "class TestClass {", "void testMethod(Odd)"))
    assert "import a.util.*;" in got["a.b.TestClass.imports"]["content"]
    assert "a.b.TestClass.void testMethod(Odd)" in got


@pytest.mark.parametrize(
    ("text", "signatures"),
    [
        ("class A { <T extends B> Map<String, List<T>> f(final int[] a, String... r) throws X { return null; } }", ["<T extends B> Map<String, List<T>> f(int[], String...)"]),
        ('class A { String s = "}{"; char c = \'}\'; /* } */ A() { } void g() { Runnable r = () -> { }; } }', ["void g()"]),
        ("interface I { int CONST = 3; default void d() {} @Ann(x = \"{\") void e(); }", ["void d()", "void e()"]),
        ("record R(int a, B b) { R { } int sum() { return a; } }", ["int sum()"]),
        ("enum E { A { void hidden() {} }, B(2); private final int x; E(int x) { this.x = x; } int x() { return x; } }", ["int x()"]),
        ("@interface Q { String value() default \"}\"; }", ["String value()"]),
        ('class T { String t = """\n  } class X {\n  """; void m() {} }', ["void m()"]),
        ("class O { static { int x = 1; } int a[] = {1, 2}, b; void m(int x[]) {} }", ["void m(int[])"]),
    ],
)
def test_signatures(text, signatures):
    assert [m.signature for m in java.parse(text).types[0].methods] == signatures


def test_errors_are_rows(spark):
    files = spark.createDataFrame([("A.java", "class A { void f( }"), ("package-info.java", "package x;"), ("B.java", None), ("B.txt", "class B {}")], "path string, content string")
    rows = java.scan(files)
    assert {r["file"] for r in java.errors(rows).collect()} == {"A.java", "package-info.java", "B.java"}
    assert rows.filter("kind <> 'error'").count() == 0


def test_nested_types_give_names_and_edges():
    rows = java.scanned("A.java", "package p;\nclass A { B b; static class In extends C { D f(E e) { return null; } } }\nclass Z { Y y; }\n")
    assert {(r["a"], r["b"]) for r in rows if r["kind"] == "name"} == {("A", "p.A"), ("In", "p.A.In"), ("Z", "p.Z")}
    assert {(r["a"], r["b"]) for r in rows if r["kind"] == "edge"} == {("p.A", "B"), ("p.A.In", "C"), ("p.A.In", "D"), ("p.A.In", "E")}


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_folder_to_chunks(spark, tmp_path):
    write(tmp_path / "project", {"src/p/A.java": "package p;\nimport p.q.B;\nclass A { B b; void f(C c) {} }\n", "src/p/C.java": "package p;\nclass C {}\n", "build/X.java": "class X {}\n", "src/.h.java": "class H {}", "notes.txt": "no"})
    root = str(tmp_path / "project")
    chunks = chunk_folder(spark, root, java_registry("p"), white_list="java")
    assert chunks.columns == CHUNK_COLUMNS
    got = {r["id"]: r for r in chunks.collect()}
    assert {"p.A", "p.C", "p.A.imports", "p.A.void f(C)", "p.A.dependencies"} <= set(got) and not any("X" in i or "H" in i for i in got)
    assert "  * p.C\n" in got["p.A.dependencies"]["content"] and "  * p.q.B\n" in got["p.A.dependencies"]["content"]
    assert got["p.A.dependencies"]["toLine"] == str(len(got["p.A.dependencies"]["content"]) - 1)


def test_registry_runs_all_matching(spark, tmp_path):
    own = Registry()
    seen = []
    own.pre_step(lambda files: seen.append(files.count()))
    own.veto(lambda path, length: path.contains("skip"))

    @own.chunker("HTML", "XML")
    class Whole:
        def __call__(self, files):
            from chunkloom.operators.chunk_maps import chunk_columns

            return files.select(*chunk_columns(id=F.col("path"), content=F.col("content")))

    write(tmp_path / "p", {"a.html": "x", "b.xml": "y", "skip.xml": "z", "c.js": "w"})
    chunks = chunk_folder(spark, str(tmp_path / "p"), own.merged(own)).collect()
    assert len(chunks) == 4 and seen[0] == 3


def test_documentation(spark, tmp_path):
    text = "package p;\nclass A {\n    void f() {\n    }\n}\n"
    files = spark.createDataFrame([("/x/src/p/A.java", text)], "path string, content string")
    embed = retrieval.hashing_embedder(64)
    store = retrieval.embedded(java.code_chunks(java.scan(files)), embed)
    asked = []

    def chat(question):
        asked.append(question)
        return "Gern: /**\n * Does f.\n */ so"

    out = f"file://{tmp_path}/out"
    rows = document_project(spark, files, store, embed, chat, out, wait=0.0)
    assert rows.count() == 1 and "void f()" in asked[0]
    written = (tmp_path / "out/src/p/A.java").read_text()
    assert "Does f." in written and written.index("Does f.") < written.index("void f()")
    assert java.parse(written).types[0].methods[0].doc is not None
    assert document_project(spark, files, store, embed, chat, out, wait=0.0).count() == 0 and len(asked) == 1
    assert graph.dependency_edges(java.raw_edges(java.scan(files)), "p.").count() == 0


def test_command_line(spark, tmp_path, capsys):
    from chunkloom.__main__ import main

    write(tmp_path / "project", {"src/p/A.java": "package p;\nclass A { void find() {} }\n"})
    main(["chunk", "-r", str(tmp_path / "project"), "-o", f"file://{tmp_path}/lines", "-wl", "java", "--prefix", "p"])
    main(["embed", "-i", f"file://{tmp_path}/lines", "--store", f"file://{tmp_path}/store"])
    capsys.readouterr()
    main(["context", "--store", f"file://{tmp_path}/store", "-q", "class A void find"])
    assert "class A" in capsys.readouterr().out
    main(["ask", "--store", f"file://{tmp_path}/store", "-q", "class A"])
    assert capsys.readouterr().out == "\n"
    main(["chunk", "-r", str(tmp_path / "project"), "-wl", "java"])
    assert '"id":"p.A"' in capsys.readouterr().out
