"""Queries on dependencies, names, trees and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forest, graph, java, prompt
from ..operators.numbering import checkpointed
from ..schema import SECTION_KEY
from .common import table

PREFIX = "nation1"


def _raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers use their nations, nations their regions."""
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    up = customer.select(F.concat(F.lit("segment."), "c_mktsegment").alias("source"), F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("target"))
    return up.union(nation.select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")), F.concat(F.lit("region"), F.col("n_regionkey").cast("string"))))


def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependency_edges(_raw_edges(spark, sf_dir), PREFIX)


def dependencies_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependencies(graph.dependency_edges(_raw_edges(spark, sf_dir))).select("source", F.array_join("targets", ",").alias("targets"))


def used_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.used_by(graph.dependency_edges(_raw_edges(spark, sf_dir))).select("target", F.array_join("sources", ",").alias("sources"))


def dependency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependency_reports(graph.dependency_edges(_raw_edges(spark, sf_dir)))


def dependency_report_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = graph.dependency_chunks(graph.dependency_edges(_raw_edges(spark, sf_dir)), size=200, overlap=20)
    return chunks.select("id", "parent", "part", "total", "size", "overlap", "content")


def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of parts as names, brands as files and packages, three brands' types as symbols."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    uses = part.select(F.col("p_brand").alias("file"), F.when(F.col("p_brand") != "Brand#3", F.col("p_brand")).alias("package"), F.col("p_type").alias("name"))
    known = part.filter(F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#4") & (F.col("p_type") != "ECONOMY"))
    symbols = known.select(F.col("p_type").alias("name"), F.concat_ws(".", "p_brand", "p_type").alias("fqn"))
    imports = spark.createDataFrame([("Brand#5", "Brand#4.SMALL", False), ("Brand#5", "Brand#2", True), ("Brand#6", "Brand#2", True), ("Brand#6", "Brand#4", True), ("Brand#1", "Brand#2.PROMO", False)], "file string, import string, is_wildcard boolean")
    return graph.resolve_names(uses, imports, symbols)


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions over nations over customers over orders, a section for each level; orders over 400,000 are hits."""
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))

    def ident(kind: str, key: str):
        return F.concat(F.lit(kind), F.col(key).cast("string"))

    rows = region.filter("r_regionkey <> 3").select(ident("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("classFrame").alias("section"))
    rows = rows.union(nation.select(ident("n", "n_nationkey"), ident("r", "n_regionkey"), F.lit("imports")))
    rows = rows.union(customer.select(ident("c", "c_custkey"), ident("n", "c_nationkey"), F.lit("methodDoc")))
    rows = rows.union(orders.select(ident("o", "o_orderkey"), ident("c", "o_custkey"), F.when(F.col("o_orderstatus") == "F", "method").otherwise("other")))
    return rows, orders.filter("o_totalprice > 400000").select(ident("o", "o_orderkey").alias("id"))


def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, hits = _tree(spark, sf_dir)
    return forest.ancestor_closure(hits, rows).select("hit_id", "node_id", "depth")


def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, hits = _tree(spark, sf_dir)
    return forest.roots(forest.ancestor_closure(hits, rows))


def tree_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, hits = _tree(spark, sf_dir)
    return forest.tree_ranks(forest.ancestor_closure(hits, rows))


def forest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, hits = _tree(spark, sf_dir)
    nodes = forest.forest(forest.ancestor_closure(hits, rows))
    return nodes.select("root_id", "node_id", F.array_join("path", ">").alias("path"))


def forest_root_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, hits = _tree(spark, sf_dir)
    return forest.forest_roots(forest.ancestor_closure(hits, rows))


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("context"))
    kept = prompt.within_budget(turns, ["conv_id"], [F.desc(F.length("context")), F.col("turn")], 900)
    return kept.select("conv_id", "turn")


def conversation_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's answers as context of its first turn's question."""
    turns = table(spark, sf_dir, "conversations")
    kept = prompt.within_budget(turns.filter("turn > 0").select("conv_id", "turn", F.col("text").alias("context")), ["conv_id"], [F.col("turn")], 2000)
    each = F.array_sort(F.collect_list(F.struct("turn", "context")))
    context = kept.groupBy("conv_id").agg(F.array_join(F.transform(each, lambda x: x["context"]), "").alias("context"))
    rows = turns.filter("turn = 0").select("conv_id", "text").join(context, "conv_id", "left")
    filled = prompt.filled(prompt.FRAME, F.col("context"), F.col("text"))
    return rows.select("conv_id", F.when(prompt.all_valid(F.coalesce("context", F.lit("")), [prompt.not_empty]), filled).otherwise(prompt.NO_CONTEXT).alias("prompt"))


_CLASS = "package nation{n};\n\n{import}public class Supplier{s} extends {base} {\n    private Supplier{s} twin;\n\n    /** Names {s}. */\n    public void name({base} other, int more) {\n        run();\n    }\n\n    int count() {\n        return {s};\n    }\n}\n"
_BROKEN = "class Broken{r} { void f( }\n"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Java file for each supplier, in its nation's package, whose class extends the next supplier's; and a broken one for each region."""
    supplier, region = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "region")
    following = supplier.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_nationkey").alias("m"))
    rows = supplier.join(following, "s_suppkey", "left")
    key, nation, base = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"), F.concat(F.lit("Supplier"), (F.col("s_suppkey") + 1).cast("string"))
    imported = F.concat(F.lit("import nation"), F.col("m").cast("string"), F.lit("."), base, F.lit(";\n\n"))
    text = F.lit(_CLASS)
    for name, value in (("{import}", F.coalesce(imported, F.lit(""))), ("{base}", F.when(F.col("m").isNull(), "Object").otherwise(base)), ("{n}", nation), ("{s}", key)):
        text = F.replace(text, F.lit(name), value)
    files = rows.select(F.concat(F.lit("src/nation"), nation, F.lit("/Supplier"), key, F.lit(".java")).alias("path"), text.alias("content"))
    broken = F.col("r_regionkey").cast("string")
    return files.union(region.select(F.concat(F.lit("src/region"), broken, F.lit("/Broken.java")), F.replace(F.lit(_BROKEN), F.lit("{r}"), broken)))


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(java.scan(_sources(spark, sf_dir)))


def java_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java.code_chunks(_scanned(spark, sf_dir)).select("id", "parent", "part", "total", F.col("metadata")[SECTION_KEY].alias("section"), "content", "fromLine", "toLine")


def java_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dependency_edges(java.raw_edges(_scanned(spark, sf_dir)), "nation")


def java_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full names of each simple name, and all imports."""
    rows = _scanned(spark, sf_dir)
    names = graph.symbol_table(java.symbols(rows)).select("name", F.array_join("fqns", ",").alias("fqns"))
    return names.unionByName(java.imports(rows).select(F.col("file").alias("name"), F.col("import").alias("fqns")))


def java_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java.errors(_scanned(spark, sf_dir))


def undocumented_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java.undocumented_methods(_scanned(spark, sf_dir))


def method_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of all methods: each class with its report, the methods' docs and bodies in place of their signatures, in the budget."""
    scanned = _scanned(spark, sf_dir)
    chunks = checkpointed(java.code_chunks(scanned).unionByName(graph.dependency_chunks(graph.dependency_edges(java.raw_edges(scanned), "nation"))))
    return prompt.context_of(chunks.filter(F.col("metadata")[SECTION_KEY] == "method").select("id"), chunks)


def documented_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with a comment put before each method that has none, by its line."""
    files = _sources(spark, sf_dir)
    missing = java.undocumented_methods(checkpointed(java.scan(files)))
    comments = missing.select("file", "line", F.concat(F.lit("    /** About "), F.col("signature"), F.lit(" */")).alias("comment"))
    return java.documented(files, comments)


QUERIES = {f.__name__: f for f in (dependency_edges, dependencies_of, used_by, dependency_report, dependency_report_chunks, resolve_names, ancestor_closure, tree_roots, tree_rank, forest_order, forest_root_list, context_budget, conversation_prompt, java_chunks, java_dependencies, java_symbols, java_errors, undocumented_methods, method_fold, documented_sources)}

_EDGES = "e AS (SELECT DISTINCT 'segment.' || c_mktsegment AS source, 'nation' || c_nationkey AS target FROM customer UNION SELECT 'nation' || n_nationkey, 'region' || n_regionkey FROM nation)"
_REPORT = f"""{_EDGES}, f AS (SELECT source, list_sort(list(target)) AS t FROM e GROUP BY source), b AS (SELECT target, list_sort(list(source)) AS s FROM e GROUP BY target),
r AS (SELECT f.source, 'Die Klasse ' || f.source || ' benutzt die folgenden Klassen:' || chr(10) || array_to_string(list_transform(t, lambda x: '  * ' || x || chr(10)), '') || 'Die folgenden Klassen verweisen auf die Klasse ' || f.source || ':' || chr(10) || coalesce(array_to_string(list_transform(s, lambda x: '  * ' || x || chr(10)), ''), '') AS content FROM f LEFT JOIN b ON b.target = f.source)"""
_NODES = """nodes AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, 'classFrame' AS section FROM region WHERE r_regionkey <> 3
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'imports' FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'methodDoc' FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'method' ELSE 'other' END FROM orders),
up AS (SELECT 'o' || o_orderkey AS hit_id, 'o' || o_orderkey AS node_id, 0 AS depth, 'o' || o_orderkey AS line FROM orders WHERE o_totalprice > 400000
UNION ALL SELECT up.hit_id, p.id, up.depth + 1, up.line FROM up JOIN nodes n ON n.id = up.node_id JOIN nodes p ON p.id = n.parent)"""
_CLASSES = """c AS (SELECT 'nation' || a.s_nationkey || '.Supplier' || a.s_suppkey AS fqn, 'Supplier' || a.s_suppkey AS name, a.s_suppkey AS s, a.s_nationkey AS n, 'src/nation' || a.s_nationkey || '/Supplier' || a.s_suppkey || '.java' AS file,
  b.s_suppkey IS NOT NULL AS whole, 'nation' || b.s_nationkey || '.Supplier' || b.s_suppkey AS above, CASE WHEN b.s_suppkey IS NULL THEN 'Object' ELSE 'Supplier' || b.s_suppkey END AS base, CASE WHEN b.s_suppkey IS NULL THEN 0 ELSE 2 END AS more,
  CASE WHEN b.s_suppkey IS NULL THEN '' ELSE 'import nation' || b.s_nationkey || '.Supplier' || b.s_suppkey || ';' || chr(10) || chr(10) END AS block FROM supplier a LEFT JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1),
m AS (SELECT *, 'void name(' || base || ', int)' AS first_name, '    /** Names ' || s || '. */' || chr(10) AS doc, '    public void name(' || base || ' other, int more) {' || chr(10) || '        run();' || chr(10) || '    }' || chr(10) AS first_body, '    int count() {' || chr(10) || '        return ' || s || ';' || chr(10) || '    }' || chr(10) AS second_body,
  'package nation' || n || ';' || chr(10) || block || 'public class ' || name || ' extends ' || base || ' {' || chr(10) || '    private ' || name || ' twin;' || chr(10) || chr(10) AS head FROM c)"""
_ROOTS = "roots AS (SELECT hit_id, arg_max(node_id, depth) AS root_id FROM up GROUP BY hit_id)"
ORACLE_SQL = {
    "dependency_edges": f"WITH {_EDGES} SELECT source, target FROM e WHERE starts_with(target, '{PREFIX}')",
    "dependencies_of": f"WITH {_EDGES} SELECT source, string_agg(target, ',' ORDER BY target) AS targets FROM e GROUP BY source",
    "used_by": f"WITH {_EDGES} SELECT target, string_agg(source, ',' ORDER BY source) AS sources FROM e GROUP BY target",
    "dependency_report": f"WITH {_REPORT} SELECT source, content FROM r",
    "dependency_report_chunks": f"""WITH {_REPORT},
v AS (SELECT *, length(content) AS len, CASE WHEN length(content) < 199 THEN 1 ELSE CAST(ceil(length(content) / 179.0) AS INT) END AS total FROM r),
x AS (SELECT *, CAST(unnest(range(0, total)) AS INT) AS part FROM v)
SELECT source || '.dependencies' AS id, source AS parent, part, total, CAST(length(chr(10) || substr(content, 1 + part * 179, 199)) AS INT) AS size, CASE WHEN len < 199 THEN 0 ELSE 20 END AS overlap, chr(10) || substr(content, 1 + part * 179, 199) AS content FROM x""",
    "resolve_names": """
WITH p AS (SELECT DISTINCT p_brand, p_type FROM part), s AS (SELECT p_type AS name, p_brand AS home, p_brand || '.' || p_type AS fqn FROM p WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#4') AND p_type <> 'ECONOMY'),
i(file, import, whole) AS (VALUES ('Brand#5', 'Brand#4.SMALL', false), ('Brand#5', 'Brand#2', true), ('Brand#6', 'Brand#2', true), ('Brand#6', 'Brand#4', true), ('Brand#1', 'Brand#2.PROMO', false)),
u AS (SELECT p_brand AS file, CASE WHEN p_brand <> 'Brand#3' THEN p_brand END AS package, p_type AS name FROM p),
c AS (SELECT u.*, s.fqn, CASE WHEN EXISTS (SELECT 1 FROM i WHERE i.file = u.file AND NOT i.whole AND i.import = s.fqn) THEN 0 WHEN s.fqn = u.package || '.' || u.name THEN 1 WHEN EXISTS (SELECT 1 FROM i WHERE i.file = u.file AND i.whole AND i.import = s.home) THEN 2 END AS rank FROM u LEFT JOIN s ON s.name = u.name)
SELECT file, package, name, CASE WHEN package IS NULL THEN name WHEN count(fqn) = 0 THEN '' ELSE coalesce(first(fqn ORDER BY rank, fqn) FILTER (rank IS NOT NULL), name) END AS fqn FROM c GROUP BY file, package, name""",
    "ancestor_closure": f"WITH RECURSIVE {_NODES} SELECT hit_id, node_id, depth FROM up",
    "tree_roots": f"WITH RECURSIVE {_NODES}, {_ROOTS} SELECT hit_id, root_id FROM roots",
    "tree_rank": f"WITH RECURSIVE {_NODES}, {_ROOTS} SELECT root_id, CAST(sum(CASE section WHEN 'classFrame' THEN 2 WHEN 'method' THEN 5 WHEN 'methodDoc' THEN 5 WHEN 'imports' THEN 1 ELSE 0 END) AS BIGINT) AS rank, count(*) AS hits FROM roots JOIN nodes ON nodes.id = roots.hit_id GROUP BY root_id",
    "forest_order": f"WITH RECURSIVE {_NODES}, {_ROOTS}, paths AS (SELECT a.hit_id, a.node_id, string_agg(b.node_id, '>' ORDER BY b.depth DESC) AS path FROM up a JOIN up b ON a.hit_id = b.hit_id AND b.depth >= a.depth GROUP BY a.hit_id, a.node_id) SELECT DISTINCT root_id, node_id, path FROM paths JOIN roots USING (hit_id)",
    "forest_root_list": f"WITH RECURSIVE {_NODES}, {_ROOTS} SELECT DISTINCT root_id FROM roots",
    "java_chunks": f"""WITH {_CLASSES}
SELECT id, parent, 0 AS part, 1 AS total, section, content, CAST(l1 AS VARCHAR) AS "fromLine", CAST(l2 AS VARCHAR) AS "toLine" FROM (
SELECT fqn AS id, NULL AS parent, 'classFrame' AS section, chr(10) || head || '    ' || first_name || chr(10) || '    int count()' || chr(10) || '}}' || chr(10) AS content, 2 + more AS l1, 14 + more AS l2 FROM m
UNION ALL SELECT fqn || '.imports', fqn, 'imports', chr(10) || block, CASE WHEN whole THEN 2 ELSE 0 END, CASE WHEN whole THEN 3 ELSE 0 END FROM m
UNION ALL SELECT fqn || '.' || first_name, fqn, 'method', '//Methode ' || first_name || ' in class ' || fqn || ':' || chr(10) || first_body, 6 + more, 9 + more FROM m
UNION ALL SELECT fqn || '.' || first_name || '.javadoc', fqn || '.' || first_name, 'methodDoc', '//Methode ' || first_name || ' in class ' || fqn || ':' || chr(10) || doc, 5 + more, 6 + more FROM m
UNION ALL SELECT fqn || '.int count()', fqn, 'method', '//Methode int count() in class ' || fqn || ':' || chr(10) || second_body, 10 + more, 13 + more FROM m)""",
    "java_dependencies": f"WITH {_CLASSES} SELECT fqn AS source, fqn AS target FROM c UNION SELECT fqn, above FROM c WHERE whole",
    "java_symbols": f"WITH {_CLASSES} SELECT name, fqn AS fqns FROM c UNION ALL SELECT file, above FROM c WHERE whole",
    "java_errors": "SELECT 'src/region' || r_regionkey || '/Broken.java' AS file, 'unmatched { at character ' || (13 + length(CAST(r_regionkey AS VARCHAR))) AS error FROM region",
    "undocumented_methods": f"WITH {_CLASSES} SELECT fqn || '.int count()' AS id, fqn AS class, 'int count()' AS signature, file, 10 + more AS line FROM c",
    "method_fold": f"""WITH {_CLASSES},
u AS (SELECT above AS target, list(fqn) AS by FROM c WHERE whole GROUP BY above),
t AS (SELECT fqn, chr(10) || chr(10) || '## Hier ein Rumpf der Klasse ' || fqn || ':' || chr(10) || chr(10) || '```java' || chr(10) || head || '    ' || doc || first_body || chr(10) || '    ' || second_body || chr(10) || '}}' || chr(10) || chr(10) || '```' || chr(10)
  || chr(10) || chr(10) || '### Hier noch Infos zu den Dependencies innerhalb des Projekts:' || chr(10) || chr(10) || 'Die Klasse ' || fqn || ' benutzt die folgenden Klassen:' || chr(10)
  || array_to_string(list_transform(list_sort(CASE WHEN whole THEN [fqn, above] ELSE [fqn] END), lambda x: '  * ' || x || chr(10)), '') || 'Die folgenden Klassen verweisen auf die Klasse ' || fqn || ':' || chr(10)
  || array_to_string(list_transform(list_sort(list_concat([fqn], coalesce(u.by, []))), lambda x: '  * ' || x || chr(10)), '') AS context FROM m LEFT JOIN u ON u.target = m.fqn),
k AS (SELECT *, coalesce(sum(length(context)) OVER (ORDER BY fqn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT string_agg(context, '' ORDER BY fqn) AS context, count(*) AS trees FROM k WHERE before <= 50000""",
    "documented_sources": f"""WITH {_CLASSES} SELECT file AS path, 'package nation' || n || ';' || chr(10) || chr(10) || block || 'public class ' || name || ' extends ' || base || ' {{' || chr(10) || '    private ' || name || ' twin;' || chr(10) || chr(10) || doc || first_body || chr(10)
  || '    /** About int count() */' || chr(10) || second_body || '}}' || chr(10) AS content FROM m""",
    "context_budget": "SELECT conv_id, turn FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) WHERE before <= 900",
    "conversation_prompt": f"""
WITH k AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations WHERE turn > 0),
c AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS context FROM k WHERE before <= 2000 GROUP BY conv_id)
SELECT q.conv_id, CASE WHEN length(coalesce(context, '')) > 0 THEN 'KONTEXT AUS DEN PROJEKT-MODULEN:' || chr(10) || context || chr(10) || chr(10) || 'FRAGE: ' || q.text || chr(10) || chr(10) ELSE '{prompt.NO_CONTEXT}' END AS prompt FROM conversations q LEFT JOIN c USING (conv_id) WHERE q.turn = 0""",
}
