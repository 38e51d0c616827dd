"""Queries on stores of vectors and chunks, and on streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import has_text
from ..functions.split import combine, split_content
from ..operators import prompt, retrieval
from ..operators.chunk_maps import chunk_columns, from_segments, to_segments
from ..operators.numbering import shared_folder
from ..operators.store import ChunkStore
from ..operators.vector_search import VectorStore
from ..registry import Registry, chunk_folder, update_store
from ..schema import SECTION_KEY
from ..sources import prompt_streams
from ..sources.chunk_table import save
from ..sources.files import text_lines
from ..sources.jsonl import decode, load_by_id, to_lines, unwritten, write_sources
from ..sources.snapshots import FolderLog
from ..streaming import streams
from ..table_functions import FileChunkers
from .common import CHUNKS_SQL, document_chunks, table

DIGITS = 6
QUESTION = "Was ist ein Vektor?"
#: Characters of a context, so that the budget ends some.
SMALL_BUDGET = 700


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _queries(vectors: DataFrame) -> DataFrame:
    """Every hundredth vector is a stated query."""
    return vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def similar_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    query = vectors.filter("vec_id = 0").first()["embedding"]
    return retrieval.similar(vectors, query, 10, 0.6, key="vec_id", digits=DIGITS).select("vec_id", "score")


def similar_top_k_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return retrieval.similar_per_query(vectors, _queries(vectors), 8, 0.55, key="vec_id", digits=DIGITS)


def relaxation_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    steps = retrieval.ladder(*retrieval.ASK_START)
    scored = retrieval.similar_per_query(vectors, _queries(vectors), max(k for _, k, _ in steps), steps[-1][2], key="vec_id", digits=DIGITS)
    return retrieval.first_valid_level(scored, retrieval.ASK_START, least_hits=5)


def ladder_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The searches that each conversation may take: odd ones start as questions do, even ones as contexts do."""
    rows = [("ask", *x) for x in retrieval.ladder(*retrieval.ASK_START)] + [("context", *x) for x in retrieval.ladder(*retrieval.CONTEXT_START)]
    steps = spark.createDataFrame(rows, "start string, level int, max_result int, min_score double")
    asked = table(spark, sf_dir, "conversations").filter("turn = 0").select("conv_id", F.when(F.col("conv_id") % 2 == 1, "ask").otherwise("context").alias("start"))
    return asked.join(F.broadcast(steps), "start")


def embed_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents that have no label, labelled ones being stored."""
    stored = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("id"))
    return retrieval.new_chunks(document_chunks(spark, sf_dir), stored).select("id", "part", "size")


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retrieval.embedded(document_chunks(spark, sf_dir).filter(has_text(F.col("content"))), retrieval.hashing_embedder(16))
    return rows.select("id", "part", F.size("embedding").alias("dimension"), F.col("embed_error").isNull().alias("ok"))


def find_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.find_by_id(document_chunks(spark, sf_dir), "doc7").select("id", "part", "size")


def find_by_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.find_by_metadata(document_chunks(spark, sf_dir), {"lang": "en", "source": "src1"}).select("id", "part", "size")


def _stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of ``documents``, cut once, as a table in buckets."""
    return save(document_chunks(spark, sf_dir), f"chunks_{uuid.uuid4().hex}", f"{_folders(spark)}/chunks")


def complete_partial_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _stored_chunks(spark, sf_dir)
    hits = chunks.filter("part = 1 and size < 700")
    return retrieval.complete_hits(hits, chunks).select("id", "part", "total")


def union_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _stored_chunks(spark, sf_dir)
    both = retrieval.with_prefetched(chunks.filter("part = 0"), chunks.filter("total > 1"))
    return both.select("id", "part", "size")


def stored_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of a stored table, put together bucket by bucket."""
    return combine(_stored_chunks(spark, sf_dir)).select("id", "file", "size", F.md5("content").alias("content_md5"))


def _folders(spark: SparkSession) -> str:
    """A new folder in the shared place of checkpoints."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def incremental_embed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk lines through a stream into a store, twice; the second run finds nothing new."""
    folder = _folders(spark)
    to_lines(document_chunks(spark, sf_dir)).write.text(f"{folder}/lines")
    store = ChunkStore(spark, f"{folder}/store")
    for run in (1, 2):
        streams.embed_incrementally(streams.chunk_lines(spark, f"{folder}/lines"), store, retrieval.hashing_embedder(16), f"{folder}/state{run}").awaitTermination()
    return store.read().select("id", "part", F.md5("content").alias("content_md5"))


def prompt_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' turns as a stream of prompts, each with the length of its enriched form."""
    folder = _folders(spark)
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.regexp_replace("text", r"\s+", " ").alias("value"))
    turns.write.text(f"{folder}/prompts")
    lines = spark.readStream.text(f"{folder}/prompts")
    kept = streams.prompts(lines).select("value", F.length("value").alias("chars"))
    kept.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("value string, chars int").parquet(f"{folder}/out")


def _code_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a stored chunk, eight to a class: the class, two methods, a doc of the second, a report, imports, another class and a chunk of no section."""
    kind, base = F.col("vec_id") % 8, F.col("vec_id") - F.col("vec_id") % 8
    own, n = F.concat(F.lit("vec"), base.cast("string")), F.col("vec_id").cast("string")

    def chosen(*values):
        out = F.when(kind == 0, values[0])
        for k, v in enumerate(values[1:], 1):
            out = out.when(kind == k, v)
        return out

    def of_class(name):
        return F.concat(own, F.lit(name))

    lone, none = F.concat(F.lit("vec"), n), F.lit(None).cast("string")
    ids = chosen(own, of_class(".m1()"), of_class(".m2()"), of_class(".m2().javadoc"), of_class(".dependencies"), of_class(".imports"), lone, lone)
    parents = chosen(none, own, own, of_class(".m2()"), own, own, none, none)
    sections = chosen(*map(F.lit, ("classFrame", "method", "method", "methodDoc", "dependenciesInfo", "imports", "classFrame", "unknown")))
    texts = chosen(*(F.concat(F.lit(f"\n{a}"), n, F.lit(b)) for a, b in (("Vektor ", " mit m1() und m2()"), ("Rumpf ", ""), ("Rumpf m2() ", ""), ("/** Doku ", " */ "), ("Bericht ", ""), ("import ", ""), ("Allein ", ""), ("Rest ", ""))))
    given = {"part": F.lit(0), "total": F.lit(1), "overlap": F.lit(0), "size": F.length(texts), "content": texts, "metadata": F.create_map(F.lit(SECTION_KEY), sections)}
    return table(spark, sf_dir, "embeddings").select(*chunk_columns(id=ids, parent=parents, **given), "embedding")


def questions_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a question, whose vector is a stored one: all enriched together, from classes with a certain word, in a small budget."""
    turns, vectors = table(spark, sf_dir, "conversations").filter("role = 'user'"), _vectors(spark, sf_dir)
    total = vectors.agg(F.max("vec_id")).first()[0] + 1
    asked = turns.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"), F.col("text").alias("question"), F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(total)).alias("vec_id"))
    told = prompt.enrich_many(asked.join(vectors, "vec_id"), _code_vectors(spark, sf_dir), validators=[prompt.not_empty, prompt.mentions("Vektor")], digits=DIGITS, budget=SMALL_BUDGET)
    return told.select("question_id", F.md5("prompt").alias("prompt_md5"), "level", "trees")


def _axis_of_length(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: the axis that a text's length names."""
    return [[float(len(t) % 64 == k) for k in range(64)] for t in texts]


def answered_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' turns as a stream of prompts, each enriched with what is found for it."""
    folder = _folders(spark)
    table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.regexp_replace("text", r"\s+", " ").alias("value")).write.text(f"{folder}/prompts")
    lines = spark.readStream.text(f"{folder}/prompts")
    streams.enrich_batches(lines, _code_vectors(spark, sf_dir), _axis_of_length, f"{folder}/out", f"{folder}/state", digits=DIGITS, budget=SMALL_BUDGET).awaitTermination()
    rows = spark.read.schema("question string, prompt string, level int, trees long").parquet(f"{folder}/out")
    return rows.select("question", F.md5("prompt").alias("prompt_md5"), "level", "trees")


def clustered_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``similar_top_k_per_query`` from a store of clusters, of which only those folders are read that can hold them."""
    store = VectorStore(spark, f"{_folders(spark)}/vectors", "vec_id")
    vectors = _vectors(spark, sf_dir)
    store.create(vectors.filter("vec_id % 3 > 0"))
    store.add(vectors.filter("vec_id % 3 = 0"))
    return store.search(_queries(vectors), 8, 0.55, DIGITS)


def _vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a stored chunk: even ones are classes, odd ones methods of the class before."""
    vectors = table(spark, sf_dir, "embeddings")
    key, method = F.col("vec_id").cast("string"), F.col("vec_id") % 2 == 1
    own_class = F.concat(F.lit("vec"), (F.col("vec_id") - F.col("vec_id") % 2).cast("string"))
    text = F.when(method, F.concat(F.lit("\nRumpf "), key)).otherwise(F.concat(F.lit("\nVektor "), key, F.lit(" mit m"), (F.col("vec_id") + 1).cast("string"), F.lit("()")))
    section = F.create_map(F.lit(SECTION_KEY), F.when(method, "method").otherwise("classFrame"))
    given = {"part": F.lit(0), "total": F.lit(1), "overlap": F.lit(0), "size": F.length(text), "content": text, "metadata": section}
    return vectors.select(*chunk_columns(id=F.when(method, F.concat(own_class, F.lit(".m"), key, F.lit("()"))).otherwise(own_class), parent=F.when(method, own_class), **given), "embedding")


def question_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question whose vector is the first one: search, ladder, trees, ranks, contexts and prompt; and what a chat model that echoes answers."""
    store = _vector_chunks(spark, sf_dir)
    vector = store.filter("id = 'vec0'").first()["embedding"]
    asked = prompt.enrich(spark, store, QUESTION, lambda texts: [vector])
    answered = prompt.ask(spark, store, QUESTION, lambda texts: [vector], chat=lambda text: text, prefetched=store.filter("id = 'vec2'"))
    return spark.createDataFrame([("context", asked), ("ask", answered), ("blank", prompt.enrich(spark, store, " ", lambda texts: [vector]))], "kind string, prompt string")


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """The documents as files of a new folder, in their source's folder, their ending by language."""
    root = f"{_folders(spark)}/project"
    write_sources(table(spark, sf_dir, "documents").select(_file_path().alias("path"), F.col("text").alias("content")), root)
    return root


def _file_path():
    ending = F.when(F.col("lang") == "en", ".xml").when(F.col("lang") == "de", ".html").when(F.col("lang") == "fr", ".png").otherwise(".txt")
    return F.concat(F.lit("src/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ending)


def folder_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder that no veto and no earlier run keeps out, cut by every registered chunker, and what a step after them adds."""
    root = _folder(spark, sf_dir)
    own = Registry()
    own.veto(lambda path, length: path.contains("/src1/"))

    @own.chunker("XML", "HTML")
    def parts(files: DataFrame) -> DataFrame:
        cut = split_content(files.select("path", F.col("content").alias("text")), "text", 1300, 100)
        given = {c: F.col(c) for c in ("part", "total", "size", "overlap", "fromLine", "toLine", "content")}
        return cut.select(*chunk_columns(id=F.regexp_extract("path", "[^/]+$", 0), mimeType=F.lit("parts"), **given))

    @own.chunker("HTML")
    class Whole:
        def __call__(self, files: DataFrame) -> DataFrame:
            return files.select(*chunk_columns(id=F.regexp_extract("path", "[^/]+$", 0), mimeType=F.lit("whole"), part=F.lit(0), total=F.lit(1), size=F.length("content"), overlap=F.lit(0), content=F.col("content")))

    own.post_step(lambda: table(spark, sf_dir, "region").select(*chunk_columns(id=F.col("r_name"), mimeType=F.lit("after"), part=F.lit(0), total=F.lit(1), size=F.lit(0), overlap=F.lit(0), content=F.lit(""))))
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    qualified = spark._jvm.org.apache.hadoop.fs.Path(root).toString()
    done = labelled.select(F.concat(F.lit(f"{qualified}/"), _file_path()).alias("path"))
    chunks = chunk_folder(spark, root, own, white_list="xml,html,txt,png", done=done)
    return chunks.select("id", F.col("mimeType").alias("kind"), "part", "total", "size", F.md5("content").alias("content_md5"))


def unvetoed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder without standard vetoes, cut by the chunkers of two registries, with what listeners before them have seen."""
    root, one, two, seen = _folder(spark, sf_dir), Registry(), Registry(), {}
    one.pre_step(lambda files: seen.update(kept=files.count()))
    two.scan_step(lambda files: seen.update(all=files.count()))
    two.veto(lambda path, length: path.contains("/src2/"))

    def whole(kind: str):
        return lambda files: files.select(*chunk_columns(id=F.regexp_extract("path", "[^/]+$", 0), mimeType=F.lit(kind), part=F.lit(0), total=F.lit(1), overlap=F.lit(0), content=F.col("content")))

    one.chunker("UNKNOWN")(whole("unknown"))
    two.chunker("XML", "UNKNOWN")(whole("second"))
    chunks = chunk_folder(spark, root, one.merged(two), standard=False)
    return chunks.select("id", F.col("mimeType").alias("kind"), F.md5("content").alias("content_md5"), F.lit(seen["kept"]).cast("long").alias("kept"), F.lit(seen["all"]).cast("long").alias("seen"))


def sql_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files, cut by a table function of SQL."""
    own, view = FileChunkers(), f"files_{uuid.uuid4().hex}"

    @own.add("XML", "HTML")
    def lines(path: str, content: str):
        for k, line in enumerate(content.split("\n")):
            yield {"id": path, "part": k, "content": line}

    own.register(spark, "chunk_lines")
    table(spark, sf_dir, "documents").select(_file_path().alias("path"), F.col("text").alias("content")).createOrReplaceTempView(view)
    return spark.sql(f"SELECT id, part, size, md5(content) AS content_md5 FROM chunk_lines(TABLE({view}))")


def folder_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of a folder: every fifth file goes, another fifth changes, and the labelled ones are new. The store follows by reading what differs."""
    docs, folder = table(spark, sf_dir, "documents"), _folders(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    files = docs.select("doc_id", _file_path().alias("path"), F.col("text").alias("content")).filter("length(content) > 0")
    write_sources(files.join(labels, "doc_id", "left_anti").union(files.join(labels, "doc_id", "left_semi").filter("doc_id % 5 = 0")), f"{folder}/first")
    write_sources(files.filter("doc_id % 5 <> 0").withColumn("content", F.when(F.col("doc_id") % 5 == 1, F.concat("content", F.lit("\nmore"))).otherwise(F.col("content"))), f"{folder}/second")
    own = Registry()

    @own.chunker("XML", "HTML", "UNKNOWN")
    def parts(files: DataFrame) -> DataFrame:
        cut = split_content(files.select("path", F.col("content").alias("text")), "text", 1300, 100)
        given = {c: F.col(c) for c in ("part", "total", "size", "overlap", "fromLine", "toLine", "content")}
        return cut.select(*chunk_columns(id=F.col("path"), file=F.col("path"), **given))

    log, store = FolderLog(spark, f"{folder}/log"), ChunkStore(spark, f"{folder}/store")
    for state in ("first", "second"):
        found = update_store(spark, f"{folder}/{state}", own, log, store, retrieval.hashing_embedder(8))
    chunks = store.read().groupBy(F.col("file").alias("path")).agg(F.count("*").alias("parts"), F.sum(F.length("content")).alias("chars"))
    return found.select("path", "digest", "change").join(chunks, "path", "left").fillna(0, ["parts", "chars"])


def lines_to_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk lines of a folder, loaded by id, through segments into a store that was filled and reset before; and one unit looked up by its id."""
    folder = _folders(spark)
    to_lines(document_chunks(spark, sf_dir)).write.text(f"{folder}/lines")
    chunks = from_segments(to_segments(load_by_id(spark, f"{folder}/lines")))
    store = ChunkStore(spark, f"{folder}/store")
    store.add(decode(text_lines(spark, f"{folder}/lines")).filter("total > 1"), retrieval.hashing_embedder(8))
    store.reset()
    store.add(chunks.filter(F.col("metadata")["lang"] == "de"), retrieval.hashing_embedder(8))
    store.add(chunks.filter(F.col("metadata")["lang"].isin("de", "fr")), retrieval.hashing_embedder(8))
    least = store.read().agg(F.min("id")).first()[0]
    rows = store.read().select(F.lit("all").alias("kind"), "id", "part", F.md5("content").alias("content_md5"))
    return rows if least is None else rows.unionByName(store.find_by_id(least).select(F.lit("one").alias("kind"), "id", "part", F.md5("content").alias("content_md5")))


def prompt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' turns as files of prompts, through the source of prompts and the sink of events; silent answers beside them."""
    folder = _folders(spark)
    prompt_streams.register(spark)
    table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.regexp_replace("text", r"\s+", " ").alias("value")).write.text(f"{folder}/prompts")
    lines = spark.readStream.format("prompts").option("mostBytes", 1 << 30).load(f"{folder}/prompts")
    asked = streams.prompts(lines).select("value", prompt.answered(F.col("value"), prompt.silent_chat).alias("answer"), F.length("value").alias("chars"))
    asked.writeStream.format("prompt_events").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return prompt_streams.read_events(spark, f"{folder}/out", "value string, answer string, chars int").drop("batch")


def unwritten_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents' files, those whose target does not exist after the labelled ones are written."""
    docs, root = table(spark, sf_dir, "documents"), f"{_folders(spark)}/out"
    rows = docs.select("doc_id", _file_path().alias("path"), F.col("text").alias("content"))
    labelled = rows.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    written = write_sources(labelled, root)
    again = write_sources(labelled, root)
    return unwritten(rows, root).select("doc_id", "path", F.lit(int(again)).alias("again"), F.lit(int(written)).alias("written"))


QUERIES = {f.__name__: f for f in (similar_top_k, similar_top_k_per_query, relaxation_ladder, ladder_steps, embed_anti_join, embedded_chunks, find_by_id, find_by_metadata, complete_partial_hits, union_prefetch, stored_units, incremental_embed_stream, prompt_stream, answered_stream, questions_prompts, clustered_top_k, unvetoed_chunks, sql_chunks, folder_states, lines_to_store, prompt_events, question_prompt, folder_chunks, unwritten_sources)}

_PAIRS = f"p AS (SELECT q.vec_id AS query_id, v.vec_id, round((1 + list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / 2, {DIGITS}) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 100 = 0)"
_LADDER = "l(level, max_result, min_score) AS (VALUES " + ", ".join(f"({a}, {b}, CAST({c!r} AS DOUBLE))" for a, b, c in retrieval.ladder(*retrieval.ASK_START)) + ")"
_QUOTED = {k: v.replace("'", "''") for k, v in {"role": prompt.ROLE, "why": prompt.WHAT_AND_WHY, "none": prompt.NO_CONTEXT}.items()}
_FOUND = "s AS (SELECT v.vec_id, v.vec_id - v.vec_id % 2 AS c, (1 + list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / 2 AS score, CASE WHEN v.vec_id % 2 = 1 THEN 'vec' || (v.vec_id - 1) || '.m' || v.vec_id || '()' ELSE 'vec' || v.vec_id END AS id FROM embeddings v JOIN embeddings q ON q.vec_id = 0)"


def _prompt_sql(kind: str, k: int, least: float, more: str, head: str) -> str:
    """The prompt of one search: the hits, one context for each class, by falling rank, then name."""
    return f"""(WITH h AS (SELECT c, vec_id FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT {k}) WHERE score >= {least} {more}),
t AS (SELECT c, sum(CASE WHEN vec_id = c THEN 2 ELSE 5 END) AS rank, bool_or(vec_id <> c) AS body FROM h GROUP BY c)
SELECT '{kind}' AS kind, '{head}KONTEXT AUS DEN PROJEKT-MODULEN:' || chr(10) || string_agg(chr(10) || chr(10) || '## Hier ein Rumpf der Klasse vec' || c || ':' || chr(10) || chr(10) || '```java' || chr(10) || 'Vektor ' || c || ' mit ' || CASE WHEN body THEN 'Rumpf ' || (c + 1) ELSE 'm' || (c + 1) || '()' END || chr(10) || '```' || chr(10), '' ORDER BY rank DESC, 'vec' || c) || chr(10) || chr(10) || 'FRAGE: {QUESTION}' || chr(10) || chr(10) AS prompt FROM t)"""


_TURNS = r"a AS (SELECT row_number() OVER () AS q, value AS name, value AS text, list_transform(range(64), lambda k: CAST(length(value) % 64 = k AS DOUBLE)) AS v FROM (SELECT regexp_replace(text, '\s+', ' ', 'g') AS value FROM conversations WHERE role = 'user' AND regexp_matches(text, '\S') AND lower(trim(text)) <> 'exit'))"
_ASKED = "a AS (SELECT row_number() OVER () AS q, conv_id || '/' || turn AS name, text, CAST(embedding AS DOUBLE[]) AS v FROM conversations JOIN embeddings ON vec_id = (conv_id * 7 + turn) % (SELECT max(vec_id) + 1 FROM embeddings) WHERE role = 'user')"


def _prompts_sql(questions: str, must: str = "") -> str:
    """The prompts of many questions over the classes of ``_code_vectors``: the first level of the ladder that finds a tree of rank over 0."""
    steps = ", ".join(f"({a}, {b}, CAST({c!r} AS DOUBLE))" for a, b, c in retrieval.ladder(*retrieval.CONTEXT_START))
    name = "question" if questions is _TURNS else "question_id"

    def before(text: str, mark: str, more: str) -> str:
        return f"CASE WHEN instr({text}, '{mark}') > 0 THEN substr({text}, 1, instr({text}, '{mark}') - 1) || {more} || substr({text}, instr({text}, '{mark}')) ELSE {text} END"

    return f"""{questions}, l(level, most, least) AS (VALUES {steps}),
e AS (SELECT vec_id, vec_id % 8 AS k, vec_id - CASE WHEN vec_id % 8 < 6 THEN vec_id % 8 ELSE 0 END AS c, 'vec' || CASE WHEN vec_id % 8 < 6 THEN vec_id - vec_id % 8 ELSE vec_id END || CASE vec_id % 8 WHEN 1 THEN '.m1()' WHEN 2 THEN '.m2()' WHEN 3 THEN '.m2().javadoc' WHEN 4 THEN '.dependencies' WHEN 5 THEN '.imports' ELSE '' END AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.q, e.k, e.c, e.id, round((1 + list_cosine_similarity(e.v, a.v)) / 2, {DIGITS}) AS score FROM a JOIN e ON regexp_matches(a.text, '\\S')),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS nr FROM s),
t AS (SELECT q, level, c, max(k) AS last, sum(CASE k WHEN 0 THEN 2 WHEN 6 THEN 2 WHEN 1 THEN 5 WHEN 2 THEN 5 WHEN 3 THEN 5 WHEN 5 THEN 1 ELSE 0 END) AS rank, bool_or(k = 1) AS m1, bool_or(k IN (2, 3)) AS m2, bool_or(k = 3) AS doc, bool_or(k = 4) AS report FROM r JOIN l ON nr <= most AND score >= least GROUP BY ALL),
b AS (SELECT *, chr(10) || chr(10) || '## Hier ein Rumpf der Klasse vec' || c || ':' || chr(10) || chr(10) || '```java' || chr(10) || CASE WHEN last = 6 THEN 'Allein ' || c ELSE 'Vektor ' || c || ' mit m1() und m2()' END || chr(10) || '```' || chr(10)
  || CASE WHEN c % 8 = 0 AND c + 4 IN (SELECT vec_id FROM e) THEN chr(10) || chr(10) || '### Hier noch Infos zu den Dependencies innerhalb des Projekts:' || chr(10) || chr(10) || 'Bericht ' || (c + 4) ELSE '' END || CASE WHEN report THEN 'Bericht ' || (c + 4) ELSE '' END AS x FROM t WHERE rank > 0 AND last <> 7),
b1 AS (SELECT *, CASE WHEN m1 THEN replace(x, 'm1()', 'Rumpf ' || (c + 1)) ELSE x END AS x1 FROM b),
b2 AS (SELECT *, CASE WHEN m2 AND c + 3 IN (SELECT vec_id FROM e) THEN {before('x1', 'm2()', "'/** Doku ' || (c + 3) || ' */ '")} ELSE x1 END AS x2 FROM b1),
b3 AS (SELECT *, CASE WHEN m2 THEN replace(x2, 'm2()', 'Rumpf m2() ' || (c + 2)) ELSE x2 END AS x3 FROM b2),
b4 AS (SELECT *, CASE WHEN doc THEN {before('x3', 'm2()', "'/** Doku ' || (c + 3) || ' */ '")} ELSE x3 END AS x4 FROM b3),
w AS (SELECT *, coalesce(sum(length(x4)) OVER (PARTITION BY q, level ORDER BY rank DESC, 'vec' || c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM b4 WHERE x4 LIKE '%{must}%'),
o AS (SELECT q, level, string_agg(x4, '' ORDER BY rank DESC, 'vec' || c) AS context, count(*) AS trees FROM w WHERE spent <= {SMALL_BUDGET} GROUP BY q, level),
p AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY q ORDER BY level) = 1)
SELECT a.name AS {name}, md5(CASE WHEN p.q IS NULL THEN '{_QUOTED['none']}' ELSE '{_QUOTED['role']}KONTEXT AUS DEN PROJEKT-MODULEN:' || chr(10) || context || chr(10) || chr(10) || 'FRAGE: ' || a.text || chr(10) || chr(10) END) AS prompt_md5, CAST(level AS INT) AS level, trees FROM a LEFT JOIN p USING (q)"""


_ENDING = "CASE lang WHEN 'en' THEN '.xml' WHEN 'de' THEN '.html' WHEN 'fr' THEN '.png' ELSE '.txt' END"
ORACLE_SQL = {
    "answered_stream": f"""WITH {_prompts_sql(_TURNS)}""",
    "questions_prompts": f"""WITH {_prompts_sql(_ASKED, 'Vektor')}""",
    "question_prompt": f"WITH {_FOUND} SELECT * FROM {_prompt_sql('context', 20, 0.75, '', _QUOTED['role'])} UNION ALL SELECT * FROM {_prompt_sql('ask', 8, 0.85, 'UNION SELECT 2, 2', _QUOTED['role'] + _QUOTED['why'])} UNION ALL SELECT 'blank', '{_QUOTED['none']}'",
    "folder_chunks": f"""WITH {CHUNKS_SQL}, f AS (SELECT * FROM chunks WHERE source <> 'src1' AND lang IN ('en', 'de') AND body <> '' AND doc_id NOT IN (SELECT doc_id FROM labels))
SELECT doc_id || {_ENDING} AS id, 'parts' AS kind, part, total, size, md5(content) AS content_md5 FROM f
UNION ALL SELECT doc_id || '.html', 'whole', 0, 1, CAST(length(coalesce(text, '')) AS INT), md5(coalesce(text, '')) FROM documents WHERE source <> 'src1' AND lang = 'de' AND text <> '' AND doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT r_name, 'after', 0, 1, 0, md5('') FROM region""",
    "unwritten_sources": f"SELECT doc_id, 'src/' || source || '/' || doc_id || {_ENDING} AS path, 0 AS again, CAST((SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS INT) AS written FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "similar_top_k": f"WITH {_PAIRS} SELECT vec_id, score FROM p WHERE query_id = 0 AND score >= 0.6 ORDER BY score DESC, vec_id LIMIT 10",
    "similar_top_k_per_query": f"WITH {_PAIRS} SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p WHERE score >= 0.55 QUALIFY rank <= 8",
    "clustered_top_k": f"WITH {_PAIRS} SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p WHERE score >= 0.55 QUALIFY rank <= 8",
    "relaxation_ladder": f"""WITH {_PAIRS}, {_LADDER}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p),
m AS (SELECT query_id, level, max_result, min_score, count(*) AS hits FROM s JOIN l ON rank <= max_result AND score >= min_score GROUP BY ALL HAVING count(*) >= 5)
SELECT query_id, level, max_result, min_score, hits FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY level) = 1""",
    "ladder_steps": "SELECT c.conv_id, t.* FROM conversations c JOIN (VALUES ('ask', 0, 8, 0.85), ('ask', 1, 10, 0.85), ('ask', 2, 12, 0.85), ('ask', 3, 14, 0.85), ('ask', 4, 16, 0.85), ('ask', 5, 16, CAST(0.7999999999999999 AS DOUBLE)), ('ask', 6, 16, CAST(0.7499999999999999 AS DOUBLE)), ('ask', 7, 16, CAST(0.6999999999999998 AS DOUBLE)), ('ask', 8, 16, CAST(0.6499999999999998 AS DOUBLE)), ('ask', 9, 16, CAST(0.5999999999999998 AS DOUBLE)), ('ask', 10, 16, CAST(0.5499999999999997 AS DOUBLE)), ('context', 0, 20, 0.75), ('context', 1, 20, 0.7), ('context', 2, 20, CAST(0.6499999999999999 AS DOUBLE)), ('context', 3, 20, CAST(0.5999999999999999 AS DOUBLE)), ('context', 4, 20, CAST(0.5499999999999998 AS DOUBLE))) t(start, level, max_result, min_score) ON t.start = CASE WHEN conv_id % 2 = 1 THEN 'ask' ELSE 'context' END WHERE turn = 0",
    "unvetoed_chunks": f"""WITH f AS (SELECT *, doc_id || {_ENDING} AS id FROM documents WHERE text <> ''), k AS (SELECT * FROM f WHERE source <> 'src2'), n AS (SELECT (SELECT count(*) FROM k) AS kept, (SELECT count(*) FROM f) AS seen)
SELECT id, 'unknown' AS kind, md5(text) AS content_md5, kept, seen FROM k, n WHERE lang NOT IN ('en', 'de') UNION ALL SELECT id, 'second', md5(text), kept, seen FROM k, n WHERE lang <> 'de'""",
    "sql_chunks": f"""WITH l AS (SELECT doc_id, source, lang, string_split(coalesce(text, ''), chr(10)) AS l FROM documents WHERE lang IN ('en', 'de')), u AS (SELECT *, unnest(l) AS line, generate_subscripts(l, 1) AS nr FROM l)
SELECT 'src/' || source || '/' || doc_id || {_ENDING} AS id, CAST(nr - 1 AS INT) AS part, CAST(length(line) AS INT) AS size, md5(line) AS content_md5 FROM u""",
    "folder_states": f"""WITH f AS (SELECT doc_id, 'src/' || source || '/' || doc_id || {_ENDING} AS path, lang, doc_id IN (SELECT doc_id FROM labels) AS labelled, text || CASE WHEN doc_id % 5 = 1 THEN chr(10) || 'more' ELSE '' END AS now, text FROM documents WHERE text <> ''),
s AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'removed' WHEN labelled THEN 'added' WHEN doc_id % 5 = 1 THEN 'changed' ELSE 'same' END AS change FROM f),
n AS (SELECT *, length(now) AS len, CASE WHEN change = 'removed' OR lang = 'fr' OR path LIKE '%build%' OR path LIKE '%target%' THEN 0 WHEN length(now) < 1299 THEN 1 ELSE CAST(ceil(length(now) / 1199.0) AS BIGINT) END AS total FROM s),
p AS (SELECT path, sum(length(substr(now, 1 + i * 1199, 1299)) + 1) AS chars, count(*) AS parts FROM (SELECT path, now, unnest(range(0, total)) AS i FROM n) WHERE regexp_matches(substr(now, 1 + i * 1199, 1299), '\\S') GROUP BY path)
SELECT path, sha256(CASE WHEN change = 'removed' THEN text ELSE now END) AS digest, change, coalesce(parts, 0) AS parts, CAST(coalesce(chars, 0) AS BIGINT) AS chars FROM n LEFT JOIN p USING (path)""",
    "lines_to_store": f"""WITH {CHUNKS_SQL}, k AS (SELECT id, part, md5(content) AS content_md5 FROM chunks WHERE lang IN ('de', 'fr') AND regexp_matches(content, '\\S'))
SELECT 'all' AS kind, * FROM k UNION ALL SELECT 'one', * FROM k WHERE id = (SELECT min(id) FROM k)""",
    "prompt_events": r"SELECT regexp_replace(text, '\s+', ' ', 'g') AS value, '' AS answer, CAST(length(regexp_replace(text, '\s+', ' ', 'g')) AS INT) AS chars FROM conversations WHERE role = 'user' AND regexp_matches(text, '\S') AND lower(trim(text)) <> 'exit'",
    "embed_anti_join": f"WITH {CHUNKS_SQL} SELECT id, part, size FROM chunks WHERE regexp_matches(content, '\\S') AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "embedded_chunks": f"WITH {CHUNKS_SQL} SELECT id, part, 16 AS dimension, true AS ok FROM chunks WHERE regexp_matches(content, '\\S')",
    "find_by_id": f"WITH {CHUNKS_SQL} SELECT id, part, size FROM chunks WHERE id = 'doc7'",
    "find_by_metadata": f"WITH {CHUNKS_SQL} SELECT id, part, size FROM chunks WHERE lang = 'en' AND source = 'src1'",
    "complete_partial_hits": f"WITH {CHUNKS_SQL} SELECT id, part, total FROM chunks WHERE id IN (SELECT id FROM chunks WHERE part = 1 AND size < 700)",
    "stored_units": f"WITH {CHUNKS_SQL} SELECT id, file, size, md5(coalesce(text, '')) AS content_md5 FROM chunks JOIN documents USING (doc_id) WHERE part = 0",
    "union_prefetch": f"WITH {CHUNKS_SQL} SELECT id, part, size FROM chunks WHERE part = 0 OR total > 1",
    "incremental_embed_stream": f"WITH {CHUNKS_SQL} SELECT id, part, md5(content) AS content_md5 FROM chunks WHERE regexp_matches(content, '\\S')",
    "prompt_stream": r"SELECT regexp_replace(text, '\s+', ' ', 'g') AS value, CAST(length(regexp_replace(text, '\s+', ' ', 'g')) AS INT) AS chars FROM conversations WHERE role = 'user' AND regexp_matches(text, '\S') AND lower(trim(text)) <> 'exit'",
}
