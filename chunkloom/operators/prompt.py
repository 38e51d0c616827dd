"""Assembly of prompts from trees of chunks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import has_text, insert_before
from ..functions.split import combine
from ..schema import SECTION_KEY
from . import forest, retrieval
from .numbering import checkpointed, until

# The texts of which contexts and prompts consist, and the budget of a context in characters.
BUDGET = 50_000
CLASS_HEADING = "\n\n## Hier ein Rumpf der Klasse {}:\n\n```java\n{}\n```\n"
DEPENDENCY_HEADING = "\n\n### Hier noch Infos zu den Dependencies innerhalb des Projekts:\n\n"
NO_CONTEXT = "Es konnte kein valider Kontext erstellt werden!"
ROLE = (
    "Du bist ein erfahrener Software-Architekt. Beantworte die Frage des Nutzers\n"
    "ausschließlich basierend auf dem unten stehenden Kontext aus seinem Java-Projekt.\n"
    "Wenn du die Antwort nicht im Kontext findest, sage das deutlich.\n\n"
)
WHAT_AND_WHY = (
    "Beantworte zunächst das WAS und dann mit dieser Erklärung das WARUM. Wenn Du das\n"
    "Warum nicht ermitteln kannst beschränke dich auf das was.\n\n"
)
FRAME = "KONTEXT AUS DEN PROJEKT-MODULEN:\n{}\n\nFRAGE: {}\n\n"
DOC_QUESTION = (
    "Du bist eine erfahrener Java-Entwickler und sollst mich bei der Dokumentation meines QuellCodes unterstützen."
    " Ich brauche JavaDoc für die Methode '{}' in der JavaClasse {}."
    " Erstelle die Antwort so, dass Sie als JavaDoc Kommentar verwendet werden kann. Dies beinhaltet deine gesamte Antwort."
    " Also auch die Erklärung, was und warum die Methode was tut. Den Code der Methode sollst Du nicht einbetten."
    " Füge auch keine MarkDown Tags ein."
)
CONTEXT_PROMPT, DOC_PROMPT = ROLE + FRAME, ROLE + WHAT_AND_WHY + FRAME

#: A validator: the column of a context -> condition.
Validator = Callable[[Column], Column]
#: A chat model: prompt -> answer.
Chat = Callable[[str], str]


def filled(template: str, *values: Column) -> Column:
    """The template with its brackets replaced; percent signs and brackets in values stay as they are."""
    pieces = template.split("{}")
    return F.concat(F.lit(pieces[0]), *(x for v, p in zip(values, pieces[1:], strict=True) for x in (v, F.lit(p))))


def silent_chat(prompt: str) -> str:
    """The model of the setting without one: an empty answer."""
    return ""


def answered(text: Column, chat: Chat) -> Column:
    """A chat model's answers to a column of prompts, asked by the executors; null where there is no prompt."""

    @F.pandas_udf("string")
    def ask_each(prompts: pd.Series) -> pd.Series:
        return prompts.map(chat, na_action="ignore")

    return ask_each(text)


def not_empty(context: Column) -> Column:
    return F.length(context) > 0


def mentions(*names: str) -> Validator:
    def check(context: Column) -> Column:
        out = F.lit(False)
        for name in names:
            out = out | context.contains(name)
        return out

    return check


def all_valid(context: Column, validators: list[Validator]) -> Column:
    out = F.lit(True)
    for v in validators:
        out = out & F.coalesce(v(context), F.lit(False))
    return out


def tree_contexts(nodes: DataFrame, chunks: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, root_id, context): each tree's text, folded over its nodes in order of visit.

    ``nodes`` as ``forest.forest`` gives it, with ``keys`` where there are several forests; ``chunks`` are combined chunks, of which javadocs and
    dependency reports are looked up. A class appends its frame and its dependencies; a method's doc is
    put before the first place of its signature, and its body replaces every place; a lone doc goes before its
    method's signature; a report is appended. A signature that is not there leaves the text as it is.
    """
    texts = chunks.select(F.col("id").alias("node_id"), "content")
    docs = chunks.filter(F.col("id").endswith(".javadoc")).select(F.regexp_replace("id", r"\.javadoc$", "").alias("node_id"), F.col("content").alias("doc"))
    reports = chunks.filter(F.col("id").endswith(".dependencies")).select(F.regexp_replace("id", r"\.dependencies$", "").alias("node_id"), F.col("content").alias("report"))
    rows = nodes.join(texts, "node_id").join(docs, "node_id", "left").join(reports, "node_id", "left")
    owner = F.when(F.col("section") == "methodDoc", F.regexp_replace("node_id", r"\.javadoc$", "")).otherwise(F.col("node_id"))
    own_class = F.element_at("path", 1)
    signature = F.when(owner.startswith(F.concat(own_class, F.lit("."))) & (owner != own_class), F.substring(owner, F.length(own_class) + 2, F.length(owner))).otherwise(F.substring_index(owner, ".", -1))
    step = F.struct("path", "node_id", "section", "content", "doc", "report", signature.alias("signature"))

    def fold(text: Column, n: Column) -> Column:
        with_doc = F.when(n["doc"].isNotNull(), insert_before(text, n["signature"], n["doc"])).otherwise(text)
        frame = F.concat(text, filled(CLASS_HEADING, n["node_id"], n["content"]), F.coalesce(F.concat(F.lit(DEPENDENCY_HEADING), n["report"]), F.lit("")))
        out = F.when(n["section"] == "classFrame", frame)
        out = out.when(n["section"] == "method", F.replace(with_doc, n["signature"], n["content"]))
        out = out.when(n["section"] == "methodDoc", insert_before(text, n["signature"], n["content"]))
        return out.when(n["section"] == "dependenciesInfo", F.concat(text, n["content"])).otherwise(text)

    trees = rows.groupBy(*keys, "root_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return trees.select(*keys, "root_id", F.aggregate("steps", F.lit(""), fold).alias("context"))


def within_budget(contexts: DataFrame, keys: list[str], order: list[Column], budget: int = BUDGET, text: str = "context") -> DataFrame:
    """The contexts of each key, in order, up to and with the first that makes their length exceed ``budget``.

    Without keys all rows share one budget, and no task sees them all; with keys, each key's rows are sorted in one.
    """
    if not keys:
        return until(contexts, F.length(text), budget, *order)
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return contexts.withColumn("__before", F.coalesce(F.sum(F.length(text)).over(window), F.lit(0))).filter(F.col("__before") <= budget).drop("__before")


def assembled(contexts: DataFrame, ranks: DataFrame, validators: list[Validator] = (), budget: int = BUDGET, keys: list[str] = ()) -> DataFrame:
    """(keys, context, trees): valid trees of rank over 0, by falling rank, then root, within the budget.

    Without keys there is one row, also if no tree stays. What is collected is no longer than the budget and one tree: trees of no text add nothing.
    """
    rows = contexts.join(ranks, [*keys, "root_id"]).filter(F.col("rank") > 0).filter(all_valid(F.col("context"), list(validators)))
    kept = within_budget(rows, list(keys), [F.desc("rank"), F.col("root_id")], budget)
    own = F.when(F.length("context") > 0, F.struct((-F.col("rank")).alias("order"), "root_id", "context"))
    each = F.array_sort(F.collect_list(own))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(each, lambda x: x["context"]), "").alias("context"), F.count("*").alias("trees"))


def context_of(hits: DataFrame, chunks: DataFrame, validators: list[Validator] = (), budget: int = BUDGET, keys: list[str] = ()) -> DataFrame:
    """The assembled context of ``hits`` (keys, id) in ``chunks``, one for each value of ``keys``.

    Parents are climbed on ids alone, as the lowest part of each unit has them, and once for an id that several keys hit; only the units of
    the trees, with their docs and reports, are put together.
    """
    keys = list(keys)
    section = F.coalesce(F.col("metadata")[SECTION_KEY], F.lit("unknown"))
    lowest = checkpointed(forest.ancestor_closure(hits, chunks.filter("part = 0").select("id", "parent", section.alias("section"))))
    placed = lowest if not keys else lowest.join(hits.select(*keys, F.col("id").alias("hit_id")).distinct(), "hit_id")
    nodes = checkpointed(forest.forest(placed, keys))
    ids = nodes.select(F.explode(F.array(F.col("node_id"), *(F.concat("node_id", F.lit(s)) for s in (".javadoc", ".dependencies")))).alias("id")).distinct()
    whole = checkpointed(combine(chunks.join(ids, "id", "left_semi")))
    return assembled(tree_contexts(nodes, whole, keys), forest.tree_ranks(placed, keys), validators, budget, keys)


def enrich_many(questions: DataFrame, store: DataFrame, start: tuple[int, float] = retrieval.CONTEXT_START, template: str = CONTEXT_PROMPT, validators: list[Validator] = (not_empty,), prefetched: DataFrame | None = None, digits: int | None = None, search: Callable[..., DataFrame] = retrieval.similar_per_query, budget: int = BUDGET) -> DataFrame:
    """(question_id, prompt, level, trees) of every row of ``questions`` (question_id, question, embedding).

    All questions are searched together, once, at the loosest level of the ladder; its levels are rows. A level whose hits are
    those of the level before is left out. Trees, ranks and contexts are those of each question and level, and each question's first level
    whose context is valid fills ``template``. Blank questions, those without a vector and those without a valid level say so and
    have no level. ``prefetched`` (question_id, id) are chunks that belong to a question's hits at every level.
    ``search`` is ``similar_per_query`` or another function of its parameters.
    """
    asked = checkpointed(questions.select("question_id", "question", "embedding"))
    known = asked.filter(has_text(F.col("question")) & F.col("embedding").isNotNull())
    steps = retrieval.ladder(*start)
    found = search(store, known.select(F.col("question_id").alias("query_id"), "embedding"), max(k for _, k, _ in steps), steps[-1][2], "id", digits)
    levels = asked.sparkSession.createDataFrame(steps, "level int, max_result int, min_score double")
    met = found.join(F.broadcast(levels), (F.col("rank") <= F.col("max_result")) & (F.col("score") >= F.col("min_score")))
    met = checkpointed(met.select(F.col("query_id").alias("question_id"), "level", "id").distinct())
    # each level's hits are among the next one's, so equal numbers are equal hits
    sizes = met.groupBy("question_id", "level").agg(F.count("*").alias("n")).groupBy("question_id", "n").agg(F.min("level").alias("level"))
    hits = met.join(sizes.select("question_id", "level"), ["question_id", "level"])
    if prefetched is not None:
        tried = sizes.select("question_id", "level").union(known.select("question_id", F.lit(0))).distinct()
        hits = hits.unionByName(tried.join(prefetched.select("question_id", "id"), "question_id")).distinct()
    hits = checkpointed(hits)
    keys = ["question_id", "level"]
    contexts = hits.select(*keys).distinct().join(context_of(hits, store, validators, budget, keys), keys, "left").fillna({"context": "", "trees": 0})
    valid = contexts.filter(all_valid(F.col("context"), list(validators)))
    best = valid.groupBy("question_id").agg(F.min_by(F.struct("level", "context", "trees"), "level").alias("b"))
    rows = asked.join(best, "question_id", "left")
    text = F.coalesce(F.when(has_text(F.col("question")), filled(template, F.col("b.context"), F.col("question"))), F.lit(NO_CONTEXT))
    return rows.select("question_id", text.alias("prompt"), F.col("b.level").alias("level"), F.col("b.trees").alias("trees"))


def enrich(spark: SparkSession, store: DataFrame, question: str, embedder: retrieval.Embedder, start: tuple[int, float] = retrieval.CONTEXT_START, template: str = CONTEXT_PROMPT, validators: list[Validator] = (not_empty,), prefetched: DataFrame | None = None) -> str:
    """The prompt for one question; see ``enrich_many``."""
    if not question.strip():
        return NO_CONTEXT
    vector = [float(x) for x in embedder([question])[0]]
    rows = spark.createDataFrame([(0, question, vector)], "question_id long, question string, embedding array<double>")
    own = None if prefetched is None else prefetched.select(F.lit(0).cast("long").alias("question_id"), "id")
    return enrich_many(rows, store, start, template, validators, own).first()["prompt"]


def ask(spark: SparkSession, store: DataFrame, question: str, embedder: retrieval.Embedder, chat: Chat = silent_chat, **how) -> str:
    """A chat model's answer to the enriched question."""
    return chat(enrich(spark, store, question, embedder, **({"start": retrieval.ASK_START, "template": DOC_PROMPT} | how)))
