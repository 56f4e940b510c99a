"""From a question to an answer's parts: rewriting, context, grounding and what to say without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as tx

#: Variants of a question, characters of a context and what a cut block must leave, the floor of grounding.
VARIANTS, CONTEXT, WORTH, FLOOR = 2, 12_000, 400, 0.15
#: Other phrases for words of a question.
HINTS = (
    ("newton", ("newton second law", "F = ma", "force mass acceleration", "equation of motion")),
    ("entropy", ("entropy definition", "disorder measure", "second law entropy generation", "dS")),
    ("photosynthesis", ("calvin benson cycle", "carbon fixation", "chloroplast light reaction")),
    ("big o", ("asymptotic complexity", "time complexity analysis", "growth rate")),
)


def expansions(question: Column) -> Column:
    """At most VARIANTS other queries: phrases for known words, then the question's key terms."""
    low, terms = F.lower(question), tx.key_terms(question, 5)
    found = F.array().cast("array<string>")
    for needle, phrases in HINTS:
        fresh = F.filter(F.array(*map(F.lit, phrases)), lambda p: ~low.contains(F.lower(p)))
        found = F.concat(found, F.when(low.contains(needle), fresh).otherwise(F.array().cast("array<string>")))
    named = F.when(F.size(terms) >= 2, F.array(F.concat(F.get(terms, F.lit(0)), F.lit(" definition")), F.array_join(F.slice(terms, 1, 3), " "))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(found, named), 1, VARIANTS)


def resolved(question: Column, vague: Column, topic: Column) -> Column:
    """A vague question with the key terms of the turn before it; others as they are."""
    about = F.concat(F.regexp_replace(question, "[?.]+$", ""), F.lit(" (about: "), F.array_join(topic, ", "), F.lit(")"))
    return F.when(vague & (F.size(topic) > 0), about).otherwise(question)


def every_query(original: Column, standalone: Column, others: Column) -> Column:
    """The different queries in order: as asked, as resolved, and the others that differ from it in more than case."""
    other = F.filter(others, lambda o: F.lower(o) != F.lower(standalone))
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(original, standalone), other), lambda x: F.trim(x)), lambda x: x != ""))


def context(ranked: DataFrame, most: int = CONTEXT) -> DataFrame:
    """(query_id, context, blocks) of rows (query_id, rank, header, text): numbered blocks within a budget.

    The block that exceeds it is cut if enough of it is left, and is the last. A query has as many rows as
    were retrieved for it.
    """
    w = W.partitionBy("query_id").orderBy("rank")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("header"), F.lit("\n"), tx.strip(F.col("text")))
    rows = ranked.select("query_id", "rank", block.alias("block"))
    rows = rows.withColumn("used", F.coalesce(F.sum(F.length("block") + 2).over(before), F.lit(0)))
    rows = rows.withColumn("over", F.col("used") + F.length("block") > most)
    rows = rows.withColumn("past", F.coalesce(F.max(F.col("over").cast("int")).over(before), F.lit(0)))
    cut = F.concat(F.regexp_replace(F.left("block", (most - F.col("used")).cast("int")), r"\s+$", ""), F.lit("\n[...truncated]"))
    piece = F.when(~F.col("over"), F.col("block")).when(most - F.col("used") > WORTH, cut)
    kept = rows.filter("past = 0").withColumn("piece", piece).filter("piece IS NOT NULL")
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "piece"))), lambda x: x["piece"]), "\n\n").alias("context"), F.count(F.lit(1)).alias("blocks"))


def best_sentences(text: Column, question: Column, most: int = 5, least: int = 40, terms: int = 10) -> Column:
    """The sentences that have most of a question's key terms, in the order of the text; earlier ones on ties."""
    def pick(asked: Column) -> Column:
        scored = F.transform(tx.sentences(text, least), lambda s, i: F.struct((-F.size(F.filter(asked, lambda t: F.lower(s).contains(t)))).alias("n"), i.alias("i"), s.alias("s")))
        return F.transform(F.array_sort(F.transform(F.slice(F.array_sort(scored), 1, most), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"])

    return tx.let(tx.key_terms(question, terms), pick)


def grounding(sentences: Column, evidence: Column, cited: Column) -> Column:
    """Labels of an answer: what its evidence says, what goes beyond it, or general knowledge without any evidence.

    ``sentences``: key terms of each sentence that has some, and ``n`` of all; ``evidence``: key terms of the
    passages, null if there were none; ``cited``: whether it names one of them.
    """
    hits = F.size(F.filter(sentences["terms"], lambda t: (F.size(t) > 0) & (F.size(F.array_intersect(t, evidence)) / F.size(t) >= 0.55)))
    hits = F.coalesce(hits, F.lit(0))
    hits = F.when(evidence.isNull(), F.lit(0)).otherwise(hits)
    labels = F.array(
        F.when((hits > 0) | cited, F.lit("retrieved_fact")),
        F.when((sentences["n"] > 0) & (hits < sentences["n"] * 0.6), F.lit("model_reasoning")),
        F.when(evidence.isNull(), F.lit("general_knowledge")),
    )
    found = F.filter(labels, lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.array_join(found, ",")).otherwise("model_reasoning")


def gate(confidence: Column, allow_general: Column) -> Column:
    """struct<evidence, confidence>: passages above the floor, else general knowledge where it is allowed, else a refusal."""
    ok = confidence >= FLOOR
    return F.struct(F.when(ok, "documents").when(allow_general, "general_knowledge").otherwise("insufficient").alias("evidence"), F.when(ok, confidence).when(allow_general, 0.3).otherwise(0.0).alias("confidence"))
