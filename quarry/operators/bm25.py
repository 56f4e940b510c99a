"""Sparse retrieval: posting tables and batch BM25 search.

Queries are a table, so a batch of any size is one plan. Texts are cut into terms once, in generated code;
each task folds a document's terms to those that some query asks for and one count of the rest before
anything is shuffled. Document frequencies, lengths and scores all read that one small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as tx

K1, B = 1.5, 0.75


def terms(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term), a row for each; null terms for texts without any."""
    raw = docs.select(key, F.explode_outer(tx.raw_tokens(F.coalesce("text", F.lit("")))).alias("raw"))
    return raw.select(key, F.explode_outer(F.when(F.col("raw").isNotNull(), tx.forms(F.col("raw")))).alias("term"))


def postings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, tf)"""
    return terms(docs, key).filter("term IS NOT NULL").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, dl): tokens of each text, folded forms included."""
    return terms(docs, key).groupBy(key).agg(F.count("term").alias("dl"))


def document_frequency(posting: DataFrame) -> DataFrame:
    return posting.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def frequencies(docs: DataFrame) -> DataFrame:
    """(term, df): a document is one row, so its distinct terms meet within it, and only sums are shuffled."""
    return docs.select(F.explode(tx.distinct_tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(length: DataFrame) -> DataFrame:
    """One row: documents and mean length, which a filter on the search never changes."""
    return length.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.when(F.col("dl") > 0, F.col("dl")).otherwise(F.lit(1))), F.lit(1.0)).alias("avgdl"))


def idf(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


#: Distinct query terms up to which they are sent to every task; beyond it they are shuffled like the terms.
SENT_TERMS = 1_000_000


def scores(docs: DataFrame, queries: DataFrame, allowed=None) -> DataFrame:
    """(query_id, doc_id, score) of every match, rounded to 6 places.

    ``allowed`` filters the documents that are returned, not the statistics.
    """
    asked = queries.select("query_id", F.explode(tx.tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    wanted = asked.select(F.col("term").alias("asked")).distinct()
    if wanted.limit(SENT_TERMS + 1).count() <= SENT_TERMS:
        wanted = F.broadcast(wanted)
    # terms that no query asks for fall together under null: what is left of a document is a few rows
    kept = terms(docs).join(wanted, F.col("term") == F.col("asked"), "left").groupBy("doc_id", "asked").agg(F.count("term").alias("tf"))
    # all uses need tf, so they read one and the same exchange
    found = kept.filter("asked IS NOT NULL AND tf > 0").select("doc_id", F.col("asked").alias("term"), "tf")
    df = document_frequency(found)
    length = kept.groupBy("doc_id").agg(F.sum("tf").alias("dl"))
    stats = corpus_stats(length)
    if allowed is not None:
        length = length.join(docs.filter(allowed).select("doc_id"), "doc_id", "left_semi")
    parts = found.join(df, "term").join(length, "doc_id").join(F.broadcast(stats)).join(asked, "term")  # stats is one row
    tf, dl = F.col("tf"), F.greatest("dl", F.lit(1))
    weight = idf(F.col("n"), F.col("df")) * (1 + F.log("qtf")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    return parts.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight), 6).alias("score")).filter("score > 0")


def best(scored: DataFrame, k: int, score: str = "score", item: str = "doc_id") -> DataFrame:
    """The k best of each query, with ``rank`` from 1; ties by the item's id."""
    order = W.partitionBy("query_id").orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
