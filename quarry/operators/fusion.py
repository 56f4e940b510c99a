"""Joining ranked lists: min-max normalisation, weighted fusion and reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DENSE, SPARSE, RRF_K = 0.7, 0.3, 60


def min_max(score: Column, *by: str) -> Column:
    """Within a list; a flat list is all ones."""
    w = W.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi - lo < 1e-9, F.lit(1.0)).otherwise((score - lo) / (hi - lo))


def fuse(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Lists (query_id, variant, item, score) -> (query_id, item, dense, sparse, score).

    Both lists go through one shuffle: a union and a grouped maximum instead of a full outer join.
    """
    lists = dense.withColumn("kind", F.lit("d")).unionByName(sparse.withColumn("kind", F.lit("s")))
    lists = lists.withColumn("x", min_max(F.col("score"), "query_id", "variant", "kind"))
    of = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("x"))), F.lit(0.0))
    both = lists.groupBy("query_id", "item").agg(of("d").alias("dense"), of("s").alias("sparse"))
    return both.select("query_id", "item", F.round("dense", 6).alias("dense"), F.round("sparse", 6).alias("sparse"), F.round(DENSE * F.col("dense") + SPARSE * F.col("sparse"), 6).alias("score"))


def reciprocal_ranks(ranked: DataFrame) -> DataFrame:
    """(query_id, item, rank) of several lists -> (query_id, item, rrf)"""
    return ranked.groupBy("query_id", "item").agg(F.round(F.sum(1 / (RRF_K + F.col("rank"))), 6).alias("rrf"))
