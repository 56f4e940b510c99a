"""Ordered windows over few keys, in two levels: ranges of rows within a key, then what the ranges before add.

A window by a key puts all rows of the key into one task. Here rows are dealt to ranges of (key, order), which are
written once, so that a range is the same rows each time. A task works within its range; totals of ranges, a row
for each, are scanned by key; and each range's rows get the total of those before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.streaming import runs

#: Rows of a key that a task of ``rolling`` holds, besides those before that its first rows need.
CHUNK = 20_000


def ranged(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows with ``range``, the number of their range; numbers rise with (keys, order)."""
    spark = rows.sparkSession
    at = runs.folder(spark, "ranges")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, *map(F.col, keys), *order).withColumn("range", F.spark_partition_id()).write.parquet(at)
    return spark.read.parquet(at)


def before(rows: DataFrame, keys: list[str], order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """Of ranged rows, for each name the sum of a column over the rows of the key that come before; 0 for the first."""
    within = W.partitionBy("range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("range", *keys).agg(*(F.sum(c).alias(name) for name, c in totals.items()))
    names = {c: f"of_{c}" for c in ("range", *keys)}
    carried = sums.select(*(F.col(c).alias(a) for c, a in names.items()), *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"carried_{name}") for name in totals))
    same = [F.col(c).eqNullSafe(F.col(a)) for c, a in names.items()]
    out = rows.select(*rows.columns, *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(name) for name, c in totals.items()))
    out = out.join(carried, same)
    return out.select(*rows.columns, *((F.col(name) + F.col(f"carried_{name}")).alias(name) for name in totals))


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """The rows with their number within the key, from 0."""
    return before(ranged(rows, keys, order), keys, order, {name: F.lit(1)}).drop("range")


def rolling(rows: DataFrame, keys: list[str], order: list[Column], width: int, values: dict[str, Callable]) -> DataFrame:
    """For each name ``make(window)`` over a row and the ``width - 1`` before it; chunks take those along that they need."""
    chunk = F.floor(F.col("place") / CHUNK)
    own = F.array(F.struct(chunk.alias("chunk"), F.lit(False).alias("lent")))
    reach = -(-(width - 1) // CHUNK)
    lent = F.transform(F.sequence(F.lit(1), F.lit(max(reach, 1))), lambda i: F.struct((chunk + i).alias("chunk"), F.lit(True).alias("lent")))
    lent = F.filter(lent, lambda x: (x["chunk"] * CHUNK - F.col("place") < width) & F.lit(width > 1))
    dealt = numbered(rows, keys, order).withColumn("to", F.explode(F.concat(own, lent))).select("*", "to.*").drop("to")
    window = W.partitionBy(*keys, "chunk").orderBy("place").rowsBetween(-(width - 1), 0)
    out = dealt.select(*rows.columns, "lent", *(make(window).alias(name) for name, make in values.items()))
    return out.filter("NOT lent").drop("lent")
