"""Tables that live across jobs, under versions, and embeddings worked out only where a cache has none."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.snapshots import Catalog, Drop, Put


class Store:
    """Named tables of a catalog. Each change is one commit: a reader sees all of it or nothing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.catalog = spark, Catalog(spark, root)

    @staticmethod
    def fresh(spark: SparkSession, name: str) -> Store:
        return Store(spark, Catalog.fresh(spark, name).root)

    def save(self, name: str, df: DataFrame) -> DataFrame:
        """The table is complete under its name, or as it was."""
        return self.catalog.commit(lambda _: {name: Put(df)}).load(name)

    def load(self, name: str, version: int | None = None) -> DataFrame | None:
        """The table, or None if there is none or its version cannot be read."""
        try:
            return self.catalog.load(name, version)
        except (AnalysisException, Py4JJavaError, ValueError, KeyError):
            return None

    def delete(self, name: str) -> bool:
        there = self.load(name) is not None
        if there:
            self.catalog.commit(lambda _: {name: Drop()})
        return there

    def upsert(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """Rows take the place of those with their key; one of several new rows with a key is kept."""
        rows = rows.dropDuplicates([key])

        def change(now):
            old = now.load(name)
            return {name: Put(rows if old is None else old.join(rows.select(key), key, "left_anti").unionByName(rows))}

        return self.catalog.commit(change).load(name)

    def remove(self, name: str, condition) -> int:
        """How many rows met the condition and are gone."""
        gone = 0

        def change(now):
            nonlocal gone
            old = now.load(name)
            gone = 0 if old is None else old.filter(condition).count()
            return {name: Put(old.filter(~F.coalesce(condition, F.lit(False))))} if gone else {}

        self.catalog.commit(change)
        return gone


def embed_missing(docs: DataFrame, cache: DataFrame | None, embed, key: str) -> DataFrame:
    """(key, embedding, cached): embeddings of texts that the cache (digest, embedding) has, the others worked out."""
    keyed = docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    if cache is None:
        return embed(keyed).withColumn("cached", F.lit(False))
    known = keyed.join(cache, "digest").select(key, "embedding", F.lit(True).alias("cached"))
    missing = keyed.join(cache.select("digest"), "digest", "left_anti").select(key, "text")
    return known.unionByName(embed(missing).withColumn("cached", F.lit(False)))
