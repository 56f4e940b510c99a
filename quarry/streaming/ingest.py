"""Incremental ingest of documents: a text that is stored already is not stored again."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.streaming import runs


def distinct_texts(spark: SparkSession, sf_dir: str, at: str | None = None) -> DataFrame:
    """(id, length) of each distinct text; with the same ``at`` a later run takes only what is new.

    What is stored is the state: a batch is held against the stored ids, read as one table, so that no stream
    state grows with the corpus and plans do not grow with the number of batches. Each batch has a folder of
    its own, so that a repeated batch replaces what it wrote.
    """
    at = at or runs.folder(spark, "ingest")

    def stored() -> DataFrame | None:
        try:
            return spark.read.parquet(f"{at}/texts")
        except AnalysisException:  # nothing is stored yet
            return None

    def store(batch: DataFrame, number: int) -> None:
        fresh, known = batch.groupBy("id").agg(F.max("length").alias("length")), stored()
        if known is not None:
            fresh = fresh.join(known.filter(F.col("batch") < number).select("id"), "id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{at}/texts/batch={number}")

    texts = runs.source(spark, sf_dir, "documents").select(F.substring(F.sha2("text", 256), 1, 32).alias("id"), F.length("text").alias("length"))
    runs.drain(texts, "append", store, at)
    return stored().select("id", "length")
