"""Running a stream over what a table holds now, and the folder that its results go to."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Files of a batch: what a batch holds is bounded, however much is there.
FILES = 64


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. On one machine a temporary one where none
    is set; on a cluster that is an error, since executors would not see each other's files there."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, for a stream whose progress nobody needs later."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session while a stream is started and run; then they are as they were."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream. The pattern lets the path be one file, which a stream's reader refuses by name."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{sf_dir}/{name}.parque[t]")


def drain(stream: DataFrame, mode: str, batch: Callable[[DataFrame, int], None], at: str) -> None:
    """Everything that is there, then stop. Progress is kept in ``at``: a run with the same ``at`` goes on from there."""
    stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
