"""A stored table of vectors in cells, of which a search reads the nearest few.

Centres are fitted on a sample of bounded size; every vector goes to its nearest centre's cell, and a cell is a
folder of the table. A query takes the cells of its nearest centres, so that the scan reads those folders alone,
and gets the exact similarity of each vector that it finds there. How many cells that are is fitted as well: the
fewest that find a wanted share of the true neighbours of the sample, held against the whole sample. With all
cells the result is the exact one.

Cells with many vectors are dealt to several tasks, and so are the queries of a cell; each task is one product of
matrices and returns the k best of each query. Vectors are stored with length 1; a zero vector is like nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.bm25 import best
from quarry.providers import VectorTable
from quarry.sources.snapshots import Append, Catalog, Put, Snapshot, live

#: Rows of the sample, most centres, rounds of fitting; rows and queries of a task; wanted share of true neighbours.
SAMPLE, CENTRES, ROUNDS, ROWS, QUERIES, WANTED = 20_000, 1024, 8, 1 << 16, 4096, 0.95
#: Sample rows that are searched for to fit the number of cells, and neighbours that are looked for.
TRIED, NEIGHBOURS = 200, 10


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def vectors_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal width, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """Centres of rows of length 1, and how many of them a query must visit to find WANTED of its neighbours."""
    rng = np.random.default_rng(seed)
    count = int(min(CENTRES, max(1, np.sqrt(len(x)))))
    centres = x[rng.choice(len(x), count, replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.bincount(own, minlength=count) == 0
        centres = np.where(empty[:, None], centres, unit(sums))
    own = (x @ centres.T).argmax(1)
    asked = rng.choice(len(x), min(TRIED, len(x)), replace=False)
    like = x[asked] @ x.T
    like[np.arange(len(asked)), asked] = -2
    true = np.argsort(-like, axis=1, kind="stable")[:, : min(NEIGHBOURS, max(1, len(x) - 1))]
    order = np.argsort(-(x[asked] @ centres.T), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(count)[None].repeat(len(asked), 0), 1)
    needed = np.sort(rank[np.arange(len(asked))[:, None], own[true]].ravel())
    return centres, int(needed[min(len(needed) - 1, int(np.ceil(WANTED * len(needed))))]) + 1


class CellVectors(VectorTable):
    """Rows (vec_id, label, embedding) of a catalog; those that are put in replace those with their id."""

    KIND = "vec_id bigint, label bigint, embedding array<float>"

    def __init__(self, catalog: Catalog):
        self.catalog, self.spark = catalog, catalog.spark

    @staticmethod
    def fresh(spark: SparkSession, name: str = "cells") -> CellVectors:
        return CellVectors(Catalog.fresh(spark, name))

    def _fitted(self, now: Snapshot) -> tuple[np.ndarray, int] | None:
        rows = now.load("centres")
        if rows is None:
            return None
        found = rows.orderBy("cell").collect()  # CENTRES rows at most
        return np.array([r.centre for r in found]), found[0].probes

    def rows(self) -> DataFrame:
        now = self.catalog.snapshot()
        rows = now.load("cells")
        return self.spark.createDataFrame([], self.KIND) if rows is None else live(now, rows, "vec_id").select("vec_id", "label", "embedding")

    def upsert(self, rows: DataFrame) -> None:
        """Centres are fitted with the first rows and stay until ``refit``."""
        rows = rows.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<float>").alias("embedding")).dropDuplicates(["vec_id"])
        self.catalog.commit(lambda now: self._change(now, rows, self._fitted(now)))

    def refit(self) -> None:
        """New centres from what there is now, and all vectors in their cells."""

        def change(now: Snapshot) -> dict:
            if now.load("cells") is None:
                return {}
            made = self._change(now, live(now, now.load("cells"), "vec_id").select("vec_id", "label", "embedding"), None)
            return {name: Put(c.rows, c.by) for name, c in made.items() if name != "gone"} | {"gone": Put(now.load("cells").select(F.col("vec_id").alias("item"), F.lit(0).cast("bigint").alias("before")).limit(0))}

        self.catalog.commit(change)

    def remove(self, condition: Column) -> int:
        found = 0

        def change(now: Snapshot) -> dict:
            nonlocal found
            if now.load("cells") is None:
                return {}
            gone = live(now, now.load("cells"), "vec_id").filter(condition).select(F.col("vec_id").alias("item"), F.lit(now.version + 1).cast("bigint").alias("before"))
            found = gone.count()
            return {"gone": Append(gone)} if found else {}

        self.catalog.commit(change)
        return found

    def _change(self, now: Snapshot, rows: DataFrame, fitted) -> dict:
        out, rev = {}, now.version + 1
        if fitted is None:
            sample = unit(vectors_of(rows.orderBy(F.xxhash64("vec_id")).select("embedding").limit(SAMPLE).toArrow().column(0)))
            if not len(sample):
                return {}
            fitted = fit(sample)
            table = [(i, c.tolist(), fitted[1]) for i, c in enumerate(fitted[0])]
            out["centres"] = Append(self.spark.createDataFrame(table, "cell int, centre array<double>, probes int").coalesce(1))
        sent = self.spark.sparkContext.broadcast(fitted[0])  # CENTRES vectors at most

        def run(batches):
            for b in batches:
                x = unit(vectors_of(b.column(2)))
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, v, pa.array((x @ sent.value.T).argmax(1).astype(np.int32))], ["vec_id", "label", "embedding", "v", "cell"])

        placed = rows.mapInArrow(run, f"{self.KIND}, v array<double>, cell int").withColumn("rev", F.lit(rev).cast("bigint"))
        # a large cell is written by several tasks
        placed = placed.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(4)))
        out["cells"] = Append(placed, ("cell",))
        if now.load("cells") is not None:
            out["gone"] = Append(rows.select(F.col("vec_id").alias("item"), F.lit(rev).cast("bigint").alias("before")))
        return out

    def query(self, queries: DataFrame, k: int, where: Column | None = None, probes: int | None = None) -> DataFrame:
        """(query_id, vec_id, label, similarity, rank) of the k nearest of each query's ``probes`` cells, as many as were
        fitted unless that is given; ``where`` is a condition on vec_id and label. Ties by vec_id."""
        now = self.catalog.snapshot()
        fitted = self._fitted(now)
        kind = "query_id bigint, vec_id bigint, label bigint, similarity double"
        if fitted is None:
            return self.spark.createDataFrame([], f"{kind}, rank int")
        centres, usual = fitted
        visits = min(len(centres), probes or usual)
        sent = self.spark.sparkContext.broadcast(centres)

        def visit(batches):
            for b in batches:
                q = unit(vectors_of(b.column(1)))
                cells = np.argsort(-(q @ sent.value.T), axis=1, kind="stable")[:, :visits]
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists(q), lists(cells.astype(np.int32))], ["query_id", "q", "cells"])

        asked = queries.filter("embedding IS NOT NULL").select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(visit, "query_id bigint, q array<double>, cells array<int>")
        blocks = max(1, -(-queries.count() // QUERIES))
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).select("query_id", "q", "block", F.explode("cells").alias("to"))
        needed = [r.to for r in asked.select("to").distinct().collect()]  # cells, CENTRES at most
        rows = live(now, now.load("cells").filter(F.col("cell").isin(needed)), "vec_id")
        rows = rows if where is None else rows.filter(where)
        parts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("parts"))
        parts = F.broadcast(parts)  # a row for each cell, CENTRES at most
        rows = rows.join(parts, "cell").select("vec_id", "label", "v", "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"))
        pairs = asked.join(parts.withColumnRenamed("cell", "to"), "to").select("query_id", "q", "to", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("at"))
        left = rows.join(pairs.select(F.col("to").alias("cell"), F.col("at").alias("part"), F.col("block").alias("block")).distinct(), ["cell", "part"])

        def run(group: pa.Table, wanted: pa.Table) -> pa.Table:
            ids, labels = group.column("vec_id").to_numpy(), group.column("label").combine_chunks()
            order = np.argsort(ids, kind="stable")
            like = np.round(np.maximum(vectors_of(wanted.column("q")) @ vectors_of(group.column("v"))[order].T, 0.0), 6) if len(ids) and len(wanted) else np.zeros((len(wanted), 0))
            keep = np.argsort(-like, axis=1, kind="stable")[:, :k]
            at = order[keep.ravel()] if keep.size else np.zeros(0, np.int64)
            q = np.repeat(wanted.column("query_id").to_numpy(), keep.shape[1])
            return pa.table([pa.array(q, pa.int64()), pa.array(ids[at], pa.int64()), labels.take(pa.array(at, pa.int64())), pa.array(np.take_along_axis(like, keep, 1).ravel(), pa.float64())], ["query_id", "vec_id", "label", "similarity"])

        found = left.groupBy("cell", "part", "block").cogroup(pairs.groupBy("to", "at", "block")).applyInArrow(run, kind)
        return best(found, k, "similarity", "vec_id")
