"""Hard negatives by a pivot table.

Components become whole numbers, floor(256 x). A vector x is augmented by sqrt(M - x.x), where M is the largest
squared length of all rows, and an anchor q by 0: then |q - x|^2 = q.q + M - 2 q.x, so the largest inner product
is the least distance. Pivots are picked far from each other in a bounded sample; they set the speed, never the
result. Distances of every row to the pivots are stored with it. For an anchor, the triangle inequality
|d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p) brackets the score of a whole group of rows from the group's
least and largest distances, then of its rows, and only survivors get an exact product.

Rows are dealt to groups of one label and one nearest pivot, divided further so that a group has a bounded
number of rows; anchors are dealt to blocks of a bounded number. A task holds one group and one block. Groups that
no anchor of a block can need are not sent to it. Each task returns an anchor's five best of its own label, in
the second turn the ten best of each band, so that what is ranked in the end does not grow with a group.

Where the bracket does not help, as for random directions in many dimensions, all rows of a group survive, and
their products are one product of matrices.

Defined results: rows without vec_id, label or vector, or with a component that is null or not finite, take no
part; a shorter vector counts as padded with zeros; rows that share a vec_id, equal or not, are rows of their
own, each of which takes its place in a ranking, and an anchor's own row alone is not its positive; ties go by
vec_id; an anchor alone in its label has no rows; a negative positive score admits no negatives, and one of 0
admits scores of 0; where a squared length passes 2**53, all products are exact and none is bracketed, and scores
beyond a long become its ends; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.shared import Stash, table

#: Contract values: scale, every so many rows an anchor, relabelled rows, positives, negatives, the band in hundredths.
SCALE, ANCHOR, RELABEL, LABELS, POSITIVES, NEGATIVES, LOW, HIGH = 256, 100, 7, 10, 5, 10, 30, 90
#: Pivots, rows of the sample they are picked from, rows of a group and anchors of a block.
PIVOTS, SAMPLE, ROWS, ANCHORS = 8, 2048, 1 << 16, 4096
#: Squared lengths up to which products in doubles are exact, and the ends of a long.
EXACT, LONG = 2.0**53, 2**63 - 1
#: Anchors whose products are worked out at once.
CHUNK = 64


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None] < sizes[:, None]] = flat
    return out


def whole(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, v, sq) of the rows that take part: whole components and squared length."""
    x = F.col("embedding").cast("array<double>")
    fine = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select("vec_id", F.col("label").cast("bigint").alias("label"), x.alias("embedding")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(fine)
    rows = rows.withColumn("label", F.when(F.col("vec_id") % RELABEL == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))

    def run(batches):
        for b in batches:
            v = b.column(2)
            flat = np.floor(SCALE * v.flatten().to_numpy(zero_copy_only=False))
            at = v.offsets.to_numpy()
            sums = np.append(0.0, np.cumsum(flat * flat)) if len(flat) else np.zeros(1)
            sq = np.array([(flat[i:j] ** 2).sum() for i, j in zip(at, at[1:], strict=False)]) if sums[-1] >= EXACT else sums[at[1:] - at[0]] - sums[at[:-1] - at[0]]
            lists = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(sq)], ["vec_id", "label", "v", "sq"])

    return rows.mapInArrow(run, "vec_id bigint, label bigint, v array<double>, sq double").withColumn("row", F.monotonically_increasing_id())


def pick_pivots(rows: DataFrame, largest: float, width: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before, in augmented form."""
    sample = rows.orderBy(F.xxhash64("row")).limit(SAMPLE).select("v", "sq").toArrow()
    v, sq = matrix(sample.column("v").combine_chunks(), width), sample.column("sq").to_numpy()
    points = np.column_stack([v, np.sqrt(largest - sq)])
    near, chosen = np.full(len(points), np.inf), [0]
    while len(chosen) < min(PIVOTS, len(points)):
        near = np.minimum(near, np.sqrt(((points - points[chosen[-1]]) ** 2).sum(1)))
        chosen.append(int(near.argmax()))
    return points[chosen]


def pivot_table(rows: DataFrame, pivots: np.ndarray, largest: float, width: int) -> DataFrame:
    """Rows with ``far``, their distances to the pivots, ``near``, those of the row as an anchor, and ``cell``."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors

    def run(batches):
        p = sent.value
        for b in batches:
            v, sq = matrix(b.column(3), width), b.column(4).to_numpy()
            shared, own = v @ p[:, :-1].T, (p**2).sum(1)
            far = np.sqrt(np.maximum(largest + own - 2 * (shared + np.outer(np.sqrt(np.maximum(largest - sq, 0)), p[:, -1])), 0))
            near = np.sqrt(np.maximum(sq[:, None] + own - 2 * shared, 0))
            at = pa.array(np.arange(0, (len(b) + 1) * len(p), len(p)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x.ravel())) for x in (far, near)]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists, pa.array(far.argmin(1).astype(np.int32))], ["row", "vec_id", "label", "v", "sq", "far", "near", "cell"])

    kind = "row bigint, vec_id bigint, label bigint, v array<double>, sq double, far array<double>, near array<double>, cell int"
    return rows.select("row", "vec_id", "label", "v", "sq").mapInArrow(run, kind)


def _products(x: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Rows of q against rows of x, as longs."""
    if exact:
        return (q @ x.T).astype(np.int64)
    big = lambda m: np.array([[int(c) for c in r] for r in m.tolist()], object).reshape(m.shape)
    return np.array([[min(max(int(s), -LONG - 1), LONG) for s in r] for r in big(q) @ big(x).T], np.int64).reshape(len(q), len(x))


def survivors(far: np.ndarray, order: np.ndarray, sorted_: np.ndarray, near: np.ndarray, reach: float) -> np.ndarray | None:
    """Rows within ``reach`` of an anchor by every pivot; None if the best pivot alone leaves most of them."""
    lo = np.array([np.searchsorted(s, d - reach, "left") for s, d in zip(sorted_, near, strict=True)])
    hi = np.array([np.searchsorted(s, d + reach, "right") for s, d in zip(sorted_, near, strict=True)])
    best = int((hi - lo).argmin())
    if 2 * (hi[best] - lo[best]) > len(far):
        return None
    at = order[best, lo[best] : hi[best]]
    return at[(np.abs(far[at] - near) <= reach).all(1)]


def searched(rows: DataFrame, anchors: DataFrame, largest: float, width: int, select, kind: str) -> DataFrame:
    """Each group of rows with each block of anchors that needs it.

    ``anchors`` has a row for each group that it needs, with ``low``, the least score of interest, or null if that
    is to be found from the group: then it is what the brackets promise of its POSITIVES best rows.
    ``select(anchor, ids, scores)`` gives the places of what an anchor takes of the survivors, and more columns.
    """
    exact = largest < EXACT
    pairs = anchors.select(F.col("cluster").alias("cluster"), F.col("block").alias("block")).distinct()
    left = rows.join(pairs, "cluster").groupBy("cluster", "block")

    def run(group: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(group) and len(asked):
            column = lambda t, c: t.column(c).combine_chunks()
            x, far = matrix(column(group, "v"), width), matrix(column(group, "far"), len(group.column("far")[0]))
            ids, numbers = group.column("vec_id").to_numpy(), group.column("row").to_numpy()
            order = far.argsort(0, kind="stable").T
            sorted_ = np.take_along_axis(far.T, order, 1)
            q, near, sq = matrix(column(asked, "v"), width), matrix(column(asked, "near"), far.shape[1]), asked.column("sq").to_numpy()
            more = asked.select([c for c in asked.column_names if c not in ("v", "near")]).to_pylist()
            full: list[int] = []

            def take(i: int, at: np.ndarray, scores: np.ndarray) -> None:
                out.extend(select(more[i], ids[at], numbers[at], scores))

            for i, anchor in enumerate(more):
                low = anchor["low"]
                if low is None:  # the brackets of as many rows, by the pivot that promises most
                    best = sorted_[:, min(POSITIVES, len(x) - 1)]
                    low = ((sq[i] + largest - (near[i] + best) ** 2) / 2).max()
                slack = 1e-6 * (sq[i] + largest + 1)
                found = survivors(far, order, sorted_, near[i], np.sqrt(max(sq[i] + largest - 2 * low + slack, 0.0)) + 1e-6) if exact else None
                if found is None:
                    full.append(i)
                elif len(found):
                    take(i, found, _products(x[found], q[i : i + 1], exact)[0])
            every = np.arange(len(x))
            for k in range(0, len(full), CHUNK):
                part = full[k : k + CHUNK]
                for i, scores in zip(part, _products(x, q[part], exact), strict=True):
                    take(i, every, scores)
        names = [c.split()[0] for c in kind.split(", ")]
        types = [pa.int32() if c.endswith(" int") else pa.int64() for c in kind.split(", ")]
        cut = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(cut, types, strict=True)], names)

    return left.cogroup(anchors.groupBy("cluster", "block")).applyInArrow(run, kind)


def _positives(anchor: dict, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> list[tuple]:
    other = np.flatnonzero(rows != anchor["row"])
    best = other[np.lexsort((rows[other], ids[other], -scores[other]))[:POSITIVES]]
    return [(anchor["row"], *x) for x in zip(ids[best].tolist(), rows[best].tolist(), scores[best].tolist(), strict=True)]


def _negatives(anchor: dict, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> list[tuple]:
    order = np.lexsort((rows, ids, -scores))
    falling, out = -scores[order], []
    for place, p in enumerate(anchor["scores"]):
        if p < 0:
            continue
        # whole numbers: 30 p <= 100 n <= 90 p
        a, b = np.searchsorted(falling, -(HIGH * p // 100), "left"), np.searchsorted(falling, -(-(-LOW * p // 100)), "right")
        best = order[a : min(b, a + NEGATIVES)]
        out += [(anchor["row"], place, *x) for x in zip(ids[best].tolist(), rows[best].tolist(), scores[best].tolist(), strict=True)]
    return out


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)"""
    kind = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark = vectors.sparkSession
    stash = Stash(spark, "negatives")
    rows = stash.keep(whole(vectors), "whole")
    head = rows.agg(F.max("sq").alias("largest"), F.max(F.size("v")).alias("width")).head()
    if head.largest is None:
        return spark.createDataFrame([], kind)
    largest, width = head.largest, head.width
    rows = stash.keep(pivot_table(rows, pick_pivots(rows, largest, width), largest, width), "pivots")
    stash.drop("whole")

    # groups of one label and cell, of at most about ROWS rows
    parts = rows.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / ROWS).alias("parts"))
    dealt = rows.join(parts, ["label", "cell"]).withColumn("cluster", F.concat_ws("-", "label", "cell", F.pmod(F.xxhash64("row"), F.col("parts"))))
    each = lambda f, of: F.transform(F.sequence(F.lit(0), F.size(of) - 1), f)
    ends = dealt.groupBy("cluster", "label").agg(*(f(F.get("far", F.lit(j))).alias(f"{name}{j}") for j in range(PIVOTS) for name, f in (("least", F.min), ("most", F.max))))
    ends = ends.select("cluster", F.col("label").alias("of"), F.array_compact(F.array(*(f"least{j}" for j in range(PIVOTS)))).alias("least"), F.array_compact(F.array(*(f"most{j}" for j in range(PIVOTS)))).alias("most"))
    ends = stash.keep(ends, "groups")  # a row for each group
    group_rows = dealt.select("cluster", "row", "vec_id", "v", "far")

    anchors = rows.filter(F.col("vec_id") % ANCHOR == 0).select("row", "label", "v", "sq", "near", F.col("vec_id").alias("anchor_id"))
    blocks = max(1, -(-anchors.count() // ANCHORS))
    anchors = stash.keep(anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), "anchors")
    first = anchors.join(ends.select("cluster", "of"), F.col("label") == F.col("of")).select("cluster", "block", "row", "v", "near", "sq", F.lit(None).cast("double").alias("low"))
    found = searched(group_rows, first, largest, width, _positives, "anchor bigint, vec_id bigint, other bigint, score bigint")
    place = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "other"))
    positives = stash.keep(found.withColumn("place", place - 1).filter(F.col("place") < POSITIVES), "positives")

    # POSITIVES scores for each anchor at most
    wanted = positives.groupBy(F.col("anchor").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda s: s["score"]).alias("scores"))
    wanted = anchors.join(wanted, "row").filter(F.array_max("scores") >= 0).withColumn("low", F.array_min(F.filter("scores", lambda s: s >= 0)) * (LOW / 100))
    apart = F.array_max(each(lambda j: F.greatest(F.get("near", j) - F.get("most", j), F.get("least", j) - F.get("near", j), F.lit(0.0)), F.col("near")))
    above = (F.col("sq") + largest - apart * apart) / 2 + 1e-6 * (F.col("sq") + largest + 1)
    second = wanted.join(ends, (F.col("label") != F.col("of")) & ((above >= F.col("low")) | F.lit(largest >= EXACT))).select("cluster", "block", "row", "v", "near", "sq", "low", "scores")
    found = searched(group_rows, second, largest, width, _negatives, "anchor bigint, place int, negative_id bigint, other bigint, negative_score bigint")
    rank = F.row_number().over(W.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id", "other"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= NEGATIVES)
    named = positives.join(anchors.select(F.col("row").alias("anchor"), "anchor_id"), "anchor").select("anchor", "place", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return best.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_pivot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


ORACLE = f"""WITH raw AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  r AS (SELECT vec_id, CASE WHEN vec_id % {RELABEL} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, v FROM raw),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM r a, r b WHERE a.vec_id % {ANCHOR} = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS i FROM s WHERE same) WHERE i <= {POSITIVES}),
  n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
  SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
