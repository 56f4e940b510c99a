"""Document fingerprints: a threshold-scaled sketch of every text.

All shingles (12 consecutive UTF-8 bytes; a shorter text is one shingle) are hashed; every hash below a
fixed fraction of the range, one in ``scale``, is kept, whatever the text's length. Sketches of very
unequal documents are therefore samples at the same rate: their union is the sketch of the joined
shingle sets, and overlaps estimate resemblance and containment without bias.

A fingerprint is the kept hashes in order, in hexadecimal; a text whose shingles are all above the
threshold has an empty one, as texts of few shingles may. Of two empty sketches nothing is known, so
their likeness is 0.

The next document is found without a global sort in one task: rows are dealt to ranges of doc_id, each
range is sorted and read in order, and its last row meets a copy of the next range's first row.

Defined results: null and empty texts have the fingerprint of the empty text; ties of doc_id are in
order of their texts; a null doc_id comes after all others; the only row is its own next one; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import textkit as tk
from quarry.llm.shared import table

ALL = (1 << 64) - 1


@dataclass(frozen=True)
class Sketch:
    width: int = 12
    scale: int = 8

    @property
    def threshold(self) -> int:
        return ALL // self.scale


def sketches(texts: list[bytes], s: Sketch = Sketch()) -> list[np.ndarray]:
    """The kept hashes of each text, in order."""
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.append(0, np.cumsum(sizes))
    data = np.frombuffer(b"".join(texts), np.uint8)
    rolling = tk.byte_hashes(data)
    lo = np.arange(len(data))
    lo = lo[np.repeat(at[1:], sizes) - lo >= s.width]
    tiny = np.flatnonzero((sizes < s.width) & (sizes > 0))
    value = np.concatenate([rolling.of(lo, lo + s.width), rolling.of(at[tiny], at[tiny + 1])])
    row = np.concatenate([np.searchsorted(at, lo, "right") - 1, tiny])
    low = np.flatnonzero(value < np.uint64(s.threshold))
    order = np.lexsort((value[low], row[low]))
    v, r = value[low][order], row[low][order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[fresh], r[fresh]
    first = np.searchsorted(r, np.arange(len(texts) + 1))
    return [v[a:b] for a, b in zip(first, first[1:], strict=False)]


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, float, float]:
    """Estimates of resemblance, and of how much of a is in b and of b in a."""
    same = len(np.intersect1d(a, b, assume_unique=True))
    whole = len(a) + len(b) - same
    return (same / whole if whole else 0.0), (same / len(a) if len(a) else 0.0), (same / len(b) if len(b) else 0.0)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both shingle sets together."""
    return np.union1d(a, b)


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def in_order(docs: DataFrame) -> DataFrame:
    """Rows (key, text, doc_id, tail), dealt to ranges of doc_id and sorted; each range ends with a copy,
    with ``tail`` = 1, of the first rows of the range that follows (the last: of the first)."""
    last = (1 << 63) - 1
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(last)).alias("key"))
    n = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # what the cluster is set to deal rows to, not what the input has
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10000 if n < 5000 else 4 * n)).head()[0]  # a number for each range
    cuts = sorted(set(cuts or []))
    width = max(1, int(len(cuts) ** 0.5))
    coarse = cuts[width - 1 :: width]

    def below(values) -> F.Column:
        return F.size(F.filter(values, lambda c: c < F.col("key")))

    literal = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    skip = below(literal(coarse)) * width
    part = skip + below(F.slice(literal(cuts), skip + 1, F.lit(width)))
    rows = rows.withColumn("part", part.cast("int"))
    heads = dict(rows.groupBy("part").agg(F.min("key")).collect())  # a row for each range
    parts = sorted(heads)
    before = {p: parts[i - 1] for i, p in enumerate(parts)}
    size = len(cuts) + 1
    head = literal([heads.get(p, last) for p in range(size)])
    previous = literal([before.get(p, 0) for p in range(size)])
    spot = F.col("part") + 1
    places = F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("tail")))
    extra = F.array(F.struct(F.element_at(previous, spot).cast("int").alias("p"), F.lit(1).alias("tail")))
    places = F.when(F.element_at(head, spot) == F.col("key"), F.concat(places, extra)).otherwise(places)
    dealt = rows.withColumn("place", F.explode(places)).select("key", "text", "doc_id", F.col("place.tail").alias("tail"), F.col("place.p").alias("part"))
    return dealt.repartitionById(size, F.col("part")).sortWithinPartitions("tail", "key", "text").select("key", "text", "doc_id", "tail")


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "edited_in_text double, text_in_edited double"
)


def fingerprints(docs: DataFrame, s: Sketch = Sketch()) -> DataFrame:
    """Columns of SCHEMA: sketches of every text and of its edited text, and how alike they are."""

    def rows(batches):
        for batch in batches:
            yield from zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)

    def block(part: list[tuple]):
        """``part``: documents in order, the last of which is only the next of the one before."""
        edited = []
        for (_, t, _), (_, u, _) in zip(part, part[1:], strict=False):
            cut = len(t) // 4
            edited.append((t[: len(t) - cut] + u[:cut]).encode("utf-8", "surrogatepass"))
        own = sketches([t.encode("utf-8", "surrogatepass") for _, t, _ in part], s)
        new = sketches(edited, s)
        out = []
        for i, e in enumerate(edited):
            near, inside, around = likeness(new[i], own[i])
            out.append((part[i][0], len(part[i][1]), hashlib.sha256(e).hexdigest(), written(own[i]), written(new[i]), near, likeness(own[i], own[i + 1])[0], inside, around))
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches):
        part, size, ended = [], 0, False
        for doc_id, text, tail in rows(batches):
            if ended:
                continue
            part.append((doc_id, text, tail))
            size += len(text)
            ended = bool(tail)
            if len(part) > 1 and (size > tk.BLOCK or ended):
                yield block(part)
                part, size = part[-1:], len(part[-1][1])
        if len(part) > 1:
            yield block(part)

    return in_order(docs).mapInArrow(run, SCHEMA)


def op5_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
