"""MinHash near-dedup: BagMinHash signatures of shingle multisets, bands, and verified overlap.

A document is the multiset of its shingles of five words. The weight axis of a shingle is cut at
1, 2, 4, 8, ...; each dyadic interval below its count carries a Poisson process over (time, weight,
signature slot) that depends only on shingle and interval. The hierarchy is this dyadic cut: an interval
that the count cuts is not split further, its points above the count are thinned out instead, which is
the same process at the discretisation step of 1 and costs at most twice the points of the last interval.
So the same point is seen or not seen by each document according to its count alone. A slot keeps its
earliest point; two signatures agree in a slot with a probability that equals the weighted Jaccard
similarity. All shingles of a block advance one point at a time until no later point can be the earliest
of any slot; a count of c has log2(c) + 1 processes.

Whole-text copies are folded first. Signatures are cut into bands. Shingles that no other candidate has
cannot overlap, which bounds every similarity from above: documents with too many are set aside. Links
are found in three turns, each followed by the components of the links so far:
1. every document with one other: of the centres of its buckets (in one order over all documents, so the
   buckets of a group have the same few) the first;
2. every document with the other centres of its buckets, where their components differ;
3. in buckets that still hold several components, documents of different components that share a shingle
   among their rarest: two multisets that reach the threshold must share one of the first
   n - ceil(threshold * n) + 1 shingles of each in any common order (prefix filter), and have enough left
   from there on, so no link is missed, and frequent shingles and those of one component are not among them;
   of each document one pair with each other component is compared first, then those that are still apart.
The first two turns make at most a number of pairs for each document; the third joins what is left by rare
shingles only; members of one component are not paired again, and of the links between two components one counts.

Defined results: null texts equal empty texts; texts without words are a class by whole text; texts of
one to four words are one shingle; a document is a doc_id with a text, so repeated rows are one document,
and different texts under one doc_id are documents each; rows without a doc_id are documents of their
own, have a class by their text, and their class is named by its smallest doc_id, or, if it has none, by
a negative number; an empty table gives an empty result; extra columns are ignored (stage: kept).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import textkit as tk
from quarry.llm.components import components
from quarry.llm.shared import Stash, table, unused


@dataclass(frozen=True)
class Params:
    """At similarity 0.8, 24 bands of 4 slots miss a link with probability 3e-6."""

    shingle: int = 5
    threshold: float = 0.8
    bands: int = 24
    slots: int = 4
    seed: int = 7

    @property
    def size(self) -> int:
        return self.bands * self.slots


def shingles(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count), sorted by row and hash."""
    words = tk.Words(data, at)
    starts, value = words.windows(width)
    n = np.diff(words.first)
    tiny = np.flatnonzero((n > 0) & (n < width))
    rolling = tk.Rolling(words.hash)
    row = np.concatenate([words.rows()[starts], tiny])
    value = np.concatenate([value, rolling.of(words.first[tiny], words.first[tiny + 1])])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    head = np.flatnonzero(new)
    return row[head], value[head], np.diff(np.append(head, len(row)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(row: np.ndarray, value: np.ndarray, count: np.ndarray, rows: int, p: Params) -> np.ndarray:
    """uint64[rows, size]: per slot a hash of the earliest point; rows without shingles are zero."""
    k = p.size
    best = np.full(rows * k, np.inf)
    owner = np.zeros(rows * k, np.uint64)
    # one process for each interval of the weight axis that begins below the count
    n_intervals = 1 + np.ceil(np.log2(count.astype(np.float64))).astype(np.int64)
    src = np.repeat(np.arange(len(row)), n_intervals)
    level = np.arange(len(src)) - np.repeat(np.cumsum(n_intervals) - n_intervals, n_intervals)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1.0))
    width = np.where(level == 0, 1.0, low)
    state = tk.mix(value[src] + np.uint64(p.seed) + (level.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
    who, weight, time = row[src], count[src].astype(np.float64), np.zeros(len(src))
    filled = np.zeros(rows, np.int64)
    worst = np.full(rows, np.inf)
    step = 0
    while len(state):
        step += 1
        draw = tk.mix(state + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log(_uniform(draw)) / width
        more = tk.mix(draw ^ np.uint64(0xE7037ED1A0B428DB))
        alive = time < worst[who]
        inside = low + width * _uniform(tk.mix(more + np.uint64(1))) < weight
        use = np.flatnonzero(alive & inside)
        slot = who[use] * k + (more[use] % np.uint64(k)).astype(np.int64)
        order = np.lexsort((time[use], slot))
        slot, use = slot[order], use[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        slot, use = slot[first], use[first]
        better = time[use] < best[slot]
        slot, use = slot[better], use[better]
        np.add.at(filled, slot[np.isinf(best[slot])] // k, 1)
        best[slot] = time[use]
        owner[slot] = more[use]
        touched = np.unique(slot // k)
        touched = touched[filled[touched] == k]
        worst[touched] = best.reshape(rows, k)[touched].max(1)
        keep = np.flatnonzero(time < worst[who])
        state, who, weight, time, low, width = state[keep], who[keep], weight[keep], time[keep], low[keep], width[keep]
    return owner.reshape(rows, k)


def band_hashes(signature: np.ndarray, p: Params) -> np.ndarray:
    """int64[rows, bands]"""
    parts = signature.reshape(len(signature), p.bands, p.slots)
    out = np.broadcast_to(np.arange(p.bands, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3), parts.shape[:2])
    for s in range(p.slots):
        out = tk.mix(out + parts[:, :, s])
    return out.view(np.int64)


def _banded(docs: DataFrame, p: Params) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo, hi, data, at in tk.blocks(batch.column(1)):
                row, value, count = shingles(data, at, p.shingle)
                bands = band_hashes(signatures(row, value, count, hi - lo, p), p)
                has = np.zeros(hi - lo, bool)
                has[row] = True
                bands = bands[has]
                flat = pa.array(bands.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * p.bands), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).filter(pa.array(has)), lists], ["doc_id", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, bands array<bigint>")


def _multisets(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, items, size): sorted hashes of (shingle, occurrence), so multiset overlap is set overlap."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in tk.blocks(batch.column(1)):
                row, value, count = shingles(data, at, p.shingle)
                src = np.repeat(np.arange(len(row)), count)
                nth = np.arange(len(src)) - np.repeat(np.cumsum(count) - count, count)
                item = tk.mix(value[src] + nth.astype(np.uint64) * np.uint64(0x589965CC75374CC3)).view(np.int64)
                order = np.lexsort((item, row[src]))
                first = np.searchsorted(row[src], np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(first), pa.array(item[order]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["doc_id", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, items array<bigint>")


def _verified(pairs: DataFrame, items: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose multisets overlap by the threshold or more."""
    left = items.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    right = items.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i) for i in range(4))
            keep = np.zeros(len(batch), bool)
            xs, ys = x.flatten().to_numpy(zero_copy_only=False), y.flatten().to_numpy(zero_copy_only=False)
            xo = np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))])
            yo = np.concatenate([[0], np.cumsum(y.value_lengths().to_numpy(zero_copy_only=False))])
            for i in range(len(batch)):
                u, v = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
                at = np.searchsorted(u, v)
                same = int((u[np.minimum(at, len(u) - 1)] == v).sum()) if len(u) else 0
                keep[i] = same >= p.threshold * (len(u) + len(v) - same) - 1e-9
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], ["a", "b"])

    return joined.mapInArrow(run, "a bigint, b bigint")


def _possible(p: Params) -> F.Column:
    """Whether documents of (na, ua) and (nb, ub) shingles and shingles of their own can reach the threshold.

    What no other candidate has cannot overlap, which bounds the similarity from above.
    """
    most = F.least(F.col("na") - F.col("ua"), F.col("nb") - F.col("ub"))
    return most >= F.lit(p.threshold) * (F.col("na") + F.col("nb") - most) - 1e-9


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _prefixes(open_: DataFrame, each: DataFrame, p: Params) -> DataFrame:
    """(item, doc_id, root, n, left): the first shingles of ``open_`` (doc_id, root, n), and how many are left from each on.

    ``each`` (doc_id, item) has the shingles. Those of one component only come first in a document's order,
    then the others from the rarest on.
    Of shingles that the very same documents hold, the first stands for all, which is the same one in each of
    them: near copies share long runs of such shingles, and would meet at every one.
    """
    held = each.join(open_, "doc_id")
    who = F.struct(F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(p.seed))).alias("y"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    split = held.groupBy("item").agg(F.count(F.lit(1)).alias("holders"), F.min("root").alias("lo"), F.max("root").alias("hi"), who.alias("who")).filter("lo < hi").select("item", "holders", "who")
    ranked = held.join(split, "item").groupBy("doc_id", "root", "n").agg(F.array_sort(F.collect_list(F.struct("holders", "item", "who"))).alias("items"))
    length = F.col("n") - F.ceil(F.lit(p.threshold) * F.col("n") - 1e-9) + 1
    own = F.col("n") - F.size("items")
    prefix = F.slice("items", F.lit(1), F.greatest(length - own, F.lit(0)).cast("int"))
    first = ranked.select("doc_id", "root", "n", own.alias("own"), F.posexplode(prefix).alias("place", "x"))
    first = first.groupBy("doc_id", "root", "n", "own", "x.holders", "x.who").agg(F.min(F.struct("place", "x.item")).alias("x"))
    return first.select("x.item", "doc_id", "root", "n", (F.col("n") - F.col("own") - F.col("x.place")).alias("left"))


def _rare_pairs(open_: DataFrame, each: DataFrame, p: Params) -> DataFrame:
    """Pairs of ``open_`` (doc_id, root, n) in different components that could reach the threshold.

    A pair is met at the first shingle that both have; from there on neither may have fewer left than the
    overlap that the threshold asks for (prefix and positional filter).
    """
    first = _prefixes(open_, each, p)
    one = first.select("item", F.col("doc_id").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("left").alias("la"))
    two = first.select("item", F.col("doc_id").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("left").alias("lb"))
    enough = F.least("la", "lb") * (1 + p.threshold) >= F.lit(p.threshold) * (F.col("na") + F.col("nb")) - 1e-9
    return one.join(two, "item").filter((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & enough).select("a", "b").distinct()


def _roots(rows: DataFrame, chosen: DataFrame, p: Params, stash: Stash) -> DataFrame:
    """(node, root) of the rows (doc_id, text) among ``chosen`` (doc_id), of which no two have the same text,
    that are linked with another. Texts are shuffled once, to meet the ids of bucket members."""
    bands = stash.keep(_banded(rows, p), "bands")
    band = bands.join(chosen, "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("band"))
    crowd = band.groupBy("band").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("band")
    bucket = stash.keep(band.join(crowd, "band"), "bucket")
    stash.drop("bands")
    items = stash.keep(_multisets(rows.join(bucket.select("doc_id").distinct(), "doc_id", "left_semi"), p), "items")
    each = items.select("doc_id", F.explode("items").alias("item"))
    # u: shingles that one candidate alone has
    lone = each.groupBy("item").agg(F.count(F.lit(1)).alias("holders"), F.min("doc_id").alias("doc_id")).filter("holders = 1")
    lone = lone.groupBy("doc_id").agg(F.count(F.lit(1)).alias("u"))
    traits = items.select("doc_id", F.size("items").cast("bigint").alias("n")).join(lone, "doc_id", "left").select("doc_id", "n", F.coalesce("u", F.lit(0)).alias("u"))
    # a document with too many of its own is like no other
    able = stash.keep(bucket.join(traits.filter(F.col("n") - F.col("u") >= F.lit(p.threshold) * F.col("n") - 1e-9), "doc_id"), "able")
    stash.drop("bucket")
    bucket = able
    # the member with the least of its own is the centre of its bucket, in an order that all buckets share
    order = F.struct((F.col("u") / F.col("n")).alias("share"), F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("u").alias("ua"))
    centre = bucket.groupBy("band").agg(F.min(order).alias("c"))
    member = bucket.select("band", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("u").alias("ub"))
    asked = member.join(centre, "band").select("b", "nb", "ub", "c", "c.*").filter(F.col("a") != F.col("b")).filter(_possible(p))
    asked = stash.keep(asked.select("b", "c").distinct(), "asked")
    pairs = stash.keep(_ordered(asked.groupBy("b").agg(F.min("c").alias("c")).select("b", "c.a")), "pairs-1")
    links = stash.keep(_verified(pairs, items, p), "links-1")
    root = components(links, stash, "turn-1")

    def apart(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of different components, with these."""
        of = lambda name: root.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
        rows = pairs.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
        rows = rows.select("a", "b", F.coalesce("root_a", "a").alias("ra"), F.coalesce("root_b", "b").alias("rb"))
        return rows.filter(F.col("ra") != F.col("rb"))

    def grown(found: DataFrame, turn: str) -> DataFrame:
        """The components with the links ``found``: as many links as there are nodes and pairs of components, however many lead from one to another."""
        between = apart(found).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        return components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(between), stash, turn)

    rest = apart(asked.select("b", "c.a"))
    pairs = stash.keep(_ordered(rest.select("a", "b")).join(pairs, ["a", "b"], "left_anti"), "pairs-2")
    found = stash.keep(_verified(pairs, items, p), "links-2")
    if found.limit(1).count():
        root = grown(found, "turn-2")
    tagged = bucket.join(root.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("band", "doc_id", "n", F.coalesce("root", "doc_id").alias("root"))
    mixed = tagged.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("band")
    open_ = stash.keep(tagged.join(mixed, "band").select("doc_id", "root", "n").distinct(), "open")
    # of each document one pair with each other component first: what these link is not compared again
    rare = stash.keep(_rare_pairs(open_, each, p), "rare")
    pairs = stash.keep(apart(rare).groupBy("a", "rb").agg(F.min("b").alias("b")).select("a", "b"), "pairs-3")
    found = stash.keep(_verified(pairs, items, p), "links-3")
    if found.limit(1).count():
        root = grown(found, "turn-3")
    pairs = stash.keep(apart(rare).select("a", "b").join(pairs, ["a", "b"], "left_anti"), "pairs-4")
    found = stash.keep(_verified(pairs, items, p), "links-4")
    if found.limit(1).count():
        root = grown(found, "turn-4")
    return root


def keyed(docs: DataFrame, key: str, stash: Stash) -> DataFrame:
    """``docs`` with a key of each row: its doc_id where that is one, else a number, written to stay with its row."""
    n, distinct = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).head()
    if n == distinct:
        return docs.withColumn(key, F.col("doc_id"))
    return stash.keep(docs.withColumn(key, F.monotonically_increasing_id()), "rows")


def row_classes(rows: DataFrame, params: Params = Params()) -> DataFrame:
    """(row, doc_id, rep, root) of every row of ``rows`` (row, doc_id, text), ``row`` a key: the least row with
    the same text, and the least of all with texts linked to it."""
    stash = Stash(rows.sparkSession, "near-dedup")
    text = F.coalesce("text", F.lit(""))
    ids = rows.select("row", "doc_id", F.sha2(text, 256).alias("digest"))
    member = stash.keep(ids.join(ids.groupBy("digest").agg(F.min("row").alias("rep")), "digest").select("row", "doc_id", "rep"), "member")
    # copies of a text are alike whatever their signatures: only one goes on
    root = _roots(rows.select(F.col("row").alias("doc_id"), text.alias("text")), member.filter("row = rep").select(F.col("row").alias("doc_id")), params, stash)
    return member.join(root.select(F.col("node").alias("rep"), "root"), "rep", "left").select("row", "doc_id", "rep", F.coalesce("root", "rep").alias("root"))


def near_duplicates(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, class_id, rep_id, is_class_rep, n_class) of every document: class_id is the smallest doc_id of
    the class, ``rep_id`` the smallest with the very same text."""
    stash = Stash(docs.sparkSession, "near-dedup-rows")
    classes = row_classes(keyed(docs.select("doc_id", "text"), "row", stash), params)
    one = F.when(F.col("doc_id").isNull(), F.col("row"))
    documents = stash.keep(classes.groupBy("doc_id", "rep", one.alias("one")).agg(F.min("root").alias("root")), "documents")
    name = lambda key: F.coalesce(F.min("doc_id"), -1 - F.first(key))
    same = documents.groupBy("rep").agg(name("rep").alias("rep_id"))
    whole = documents.groupBy("root").agg(name("root").alias("class_id"), F.count(F.lit(1)).alias("n_class"))
    out = documents.join(same, "rep").join(whole, "root")
    return out.select("doc_id", "class_id", "rep_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("is_class_rep"), "n_class")


def op3_bagminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each class stays, that of the smallest doc_id.

    Rows are classed by their texts under keys of their own, so rows without a doc_id take part (and stay
    only where no row with one is like them), repeated rows leave one, and different texts under one
    doc_id are judged each for itself. Null and empty texts are copies of each other. An empty table gives
    an empty one; all columns, whatever their names, are kept.
    """
    stash = Stash(spark, "keep-one")
    (key,) = unused(docs, "row")
    rows = keyed(docs, key, stash)
    classes = row_classes(rows.select(F.col(key).alias("row"), "doc_id", "text"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row")))
    stay = classes.groupBy("root").agg(least.alias("first")).select(F.col("first.row").alias(key))
    return rows.join(stay, key, "left_semi").select(*docs.columns)
