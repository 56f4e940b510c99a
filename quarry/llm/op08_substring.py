"""Substring dedup: words in windows that also start in an earlier document are removed.

Two operators share this module.

``against_reference`` streams documents through suffix automata of reference shards: the automaton's
matching statistics give, at every word, the longest reference passage that ends there, and maximal
spans of the threshold or more are removed. Shards are built on the executors, of a bounded number of
words each, and written; they are broadcast one after the other, so that memory is bounded by a shard
whatever the reference's size, and the spans of all shards are united by document.

``earlier_windows`` dedups a corpus against itself. With automata every document would pass through
the shards of the whole corpus, work in the square of its size (README: measured figures), so its
windows are matched by shuffles instead. Each window of 50 words is named by the least
hash among its runs of ten words. Names that occur in one document only cannot belong to a repeated
window, so only windows with a shared name are hashed and shuffled, by 94 bits of two independent
hashes, and the smallest doc_id of each decides. No window is left out: equal windows have equal names.

Defined results: a null or empty text has no words; rows repeated with one doc_id are one document each
time, and no repeat of each other, whether their texts are equal or not; rows without a doc_id come
last, keep their words, and remove none; shorter texts than a window are kept whole; extra columns are
ignored; an empty table gives an empty result, an empty reference removes nothing.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import textkit as tk
from quarry.llm.shared import Stash, table

WINDOW, RUN = 50, 10


class SuffixAutomaton:
    """Of a sequence of word hashes; separate passages are divided by None."""

    def __init__(self, words: Iterable[int | None] = ()):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.last = 0
        for w in words:
            self.add(w)

    def add(self, word: int | None) -> None:
        if word is None:  # a passage ends: the next one starts at the root
            self.last = 0
            return
        step = self.next[self.last].get(word)
        if step is not None and self.length[step] == self.length[self.last] + 1:
            self.last = step  # known from an earlier passage
            return
        state, p = len(self.next), self.last
        self.next.append({})
        self.length.append(self.length[p] + 1)
        self.link.append(0)
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            if self.length[q] == self.length[p] + 1:
                self.link[state] = q
            else:
                copy = len(self.next)
                self.next.append(dict(self.next[q]))
                self.length.append(self.length[p] + 1)
                self.link.append(self.link[q])
                while p >= 0 and self.next[p].get(word) == q:
                    self.next[p][word] = copy
                    p = self.link[p]
                self.link[q] = self.link[state] = copy
                if step == q:
                    state = copy
        self.last = state

    def statistics(self, words: list[int]) -> list[int]:
        """For each word, the length of the longest passage of the reference that ends there."""
        out, state, length = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            step = self.next[state].get(w)
            if step is None:
                state = length = 0
            else:
                state, length = step, length + 1
            out.append(length)
        return out


def covered(lengths: list[int], least: int) -> np.ndarray:
    """Flags of the words in passages of ``least`` words or more, from matching statistics."""
    n = len(lengths)
    change = np.zeros(n + 1, np.int64)
    for end, k in enumerate(lengths):
        if k >= least:
            change[end - k + 1] += 1
            change[end + 1] -= 1
    return np.cumsum(change[:n]) > 0


def _result(ids: pa.Array, data: np.ndarray, words: tk.Words, drop: np.ndarray) -> pa.RecordBatch:
    raw, starts, ends = data.tobytes(), words.starts.tolist(), words.ends.tolist()
    keep = np.flatnonzero(~drop)
    cut = np.searchsorted(keep, words.first)
    digests = []
    for i in range(len(words.first) - 1):
        digests.append(hashlib.sha256(b" ".join([raw[starts[j] : ends[j]] for j in keep[cut[i] : cut[i + 1]].tolist()])).hexdigest())
    total = np.diff(words.first)
    return pa.RecordBatch.from_arrays([ids, pa.array(total), pa.array(total - np.diff(cut)), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


SHARD = "shard bigint, automaton binary"


def build_shards(reference: DataFrame, shard_words: int) -> DataFrame:
    """SHARD: pickled automata of about ``shard_words`` words of ``reference`` (text) each, built where the texts lie."""

    def run(batches):
        part, number = [], 0
        for batch in batches:
            for lo, hi, data, at in tk.blocks(batch.column(0)):
                words = tk.Words(data, at)
                for i in range(hi - lo):
                    part += [*words.hash[words.first[i] : words.first[i + 1]].tolist(), None]
                    if len(part) >= shard_words:
                        yield _packed(number, SuffixAutomaton(part))
                        part, number = [], number + 1
        if part:
            yield _packed(number, SuffixAutomaton(part))

    return reference.select("text").mapInArrow(run, SHARD)


def _packed(number: int, a: SuffixAutomaton) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pickle.dumps((a.next, a.link, a.length))], pa.binary())], ["shard", "automaton"])


def against_reference(docs: DataFrame, reference: DataFrame, least: int = WINDOW, shard_words: int = 200_000) -> DataFrame:
    """SCHEMA, after the removal of all passages of ``least`` words or more that the reference (text) has.

    The driver holds one shard at a time; a pass over ``docs`` for each shard writes the spans found in it.
    """
    spark = docs.sparkSession
    stash = Stash(spark, "reference")
    rows = stash.keep(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "rows")
    shards = stash.keep(build_shards(reference, shard_words).withColumn("place", F.monotonically_increasing_id()), "shards")
    spans_schema, any_shard = "row bigint, start int, end int", False
    for (place,) in shards.select("place").toLocalIterator():
        sent = spark.sparkContext.broadcast(shards.filter(F.col("place") == place).head().automaton)  # at most one shard

        def run(batches, sent=sent):
            a = SuffixAutomaton()
            a.next, a.link, a.length = pickle.loads(sent.value)
            for batch in batches:
                for lo, hi, data, at in tk.blocks(batch.column(1)):
                    words, out = tk.Words(data, at), []
                    for i in range(hi - lo):
                        lengths = a.statistics(words.hash[words.first[i] : words.first[i + 1]].tolist())
                        drop = np.concatenate([[0], covered(lengths, least).astype(np.int8), [0]])
                        turns = np.flatnonzero(np.diff(drop)).tolist()
                        out += [(batch.column(0)[lo + i].as_py(), s, e) for s, e in zip(turns[::2], turns[1::2], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["row", "start", "end"])

        stash.keep(rows.select("row", "text").mapInArrow(run, spans_schema), f"spans/shard={place}")
        any_shard = True
        sent.unpersist()
    found = spark.read.schema(spans_schema).parquet(stash.path("spans")) if any_shard else spark.createDataFrame([], spans_schema)
    spans = found.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))

    def remove(batches):
        for batch in batches:
            for lo, hi, data, at in tk.blocks(batch.column(1)):
                words = tk.Words(data, at)
                change = np.zeros(len(words) + 1, np.int64)
                for i in range(hi - lo):
                    for span in batch.column(2)[lo + i].as_py() or ():
                        change[words.first[i] + span["start"]] += 1
                        change[words.first[i] + span["end"]] -= 1
                yield _result(batch.column(0).slice(lo, hi - lo), data, words, np.cumsum(change[:-1]) > 0)

    return rows.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(remove, SCHEMA)


def names_of(words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """(starts of windows, their names): the least hash of the runs of RUN words in each window."""
    starts, value = words.windows(RUN)
    if not len(starts):
        return starts, value
    span = WINDOW - RUN + 1
    low, have = value.copy(), 1
    while have < span:  # least of so many runs from each start
        step = min(have, span - have)
        low[: len(low) - step] = np.minimum(low[: len(low) - step], low[step:])
        have += step
    whole = words.left()[starts] >= WINDOW
    return starts[whole], low[whole]


def earlier_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, windows): hashes of the windows that also start in a document of a smaller doc_id."""
    stash = Stash(docs.sparkSession, "substring")

    def names(batches):
        for batch in batches:
            for lo, hi, data, at in tk.blocks(batch.column(1)):
                words = tk.Words(data, at)
                starts, name = names_of(words)
                row = words.rows()[starts]
                order = np.lexsort((name, row))
                row, name = row[order], name[order].view(np.int64)
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (name[1:] != name[:-1])
                row, name = row[fresh], name[fresh]
                first = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(first), pa.array(name))], ["doc_id", "names"])

    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    named = stash.keep(rows.mapInArrow(names, "doc_id bigint, names array<bigint>").filter(F.size("names") > 0), "names").select("doc_id", F.explode("names").alias("name"))
    shared = named.groupBy("name").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("name")
    asked = stash.keep(named.join(shared, "name").groupBy("doc_id").agg(F.collect_set("name").alias("names")), "asked")
    stash.drop("names")

    def windows(batches):
        for batch in batches:
            for lo, hi, data, at in tk.blocks(batch.column(1)):
                words = tk.Words(data, at)
                starts, name = names_of(words)
                row = words.rows()[starts]
                hit = among(row, name, batch.column(2).slice(lo, hi - lo))
                starts, row = starts[hit], row[hit]
                rolling = tk.Rolling(words.hash)
                value = rolling.of(starts, starts + WINDOW)
                order = np.lexsort((value, row))  # each window of a row once
                fresh = np.append(True, (row[order][1:] != row[order][:-1]) | (value[order][1:] != value[order][:-1]))[: len(order)]
                starts, row, value = starts[order][fresh], row[order][fresh], value[order][fresh]
                check = tk.Rolling(tk.mix(words.hash)).of(starts, starts + WINDOW)
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(value.view(np.int64)), pa.array((check >> np.uint64(32)).astype(np.uint32).view(np.int32))], ["doc_id", "window", "check"])

    window = stash.keep(rows.join(asked, "doc_id").select("doc_id", "text", "names").mapInArrow(windows, "doc_id bigint, window bigint, check int"), "windows")
    first = window.groupBy("window", "check").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("window", "check", "lo")
    again = window.join(first, ["window", "check"]).filter("doc_id > lo").select("doc_id", "window")
    done = stash.keep(again.groupBy("doc_id").agg(F.collect_set("window").alias("windows")), "again")
    stash.drop("asked", "windows")
    return done


def among(row: np.ndarray, value: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Flags of the values that the list of their row holds; a null list holds none."""
    size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    salt = lambda r: tk.mix(r.astype(np.uint64) + np.uint64(1))
    keys = np.unique(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) ^ salt(np.repeat(np.arange(len(lists)), size)))
    if not len(keys) or not len(row):
        return np.zeros(len(row), bool)
    own = value ^ salt(row)
    return keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own


def dedup_passages(docs: DataFrame) -> DataFrame:
    """SCHEMA over every row of ``docs``. A row loses the windows of its own text that were found again
    under its doc_id, so rows that share a doc_id do not take each other's."""
    again = earlier_windows(docs)

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in tk.blocks(batch.column(1)):
                words = tk.Words(data, at)
                starts, value = words.windows(WINDOW)
                begin = starts[among(words.rows()[starts], value, batch.column(2).slice(lo, hi - lo))]
                change = np.zeros(len(words) + 1, np.int64)
                change[begin] += 1
                change[begin + WINDOW] -= 1
                yield _result(batch.column(0).slice(lo, hi - lo), data, words, np.cumsum(change[:-1]) > 0)

    return docs.select("doc_id", "text").join(again, "doc_id", "left").mapInArrow(run, SCHEMA)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents"))
