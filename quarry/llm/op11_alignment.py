"""Alignment of two tokenizers' tokens, as joins and windows of Spark.

Tokens are exploded with their positions, and running sums of their byte lengths give their ends. Both tokenizers'
tokens of a text are put in one order by their ends, where those that both share lie next to each other; their
running count numbers the groups. Between two ends next to each other lies one token of each tokenizer, and any two
tokens that overlap have one such place: the links are read off in the same order, so that no group's tokens all
meet each other, and a text's tokens are sorted and passed through once.

Neither tokenizer has a token over a place where a blank or a line break follows a character that is no white
space: the first one's words take a blank at their start only, and no piece of the second holds a word mark or a
line break after other characters (both are checked). Texts are cut there into stretches, and a stretch has the
same tokens in every text. So a narrow first pass cuts each block of texts into its different stretches and every
text into their numbers, and the joins and windows above run once for each different stretch of the corpus. Its
result takes along the places that hold it, a number in a block each, and goes back to their texts by an equi-join
on block and number, which are dealt out by block, so that a frequent word is one row of each block and never one
hot key.

Documents that hold a linked pair are counted from the different stretches of each document.

Defined results: null and empty texts, and texts of whose bytes a tokenizer loses some (such as a text with the
word mark itself), have no tokens, zeros and an empty string of groups, and do not count; equal rows are
documents of their own; rows without a doc_id are aligned like others; texts of any length are aligned whole, and
what is kept of one at once is in proportion to it; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm import textkit as tk
from quarry.llm.shared import Stash, cleaned, table

BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of text of a block; bits of its number within a task.
BLOCK, CHUNKS = 8 << 20, 11
#: How tables in buckets are written; numbers that rise within a row are kept as differences.
PACKED = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", **{f"parquet.enable.dictionary#{c}.list.element": "false" for c in ("units", "places")}}
#: Documents of a partition that are folded in memory, about those of a block; more are sorted.
FOLDED = 5000
#: Different pairs up to which their counts are sent to every task; beyond it they are shuffled.
SENT_PAIRS = 300_000

# White space of Unicode: no cut after it. In ASCII all up to 0x20, otherwise the last two bytes.
_SPACE_ENDS = {0xC2: (0x85, 0xA0), 0x9A: (0x80,), 0x80: (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF), 0x81: (0x9F,)}
_SPACED = np.zeros((256, 256), bool)
_SPACED[:, : 0x21] = True
for _before, _last in _SPACE_ENDS.items():
    _SPACED[_before, list(_last)] = True


def _byte_alphabet() -> dict[str, int]:
    """Characters of a byte-level vocabulary: printable Latin-1 for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


class Tokenizers:
    """Both tokenizers and their tokens' bytes. The files are read by the driver; tasks get their contents."""

    def __init__(self, byte_file: str = BYTE_BPE, piece_file: str = PIECE_BPE):
        with open(byte_file, encoding="utf-8") as f:
            self.byte_model = f.read()
        with open(piece_file, "rb") as f:
            self.piece_model = f.read()
        self._load()

    def __getstate__(self):
        return {"byte_model": self.byte_model, "piece_model": self.piece_model}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._load()

    def _load(self) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        spec = json.loads(self.byte_model)
        cut = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or cut.get("type") != "ByteLevel" or not cut.get("use_regex") or cut.get("add_prefix_space"):
            raise ValueError("the first tokenizer is not a plain byte-level one")
        self.first = Tokenizer.from_str(self.byte_model)
        self.first.encode_special_tokens = True
        alphabet = _byte_alphabet()
        self.a = [b""] * self.first.get_vocab_size()
        for piece, i in spec["model"]["vocab"].items():
            self.a[i] = bytes(alphabet[c] for c in piece)
        self.second = sp = sentencepiece.SentencePieceProcessor(model_proto=self.piece_model)
        self.b = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.b.append(bytes([int(piece[3:5], 16)]))
                continue
            if MARK in piece.lstrip(MARK) or (len(piece) > 1 and "\n" in piece):
                raise ValueError("a piece holds a word mark or a line break after other characters")
            self.b.append(b"" if sp.is_control(i) or sp.is_unknown(i) else piece.replace(MARK, " ").encode())
        self.sizes = [np.array([len(t) for t in x], np.int64) for x in (self.a, self.b)]

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a text that begins with a blank, which the second tokenizer adds."""
        return self.first.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.second.encode(text[1:], num_threads=1)

    def encode(self, stretches: pa.Array) -> Iterator[tuple[np.ndarray, list | None]]:
        """Places of runs of stretches with (ids, where each begins) of both tokenizers, or None where bytes are lost.

        Stretches are encoded as one text as far as none ends in white space, behind a word of their own that
        keeps the added blank away; the others, and all if that text loses bytes, are encoded one by one.
        """
        data, at = tk.buffers(stretches)
        plain = np.flatnonzero(~_SPACED[data[np.maximum(at[1:] - 2, 0)], data[at[1:] - 1]])
        alone = np.setdiff1d(np.arange(len(stretches)), plain)
        words = stretches.take(pa.array(plain))
        cuts = self._cuts(" ." + "".join(words.to_pylist()), np.append(2, 2 + np.cumsum(np.diff(at)[plain])))
        if cuts is None:
            alone = np.arange(len(stretches))
        elif len(words):
            yield plain, cuts
        for i in alone.tolist():
            text = " ." + stretches[i].as_py()
            yield np.array([i]), self._cuts(text, np.array([2, len(text.encode())]))

    def _cuts(self, text: str, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """(ids, places of ``ends`` among the tokens' ends) of both; None if bytes are lost or a token crosses an end."""
        raw, found = text.encode(), []
        for ids, tokens, sizes in zip(self.ids(text), (self.a, self.b), self.sizes, strict=True):
            if b"".join(map(tokens.__getitem__, ids)) != raw:
                return None
            ids = np.array(ids, np.int32)
            at = np.append(0, np.cumsum(sizes[ids]))
            place = np.searchsorted(at, ends)
            if (at[place] != ends).any():
                return None
            found.append((ids[place[0] : place[-1]], (place - place[0]).astype(np.int32)))
        return found


def cut_texts(docs: DataFrame) -> DataFrame:
    """(block, row, doc_id, units, times, codes) of each text, and of each block a row with ``stretches``.

    ``units`` are the numbers of a text's different stretches, ``times`` how often each occurs, and ``codes`` the
    text itself, as places in ``units``.
    """

    def flush(part: list[tuple[pa.Array, pa.Array]], block: int) -> Iterator[pa.RecordBatch]:
        ids, texts = pa.concat_arrays([x for x, _ in part]), pa.concat_arrays([x for _, x in part])
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), None, texts)
        data, at = tk.buffers(pc.utf8_replace_slice(texts, 0, 0, " "))  # nulls stay empty
        before = np.append(np.uint8(32), data[:-1])
        begins = ((data == 0x20) | (data == 0x0A)) & ~_SPACED[np.append(np.uint8(32), before[:-1]), before]
        begins[at[:-1][at[:-1] < at[1:]]] = True
        starts = np.flatnonzero(begins)
        cut = np.append(starts, len(data))
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        n, first = len(ids), np.searchsorted(starts, at)
        row = np.repeat(np.arange(n), np.diff(first))
        own, code, times = np.unique(row << 32 | coded.indices.to_numpy(), return_inverse=True, return_counts=True)
        begin = np.searchsorted(own >> 32, np.arange(n + 1))
        lists = lambda cuts, values: pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.astype(np.int32)))
        none = lambda k: pa.nulls(k, pa.list_(pa.int32()))
        names = ["block", "row", "doc_id", "units", "times", "codes", "stretches"]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int32)), pa.array(np.arange(n, dtype=np.int32)), ids, lists(begin, own & 0xFFFFFFFF), lists(begin, times), lists(first, code - begin[row]), pa.nulls(n, pa.list_(pa.string()))], names)
        words = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), none(1), none(1), none(1), words], names)

    def run(batches):
        task, part, held, chunk = TaskContext.get().partitionId(), [], 0, 0
        if task >> (31 - CHUNKS):
            raise ValueError("too many tasks to number blocks")
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.large_string())
            for lo, hi, data, _ in tk.blocks(texts, BLOCK):
                if part and held + len(data) > BLOCK:
                    yield from flush(part, task << CHUNKS | chunk)
                    part, held, chunk = [], 0, chunk + 1
                    if chunk >> CHUNKS:
                        raise ValueError("too much text in one task to number blocks")
                part.append((ids.slice(lo, hi - lo), texts.slice(lo, hi - lo)))
                held += len(data)
        if part:
            yield from flush(part, task << CHUNKS | chunk)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "block int, row int, doc_id bigint, units array<int>, times array<int>, codes array<int>, stretches array<string>")


def tokenize(stretches: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """Of rows (stretch, places) (places, ok, a, an, b, bn): ids of both tokenizers and their byte lengths."""
    shipped = stretches.sparkSession.sparkContext.broadcast(tokenizers)  # of the size of the two files

    def run(batches):
        both = shipped.value
        for batch in batches:
            for lo, hi, _, _ in tk.blocks(batch.column(0)):
                for rows, found in both.encode(batch.column(0).slice(lo, hi - lo)):
                    columns = []
                    for side, sizes in enumerate(both.sizes):
                        ids, at = found[side] if found else (np.zeros(0, np.int32), np.zeros(2, np.int32))
                        columns += [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (ids, sizes[ids].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(lo + rows)), pa.array(np.full(len(rows), found is not None)), *columns], ["places", "ok", "a", "an", "b", "bn"])

    return stretches.select("stretch", "places").mapInArrow(run, "places array<bigint>, ok boolean, a array<int>, an array<int>, b array<int>, bn array<int>")


def dealt_once(spark: SparkSession, more: dict[str, str]) -> SparkSession:
    """A session with the settings of ``spark``, in which rows dealt out by text or by block are joined on further
    columns without being dealt out again, and in which a step's shuffle files go when it has been written."""
    other = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            other.conf.set(key, value)
    other.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    other.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    for key, value in more.items():
        other.conf.set(key, value)
    return other


def _dealt(df: DataFrame, stash: Stash, name: str, by: str, buckets: int) -> DataFrame:
    """The rows, written in buckets of a column, so that no later step deals them out by it again."""
    spark, made = df.sparkSession, f"alignment_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
    options = ", ".join(f"'{key}' '{value}'" for key, value in PACKED.items())
    spark.sql(f"CREATE TABLE {made} ({columns}) USING parquet OPTIONS ({options}) CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{stash.path(name)}'")
    with cleaned(spark):
        df.write.insertInto(made)
    out = stash.spark.table(made)
    spark.sql(f"DROP TABLE {made}")  # its files stay, and the rows' reader knows how they are dealt
    return out


def align(tokens: DataFrame, stash: Stash, name: str) -> DataFrame:
    """(uid, n_a, n_b, n_groups, groups, links, other columns) of each stretch; a link is the first id times 2**32 plus the second.

    From the last end to the first: of tokens that end at one place the second follows the first, and the last token
    seen of each side is the one that lies before the end.
    """
    parts = min(100_000, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    more = [c for c in tokens.columns if c not in ("uid", "ok", "a", "an", "b", "bn")]
    rows = tokens.filter("ok").repartition(parts, "uid").select("uid", *more, "an", "bn", F.size("a").alias("n_a"), F.posexplode(F.concat("a", "b")).alias("pos", "id"))
    once = [F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in more]
    behind = F.col("pos") >= F.col("n_a")
    size = F.when(behind, F.get("bn", F.col("pos") - F.col("n_a"))).otherwise(F.get("an", F.col("pos")))
    rows = rows.select("uid", *once, behind.cast("int").alias("side"), "pos", "id", size.alias("n"))
    rows = rows.withColumn("end", F.sum("n").over(W.partitionBy("uid", "side").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))

    down = W.partitionBy("uid").orderBy(F.desc("end"), "side")
    seen = down.rowsBetween(W.unboundedPreceding, 0)
    last = lambda side: F.last(F.when(F.col("side") == side, F.col("id")), ignorenulls=True).over(seen).cast("bigint")
    rows = rows.withColumns({"again": F.lead("end").over(down).eqNullSafe(F.col("end")), "shared": F.lag("end").over(down).eqNullSafe(F.col("end")), "first": last(0), "second": last(1)})
    rows = rows.withColumn("shared", F.col("again") | F.col("shared")).withColumn("part", F.count(F.when(F.col("again"), 1)).over(seen))
    link = F.when(~F.col("again"), F.shiftleft("first", 32) + F.col("second"))
    order = (F.col("side") - 2 * F.col("part")) * 2**32 + F.col("end")
    mark = F.when(~F.col("shared"), ",").when(F.col("side") == 0, "|").otherwise(";")
    pieces = F.sort_array(F.collect_list(F.struct(order.alias("order"), F.concat(F.col("id").cast("string"), mark).alias("piece"))))
    text = F.array_join(F.transform(pieces, lambda x: x["piece"]), "")
    out = rows.groupBy("uid").agg(
        F.count_if(F.col("side") == 0).cast("int").alias("n_a"), F.count_if(F.col("side") == 1).cast("int").alias("n_b"), F.count_if("again").alias("n_groups"), text.alias("groups"),
        F.collect_list(link).alias("links"), *(F.first(c, ignorenulls=True).alias(c) for c in more),
    )
    return _dealt(out, stash, name, "uid", parts)


def pair_counts(units: DataFrame, links: DataFrame, blocks: int) -> DataFrame:
    """(pair, n, top): documents that hold each linked pair, and whether no pair of its first id has more."""
    held = units.select("block", "row", F.explode("units").alias("unit"))
    held = held.join(links.repartition(blocks, "block").hint("shuffle_hash"), ["block", "unit"], "left")
    # a document is folded to its different pairs before any is shuffled
    held = held.groupBy("block", "row").agg(F.bool_and(F.col("links").isNotNull()).alias("ok"), F.collect_list("links").alias("links")).filter("ok")
    pairs = held.select(F.explode(F.array_distinct(F.flatten("links"))).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.withColumn("a", F.shiftright("pair", 32))
    most = pairs.groupBy(F.col("a").alias("first")).agg(F.max("n").alias("most"))
    return pairs.join(most, F.col("a") == F.col("first")).select("pair", "n", (F.col("n") == F.col("most")).alias("top"))


def align_documents(docs: DataFrame, byte_file: str = BYTE_BPE, piece_file: str = PIECE_BPE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), groups as text without its last mark."""
    session = dealt_once(docs.sparkSession, {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(FOLDED)})
    stash = Stash(docs.sparkSession, "alignment").seen_by(session)
    # written in buckets of blocks, so that no step deals texts out again; more buckets than tasks, so that few blocks share one
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    blocks = min(100_000, 4 * parts)
    by_text = stash.seen_by(dealt_once(docs.sparkSession, {"spark.sql.execution.useObjectHashAggregateExec": "false"}))  # rows are in order already
    cut = _dealt(cut_texts(docs), stash.seen_by(session), "cut", "block", blocks)
    texts = cut.filter("stretches IS NULL").select("block", "row", "doc_id", "units", "times", "codes")

    own = by_text.spark.read.schema(cut.schema).parquet(stash.path("cut")).filter("stretches IS NOT NULL")
    places = own.select(F.shiftleft(F.col("block").cast("bigint"), 32).alias("block"), F.posexplode("stretches").alias("unit", "stretch"))
    places = places.select("stretch", (F.col("block") + F.col("unit")).alias("place")).repartition(parts, "stretch")
    tokens = tokenize(places.groupBy("stretch").agg(F.collect_list("place").alias("places")), Tokenizers(byte_file, piece_file))
    tokens = by_text.keep(tokens.withColumn("uid", F.monotonically_increasing_id()), "tokens")
    aligned = align(tokens, stash, "aligned")
    stash.drop("tokens")

    at_block = (F.shiftright("place", 32).cast("int").alias("block"), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("unit"))
    links = aligned.select("links", F.explode("places").alias("place")).select(*at_block, "links")
    pairs = stash.keep(pair_counts(texts, links, blocks), "pairs")
    if pairs.limit(SENT_PAIRS + 1).count() <= SENT_PAIRS:
        pairs = F.broadcast(pairs)
    linked = aligned.select("uid", F.explode("links").alias("pair")).join(pairs, "pair")
    linked = linked.groupBy("uid").agg(F.sum("n").alias("count_sum"), F.count(F.when(F.col("top"), 1)).alias("n_best"))
    known = aligned.select("uid", "places", "n_a", "n_b", "groups").join(linked.hint("shuffle_hash"), "uid")
    known = known.withColumn("place", F.explode("places")).select(*at_block, "n_a", "n_b", "n_best", "count_sum", "groups")

    held = texts.select("block", "row", "times", F.posexplode("units").alias("pos", "unit")).select("block", "row", "pos", "unit", F.get("times", F.col("pos")).alias("times"))
    held = held.join(known.repartition(blocks, "block").hint("shuffle_hash"), ["block", "unit"], "left")
    sums = (F.sum(F.col(c) * F.col("times")).alias(c) for c in ("n_a", "n_b", "n_best", "count_sum"))
    held = held.groupBy("block", "row").agg(F.bool_and(F.col("n_a").isNotNull()).alias("ok"), *sums, F.collect_list("pos").alias("order"), F.collect_list(F.coalesce("groups", F.lit(""))).alias("own"))
    # mostly they come in order
    sorted_own = F.transform(F.sort_array(F.arrays_zip("order", "own")), lambda x: x["own"])
    held = held.withColumn("own", F.when(F.col("order") == F.sequence(F.lit(0), F.size("order") - 1), F.col("own")).otherwise(sorted_own)).drop("order")
    # a text's groups are those of its different stretches, put in its order
    held = texts.select("block", "row", "doc_id", "codes").join(held.filter("ok").hint("merge"), ["block", "row"], "left")
    held = held.withColumn("text", F.array_join(F.transform("codes", lambda i: F.get("own", i)), ""))
    # a group has one mark of its end; each end, of one side or of both, ends one link
    held = held.withColumn("n_groups", F.length("text") - F.length(F.replace("text", F.lit(";")))).withColumn("n_links", F.col("n_a") + F.col("n_b") - F.col("n_groups"))
    whole = (F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    return held.select("doc_id", *whole, F.coalesce(F.when(F.col("ok"), F.expr("left(text, length(text) - 1)")), F.lit("")).alias("groups"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align_documents(table(spark, sf_dir, "documents"))
    return out.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
