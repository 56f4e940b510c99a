"""Token counts from flat token files, by a scan for end-of-document identifiers.

A token file is nothing but little-endian 16-bit identifiers; identifier 0 ends a document. Files of any
size are read in byte ranges: Spark's text reader cuts them into splits, and with one byte as its line
end the lines of a split, that byte put back between them, are the split's bytes exactly. A task walks
them in blocks of fixed size. A split begins after a line end, so whether its first byte is the low or the
high one of an identifier is not known yet: each block reports the separators of both readings, found
with one vectorised comparison. A prefix scan over the small totals of the blocks (bytes so far, and
where the document that is still open began) picks the reading and stitches documents that run across
blocks and splits, however many; places of separators do not pass through it.

``write_token_files`` makes such files from texts with a byte-level BPE vocabulary (its identifiers
plus one). Spark's own text writer puts them down, with the separator as its line end, so any file
system will do. Each document may begin with ``HEADER`` identifiers that hold its doc_id.

Defined results: null and empty texts are documents of no tokens; a null doc_id comes back as null;
repeated rows are documents of their own; an empty table or folder gives an empty result; a file that
does not end with a separator ends with an open document (``terminated`` false); extra columns are
ignored. An odd last byte of a file is not a token. A file that begins with the bytes EF BB BF, which
Spark's reader takes for a mark of encoding and leaves out, raises an error; files with a header never do.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.shared import Stash, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary's texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END, HEADER, NO_ID = 0, 5, 50_257
BLOCK_BYTES = 1 << 18
_encoders: dict[int, object] = {}


def encoder(raw: bytes):
    """Of the vocabulary in ``raw`` (a line of base64 and rank each); built once per worker."""
    key = hash(raw)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in raw.splitlines() if line)}
        if max(ranks.values()) + 1 >= NO_ID:
            raise ValueError("identifiers do not fit 16 bits beside the separator")
        _encoders[key] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def header_of(doc_id: int | None) -> list[int]:
    """Five identifiers, none of them the separator: digits of 13 bits, lowest first."""
    if doc_id is None:
        return [NO_ID] * HEADER
    x = doc_id & (1 << 64) - 1
    return [(x >> 13 * i & 8191) + 1 for i in range(HEADER)]


def write_token_files(docs: DataFrame, path: str, ranks_file: str = RANKS, with_header: bool = True) -> None:
    """Files of tokens under ``path``, a document of the table after the other."""
    with open(ranks_file, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())  # of the vocabulary's size

    def run(batches):
        encode = encoder(shipped.value).encode_ordinary
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(ids), 500):
                rows = []
                for i, t in zip(ids[lo : lo + 500], texts[lo : lo + 500], strict=True):
                    tokens = np.array(encode(t) if t else [], np.uint16) + np.uint16(1)
                    rows.append((np.array(header_of(i), "<u2").tobytes() if with_header else b"") + tokens.astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["tokens"])

    flat = docs.select("doc_id", "text").mapInArrow(run, "tokens binary")
    flat.select(F.col("tokens").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\0\0").text(path)


#: The byte that Spark's reader takes as a line end; no pattern of bytes makes one byte ambiguous.
LINE = b"\n"
SUMMARY = "file bigint, split bigint, block int, n_bytes bigint, file_bytes bigint, first binary, even struct<ends:array<bigint>,heads:array<binary>>, odd struct<ends:array<bigint>,heads:array<binary>>"


def _separators(raw: np.ndarray, at: int, stop: int, header: int) -> dict:
    """Offsets behind the separators that begin in raw[at:stop:2], and the bytes of the headers that follow."""
    low = raw[at:stop:2]
    high = raw[at + 1 : stop + 1 : 2]
    ends = at + 2 * np.flatnonzero((low[: len(high)] == END) & (high == END)) + 2
    return {"ends": ends, "heads": [raw[e : e + 2 * header].tobytes() for e in ends.tolist()] if header else [b""] * len(ends)}


def summaries(spark: SparkSession, path: str, header: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block: its size, the separators of both readings, its first bytes.

    ``file`` is a hash of the path. A separator belongs to the block where it begins; an identifier whose
    bytes lie in two splits begins with the line end, so it is none.
    """
    if block_bytes % 2 or block_bytes < 2 * max(1, header):
        raise ValueError("a block is an even number of bytes and holds a header")
    lines = spark.read.option("lineSep", LINE.decode()).schema("value string").text(path)
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    part = pa.struct([("ends", pa.list_(pa.int64())), ("heads", pa.list_(pa.binary()))])
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), part, part]

    def walk(batches):
        """((file, split, size), bytes of lines) of runs of lines of one split."""
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            turns = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *turns.tolist()], [*turns.tolist(), len(batch)], strict=True):
                if hi > lo:
                    yield tuple(keys[lo].tolist()), LINE.join([*batch.column(3).slice(lo, hi - lo).to_pylist(), b""])

    def run(batches):
        key, held, block, rows = None, b"", 0, []

        def take(own: int) -> None:
            """The next ``own`` bytes as a block; the held ones behind them complete its identifiers and headers."""
            nonlocal held, block
            raw = np.frombuffer(held, np.uint8)
            rows.append((key[0], key[1], block, own, key[2], held[: 2 * header], _separators(raw, 0, own, header), _separators(raw, 1, own, header)))
            held, block = held[own:], block + 1

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return out

        for of, raw in walk(batches):
            if of != key:
                if held:
                    take(len(held))
                key, held, block = of, b"", 0
            at = 0
            while at < len(raw):  # no more than two blocks are held, however long the lines
                step = raw[at : at + 2 * block_bytes]
                held, at = held + step, at + len(step)
                while len(held) >= 2 * block_bytes:
                    take(block_bytes)
                    if len(rows) >= 16:
                        yield flush()
        if held:
            take(len(held))
        if rows:
            yield flush()

    return lines.mapInArrow(run, SUMMARY)


def token_counts(spark: SparkSession, path: str, header: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, start, n_tokens, terminated, head) of every document: ``file`` is xxhash64 of the file's path, ``head`` the header's identifiers."""
    stash = Stash(spark, "separators")
    rows = stash.keep(summaries(spark, path, header, block_bytes), "blocks")
    h = 2 * header
    # the scan sees a few numbers of each block: its size, its last separator in both readings, its first bytes
    last = lambda name: F.when(F.size(f"{name}.ends") > 0, F.struct(F.element_at(f"{name}.ends", -1).alias("end"), F.element_at(f"{name}.heads", -1).alias("head")))
    small = rows.select("file", "split", "block", "n_bytes", "file_bytes", "first", last("even").alias("even"), last("odd").alias("odd"))
    order = "PARTITION BY file ORDER BY split, block"
    before = f"{order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    after = f"{order} ROWS BETWEEN 1 FOLLOWING AND {max(h, 1)} FOLLOWING"
    small = small.withColumn("at", F.expr(f"coalesce(sum(n_bytes) OVER ({before}), 0L)"))
    small = small.withColumn("following", F.expr(f"array_join(transform(collect_list(first) OVER ({after}), x -> hex(x)), '')"))
    small = small.withColumn("last_here", F.when(F.col("at") % 2 == 0, F.col("even")).otherwise(F.col("odd")))
    whole = lambda raw, rest: F.unhex(F.left(F.concat(F.hex(raw), rest), F.lit(2 * h)))
    small = small.withColumn("opens", F.when(F.col("last_here").isNotNull(), F.struct((F.col("at") + F.col("last_here.end")).alias("start"), whole(F.col("last_here.head"), F.col("following")).alias("head"))))
    small = small.withColumn("open", F.expr(f"last_value(opens) IGNORE NULLS OVER ({before})"))
    small = small.withColumn("begin", F.expr(f"first_value(struct(first, following)) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    small = small.withColumn("open", F.coalesce("open", F.struct(F.lit(0).cast("bigint").alias("start"), whole(F.col("begin.first"), F.col("begin.following")).alias("head"))))
    small = small.withColumn("is_last", F.expr(f"lead(n_bytes) OVER ({order}) IS NULL"))
    # the last line may end with the file instead of a line end, which was put behind it; a separator may
    # begin in a block and end in the next one
    total = F.col("at") + F.col("n_bytes")
    extra = total - F.col("file_bytes")
    right = ~F.col("is_last") | extra.isin(0, 1)
    small = small.withColumn("stop", F.when(right, F.when(F.col("is_last"), F.col("file_bytes")).otherwise(total + 1)).otherwise(F.raise_error(F.lit("a token file begins with a mark of encoding"))))
    placed = stash.keep(small.select("file", "split", "block", "at", "stop", "is_last", "open", "following"), "placed")
    # heavy rows meet their place by block; every document ends in one block
    each = rows.select("file", "split", "block", "even", "odd").join(placed, ["file", "split", "block"])
    mine = F.when(F.col("at") % 2 == 0, F.col("even")).otherwise(F.col("odd"))
    each = each.withColumn("mine", mine).withColumn("ends", F.transform(F.filter("mine.ends", lambda e: e + F.col("at") <= F.col("stop")), lambda e: e + F.col("at")))
    closed = F.element_at(F.concat(F.array("open.start"), F.col("ends")), -1)
    rest = F.col("is_last") & (F.col("stop") - F.col("stop") % 2 > closed)  # tokens behind the last separator of the file
    each = each.withColumn("rest", rest)
    each = each.withColumn("ends", F.when(F.col("rest"), F.concat("ends", F.array(F.col("stop") - F.col("stop") % 2 + 2))).otherwise(F.col("ends")))
    each = each.select("file", "open", "following", "mine", "ends", "rest", F.posexplode("ends").alias("i", "end"))
    previous = F.greatest(F.col("i") - 1, F.lit(0))
    start = F.when(F.col("i") == 0, F.col("open.start")).otherwise(F.get("ends", previous))
    head = F.when(F.col("i") == 0, F.col("open.head")).otherwise(whole(F.get("mine.heads", previous), F.col("following")))
    ids = F.transform(F.sequence(F.lit(1), F.lit(max(header, 1))), lambda k: F.conv(F.concat(F.substring(F.hex(head), 4 * k - 1, F.lit(2)), F.substring(F.hex(head), 4 * k - 3, F.lit(2))), 16, 10).cast("int"))
    ids = F.slice(ids, 1, header) if header else F.array().cast("array<int>")
    terminated = ~F.col("rest") | (F.col("i") < F.size("ends") - 1)
    n = F.greatest(F.floor((F.col("end") - start) / 2) - 1 - header, F.lit(0))
    return each.select("file", F.floor(start / 2).alias("start"), n.cast("bigint").alias("n_tokens"), terminated.alias("terminated"), ids.alias("head"))


def doc_id_of(head) -> F.Column:
    """The doc_id that a header holds."""
    digits = F.lit(0).cast("bigint")
    for i in range(HEADER):
        digits = digits.bitwiseOR(F.shiftleft((F.element_at(head, i + 1) - 1).cast("bigint"), 13 * i))
    return F.when(F.element_at(head, 1) != NO_ID, digits)


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Stash(spark, "tokens").path("flat")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return token_counts(spark, path, HEADER).select(doc_id_of(F.col("head")).alias("doc_id"), "n_tokens", "terminated")
