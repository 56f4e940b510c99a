"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch of texts are laid end to end and indexed by a suffix array; a binary
search of every piece of the vocabulary gives the range of suffixes where it occurs. Each occurrence
is an edge from its first to its last character. Edges are put in order of position, and relaxed: in
each round every segment joins neighbouring symbols that an edge of its best score spans, from the left
and without overlaps, until no edge spans two neighbours. For a BPE vocabulary, which joins one such pair
at a time, the result is the same: what a join makes possible has a worse score, so it comes after the
rest of the round. Where a piece can be part of one of a better score, a round joins only pairs so far
apart that nothing that follows from one reaches another.

A segment is a run of word marks and what follows up to the next mark. Pieces hold marks at their
start only (checked likewise), and characters that no longer piece holds, such as line breaks, join with
nothing, so segments are independent, and each is worked out once per batch. Segments of any length and
of any characters go the same way; places that no edge crosses divide them further.
Characters without a piece become their UTF-8 bytes. Decoding joins pieces and turns marks to spaces.

Defined results: null and empty texts have no ids; texts of any length are encoded whole; a mark
character in a text decodes as a space, as the format defines; repeated rows have equal ids; rows without
a doc_id are encoded like others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.shared import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Divides segments: no character.
GAP = 0x110000
#: Characters of new segments that are indexed at once, and segments whose ids a worker remembers.
CHUNK, REMEMBERED = 500_000, 400_000


class Vocabulary:
    """Pieces, ranks (0 is best; equal scores have equal ranks) and byte ids of a BPE model."""

    def __init__(self, model_file: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        usual = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.bytes = np.array([i for i in range(n) if sp.is_byte(i)], np.int32)
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        scores = np.array([sp.get_score(i) for i in usual])
        ranks = np.unique(-scores, return_inverse=True)[1]
        pieces = [sp.id_to_piece(i) for i in usual]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a word mark after other characters")
        self.rank = {p: int(r) for p, r in zip(pieces, ranks, strict=True)}
        self.id = {p: i for p, i in zip(pieces, usual, strict=True)}
        # ranks of pieces that, once joined, can be part of a piece of a better rank
        self.early = np.zeros(len(pieces) + 1, bool)
        for p, r in self.rank.items():
            for i in range(1, len(p)):
                if p[:i] in self.rank and p[i:] in self.rank:
                    for q in (p[:i], p[i:]):
                        if len(q) > 1 and self.rank[q] >= r:
                            self.early[self.rank[q]] = True
        longer = set("".join(p for p in pieces if len(p) > 1))
        alone = "".join(c for c in map(chr, range(32)) if c not in longer)
        self.cut = f"{MARK}+[^{MARK}{re.escape(alone)}]*|[^{MARK}{re.escape(alone)}]+|[{re.escape(alone)}]" if alone else f"{MARK}+[^{MARK}]*"
        self.longest = max(map(len, pieces))
        self.decoded = [b""] * n
        for p, i in self.id.items():
            self.decoded[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.bytes.tolist()):
            self.decoded[i] = bytes([b])
        self.decoded[sp.unk_id()] = " ⁇ ".encode()


class Matcher:
    """Encodes batches with a vocabulary; remembers the ids of segments seen before."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pattern = re.compile(vocabulary.cut)
        self.known: dict[str, bytes] = {}
        longer = sorted(p for p in vocabulary.rank if len(p) > 1)
        self.piece_rank = np.array([vocabulary.rank[p] for p in longer], np.int64)
        self.piece_id = np.array([vocabulary.id[p] for p in longer], np.int32)
        self.piece_len = np.array([len(p) for p in longer], np.int64)
        self.depth = -(-vocabulary.longest // 4) * 4
        points = np.zeros((len(longer), self.depth), np.uint32)
        for i, p in enumerate(longer):
            points[i, : len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
        self.points, piece_point = np.unique(points, return_inverse=True)
        self.piece_point = piece_point.reshape(points.shape)

    def single(self, symbol: str) -> bytes:
        found = self.v.id.get(symbol)
        return (self.v.bytes[list(symbol.encode("utf-8", "surrogatepass"))] if found is None else np.array([found], np.int32)).tobytes()

    def edges(self, text: np.ndarray) -> np.ndarray:
        """piece[position, length] that starts there, as 1 + its number, or 0.

        ``text`` holds code points, with GAP between segments.
        """
        n = len(text)
        alphabet = np.unique(text)
        bits = next(b for b in (8, 16, 32) if len(alphabet) < (1 << b) - 1)
        packed, top = 64 // bits, (1 << bits) - 1
        code = np.searchsorted(alphabet, text).astype(np.uint64) + np.uint64(1)
        padded = np.concatenate([code, np.zeros(self.depth, np.uint64)])
        keys = []
        for k in range(0, self.depth, packed):
            key = np.zeros(n, np.uint64)
            for j in range(k, min(k + packed, self.depth)):
                key = (key << np.uint64(bits)) | padded[j : j + n]
            keys.append(key)
        suffixes = np.lexsort(keys[::-1])
        keys = [k[suffixes] for k in keys]
        spot = np.minimum(np.searchsorted(alphabet, self.points), len(alphabet) - 1)
        code_of = np.where(alphabet[spot] == self.points, spot + 1, 0).astype(np.uint64)
        codes = code_of[self.piece_point]
        lengths = self.piece_len
        inside = np.arange(self.depth)[None] < lengths[:, None]
        here = np.flatnonzero(((codes > 0) | ~inside).all(1))
        codes, lengths, inside = codes[here], lengths[here], inside[here]

        def bound(fill: int) -> np.ndarray:
            """For each piece, the first suffix above the piece padded with ``fill``."""
            full = np.where(inside, codes, np.uint64(fill))
            want = []
            for k in range(0, self.depth, packed):
                key = np.zeros(len(here), np.uint64)
                for j in range(k, min(k + packed, self.depth)):
                    key = (key << np.uint64(bits)) | full[:, j]
                want.append(key)
            lo, hi = np.zeros(len(here), np.int64), np.full(len(here), n, np.int64)
            while len(lo) and (lo < hi).any():
                mid = np.minimum((lo + hi) // 2, n - 1)
                less, same = np.zeros(len(here), bool), np.ones(len(here), bool)
                for have, w in zip(keys, want, strict=True):
                    h = have[mid]
                    less |= same & (h < w)
                    same &= h == w
                go = (less | (same if fill else False)) & (lo < hi)
                hi = np.where(go | (lo >= hi), hi, mid)
                lo = np.where(go, mid + 1, lo)
            return lo

        begin, end = bound(0), bound(top)
        total = end - begin
        which = np.repeat(np.arange(len(here)), total)
        at = suffixes[np.repeat(begin, total) + np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)]
        # edges in order of position, then of length: each has a cell of its own
        table_ = np.zeros(n * (self.v.longest + 1), np.int32)
        table_[at * (self.v.longest + 1) + lengths[which]] = here[which] + 1
        return table_

    def join(self, segments: list[str]) -> list[bytes]:
        """Ids of the segments."""
        text = np.frombuffer(("\0".join(segments) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        sizes = np.array([len(s) for s in segments], np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        text[first + sizes] = GAP
        edge, none, wide = self.edges(text), 2**31 - 1, self.v.longest
        rank = np.append(none, self.piece_rank)
        segment = np.repeat(np.arange(len(segments)), sizes)
        start = np.arange(len(segment)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[segment]
        end = start + 1
        # a place that no edge crosses ends a part: nothing joins over it
        at, span = np.divmod(np.flatnonzero(edge), wide + 1)
        crossed = np.zeros(len(text) + 1, np.int64)
        np.add.at(crossed, at + 1, 1)
        np.add.at(crossed, at + span, -1)
        crossed = np.cumsum(crossed) > 0
        part = np.cumsum(~crossed[start] | np.append(True, segment[1:] != segment[:-1])) if len(start) else start
        early = np.append(self.v.early, False)

        def clear(of: np.ndarray, place: np.ndarray) -> np.ndarray:
            """Whether the candidate before, if of the same part, is out of reach."""
            far = np.append(True, (of[1:] != of[:-1]) | (place[1:] - place[:-1] >= 2 * wide))
            return far[: len(place)]

        done_s, done_e = [], []
        while len(start):
            m = len(start)
            best = np.full(m, none, np.int64)
            span = end[1:] - start[:-1]
            ok = np.flatnonzero((part[1:] == part[:-1]) & (span <= wide))
            best[ok] = rank[edge[start[ok] * (wide + 1) + span[ok]]]
            head = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            size = np.diff(np.append(head, m))
            least = np.minimum.reduceat(best, head)
            live = least < none
            gone = np.repeat(~live, size)
            if gone.any():
                done_s.append(start[gone]), done_e.append(end[gone])
            # of a run of candidates that follow each other, every other one from the left
            hit = (best == np.repeat(least, size)) & ~gone
            pick = np.flatnonzero(hit)
            opens = np.append(True, pick[1:] != pick[:-1] + 1)[: len(pick)]
            turn = np.arange(len(pick)) - np.maximum.accumulate(np.where(opens, np.arange(len(pick)), 0))
            pick = pick[np.where(early[best[pick]], clear(part[pick], start[pick]), turn % 2 == 0)]
            end[pick] = end[pick + 1]
            gone[pick + 1] = True
            start, end, part = start[~gone], end[~gone], part[~gone]
        s, e = np.concatenate(done_s), np.concatenate(done_e)
        order = np.argsort(s)
        s, e = s[order], e[order]
        ids, count = np.empty(len(s), np.int32), np.ones(len(s), np.int64)
        multi = e - s > 1
        ids[multi] = self.piece_id[edge[s[multi] * (wide + 1) + (e - s)[multi]] - 1]
        points, back = np.unique(text[s[~multi]], return_inverse=True)
        lone = [self.single(chr(c)) for c in points.tolist()]
        ids[~multi] = np.array([np.frombuffer(x, np.int32)[0] for x in lone], np.int32)[back] if lone else 0
        count[~multi] = np.array([len(x) // 4 for x in lone], np.int64)[back] if lone else 1
        if (count > 1).any():  # characters that become several bytes
            many = np.flatnonzero(count > 1)
            tail = [np.frombuffer(self.single(chr(c)), np.int32)[1:] for c in text[s[many]].tolist()]
            ids = np.insert(ids, np.repeat(many + 1, count[many] - 1), np.concatenate(tail))
        edge_of = np.append(0, np.cumsum(count))
        cut = (4 * edge_of[np.append(np.searchsorted(s, first), len(s))]).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def learn(self, segments: set[str]) -> None:
        part, chars = [], 0
        for s in segments:
            part.append(s)
            chars += len(s) + 1
            if chars >= CHUNK:
                self.known.update(zip(part, self.join(part), strict=True))
                part, chars = [], 0
        if part:
            self.known.update(zip(part, self.join(part), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.pattern.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set()
        for c in cut:
            new.update(c)
        if len(self.known) > REMEMBERED:  # what this batch uses stays
            self.known = {s: self.known[s] for s in new.intersection(self.known)}
        self.learn(new.difference(self.known))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, c)), np.int32) for c in cut]


def decode(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    raw = b"".join(map(vocabulary.decoded.__getitem__, ids.tolist()))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def groups(texts: list[str | None], chars: int = 3 << 19):
    """(first, end) of runs of texts of about so many characters."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= chars:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def encode_documents(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_pieces, round_trip): a narrow map; ``round_trip``: decoding gave the text again.

    The model is read on the driver; its pieces, of a size fixed by the vocabulary, go to the executors.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_file))

    def run(batches):
        matcher = Matcher(shipped.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in groups(texts):
                part = texts[lo:hi]
                ids = matcher.encode(part)
                same = [decode(shipped.value, i) == (t or "").replace(MARK, " ") for i, t in zip(ids, part, strict=True)]
                sizes = np.array([len(i) for i in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists, pa.array(sizes), pa.array(same)], ["doc_id", "ids", "n_pieces", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>, n_pieces bigint, round_trip boolean")


def op2_sentencepiece_suffix_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: documents with their ids."""
    return encode_documents(docs)
