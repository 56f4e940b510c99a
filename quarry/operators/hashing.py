"""Embeddings by feature hashing: words, their stems' marks and character grams in a vector of fixed width."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tx

WORD = re.compile(tx.WORD_OR_NUMBER)
STOP = frozenset(tx.CONTENT_STOPWORDS)
#: Width, gram sizes and weights.
WIDTH, GRAMS, GRAM_WEIGHT, KEY_BOOST, STEM_WEIGHT, KEY_TERMS = 384, (3, 4, 5), 0.35, 1.6, 0.4, 8
#: Words and grams that a worker remembers, words that are added up at once, and bytes of texts that are read at once.
REMEMBERED, WORDS, READ = 1 << 18, 1 << 16, 1 << 20


class Places:
    """Where words, their stem marks and their grams go. A word is numbered when it is first seen; words share most grams."""

    def __init__(self, width: int = WIDTH):
        self.width, self.grams = width, {}
        self.forget()

    def forget(self) -> None:
        self.known, self.content = {}, np.zeros(0, bool)
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def place(self, feature: str) -> int:
        return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big") % self.width

    def numbers(self, words: list[str]) -> np.ndarray:
        """Of words, some of them new. What is remembered is bounded, but for the words of one call."""
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new and len(self.known) + len(new) > REMEMBERED:
            self.forget()
            new = list(dict.fromkeys(words))
        if len(self.grams) > REMEMBERED:
            self.grams = {}
        if new:
            flat, sizes, grams = [], [], self.grams
            content = [len(w) >= 2 and "a" <= w[0] <= "z" and w not in STOP for w in new]
            for word in new:
                self.known[word] = len(self.known)
                framed = f"<{word}>"
                cut = [framed[at : at + size] for size in GRAMS for at in range(max(1, len(framed) - size + 1))]
                for gram in cut:
                    if gram not in grams:
                        grams[gram] = self.place(gram)
                flat += [self.place(word), self.place(f"{word}~stem"), *map(grams.__getitem__, cut)]
                sizes.append(2 + len(cut))
            self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.content = np.concatenate([self.content, np.array(content, bool)])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def vector(text: str, width: int = WIDTH) -> np.ndarray:
    return _vectors([Counter(WORD.findall(text))], Places(width))[0]


def _vectors(counts: list[Counter], places: Places) -> np.ndarray:
    """Of texts' words in their order; unit length, or zeros without words. The most frequent content words count for more."""
    words, sizes = list(chain.from_iterable(counts)), np.fromiter(map(len, counts), np.int64, len(counts))
    n = np.fromiter(chain.from_iterable(c.values() for c in counts), np.int64, len(words))
    doc = np.repeat(np.arange(len(counts)), sizes)
    number, out, weight = places.numbers(words), np.zeros(len(counts) * places.width), 1.0 + np.log(n)
    weight[_most(doc, n, np.flatnonzero(places.content[number]))] *= KEY_BOOST
    for lo in range(0, len(words), WORDS):
        run = slice(lo, lo + WORDS)
        start, many = places.starts[number[run]], np.diff(places.starts)[number[run]]
        first = np.cumsum(many) - many
        at = places.flat[np.repeat(start - first, many) + np.arange(many.sum())] + np.repeat(doc[run] * places.width, many)
        adds = np.repeat(GRAM_WEIGHT * n[run], many)
        adds[first], adds[first + 1] = weight[run], weight[run] * STEM_WEIGHT
        np.add.at(out, at, adds)  # in the order of the words
    out = out.reshape(len(counts), places.width)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0).astype(np.float32)


def _most(doc: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the places ``at`` those of each text's KEY_TERMS largest counts; ties: in the order of the text."""
    most = int(n[at].max(initial=0))
    order = at[np.argsort(doc[at] * (most + 1) + most - n[at], kind="stable")]
    return order[np.arange(len(order)) - np.searchsorted(doc[order], doc[order]) < KEY_TERMS]


def embed(docs: DataFrame, key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(key, embedding) of every row of (key, text), in Arrow batches: the digest is no function of Spark's. Null texts get zeros."""
    lower = F.lower(F.coalesce("text", F.lit("")))
    rows = docs.select(key, lower.alias("text"))

    def run(batches):
        places = Places(width)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_numpy().astype(np.int64) + width
            cuts = [0, *np.flatnonzero(np.diff(np.cumsum(sizes) // READ)) + 1, len(batch)]
            for lo, hi in pairwise(cuts):
                part = batch.slice(lo, hi - lo)
                flat = _vectors([Counter(WORD.findall(t)) for t in part.column(1).to_pylist()], places).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, "embedding"])

    return rows.mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, embedding array<float>")
