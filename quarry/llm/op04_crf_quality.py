"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line is described by shares of symbols, capitals, digits and pipes, by repetition, word counts and
lengths, each also taken from the line before and the line after. Labels are of documents, so labels of
training lines are worked out first: a regression from a line's own features to its document's label gives each line's odds; a line is labelled by them and by its document's label, which counts
``Fit.trust`` in log odds, so that a bad document may have good lines and a good one bad lines; a document
whose lines would all contradict its label keeps it at its most likely line. The field is fitted to these
labels and their neighbourhoods. Forward-backward gives each line's marginal probability of being good;
their mean, weighted by line length, is calibrated by a logistic curve into the document's score.

The field is fitted on at most ``Fit.max_documents`` labelled documents whose crc32(doc_id) mod 3 is
not 1, whole ones: in the order of a hash, so that the layout of the input does not matter, a document
is passed over if the sample would have more than ``Fit.max_bytes`` bytes with it, or more than
``Fit.max_lines`` lines for each of ``Fit.max_documents``.

Defined results: null and empty texts have one empty line and get that line's score; a null doc_id is
never a training row and not held out; of several texts under one labelled doc_id the one of the least
digest is learned from; repeated rows get equal scores; with no labels, or only one
label, every score is the share of label 1 (0.5 without any); extra columns are ignored by the query and
kept by the stage, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import textkit as tk
from quarry.llm.shared import Stash, table, unused

HELD_OUT_MOD, HELD_OUT = 3, 1


@dataclass(frozen=True)
class Fit:
    max_documents: int = 3000
    max_lines: int = 200
    max_bytes: int = 1 << 25
    rounds: int = 60
    rate: float = 0.25
    ridge: float = 1e-4
    trust: float = 1.0


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL, UPPER, DIGIT, PIPE, BANG = _class(b"#*$%&|<>@^~_{}[]\\"), _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b"|"), _class(b"!?")
STOP = _class(b".!?:;\"')")
N_OWN = 12


def line_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, weights, where each row's lines begin) for a block of rows."""
    rows = len(at) - 1
    breaks = np.flatnonzero(data == 10)
    row = np.concatenate([np.arange(rows), np.searchsorted(at, breaks, "right") - 1])
    starts = np.concatenate([at[:-1], breaks + 1])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = np.append(starts[1:] - 1, 0)
    final = np.append(row[1:] != row[:-1], True)
    ends[final] = at[row[final] + 1]
    first = np.searchsorted(row, np.arange(rows + 1))

    words = tk.Words(data, at)
    point = (data & 0xC0) != 0x80
    span = np.column_stack([starts, ends]).ravel()

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        part = total[span].reshape(-1, 2)
        return (part[:, 1] - part[:, 0]).astype(np.float64)

    chars, solid = per_line(point), per_line(point & words.solid)
    lo, hi = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    n_words = (hi - lo).astype(np.float64)
    line_of_word = np.repeat(np.arange(len(lo)), hi - lo)
    key = tk.mix(words.hash + line_of_word.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    sort = np.argsort(key, kind="stable")
    again = sort[1:][key[sort[1:]] == key[sort[:-1]]] if len(sort) else sort
    repeated = np.bincount(line_of_word[again], minlength=len(lo)).astype(np.float64)
    near = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (line_of_word[1:] == line_of_word[:-1])) + 1
    adjacent = np.bincount(line_of_word[near], minlength=len(lo)).astype(np.float64)
    line_key = tk.mix(words.rolling.of(starts, ends) + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    sort = np.argsort(line_key, kind="stable")
    copy = np.zeros(len(lo))
    copy[sort[1:][line_key[sort[1:]] == line_key[sort[:-1]]]] = 1.0
    copy[n_words == 0] = 0.0
    tail = np.zeros(len(lo))
    full = ends > starts
    tail[full] = STOP[data[ends[full] - 1]]
    c, w = np.maximum(solid, 1.0), np.maximum(n_words, 1.0)
    own = np.column_stack([
        np.ones(len(lo)), per_line(SYMBOL[data]) / c, per_line(UPPER[data]) / c, per_line(DIGIT[data]) / c, per_line(PIPE[data]) / w,
        np.minimum(per_line(BANG[data]) / w, 2.0), adjacent / w, repeated / w, np.log1p(n_words) / 4, np.minimum(solid / w, 40.0) / 10, copy, tail,
    ])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0.0
    after[first[1:] - 1] = 0.0
    return np.hstack([own, before, after]), np.maximum(chars, 1.0), first


def forward_backward(unary: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of label 1 per line, expected counts of the 2x2 transitions).

    ``unary`` is the log odds of label 1. Rows are walked side by side, the longest first, so a step
    of the chain is one vector operation over all rows that still have a line there.
    """
    n_lines = np.diff(first)
    by_length = np.argsort(-n_lines, kind="stable")
    begin, lengths = first[:-1][by_length], n_lines[by_length]
    steps = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(steps), "left") if steps else np.zeros(0, int)  # rows with more than t lines
    up = np.exp(np.clip(unary, -30, 30))
    a = np.exp(trans - trans.max())
    forward, backward = np.empty((len(unary), 2)), np.ones((len(unary), 2)) / 2
    for t in range(steps):
        i = begin[: alive[t]] + t
        p = np.full((alive[t], 2), 0.5) if t == 0 else forward[i - 1] @ a
        p[:, 1] *= up[i]
        forward[i] = p / p.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        i = begin[: alive[t + 1]] + t
        q = backward[i + 1].copy()
        q[:, 1] *= up[i + 1]
        joint = forward[i][:, :, None] * a[None] * q[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        q = q @ a.T
        backward[i] = q / q.sum(1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(1), pairs


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    slope: float
    offset: float

    def lines(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, weight, first = line_features(data, at)
        return forward_backward(x @ self.weights, first, self.trans)[0], weight, first

    def score(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, number of lines, number of lines labelled bad) per row."""
        p, weight, first = self.lines(data, at)
        mean = np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        bad = np.add.reduceat((p < 0.5).astype(np.int64), first[:-1])
        return 1 / (1 + np.exp(-(self.slope * mean + self.offset))), np.diff(first), bad


def _adam(value: np.ndarray, gradient: np.ndarray, state: list, rate: float, t: int) -> np.ndarray:
    state[0] = 0.9 * state[0] + 0.1 * gradient
    state[1] = 0.99 * state[1] + 0.01 * gradient**2
    return value - rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)


def line_labels(x: np.ndarray, first: np.ndarray, y_doc: np.ndarray, fit: Fit) -> np.ndarray:
    """A label for each training line, which may differ from its document's; neighbours have no say yet."""
    x = x[:, :N_OWN]
    y = np.repeat(y_doc, np.diff(first))
    weights, state = np.zeros(x.shape[1]), [0.0, 0.0]
    for t in range(1, fit.rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        weights = _adam(weights, x.T @ (p - y) / len(y) + fit.ridge * weights, state, fit.rate, t)
    odds = x @ weights
    out = (odds + fit.trust * (2 * y - 1) >= 0).astype(np.float64)
    toward = odds * (2 * y - 1)
    lost = np.flatnonzero(np.add.reduceat((out == y).astype(np.int64), first[:-1]) == 0)
    for d in lost.tolist():
        out[first[d] + int(np.argmax(toward[first[d] : first[d + 1]]))] = y_doc[d]
    return out


def train(texts: list[str | None], quality: list[int], fit: Fit = Fit()) -> Model:
    """Maximum likelihood of the line labels, then the calibration of the documents' means."""
    y_doc = np.array(quality, np.float64)
    if not len(y_doc) or y_doc.min() == y_doc.max():
        share = np.clip(y_doc.mean() if len(y_doc) else 0.5, 1e-3, 1 - 1e-3)
        return Model(np.zeros(3 * N_OWN), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    parts = [line_features(data, at) for _, _, data, at in tk.blocks(pa.array([t or "" for t in texts], pa.string()))]
    x, weight = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    first = np.append(0, np.cumsum(np.concatenate([np.diff(p[2]) for p in parts])))
    n = len(x)
    y = line_labels(x, first, y_doc, fit)
    inner = np.ones(n, bool)
    inner[first[:-1]] = False  # lines with one before them
    inner = np.flatnonzero(inner)
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[inner - 1].astype(np.int64), y[inner].astype(np.int64)), 1)
    model = Model(np.zeros(x.shape[1]), np.zeros((2, 2)), 1.0, 0.0)
    states = ([0.0, 0.0], [0.0, 0.0])
    for t in range(1, fit.rounds + 1):
        p, pairs = forward_backward(x @ model.weights, first, model.trans)
        model.weights = _adam(model.weights, x.T @ (p - y) / n + fit.ridge * model.weights, states[0], fit.rate, t)
        model.trans = np.clip(_adam(model.trans, (pairs - observed) / n, states[1], fit.rate, t), -4, 4)
    p, _ = forward_backward(x @ model.weights, first, model.trans)
    mean = np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps of a ridge-regularised logistic curve
        q = 1 / (1 + np.exp(-(slope * mean + offset)))
        r = q * (1 - q)
        g = np.array([((q - y_doc) * mean).sum() + 0.01 * slope, (q - y_doc).sum()])
        h = np.array([[(r * mean * mean).sum() + 0.01, (r * mean).sum()], [(r * mean).sum(), r.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return Model(model.weights, model.trans, float(slope), float(offset))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_MOD == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """The bounded sample: distinct labelled ids outside the held-out third, lowest hash first."""
    ids = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit.max_documents)
    )
    # at most max_documents small rows, so the broadcast has a fixed bound
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", F.struct(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text").alias("t"), "quality")
    return rows.groupBy("doc_id", "quality").agg(F.min("t").alias("t")).select("doc_id", "t.text", "quality")


def fit_model(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    sample = Stash(docs.sparkSession, "quality").keep(training_rows(docs, labels, fit), "sample")
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = sample.select("doc_id", F.octet_length(text).alias("bytes"), (F.regexp_count(text, F.lit("\n")) + 1).alias("lines")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    room, lines, chosen = fit.max_bytes, fit.max_lines * fit.max_documents, []
    for r in sizes:
        if r.bytes <= room and r.lines <= lines:
            room, lines, chosen = room - r.bytes, lines - r.lines, [*chosen, r.doc_id]
    rows = sample if len(chosen) == len(sizes) else sample.filter(F.col("doc_id").isin(chosen))
    rows = sorted(rows.collect(), key=lambda r: r.doc_id)
    return train([r.text for r in rows], [r.quality for r in rows], fit)


def score_documents(docs: DataFrame, model: Model, names: tuple[str, ...] = ("score", "predicted", "n_lines", "n_bad_lines")) -> DataFrame:
    """``docs`` with four columns of these names added, in place of columns that have them; a narrow map without shuffle."""
    kept = [c for c in docs.columns if c not in names]
    docs = docs.select(*kept)
    spot = kept.index("text")
    schema = T.StructType([*docs.schema, *(T.StructField(n, t) for n, t in zip(names, (T.DoubleType(), T.IntegerType(), T.LongType(), T.LongType()), strict=True))])

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in tk.blocks(batch.column(spot)):
                score, lines, bad = model.score(data, at)
                part = batch.slice(lo, hi - lo)
                extra = [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(lines), pa.array(bad)]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*kept, *names])

    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    model = fit_model(docs, labels, fit)
    out = score_documents(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_lines", "n_bad_lines")


def op4_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go.

    Every row is judged by its own text, so repeated rows stay or go together, and rows without a doc_id
    are judged like others; null and empty texts have the score of an empty line. An empty table gives an
    empty one; all columns, whatever their names, are kept as they are.
    """
    model = fit_model(docs, table(spark, sf_dir, "labels"))
    names = unused(docs, "score", "predicted", "n_lines", "n_bad_lines")
    return score_documents(docs, model, tuple(names)).filter(F.col(names[1]) == 1).select(*docs.columns)
