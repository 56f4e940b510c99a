"""Quality rules: repeated passages inside a document, found with a suffix array over its words.

The words of a block of documents form one array; suffixes are sorted by prefix doubling, of which
each round only touches suffixes that still tie. Longest common prefixes of neighbours come from the
ranks of all rounds. Intervals of that array are the repeated substrings; where they cannot be
extended to the left either, they are maximal. After the base rules, the share of words in the union of
their spans and the length of the longest one decide, and nothing else.

Defined results: a null or empty text has zero words, fails the base rules and has no spans; repeated
rows are judged each by itself; other columns of the input, whatever their names, are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import textkit as tk
from quarry.llm.shared import table

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """Limits. ``span_words``: the shortest repeat whose span counts as covered."""

    min_words: int = 50
    max_repeat_percent: int = 50
    span_words: int = 10
    max_covered: float = 0.40
    max_longest: int = 200


def suffix_array(words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, lcp) over the words of a block; lcp[j] is shared by entries j-1 and j.

    Suffixes end with their row and rows never tie, so prefixes are shared within a row only.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, left = words.rows(), words.left()
    key = tk.mix(words.hash + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group  # a rank is the place of its group's first suffix
    levels, width = [rank.copy()], 1
    size = np.bincount(group, minlength=n)
    active = np.flatnonzero(size[rank] > 1)
    while len(active):
        follows = active + width
        second = np.where(left[active] > width, rank[np.minimum(follows, n - 1)] + 1, 0)
        pair = rank[active] * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        active, pair = active[order], pair[order]
        m = len(active)
        old = rank[active]
        outer = np.ones(m, bool)
        outer[1:] = old[1:] != old[:-1]
        inner = np.ones(m, bool)
        inner[1:] = pair[1:] != pair[:-1]
        begin = np.maximum.accumulate(np.where(outer, np.arange(m), 0))
        sub = np.maximum.accumulate(np.where(inner, np.arange(m), 0))
        rank[active] = old + sub - begin
        sizes = np.bincount(sub, minlength=m)
        active = np.sort(active[sizes[sub] > 1])
        levels.append(rank.copy())
        width *= 2
    array = np.empty(n, np.int64)
    array[rank] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    at = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]]) + 1
    a, b, common = array[at - 1], array[at], np.zeros(len(at), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        inside = (left[a] > common) & (left[b] > common)
        x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        same = inside & (levels[t][x] == levels[t][y])
        common += same.astype(np.int64) << t
    lcp[at] = common
    return array, lcp


def covered_by(array: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """Flags of the words in the union of all repeats of ``least`` words or more."""
    n = len(array)
    reach = np.zeros(n, np.int64)
    reach[array] = np.maximum(lcp, np.append(lcp[1:], 0)) if n else 0
    start = np.flatnonzero(reach >= least)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + reach[start], -1)
    return np.cumsum(change[:n]) > 0


def maximal_repeats(words: tk.Words, array: np.ndarray, lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first entry, last entry) of the lcp intervals that are left-maximal, ``least`` words or more."""
    n, out = len(array), []
    if not n:
        return out
    before = np.where(np.isin(np.arange(n), words.first[:-1]), np.uint64(0), words.hash[np.maximum(np.arange(n) - 1, 0)])
    ahead = before[array]
    differs = np.zeros(n + 1, np.int64)
    differs[2:] = np.cumsum((ahead[1:] != ahead[:-1]) | (ahead[1:] == 0))

    def close(length: int, lo: int, hi: int) -> None:
        if differs[hi + 1] > differs[lo + 1]:
            out.append((length, lo, hi))

    stack: list[tuple[int, int]] = []
    last = -2
    for j in np.flatnonzero(lcp >= least).tolist():
        if j != last + 1:
            while stack:
                length, lo = stack.pop()
                close(length, lo, last)
        depth, lo = int(lcp[j]), j - 1
        while stack and stack[-1][0] > depth:
            length, lo = stack.pop()
            close(length, lo, j - 1)
        if not stack or stack[-1][0] < depth:
            stack.append((depth, lo))
        last = j
    while stack:
        length, lo = stack.pop()
        close(length, lo, last)
    return out


def duplicate_lines(data: np.ndarray, at: np.ndarray, words: tk.Words) -> np.ndarray:
    """Per row: lines with a word that equal an earlier line."""
    rows = len(at) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([at[:-1], breaks + 1])
    ends = np.concatenate([at[1:], breaks])
    row = np.concatenate([np.arange(rows), np.searchsorted(at, breaks, "right") - 1])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = np.append(starts[1:] - 1, 0)
    final = np.append(row[1:] != row[:-1], True)
    ends[final] = at[row[final] + 1]
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, row = starts[filled], ends[filled], row[filled]
    key = tk.mix(words.rolling.of(starts, ends) + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]]) + 1 if len(order) else order
    return np.bincount(row[order[again]], minlength=rows)


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, n_maximal_repeats bigint, longest_repeat bigint, n_covered bigint, "
    "spans array<struct<start:int,end:int>>"
)


def judge(ids: list, data: np.ndarray, at: np.ndarray, rules: Rules) -> dict[str, list]:
    """Columns of SCHEMA for a block of rows. Spans are word ranges of repeats, end exclusive."""
    words = tk.Words(data, at)
    rows = len(at) - 1
    n_words = np.diff(words.first)
    array, lcp = suffix_array(words)
    row = words.rows()
    point = (data & 0xC0) != 0x80
    per_word = lambda flags: np.bincount(row[flags], minlength=rows)
    covered = covered_by(array, lcp, rules.span_words)
    longest, repeats = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    found = maximal_repeats(words, array, lcp, rules.span_words)
    if found:
        length, lo, _ = np.array(found).T
        np.maximum.at(longest, row[array[lo]], length)
        np.add.at(repeats, row[array[lo]], 1)
    n_repeat, n_covered = per_word(covered_by(array, lcp, 3)), per_word(covered)
    symbols, chars = tk.count(SYMBOLS[data], at), tk.count(point & words.solid, at)
    failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
    kept = ~failed & (n_covered <= rules.max_covered * n_words) & (longest <= rules.max_longest)
    flag = np.zeros(len(covered) + 2, np.int8)
    flag[1:-1] = covered
    inner = np.zeros(len(covered) + 1, bool)
    inner[words.first] = True  # spans end with their row
    opens = np.flatnonzero((flag[1:-1] == 1) & ((flag[:-2] == 0) | inner[:-1]))
    closes = np.flatnonzero((flag[1:-1] == 1) & ((flag[2:] == 0) | inner[1:])) + 1
    spans: list[list] = [[] for _ in range(rows)]
    for s, e in zip(opens.tolist(), closes.tolist(), strict=True):
        r = int(row[s])
        base = int(words.first[r])
        spans[r].append({"start": s - base, "end": e - base})
    return {
        "doc_id": ids, "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": duplicate_lines(data, at, words),
        "n_repeat_words": n_repeat, "base_failed": failed, "kept": kept, "n_maximal_repeats": repeats, "longest_repeat": longest,
        "n_covered": n_covered, "spans": spans,
    }


def repetition_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with the columns of SCHEMA; no shuffle."""
    kinds = [("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in tk.blocks(batch.column(1)):
                out = judge(batch.column(0).slice(lo, hi - lo).to_pylist(), data, at, rules)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, dict(kinds).get(k, pa.bool_() if k in ("base_failed", "kept") else pa.int64())) for k, v in out.items()], list(out)
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op1_suffix_array_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))
