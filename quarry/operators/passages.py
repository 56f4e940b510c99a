"""Cutting long texts into overlapping passages, and shortening passages to what a question asks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as tx

#: The usual length of a passage and what neighbours share, in characters.
TARGET, OVERLAP = 1100, 180


def pack(sentences: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """array<string>: sentences in passages of about ``target`` characters; each begins with the end of the one before.

    A fold within the row. A sentence that is longer than a passage is one of its own.
    """
    none = F.array().cast("array<string>")
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda n, s: n + F.length(s) + 1)

    def tail(xs: Column) -> Column:
        """The last sentences that fit the overlap, from the last one back until one does not."""
        start = F.struct(none.alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def back(acc: Column, s: Column) -> Column:
            fits = acc["open"] & (acc["n"] + F.length(s) <= overlap)
            added = F.struct(F.concat(F.array(s), acc["kept"]).alias("kept"), (acc["n"] + F.length(s) + 1).alias("n"), F.lit(True).alias("open"))
            return F.when(fits, added).otherwise(F.struct(acc["kept"].alias("kept"), acc["n"].alias("n"), F.lit(False).alias("open")))

        return F.aggregate(F.reverse(xs), start, back, lambda acc: acc["kept"])

    def step(acc: Column, s: Column) -> Column:
        full = (F.size(acc["now"]) > 0) & (acc["n"] + F.length(s) > target)
        rest = tail(acc["now"])
        return F.when(
            full,
            F.struct(F.concat(acc["out"], F.array(F.array_join(acc["now"], " "))).alias("out"), F.concat(rest, F.array(s)).alias("now"), (size(rest) + F.length(s) + 1).alias("n")),
        ).otherwise(F.struct(acc["out"].alias("out"), F.concat(acc["now"], F.array(s)).alias("now"), (acc["n"] + F.length(s) + 1).alias("n")))

    done = lambda acc: F.when(F.size(acc["now"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["now"], " ")))).otherwise(acc["out"])
    return F.aggregate(sentences, F.struct(none.alias("out"), none.alias("now"), F.lit(0).alias("n")), step, done)


def compress(sentences: Column, asked: Column, most: int = 6, floor: float = 0.05) -> Column:
    """array<string>: the sentences that share most distinct tokens with ``asked``, in the order of the text.

    Few sentences stay whole. Earlier ones get a little more, so ties go to them.
    """

    def pick(v: Column) -> Column:
        n, wanted = F.size(v["s"]), v["asked"]
        scored = F.transform(
            v["s"],
            lambda s, i: F.struct((-(F.size(F.array_intersect(wanted, tx.tokens(s))) / F.greatest(F.size(wanted), F.lit(1)) + 0.12 * (1 - i / (2 * n)))).alias("score"), i.alias("i"), s.alias("s")),
        )
        best = F.filter(F.slice(F.array_sort(scored), 1, most), lambda x: x["score"] < -floor)
        ordered = F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
        return F.when(n <= most, v["s"]).otherwise(F.transform(ordered, lambda x: x["s"]))

    return tx.let(F.struct(sentences.alias("s"), asked.alias("asked")), pick)
