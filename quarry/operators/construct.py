"""Building questions, cards and papers from rows: ordering of options, deduplication, caps and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as tx


def seeded_order(items: Column, seed: Column) -> Column:
    """Items in an order that looks random and depends on seed and item alone."""
    keyed = tx.let(seed, lambda s: F.transform(items, lambda x: F.struct(F.sha2(F.concat_ws("|", s, x), 256).alias("k"), x.alias("x"))))
    return F.transform(F.array_sort(keyed), lambda p: p["x"])


def distinct_options(options: Column) -> Column:
    """Options without those that are empty, or equal to an earlier one, after normalising."""
    first = lambda all_: F.filter(all_, lambda p, i: (p["key"] != "") & (F.array_position(all_["key"], p["key"]) == i + 1))
    return F.transform(tx.let(F.transform(options, lambda o: F.struct(tx.answer(o).alias("key"), o.alias("text"))), first), lambda p: tx.strip(p["text"]))


def resolve_choice(options: Column, index: Column, answer: Column) -> Column:
    """struct<options, answer>: the right option by place, by text, by number, or else the first; it is always among the options.

    Each step is worked out once and bound: what it is made of would be put into every place that names it.
    """

    def text_of(v: Column) -> Column:
        unique, answer = v["options"], v["answer"]
        n = F.size(unique)
        by_text = F.nullif(F.array_position(F.transform(unique, lambda o: tx.answer(o)), tx.answer(answer)).cast("int"), F.lit(0))
        number = F.when(answer.rlike(r"^\d{1,9}$"), answer.cast("int"))
        stated = F.coalesce(F.when(answer != "", by_text - 1), F.when(number.between(1, n), number - 1), F.lit(0))
        place = F.when(index.between(0, n - 1), index).otherwise(stated)
        return F.struct(unique.alias("options"), F.when(answer != "", answer).otherwise(F.coalesce(F.get(unique, place), F.lit(""))).alias("text"))

    def with_text(v: Column) -> Column:
        unique, text = v["options"], v["text"]
        every = F.when((text != "") & ~F.array_contains(unique, text), F.array_append(unique, text)).otherwise(unique)
        return F.struct(every.alias("options"), text.alias("text"))

    def ordered(v: Column) -> Column:
        seed = F.concat(F.left(F.regexp_replace(v["text"], r"\W+", ""), F.lit(32)), F.size(v["options"]).cast("string"))
        return F.struct(seeded_order(v["options"], seed).alias("options"), v["text"].alias("answer"))

    given = F.struct(distinct_options(options).alias("options"), tx.strip(F.coalesce(answer, F.lit(""))).alias("answer"))
    return tx.let(tx.let(tx.let(given, text_of), with_text), ordered)


def assemble(items: DataFrame, group: str, key: Column, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` items of each group, of which only the first with a key counts; ``place`` from 1.

    Repeated keys fall away by a grouped minimum before any group is put in order.
    """
    first = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *items.columns))
    kept = items.groupBy(group, key.alias("_key")).agg(first.alias("x")).select("x.*")
    place = F.row_number().over(W.partitionBy(group).orderBy(*[f"o{i}" for i in range(len(order))]))
    return kept.withColumn("place", place).filter(F.col("place") <= most).select(*items.columns, "place")


def cards(text: Column, label: Column) -> Column:
    """struct<subject, front, back> of a card from the first sentence of a passage; a null back for passages too short."""
    found = tx.sentences(text, 55)
    sentence = F.left(F.when(F.size(found) > 0, F.get(found, F.lit(0))).otherwise(tx.strip(text)), F.lit(400))
    subject = F.coalesce(F.get(tx.key_terms(sentence, 3), F.lit(0)), label)
    return F.struct(subject.alias("subject"), F.concat(F.lit("What does your material state about "), subject, F.lit("?")).alias("front"), F.when(F.length(sentence) >= 40, sentence).alias("back"))


def confidence(*weighted: tuple[float, Column]) -> Column:
    """A blend of shares with a bonus, below certainty."""
    total = sum((w * c for w, c in weighted[1:]), weighted[0][0] * weighted[0][1])
    return F.round(F.round(F.least(F.lit(0.92), total + 0.12), 9), 4)
