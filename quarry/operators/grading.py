"""Grading of answers, as column expressions: options named by letter or number, tolerant matching, lexical credit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text as tx

#: A number within an answer, likeness that counts as equal, key terms compared, and the mark that passes.
NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
ALIKE, NEAR, TERMS, PASS = 0.86, 1e-6, 12, 0.7
#: An option named by itself, in brackets or not, or by its number.
LETTER, ORDINAL = r"^[\(\[]?([a-h])[\)\].:]?$", r"^(?:option\s*)?(\d{1,2})$"


def number_of(text: Column) -> Column:
    """The first number of a text, null if it has none; commas within numbers are ignored."""
    return F.nullif(F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), NUMBER, 0), F.lit("")).try_cast("double")


def option_place(said: Column, n: Column) -> Column:
    """The place, from 0, of the option that an answer names ("B", "(b)", "2", "option 3"); null if none of ``n``."""
    bare = F.regexp_replace(F.lower(tx.strip(said)), LETTER, "$1")
    ordinal = F.nullif(F.regexp_extract(bare, ORDINAL, 1), F.lit("")).cast("int")
    letter = F.ascii(bare) - F.lit(97)
    return F.when(ordinal.isNotNull(), F.when(ordinal.between(1, n), ordinal - 1)).when(bare.rlike("^[a-h]$") & (letter < n), letter)


def matches(said: Column, expected: Column) -> Column:
    """Equal after normalising, the same number, one within the other, or much alike."""
    a, b = tx.answer(said), tx.answer(expected)
    within = (F.length(a) > 3) & (b.contains(a) | a.contains(b))
    alike = tx.jaccard(tx.words_and_numbers(a), tx.words_and_numbers(b)) >= ALIKE
    same = F.coalesce(F.abs(number_of(a) - number_of(b)) < NEAR, F.lit(False))
    return (a != "") & (b != "") & ((a == b) | same | within | alike)


def objective(said: Column, options: Column, correct: Column) -> Column:
    """Whether an answer to a choice is right; an option named by its place also counts as what was said."""
    place = option_place(said, F.size(options))
    given = F.coalesce(F.get(options, place), said)
    expected = F.when(place.isNotNull(), F.array(correct, said)).otherwise(F.array(correct))
    return F.exists(expected, lambda e: matches(given, e))


def lexical(said: Column, expected: Column) -> Column:
    """struct<score, is_correct, missing>: the share of the expected key terms that an answer has."""
    def grade(k: Column) -> Column:
        want, have = k["want"], k["have"]
        score = F.when(F.size(want) == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(want, have)) / F.size(want), 3))
        missing = F.slice(F.array_sort(F.array_except(want, have)), 1, 5)
        return F.struct(score.alias("score"), (score >= PASS).alias("is_correct"), missing.alias("missing"))

    return tx.let(F.struct(tx.key_terms(expected, TERMS).alias("want"), tx.key_terms(said, TERMS).alias("have")), grade)
