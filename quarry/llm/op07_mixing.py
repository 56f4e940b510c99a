"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token weights are summed into cells of source, language and topic. In turn, each of the three margins
is scaled to its target; the product of the factors calibrates every cell. Documents are then drawn
with a probability in proportion to their cell's factor, by a hash of doc_id, so that the draw is the
same on every run and a lost executor repeats it exactly.

Topics are registers that the text shows: tables, licences, markup, dialogue or prose; ``topic`` can be
any expression over the input instead. A target margin gives the shares wanted; values without one get
their share to the power ``flatten``, as far as they have it at ``keep``.

A chance is 1 at most, so raking works under that bound: cells at 1 stay there, the others take what is
missing, until the sample expected has the margins wanted. Where ``keep`` asks more of a value than
there is, the sample is smaller, and a warning says so; so it does where targets cannot be met.

Defined results: null and empty texts weigh one token; null sources, languages and topics are a value
of their own; a null doc_id is drawn as the text "null" (stage: by the
digest of its text); an empty table gives an empty result; rows
repeated with one doc_id share its draw; extra columns are ignored (stage: kept).
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.shared import Stash, table, unused

#: Topic names and the expressions that are tried in this order, in the common subset of Java's and RE2's syntax.
TOPICS = (
    ("licence", r"(?i)(licensed under|copyright|all rights reserved|permission is hereby)"),
    ("table", r"\|[^|\n]*\|"),
    ("markup", r"[#$%&*<>]{3}"),
    ("contact", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\."),
)
DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Mix:
    """``keep``: the share of all tokens that the sample aims at. ``rounds``: passes of ``calibrate`` over the margins."""

    flatten: float = 0.5
    keep: float = 0.5
    rounds: int = 6
    seed: str = "mix-1"
    targets: Mapping[str, Mapping[str, float]] = field(default_factory=dict)


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def weighted(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens); tokens are words, one at least."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.greatest(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(1)).cast("bigint")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("(null)")).alias(c) for c in ("source", "lang")]
    return docs.select("doc_id", *named, F.coalesce(topic if topic is not None else topic_of(text), F.lit("(null)")).alias("topic"), words.alias("tokens"))


def _target(margin: DataFrame, name: str, mix: Mix, limited: bool) -> DataFrame:
    """(value, share wanted) of one margin; shares sum to 1.

    Named values get their share. The others divide the rest by their tokens to the power ``flatten``. Where
    the sample is ``limited`` to what there is, none of them is asked for more than it has at ``keep``: what such
    a value cannot give, the others give. A margin has a row for each value; they are put in order by how soon
    they run out.
    """
    wanted = mix.targets.get(name, {})
    left = max(0.0, 1.0 - sum(map(float, wanted.values())))
    every = W.partitionBy()
    has = F.col("tokens") / F.sum("tokens").over(every)
    given = margin.select(name, has.alias("has"), F.pow("tokens", F.lit(mix.flatten)).alias("raw"))
    named = given.filter(F.col(name).isin(list(wanted))) if wanted else given.limit(0)
    share = F.lit(0.0)
    for value, x in wanted.items():
        share = F.when(F.col(name) == value, F.lit(float(x))).otherwise(share)
    rest = (given.filter(~F.col(name).isin(list(wanted))) if wanted else given).withColumn("raw", F.col("raw") / F.sum("raw").over(every))
    order = W.orderBy(F.col("has") / F.col("raw"), name)
    rest = rest.withColumn("full", F.col("has") / mix.keep).withColumn("runs_out", F.col("full") / F.col("raw"))
    before = F.coalesce(F.sum("full").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = (left - before) / F.sum("raw").over(order.rowsBetween(0, W.unboundedFollowing))
    rest = rest.withColumn("level", level)
    # the first value that lasts at the level that is left by those before it sets the level
    rest = rest.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("runs_out"), F.col("level")), F.when(F.col("level") <= F.col("runs_out"), F.col("runs_out"))).over(every))
    if not limited:
        rest = rest.withColumn("full", left * F.col("raw")).withColumn("level", F.lit(None).cast("double"))
    out = named.select(name, share.alias("raw")).unionByName(rest.select(name, F.when(F.col("level").isNull(), F.col("full")).otherwise(F.least("full", F.col("level") * F.col("raw"))).alias("raw")))
    return out.select(name, (F.col("raw") / F.sum("raw").over(every)).alias("want"))


def _targets(cells: DataFrame, mix: Mix, stash: Stash, limited: bool) -> dict[str, DataFrame]:
    margins = {name: cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("tokens")) for name in DIMENSIONS}
    return {name: stash.keep(_target(margin, name, mix, limited), f"target-{name}") for name, margin in margins.items()}


def calibrate(cells: DataFrame, mix: Mix, stash: Stash) -> DataFrame:
    """Cells (source, lang, topic, tokens) with ``fitted``: token weights raked to the margins."""
    whole = cells.agg(F.sum("tokens").cast("double").alias("whole"))  # one row
    targets = _targets(cells, mix, stash, False)
    at = stash.keep(cells.join(F.broadcast(whole)).select(*DIMENSIONS, "tokens", (F.col("tokens") / F.col("whole")).alias("fitted")), "cells-0")
    # each step is written: a step reads its cells twice, so plans of several steps would double with each
    for step in range(1, mix.rounds * len(DIMENSIONS) + 1):
        name = DIMENSIONS[(step - 1) % len(DIMENSIONS)]
        # each task first sums its own cells, so a margin that holds most of them stays small
        scale = at.groupBy(name).agg(F.sum("fitted").alias("have")).join(targets[name], name).select(name, (F.col("want") / F.col("have")).alias("scale"))
        at = stash.keep(at.join(scale, name).select(*DIMENSIONS, "tokens", (F.col("fitted") * F.col("scale")).alias("fitted")), f"cells-{step}")
        stash.drop(f"cells-{step - 1}")
    return at


def uniform(doc_id: Column, seed: str) -> Column:
    """In [0, 1), from the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _step(at: DataFrame, name: str, keep: float, relax: float) -> DataFrame:
    """``at`` with the factors of one margin moved towards its target; cells at 1 stay there."""
    full, want = F.col("factor") >= 1, F.lit(keep) * F.col("want")
    sums = at.groupBy(name).agg(
        F.max(f"want_{name}").alias("want"),
        F.sum(F.when(full, F.col("share")).otherwise(0.0)).alias("fixed"),
        F.sum(F.when(full, 0.0).otherwise(F.col("share") * F.col("factor"))).alias("free"),
    )
    have = F.col("fixed") + F.col("free")
    scale = F.when((F.col("free") > 0) & (want > F.col("fixed")), F.try_divide(want - F.col("fixed"), F.col("free"))).otherwise(F.coalesce(F.try_divide(want, have), F.lit(1.0)))
    steps = sums.select(name, F.pow(scale, F.lit(relax)).alias("scale"))
    return at.join(steps, name).withColumn("factor", F.col("factor") * F.col("scale")).select(*at.columns)


def _margins(at: DataFrame) -> DataFrame:
    """(want, got) of each value of the three margins, by one shuffle; ``got`` is the share of all tokens expected."""
    sides = F.array(*[F.struct(F.lit(name).alias("name"), F.col(name).alias("value"), F.col(f"want_{name}").alias("want")) for name in DIMENSIONS])
    rows = at.select(F.explode(sides).alias("side"), (F.col("share") * F.least(F.lit(1.0), "factor")).alias("got"))
    return rows.groupBy("side.name", "side.value").agg(F.max("side.want").alias("want"), F.sum("got").alias("got"))


#: A margin is met within this share of its target; rounds without that before the sample is made smaller; rounds in all.
NEAR, PATIENCE, MOST = 1e-3, 15, 60


def bounded(cells: DataFrame, mix: Mix, stash: Stash, near: float = NEAR, patience: int = PATIENCE, most: int = MOST) -> DataFrame:
    """Cells with the chance of a document, such that the sample expected has the margins wanted.

    A chance is least(1, product of a factor for each margin). The sample has ``keep`` of all tokens, or
    what the scarcest value allows. Rounds go on until each margin is met within ``near``; after each
    ``patience`` rounds without that, as values that are scarce together can cause, the sample is made a
    fifth smaller. Targets that ``most`` rounds do not meet are warned of.
    """
    whole = cells.agg(F.sum("tokens").cast("double").alias("whole"))  # one row
    at = cells.join(F.broadcast(whole)).select(*DIMENSIONS, (F.col("tokens") / F.col("whole")).alias("share"), F.lit(1.0).alias("factor"))
    for name, target in _targets(cells, mix, stash, True).items():
        at = at.join(target.withColumnRenamed("want", f"want_{name}"), name)
    at = stash.keep(at, "bounded-0")
    room = _margins(at).filter("want > 0").agg(F.min(F.col("got") / F.col("want"))).head()[0]
    keep = mix.keep if room is None else min(mix.keep, room)
    at = at.withColumn("factor", F.lit(keep))
    for turn in range(most + 1):
        goal = F.lit(keep) * F.col("want")
        miss = _margins(at).agg(F.max(F.abs(F.col("got") - goal) / F.greatest(goal, F.lit(1e-12)))).head()[0] or 0.0
        if miss <= near or turn == most:
            break
        if turn and turn % patience == 0:
            keep *= 0.8
        relax = 1.3 if turn < patience else 1.0  # longer steps need half the rounds, but need not settle
        for name in DIMENSIONS:
            at = _step(at, name, keep, relax)
        # a round is written once: the steps within it share their exchanges, those of several rounds would double
        at = stash.keep(at, f"bounded-{turn + 1}")
        stash.drop(f"bounded-{turn}")
    if miss > near:
        warnings.warn(f"the targets cannot be met: a margin of the sample is off by {miss:.3g} of its target", stacklevel=2)
    elif keep < mix.keep * (1 - 1e-9):
        warnings.warn(f"the targets leave {keep:.3g} of the tokens, not {mix.keep:.3g}: of some values there is no more", stacklevel=2)
    return at.select(*DIMENSIONS, F.least(F.lit(1.0), "factor").alias("probability"))


def mixed(docs: DataFrame, mix: Mix = Mix(), topic: Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, sampled) of every row."""
    stash = Stash(docs.sparkSession, "mixing")
    rows = stash.keep(weighted(docs, topic), "rows")  # no texts: the expressions run over them once
    cells = stash.keep(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    out = rows.join(bounded(cells, mix, stash), list(DIMENSIONS))
    return out.select("doc_id", *DIMENSIONS, "tokens", F.round("probability", 6).alias("probability"), (uniform(F.col("doc_id"), mix.seed) < F.col("probability")).alias("sampled"))


def op7_ipf_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def draw(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the sample. Rows keep all their columns, whatever their names.

    Repeated rows are drawn together; rows without a doc_id by the digest of their text; null and empty
    texts weigh one token; null sources and languages are values of their own; an empty table gives an
    empty sample.
    """
    mix = Mix()
    names = dict(zip((*DIMENSIONS, "p"), unused(docs, *[f"_{c}" for c in DIMENSIONS], "_p"), strict=True))
    stash = Stash(spark, "mixing")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = weighted(docs)
    cells = stash.keep(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    chance = bounded(cells, mix, stash).select(*[F.col(c).alias(names[c]) for c in DIMENSIONS], F.col("probability").alias(names["p"]))
    key = {"source": F.coalesce(F.col("source").cast("string"), F.lit("(null)")), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("(null)")), "topic": topic_of(text)}
    on = [key[c] == F.col(names[c]) for c in DIMENSIONS]
    drawn = F.coalesce(F.col("doc_id").cast("string"), F.md5(text.cast("binary")))  # rows without a doc_id by text, not all at once
    return docs.join(chance, on).filter(uniform(drawn, mix.seed) < F.col(names["p"])).select(*docs.columns)


def oracle(mix: Mix = Mix(), docs: str = "documents") -> str:
    """DuckDB SQL for op7 with the default targets: a recursive step is a round of ``bounded``."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS) + " ELSE 'prose' END"
    fixed, free = "CASE WHEN factor >= 1 THEN share ELSE 0.0 END", "CASE WHEN factor >= 1 THEN 0.0 ELSE share * factor END"

    def sums(name: str) -> str:
        return f"sum({fixed}) OVER (PARTITION BY {name}) AS fixed, sum({free}) OVER (PARTITION BY {name}) AS free"

    def step(source: str, name: str) -> str:
        scale = f"CASE WHEN free > 0 AND keep * want_{name} > fixed THEN (keep * want_{name} - fixed) / free ELSE coalesce(keep * want_{name} / nullif(fixed + free, 0), 1.0) END"
        return f"SELECT * EXCLUDE (factor, fixed, free), factor * pow({scale}, CASE WHEN turn < {PATIENCE} THEN 1.3 ELSE 1.0 END) AS factor FROM (SELECT *, {sums(name)} FROM ({source}))"

    wants = ", ".join(f"want_{name}" for name in DIMENSIONS)
    miss = ", ".join(f"max(abs(got_{name} - keep * want_{name}) / greatest(keep * want_{name}, 1e-12)) OVER ()" for name in DIMENSIONS)
    got = ", ".join(f"sum(share * least(1.0, factor)) OVER (PARTITION BY {name}) AS got_{name}" for name in DIMENSIONS)
    going = f"SELECT turn, keep * CASE WHEN turn > 0 AND turn % {PATIENCE} = 0 THEN 0.8 ELSE 1.0 END AS keep, {', '.join(DIMENSIONS)}, share, {wants}, factor FROM (SELECT *, greatest({miss}) AS miss FROM (SELECT *, {got} FROM r)) WHERE miss > {NEAR} AND turn < {MOST}"
    for name in DIMENSIONS:
        going = step(going, name)
    columns = f"{', '.join(DIMENSIONS)}, share, {wants}, factor"
    targets = ", ".join(
        f"""v_{name} AS (SELECT {name}, has, raw / sum(raw) OVER () AS raw, has / {mix.keep} AS f FROM (SELECT {name}, sum(share) AS has, pow(sum(tokens), {mix.flatten}) AS raw FROM c GROUP BY {name})),
    o_{name} AS (SELECT *, f / raw AS runs_out, (1 - coalesce(sum(f) OVER (ORDER BY has / raw, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(raw) OVER (ORDER BY has / raw, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v_{name}),
    l_{name} AS (SELECT {name}, has, CASE WHEN lv IS NULL THEN f ELSE least(f, lv * raw) END AS x FROM o_{name}, (SELECT arg_min(level, runs_out) FILTER (level <= runs_out) AS lv FROM o_{name})),
    m_{name} AS (SELECT {name}, has, x / sum(x) OVER () AS want_{name} FROM l_{name})"""
        for name in DIMENSIONS
    )
    room = " UNION ALL ".join(f"SELECT has / want_{name} AS room FROM m_{name} WHERE want_{name} > 0" for name in DIMENSIONS)
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '(null)') AS source, coalesce(lang, '(null)') AS lang, {topic} AS topic, CAST(greatest(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 1) AS BIGINT) AS tokens FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM {docs})),
    c AS (SELECT source, lang, topic, tokens, tokens / sum(tokens) OVER () AS share FROM (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)),
    {targets},
    k AS (SELECT least({mix.keep}, min(room)) AS keep FROM ({room})),
    r AS (
      SELECT 0 AS turn, keep, {', '.join(DIMENSIONS)}, share, {wants}, keep AS factor FROM c {' '.join(f'JOIN m_{name} USING ({name})' for name in DIMENSIONS)} CROSS JOIN k
      UNION ALL
      SELECT turn + 1, keep, {columns} FROM ({going})
    ),
    p AS (SELECT source, lang, topic, least(1.0, factor) AS probability FROM r WHERE turn = (SELECT max(turn) FROM r))
    SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(probability, 6) AS probability,
      CAST(('0x' || substr(md5('{mix.seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / {float(1 << 52)!r} < probability AS sampled
    FROM d JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic"""
