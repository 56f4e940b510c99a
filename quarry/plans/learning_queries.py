"""Queries over grading, construction of questions and cards, requests, and guided dialogue."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import bm25, construct, grading, requests
from quarry.plans.retrieval_queries import SCORE, asked, docs_of, searched
from quarry.plans.study_queries import dialogue
from quarry.plans.table_queries import MASTERY, QUERIES as TABLES, mastery
from quarry.plans.text_queries import ANSWER_SQL, SPLIT, STOP, STRIP, WORDS, q, route
from quarry.sources.tables import table as T

QUERIES: dict = {}


def add(name, build, sql=None):
    QUERIES[name] = (build, sql)


def edges(pattern: str) -> str:
    """A pattern whose word edges know letters of any language, as Java's do and RE2's do not. It takes in what is at the edge."""
    head, tail = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
    flag, rest = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    rest = head + rest[2:] if rest.startswith(r"\b") else rest
    return flag + (rest[:-2] + tail if rest.endswith(r"\b") else rest)


def strings(values) -> str:
    """A list of strings in SQL."""
    return "[" + ", ".join(f"'{q(v)}'" for v in values) + "]"


def terms_sql(source: str, keys: str, most: int, text: str = "text") -> str:
    """(keys, terms): the key terms of a row, in order."""
    return f"""(SELECT {keys}, list(term ORDER BY rank) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, first) AS rank
      FROM (SELECT {keys}, term, count(*) AS n, min(i) AS first FROM (SELECT {keys}, unnest(range(len(l))) AS i, lower(unnest(l)) AS term FROM (SELECT {keys}, {WORDS.format(text)} AS l FROM {source}))
        WHERE length(term) >= 2 AND regexp_matches(term, '^[a-z]') AND term NOT IN {STOP} GROUP BY ALL)) WHERE rank <= {most} GROUP BY ALL)"""


# Grading. The answers are a part's own texts in the forms that learners use.
def objective_items(s, d):
    part = T(s, d, "part").withColumn("options", F.array("p_name", "p_brand", "p_type", F.lit("None of these")))
    said = F.array(F.lit("B"), F.lit("(c)"), F.lit("3"), F.lit("option 9"), F.upper("p_type"), F.concat(F.lit("The "), "p_type", F.lit(".")), F.col("p_size").cast("string"), F.col("p_name"), F.lit("  "))
    return part.select("p_partkey", "options", F.col("p_type").alias("correct"), F.get(said, (F.col("p_partkey") + F.col("p_size")).cast("int") % 9).alias("said"))


OBJECTIVE = f"""WITH a AS (SELECT p_partkey, [p_name, p_brand, p_type, 'None of these'] AS options, p_type AS correct, ['B', '(c)', '3', 'option 9', upper(p_type), 'The ' || p_type || '.', CAST(p_size AS VARCHAR), p_name, '  '][(p_partkey + p_size) % 9 + 1] AS said FROM part),
  b AS (SELECT *, regexp_replace(lower({STRIP.format('said')}), '{grading.LETTER}', '\\1') AS bare FROM a),
  c AS (SELECT *, CASE WHEN regexp_matches(bare, '{grading.ORDINAL}') THEN CASE WHEN CAST(regexp_extract(bare, '{grading.ORDINAL}', 1) AS INT) BETWEEN 1 AND 4 THEN CAST(regexp_extract(bare, '{grading.ORDINAL}', 1) AS INT) - 1 END WHEN regexp_matches(bare, '^[a-h]$') AND ascii(bare) - 97 < 4 THEN ascii(bare) - 97 END AS place FROM b),
  e AS (SELECT *, coalesce(options[place + 1], said) AS given, unnest(CASE WHEN place IS NOT NULL THEN [correct, said] ELSE [correct] END) AS expected FROM c),
  n AS (SELECT *, {ANSWER_SQL.format('given')} AS x, {ANSWER_SQL.format('expected')} AS y FROM e),
  m AS (SELECT *, list_distinct({WORDS.format('lower(x)')}) AS xs, list_distinct({WORDS.format('lower(y)')}) AS ys, TRY_CAST(nullif(regexp_extract(replace(x, ',', ''), '{grading.NUMBER}', 0), '') AS DOUBLE) AS xn, TRY_CAST(nullif(regexp_extract(replace(y, ',', ''), '{grading.NUMBER}', 0), '') AS DOUBLE) AS yn FROM n),
  g AS (SELECT p_partkey, any_value(said) AS said, any_value(place) AS place, bool_or(x <> '' AND y <> '' AND (x = y OR coalesce(abs(xn - yn) < 1e-6, false) OR (length(x) > 3 AND (contains(y, x) OR contains(x, y))) OR (len(xs) > 0 AND len(ys) > 0 AND len(list_intersect(xs, ys)) / len(list_distinct(xs || ys)) >= 0.86))) AS ok FROM m GROUP BY p_partkey)"""
add("g01_grade_objective", lambda s, d: objective_items(s, d).select("p_partkey", grading.option_place(F.col("said"), F.size("options")).alias("place"), grading.objective(F.col("said"), F.col("options"), F.col("correct")).alias("is_correct")), OBJECTIVE + " SELECT p_partkey, CAST(place AS INT) AS place, ok AS is_correct FROM g")
add(
    "g22_grade_dispatch",
    lambda s, d: objective_items(s, d).select("p_partkey", F.when(tx.strip(F.col("said")) == "", "blank").when(grading.objective(F.col("said"), F.col("options"), F.col("correct")), "correct").otherwise("wrong").alias("verdict"))
    .withColumn("score", F.when(F.col("verdict") == "correct", 1.0).otherwise(0.0)).withColumn("hint", F.when(F.col("verdict") == "blank", "Re-read the source passage before retrying.")),
    OBJECTIVE + " SELECT p_partkey, verdict, CASE WHEN verdict = 'correct' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score, CASE WHEN verdict = 'blank' THEN 'Re-read the source passage before retrying.' END AS hint FROM (SELECT p_partkey, CASE WHEN trim(said) = '' THEN 'blank' WHEN ok THEN 'correct' ELSE 'wrong' END AS verdict FROM g)",
)


def lexical_grades(s, d):
    graded = dialogue(s, d).select("conv_id", "turn", grading.lexical(F.col("reply"), F.col("text")).alias("g"))
    return graded.select("conv_id", "turn", "g.score", "g.is_correct", F.array_join("g.missing", ",").alias("missing"))


add("g02_grade_lexical", lexical_grades, f"""WITH k AS {terms_sql("conversations", "conv_id, turn", 12)},
  p AS (SELECT u.conv_id, u.turn, coalesce(e.terms, []) AS want, coalesce(h.terms, []) AS have FROM conversations u JOIN conversations r ON r.conv_id = u.conv_id AND r.turn - 1 = u.turn AND u.role = 'user' AND r.role = 'assistant' LEFT JOIN k e ON e.conv_id = u.conv_id AND e.turn = u.turn LEFT JOIN k h ON h.conv_id = r.conv_id AND h.turn = r.turn),
  s AS (SELECT *, CASE WHEN len(want) = 0 THEN 0.0::DOUBLE ELSE round(CAST(len(list_intersect(want, have)) AS DOUBLE) / len(want), 3) END AS score FROM p)
  SELECT conv_id, turn, score, score >= 0.7 AS is_correct, array_to_string(list_sort(list_filter(want, lambda w: NOT list_contains(have, w)))[1:5], ',') AS missing FROM s""")  # fmt: skip


def report(s, d):
    """A report for each learner: points, weak and strong topics, and what to do next."""
    log = T(s, d, "events").withColumn("ok", F.col("value") > 10)
    topics = log.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("bigint")).alias("right"))
    topics = topics.withColumn("percent", F.round(100.0 * F.col("right") / F.col("n"), 2))
    ends = topics.groupBy("user_id").agg(F.sum("n").alias("attempted"), F.sum("right").alias("correct"), F.array_sort(F.collect_list(F.struct("percent", "event_type"))).alias("up"), F.array_sort(F.collect_list(F.struct((-F.col("percent")).alias("m"), "event_type"))).alias("down"))  # a row a topic
    weak = F.transform(F.filter(F.slice("up", 1, 3), lambda x: x["percent"] < 70), lambda x: x["event_type"])
    strong = F.transform(F.filter(F.slice("down", 1, 3), lambda x: x["m"] <= -80), lambda x: x["event_type"])
    poor = F.transform(F.slice(F.filter("up", lambda x: x["percent"] < 60), 1, 2), lambda x: x["event_type"])
    advice = F.when(F.size(poor) > 0, F.concat(F.lit("Re-read the material on "), F.array_join(poor, ", "), F.lit(" and retake a targeted drill on just those topics."))).otherwise("Accuracy is solid here. Move to harder items or a timed exam-mode paper.")
    return ends.select("user_id", "attempted", "correct", F.round(100.0 * F.col("correct") / F.col("attempted"), 2).alias("percent"), F.array_join(weak, ",").alias("weak"), F.array_join(strong, ",").alias("strong"), advice.alias("advice"))


add("g03_grade_report", report, """WITH t AS (SELECT user_id, event_type, count(*) AS n, sum(CAST(value > 10 AS BIGINT)) AS ok, round(100.0::DOUBLE * sum(CAST(value > 10 AS BIGINT)) / count(*), 2) AS percent FROM events GROUP BY ALL),
  u AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS attempted, CAST(sum(ok) AS BIGINT) AS correct, list({'p': percent, 'e': event_type} ORDER BY percent, event_type) AS up, list({'p': percent, 'e': event_type} ORDER BY percent DESC, event_type) AS down FROM t GROUP BY ALL)
  SELECT user_id, attempted, correct, round(100.0::DOUBLE * correct / attempted, 2) AS percent, array_to_string(list_transform(list_filter(up[1:3], lambda x: x.p < 70), lambda x: x.e), ',') AS weak, array_to_string(list_transform(list_filter(down[1:3], lambda x: x.p >= 80), lambda x: x.e), ',') AS strong,
   CASE WHEN len(list_filter(up, lambda x: x.p < 60)) > 0 THEN 'Re-read the material on ' || array_to_string(list_transform(list_filter(up, lambda x: x.p < 60)[1:2], lambda x: x.e), ', ') || ' and retake a targeted drill on just those topics.' ELSE 'Accuracy is solid here. Move to harder items or a timed exam-mode paper.' END AS advice FROM u""")  # fmt: skip


def blends(s, d):
    """Confidence of a learner's set as a quiz and as a deck: what has evidence, what is explained, what is distinct, and breadth."""
    k = F.get_json_object("props", "$.k").cast("int")
    share = lambda c: F.avg(c.cast("double"))
    rows = T(s, d, "events").groupBy("user_id").agg(share(k > 20).alias("refs"), share(F.col("value") > 5).alias("why"), (F.count_distinct("props") / F.count(F.lit(1))).alias("distinct"), F.least(F.lit(1.0), F.count_distinct("event_type") / 3).alias("breadth"))
    return rows.select("user_id", construct.confidence((0.45, F.col("refs")), (0.3, F.col("why")), (0.25, F.col("breadth"))).alias("quiz"), construct.confidence((0.5, F.col("refs")), (0.2, F.col("distinct")), (0.3, F.col("breadth"))).alias("deck"))


add("a26_confidence_blends", blends, """WITH x AS (SELECT user_id, avg(CAST(CAST(json_extract_string(props, '$.k') AS INT) > 20 AS INT)) AS refs, avg(CAST(value > 5 AS INT)) AS why, count(DISTINCT props) / count(*) AS dist, least(1.0::DOUBLE, count(DISTINCT event_type) / 3) AS breadth FROM events GROUP BY ALL)
  SELECT user_id, round(round(least(0.92::DOUBLE, 0.45::DOUBLE * refs + 0.3::DOUBLE * why + 0.25::DOUBLE * breadth + 0.12::DOUBLE), 9), 4) AS quiz, round(round(least(0.92::DOUBLE, 0.5::DOUBLE * refs + 0.2::DOUBLE * dist + 0.3::DOUBLE * breadth + 0.12::DOUBLE), 9), 4) AS deck FROM x""")  # fmt: skip


# Construction.
def choices(s, d):
    options = F.array("p_type", "p_brand", F.concat(F.lit(" The "), "p_type", F.lit(".")), "p_name", F.lit(" "))
    answer = F.get(F.array(F.lit(""), F.col("p_brand"), F.lit("2"), F.lit("something else")), (F.col("p_partkey") % 4).cast("int"))
    rows = T(s, d, "part").select("p_partkey", construct.resolve_choice(options, F.when(F.col("p_size") % 3 == 0, F.col("p_size") % 7), answer).alias("c"))
    return rows.select("p_partkey", F.array_join("c.options", "|").alias("options"), "c.answer")


CHOICES = f"""WITH a AS (SELECT p_partkey, list_transform([p_type, p_brand, ' The ' || p_type || '.', p_name, ' '], lambda o: {STRIP.format('o')}) AS os, CASE WHEN p_size % 3 = 0 THEN p_size % 7 END AS idx, ['', p_brand, '2', 'something else'][p_partkey % 4 + 1] AS answer FROM part),
  b AS (SELECT *, list_transform(os, lambda o: {ANSWER_SQL.format('o')}) AS ks FROM a),
  c AS (SELECT *, list_transform(list_filter(range(1, len(os) + 1), lambda i: ks[i] <> '' AND list_position(ks, ks[i]) = i), lambda i: os[i]) AS u, list_filter(ks, lambda k: k <> '') AS uk0 FROM b),
  e AS (SELECT *, list_position(list_transform(u, lambda o: {ANSWER_SQL.format('o')}), {ANSWER_SQL.format('answer')}) AS bt, CASE WHEN regexp_matches(answer, '^\\d+$') THEN CAST(answer AS INT) END AS num FROM c),
  f AS (SELECT *, CASE WHEN idx BETWEEN 0 AND len(u) - 1 THEN idx WHEN answer <> '' AND bt > 0 THEN bt - 1 WHEN num BETWEEN 1 AND len(u) THEN num - 1 ELSE 0 END AS place FROM e),
  g AS (SELECT *, CASE WHEN answer <> '' THEN answer ELSE coalesce(u[place + 1], '') END AS t FROM f),
  h AS (SELECT *, CASE WHEN t <> '' AND NOT list_contains(u, t) THEN list_append(u, t) ELSE u END AS ev FROM g),
  i AS (SELECT p_partkey, t AS answer, ev, left(regexp_replace(t, '\\W+', '', 'g'), 32) || len(ev) AS seed FROM h)"""
add("g04_resolve_choice", choices, CHOICES + " SELECT p_partkey, array_to_string(list_transform(list_sort(list_transform(ev, lambda o: {'k': sha256(seed || '|' || o), 'x': o})), lambda p: p.x), '|') AS options, answer FROM i")
add("m23_seeded_order", lambda s, d: T(s, d, "part").select("p_partkey", F.array_join(construct.seeded_order(F.split("p_name", " "), F.col("p_brand")), " ").alias("shuffled")), "SELECT p_partkey, array_to_string(list_transform(list_sort(list_transform(string_split(p_name, ' '), lambda o: {'k': sha256(p_brand || '|' || o), 'x': o})), lambda p: p.x), ' ') AS shuffled FROM part")

FOLD = "list_reduce(list_prepend({'out': CAST([] AS VARCHAR[]), 'held': ''}, list_transform(parts, lambda x: {'out': CAST([] AS VARCHAR[]), 'held': x})), lambda acc, x: CASE WHEN J = '' THEN acc WHEN (length(J) < LEAST AND NOT regexp_matches(J, '[.!?]$')) OR NOT (length(J) >= LEAST OR len(acc.out) > 0) THEN {'out': acc.out, 'held': J} ELSE {'out': list_append(acc.out, J), 'held': ''} END)"
JOINED = "trim(CASE WHEN acc.held <> '' THEN acc.held || ' ' || x.held ELSE x.held END)"


def sentences_sql(source: str, keys: str, least: int, text: str = "text") -> str:
    """(keys, s): the sentences of each row."""
    fold = FOLD.replace("J", JOINED).replace("LEAST", str(least))
    return f"(SELECT {keys}, CASE WHEN r.held <> '' THEN list_append(r.out, r.held) ELSE r.out END AS s FROM (SELECT {keys}, {fold} AS r FROM (SELECT {keys}, {SPLIT.replace('text', text)} AS parts FROM {source})))"


add("g05_extractive_cards", lambda s, d: T(s, d, "documents").select("doc_id", construct.cards(F.col("text"), F.col("source")).alias("c")).filter("c.back IS NOT NULL").select("doc_id", "c.subject", "c.front", F.sha2("c.back", 256).alias("back")),
    f"""WITH s AS {sentences_sql("documents", "doc_id, source, text", 55)}, b AS (SELECT doc_id, source, left(CASE WHEN len(s) > 0 THEN s[1] ELSE {STRIP.format('text')} END, 400) AS back FROM s), k AS {terms_sql("b", "doc_id", 3, "back")}
  SELECT doc_id, coalesce(terms[1], source) AS subject, 'What does your material state about ' || coalesce(terms[1], source) || '?' AS front, sha256(back) AS back FROM b LEFT JOIN k USING (doc_id) WHERE length(back) >= 40""")  # fmt: skip


def exam(s, d, most=20):
    """A paper for each brand: weak items first, no two alike in their first 90 characters, capped, with time for it."""
    items = T(s, d, "part").select("p_brand", "p_partkey", "p_type", (F.col("p_size") > 10).alias("later"))
    paper = construct.assemble(items, "p_brand", F.left(tx.answer(F.col("p_type")), F.lit(90)), [F.col("later"), F.col("p_partkey")], most)
    return paper.select("p_brand", "place", "p_partkey", F.greatest(F.lit(15), 2 * F.count(F.lit(1)).over(W.partitionBy("p_brand"))).cast("int").alias("minutes"))


EXAM = "WITH k AS (SELECT p_brand, p_partkey, p_size > 10 AS later, row_number() OVER (PARTITION BY p_brand, left({key}, {width}) ORDER BY {order}) AS r FROM part {where}), p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY {order}) AS place FROM k WHERE r = 1)"
add("g06_exam_assembly", exam, EXAM.format(key=ANSWER_SQL.format("p_type"), width=90, order="p_size > 10, p_partkey", where="").replace("ORDER BY p_size > 10, p_partkey) AS place", "ORDER BY later, p_partkey) AS place") + " SELECT p_brand, CAST(place AS INT) AS place, p_partkey, CAST(greatest(15, 2 * count(*) OVER (PARTITION BY p_brand)) AS INT) AS minutes FROM p WHERE place <= 20")


def drill(s, d, topics=6, questions=8):
    """Passages for each of the first topics; all are searched in one batch."""
    few = asked(s, d).orderBy("query_id").limit(topics)
    return searched(s, d, max(4, questions // topics + 3), few).select("query_id", "rank", "doc_id")


add("g07_targeted_drill", drill, SCORE + ", t AS (SELECT item_id FROM benchmark ORDER BY item_id LIMIT 6) SELECT query_id, CAST(r AS INT) AS rank, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM sc WHERE query_id IN (SELECT item_id FROM t)) WHERE r <= 4")
add("j12_retrieval_per_key", lambda s, d: searched(s, d, 3).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("documents")), SCORE + " SELECT query_id, string_agg(doc_id, ',' ORDER BY r) AS documents FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM sc) WHERE r <= 3 GROUP BY ALL")


def deck(s, d, most=15):
    """Cards for each brand: those too short fall away, then those with the front of an earlier one."""
    valid = T(s, d, "part").filter((F.length(F.trim("p_name")) >= 6) & (F.length(F.trim("p_type")) >= 6)).select("p_brand", "p_partkey", "p_name")
    key = F.left(F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", " ")), F.lit(80))
    return construct.assemble(valid, "p_brand", key, [F.col("p_partkey")], most).select("p_brand", "place", "p_partkey")


add("g08_flashcard_deck", deck, EXAM.format(key="trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'))", width=80, order="p_partkey", where="WHERE length(trim(p_name)) >= 6 AND length(trim(p_type)) >= 6") + " SELECT p_brand, CAST(place AS INT) AS place, p_partkey FROM p WHERE place <= 15")


# Plans: an order is a day of its customer's plan.
RETRIEVAL = ("quiz", "flashcards", "practice", "mock_exam")
PLAN_DAYS, CAP = 7, 3.0
DAYS_SQL = f"""WITH r AS (SELECT o_custkey, o_orderkey, o_orderpriority AS focus, o_orderstatus AS st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS day, o_totalprice / 50000 AS h FROM orders),
  n AS (SELECT o_custkey, CAST(day AS INT) AS day, focus, CASE st WHEN 'F' THEN ['revise'] WHEN 'O' THEN ['read', 'practice'] ELSE ['read'] END AS act, CASE WHEN round(least(h, {CAP}::DOUBLE), 2) <= 0 THEN 1.0::DOUBLE ELSE round(least(h, {CAP}::DOUBLE), 2) END AS hours FROM r WHERE day <= {PLAN_DAYS}),
  v AS (SELECT o_custkey, day, focus, CASE WHEN list_has_any(act, {list(RETRIEVAL)!r}) THEN act ELSE list_append(act, 'quiz') END AS act, hours FROM n)"""


def plan_days(s, d):
    """Proposed days held to the limits: at most a week, hours within the daily budget, and a task of recall on every day."""
    day = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    act = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("revise"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("read"), F.lit("practice"))).otherwise(F.array(F.lit("read")))
    rows = T(s, d, "orders").withColumn("day", day).filter(F.col("day") <= PLAN_DAYS)
    hours = F.round(F.least(F.col("o_totalprice") / 50000, F.lit(CAP)), 2)
    return rows.select("o_custkey", "day", F.col("o_orderpriority").alias("focus"), F.when(F.arrays_overlap(act, F.array(*map(F.lit, RETRIEVAL))), act).otherwise(F.array_append(act, F.lit("quiz"))).alias("act"), F.when(hours <= 0, 1.0).otherwise(hours).alias("hours"))


add("g10_plan_validation", lambda s, d: plan_days(s, d).select("o_custkey", "day", F.array_join("act", ",").alias("activities"), "hours"), DAYS_SQL + " SELECT o_custkey, day, array_to_string(act, ',') AS activities, hours FROM v")


def revision(s, d):
    """The share of each day that is revision, in hundredths of an hour, which halves round up in."""
    recall = F.arrays_overlap(F.col("act"), F.array(F.lit("revise"), F.lit("quiz"), F.lit("flashcards")))
    share = F.expr("(CAST(round(hours * 100) AS BIGINT) * IF(array_contains(act, 'revise'), 30, 20) + 50) div 100") / 100
    return plan_days(s, d).filter(recall).select("o_custkey", "day", share.alias("hours")).filter("hours > 0")


add("g11_revision_share", revision,
    DAYS_SQL + " SELECT * FROM (SELECT o_custkey, day, (CAST(round(hours * 100) AS BIGINT) * CASE WHEN list_contains(act, 'revise') THEN 30 ELSE 20 END + 50) // 100 / 100 AS hours FROM v WHERE list_has_any(act, ['revise', 'quiz', 'flashcards'])) WHERE hours > 0")


def acceptance(s, d):
    """Whether a plan holds: the first weak day is not behind the first strong one, and there are days enough."""
    weak, strong = F.col("focus") == "1-URGENT", F.col("focus") == "5-LOW"
    g = plan_days(s, d).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(weak, F.col("day"))).alias("w"), F.min(F.when(strong, F.col("day"))).alias("s"))
    first = F.col("w").isNotNull() & (F.col("s").isNull() | (F.col("w") <= F.col("s")))
    return g.select("o_custkey", F.when(~first, "weak areas are not first").when(F.col("n") < max(1, PLAN_DAYS // 2), "too sparse").otherwise("kept").alias("verdict"))


add("g23_plan_acceptance", acceptance, DAYS_SQL + f" SELECT o_custkey, CASE WHEN NOT (w IS NOT NULL AND (s IS NULL OR w <= s)) THEN 'weak areas are not first' WHEN n < {max(1, PLAN_DAYS // 2)} THEN 'too sparse' ELSE 'kept' END AS verdict FROM (SELECT o_custkey, count(*) AS n, min(day) FILTER (focus = '1-URGENT') AS w, min(day) FILTER (focus = '5-LOW') AS s FROM v GROUP BY ALL)")

# Requests: turns behind the openings that learners use.
OPENINGS = ("quiz me on entropy, heat and work with 5 hard questions then ", "explain like i'm a beginner how ", "make 12 tricky flashcards on the ", "give me a short analogy for ", "teach me this ", "in depth derivation of ", "about 30 ", "", "i give up: ", "plan my week for ")


def said_of(s, d):
    lead = F.get(F.array(*map(F.lit, OPENINGS)), ((F.col("conv_id") + F.col("turn")) % len(OPENINGS)).cast("int"))
    return T(s, d, "conversations").select("conv_id", "turn", F.lower(F.concat(lead, F.coalesce("text", F.lit("")))).alias("low"))


SAID = f"WITH a AS (SELECT conv_id, turn, lower({strings(OPENINGS)}[(conv_id + turn) % {len(OPENINGS)} + 1] || coalesce(text, '')) AS low FROM conversations)"


def _first_sql(table) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(low, '{q(w)}')" for w in words) + f" THEN '{name}'" for name, words in table) + " END"


def parameters(s, d):
    low = F.col("low")
    return said_of(s, d).select("conv_id", "turn", requests.count_of(low).alias("count"), requests.first_of(low, requests.LEVELS).alias("level"), requests.first_of(low, requests.STYLES).alias("style"), requests.first_of(low, requests.DIFFICULTIES).alias("difficulty"), requests.topic_of(low).alias("topic"), low.rlike(requests.SECOND).alias("second"))


_REJECTED = ", ".join(f"'{r}'" for r in requests.REJECT)
_BROKEN = ", ".join(f"'{r}'" for r in requests.BREAKS)
PARAMETERS = SAID + f""", w AS (SELECT *, list_transform(string_split_regex(regexp_extract(regexp_replace(low, '{q(requests.LEAD_NOISE)}', ' ', 'g'), '{edges(requests.TOPIC)}', 1), '[\\s,]+')[1:14], lambda x: regexp_replace(x, '{q(requests.EDGES)}', '', 'g')) AS ws FROM a),
  e AS (SELECT *, coalesce(list_min(list_filter(range(1, len(ws) + 1), lambda i: ws[i] = '' OR regexp_matches(ws[i], '^\\d+$') OR (i > 1 AND ws[i] IN ({_BROKEN})))), len(ws) + 1) AS stop FROM w),
  t AS (SELECT *, {STRIP.format(f"regexp_replace(array_to_string(ws[1:stop - 1], ' '), '{requests.TAIL_NOISE}', '')")} AS topic0 FROM e),
  p AS (SELECT conv_id, turn, low, CAST(nullif(regexp_extract(low, '{edges(requests.COUNT)}', 1), '') AS INT) AS count, {_first_sql(requests.LEVELS)} AS level, {_first_sql(requests.STYLES)} AS style, {_first_sql(requests.DIFFICULTIES)} AS difficulty, CASE WHEN topic0 NOT IN ({_REJECTED}) AND length(topic0) >= 3 THEN topic0 END AS topic, regexp_matches(low, '{edges(requests.SECOND)}') AS second FROM t)"""
add("g15_request_parameters", parameters, PARAMETERS + " SELECT * EXCLUDE (low) FROM p")


def _route_sql() -> str:
    from quarry.plans.text_queries import ROUTES

    return "CASE " + " ".join(f"WHEN regexp_matches(low, '{q(tx.keyword_pattern(k))}') THEN '{n}'" for n, k in ROUTES) + " ELSE 'unclear' END"


def _lookup_sql(key: str, table: dict[str, str], otherwise: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{q(v)}'" for k, v in table.items()) + f" ELSE '{q(otherwise)}' END"


def workflow(s, d):
    rows = parameters(s, d).join(said_of(s, d), ["conv_id", "turn"]).withColumn("intent", route(F.col("low")))
    return rows.select("conv_id", "turn", "intent", requests.lookup(F.col("intent"), requests.WORKFLOWS, "").alias("workflow"), requests.lookup(F.col("intent"), requests.STAGES, "reply").alias("stages"), requests.item_count(F.col("intent"), F.col("difficulty"), F.col("count")).alias("items"), F.coalesce("level", F.lit("undergraduate")).alias("level"))


add("g16_workflow", workflow, PARAMETERS + f", i AS (SELECT *, {_route_sql()} AS intent FROM p) SELECT conv_id, turn, intent, {_lookup_sql('intent', requests.WORKFLOWS, '')} AS workflow, {_lookup_sql('intent', requests.STAGES, 'reply')} AS stages, CAST(CASE WHEN count > 0 THEN least(count, 30) WHEN intent = 'exam' THEN 20 WHEN difficulty IN ('hard', 'expert') THEN 8 ELSE 6 END AS INT) AS items, coalesce(level, 'undergraduate') AS level FROM i")
_FOLLOW = {k: "\n".join(v) for k, v in requests.FOLLOW_UPS.items()}
add("f31_follow_ups", lambda s, d: parameters(s, d).join(said_of(s, d), ["conv_id", "turn"]).select("conv_id", "turn", requests.follow_ups(route(F.col("low")), F.col("topic")).alias("suggestions")),
    PARAMETERS + f", i AS (SELECT *, {_route_sql()} AS intent FROM p) SELECT conv_id, turn, replace({_lookup_sql('intent', _FOLLOW, chr(10).join(requests.OTHERWISE))}, '{{}}', coalesce(topic, 'this topic')) AS suggestions FROM i")
add("p18_gives_up", lambda s, d: said_of(s, d).select("conv_id", "turn", requests.gives_up(F.col("low")).alias("gives_up")), SAID + f" SELECT conv_id, turn, regexp_matches(low, '{q('|'.join(requests.GIVE_UP))}') AS gives_up FROM a")
add("g19_guided_probe", lambda s, d: T(s, d, "conversations").select("conv_id", "turn", requests.probe(F.left("text", F.lit(60)), F.least(F.col("turn") + 1, F.lit(requests.MOST_SCAFFOLD)).cast("int")).alias("probe")),
    f"SELECT conv_id, turn, replace({strings(requests.PROBES)}[greatest(1, least(turn + 1, {requests.MOST_SCAFFOLD}))], '{{}}', regexp_replace({STRIP.format('left(text, 60)')}, '\\?+$', '')) AS probe FROM conversations")


def profile(s, d):
    """What a prompt is told of a learner."""
    m = mastery(s, d)
    names = lambda c: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(c)), 1, 5), lambda x: x["event_type"]), ", ")
    g = m.groupBy("user_id").agg(names(F.when(F.col("mastery") < 0.65, F.struct("mastery", "event_type"))).alias("weak"), names(F.when(F.col("mastery") >= 0.65, F.struct((-F.col("mastery")).alias("m"), "event_type"))).alias("strong"), F.sum("attempts").alias("n"))
    line = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c)))
    return g.select("user_id", F.concat_ws("\n", F.lit("Preferred explanation level: undergraduate"), F.lit("Preferred teaching style: detailed"), line("Weak areas (needs extra care): ", "weak"), line("Strong areas (can go faster): ", "strong"), F.concat(F.lit("Questions asked: "), F.col("n").cast("string"))).alias("profile"))


add("g17_learner_profile", profile, f"""WITH {MASTERY}, g AS (SELECT user_id, array_to_string(list(event_type ORDER BY mastery, event_type) FILTER (mastery < 0.65)[1:5], ', ') AS weak, array_to_string(list(event_type ORDER BY mastery DESC, event_type) FILTER (mastery >= 0.65)[1:5], ', ') AS strong, CAST(sum(attempts) AS BIGINT) AS n FROM m GROUP BY ALL)
  SELECT user_id, concat_ws(e'\\n', 'Preferred explanation level: undergraduate', 'Preferred teaching style: detailed', 'Weak areas (needs extra care): ' || nullif(weak, ''), 'Strong areas (can go faster): ' || nullif(strong, ''), 'Questions asked: ' || n) AS profile FROM g""")  # fmt: skip
_context, _context_sql = TABLES["g18_conversation_context"]
add("m26_memory_tokens", lambda s, d: _context(s, d).select("conv_id", tx.token_estimate(F.col("context")).alias("tokens")), f"SELECT conv_id, CAST(CASE WHEN length(context) = 0 THEN 0 ELSE greatest(len(string_split_regex({STRIP.format('context')}, '\\s+')), length(context) // 4 + 1) END AS INT) AS tokens FROM ({_context_sql})")
add("f37_derived_properties", lambda s, d: T(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(100 * F.col("l_discount") / F.nullif(F.col("l_tax"), F.lit(0.0)), 2).alias("percentage"), F.round(F.col("l_quantity") * 0.75 * 60).cast("int").alias("minutes"), F.when(F.col("l_tax") >= 0.06, 3).when(F.col("l_tax") >= 0.03, 2).otherwise(1).alias("level")).na.fill(0.0, ["percentage"]),
    "SELECT l_orderkey, l_linenumber, coalesce(round(100 * l_discount / nullif(l_tax, 0), 2), 0) AS percentage, CAST(round(l_quantity * 0.75 * 60) AS INT) AS minutes, CASE WHEN l_tax >= 0.06 THEN 3 WHEN l_tax >= 0.03 THEN 2 ELSE 1 END AS level FROM lineitem")
add("f38_ingest_summary", lambda s, d: T(s, d, "documents").select("doc_id", F.when(F.col("n_chars") < 40, F.concat("source", F.lit(": skipped (too short)"))).when(F.col("n_chars") > 50000, F.concat("source", F.lit(": failed - too long"))).otherwise(F.concat("source", F.lit(": "), F.ceil(F.col("n_chars") / 1100).cast("string"), F.lit(" chunks from "), F.ceil(F.col("n_chars") / 3000).cast("string"), F.lit(" pages ("), F.format_number("n_chars", 0), F.lit(" chars)"))).alias("summary")),
    "SELECT doc_id, CASE WHEN n_chars < 40 THEN source || ': skipped (too short)' WHEN n_chars > 50000 THEN source || ': failed - too long' ELSE source || ': ' || CAST(ceil(n_chars / 1100) AS BIGINT) || ' chunks from ' || CAST(ceil(n_chars / 3000) AS BIGINT) || ' pages (' || format('{:,}', n_chars) || ' chars)' END AS summary FROM documents")
