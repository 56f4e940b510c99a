"""Queries over stored rows: scans, filters, joins, aggregates, learner analytics and plans."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import scans
from quarry.sources.tables import table

QUERIES: dict = {}


def add(name, build, sql=None):
    QUERIES[name] = (build, sql)


T = table
add("s12_collection_scan", lambda s, d: T(s, d, "embeddings").select("label", "vec_id"), "SELECT label, vec_id FROM embeddings")
add("s13_point_lookup", lambda s, d: s.range(1).select(F.posexplode(F.array(*map(F.lit, (7, 3, 99999999, 3, 12)))).alias("pos", "id")).join(T(s, d, "documents"), F.col("id") == F.col("doc_id")).select("pos", "doc_id", "lang"), "SELECT CAST(i - 1 AS INT) AS pos, doc_id, lang FROM (SELECT unnest(range(1, 6)) AS i, unnest([7, 3, 99999999, 3, 12]) AS id) JOIN documents ON id = doc_id")
add("s14_recent_rows", lambda s, d: T(s, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
add("s19_latest_row", lambda s, d: T(s, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest")), "SELECT o_custkey, arg_max(o_orderkey, {'a': o_orderdate, 'b': o_orderkey}) AS latest FROM orders GROUP BY ALL")
add("s17_cache_read_ttl", lambda s, d: T(s, d, "events").join(F.broadcast(T(s, d, "events").agg(F.max("ts").alias("now")))).filter(F.expr("ts > now - INTERVAL 24 HOURS")).select("event_id"), "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOURS")
add("p01_metadata_filter", lambda s, d: T(s, d, "embeddings").filter(F.col("label").cast("string").isin("1", "4")).select("vec_id", "label"), "SELECT vec_id, label FROM embeddings WHERE CAST(label AS VARCHAR) IN ('1', '4')")
add("p02_filtered_count", lambda s, d: T(s, d, "embeddings").filter("label = 2").agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM embeddings WHERE label = 2")
add("p03_equality_where", lambda s, d: T(s, d, "orders").filter((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
add("p04_not_null_true", lambda s, d: T(s, d, "documents").join(T(s, d, "labels"), "doc_id", "left").filter(F.col("quality").isNotNull() & (F.col("toxic") == 1)).select("doc_id"), "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic = 1")
add("p05_time_range", lambda s, d: T(s, d, "events").join(F.broadcast(T(s, d, "events").agg(F.max("ts").alias("now")))).filter(F.expr("ts >= now - INTERVAL 7 DAYS")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS GROUP BY ALL")
add("p19_exists", lambda s, d: T(s, d, "customer").join(T(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
add("k01_vector_upsert", lambda s, d: T(s, d, "embeddings").join(T(s, d, "embeddings").filter("label = 5").select("vec_id"), "vec_id", "left_anti").select("vec_id", "label").unionByName(T(s, d, "embeddings").filter("label = 5").select("vec_id", F.lit(50).alias("label"))), "SELECT vec_id, CASE WHEN label = 5 THEN 50 ELSE label END AS label FROM embeddings")
add("k02_delete_by_document", lambda s, d: T(s, d, "embeddings").filter("label <> 3").groupBy("label").agg(F.count(F.lit(1)).alias("n")), "SELECT label, count(*) AS n FROM embeddings WHERE label <> 3 GROUP BY ALL")
add("k07_idempotent_ingest", lambda s, d: T(s, d, "documents").groupBy(F.substring(F.sha2("text", 256), 1, 32).alias("id")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "SELECT left(sha256(text), 32) AS id, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
add("k10_latest_state", lambda s, d: T(s, d, "orders").withColumn("r", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).filter("r = 1").select("o_custkey", "o_orderstatus"), "SELECT o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
add("k11_cascade_delete", lambda s, d: T(s, d, "lineitem").join(T(s, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")), "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL")
add("k12_unique_violations", lambda s, d: T(s, d, "documents").groupBy(F.sha2("text", 256).alias("sha256"), "n_chars").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "SELECT sha256(text) AS sha256, n_chars, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
add("k14_cache_stats", lambda s, d: T(s, d, "documents").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("text")).alias("bytes")), "SELECT count(*) AS entries, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents")
add("k16_counters", lambda s, d: T(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("value") > 10).alias("correct")), "SELECT user_id, count(*) AS reviewed, count(*) FILTER (value > 10) AS correct FROM events GROUP BY ALL")
add("k17_conversation_title", lambda s, d: T(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.when(F.col("role") == "user", F.left(F.trim("text"), F.lit(80))), F.when(F.col("role") == "user", F.col("turn"))).alias("title")), "SELECT conv_id, count(*) AS n, min_by(left(trim(text), 80), turn) FILTER (role = 'user') AS title FROM conversations GROUP BY ALL")
add("k15_render_conversation", lambda s, d: T(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(F.lit("**"), x["role"], F.lit("**: "), x["text"])), "\n\n").alias("markdown")), "SELECT conv_id, string_agg('**' || role || '**: ' || text, e'\\n\\n' ORDER BY turn, role, text) AS markdown FROM conversations GROUP BY ALL")
add("j05_left_outer_responses", lambda s, d: T(s, d, "conversations").filter("role = 'user'").alias("q").join(T(s, d, "conversations").filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")), ["conv_id", "turn"], "left").select("conv_id", "turn", F.length(F.coalesce("reply", F.lit(""))).alias("n")), "SELECT q.conv_id, q.turn, CAST(length(coalesce(a.text, '')) AS INT) AS n FROM conversations q LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'")
add("j06_left_semi", lambda s, d: T(s, d, "orders").join(T(s, d, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
add("j07_left_anti", lambda s, d: T(s, d, "documents").join(T(s, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
add("j08_positional_zip", lambda s, d: T(s, d, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(F.slice("embedding", 1, 4).alias("a"), F.slice("embedding", 5, 4).alias("b"))).alias("i", "x")).select("vec_id", "i", F.round(F.col("x.a").cast("double") + F.col("x.b").cast("double"), 6).alias("y")), "SELECT vec_id, CAST(i - 1 AS INT) AS i, round(CAST(embedding[i] AS DOUBLE) + CAST(embedding[i + 4] AS DOUBLE), 6) AS y FROM embeddings, range(1, 5) t(i)")
add("j09_parent_child", lambda s, d: T(s, d, "orders").join(T(s, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("items"), F.max("l_linenumber").alias("last")), "SELECT o_orderkey, count(*) AS items, max(l_linenumber) AS last FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
add("j11_revision_due", lambda s, d: _due(s, d), "WITH f AS (SELECT user_id, event_type, CAST(min(ts) AS DATE) AS day FROM events GROUP BY ALL) SELECT user_id, event_type, strftime(day + CAST(k AS INT), '%Y-%m-%d') AS due FROM f, (SELECT unnest([1, 3, 7, 14]) AS k)")


def _due(s, d):
    first = T(s, d, "events").groupBy("user_id", "event_type").agg(F.to_date(F.min("ts")).alias("day"))
    return first.select("user_id", "event_type", F.explode(F.array(*map(F.lit, (1, 3, 7, 14)))).alias("k"), "day").select("user_id", "event_type", F.date_format(F.date_add("day", F.col("k")), "yyyy-MM-dd").alias("due"))


add("a01_conditional_counts", lambda s, d: T(s, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done")), "SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders")
add("a02_sum_or_zero", lambda s, d: T(s, d, "lineitem").agg(F.round(F.coalesce(F.sum("l_quantity"), F.lit(0)), 2).alias("total"), F.coalesce(F.sum(F.when(F.col("l_quantity") < 0, F.col("l_quantity"))), F.lit(0.0)).alias("none")), "SELECT round(coalesce(sum(l_quantity), 0), 2) AS total, coalesce(sum(l_quantity) FILTER (l_quantity < 0), 0.0) AS none FROM lineitem")
add("a03_average_or_zero", lambda s, d: T(s, d, "orders").groupBy("o_orderpriority").agg(F.round(F.coalesce(F.avg("o_totalprice"), F.lit(0)), 4).alias("mean")), "SELECT o_orderpriority, round(coalesce(avg(o_totalprice), 0), 4) AS mean FROM orders GROUP BY ALL")
add("a04_distinct_values", lambda s, d: T(s, d, "documents").select("lang").distinct(), "SELECT DISTINCT lang FROM documents")
add("a05_count_by_source", lambda s, d: T(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")), "SELECT source, count(*) AS n FROM documents GROUP BY ALL")
add("a06_activity_by_day", lambda s, d: T(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n")), "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
add("a07_topic_breakdown", lambda s, d: T(s, d, "events").groupBy("user_id", "event_type").agg(F.round(100 * F.avg((F.col("value") > 10).cast("int")), 2).alias("percent")), "SELECT user_id, event_type, round(100 * avg(CAST(value > 10 AS INT)), 2) AS percent FROM events GROUP BY ALL")
add("a08_report_totals", lambda s, d: T(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("value") > 10).alias("correct"), F.round(F.sum(F.when(F.col("value") > 10, F.col("value")).otherwise(0)) / F.greatest(F.sum("value"), F.lit(1)) * 100, 2).alias("score")), "SELECT user_id, count(*) AS attempted, count(*) FILTER (value > 10) AS correct, round(sum(CASE WHEN value > 10 THEN value ELSE 0 END) / greatest(sum(value), 1) * 100, 2) AS score FROM events GROUP BY ALL")


def mastery(s, d):
    """Exponential mean of right answers in order of time; the first two count more."""
    log = T(s, d, "events").groupBy("user_id", "event_type").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", (F.col("value") > 10).cast("double").alias("ok")))).alias("log"), F.count(F.lit(1)).alias("attempts"), F.avg((F.col("value") > 10).cast("double")).alias("accuracy"), F.sum(F.round(F.col("value") * 10000).cast("bigint")).alias("total"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("m"))

    def step(a, x):
        w = F.when(a["n"] + 1 > 2, F.lit(0.4)).otherwise(F.lit(0.6))
        return F.struct((a["n"] + 1).alias("n"), F.round((1 - w) * a["m"] + w * x["ok"], 4).alias("m"))

    return log.select("user_id", "event_type", "attempts", F.round(F.col("accuracy") * 100, 2).alias("accuracy"), (F.expr("(2 * total + attempts) div (2 * attempts)") / 10000).alias("seconds"), F.aggregate("log", start, step, lambda a: a["m"]).alias("mastery"))


MASTERY = """l AS (SELECT user_id, event_type, list({'n': 0, 'm': CASE WHEN value > 10 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END} ORDER BY ts, event_id) AS log, count(*) AS attempts, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END) * 100, 2) AS accuracy, (2 * sum(CAST(round(value * 10000) AS BIGINT)) + count(*)) // (2 * count(*)) / 10000 AS seconds FROM events GROUP BY ALL),
 m AS (SELECT user_id, event_type, attempts, accuracy, seconds, list_reduce(list_prepend({'n': 0, 'm': CAST(0.0 AS DOUBLE)}, log), lambda a, x: {'n': a.n + 1, 'm': round(CASE WHEN a.n + 1 > 2 THEN CAST(0.6 AS DOUBLE) * a.m + CAST(0.4 AS DOUBLE) * x.m ELSE CAST(0.4 AS DOUBLE) * a.m + CAST(0.6 AS DOUBLE) * x.m END, 4)}).m AS mastery FROM l)"""
add("a10_mastery", lambda s, d: mastery(s, d).select("user_id", "event_type", "mastery"), f"WITH {MASTERY} SELECT user_id, event_type, mastery FROM m")
add("a09_topic_accuracy", lambda s, d: mastery(s, d).select("user_id", "event_type", "accuracy"), f"WITH {MASTERY} SELECT user_id, event_type, accuracy FROM m")
add("a11_weighted_mastery", lambda s, d: mastery(s, d).groupBy("user_id").agg(F.round(F.round(F.sum(F.col("mastery") * F.col("attempts")) / F.sum("attempts"), 9), 4).alias("overall")), f"WITH {MASTERY} SELECT user_id, round(round(sum(mastery * attempts) / sum(attempts), 9), 4) AS overall FROM m GROUP BY ALL")
BAND = "CASE WHEN attempts = 0 THEN 'unseen' WHEN mastery >= 0.85 THEN 'mastered' WHEN mastery >= 0.65 THEN 'competent' WHEN mastery >= 0.4 THEN 'developing' ELSE 'needs_work' END"
add("a13_status_bands", lambda s, d: mastery(s, d).select("user_id", "event_type", F.when(F.col("attempts") == 0, "unseen").when(F.col("mastery") >= 0.85, "mastered").when(F.col("mastery") >= 0.65, "competent").when(F.col("mastery") >= 0.4, "developing").otherwise("needs_work").alias("status"), "seconds"), f"WITH {MASTERY} SELECT user_id, event_type, {BAND} AS status, seconds FROM m")
add("a27_strongest_weakest", lambda s, d: mastery(s, d).groupBy("user_id").agg(F.max_by("event_type", F.struct("mastery", "event_type")).alias("strongest"), F.min_by("event_type", F.struct("mastery", "event_type")).alias("weakest")), f"WITH {MASTERY} SELECT user_id, arg_max(event_type, {{'a': mastery, 'b': event_type}}) AS strongest, arg_min(event_type, {{'a': mastery, 'b': event_type}}) AS weakest FROM m GROUP BY ALL")
add("t05_weak_topics", lambda s, d: mastery(s, d).filter("mastery < 0.65").withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy("mastery", F.desc("attempts"), "event_type"))).filter("place <= 3").select("user_id", "place", "event_type"), f"WITH {MASTERY} SELECT user_id, CAST(place AS INT) AS place, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mastery, attempts DESC, event_type) AS place FROM m WHERE mastery < 0.65) WHERE place <= 3")
add("t06_report_weak_strong", lambda s, d: _ends(s, d), f"WITH {MASTERY}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY accuracy, event_type) AS lo, row_number() OVER (PARTITION BY user_id ORDER BY accuracy DESC, event_type) AS hi FROM m) SELECT user_id, event_type, 'weak' AS side FROM r WHERE lo <= 3 AND accuracy < 70 UNION ALL SELECT user_id, event_type, 'strong' FROM r WHERE hi <= 3 AND accuracy >= 80")


def _ends(s, d):
    m = mastery(s, d).withColumn("lo", F.row_number().over(W.partitionBy("user_id").orderBy("accuracy", "event_type"))).withColumn("hi", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("accuracy"), "event_type")))
    weak = m.filter("lo <= 3 AND accuracy < 70").select("user_id", "event_type", F.lit("weak").alias("side"))
    return weak.unionByName(m.filter("hi <= 3 AND accuracy >= 80").select("user_id", "event_type", F.lit("strong").alias("side")))


add("p08_topic_predicates", lambda s, d: mastery(s, d).filter("attempts > 0 AND mastery < 0.65").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), f"WITH {MASTERY} SELECT event_type, count(*) AS n FROM m WHERE attempts > 0 AND mastery < 0.65 GROUP BY ALL")


def recommend(s, d):
    """What each learner should do next, from the weakest and strongest topics."""
    weak = F.array_sort(F.collect_list(F.when(F.col("mastery") < 0.65, F.struct("mastery", (-F.col("attempts")).alias("a"), "event_type"))))
    strong = F.array_sort(F.collect_list(F.when(F.col("mastery") >= 0.65, F.struct((-F.col("mastery")).alias("m"), "attempts", "event_type"))))
    g = mastery(s, d).groupBy("user_id").agg(weak.alias("weak"), strong.alias("strong"))
    names = lambda c, k: F.array_join(F.transform(F.slice(c, 1, k), lambda x: x["event_type"]), ", ")
    text = F.when(F.size("weak") > 0, F.when(F.get("weak", F.lit(0))["mastery"] < 0.4, F.concat(F.lit("Review "), names("weak", 1))).otherwise(F.concat(F.lit("Practise "), names("weak", 2)))).when(F.size("strong") > 0, F.concat(F.lit("Strong in "), names("strong", 2))).otherwise("Start")
    return g.select("user_id", text.alias("headline"), F.when(F.size("weak") > 0, 1).when(F.size("strong") > 0, 3).otherwise(4).alias("priority"))


add("g13_recommendation", recommend, f"""WITH {MASTERY}, w AS (SELECT user_id, list(event_type ORDER BY mastery, attempts DESC, event_type) AS names, min(mastery) AS least FROM m WHERE mastery < 0.65 GROUP BY ALL), s AS (SELECT user_id, list(event_type ORDER BY mastery DESC, attempts, event_type) AS names FROM m WHERE mastery >= 0.65 GROUP BY ALL)
 SELECT u.user_id, CASE WHEN w.names IS NOT NULL THEN CASE WHEN least < 0.4 THEN 'Review ' || w.names[1] ELSE 'Practise ' || array_to_string(w.names[1:2], ', ') END ELSE 'Strong in ' || array_to_string(s.names[1:2], ', ') END AS headline, CASE WHEN w.names IS NOT NULL THEN 1 ELSE 3 END AS priority FROM (SELECT DISTINCT user_id FROM m) u LEFT JOIN w USING (user_id) LEFT JOIN s USING (user_id)""")  # fmt: skip
add("a12_progress_snapshot", lambda s, d: mastery(s, d).agg(F.count(F.lit(1)).alias("topics"), F.sum("attempts").alias("attempts"), F.round(F.round(F.sum(F.col("mastery") * F.col("attempts")) / F.sum("attempts"), 9), 4).alias("overall"), F.count_if(F.col("mastery") < 0.65).alias("weak")).join(F.broadcast(T(s, d, "events").agg(F.countDistinct(F.to_date("ts")).alias("days")))).join(F.broadcast(T(s, d, "conversations").agg(F.countDistinct("conv_id").alias("threads")))), f"WITH {MASTERY} SELECT count(*) AS topics, CAST(sum(attempts) AS BIGINT) AS attempts, round(round(sum(mastery * attempts) / sum(attempts), 9), 4) AS overall, count(*) FILTER (mastery < 0.65) AS weak, (SELECT count(DISTINCT CAST(ts AS DATE)) FROM events) AS days, (SELECT count(DISTINCT conv_id) FROM conversations) AS threads FROM m")
add("a21_source_diversity", lambda s, d: T(s, d, "documents").groupBy("lang").agg(F.least(F.lit(1.0), F.countDistinct("source") / 2).alias("diversity")), "SELECT lang, least(1.0, count(DISTINCT source) / 2) AS diversity FROM documents GROUP BY ALL")
add("a22_distinct_in_order_last", lambda s, d: T(s, d, "events").groupBy("user_id", "props").agg(F.min("event_id").alias("first")).withColumn("r", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("first")))).filter("r <= 25 AND length(props) >= 8").select("user_id", "props"), "SELECT user_id, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first DESC) AS r FROM (SELECT user_id, props, min(event_id) AS first FROM events GROUP BY ALL)) WHERE r <= 25 AND length(props) >= 8")
add("a23_group_cards", lambda s, d: T(s, d, "part").groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_list("p_name")), "|").alias("cards")), "SELECT p_type, string_agg(p_name, '|' ORDER BY p_name) AS cards FROM part GROUP BY ALL")
add("a25_completeness", lambda s, d: T(s, d, "customer").select("c_custkey", F.round(F.least(F.lit(1.0), (F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.0) + F.when(F.col("c_mktsegment") == "BUILDING", 0.5).otherwise(0.0) + 1) / 2.5), 3).alias("filled")), "SELECT c_custkey, round(least(1.0, (CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 0.5 ELSE 0.0 END + 1) / 2.5), 3) AS filled FROM customer")
add("a28_describe", lambda s, d: T(s, d, "documents").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("source").alias("documents"), F.sum("n_chars").alias("chars")), "SELECT count(*) AS chunks, count(DISTINCT source) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents")
add("a29_timing_stats", lambda s, d: _timing(s, d), "WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events), a AS (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n, round(avg(value), 6) AS mean, max(CASE WHEN r = 1 THEN value END) AS last FROM l WHERE r <= 200 GROUP BY ALL) SELECT event_type, n, mean, last, v[least(CAST(floor(n * 0.95) AS BIGINT), n - 1) + 1] AS p95 FROM a")


def _timing(s, d):
    last = T(s, d, "events").withColumn("r", F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))).filter("r <= 200")
    g = last.groupBy("event_type").agg(F.array_sort(F.collect_list("value")).alias("v"), F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max(F.when(F.col("r") == 1, F.col("value"))).alias("last"))
    return g.select("event_type", "n", "mean", "last", F.element_at("v", (F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1) + 1).cast("int")).alias("p95"))


add("a30_counters", lambda s, d: T(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
add("a31_distinct_documents", lambda s, d: T(s, d, "documents").select("source").distinct(), "SELECT DISTINCT source FROM documents")
add("w05_last_turns", lambda s, d: T(s, d, "conversations").withColumn("r", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))).filter("r <= 6").select("conv_id", "turn", "role"), "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS r FROM conversations) WHERE r <= 6")
add("w07_ordered_dedup", lambda s, d: T(s, d, "documents").withColumn("r", F.row_number().over(W.partitionBy(F.sha2("text", 256)).orderBy("doc_id"))).filter("r = 1").select("doc_id"), "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
add("w08_stride_sample", lambda s, d: scans.numbered(T(s, d, "documents").select("source", "doc_id"), ["source"], [F.col("doc_id")], "i").join(T(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source").filter("i < greatest(3, floor(n / 4)) OR i % 5 = 0").select("source", "doc_id"), "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE i < greatest(3, n // 4) OR i % 5 = 0")
add("w10_rolling_mean", lambda s, d: scans.rolling(T(s, d, "events").select("event_type", "ts", "event_id", "value"), ["event_type"], [F.col("ts"), F.col("event_id")], 200, {"mean": lambda w: F.round(F.round(F.avg("value").over(w), 9), 6)}).select("event_id", "mean"), "SELECT event_id, round(round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 9), 6) AS mean FROM events")
add("w03_min_max", lambda s, d: T(s, d, "events").select("event_id", F.round((F.col("value") - F.min("value").over(W.partitionBy("user_id"))) / F.greatest(F.max("value").over(W.partitionBy("user_id")) - F.min("value").over(W.partitionBy("user_id")), F.lit(1e-9)), 6).alias("x")), "SELECT event_id, round((value - min(value) OVER w) / greatest(max(value) OVER w - min(value) OVER w, 1e-9), 6) AS x FROM events WINDOW w AS (PARTITION BY user_id)")
add("t07_order_limit", lambda s, d: T(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
add("t09_worst_five", lambda s, d: mastery(s, d).orderBy("accuracy", "user_id", "event_type").limit(5).select("user_id", "event_type", "accuracy"), f"WITH {MASTERY} SELECT user_id, event_type, accuracy FROM m ORDER BY accuracy, user_id, event_type LIMIT 5")
add("u01_variant_union", lambda s, d: T(s, d, "benchmark").select("item_id", F.explode(F.array("text", F.concat(F.lit(" "), "text"), F.left("text", F.lit(20)))).alias("v")).select("item_id", F.lower(F.trim("v")).alias("v")).distinct(), "SELECT DISTINCT item_id, lower(trim(v)) AS v FROM (SELECT item_id, unnest([text, ' ' || text, left(text, 20)]) AS v FROM benchmark)")
add("u06_merge_by_url", lambda s, d: T(s, d, "pages").withColumn("k", F.lower(F.regexp_replace("url", r"[?#].*$", ""))).withColumn("r", F.row_number().over(W.partitionBy("k").orderBy("page_id"))).filter("r = 1").select("page_id"), "SELECT min(page_id) AS page_id FROM pages GROUP BY lower(regexp_replace(url, '[?#].*$', ''))")
add("m15_duration_minutes", lambda s, d: T(s, d, "events").groupBy("user_id").agg(F.round((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 6e7, 4).alias("minutes")), "SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7, 4) AS minutes FROM events GROUP BY ALL")
add("c05_map_merge", lambda s, d: T(s, d, "part").select("p_partkey", F.explode(F.map_from_entries(F.array(F.struct(F.lit("brand").alias("k"), F.col("p_brand").alias("v")), F.struct(F.lit("type").alias("k"), F.col("p_type").alias("v"))))).alias("k", "v")), "SELECT p_partkey, 'brand' AS k, p_brand AS v FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part")
add("s01_loader_dispatch", lambda s, d: T(s, d, "pages").select("page_id", _loader(F.concat(F.lit("f"), F.element_at(F.array(*map(F.lit, (".txt", ".MD", ".csv", ".html", ".exe"))), (F.col("page_id") % 5 + 1).cast("int")))).alias("loader")), "SELECT page_id, ['text', 'markdown', 'table', 'html', 'unsupported'][page_id % 5 + 1] AS loader FROM pages")


def _loader(path):
    ext = F.lower(F.regexp_extract(path, r"\.[^.]+$", 0))
    return F.when(ext.isin(".txt", ".text", ".log"), "text").when(ext.isin(".md", ".markdown", ".mdx", ".rst"), "markdown").when(ext.isin(".csv", ".tsv"), "table").when(ext.isin(".html", ".htm"), "html").otherwise("unsupported")


add("s05_html_loader", lambda s, d: T(s, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", "(?is)<h1[^>]*>(.*?)</h1>", 1).alias("heading"), F.length(F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "(?s)<[^>]+>", "")).alias("n")), "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS heading, CAST(length(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', '', 'g')) AS INT) AS n FROM pages")
add("s11_page_links", lambda s, d: T(s, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("i", "link")).filter("i < 20"), "SELECT page_id, CAST(i AS INT) AS i, link FROM (SELECT page_id, unnest(range(len(l))) AS i, unnest(l) AS link FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS l FROM pages)) WHERE i < 20")


def study_plan(s, d, days=21, hours=2.0):
    """A plan per region over its nations: rest days, mock exams at the end, spaced revision."""
    topics = T(s, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("queue"))
    plan = topics.select("n_regionkey", "queue", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day"))
    left = F.lit(days) - F.col("day")
    rest = (F.lit(days) >= 6) & (F.col("day") % 7 == 0) & (left > 1)
    exam = (left <= 1) & F.lit(days >= 3)
    studied = (F.col("day") - 1 - F.floor((F.col("day") - 1) / 7)).cast("int")  # study days before this one
    primary = F.when(F.col("day") <= F.size("queue"), F.element_at("queue", F.least(F.col("day"), F.size("queue")))).otherwise(F.element_at("queue", (studied % F.size("queue") + 1).cast("int")))
    kind = F.when(rest, "rest").when(exam, "mock").otherwise("study")
    h = F.when(rest, F.least(F.lit(1.0), F.lit(0.4 * hours))).when(exam, F.least(F.lit(hours), F.greatest(F.lit(1.0), F.lit(0.8 * hours)))).otherwise(F.least(F.lit(hours), F.greatest(F.lit(0.75), F.lit(0.9 * hours))))
    return plan.select("n_regionkey", "day", kind.alias("kind"), F.when(kind == "study", primary).alias("topic"), F.round(h, 4).alias("hours"))


PLAN = "q AS (SELECT n_regionkey, list(n_name ORDER BY n_name) AS queue FROM nation GROUP BY ALL), p AS (SELECT n_regionkey, queue, CAST(day AS INT) AS day, CASE WHEN day % 7 = 0 AND 21 - day > 1 THEN 'rest' WHEN 21 - day <= 1 THEN 'mock' ELSE 'study' END AS kind FROM q, range(1, 22) t(day))"
PLAN_ROWS = f"WITH {PLAN}, o AS (SELECT n_regionkey, day, kind, CASE WHEN kind <> 'study' THEN NULL WHEN day <= len(queue) THEN queue[day] ELSE queue[(day - 1 - (day - 1) // 7) % len(queue) + 1] END AS topic, CAST(CASE kind WHEN 'rest' THEN 0.8 WHEN 'mock' THEN 1.6 ELSE 1.8 END AS DOUBLE) AS hours FROM p)"
add("g09_study_plan", study_plan, PLAN_ROWS + " SELECT * FROM o")
add("g11_plan_totals", lambda s, d: study_plan(s, d).groupBy("n_regionkey").agg(F.round(F.sum("hours"), 4).alias("hours"), F.count_if(F.col("kind") == "rest").alias("rest_days")), PLAN_ROWS + " SELECT n_regionkey, round(sum(hours), 4) AS hours, count(*) FILTER (kind = 'rest') AS rest_days FROM o GROUP BY ALL")
add("g12_adjust_plan", lambda s, d: study_plan(s, d).filter("day > 5").select("n_regionkey", (F.col("day") - 5).alias("day"), "kind"), PLAN_ROWS + " SELECT n_regionkey, day - 5 AS day, kind FROM o WHERE day > 5")
add("g18_conversation_context", lambda s, d: T(s, d, "conversations").withColumn("r", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text"))).filter("r <= 6").groupBy("conv_id").agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(F.when(x["role"] == "user", "Learner: ").otherwise("Tutor: "), F.left(x["text"], F.lit(600)))), "\n"), F.lit(2400)).alias("context")), "SELECT conv_id, left(string_agg(CASE WHEN role = 'user' THEN 'Learner: ' ELSE 'Tutor: ' END || left(text, 600), e'\\n' ORDER BY turn, role, text), 2400) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS r FROM conversations) WHERE r <= 6 GROUP BY ALL")
