"""Queries over rankings, token sets, plans and derived properties, and the batch results of streams."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import vectors
from quarry.plans.retrieval_queries import PAIR, POST, asked, asked_vectors, docs_of, sims
from quarry.plans.text_queries import TOKEN_SQL
from quarry.sources.postings import shared_terms
from quarry.sources.tables import table as T
from quarry.streaming import events, ingest

QUERIES: dict = {}


def add(name, build, sql=None):
    QUERIES[name] = (build, sql)


def ranked(s, d, name, kind, values):
    emb = T(s, d, "embeddings")
    return vectors.placed(emb, asked_vectors(emb), name, kind, values)


def blended(s, d):
    """A label's quality weighs more than the similarity, where a vector has one; labels are put to the vectors, not to the pairs."""
    emb = T(s, d, "embeddings")
    labelled = emb.join(T(s, d, "labels").select(F.col("doc_id").alias("vec_id"), "quality"), "vec_id", "left")

    def score(like, quality):
        known = pc.is_valid(quality).to_numpy(zero_copy_only=False)[:, None]
        return vectors.rounded(np.where(known, 0.65 * pc.fill_null(quality, 0).to_numpy(zero_copy_only=False)[:, None] + 0.35 * like, like), 9)

    return vectors.similarities(labelled, asked_vectors(emb), ("quality",), score).withColumnRenamed("similarity", "score")


RANKED = f"WITH {PAIR}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) - 1 AS pos, count(*) OVER (PARTITION BY query_id) AS n FROM sim)"
add("a18_list_bounds", lambda s, d: sims(s, d).groupBy("query_id").agg(F.min("similarity").alias("low"), F.max("similarity").alias("high")), f"WITH {PAIR} SELECT query_id, min(similarity) AS low, max(similarity) AS high FROM sim GROUP BY ALL")
add("a19_best_of_variants", lambda s, d: sims(s, d).groupBy((F.col("query_id") % 400).alias("question"), "vec_id").agg(F.max("similarity").alias("best")), f"WITH {PAIR} SELECT query_id % 400 AS question, vec_id, max(similarity) AS best FROM sim GROUP BY ALL")
add("w01_rank_of_list", lambda s, d: ranked(s, d, "place", "int", lambda n: np.arange(1, n + 1, dtype=np.int32)), f"{RANKED} SELECT query_id, vec_id, CAST(pos + 1 AS INT) AS place FROM r")
add("w02_position_prior", lambda s, d: ranked(s, d, "prior", "double", lambda n: vectors.rounded(1 - np.arange(n) / n, 6)), f"{RANKED} SELECT query_id, vec_id, round(1 - pos / n, 6) AS prior FROM r")
add("p07_grounding_floor", lambda s, d: sims(s, d).filter("similarity >= 0.15").select("query_id", "vec_id"), f"WITH {PAIR} SELECT query_id, vec_id FROM sim WHERE similarity >= 0.15")
add("j04_terms_and_postings", lambda s, d: shared_terms(docs_of(s, d), asked(s, d)), POST + f", q AS (SELECT DISTINCT item_id AS query_id, unnest({TOKEN_SQL.format('text')}) AS term FROM benchmark) SELECT query_id, doc_id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS hits FROM q JOIN post USING (term) GROUP BY ALL")
add("r09_blended_rerank", blended, f"WITH {PAIR} SELECT query_id, vec_id, round(coalesce(CAST(0.65 AS DOUBLE) * quality + CAST(0.35 AS DOUBLE) * similarity, similarity), 9) AS score FROM sim LEFT JOIN labels ON vec_id = doc_id")


def dialogue(s, d):
    turns = T(s, d, "conversations")
    reply = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return turns.filter("role = 'user'").join(reply, ["conv_id", "turn"])


DIALOGUE = "FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn - 1 = q.turn AND a.role = 'assistant' AND q.role = 'user'"
add("j13_overlap_terms", lambda s, d: dialogue(s, d).select("conv_id", "turn", F.size(F.array_intersect(tx.tokens(F.col("text")), tx.tokens(F.col("reply")))).alias("shared")), f"SELECT q.conv_id, q.turn, CAST(len(list_distinct(list_intersect({TOKEN_SQL.format('q.text')}, {TOKEN_SQL.format('a.text')}))) AS INT) AS shared {DIALOGUE}")
add("u04_token_coverage", lambda s, d: dialogue(s, d).select("conv_id", "turn", F.array_distinct(tx.tokens(F.col("text"))).alias("q"), tx.tokens(F.col("reply")).alias("a")).select("conv_id", "turn", F.round(F.size(F.array_intersect("q", "a")) / F.greatest(F.size("q"), F.lit(1)), 6).alias("coverage")), f"SELECT conv_id, turn, round(len(list_distinct(list_intersect(x, y))) / greatest(len(list_distinct(x)), 1), 6) AS coverage FROM (SELECT q.conv_id, q.turn, {TOKEN_SQL.format('q.text')} AS x, {TOKEN_SQL.format('a.text')} AS y {DIALOGUE})")
add("c08_boosted_terms", lambda s, d: asked(s, d).select("query_id", F.explode(F.flatten(F.transform(tx.tokens(F.col("text")), lambda x: F.array(x, x)))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n")), f"SELECT query_id, term, 2 * count(*) AS n FROM (SELECT item_id AS query_id, unnest({TOKEN_SQL.format('text')}) AS term FROM benchmark) GROUP BY ALL")
add("c04_head_and_stride", lambda s, d: T(s, d, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("head"), F.filter("embedding", lambda x, i: i % 16 == 0).alias("every")).select("vec_id", F.col("head")[3].alias("fourth"), F.col("every")[3].alias("at_48"), F.size("every").alias("n")), "SELECT vec_id, embedding[1:4][4] AS fourth, embedding[1::16][4] AS at_48, CAST(len(embedding[1::16]) AS INT) AS n FROM (SELECT vec_id, CAST(embedding AS FLOAT[]) AS embedding FROM embeddings)".replace("embedding[1::16]", "embedding[1:-1:16]"))
add("c06_map_by_group", lambda s, d: T(s, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m")).select("user_id", F.explode("m").alias("topic", "n")), "SELECT user_id, event_type AS topic, count(*) AS n FROM events GROUP BY ALL")
add("c07_first_terms", lambda s, d: asked(s, d).select("query_id", F.posexplode(F.slice(tx.tokens(F.col("text")), 1, 14)).alias("i", "term")), f"SELECT query_id, CAST(i AS INT) AS i, term FROM (SELECT item_id AS query_id, unnest(range(len(l))) AS i, unnest(l) AS term FROM (SELECT item_id, {TOKEN_SQL.format('text')} AS l FROM benchmark)) WHERE i < 14")
add("p16_ocr_needed", lambda s, d: T(s, d, "documents").select("doc_id", (F.length(F.trim("text")) < 180).alias("needed")), "SELECT doc_id, length(trim(text)) < 180 AS needed FROM documents")
add("s16_describe", lambda s, d: T(s, d, "documents").select("doc_id", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha256")), "SELECT doc_id, CAST(strlen(text) AS INT) AS size, sha256(text) AS sha256 FROM documents")
add("a24_totals", lambda s, d: T(s, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("points")), "SELECT l_orderkey, round(sum(l_quantity), 2) AS points FROM lineitem GROUP BY ALL")
add("a32_telemetry_snapshot", lambda s, d: T(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("last"), F.round(F.avg("value"), 6).alias("mean")), "SELECT event_type, count(*) AS n, arg_max(value, {'a': ts, 'b': event_id}) AS last, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
add("m19_plan_dates", lambda s, d: T(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("first"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("o_orderkey", "i", F.date_format(F.date_add("first", F.col("i")), "yyyy-MM-dd").alias("day")), "SELECT o_orderkey, CAST(i AS INT) AS i, strftime(CAST(o_orderdate AS DATE) + CAST(i AS INT), '%Y-%m-%d') AS day FROM orders, range(5) t(i)")
add("m25_coerced_parameters", lambda s, d: T(s, d, "part").select("p_partkey", F.when(F.lower("p_type").isin("easy", "medium", "hard"), F.lower("p_type")).alias("level"), F.expr("try_cast(regexp_extract(p_brand, '([0-9]+)', 1) AS INT)").alias("count")), "SELECT p_partkey, CASE WHEN lower(p_type) IN ('easy', 'medium', 'hard') THEN lower(p_type) END AS level, TRY_CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) AS count FROM part")


def _kind():
    docs, web = F.count_if(F.col("l_returnflag") == "R") > 0, F.count_if(F.col("l_returnflag") == "A") > 0
    return F.when(docs & web, "mixed").when(docs, "documents").when(web, "web").otherwise("none")


add("f35_evidence_kind", lambda s, d: T(s, d, "lineitem").groupBy("l_orderkey").agg(_kind().alias("kind")), "SELECT l_orderkey, CASE WHEN r AND a THEN 'mixed' WHEN r THEN 'documents' WHEN a THEN 'web' ELSE 'none' END AS kind FROM (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS r, bool_or(l_returnflag = 'A') AS a FROM lineitem GROUP BY ALL)")


def _queue(s, d):
    share = 100 * F.avg((F.col("value") > 10).cast("int"))
    seen = T(s, d, "events").groupBy("user_id", "event_type").agg(F.when(share < 60, 0).when(share < 80, 1).otherwise(2).alias("band"))
    return seen.select("user_id", "event_type", F.row_number().over(W.partitionBy("user_id").orderBy("band", "event_type")).alias("place"))


add("u07_study_queue", _queue, "WITH b AS (SELECT user_id, event_type, 100 * avg(CAST(value > 10 AS INT)) AS p FROM events GROUP BY ALL) SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN p < 60 THEN 0 WHEN p < 80 THEN 1 ELSE 2 END, event_type) AS INT) AS place FROM b")
add("x03_incremental_ingest", ingest.distinct_texts, "SELECT left(sha256(text), 32) AS id, CAST(max(length(text)) AS INT) AS length FROM documents GROUP BY 1")
add("x04_running_day_counts", events.day_counts, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
