"""Queries on the way from retrieved passages to an answer: passages, embeddings, citations, confidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import bm25, digest, hashing, passages, vectors
from quarry.plans.retrieval_queries import FUSED, QUERIES as RETRIEVAL, SCORE, TOP, asked, dense_candidates, docs_of, hybrid, nearest, reranked, searched
from quarry.sources.tables import table as T

QUERIES: dict = {}


def add(name, build, sql=None):
    QUERIES[name] = (build, sql)


add("r02_split_long_block", lambda s, d: docs_of(s, d).select("doc_id", F.posexplode(passages.pack(tx.sentences(F.col("text"), 40))).alias("place", "passage")))
add("m11_stable_hash", lambda s, d: digest.stable_hash(docs_of(s, d), "doc_id", "text"))
add("m03_hashing_embedding", lambda s, d: hashing.embed(docs_of(s, d).select("doc_id", "text")))


def compressed(s, d):
    pool = searched(s, d, 8).join(docs_of(s, d), "doc_id").join(asked(s, d).withColumnRenamed("text", "question"), "query_id")
    # a passage that is a table stays whole
    lines = F.when(F.regexp_count("text", F.lit(r"\|")) >= 4, F.array("text")).otherwise(passages.compress(tx.sentences(F.col("text")), F.array_distinct(tx.tokens(F.col("question")))))
    short = F.array_join(lines, "\n")
    return pool.select("query_id", "doc_id", short.alias("passage"), F.round(F.length(short) / F.greatest(F.length("text"), F.lit(1)), 6).alias("ratio"))


add("r11_compress", compressed)


def candidates(s, d, pool=24):
    dense = dense_candidates(s, d, pool).select("query_id", F.col("vec_id").alias("item"), F.col("similarity").alias("dense"))
    sparse = searched(s, d, pool).select("query_id", F.col("doc_id").alias("item"), F.col("score").alias("sparse"))
    return dense.join(sparse, ["query_id", "item"], "full_outer").na.fill(0.0, ["dense", "sparse"])


add("j02_full_outer_candidates", candidates, FUSED + " SELECT query_id, item, coalesce(dl.score, 0) AS dense, coalesce(sl.score, 0) AS sparse FROM dl FULL JOIN sl USING (query_id, item)")
add("u03_union_of_candidates", lambda s, d: candidates(s, d).select("query_id", "item"), FUSED + " SELECT query_id, item FROM dl UNION SELECT query_id, item FROM sl")
add("t02_bm25_top_k", lambda s, d: searched(s, d, 5), SCORE + TOP.replace("{}", "").replace("<= 10", "<= 5"))
add("t03_fused_top_k", lambda s, d: hybrid(s, d, k=5).select("query_id", "item", "rank"), FUSED + " SELECT query_id, item, rank FROM top WHERE rank <= 5")


def citations(s, d, most=8):
    cited = searched(s, d, most).join(docs_of(s, d), "doc_id")
    return cited.select("query_id", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")).alias("marker"), "doc_id", "source", "score")


add("r14_build_citations", citations, SCORE + f", top AS ({TOP.replace('{}', '').replace('<= 10', '<= 8')}) SELECT query_id, '[' || rank || ']' AS marker, doc_id, source, score FROM top JOIN documents USING (doc_id)")


def grounded(s, d):
    """Markers of an answer against the three that it was given; the turn gives one marker, the text the others."""
    answer = F.concat("text", F.lit(" ["), (F.col("turn") + 1).cast("string"), F.lit("] [2]"))
    used = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda m: m.cast("int")))
    given = F.array(*map(F.lit, (1, 2, 3)))
    said = T(s, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", used.alias("used"))
    in_order = lambda xs: F.array_join(F.transform(F.array_sort(xs), lambda m: m.cast("string")), ",")
    return said.select("conv_id", "turn", in_order(F.array_intersect("used", given)).alias("kept"), in_order(F.array_except("used", given)).alias("fabricated"))


add("r15_verify_grounding", grounded, r"""WITH a AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_extract_all(text || ' [' || (turn + 1) || '] [2]', '\[(\d{1,2})\]', 1), lambda m: CAST(m AS INT))) AS used FROM conversations WHERE role = 'assistant')
  SELECT conv_id, turn, array_to_string(list_sort(list_filter(used, lambda m: m IN (1, 2, 3))), ',') AS kept, array_to_string(list_sort(list_filter(used, lambda m: m NOT IN (1, 2, 3))), ',') AS fabricated FROM a""")  # fmt: skip


def confidence(s, d):
    """Of a retrieval without an answer yet; what the passages share with the question gates the whole."""
    found = reranked(s, d)
    terms = asked(s, d).select("query_id", tx.key_terms(F.col("text"), 10).alias("q"))
    lead = found.filter("place <= 4").join(docs_of(s, d), "doc_id").join(terms, "query_id")
    covered = lead.groupBy("query_id").agg(F.sum(F.size(F.array_intersect("q", tx.key_terms(F.col("text"), 400)))).alias("covered"), F.max(F.size("q")).alias("n_terms"))
    top = found.groupBy("query_id").agg(F.max("rerank").alias("top"), F.avg(F.when(F.col("place") <= 3, F.col("rerank"))).alias("three"), F.count_distinct("doc_id").alias("n_docs"))
    coverage = F.when(F.col("n_terms") > 0, F.least(F.lit(1.0), F.col("covered") / F.col("n_terms"))).otherwise(0.5)
    blend = 0.30 * F.col("top") + 0.20 * F.col("three") + 0.15 * F.least(F.lit(1.0), F.col("n_docs") / 2) + 0.20 * F.col("coverage")
    gate = F.when(F.col("n_terms") > 0, F.least(F.lit(1.0), F.col("coverage") / 0.2)).otherwise(1.0)
    rows = top.join(covered, "query_id").withColumn("coverage", coverage)
    return rows.select("query_id", F.round("coverage", 6).alias("coverage"), F.round(F.least(F.lit(1.0), blend * gate), 4).alias("confidence"))


def _key_sql(table_: str, key: str, most: int) -> str:
    words = f"SELECT id, i, lower(w) AS term FROM (SELECT {key} AS id, unnest(range(len(l))) AS i, unnest(l) AS w FROM (SELECT {key}, regexp_extract_all(text, '{tx.WORD_OR_NUMBER.replace(chr(39), chr(39) * 2)}', 0) AS l FROM {table_}))"
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.CONTENT_STOPWORDS)
    return f"(SELECT id, term FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(i), term) AS r FROM ({words}) WHERE length(term) >= 2 AND regexp_matches(term, '^[a-z]') AND term NOT IN ({stop}) GROUP BY id, term) WHERE r <= {most})"


add("r17_confidence", confidence, f"""WITH found AS ({RETRIEVAL["r07_local_rerank"][1]}), qk AS {_key_sql("benchmark", "item_id", 10)}, dk AS {_key_sql("documents", "doc_id", 400)},
  size AS (SELECT item_id AS query_id, count(term) AS n_terms FROM benchmark LEFT JOIN qk ON id = item_id GROUP BY ALL),
  cov AS (SELECT query_id, count(dk.term) AS covered FROM found LEFT JOIN qk ON qk.id = query_id LEFT JOIN dk ON dk.id = doc_id AND dk.term = qk.term WHERE place <= 4 GROUP BY ALL),
  top AS (SELECT query_id, max(rerank) AS top, avg(rerank) FILTER (place <= 3) AS three, count(DISTINCT doc_id) AS n_docs FROM found GROUP BY ALL),
  x AS (SELECT *, CASE WHEN n_terms > 0 THEN least(CAST(1 AS DOUBLE), covered / n_terms) ELSE 0.5 END AS c FROM top JOIN cov USING (query_id) JOIN size USING (query_id))
  SELECT query_id, round(c, 6) AS coverage, round(least(CAST(1 AS DOUBLE), (0.3::DOUBLE * top + 0.2::DOUBLE * three + 0.15::DOUBLE * least(CAST(1 AS DOUBLE), n_docs / 2) + 0.2::DOUBLE * c) * CASE WHEN n_terms > 0 THEN least(CAST(1 AS DOUBLE), c / 0.2::DOUBLE) ELSE 1 END), 4) AS confidence FROM x""")  # fmt: skip


def tutor(s, d):
    """Confidence of an explanation: fixed without passages, else a little below the retrieval's, with a floor."""
    asked_ = T(s, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    # a question's own vector is no passage for it, so the best other one is among two
    best = nearest(s, d, 2)
    best = best.filter("vec_id <> query_id AND similarity >= 0.4").groupBy("query_id").agg(F.max("similarity").alias("c"))
    return asked_.join(best, "query_id", "left").select("query_id", F.when(F.col("c").isNull(), 0.35).otherwise(F.round(F.greatest(0.95 * F.col("c"), F.lit(0.45)), 6)).alias("confidence"))


add("g20_tutor_confidence", tutor, RETRIEVAL["m02_cosine"][1].replace("SELECT query_id, vec_id, similarity FROM sim", "SELECT v.vec_id AS query_id, CASE WHEN c IS NULL THEN 0.35::DOUBLE ELSE round(greatest(0.95::DOUBLE * c, 0.45::DOUBLE), 6) END AS confidence FROM v LEFT JOIN (SELECT query_id, max(similarity) AS c FROM sim WHERE vec_id <> query_id AND similarity >= 0.4 GROUP BY ALL) ON query_id = v.vec_id WHERE v.vec_id % 100 = 0"))
CLAIM = r"(?i)(?:according to|sourced? (?:from|in)|as (?:stated|described|shown) in)\s+\[?([^\]\n.,;]{3,80})\]?"
add("f19_source_claims", lambda s, d: T(s, d, "part").select("p_partkey", F.array_join(F.regexp_extract_all(F.concat(F.lit("As shown in ["), F.col("p_name"), F.lit("], and according to "), F.col("p_type"), F.lit("; ok")), F.lit(CLAIM), F.lit(1)), "|").alias("claims")), f"SELECT p_partkey, array_to_string(regexp_extract_all('As shown in [' || p_name || '], and according to ' || p_type || '; ok', '{CLAIM}', 1), '|') AS claims FROM part")
add("f33_topic_seed", lambda s, d: T(s, d, "part").select("p_partkey", F.left(F.regexp_replace("p_name", r"\W+", ""), F.lit(32)).alias("seed")), r"SELECT p_partkey, left(regexp_replace(p_name, '\W+', '', 'g'), 32) AS seed FROM part")
SPACES = r"[ \t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
add("f29_clean_context", lambda s, d: docs_of(s, d).select("doc_id", F.sha2(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " "), "^ | $", ""), 256).alias("digest")), f"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g'))) AS digest FROM documents")
add("u08_tag_merge", lambda s, d: T(s, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_union(F.split("p_name", " "), F.split("p_type", " "))), ",").alias("tags")), "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' ') || string_split(p_type, ' '))), ',') AS tags FROM part")
STATED = r"\b(\d{1,3})\s*(days?|weeks?)\b"


def stated_days(s, d):
    said = F.concat(F.lit("I have "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.lit(" weeks left")).otherwise(F.lit(" days left")))
    n = F.regexp_extract(said, STATED, 1).cast("int")
    return T(s, d, "part").select("p_partkey", F.when(F.regexp_extract(said, STATED, 2).startswith("week"), n * 7).otherwise(n).alias("days"))


add("m17_typed_days", stated_days, "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size * 7 ELSE p_size END AS days FROM part")
