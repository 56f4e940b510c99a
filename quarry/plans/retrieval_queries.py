"""Queries over sparse, dense and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import bm25, fusion, vectors
from quarry.plans.text_queries import TOKEN_SQL
from quarry.sources.cells import CellVectors
from quarry.sources.postings import documents_index
from quarry.sources.tables import table

QUERIES: dict = {}


def add(name, build, sql=None):
    QUERIES[name] = (build, sql)


def docs_of(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source")


def asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


#: Rows found up to which they are sent to the tasks that read the documents, so that no text is dealt out.
SENT_ROWS = 100_000


def sent(rows, most):
    """Rows, ``most`` of them at most, that are joined where the other side is, if they are few."""
    return F.broadcast(rows) if most <= SENT_ROWS else rows


def searched(spark, d, k, queries=None, allowed=None):
    """The k best documents of each query, from the stored index."""
    queries = asked(spark, d) if queries is None else queries
    return sent(documents_index(spark, d).search(queries, k, allowed), queries.count() * k)


POST = f"WITH tok AS (SELECT doc_id, unnest({TOKEN_SQL.format('text')}) AS term FROM documents), post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), len AS (SELECT d.doc_id, count(term) AS dl FROM documents d LEFT JOIN tok USING (doc_id) GROUP BY ALL), stats AS (SELECT count(*) AS n, avg(greatest(dl, 1)) AS avgdl FROM len), df AS (SELECT term, count(*) AS df FROM post GROUP BY ALL)"
SCORE = (
    POST
    + f", qt AS (SELECT item_id AS query_id, unnest({TOKEN_SQL.format('text')}) AS term FROM benchmark), q AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY ALL), sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (1 + ln(qtf)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / avgdl))), 6) AS score FROM q JOIN post USING (term) JOIN df USING (term) JOIN len USING (doc_id), stats GROUP BY ALL)"
)
TOP = "SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc {}) WHERE rank <= 10"

add("r05_bm25_search", lambda spark, d: searched(spark, d, 10), SCORE + TOP.replace("{}", ""))
add("r05_bm25_filtered", lambda spark, d: searched(spark, d, 10, allowed=F.col("source").isin("src1", "src2")), SCORE + TOP.replace("{}", "JOIN documents USING (doc_id) WHERE source IN ('src1', 'src2')"))
add("a15_term_frequency", lambda spark, d: bm25.postings(docs_of(spark, d)), POST + " SELECT doc_id, term, tf FROM post")
add("a14_document_frequency", lambda spark, d: bm25.frequencies(docs_of(spark, d)), POST + " SELECT term, df FROM df")
add("a16_average_length", lambda spark, d: bm25.corpus_stats(bm25.lengths(docs_of(spark, d))).select("n", F.round("avgdl", 6).alias("avgdl")), POST + " SELECT n, round(avgdl, 6) AS avgdl FROM stats")
add("a17_idf", lambda spark, d: bm25.frequencies(docs_of(spark, d)).join(F.broadcast(docs_of(spark, d).agg(F.count(F.lit(1)).alias("n")))).select("term", F.round(bm25.idf(F.col("n"), F.col("df")), 6).alias("idf")), POST + " SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, stats")
add("k04_index_add", lambda spark, d: bm25.postings(docs_of(spark, d).filter("doc_id % 2 = 0")).unionByName(bm25.postings(docs_of(spark, d).filter("doc_id % 2 = 1"))).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), POST + " SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")
add("k05_index_remove", lambda spark, d: bm25.postings(docs_of(spark, d)).join(docs_of(spark, d).filter("source = 'src3'").select("doc_id"), "doc_id", "left_anti").groupBy("term").agg(F.count(F.lit(1)).alias("df")), POST + " SELECT term, count(*) AS df FROM post JOIN documents USING (doc_id) WHERE source <> 'src3' GROUP BY term")
add("w06_first_position", lambda spark, d: docs_of(spark, d).select("doc_id", F.posexplode(tx.tokens(F.col("text"))).alias("i", "term")).groupBy("doc_id", "term").agg(F.min("i").alias("first")), f"SELECT doc_id, term, CAST(min(i) AS INT) AS first FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS term FROM (SELECT doc_id, {TOKEN_SQL.format('text')} AS l FROM documents)) GROUP BY ALL")

VEC = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
DOT = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))"
PAIR = f"v AS (SELECT vec_id, label, {VEC} AS v FROM embeddings), sim AS (SELECT b.vec_id AS query_id, a.vec_id, a.label, round(greatest({DOT} / sqrt(list_sum(list_transform(a.v, lambda x: x * x))) / sqrt(list_sum(list_transform(b.v, lambda x: x * x))), 0.0), 6) AS similarity FROM v a, v b WHERE b.vec_id % 100 = 0)"


def asked_vectors(emb):
    return emb.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def sims(spark, d):
    emb = table(spark, d, "embeddings")
    return vectors.similarities(emb, asked_vectors(emb))


def nearest(spark, d, k, where=None):
    emb = table(spark, d, "embeddings")
    asked_ = emb.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return bm25.best(vectors.nearest(emb if where is None else emb.filter(where), asked_, k), k, "similarity", "vec_id").select("query_id", "vec_id", "similarity", "rank")


TOPV = "SELECT query_id, vec_id, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM sim {}) WHERE rank <= 10"
add("m01_l2_normalize", lambda spark, d: table(spark, d, "embeddings").select("vec_id", F.posexplode(vectors.unit(vectors.as_double(F.col("embedding")))).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x")), f"SELECT vec_id, CAST(i AS INT) AS i, round(x, 6) AS x FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(v, lambda x: x / n)) AS x FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, {VEC} AS v FROM embeddings)))")
add("m02_cosine", lambda spark, d: sims(spark, d).select("query_id", "vec_id", "similarity"), f"WITH {PAIR} SELECT query_id, vec_id, similarity FROM sim")
add("t01_vector_top_k", lambda spark, d: nearest(spark, d, 10), f"WITH {PAIR} {TOPV.replace('{}', '')}")
add("j03_query_by_vector", lambda spark, d: nearest(spark, d, 3), f"WITH {PAIR} {TOPV.replace('{}', '').replace('<= 10', '<= 3')}")


def in_cells(spark, d, k, probes=None):
    """The vectors in cells, of which those of the nearest centres are read; one source's labels are put in anew."""
    cells = CellVectors.fresh(spark)
    emb = table(spark, d, "embeddings")
    cells.upsert(emb)
    cells.upsert(emb.filter("label = 3"))
    return cells.query(emb.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k, probes=probes).select("query_id", "vec_id", "similarity", "rank")


# all cells give the exact result; the fitted number of them gives most of it
add("t01_all_cells", lambda spark, d: in_cells(spark, d, 10, 10**6), f"WITH {PAIR} {TOPV.replace('{}', '')}")
add("t01_nearest_cells", lambda spark, d: in_cells(spark, d, 10))
add("r04_vector_query_filtered", lambda spark, d: nearest(spark, d, 10, F.col("label").cast("string").isin("3", "7")), f"WITH {PAIR} {TOPV.replace('{}', 'WHERE label IN (3, 7)')}")
add("a20_reciprocal_rank_fusion", lambda spark, d: fusion.reciprocal_ranks(nearest(spark, d, 20).select((F.col("query_id") % 400).alias("query_id"), F.col("vec_id").alias("item"), "rank")), f"WITH {PAIR}, r AS (SELECT query_id % 400 AS query_id, vec_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM sim) SELECT query_id, item, round(sum(1 / (60 + rank)), 6) AS rrf FROM r WHERE rank <= 20 GROUP BY ALL")


def dense_candidates(spark, d, pool):
    """The nearest vectors of those whose id is a benchmark text's."""
    emb, ids = table(spark, d, "embeddings"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    queries = emb.select(F.col("vec_id").alias("query_id"), "embedding").join(ids, "query_id", "left_semi")
    return bm25.best(vectors.nearest(emb, queries, pool), pool, "similarity", "vec_id")


def hybrid(spark, d, k=8, pool=24):
    """Dense and sparse candidates of the same ids; the queries are all benchmark texts, with the vectors of their ids."""
    dense = dense_candidates(spark, d, pool).select("query_id", F.lit(0).alias("variant"), F.col("vec_id").alias("item"), F.col("similarity").alias("score"))
    sparse = searched(spark, d, pool).select("query_id", F.lit(0).alias("variant"), F.col("doc_id").alias("item"), "score")
    return bm25.best(fusion.fuse(dense, sparse), k, "score", "item")


NORM = "CASE WHEN max(score) OVER w - min(score) OVER w < 1e-9 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"
FUSED = (
    SCORE
    + f", {PAIR.replace('b.vec_id % 100 = 0', 'b.vec_id IN (SELECT item_id FROM benchmark)')}, dl AS (SELECT query_id, vec_id AS item, similarity AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM sim) WHERE r <= 24), sl AS (SELECT query_id, doc_id AS item, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM sc) WHERE r <= 24), dn AS (SELECT query_id, item, {NORM} AS x FROM dl WINDOW w AS (PARTITION BY query_id)), sn AS (SELECT query_id, item, {NORM} AS x FROM sl WINDOW w AS (PARTITION BY query_id)), fu AS (SELECT query_id, item, round(coalesce(dn.x, 0), 6) AS dense, round(coalesce(sn.x, 0), 6) AS sparse, round(0.7 * coalesce(dn.x, 0) + 0.3 * coalesce(sn.x, 0), 6) AS score FROM dn FULL JOIN sn USING (query_id, item)), top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS INT) AS rank FROM fu) WHERE rank <= 8)"
)
add("r06_hybrid_retrieve", hybrid, FUSED + " SELECT * FROM top")
add("j01_hydrate_ranked", lambda spark, d: hybrid(spark, d).join(docs_of(spark, d), F.col("item") == F.col("doc_id")).select("query_id", "rank", "doc_id", "source", F.length("text").alias("n")), FUSED + " SELECT query_id, rank, doc_id, source, CAST(length(text) AS INT) AS n FROM top JOIN documents ON item = doc_id")


def _rerank_score(qt, t):
    """Of a question's and a passage's tokens, with the columns score and prior."""
    q = F.array_distinct(qt)
    rare = F.filter(q, lambda x: F.length(x) > 4)
    share = lambda part: F.size(F.array_intersect(part, t)) / F.size(part)
    coverage = F.when(F.size(q) > 0, share(q)).otherwise(0.0)
    rare_share = F.when(F.size(rare) > 0, share(rare)).otherwise(coverage)
    spots = F.filter(F.transform(t, lambda x, i: F.when(F.array_contains(qt, x), i)), lambda i: i.isNotNull())
    close = tx.let(spots, lambda at: F.when(F.size(qt) < 2, F.when((F.size(qt) == 1) & (F.size(at) > 0), 1.0).otherwise(0.0)).when(F.size(at) < 2, 0.0).otherwise(F.least(F.lit(1.0), F.size(qt) / (F.array_max(at) - F.array_min(at) + 1))))
    return 0.34 * coverage + 0.18 * rare_share + 0.16 * close + 0.10 * F.least("score", F.lit(1.0)) + 0.10 * F.col("prior")


def reranked(spark, d):
    """Local reranking of the sparse candidates: coverage, rare words, proximity, score and position."""
    pool = searched(spark, d, 8)
    pool = pool.join(docs_of(spark, d), "doc_id").join(asked(spark, d).withColumnRenamed("text", "query"), "query_id")
    n = F.count(F.lit(1)).over(W.partitionBy("query_id"))
    pool = pool.withColumn("prior", 1 - (F.col("rank") - 1) / n)
    words = F.struct(F.filter(tx.tokens(F.col("query")), lambda t: F.length(t) > 1).alias("qt"), tx.tokens(F.col("text")).alias("t"))
    score = tx.let(words, lambda v: _rerank_score(v["qt"], v["t"]))
    phrase = F.left(F.array_join(F.filter(tx.tokens(F.col("query")), lambda x: x.rlike(r"^\p{L}+$")), " "), F.lit(60))
    score = F.when((phrase != "") & F.regexp_replace(F.lower("text"), r"\s+", " ").contains(phrase), F.least(F.lit(1.0), score + 0.12)).otherwise(score)
    out = pool.select("query_id", "doc_id", F.round(score, 6).alias("rerank"))
    return sent(out.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rerank"), "doc_id"))), asked(spark, d).count() * 8)


add("r07_local_rerank", reranked, SCORE + f""", pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 8),
  x AS (SELECT query_id, doc_id, score, rank, count(*) OVER (PARTITION BY query_id) AS n, d.text, {TOKEN_SQL.format('b.text')} AS qa, list_filter({TOKEN_SQL.format('b.text')}, lambda z: length(z) > 1) AS qt, {TOKEN_SQL.format('d.text')} AS t FROM pool JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id),
  y AS (SELECT *, list_distinct(qt) AS q, list_filter(list_distinct(qt), lambda z: length(z) > 4) AS rare, list_filter(list_transform(range(len(t)), lambda i: CASE WHEN list_contains(qt, t[i + 1]) THEN i END), lambda i: i IS NOT NULL) AS spots, left(array_to_string(list_filter(qa, lambda z: regexp_matches(z, '^\\p{{L}}+$')), ' '), 60) AS phrase FROM x),
  z AS (SELECT *, CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0 END AS cov FROM y),
  s AS (SELECT query_id, doc_id, text, phrase, 0.34 * cov + 0.18 * CASE WHEN len(rare) > 0 THEN len(list_intersect(rare, t)) / len(rare) ELSE cov END + 0.16 * CASE WHEN len(qt) < 2 THEN CASE WHEN len(qt) = 1 AND len(spots) > 0 THEN 1 ELSE 0 END WHEN len(spots) < 2 THEN 0 ELSE least(1.0, len(qt) / (list_max(spots) - list_min(spots) + 1)) END + 0.10 * least(score, 1.0) + 0.10 * (1 - (rank - 1) / n) AS sc2 FROM z),
  r AS (SELECT query_id, doc_id, round(CASE WHEN phrase <> '' AND contains(regexp_replace(lower(text), '\\s+', ' ', 'g'), phrase) THEN least(1.0, sc2 + 0.12) ELSE sc2 END, 6) AS rerank FROM s)
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, doc_id) AS INT) AS place FROM r""")  # fmt: skip
add("f15_local_relevance", lambda spark, d: asked(spark, d).filter("query_id % 100 = 0").join(docs_of(spark, d).withColumnRenamed("text", "body")).select("query_id", "doc_id", F.round(F.size(F.array_intersect(F.array_distinct(tx.tokens(F.col("text"))), tx.tokens(F.col("body")))) / F.size(F.array_distinct(tx.tokens(F.col("text")))), 6).alias("relevance")), f"SELECT item_id AS query_id, doc_id, round(len(list_intersect(q, t)) / len(q), 6) AS relevance FROM (SELECT item_id, list_distinct({TOKEN_SQL.format('text')}) AS q FROM benchmark WHERE item_id % 100 = 0), (SELECT doc_id, list_distinct({TOKEN_SQL.format('text')}) AS t FROM documents)")
add("u05_missing_terms", lambda spark, d: docs_of(spark, d).select("doc_id", F.size(F.array_except(tx.words_and_numbers(F.col("text")), F.array(*map(F.lit, ("the", "of", "and"))))).alias("n")), "SELECT doc_id, CAST(len(list_filter(list_distinct(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z''\\-]*|\\d+(?:\\.\\d+)?', 0)), lambda w: w NOT IN ('the', 'of', 'and'))) AS INT) AS n FROM documents")
add("w04_context_budget", lambda spark, d: _budget(spark, d), """WITH b AS (SELECT source, doc_id, n_chars + 20 AS size FROM documents), c AS (SELECT *, coalesce(sum(size + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b), o AS (SELECT *, before + size > 12000 AS over FROM c), p AS (SELECT *, coalesce(max(CAST(over AS INT)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM o)
  SELECT source, doc_id, CAST(CASE WHEN over THEN 12000 - before ELSE size END AS BIGINT) AS used, over AS truncated FROM p WHERE past = 0 AND (NOT over OR 12000 - before > 400)""")  # fmt: skip


def _budget(spark, d):
    """Blocks of a source in order until one overflows; that one is cut if enough room is left."""
    earlier = W.partitionBy("source").orderBy("doc_id").rowsBetween(W.unboundedPreceding, -1)
    blocks = table(spark, d, "documents").select("source", "doc_id", (F.col("n_chars") + 20).alias("size")).filter("size IS NOT NULL")
    # a block takes 22 characters at least, so that no later one can have room: each task keeps as many of a source
    most = 12000 // 22 + 1
    blocks = blocks.withColumn("place", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).filter(F.col("place") <= most)
    blocks = blocks.withColumn("before", F.coalesce(F.sum(F.col("size") + 2).over(earlier), F.lit(0)))
    blocks = blocks.withColumn("over", F.col("before") + F.col("size") > 12000)
    blocks = blocks.withColumn("past", F.coalesce(F.max(F.col("over").cast("int")).over(earlier), F.lit(0)))
    room = 12000 - F.col("before")
    return blocks.filter((F.col("past") == 0) & (~F.col("over") | (room > 400))).select("source", "doc_id", F.when(F.col("over"), room).otherwise(F.col("size")).cast("bigint").alias("used"), F.col("over").alias("truncated"))


add("j10_theta_contains", lambda spark, d: docs_of(spark, d).join(asked(spark, d).withColumnRenamed("text", "needle"), F.col("text").contains(F.col("needle"))).select("doc_id", "query_id"), "SELECT doc_id, item_id AS query_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
