"""Queries over passages of documents, rewriting of questions, contexts, grounding, and answers without a model."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import structure
from quarry.functions import text as tx
from quarry.operators import answering, bm25, chunks, scans
from quarry.plans.answer_queries import QUERIES as ANSWERS
from quarry.plans.learning_queries import sentences_sql, terms_sql
from quarry.plans.retrieval_queries import QUERIES as RETRIEVAL, SCORE, asked, docs_of, reranked, searched
from quarry.plans.text_queries import CLEAN, FOLLOW_UP, HEADING, LINE_ROWS, LINK, PRONOUNS, STRIP, TOKEN_SQL, lines, vague
from quarry.sources.tables import table as T

QUERIES: dict = {}


def add(name, build, sql=None):
    QUERIES[name] = (build, sql)


# Structure.
SECTIONED = (
    f"""WITH h AS (SELECT doc_id, i, s, CASE WHEN {HEADING} THEN CASE WHEN length(regexp_extract(s, '^(#{{1,6}})\\s', 1)) > 0 THEN length(regexp_extract(s, '^(#{{1,6}})\\s', 1)) WHEN regexp_matches(s, '^\\d+(\\.\\d+){{0,3}}[.)]?\\s') THEN least(len(string_split(regexp_extract(s, '^(\\d+(\\.\\d+){{0,3}})[.)]?\\s', 1), '.')) + 1, 6) WHEN regexp_matches(s, '(?i)^(chapter|part|unit)\\b') THEN 1 ELSE 2 END END AS level, """
    + STRIP.format("regexp_replace(regexp_replace(s, '^#{1,6}\\s+', ''), '^[*_# ]+|[*_# ]+$', '', 'g')")
    + f" AS title FROM (SELECT doc_id, i, {STRIP.format('line')} AS s FROM {LINE_ROWS})), l AS (SELECT doc_id, i, level, "
    + ", ".join(f"last_value(CASE WHEN level = {k} THEN {{'i': i, 't': title}} END IGNORE NULLS) OVER w AS h{k}" for k in range(1, 7))
    + " FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
)


def _open_sql(k: int) -> str:
    above = ", ".join(["-1", *(f"coalesce(h{j}.i, -1)" for j in range(1, k))])
    return f"CASE WHEN h{k} IS NOT NULL AND greatest({above}, -1) <= h{k}.i THEN nullif(h{k}.t, '') END"


PATH_SQL = "concat_ws(' > ', " + ", ".join(map(_open_sql, range(1, 7))) + ")"
add("w11_heading_paths", lambda s, d: structure.heading_paths(lines(s, d), "doc_id").select("doc_id", "i", "level", "path"), f"{SECTIONED} SELECT doc_id, CAST(i AS INT) AS i, CAST(level AS INT) AS level, {PATH_SQL} AS path FROM l")
add("f11_section_paths", lambda s, d: structure.heading_paths(lines(s, d), "doc_id").filter("level IS NOT NULL").groupBy("doc_id", "path").agg(F.count(F.lit(1)).alias("n")), f"{SECTIONED} SELECT doc_id, path, count(*) AS n FROM (SELECT doc_id, {PATH_SQL} AS path FROM l WHERE level IS NOT NULL) GROUP BY ALL")
add("f07_paragraphs", lambda s, d: T(s, d, "documents").select("doc_id", structure.paragraphs(F.col("text")).alias("p")).select("doc_id", F.size("p").alias("n"), F.sha2(F.array_join("p", "|"), 256).alias("digest")))
BLOCKS = f"list_filter(list_transform(string_split(replace(text, chr(12), e'\\n\\n'), e'\\n\\n'), lambda b: {STRIP.format('b')}), lambda b: b <> '')"
add("f24_pages", lambda s, d: T(s, d, "documents").select("doc_id", F.posexplode(structure.pages(F.replace("text", F.lit("\n"), F.lit("\n\n")), 600)).alias("page", "text")).select("doc_id", "page", F.length("text").alias("n"), F.sha2("text", 256).alias("digest")),
    f"""WITH b AS (SELECT doc_id, unnest(range(len(bs))) AS i, unnest(bs) AS b FROM (SELECT doc_id, {BLOCKS.replace('(text', "(replace(text, e'\\n', e'\\n\\n')")} AS bs FROM documents)),
  r AS (SELECT doc_id, list({{'p': 0, 'n': 0, 'b': b}} ORDER BY i) AS bs FROM b GROUP BY ALL),
  f AS (SELECT doc_id, list_reduce(list_prepend({{'out': CAST([] AS STRUCT(p INT, b VARCHAR)[]), 'p': 0, 'n': 0}}, list_transform(bs, lambda x: {{'out': [{{'p': 0, 'b': x.b}}], 'p': 0, 'n': 0}})), lambda a, x: {{'out': list_append(a.out, {{'p': CASE WHEN a.n > 0 AND a.n + length(x.out[1].b) > 600 THEN a.p + 1 ELSE a.p END, 'b': x.out[1].b}}), 'p': CASE WHEN a.n > 0 AND a.n + length(x.out[1].b) > 600 THEN a.p + 1 ELSE a.p END, 'n': CASE WHEN a.n > 0 AND a.n + length(x.out[1].b) > 600 THEN 0 ELSE a.n END + length(x.out[1].b) + 2}}) AS s FROM r),
  u AS (SELECT doc_id, unnest(range(len(s.out))) AS i, unnest(s.out) AS x FROM f), g AS (SELECT doc_id, x.p AS page, string_agg(x.b, e'\\n\\n' ORDER BY i) AS t FROM u GROUP BY ALL)
  SELECT doc_id, CAST(page AS INT) AS page, CAST(length(t) AS INT) AS n, sha256(t) AS digest FROM g""")  # fmt: skip
add("r01_section_chunks", lambda s, d: chunks.chunk(T(s, d, "documents")))
add("r03_embedding_texts", lambda s, d: chunks.chunk(T(s, d, "documents")).select("doc_id", "chunk_index", "embed_text"))

# Rewriting.
QUESTION_SQL = r"regexp_replace(regexp_replace(regexp_replace(x, '^\?+|\?+$', '', 'g'), '^\s+', ''), '\s+$', '')"


def rewritten(s, d):
    """Every user turn as retrieval queries: vague ones borrow the topic of the last user turn before them that had one."""
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    turns = T(s, d, "conversations").withColumn("topic", F.when(F.col("role") == "user", tx.key_terms(F.coalesce("text", F.lit("")), 5)))
    turns = turns.withColumn("past", F.last(F.when(F.size("topic") > 0, F.col("topic")), ignorenulls=True).over(before)).filter("role = 'user'")
    # openings of follow-up questions come up in every third turn
    said = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("explain this "), F.left("text", F.lit(40)))).otherwise(F.col("text"))
    turns = turns.withColumn("original", tx.question(F.coalesce(said, F.lit(""))))
    turns = turns.withColumn("standalone", answering.resolved(F.col("original"), vague(F.col("original")) & F.col("past").isNotNull(), F.coalesce("past", F.array().cast("array<string>"))))
    return turns.select("conv_id", "turn", "original", "standalone", answering.expansions(F.col("standalone")).alias("others"))


def _hint_sql() -> str:
    parts = [f"CASE WHEN contains(lower(standalone), '{n}') THEN list_filter({[*p]!r}, lambda p: NOT contains(lower(standalone), lower(p))) ELSE [] END" for n, p in answering.HINTS]
    return " || ".join(parts)


REWRITTEN = f"""WITH k AS {terms_sql("conversations", "conv_id, turn", 5)},
  t AS (SELECT c.conv_id, c.turn, c.role, c.text, CASE WHEN c.role = 'user' THEN k.terms END AS topic FROM conversations c LEFT JOIN k USING (conv_id, turn)),
  p AS (SELECT *, last_value(topic IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM t),
  o AS (SELECT conv_id, turn, past, {QUESTION_SQL} AS original FROM (SELECT *, {STRIP.format("regexp_replace(" + LINK.format(CLEAN.format("CASE WHEN turn % 3 = 2 THEN 'explain this ' || left(text, 40) ELSE text END")) + r", '\s+', ' ', 'g')")} AS x FROM p WHERE role = 'user')),
  v AS (SELECT *, (low = '' OR (len(w) <= 3 AND list_has_any(w, {PRONOUNS!r})) OR regexp_matches(low, '{FOLLOW_UP}')) AND past IS NOT NULL AS vague FROM (SELECT *, lower({STRIP.format('original')}) AS low, string_split_regex(lower({STRIP.format('original')}), '\\s+') AS w FROM o)),
  s AS (SELECT conv_id, turn, original, CASE WHEN vague THEN regexp_replace(original, '[?.]+$', '') || ' (about: ' || array_to_string(past, ', ') || ')' ELSE original END AS standalone FROM v),
  e AS {terms_sql("s", "conv_id, turn", 5, "standalone")},
  q AS (SELECT s.*, ({_hint_sql()} || CASE WHEN len(coalesce(terms, [])) >= 2 THEN [terms[1] || ' definition', array_to_string(terms[1:3], ' ')] ELSE [] END)[1:{answering.VARIANTS}] AS others FROM s LEFT JOIN e USING (conv_id, turn))"""
add("r18_query_rewrite", lambda s, d: rewritten(s, d).select("conv_id", "turn", "standalone", F.array_join("others", "|").alias("queries")), REWRITTEN + " SELECT conv_id, turn, standalone, array_to_string(others, '|') AS queries FROM q")
add("u02_every_query", lambda s, d: rewritten(s, d).select("conv_id", "turn", F.posexplode(answering.every_query(F.col("original"), F.col("standalone"), F.col("others"))).alias("i", "query")),
    REWRITTEN + """, a AS (SELECT conv_id, turn, list_filter(list_transform([original, standalone] || list_filter(others, lambda o: lower(o) <> lower(standalone)), lambda x: trim(x)), lambda x: x <> '') AS l FROM q),
  u AS (SELECT conv_id, turn, list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]) AS l FROM a)
  SELECT conv_id, turn, CAST(unnest(range(len(l))) AS INT) AS i, unnest(l) AS query FROM u""")  # fmt: skip


def payloads(s, d):
    """A rewrite as a model would return it, whole or in part, applied over the question."""
    given = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 3 == 0, "not json").otherwise(F.concat(F.lit('{"standalone": "topic '), given, F.lit('", "keywords": ["a'), given, F.lit('", " "], "resolved": '), (F.col("value") > 10).cast("string"), F.lit("}")))
    body = F.from_json(raw, "standalone string, keywords array<string>, resolved boolean")
    words = F.filter(F.transform(F.coalesce(body["keywords"], F.array().cast("array<string>")), lambda k: F.trim(k)), lambda k: k != "")
    return T(s, d, "events").select("event_id", F.coalesce(body["standalone"], F.col("event_type")).alias("standalone"), F.when(F.size(words) > 0, F.array_join(words, ",")).otherwise(F.col("event_type")).alias("keywords"), F.coalesce(body["resolved"], F.lit(False)).alias("resolved"))


add("g25_rewrite_payload", payloads, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'topic ' || json_extract_string(props, '$.k') END AS standalone, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'a' || json_extract_string(props, '$.k') END AS keywords, event_id % 3 <> 0 AND value > 10 AS resolved FROM events")

# Context, grounding, answers.
def header():
    return F.concat(F.lit("Source: "), F.col("source"), F.lit(" | "), F.col("doc_id").cast("string"))


def contexts(s, d):
    top = searched(s, d, 8).join(docs_of(s, d), "doc_id")
    return answering.context(top.select("query_id", "rank", header().alias("header"), "text"))


def context_sql(source: str) -> str:
    """(query_id, context, blocks) of rows (query_id, rank, header, text)."""
    return f"""cb AS (SELECT query_id, rank, '[' || rank || '] ' || header || e'\\n' || {STRIP.format('text')} AS block FROM {source}),
  cu AS (SELECT *, coalesce(sum(length(block) + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM cb),
  co AS (SELECT *, used + length(block) > {answering.CONTEXT} AS over FROM cu),
  cp AS (SELECT *, coalesce(max(CAST(over AS INT)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM co),
  cx AS (SELECT query_id, string_agg(CASE WHEN NOT over THEN block ELSE regexp_replace(left(block, CAST({answering.CONTEXT} - used AS INT)), '\\s+$', '') || e'\\n[...truncated]' END, e'\\n\\n' ORDER BY rank) AS context, count(*) AS blocks FROM cp WHERE past = 0 AND (NOT over OR {answering.CONTEXT} - used > {answering.WORTH}) GROUP BY ALL)"""


TOP8 = SCORE + ", top AS (SELECT query_id, r AS rank, doc_id, score, source, text, 'Source: ' || source || ' | ' || doc_id AS header FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM sc) JOIN documents USING (doc_id) WHERE r <= 8)"
add("r13_build_context", lambda s, d: contexts(s, d).select("query_id", "blocks", F.length("context").alias("n"), F.sha2("context", 256).alias("digest")), f"{TOP8}, {context_sql('top')} SELECT query_id, blocks, CAST(length(context) AS INT) AS n, sha256(context) AS digest FROM cx")
_confidence, _confidence_sql = ANSWERS["r17_confidence"]


def search_only(s, d):
    """The whole way without compression: reranked passages, their context, and how sure it is."""
    found = reranked(s, d).join(docs_of(s, d), "doc_id")
    body = answering.context(found.select("query_id", F.col("place").alias("rank"), header().alias("header"), "text"))
    return body.join(_confidence(s, d), "query_id").select("query_id", "blocks", F.sha2("context", 256).alias("digest"), "confidence", (F.col("confidence") >= answering.FLOOR).alias("grounded"))


add("r19_search_only", search_only, f"WITH rk AS ({RETRIEVAL['r07_local_rerank'][1]}), top AS (SELECT query_id, place AS rank, text, 'Source: ' || source || ' | ' || doc_id AS header FROM rk JOIN documents USING (doc_id)), {context_sql('top')}, cf AS ({_confidence_sql}) SELECT query_id, blocks, sha256(context) AS digest, confidence, confidence >= {answering.FLOOR} AS grounded FROM cx JOIN cf USING (query_id)")
add("r20_evidence_gate", lambda s, d: _confidence(s, d).withColumn("c", F.col("confidence") * (F.col("query_id") % 4) / 3).select("query_id", answering.gate(F.round("c", 4), F.col("query_id") % 2 == 0).alias("g")).select("query_id", "g.*"),
    f"WITH cf AS ({_confidence_sql}), c AS (SELECT query_id, round(confidence * (query_id % 4) / 3, 4) AS c FROM cf) SELECT query_id, CASE WHEN c >= 0.15 THEN 'documents' WHEN query_id % 2 = 0 THEN 'general_knowledge' ELSE 'insufficient' END AS evidence, CASE WHEN c >= 0.15 THEN c WHEN query_id % 2 = 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM c")


def quoted(s, d):
    """The retrieved passages as they are, for when no model answers."""
    top = searched(s, d, 8).join(docs_of(s, d), "doc_id")
    line = F.concat(F.lit("- ["), F.col("rank").cast("string"), F.lit("] "), F.col("source"), F.lit("\n  > "), tx.preview(F.col("text"), 400))
    body = top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    return body.join(_confidence(s, d), "query_id").select("query_id", F.sha2("body", 256).alias("digest"), F.least("confidence", F.lit(0.5)).alias("confidence"))


_PREVIEW = "CASE WHEN length(x) <= 400 THEN x ELSE left(x, 400) || '…' END"
add("r21_extractive_fallback", quoted, f"{TOP8}, pv AS (SELECT query_id, rank, source, {STRIP.format(r"regexp_replace(text, '\s+', ' ', 'g')")} AS x FROM top), bd AS (SELECT query_id, string_agg('- [' || rank || '] ' || source || e'\\n  > ' || {_PREVIEW}, e'\\n' ORDER BY rank) AS body FROM pv GROUP BY ALL), cf AS ({_confidence_sql}) SELECT query_id, sha256(body) AS digest, least(confidence, 0.5::DOUBLE) AS confidence FROM bd JOIN cf USING (query_id)")


def offline(s, d):
    best = searched(s, d, 1).join(docs_of(s, d), "doc_id").join(asked(s, d).withColumnRenamed("text", "question"), "query_id")
    return best.select("query_id", "doc_id", answering.best_sentences(F.col("text"), F.col("question")).alias("s"))


OFFLINE = SCORE + f""", b AS (SELECT query_id, doc_id, d.text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM sc) JOIN documents d USING (doc_id) WHERE r = 1), se AS {sentences_sql("b", "query_id, doc_id", 40)}, k AS {terms_sql("benchmark", "item_id", 10)},
  u AS (SELECT query_id, doc_id, unnest(range(len(s))) AS i, unnest(s) AS s, coalesce(terms, []) AS terms FROM se LEFT JOIN k ON item_id = query_id),
  v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY len(list_filter(terms, lambda t: contains(lower(s), t))) DESC, i) AS r FROM u)"""
add("r23_offline_answer", lambda s, d: offline(s, d).select("query_id", "doc_id", F.size("s").alias("n"), F.sha2(F.array_join("s", "\n"), 256).alias("digest")), OFFLINE + " SELECT query_id, doc_id, CAST(count(*) AS INT) AS n, sha256(string_agg(s, e'\\n' ORDER BY i)) AS digest FROM v WHERE r <= 5 GROUP BY ALL")
add("t08_sentences_in_order", lambda s, d: offline(s, d).select("query_id", F.posexplode("s").alias("place", "sentence")).select("query_id", "place", F.length("sentence").alias("n")), OFFLINE + " SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS INT) AS place, CAST(length(s) AS INT) AS n FROM v WHERE r <= 5")


def labelled(s, d):
    """Grounding of every assistant turn against the user turn before it, if there is one."""
    turns = T(s, d, "conversations")
    said = turns.filter("role = 'assistant'").select("conv_id", "turn", tx.sentences(F.col("text"), 25).alias("s"), F.col("text").contains("[1]").alias("cited"))
    user = turns.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), tx.key_terms(F.col("text"), 14).alias("evidence"))
    rows = said.join(user, ["conv_id", "turn"], "left")
    parts = F.struct(F.transform("s", lambda x: tx.key_terms(x, 14)).alias("terms"), F.size("s").alias("n"))
    return rows.select("conv_id", "turn", answering.grounding(parts, F.col("evidence"), F.col("cited") & F.col("evidence").isNotNull()).alias("labels"))


add("r16_grounding_labels", labelled, f"""WITH a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), se AS {sentences_sql("a", "conv_id, turn", 25)},
  u AS (SELECT conv_id, turn, unnest(range(len(s))) AS si, unnest(s) AS text FROM se), k AS {terms_sql("u", "conv_id, turn, si", 14)}, uu AS (SELECT * FROM conversations WHERE role = 'user'), ke AS {terms_sql("uu", "conv_id, turn", 14)},
  e AS (SELECT uu.conv_id, uu.turn + 1 AS turn, coalesce(terms, []) AS evidence FROM uu LEFT JOIN ke USING (conv_id, turn)),
  h AS (SELECT u.conv_id, u.turn, count(*) AS n, count(*) FILTER (k.terms IS NOT NULL AND len(list_intersect(k.terms, e.evidence)) / len(k.terms) >= 0.55) AS hits FROM u LEFT JOIN k USING (conv_id, turn, si) LEFT JOIN e ON e.conv_id = u.conv_id AND e.turn = u.turn GROUP BY ALL),
  l AS (SELECT a.conv_id, a.turn, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, contains(a.text, '[1]') AND e.evidence IS NOT NULL AS cited, e.evidence IS NULL AS bare FROM a LEFT JOIN h USING (conv_id, turn) LEFT JOIN e ON e.conv_id = a.conv_id AND e.turn = a.turn)
  SELECT conv_id, turn, coalesce(nullif(concat_ws(',', CASE WHEN hits > 0 OR cited THEN 'retrieved_fact' END, CASE WHEN n > 0 AND hits < n * 0.6 THEN 'model_reasoning' END, CASE WHEN bare THEN 'general_knowledge' END), ''), 'model_reasoning') AS labels FROM l""")  # fmt: skip


def compared(s, d):
    """The best passage of each source for every question, and the least of them, which bounds a comparison's confidence."""
    scored = bm25.scores(docs_of(s, d), asked(s, d)).join(docs_of(s, d).select("doc_id", "source"), "doc_id")
    best = scored.groupBy("query_id", "source").agg(F.max("score").alias("best"))
    return best.groupBy("query_id").agg(F.count(F.lit(1)).alias("sources"), F.min("best").alias("least"), F.max("best").alias("most"))


add("r22_compare_sources", compared, SCORE + ", b AS (SELECT query_id, source, max(score) AS best FROM sc JOIN documents USING (doc_id) GROUP BY ALL) SELECT query_id, count(*) AS sources, min(best) AS least, max(best) AS most FROM b GROUP BY ALL")
add("j14_marker_lookup", lambda s, d: ANSWERS["r14_build_citations"][0](s, d).join(s.range(1, 10, 3).select(F.concat(F.lit("["), F.col("id").cast("string"), F.lit("]")).alias("marker")), "marker").select("query_id", "marker", "doc_id"), f"WITH c AS ({ANSWERS['r14_build_citations'][1]}) SELECT query_id, marker, doc_id FROM c WHERE marker IN ('[1]', '[4]', '[7]')")
add("t10_stable_ties", lambda s, d: scans.numbered(T(s, d, "documents").select("lang", "n_chars", "doc_id"), ["lang"], [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", (F.col("place") + 1).cast("int").alias("place")), "SELECT doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INT) AS place FROM documents")


def spots(s, d):
    """Where a passage first and last has a word of the question: how close together it has them."""
    pool = searched(s, d, 8).join(docs_of(s, d), "doc_id").join(asked(s, d).withColumnRenamed("text", "question"), "query_id")
    words = F.struct(F.filter(tx.tokens(F.col("question")), lambda t: F.length(t) > 1).alias("q"), tx.tokens(F.col("text")).alias("t"))
    found = tx.let(words, lambda v: F.filter(F.transform(v["t"], lambda x, i: F.when(F.array_contains(v["q"], x), i)), lambda i: i.isNotNull()))
    ends = tx.let(found, lambda f: F.struct(F.array_min(f).alias("first"), F.array_max(f).alias("last")))
    return pool.select("query_id", "doc_id", ends.alias("e")).select("query_id", "doc_id", "e.first", "e.last")


def _spots_sql() -> str:
    return SCORE + f""", x AS (SELECT query_id, doc_id, list_filter({TOKEN_SQL.format('b.text')}, lambda z: length(z) > 1) AS qt, {TOKEN_SQL.format('d.text')} AS t FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM sc) JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id WHERE r <= 8),
      y AS (SELECT query_id, doc_id, list_filter(range(len(t)), lambda i: list_contains(qt, t[i + 1])) AS f FROM x) SELECT query_id, doc_id, CAST(list_min(f) AS INT) AS first, CAST(list_max(f) AS INT) AS last FROM y"""


add("w13_proximity_span", spots, _spots_sql())
add("c01_bag_of_tokens", lambda s, d: bm25.postings(T(s, d, "benchmark"), "item_id"), f"SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({TOKEN_SQL.format('text')}) AS term FROM benchmark) GROUP BY ALL")
add("c02_set_algebra", lambda s, d: T(s, d, "part").select("p_partkey", *[F.array_join(F.array_sort(f(F.split("p_name", " "), F.split("p_type", " "))), ",").alias(n) for n, f in (("both", F.array_intersect), ("either", F.array_union), ("first_only", F.array_except))]),
    "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_intersect(a, b))), ',') AS \"both\", array_to_string(list_sort(list_distinct(a || b)), ',') AS either, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ',') AS first_only FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_type, ' ') AS b FROM part)")
add("c03_ordered_dedup", lambda s, d: T(s, d, "documents").select("doc_id", F.array_join(F.slice(F.array_distinct(F.split("text", r"\s+")), 1, 12), " ").alias("words")), "SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i)[1:12], lambda i: l[i]), ' ') AS words FROM (SELECT doc_id, string_split_regex(text, '\\s+') AS l FROM documents)")
add("p10_column_pruning", lambda s, d: T(s, d, "documents").select("doc_id", "lang"), "SELECT doc_id, lang FROM documents")
