"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.sources.tables import table

QUERIES: dict = {}


def add(name, build, sql=None):
    QUERIES[name] = (build, sql)


def over(spark, d, tab, keys, /, **cols):
    """A projection of one table."""
    return table(spark, d, tab).select(*keys, *[c.alias(n) for n, c in cols.items()])


class Sql(str):
    """A piece of SQL with a hole."""

    def format(self, inner):
        return Sql(self.replace("{}", inner))


def q(s: str) -> str:
    return s.replace("'", "''")


def body():
    return F.coalesce(F.col("text"), F.lit(""))


STRIP = Sql(r"regexp_replace({}, '^\s+|\s+$', '', 'g')")
CONTROL = Sql(r"regexp_replace({}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g')")
BLANKS = Sql(r"regexp_replace({}, '[ \t ]{2,}', ' ', 'g')")
TRAIL = Sql(r"regexp_replace({}, '(?m)[ \t]+$', '', 'g')")
LINES = Sql(r"regexp_replace({}, '\n{3,}', e'\n\n', 'g')")
SQUEEZE = STRIP.format(LINES.format(TRAIL.format(BLANKS.format(CONTROL.format("{}")))))
DEHYPHEN = Sql(r"regexp_replace({}, '(\w)-\n(\w)', '\1\2', 'g')")
LIGATURES = Sql("replace(replace(replace(replace(replace({}, 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl')")
CLEAN = Sql(STRIP.format(LINES.format(BLANKS.format(TRAIL.format(CONTROL.format(DEHYPHEN.format("replace(replace(" + LIGATURES + r", e'\r\n', e'\n'), e'\r', e'\n')")))))))
LINK = Sql(r"regexp_replace(regexp_replace({}, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g')")

add("f01_normalize_whitespace", lambda spark, d: over(spark, d, "documents", ["doc_id"], out=tx.squeeze(body())), f"SELECT doc_id, {SQUEEZE.format('text')} AS out FROM documents")
add("f02_collapse_whitespace", lambda spark, d: over(spark, d, "documents", ["doc_id"], out=tx.one_line(body())), f"SELECT doc_id, {BLANKS.format('replace(' + SQUEEZE.format('text') + r", e'\n', ' ')")} AS out FROM documents")
add("f03_dehyphenate", lambda spark, d: over(spark, d, "documents", ["doc_id"], out=tx.dehyphenate(F.replace(body(), F.lit(" "), F.lit("-\n")))), f"SELECT doc_id, {DEHYPHEN.format(r"replace(text, ' ', e'-\n')")} AS out FROM documents")
add("f04_clean_text", lambda spark, d: over(spark, d, "documents", ["doc_id"], out=tx.clean(body())), f"SELECT doc_id, {CLEAN.format('text')} AS out FROM documents")
add("f05_strip_markdown", lambda spark, d: over(spark, d, "pages", ["page_id"], out=tx.link_text(F.concat(F.lit("![i](x) [see "), F.col("url"), F.lit("](http://a) tail")))), f"SELECT page_id, {LINK.format("'![i](x) [see ' || url || '](http://a) tail'")} AS out FROM pages")
add("f06_normalize_query", lambda spark, d: over(spark, d, "conversations", ["conv_id", "turn"], out=tx.question(body())), r"SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(x, '^\?+|\?+$', '', 'g'), '^\s+', ''), '\s+$', '') AS out FROM (SELECT conv_id, turn, " + STRIP.format(r"regexp_replace(" + LINK.format(CLEAN.format("text")) + r", '\s+', ' ', 'g')") + " AS x FROM conversations)")

SENT = "replace(" + SQUEEZE.format("text") + r", e'\n', ' ')"
SPLIT = "string_split(regexp_replace(" + SENT + r""", '([.!?])\s+([A-Z0-9(\["''“])', '\1' || chr(1) || '\2', 'g'), chr(1))"""
add(
    "f08_sentences",
    lambda spark, d: table(spark, d, "documents").select("doc_id", tx.sentences(body()).alias("s")).select("doc_id", F.size("s").cast("bigint").alias("n"), F.element_at(F.concat("s", F.array(F.lit(""))), 1).alias("first"), F.array_join("s", "|").alias("joined")),
    f"""WITH p AS (SELECT doc_id, {SPLIT} AS parts FROM documents),
    f AS (SELECT doc_id, list_reduce(list_prepend({{'out': CAST([] AS VARCHAR[]), 'held': ''}}, list_transform(parts, lambda x: {{'out': CAST([] AS VARCHAR[]), 'held': x}})), lambda acc, x:
      CASE WHEN trim(CASE WHEN acc.held <> '' THEN acc.held || ' ' || x.held ELSE x.held END) = '' THEN acc
        WHEN (length(trim(CASE WHEN acc.held <> '' THEN acc.held || ' ' || x.held ELSE x.held END)) < 25 AND NOT regexp_matches(trim(CASE WHEN acc.held <> '' THEN acc.held || ' ' || x.held ELSE x.held END), '[.!?]$'))
          OR NOT (length(trim(CASE WHEN acc.held <> '' THEN acc.held || ' ' || x.held ELSE x.held END)) >= 25 OR len(acc.out) > 0)
        THEN {{'out': acc.out, 'held': trim(CASE WHEN acc.held <> '' THEN acc.held || ' ' || x.held ELSE x.held END)}}
        ELSE {{'out': list_append(acc.out, trim(CASE WHEN acc.held <> '' THEN acc.held || ' ' || x.held ELSE x.held END)), 'held': ''}} END) AS r FROM p),
    s AS (SELECT doc_id, CASE WHEN r.held <> '' THEN list_append(r.out, r.held) ELSE r.out END AS s FROM f)
    SELECT doc_id, CAST(len(s) AS BIGINT) AS n, coalesce(s[1], '') AS first, array_to_string(s, '|') AS joined FROM s""",
)
add("f09_truncate_words", lambda spark, d: over(spark, d, "documents", ["doc_id"], out=tx.first_words(body(), 20)), f"SELECT doc_id, CASE WHEN len(w) <= 20 THEN text ELSE array_to_string(w[1:20], ' ') || '…' END AS out FROM (SELECT doc_id, text, string_split_regex({STRIP.format('text')}, '\\s+') AS w FROM documents)")

LINE_ROWS = r"(SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, e'\n') AS l FROM documents))"
S = STRIP.format("line")
HEADING = rf"""CASE WHEN s = '' OR length(s) > 120 THEN false WHEN regexp_matches(s, '[.,;]$') AND NOT regexp_matches(s, '^\d+(\.\d+)*\s') THEN false
  WHEN regexp_matches(s, '^#{{1,6}}\s+\S') OR regexp_matches(s, '(?i)^(chapter|section|unit|module|part|lecture|topic|appendix)\b') OR regexp_matches(s, '^\d+(\.\d+){{0,3}}[.)]?\s+\S') OR regexp_matches(s, '^[IVXLC]+[.)]\s+\S') THEN true
  WHEN regexp_matches(s, '\p{{L}}') AND upper(s) = s AND NOT regexp_matches(s, '\p{{Ll}}') AND len(string_split_regex(s, '\s+')) <= 12 THEN true
  WHEN regexp_matches(s, '^(\*\*|__)') AND regexp_matches(s, '(\*\*|__)$') THEN true
  ELSE len(string_split_regex(s, '\s+')) <= 9 AND regexp_matches(s, '^\p{{Lu}}') AND NOT suffix(s, ':') END"""


def lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


add("p15_looks_like_heading", lambda spark, d: lines(spark, d).select("doc_id", "i", tx.is_heading(F.col("line")).alias("heading")), f"SELECT doc_id, CAST(i AS INT) AS i, {HEADING} AS heading FROM (SELECT doc_id, i, {S} AS s FROM {LINE_ROWS})")
add("f10_heading_level", lambda spark, d: lines(spark, d).select("doc_id", "i", tx.heading_level(F.concat(F.repeat(F.lit("#"), (F.col("i") % 8).cast("int")), F.lit(" "), F.col("line"))).alias("level")),
    r"SELECT doc_id, CAST(i AS INT) AS i, CAST(CASE WHEN length(regexp_extract(s, '^(#{1,6})\s', 1)) > 0 THEN length(regexp_extract(s, '^(#{1,6})\s', 1)) WHEN regexp_matches(s, '^\d+(\.\d+){0,3}[.)]?\s') THEN least(len(string_split(regexp_extract(s, '^(\d+(\.\d+){0,3})[.)]?\s', 1), '.')) + 1, 6) WHEN regexp_matches(s, '(?i)^(chapter|part|unit)\b') THEN 1 ELSE 2 END AS INT) AS level FROM (SELECT doc_id, i, " + STRIP.format("repeat('#', CAST(i % 8 AS INT)) || ' ' || line") + f" AS s FROM {LINE_ROWS})")
add("w12_section_of_line", lambda spark, d: lines(spark, d).select("doc_id", "i", F.sum(F.col("line").rlike("^[A-Z]").cast("bigint")).over(W.partitionBy("doc_id").orderBy("i")).alias("section")),
    f"SELECT doc_id, CAST(i AS INT) AS i, CAST(sum(CAST(regexp_matches(line, '^[A-Z]') AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS section FROM {LINE_ROWS}")
add("f25_first_heading", lambda spark, d: table(spark, d, "documents").select("doc_id", F.element_at(F.concat(F.filter(F.split("text", "\n"), tx.is_heading), F.array(F.lit(""))), 1).alias("heading")),
    f"SELECT doc_id, coalesce((SELECT min_by(line, i) FROM (SELECT doc_id AS d2, i, line, {S} AS s FROM {LINE_ROWS}) h WHERE h.d2 = documents.doc_id AND {HEADING}), '') AS heading FROM documents")

WORDS = Sql("regexp_extract_all({}, '[A-Za-z][A-Za-z''\\-]*|\\d+(?:\\.\\d+)?', 0)")
STOP = "(" + ", ".join(f"'{q(w)}'" for w in tx.CONTENT_STOPWORDS) + ")"


def key_terms(spark, d):
    """At corpus size: positions are exploded, counted by document and term, and ranked."""
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(tx.WORD_OR_NUMBER), F.lit(0))).alias("i", "raw"))
    words = words.withColumn("term", F.lower("raw")).filter((F.length("term") >= 2) & F.col("term").rlike("^[a-z]") & ~F.col("term").isin(tx.CONTENT_STOPWORDS))
    counted = words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "first")))
    return ranked.filter("rank <= 12").select("doc_id", "rank", "term", "n")


add("f12_key_terms", key_terms, f"""WITH w AS (SELECT doc_id, unnest(range(len(l))) AS i, lower(unnest(l)) AS term FROM (SELECT doc_id, {WORDS.format('text')} AS l FROM documents)),
  c AS (SELECT doc_id, term, count(*) AS n, min(i) AS first FROM w WHERE length(term) >= 2 AND regexp_matches(term, '^[a-z]') AND term NOT IN {STOP} GROUP BY ALL)
  SELECT doc_id, CAST(rank AS INT) AS rank, term, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= 12""")  # fmt: skip
add("t04_key_terms_in_row", lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", F.array_join(tx.key_terms(body(), 5), ",").alias("terms")),
    f"""WITH w AS (SELECT conv_id, turn, unnest(range(len(l))) AS i, lower(unnest(l)) AS term FROM (SELECT conv_id, turn, {WORDS.format('text')} AS l FROM conversations)),
  c AS (SELECT conv_id, turn, term, count(*) AS n, min(i) AS first FROM w WHERE length(term) >= 2 AND regexp_matches(term, '^[a-z]') AND term NOT IN {STOP} GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, first) AS rank FROM c)
  SELECT t.conv_id, t.turn, coalesce(string_agg(r.term, ',' ORDER BY rank), '') AS terms FROM conversations t LEFT JOIN r ON t.conv_id = r.conv_id AND t.turn = r.turn AND rank <= 5 GROUP BY t.conv_id, t.turn""")  # fmt: skip
BAG = Sql("list_distinct(" + WORDS.format("lower({})") + ")")
add("f13_similarity_ratio", lambda spark, d: table(spark, d, "documents").alias("x").join(table(spark, d, "documents").select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id").select("doc_id", F.round(tx.jaccard(tx.words_and_numbers(F.col("text")), tx.words_and_numbers(F.col("other"))), 6).alias("ratio")),
    f"SELECT doc_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) END AS ratio FROM (SELECT x.doc_id, {BAG.format('x.text')} AS a, {BAG.format('y.text')} AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1)")

TOKEN_SQL = Sql("""flatten(list_transform(regexp_extract_all({}, '[A-Za-z][A-Za-z''\\-]*|\\d+(?:\\.\\d+)?|[^\\sA-Za-z\\d]', 0), lambda t:
  CASE WHEN NOT regexp_matches(t, '^\\p{L}+$') THEN [t] WHEN length(t) < 2 THEN [lower(t)]
  WHEN suffix(lower(t), 'ies') AND length(t) > 5 THEN [lower(t), left(lower(t), -3) || 'y'] WHEN suffix(lower(t), 'sses') THEN [lower(t), left(lower(t), -2)]
  WHEN suffix(lower(t), 's') AND NOT regexp_matches(lower(t), '(ss|us|is)$') THEN [lower(t), left(lower(t), -1)]
  WHEN NOT suffix(lower(t), 's') AND suffix(lower(t), 'ing') AND length(t) > 6 THEN [lower(t), left(lower(t), -3)] ELSE [lower(t)] END))""")
add("f14_tokenize", lambda spark, d: over(spark, d, "documents", ["doc_id"], tokens=F.array_join(tx.tokens(body()), " ")), f"SELECT doc_id, array_to_string({TOKEN_SQL.format('text')}, ' ') AS tokens FROM documents")
add("f16_preview", lambda spark, d: over(spark, d, "documents", ["doc_id"], out=tx.preview(body(), 240)), f"SELECT doc_id, CASE WHEN length(x) <= 240 THEN x ELSE left(x, 240) || '…' END AS out FROM (SELECT doc_id, {STRIP.format(r"regexp_replace(text, '\s+', ' ', 'g')")} AS x FROM documents)")
add("f17_citation_label", lambda spark, d: over(spark, d, "documents", ["doc_id"], label=F.concat_ws(" · ", F.col("source"), F.concat(F.lit("p. "), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") + 1).cast("string")), F.when(F.col("lang") != "en", F.col("lang")))),
    "SELECT doc_id, concat_ws(' · ', source, 'p. ' || CASE WHEN doc_id % 2 = 0 THEN doc_id + 1 END, CASE WHEN lang <> 'en' THEN lang END) AS label FROM documents")
add("f18_markers", lambda spark, d: over(spark, d, "conversations", ["conv_id", "turn"], markers=F.array_join(F.transform(F.regexp_extract_all(F.concat(body(), F.lit(" [1] [07] [123] [x] [2]")), F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda m: F.concat(F.lit("["), m.cast("int").cast("string"), F.lit("]"))), ",")),
    r"SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text || ' [1] [07] [123] [x] [2]', '\[(\d{1,2})\]', 1), lambda m: '[' || CAST(m AS INT) || ']'), ',') AS markers FROM conversations")
ANSWER_SQL = Sql(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(" + STRIP.format("{}") + r"), '[\s.,;:!?]+$', ''), '^(the|a|an)\s+', ''), '\s+', ' ', 'g'), '^[ .,:;]+|[ .,:;]+$', '', 'g')")
add("f20_normalise_answer", lambda spark, d: over(spark, d, "part", ["p_partkey"], out=tx.answer(F.concat(F.lit(" The "), F.col("p_name"), F.lit(" ;!")))), f"SELECT p_partkey, {ANSWER_SQL.format("' The ' || p_name || ' ;!'")} AS out FROM part")
add("f21_human_size", lambda spark, d: over(spark, d, "documents", ["doc_id"], out=F.when(F.col("n_chars") < 1024, F.format_string("%d B", "n_chars")).otherwise(F.format_string("%.1f KB", F.round(F.col("n_chars") / 1024, 1)))), "SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE printf('%.1f KB', round(n_chars / 1024, 1)) END AS out FROM documents")
add("f22_table_row", lambda spark, d: table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("| "), F.array_join(F.transform(F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")), lambda c: F.trim(F.regexp_replace(F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|")), r"\s{2,}", " "))), " | "), F.lit(" |")).alias("row")),
    "SELECT n_nationkey, '| ' || concat_ws(' | ', n_nationkey, replace(n_name, '|', '\\|'), n_regionkey) || ' |' AS row FROM nation")
add("f27_url_key", lambda spark, d: over(spark, d, "pages", ["page_id"], key=F.lower(F.regexp_replace(F.concat(F.parse_url("url", F.lit("HOST")), F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit(""))), "/+$", ""))),
    r"SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z]+://', ''), '[?#].*$', ''), '/+$', '')) AS key FROM pages")
add("f28_html_to_text", lambda spark, d: over(spark, d, "pages", ["page_id"], out=tx.strip(F.regexp_replace(F.regexp_replace("html", "(?s)<[^>]*>", ""), r"\s+", " "))), f"SELECT page_id, {STRIP.format(r"regexp_replace(regexp_replace(html, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')")} AS out FROM pages")
add("f30_turn_lines", lambda spark, d: over(spark, d, "conversations", ["conv_id", "turn"], line=F.concat(F.when(F.col("role") == "user", "Learner: ").otherwise("Tutor: "), F.left(body(), F.lit(600)))), "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Learner: ' ELSE 'Tutor: ' END || left(text, 600) AS line FROM conversations")
add("f32_card_key", lambda spark, d: over(spark, d, "part", ["p_partkey"], key=F.left(F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", " ")), F.lit(80))), "SELECT p_partkey, left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), 80) AS key FROM part")
add("f34_topic_list", lambda spark, d: over(spark, d, "part", ["p_partkey"], topics=F.array_join(F.array_distinct(F.filter(F.transform(F.split(F.concat_ws(",", "p_type", "p_brand", F.lit(" "), "p_type"), "[\n,]"), lambda x: F.trim(x)), lambda x: x != "")), ";")), "SELECT p_partkey, CASE WHEN trim(p_type) = trim(p_brand) THEN trim(p_type) ELSE trim(p_type) || ';' || trim(p_brand) END AS topics FROM part")
add("f36_finalize_document", lambda spark, d: table(spark, d, "documents").select("doc_id", F.filter(F.transform(F.split("text", "\n"), lambda p: tx.strip(p)), lambda p: p != "").alias("pages")).select("doc_id", F.size("pages").cast("bigint").alias("page_count"), F.aggregate("pages", F.lit(0).cast("bigint"), lambda a, p: a + F.length(p)).alias("char_count"), F.array_join("pages", "\n\n").alias("full_text")),
    f"WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, e'\\n'), lambda x: {STRIP.format('x')}), lambda x: x <> '') AS p FROM documents) SELECT doc_id, CAST(len(p) AS BIGINT) AS page_count, CAST(coalesce(list_sum(list_transform(p, lambda x: length(x))), 0) AS BIGINT) AS char_count, array_to_string(p, e'\\n\\n') AS full_text FROM p")
add("m06_confidence_level", lambda spark, d: over(spark, d, "events", ["event_id"], level=F.when(F.col("value") / 100 >= 0.62, "high").when(F.col("value") / 100 >= 0.34, "medium").otherwise("low")), "SELECT event_id, CASE WHEN value / 100 >= 0.62 THEN 'high' WHEN value / 100 >= 0.34 THEN 'medium' ELSE 'low' END AS level FROM events")
add("m07_estimate_tokens", lambda spark, d: over(spark, d, "documents", ["doc_id"], tokens=tx.token_estimate(body())), f"SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(CASE WHEN {STRIP.format('text')} = '' THEN 0 ELSE len(string_split_regex({STRIP.format('text')}, '\\s+')) END, length(text) // 4 + 1) END AS INT) AS tokens FROM documents")
add("m09_document_id", lambda spark, d: over(spark, d, "documents", ["doc_id"], content_hash=F.substring(F.sha2("text", 256), 1, 32), document_id=F.substring(F.sha2(F.sha2("text", 256), 256), 1, 32)), "SELECT doc_id, left(sha256(text), 32) AS content_hash, left(sha256(sha256(text)), 32) AS document_id FROM documents")
add("m10_cache_key", lambda spark, d: over(spark, d, "part", ["p_partkey"], key=F.concat(F.lit("part-"), F.substring(F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256), 1, 24))), "SELECT p_partkey, 'part-' || left(sha256(p_name || '|' || p_brand), 24) AS key FROM part")
add("m04_sigmoid", lambda spark, d: over(spark, d, "events", ["event_id"], out=F.round(F.when(F.col("value") - 20 > 30, 1.0).when(F.col("value") - 20 < -30, 0.0).otherwise(1 / (1 + F.pow(F.lit(2.718281828), 20 - F.col("value")))), 6)), "SELECT event_id, round(CASE WHEN value - 20 > 30 THEN 1.0 WHEN value - 20 < -30 THEN 0.0 ELSE 1 / (1 + pow(2.718281828, 20 - value)) END, 6) AS out FROM events")
add("m05_clamp", lambda spark, d: over(spark, d, "events", ["event_id"], out=F.round(F.least(F.greatest(F.coalesce(F.col("value") / 10, F.lit(0.5)), F.lit(0.0)), F.lit(1.0)), 6)), "SELECT event_id, round(least(greatest(coalesce(value / 10, 0.5), 0.0), 1.0), 6) AS out FROM events")
add("m12_coerce_int", lambda spark, d: over(spark, d, "events", ["event_id"], k=F.when(F.regexp_extract("props", r"(\d{1,9})", 1).cast("int").between(1, 50), F.regexp_extract("props", r"(\d{1,9})", 1).cast("int")).otherwise(F.lit(10))), r"SELECT event_id, CASE WHEN TRY_CAST(regexp_extract(props, '(\d{1,9})', 1) AS INT) BETWEEN 1 AND 50 THEN TRY_CAST(regexp_extract(props, '(\d{1,9})', 1) AS INT) ELSE 10 END AS k FROM events")
add("m13_numeric_value", lambda spark, d: over(spark, d, "part", ["p_partkey"], number=F.expr(r"try_cast(regexp_extract(replace(concat('about ', cast(p_retailprice AS string), ' units'), ',', ''), '[-+]?[0-9]*[.]?[0-9]+', 0) AS double)")), "SELECT p_partkey, CAST(regexp_extract(replace('about ' || p_retailprice || ' units', ',', ''), '[-+]?[0-9]*[.]?[0-9]+', 0) AS DOUBLE) AS number FROM part")
add("m14_guess_year", lambda spark, d: over(spark, d, "documents", ["doc_id"], year=F.expr(r"try_cast(nullif(regexp_extract(text, '(19|20)[0-9]{2}', 0), '') AS int)")), "SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '(19|20)[0-9]{2}', 0), '') AS INT) AS year FROM documents")
add("m16_iso_day", lambda spark, d: over(spark, d, "orders", ["o_orderkey"], day=F.date_format("o_orderdate", "yyyy-MM-dd")), "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
add("m18_parse_date", lambda spark, d: over(spark, d, "orders", ["o_orderkey"], ok=F.expr("try_to_date(CASE WHEN o_orderkey % 3 = 0 THEN 'soon' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END, 'yyyy-MM-dd')").cast("string")), "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS ok FROM orders")
add("m21_json_field", lambda spark, d: over(spark, d, "events", ["event_id"], k=F.get_json_object("props", "$.k").cast("int")), "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
add("m22_list_split", lambda spark, d: over(spark, d, "part", ["p_partkey"], items=F.array_join(F.filter(F.transform(F.split(F.concat_ws("; ", "p_name", F.lit(""), "p_brand"), "[;\n]"), lambda x: F.trim(x)), lambda x: x != ""), "|")), "SELECT p_partkey, trim(p_name) || '|' || trim(p_brand) AS items FROM part")
ERRORS = (("timeout", "timed? ?out|timeout"), ("rate_limit", "rate.?limit|429"), ("permanent", "invalid|unauthor|40[013]"))


def errors(spark, d):
    message = F.concat(F.element_at(F.array(*map(F.lit, ("request timed out", "HTTP 429", "invalid key", "odd failure"))), (F.col("event_id") % 4 + 1).cast("int")), F.lit(" "), F.col("event_type"))
    kind = F.lit("other")
    for name, pattern in reversed(ERRORS):
        kind = F.when(message.rlike(pattern), name).otherwise(kind)
    return table(spark, d, "events").select("event_id", kind.alias("kind"))


add("m27_error_class", errors, "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'permanent' ELSE 'other' END AS kind FROM events")
KEYS = ("the", "tion", "summary", "is")
add("p12_keyword_match", lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", tx.mentions(body(), KEYS).alias("hit")), "SELECT conv_id, turn, regexp_matches(lower(text), '(^|[^a-z0-9])(the|tion(e?s)?|summary(e?s)?|is)([^a-z0-9]|$)') AS hit FROM conversations")
#: Words that lean on what was said before, and openings of follow-up questions.
PRONOUNS = "this that it these those they them he she his her their more again elaborate".split()
FOLLOW_UP = r"^\s*(explain|elaborate|expand)\s+(this|that|it)\b|^\s*(more|anything else|what else)\b|^\s*and\s+(what|why|how|when|where)\b|^\s*(why|how)\s+(is|are|does|do|can)\s+(that|this|it)\b|^\s*(tell me )?(more )?about (it|that|this)\b"


def vague(text):
    low = F.lower(tx.strip(text))
    words = F.split(low, r"\s+")
    return (low == "") | ((F.size(words) <= 3) & F.arrays_overlap(words, F.array(*map(F.lit, PRONOUNS)))) | low.rlike(FOLLOW_UP)


add("p13_vague_question", lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", vague(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("explain this "), body())).otherwise(F.left(body(), F.lit(12)))).alias("vague")),
    f"SELECT conv_id, turn, s = '' OR (len(w) <= 3 AND list_has_any(w, {PRONOUNS!r})) OR regexp_matches(s, '{FOLLOW_UP}') AS vague FROM (SELECT conv_id, turn, s, string_split_regex(s, '\\s+') AS w FROM (SELECT conv_id, turn, lower({STRIP.format("CASE WHEN turn % 3 = 0 THEN 'explain this ' || text ELSE left(text, 12) END")}) AS s FROM conversations))")
add("p14_is_table", lambda spark, d: over(spark, d, "documents", ["doc_id"], is_table=F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit(""))) >= 4), "SELECT doc_id, length(text) - length(replace(text, '|', '')) >= 4 AS is_table FROM documents")
add("p06_upload_validation", lambda spark, d: over(spark, d, "documents", ["doc_id"], verdict=F.when(F.col("n_chars") <= 0, "empty").when(F.col("n_chars") > 5000, "too large").when(~F.col("source").isin("src1", "src2", "src3"), "bad extension").otherwise("ok")), "SELECT doc_id, CASE WHEN n_chars <= 0 THEN 'empty' WHEN n_chars > 5000 THEN 'too large' WHEN source NOT IN ('src1', 'src2', 'src3') THEN 'bad extension' ELSE 'ok' END AS verdict FROM documents")
add("p09_name_contains", lambda spark, d: table(spark, d, "part").filter(F.lower("p_name").contains("an")).select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an')")
add("p11_flatten_metadata", lambda spark, d: over(spark, d, "documents", ["doc_id"], head=F.left(body(), F.lit(480)), lang=F.nullif(F.col("lang"), F.lit("en"))), "SELECT doc_id, left(text, 480) AS head, nullif(lang, 'en') AS lang FROM documents")
add("w09_digest", lambda spark, d: over(spark, d, "conversations", ["conv_id", "turn"], out=F.when(F.length("text") <= 1200, F.col("text")).otherwise(F.concat(F.left("text", F.lit(600)), F.lit(" ... "), F.right("text", F.lit(600))))), "SELECT conv_id, turn, CASE WHEN length(text) <= 1200 THEN text ELSE left(text, 600) || ' ... ' || right(text, 600) END AS out FROM conversations")
#: Intents and the keywords that decide them, the first match wins.
ROUTES = (
    ("plan", ("study plan", "revision schedule", "schedule my", "plan my", "timetable")),
    ("exam", ("exam paper", "mock exam", "exam mode", "full exam", "past paper")),
    ("quiz", ("quiz", "test me", "mcq", "practice questions", "viva", "question paper")),
    ("flashcards", ("flashcard", "flash card", "revision card", "spaced repetition", "anki")),
    ("paper_analysis", ("analyse this paper", "analyze this paper", "paper analysis", "methodology of this", "research gap", "critical analysis", "summarise this paper", "summarize this paper")),
    ("compare", ("compare", "versus", " vs ", "vs.", "difference between", "contradict", "conflict")),
    ("socratic", ("socratic", "guide me", "hint me", "don't tell me", "dont tell me")),
    ("summarize", ("summarise", "summarize", "tldr", "tl;dr", "in short", "condense")),
    ("progress", ("how am i", "my progress", "my score", "weak area", "streak", "improve me")),
    ("research", ("latest", "news", "on the internet", "online", "recent paper", "who is working on", "research", "find papers", "literature", "state of the art", "survey the")),
    ("search", ("search for", "search my", "find where", "look up", "locate", "search")),
    ("explain", ("explain", "teach me", "how does", "what is", "why does", "walk me through", "i don't understand", "help me understand", "meaning of")),
    ("small_talk", ("hi", "hello", "hey", "thanks", "thank you", "who are you", "what can you do")),
)


def route(text):
    intent = F.lit("unclear")
    for name, keywords in reversed(ROUTES):
        intent = F.when(tx.mentions(text, keywords), name).otherwise(intent)
    return intent


LEADS = ("please make me a study plan for", "give me a mock exam on", "quiz me on", "compare", "what is", "hello", "latest news on", "it")


def routed(spark, d):
    lead = F.element_at(F.array(*map(F.lit, LEADS)), (F.col("turn") % len(LEADS) + 1).cast("int"))
    text = F.concat(lead, F.lit(" "), body())
    return table(spark, d, "conversations").select("conv_id", "turn", route(text).alias("intent")).withColumn("confidence", F.when(F.col("intent") == "unclear", 0.3).otherwise(0.62))


add("g14_rule_router", routed, "SELECT *, CAST(CASE WHEN intent = 'unclear' THEN 0.3 ELSE 0.62 END AS DOUBLE) AS confidence FROM (SELECT conv_id, turn, CASE "
    + " ".join(f"WHEN regexp_matches(s, '{q(tx.keyword_pattern(k))}') THEN '{n}'" for n, k in ROUTES)
    + f" ELSE 'unclear' END AS intent FROM (SELECT conv_id, turn, lower({[*LEADS]!r}[turn % {len(LEADS)} + 1] || ' ' || text) AS s FROM conversations))")
