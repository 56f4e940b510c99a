"""Queries over loaded files, stored tables and indexes, and keyed streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import structure
from quarry.functions import text as tx
from quarry.operators import hashing
from quarry.plans.retrieval_queries import POST, SCORE, TOP, asked, docs_of
from quarry.plans.table_queries import MASTERY
from quarry.plans.text_queries import TOKEN_SQL
from quarry.sources import loaders
from quarry.sources.postings import PostingsIndex
from quarry.sources.snapshots import Catalog
from quarry.sources.store import Store, embed_missing
from quarry.sources.tables import table as T
from quarry.streaming import events

QUERIES: dict = {}


def add(name, build, sql=None):
    QUERIES[name] = (build, sql)


# Files: rows of the tables as the contents of files.
def as_files(df, name, content):
    return df.select(name.alias("path"), content.cast("binary").alias("content"))


def texts_loaded(s, d, extension):
    return loaders.parse(as_files(T(s, d, "documents"), F.concat(F.col("doc_id").cast("string"), F.lit(extension)), F.col("text")))


def digests(parsed, key):
    return parsed.select(F.regexp_extract("document_name", r"^(\d+)", 1).cast("bigint").alias(key), "source_type", "title", "page_count", "char_count", F.sha2("full_text", 256).alias("digest"))


add("s02_text_files", lambda s, d: digests(texts_loaded(s, d, ".txt"), "doc_id"))
add("s03_markdown_files", lambda s, d: digests(texts_loaded(s, d, ".md"), "doc_id"))
add("s05_html_files", lambda s, d: digests(loaders.parse(as_files(T(s, d, "pages"), F.concat(F.col("page_id").cast("string"), F.lit(".html")), F.col("html"))), "page_id"))
add("s10_raw_texts", lambda s, d: loaders.from_text(T(s, d, "documents").select("text", F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("document_name"))).select("document_name", "document_id", "size"), "SELECT source || '-' || doc_id || '.txt' AS document_name, left(sha256(sha256(text)), 32) AS document_id, CAST(strlen(text) AS BIGINT) AS size FROM documents")


def regions(s, d):
    """A region's nations as a file of comma-separated values."""
    row = F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"))
    body = T(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]), "\n").alias("body"))  # a nation is one row
    return loaders.parse(as_files(body, F.concat(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit(".csv")), F.concat(F.lit("key,name,region\n\n"), "body")))


add("s04_csv_files", lambda s, d: regions(s, d).select("document_name", "title", F.get(F.get("pages", F.lit(0))["tables"], F.lit(0)).alias("table")),
    """SELECT 'region' || n_regionkey || '.csv' AS document_name, 'region' || n_regionkey AS title, '**region' || n_regionkey || '.csv (first ' || (count(*) + 1) || e' rows)**\\n\\n| key | name | region |\\n| --- | --- | --- |\\n' || string_agg('| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |', e'\\n' ORDER BY n_nationkey) AS table FROM nation GROUP BY n_regionkey""")  # fmt: skip
add("s18_file_kinds", lambda s, d: loaders.parse(as_files(s.createDataFrame([(f"a{e}",) for e in [*loaders.supported(), ".exe", ""]], "path string"), F.col("path"), F.lit("# Head\n\nname,n\nx,1"))).select("document_name", "source_type", F.col("error").isNull().alias("ok")))


def dropped_rows(s, d):
    """Rows of cells, of which those without any content fall away."""
    cells = F.array(F.when(F.col("p_size") % 3 > 0, F.col("p_name")).otherwise(" "), F.when(F.col("p_size") % 2 > 0, F.col("p_type")).otherwise(""))
    return T(s, d, "part").select("p_partkey", cells.alias("cells")).filter(F.exists("cells", lambda c: F.trim(c) != "")).select("p_partkey", F.size("cells").alias("n"))


add("p17_empty_rows", dropped_rows, "SELECT p_partkey, 2 AS n FROM part WHERE p_size % 3 > 0 OR p_size % 2 > 0")


def over_python(df, key, column, make, kind):
    """A projection by a Python function, in Arrow batches."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([make(t) for t in b.column(1).to_pylist()], pa.string() if kind == "string" else pa.int64())], [key, "out"])

    return df.select(key, column).mapInArrow(run, f"{key} bigint, out {kind}")


add("f23_aligned_table", lambda s, d: over_python(T(s, d, "documents").withColumn("text", F.replace("text", F.lit(" "), F.lit("  "))), "doc_id", "text", structure.aligned_table, "string").select("doc_id", F.sha2("out", 256).alias("digest")))


def _front(t):
    fields, body = structure.front_matter(t)
    return "|".join(f"{k}={v if isinstance(v, str) else ','.join(v)}" for k, v in sorted(fields.items())) + f"|{len(body)}"


add("f26_front_matter", lambda s, d: over_python(T(s, d, "part").withColumn("t", F.concat(F.lit("---\ntitle: "), "p_name", F.lit("\nAuthor: '"), "p_brand", F.lit("'\ntags: "), F.replace("p_type", F.lit(" "), F.lit(", ")), F.lit("\nother\n---\n"), "p_type")), "p_partkey", "t", _front, "string"),
    "SELECT p_partkey, 'author=' || p_brand || '|tags=' || replace(p_type, ' ', ',') || '|title=' || p_name || '|' || length(p_type) AS out FROM part")


def _json_k(t):
    found = structure.json_within(t)
    return int(found["k"]) if isinstance(found, dict) and "k" in found else -1


def wrapped(s, d):
    """Objects as models return them: bare, in a fence, among prose, with a comma too many, cut off, or none at all."""
    p = F.col("props")
    forms = F.array(p, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```\nok")), F.concat(F.lit("so {this} is "), p, F.lit(" then.")), F.concat(F.rtrim(p, F.lit("}")), F.lit(",}")), F.concat(F.rtrim(p, F.lit("}")), F.lit(', "more": ["a", "b')), F.lit("none {at all"))
    return over_python(T(s, d, "events").withColumn("t", F.get(forms, (F.col("event_id") % 6).cast("int"))), "event_id", "t", _json_k, "bigint")


add("m20_json_in_text", wrapped, "SELECT event_id, CASE WHEN event_id % 6 = 5 THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS out FROM events")


def trimmed(s, d, most=50):
    """Texts cut to a budget of estimated tokens."""
    n = tx.token_estimate(F.col("text"))
    cut = F.rtrim(F.left("text", F.floor(F.length("text") * (F.lit(most) / F.col("n"))).cast("int")))
    rows = T(s, d, "documents").withColumn("n", n)
    return rows.select("doc_id", F.col("n").alias("tokens"), F.length(F.when(F.col("n") <= most, F.col("text")).otherwise(F.regexp_replace(cut, r"\s+$", ""))).alias("kept"))


add("m08_trim_to_tokens", trimmed)


# Stored tables.
def indexed(s, d, fold=True):
    index = PostingsIndex(Catalog.fresh(s, "index"))
    index.add(docs_of(s, d), fold)
    return index


add("k06_index_save", lambda s, d: indexed(s, d).frequencies().select("term", "df"), POST + " SELECT term, df FROM df")


def found_or_not(s, d):
    """Passages of the index as it is stored, of one that is missing, and of one whose manifest is no manifest."""
    index, broken = indexed(s, d), Catalog.fresh(s, "broken")
    broken._write(f"log/{1:020d}.json", "{")
    rows = []
    for name, catalog in (("stored", index.catalog), ("missing", Catalog.fresh(s, "nothing")), ("corrupt", broken)):
        there = Store(s, catalog.root).load("passages")
        rows.append((name, there is not None, there.count() if there is not None else 0))
    return s.createDataFrame(rows, "name string, found boolean, passages bigint")


add("s15_index_load", found_or_not, "SELECT 'stored' AS name, true AS found, count(*) AS passages FROM documents UNION ALL SELECT * FROM (VALUES ('missing', false, 0), ('corrupt', false, 0))")


def emptied(s, d):
    index = indexed(s, d)
    before = index.count()
    index.reset()
    return s.createDataFrame([(before, index.count())], "before bigint, after bigint")


add("k03_index_reset", emptied, "SELECT count(*) AS before, CAST(0 AS BIGINT) AS after FROM documents")


def without(s, d):
    """What is left of the frequencies after one source is removed."""
    index = indexed(s, d)
    gone = index.remove(F.col("source") == "src3")
    return index.frequencies().select("term", "df", F.lit(gone).cast("bigint").alias("gone"))


add("k08_remove_document", without, POST + " SELECT term, count(*) AS df, (SELECT count(*) FROM documents WHERE source = 'src3') AS gone FROM post JOIN documents USING (doc_id) WHERE source <> 'src3' GROUP BY term")


def rebuilt(s, d):
    """All tables made anew from what is stored, after texts were replaced by themselves: postings are folded once, by this."""
    index = indexed(s, d, fold=False)
    index.add(docs_of(s, d).filter("source = 'src1'"), fold=False)
    index.compact()
    return index.frequencies()


add("k09_index_rebuild", rebuilt, POST + " SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term")


def again(s, d):
    """A source whose documents are indexed again with other texts: nothing of the first ones is left."""
    index = indexed(s, d)
    index.add(docs_of(s, d).filter("source = 'src2'").withColumn("text", F.concat(F.lit("entry "), F.col("doc_id").cast("string"))))
    return index.frequencies().select("term", "df")


add("k18_reindex_document", again, POST.replace("FROM documents), post", "FROM (SELECT doc_id, CASE WHEN source = 'src2' THEN 'entry ' || doc_id ELSE text END AS text FROM documents)), post") + " SELECT term, df FROM df")


def changed_search(s, d):
    """Searches after a source was removed and another one's texts were cut in half: the index as it is now answers."""
    index = indexed(s, d)
    index.remove(F.col("source") == "src3")
    index.add(docs_of(s, d).filter("source = 'src2'").withColumn("text", F.left("text", F.floor(F.length("text") / 2).cast("int"))))
    return index.search(asked(s, d), 10)


HALVED = "(SELECT doc_id, CASE WHEN source = 'src2' THEN left(text, length(text) // 2) ELSE text END AS text FROM documents WHERE source <> 'src3')"
add("r05_search_after_changes", changed_search, SCORE.replace("FROM documents), post", f"FROM {HALVED}), post").replace("FROM documents d LEFT JOIN", f"FROM {HALVED} d LEFT JOIN") + TOP.replace("{}", ""))


def boosted_search(s, d):
    """Key terms and the source as a heading count twice besides the text."""
    index = PostingsIndex(Catalog.fresh(s, "boosted"))
    index.add(docs_of(s, d).withColumn("boost_terms", F.array(F.upper("source"), F.regexp_extract("text", "[A-Za-z]{4,}", 0))), fold=False)
    return index.search(asked(s, d).withColumn("text", F.concat(F.left("text", F.lit(60)), F.lit(" src2"))), 10)


BOOSTED = f"{TOKEN_SQL.format('text')} || [lower(source), lower(source), lower(regexp_extract(text, '[A-Za-z]{{4,}}', 0)), lower(regexp_extract(text, '[A-Za-z]{{4,}}', 0))]"
add("r05_boosted_search", boosted_search, SCORE.replace(f"unnest({TOKEN_SQL.format('text')}) AS term FROM documents", f"unnest({BOOSTED}) AS term FROM documents").replace(f"unnest({TOKEN_SQL.format('text')}) AS term FROM benchmark", f"unnest({TOKEN_SQL.format("left(text, 60) || ' src2'")}) AS term FROM benchmark") + TOP.replace("{}", ""))


def versions(s, d):
    """Postings and passages of each version of an index that grew and shrank: an older one stays as it was."""
    index = indexed(s, d)
    index.remove(F.col("source") == "src3")
    index.remove(F.col("source") == "src2")
    rows = [(v, index.passages(index.catalog.snapshot(v)).count(), index.frequencies(index.catalog.snapshot(v)).count()) for v in index.catalog.versions()]
    return s.createDataFrame(rows, "version bigint, passages bigint, terms bigint")


add("k18_versions", versions, POST + ", v AS (SELECT * FROM (VALUES (1, ['']), (2, ['src3']), (3, ['src3', 'src2'])) AS t(version, gone)) SELECT CAST(version AS BIGINT) AS version, count(DISTINCT d.doc_id) AS passages, count(DISTINCT term) AS terms FROM v JOIN documents d ON NOT list_contains(gone, source) LEFT JOIN post USING (doc_id) GROUP BY version")


def cached(s, d):
    """Entries written, some deleted by key, then all cleared."""
    store = Store.fresh(s, "cache")
    entries = T(s, d, "part").select(F.concat(F.lit("part-"), F.substring(F.sha2("p_name", 256), 1, 24)).alias("key"), F.col("p_size").alias("value"))
    store.upsert("cache", entries, "key")
    store.upsert("cache", entries, "key")
    written = store.load("cache").count()
    deleted = store.remove("cache", F.col("key") < "part-8")
    left = store.load("cache").count()
    store.delete("cache")
    return s.createDataFrame([(written, deleted, left, store.load("cache") is None)], "written bigint, deleted bigint, kept bigint, cleared boolean")


add("k13_cache_life", cached, "WITH k AS (SELECT DISTINCT 'part-' || left(sha256(p_name), 24) AS key FROM part) SELECT count(*) AS written, count(*) FILTER (key < 'part-8') AS deleted, count(*) FILTER (key >= 'part-8') AS kept, true AS cleared FROM k")


def embedded(s, d):
    """Of texts that a cache has vectors for, none is worked out again."""
    docs = docs_of(s, d).select("doc_id", "text")
    kept = docs.filter("doc_id % 2 = 0").withColumn("digest", F.sha2("text", 256)).dropDuplicates(["digest"]).select("digest", "text")
    cache = Store.fresh(s, "embeddings").save("cache", hashing.embed(kept, "digest"))  # worked out once, however often it is read
    return embed_missing(docs, cache, lambda x: hashing.embed(x, "doc_id"), "doc_id").select("doc_id", "cached")


add("r03_embed_missing", embedded, "SELECT doc_id, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) AS cached FROM documents")

# Streams with keyed state.
add("x02_running_mastery", lambda s, d: events.running_mastery(s, d).select("user_id", "event_type", "attempts", "mastery"), f"WITH {MASTERY} SELECT user_id, event_type, attempts, mastery FROM m")
add("x06_rolling_timings", lambda s, d: events.rolling_timings(s, d).select("event_type", "n", "last", "p95"), "WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events), a AS (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n, max(value) FILTER (r = 1) AS last FROM l WHERE r <= 200 GROUP BY ALL) SELECT event_type, n, last, v[CAST(least(floor(n * 0.95), n - 1) AS INT) + 1] AS p95 FROM a")
add("x05_rolling_memory", lambda s, d: events.rolling_memory(s, d, after=4).select("conv_id", "messages", "recent", F.col("summary").isNotNull().alias("summarised")),
    r"""WITH r AS (SELECT *, CASE WHEN role = 'user' THEN 'Learner: ' ELSE 'Tutor: ' END || left(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), 400) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
  SELECT conv_id, any_value(n) AS messages, string_agg(line, e'\n' ORDER BY turn, role, text) AS recent, any_value(n) > 6 AS summarised FROM r WHERE p <= 6 GROUP BY conv_id""")  # fmt: skip
add("s17_expiring_cache", lambda s, d: events.expiring_cache(s, d, ttl=3 * 86_400_000), "WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r, max(ts) OVER () AS now FROM events) SELECT user_id, event_type, value, ts + INTERVAL 3 DAY <= date_trunc('millisecond', now) AS expired FROM l WHERE r = 1")
