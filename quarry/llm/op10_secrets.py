"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is parsed into a Boolean query of trigrams that any match must contain, in
lower case: literals and small classes give sets of exact strings, sequences join them, alternations unite
them, and what cannot be listed (wide classes, repeats) ends a string. The index holds, for the trigrams
that occur in some query, the documents that contain them; postings are intersected by document, and only
candidates are verified with the rule's expression. A rule without mandatory trigrams scans every text.

Defined results: a null text is an empty one; rows repeated with one doc_id give one row each, and are
candidates of what any of their texts is; a null doc_id is scanned in full by every rule; an empty table
gives an empty result; texts of any length are scanned whole; extra columns are ignored by the query, and
kept by ``redact``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as rc
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.shared import table, unused


@dataclass(frozen=True)
class Rule:
    """``secret``: the group that ``least`` measures; 0 is the whole match."""

    kind: str
    pattern: str
    secret: int = 0
    least: int = 1


#: The base rules of the contract, in its order, then the rules that the method adds.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("bearer", r"(?i)bearer\x20+([A-Za-z0-9._~+/-]{20,}=*)"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]+:[^\s/@]+@"),
)
RULES = BASE + MORE

#: Strings that are listed at once, and characters of a class that is listed.
STRINGS, LETTERS = 32, 12


def both(parts: list):
    """AND of queries; a query is True, a trigram, or ("and" | "or", queries)."""
    parts = sorted({p for p in parts if p is not True}, key=repr)
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def either(parts: list):
    """OR of queries; one that asks for all that another does, and more, is left out."""
    if any(p is True for p in parts):
        return True
    parts = set(parts)
    flat = {p: frozenset(p[1]) if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in parts}
    parts = sorted((p for p in parts if not any(flat[q] < flat[p] for q in parts)), key=repr)
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def strings_query(strings: set[str]):
    """What a text holds that has one of the strings."""
    return either([both([s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _letters(items) -> set[str] | None:
    """The lower-case characters of a class, or None if they are many."""
    out: set[str] = set()
    for op, value in items:
        if op is rc.LITERAL:
            out.add(chr(value).lower())
        elif op is rc.RANGE and value[1] - value[0] < LETTERS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= LETTERS else None


def _node(op, value) -> tuple[set[str] | None, object]:
    """(all strings that the node matches, or None; query of any match)."""
    if op is rc.LITERAL:
        return {chr(value).lower()}, True
    if op is rc.IN:
        return _letters(value), True
    if op is rc.SUBPATTERN:
        return _sequence(value[3])
    if op is rc.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(p[0] is not None for p in parts) and sum(len(p[0]) for p in parts) <= STRINGS:
            return set().union(*(p[0] for p in parts)), True
        return None, either([q if s is None else strings_query(s) for s, q in parts])
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, query = _sequence(inner)
        if most == 1 and strings is not None:
            return (strings if least else strings | {""}), True
        if not least:
            return None, True
        return None, query if strings is None else strings_query(strings)
    if op is rc.AT:
        return {""}, True
    return None, True  # any character, negated classes, look-around, references: nothing is known


def _sequence(nodes) -> tuple[set[str] | None, object]:
    strings, whole, queries = {""}, True, []

    def flush() -> None:
        queries.append(strings_query(strings))

    def ends(op, value) -> set[str] | None:
        """Strings that a repeat of a small class is sure to begin (or end) with, to reach over its edge."""
        if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and value[0]:
            found = _sequence(value[2])[0]
            return found if found and len(found) <= LETTERS else None
        return None

    for op, value in nodes:
        found, query = _node(op, value)
        queries.append(query)
        if found is not None and len(strings) * len(found) <= STRINGS:
            strings = {a + b for a, b in product(strings, found)}
            continue
        edge = found if found is not None else ends(op, value)
        if edge and len(strings) * len(edge) <= STRINGS:
            strings = {a + b for a, b in product(strings, edge)}
        flush()
        whole = False
        strings = set(edge) if edge and (found is not None or op in (rc.MAX_REPEAT, rc.MIN_REPEAT)) else {""}
    if whole:
        return strings, True
    flush()
    return None, both(queries)


def query_of(pattern: str):
    """The Boolean trigram query that every match of ``pattern`` implies, over lower-cased text."""
    strings, query = _sequence(_parser.parse(pattern))
    return query if strings is None else strings_query(strings)


def trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def wanted_by(rules: tuple[Rule, ...]) -> list[str]:
    return sorted(set().union(*(trigrams(query_of(r.pattern)) for r in rules)))


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The inverted index (trigram, doc_id) over the trigrams of the rules' queries.

    Only these trigrams are ever asked for, so their number is fixed by the rules, not by the corpus.
    """
    lower = F.lower("text")
    found = F.filter(F.array(*[F.when(lower.contains(t), F.lit(t)) for t in wanted_by(rules)]), lambda t: t.isNotNull())
    return docs.select("doc_id", F.explode(found).alias("trigram"))


#: Trigrams that one integer marks.
BITS = 60


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kinds): postings intersected by document, as one bit for each trigram."""
    wanted = wanted_by(rules)
    place = {t: divmod(i, BITS) for i, t in enumerate(wanted)}

    def bits(part: list[str]) -> Column:
        at = F.lit(None).cast("bigint")
        for i, t in enumerate(part):
            at = F.when(F.col("trigram") == t, F.lit(1 << i).cast("bigint")).otherwise(at)
        return F.coalesce(F.bit_or(at), F.lit(0).cast("bigint"))

    groups = [wanted[i : i + BITS] for i in range(0, len(wanted), BITS)]
    masks = postings.groupBy("doc_id").agg(*[bits(part).alias(f"m{g}") for g, part in enumerate(groups)] or [F.count(F.lit(1))])

    def holds(query) -> Column:
        if isinstance(query, str):
            g, i = place[query]
            return F.col(f"m{g}").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0
        out = holds(query[1][0])
        for part in query[1][1:]:
            out = (out & holds(part)) if query[0] == "and" else (out | holds(part))
        return out

    asked = [(r.kind, query_of(r.pattern)) for r in rules]
    kinds = F.filter(F.array(*[F.when(holds(q), F.lit(kind)) for kind, q in asked if q is not True], F.lit(None).cast("string")), lambda k: k.isNotNull())
    return masks.select("doc_id", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def running(values: Column, join, start: int) -> Column:
    """Inclusive running sums (or whatever ``join`` does) of an array of integers, in log2(n) passes over it."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int"))

    def double(acc: Column, k: Column) -> Column:
        back = lambda i: i - F.pow(F.lit(2), k).cast("int")
        return F.transform(acc, lambda v, i: join(v, F.when(back(i) >= 0, F.get(acc, back(i))).otherwise(F.lit(start))))

    return F.aggregate(steps, values, double)


NONE = "array<struct<start:int,place:int,kind:string,end:int>>"


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """array<struct<start, place, kind, end>> of a rule's matches, in code points, end exclusive.

    What stands between matches and the matches themselves, read in turn, give the positions.
    """
    pattern = F.lit(rule.pattern)
    size = lambda xs: F.transform(xs, lambda x: F.length(x))
    secret = F.regexp_extract_all(text, pattern, F.lit(rule.secret))
    # one array is worked out once as the fold's start, and then taken apart
    parts = F.arrays_zip(size(F.split(text, rule.pattern, -1)).alias("gap"), size(F.regexp_extract_all(text, pattern, F.lit(0))).alias("hit"), size(secret).alias("secret"))

    def place_all(xs: Column) -> Column:
        ends = running(F.transform(xs, lambda x: x["gap"] + F.coalesce(x["hit"], F.lit(0))), lambda a, b: a + b, 0)
        spans = F.zip_with(xs, ends, lambda x, e: F.when(x["secret"] >= rule.least, F.struct((e - x["hit"]).alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), e.alias("end"))))
        return F.filter(spans, lambda s: s.isNotNull())

    found = F.flatten(F.transform(F.array(parts), place_all))
    return F.when(text.rlike(rule.pattern), found.cast(NONE)).otherwise(F.array().cast(NONE))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, name: str = "found") -> DataFrame:
    """``docs`` with ``name``: all spans of the rules by start, then by the rules' order; null texts become empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc, kinds = unused(docs, "_doc", "_kinds")
    hits = candidates(index(docs, rules), rules).withColumnRenamed("doc_id", doc).withColumnRenamed("kinds", kinds)
    joined = docs.withColumn("text", text).join(hits, F.col("doc_id") == F.col(doc), "left")
    arrays = []
    for place, rule in enumerate(rules):
        every = spans_of(F.col("text"), rule, place)
        asked = F.array_contains(kinds, rule.kind) | F.col("doc_id").isNull()
        arrays.append(every if query_of(rule.pattern) is True else F.when(asked, every).otherwise(F.array().cast(NONE)))
    return joined.withColumn(name, F.array_sort(F.concat(*arrays))).drop(doc, kinds)


def joined_spans(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint")
    base = joined_spans(F.filter("found", lambda s: s["place"] < len(BASE)))
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), joined_spans(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` (overlapping spans by one) and n_chars set anew."""
    (name,) = unused(docs, "found")
    found = scan(docs, name=name)
    ends = running(F.transform(name, lambda s: s["end"]), lambda a, b: F.greatest(a, b), 0)
    known = F.zip_with(name, ends, lambda s, e: F.struct(s["start"].alias("start"), e.alias("end")))

    def replaced(xs: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(xs, i - 1)["end"]).otherwise(F.lit(0))
        # a span that begins within one before it adds nothing of its own
        pieces = F.transform(xs, lambda x, i: F.when(x["start"] >= before(i), F.concat(F.substring("text", before(i) + 1, x["start"] - before(i)), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), F.substring("text", F.element_at(xs, -1)["end"] + 1, F.length("text")))

    done = F.element_at(F.transform(F.array(known), replaced), 1)
    clean = found.withColumn("text", F.when(F.size(name) > 0, done).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return clean.select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are replaced by a mark; every document stays.

    Null texts become empty ones; repeated rows and rows without a doc_id are redacted each by itself; an
    empty table gives an empty one; all columns, whatever their names, are kept, n_chars set anew.
    """
    return redact(docs)


def _sql_spans(rule: Rule, place: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""(SELECT coalesce(list({{'start': s, 'place': {place}, 'kind': '{rule.kind}', 'end': s + length(hit)}} ORDER BY s) FILTER (length(secret) >= {rule.least}), [])
      FROM (SELECT hit, secret, CAST(sum(length(gap)) OVER (ORDER BY i) + coalesce(sum(length(hit)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
        FROM (SELECT unnest(range(len(hits))) AS i, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit, unnest(secrets) AS secret
          FROM (SELECT string_split_regex(d.text, '{pattern}') AS gaps, regexp_extract_all(d.text, '{pattern}', 0) AS hits, regexp_extract_all(d.text, '{pattern}', {rule.secret}) AS secrets))))"""


def oracle() -> str:
    """DuckDB SQL for op10: every rule scans every text."""
    joined = "array_to_string(list_transform(x, lambda s: s.kind || ':' || s.start || ':' || s['end']), ',')"
    lists = ", ".join(f"{_sql_spans(r, i)} AS k{i}" for i, r in enumerate(RULES))
    every = " || ".join(f"k{i}" for i in range(len(RULES)))
    base = " || ".join(f"k{i}" for i in range(len(BASE)))
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    k AS (SELECT doc_id, {lists} FROM d)
    SELECT doc_id, CAST(len(k0) AS BIGINT) AS n_assign, CAST(len(k1) AS BIGINT) AS n_access, CAST(len(k2) AS BIGINT) AS n_hex,
      sha256(coalesce({joined.replace("x,", f"list_sort({base}),", 1)}, '')) AS base_sha256,
      coalesce({joined.replace("x,", f"list_sort({every}),", 1)}, '') AS spans
    FROM k"""
