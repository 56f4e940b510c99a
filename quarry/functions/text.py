"""Text functions as column expressions: they stay in the JVM and inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic.
STOPWORDS = """
a about above after again against all am an and any are aren't as at be because been
before being below between both but by can cannot could couldn't did didn't do does
doesn't doing don't down during each few for from further had hadn't has hasn't have
haven't having he her here hers herself him himself his how i if in into is isn't it
its itself let's me more most mustn't my myself no nor not of off on once only or other
ought our ours ourselves out over own same shan't she should shouldn't so some such than
that the their theirs them themselves then there these they this those through to too
under until up very was wasn't we were weren't what when where which while who whom why
with won't would wouldn't you your yours yourself yourselves explain tell me about
please give describe what does mean do does is are the this that of and in to how why
""".split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten".split()
CONTENT_STOPWORDS = sorted(set(STOPWORDS) - set(NUMBER_WORDS))

TOKEN = r"[A-Za-z][A-Za-z'\-]*|\d+(?:\.\d+)?|[^\sA-Za-z\d]"
WORD_OR_NUMBER = r"[A-Za-z][A-Za-z'\-]*|\d+(?:\.\d+)?"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, wherever and however often ``body`` uses it.

    Spark puts the expression of a column in each place that names it, and so once for each element of an
    array whose function names it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def squeeze(text: Column) -> Column:
    """Control characters to spaces, runs of blanks to one, at most one empty line, trimmed."""
    text = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    text = F.regexp_replace(text, r"[ \t ]{2,}", " ")
    text = F.regexp_replace(text, r"(?m)[ \t]+$", "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def one_line(text: Column) -> Column:
    return F.regexp_replace(F.replace(squeeze(text), F.lit("\n"), F.lit(" ")), r"[ \t ]{2,}", " ")


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, r"(\w)-\n(\w)", "$1$2")


def clean(text: Column) -> Column:
    """The cleaning of loaded text, without compatibility folding."""
    for ligature, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    text = dehyphenate(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    text = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    text = F.regexp_replace(text, r"(?m)[ \t]+$", "")
    text = F.regexp_replace(text, r"[ \t ]{2,}", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def link_text(text: Column) -> Column:
    """Images go, links leave their text."""
    return F.regexp_replace(F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", ""), r"\[([^\]]+)\]\([^)]*\)", "$1")


def question(text: Column) -> Column:
    flat = strip(F.regexp_replace(link_text(clean(text)), r"\s+", " "))
    return strip(F.regexp_replace(flat, r"^\?+|\?+$", ""))


def forms(raw: Column) -> Column:
    """The terms of one token: words of letters are lower-cased and add one folded form."""
    low = F.lower(raw)
    n = F.length(low)
    cut = lambda k: F.substring(low, F.lit(1), n - k)
    folded = (
        F.when(low.endswith("ies") & (n > 5), F.array(low, F.concat(cut(3), F.lit("y"))))
        .when(low.endswith("sses"), F.array(low, cut(2)))
        .when(low.endswith("s") & ~(low.endswith("ss") | low.endswith("us") | low.endswith("is")), F.array(low, cut(1)))
        .when(~low.endswith("s") & low.endswith("ing") & (n > 6), F.array(low, cut(3)))
        .otherwise(F.array(low))
    )
    # longer tokens are numbers, or begin with a Latin letter and are words unless they hold one of two marks
    mixed = raw.contains("'") | raw.contains("-") | F.substring(raw, 1, 1).between("0", "9")
    return F.when(n < 2, F.when(raw.rlike(r"^\p{L}$"), F.array(low)).otherwise(F.array(raw))).when(mixed, F.array(raw)).otherwise(folded)


def ascii_forms(raw: str) -> list[str]:
    """The terms of one token of ASCII characters, as ``forms`` has them."""
    low = raw.lower()
    if len(raw) < 2:
        return [low]
    if "'" in raw or "-" in raw or raw[0].isdigit():
        return [raw]
    if low.endswith("ies") and len(low) > 5:
        return [low, low[:-3] + "y"]
    if low.endswith("sses"):
        return [low, low[:-2]]
    if low.endswith("s"):
        return [low] if low.endswith(("ss", "us", "is")) else [low, low[:-1]]
    return [low, low[:-3]] if low.endswith("ing") and len(low) > 6 else [low]


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """Tokens of sparse retrieval, within a row."""
    return F.flatten(F.transform(raw_tokens(text), forms))


def distinct_tokens(text: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(raw_tokens(text)), forms)))


def words_and_numbers(text: Column) -> Column:
    """The distinct lower-cased words and numbers, for set similarity."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD_OR_NUMBER), F.lit(0)))


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(both / (F.size(left) + F.size(right) - both))


def key_terms(text: Column, limit: int = 12) -> Column:
    """The most frequent content words, earlier ones first on ties: counted within the row."""
    raw = F.regexp_extract_all(text, F.lit(WORD_OR_NUMBER), F.lit(0))
    usable = F.filter(F.transform(raw, lambda w: F.lower(w)), lambda w: (F.length(w) >= 2) & w.rlike("^[a-z]") & ~w.isin(CONTENT_STOPWORDS))
    in_order = F.array_sort(F.transform(usable, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def runs(x: Column) -> Column:
        """Neighbours that are the same word, as (-count, first place, word): cut where a word differs from the one before."""
        first = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda k: (k == 0) | (F.get(x, k)["w"] != F.get(x, k - 1)["w"]))
        count = lambda f: F.transform(f, lambda k, j: F.struct((k - F.coalesce(F.get(f, j + 1), F.size(x))).alias("n"), F.get(x, k)["i"].alias("i"), F.get(x, k)["w"].alias("w")))
        return F.when(F.size(x) > 0, let(first, count)).otherwise(F.array().cast("array<struct<n:int,i:int,w:string>>"))

    return F.transform(F.slice(F.array_sort(let(in_order, runs)), 1, limit), lambda x: x["w"])


def sentences(text: Column, least: int = 25) -> Column:
    """Sentences, with fragments below ``least`` characters merged into what follows."""
    flat = F.replace(squeeze(text), F.lit("\n"), F.lit(" "))
    raw = F.transform(F.split(flat, "(?<=[.!?])\\s+(?=[A-Z0-9(\\[\"'“])"), strip)
    # all parts but the last end a sentence, so only those before the first of enough characters go together
    start = F.struct(F.lit(0).alias("parts"), F.lit(-1).alias("chars"))
    step = lambda acc, part: F.when(acc["chars"] >= least, acc).otherwise(F.struct((acc["parts"] + 1).alias("parts"), (acc["chars"] + 1 + F.length(part)).alias("chars")))

    def merged(parts: Column) -> Column:
        taken = F.aggregate(F.slice(parts, 1, least + 1), start, step)["parts"]
        return let(taken, lambda n: F.concat(F.array(F.array_join(F.slice(parts, F.lit(1), n), " ")), F.slice(parts, n + 1, F.size(parts))))

    return F.filter(let(raw, merged), lambda x: x != "")


def is_heading(line: Column) -> Column:
    s = strip(F.coalesce(line, F.lit("")))
    numbered = s.rlike(r"^\d+(\.\d+)*\s")
    words = F.size(F.split(s, r"\s+"))
    return (
        F.when((s == "") | (F.length(s) > 120), F.lit(False))
        .when(s.rlike("[.,;]$") & ~numbered, F.lit(False))
        .when(s.rlike(r"^#{1,6}\s+\S"), F.lit(True))
        .when(s.rlike(r"(?i)^(chapter|section|unit|module|part|lecture|topic|appendix)\b"), F.lit(True))
        .when(s.rlike(r"^\d+(\.\d+){0,3}[.)]?\s+\S"), F.lit(True))
        .when(s.rlike(r"^[IVXLC]+[.)]\s+\S"), F.lit(True))
        .when(s.rlike(r"\p{L}") & (F.upper(s) == s) & ~s.rlike(r"\p{Ll}") & (words <= 12), F.lit(True))
        .when(s.rlike(r"^(\*\*|__)") & s.rlike(r"(\*\*|__)$"), F.lit(True))
        .otherwise((words <= 9) & s.rlike(r"^\p{Lu}") & ~s.endswith(":"))
    )


def heading_level(line: Column) -> Column:
    s = strip(F.coalesce(line, F.lit("")))
    marks = F.length(F.regexp_extract(s, r"^(#{1,6})\s", 1))
    number = F.regexp_extract(s, r"^(\d+(\.\d+){0,3})[.)]?\s", 1)
    return (
        F.when(marks > 0, marks)
        .when(number != "", F.least(F.size(F.split(number, r"\.")) + 1, F.lit(6)))
        .when(s.rlike(r"(?i)^(chapter|part|unit)\b"), F.lit(1))
        .otherwise(F.lit(2))
    )


def mentions(text: Column, keywords: tuple[str, ...]) -> Column:
    """Whether any keyword occurs as whole words; keywords of four letters or more also in the plural."""
    return F.coalesce(F.lower(text).rlike(keyword_pattern(keywords)), F.lit(False))


def keyword_pattern(keywords: tuple[str, ...]) -> str:
    """In the common subset of Java's and RE2's syntax."""
    parts = []
    for keyword in keywords:
        bare = keyword.strip().lower()
        plain = "".join(c if c.isalnum() or c in " '" else "[.]" if c == "." else f"[{c}]" for c in bare).replace(" ", r"\s+")
        parts.append(plain + ("(e?s)?" if len(bare) >= 4 else ""))
    return "(^|[^a-z0-9])(" + "|".join(parts) + ")([^a-z0-9]|$)"


def answer(text: Column) -> Column:
    """An answer for tolerant comparison."""
    s = F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), r"[\s.,;:!?]+$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^(the|a|an)\s+", ""), r"\s+", " ")
    return F.regexp_replace(s, r"^[ .,:;]+|[ .,:;]+$", "")


def preview(text: Column, limit: int) -> Column:
    flat = strip(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.left(flat, F.lit(limit)), F.lit("…")))


def first_words(text: Column, limit: int) -> Column:
    words = F.split(strip(text), r"\s+")
    return F.when(F.size(words) <= limit, text).otherwise(F.concat(F.array_join(F.slice(words, 1, limit), " "), F.lit("…")))


def token_estimate(text: Column) -> Column:
    trimmed = strip(text)
    words = F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(words, F.floor(F.length(text) / 4).cast("int") + 1))
