"""Structure of texts: paragraphs, pages, headings and their paths, pipe tables, front matter, JSON within prose."""

from __future__ import annotations

import csv
import html
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as tx

#: Characters of a page made of a text without pages, and levels of headings.
PAGE_CHARS, LEVELS = 3000, 6


def paragraphs(text: Column) -> Column:
    """Blocks between empty lines, and at single line ends before a capital or a digit."""
    parts = F.split(tx.squeeze(text), r"\n\s*\n|(?<!\n)\n(?=\s*[A-Z0-9])")
    return F.filter(F.transform(parts, tx.strip), lambda p: p != "")


def pages(text: Column, chars: int = PAGE_CHARS) -> Column:
    """array<string>: blocks of a text packed to pages; a block is never cut."""
    blocks = F.filter(F.transform(F.split(F.replace(text, F.lit("\f"), F.lit("\n\n")), "\n\n"), tx.strip), lambda b: b != "")
    # the fold keeps where pages begin, not the pages
    start = F.struct(F.array().cast("array<int>").alias("begins"), F.lit(0).alias("i"), F.lit(0).alias("n"))

    def step(acc: Column, b: Column) -> Column:
        fresh = (acc["i"] == 0) | (acc["n"] + F.length(b) > chars)
        return F.struct(F.when(fresh, F.array_append(acc["begins"], acc["i"])).otherwise(acc["begins"]).alias("begins"), (acc["i"] + 1).alias("i"), (F.when(fresh, F.lit(0)).otherwise(acc["n"]) + F.length(b) + 2).alias("n"))

    def cut(v: Column) -> Column:
        ends = F.array_append(F.slice(v["begins"], F.lit(2), F.size(v["begins"])), F.size(v["blocks"]))
        return F.zip_with(v["begins"], ends, lambda lo, hi: F.array_join(F.slice(v["blocks"], lo + 1, hi - lo), "\n\n"))

    whole = lambda bs: tx.let(F.struct(bs.alias("blocks"), F.aggregate(bs, start, step, lambda acc: acc["begins"]).alias("begins")), cut)
    return F.when(F.size(blocks) > 0, tx.let(blocks, whole)).otherwise(F.array().cast("array<string>"))


def heading_paths(lines: DataFrame, key: str) -> DataFrame:
    """``lines`` (key, i, line) with ``level`` (null: no heading) and ``path``, the open headings at each line.

    A heading closes those of its own level and below. Which are open follows from where each level had its
    last heading: one is open while no heading of a level above came after it. One pass over windows of a
    document's lines, no state that grows with the text.
    """
    s = tx.strip(F.coalesce("line", F.lit("")))
    level = F.when(tx.is_heading(F.col("line")), tx.heading_level(F.col("line")))
    title = tx.strip(F.regexp_replace(F.regexp_replace(s, r"^#{1,6}\s+", ""), r"^[*_# ]+|[*_# ]+$", ""))
    w = W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = lines.withColumn("level", level).withColumn("title", title)
    for k in range(1, LEVELS + 1):
        rows = rows.withColumn(f"_h{k}", F.last(F.when(F.col("level") == k, F.struct("i", "title")), ignorenulls=True).over(w))
    parts = []
    for k in range(1, LEVELS + 1):
        above = [F.coalesce(F.col(f"_h{j}.i"), F.lit(-1)) for j in range(1, k)]
        later = F.lit(False) if not above else (F.greatest(*above, F.lit(-1)) > F.col(f"_h{k}.i"))
        parts.append(F.when(F.col(f"_h{k}").isNotNull() & ~later, F.nullif(F.col(f"_h{k}.title"), F.lit(""))))
    return rows.withColumn("path", F.concat_ws(" > ", *parts)).drop("title", *[f"_h{k}" for k in range(1, LEVELS + 1)])


# What follows works on one text at a time, in Arrow batches of the loaders.
#: Cells of aligned text, lines that divide a table's head, words of a head, cells that are numbers, the longest cell.
CELLS, DIVIDER = re.compile(r"\s{2,}|\s*\|\s*|\t+"), re.compile(r"[\s|:\-]+")
HEAD_WORD = re.compile(r"\b(name|value|unit|total|item|type|description|quantity|result|method|year|rank|amount)\b", re.I)
NUMERIC, LONGEST_CELL = re.compile(r"[-+]?[\d.,%$ ]+"), 220


def cell(value) -> str:
    """A table cell on one line, of bounded length."""
    flat = re.sub(r"[ \t]{2,}", " ", ("" if value is None else str(value)).replace("\n", " ").replace("|", "\\|")).strip()
    return flat if len(flat) <= LONGEST_CELL else flat[: LONGEST_CELL - 1].rstrip() + "…"


def pipe_table(rows, caption: str | None = None) -> str:
    """A Markdown table; rows without content are left out, and a head of numbers only gets names of its own."""
    rows = [[cell(c) for c in r] for r in rows if r and any(str(c or "").strip() for c in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    head = rows[0]
    numbers = sum(bool(c and NUMERIC.fullmatch(c)) for c in head)
    if len(head) >= 2 and numbers >= max(1, len(head) - 2) and not any(map(HEAD_WORD.search, head)):
        head = [f"Col {i}" for i in range(1, width + 1)]
    lines = [head, ["---"] * width, *rows[1:]]
    top = f"**{caption.strip()}**\n\n" if caption else ""
    return top + "\n".join("| " + " | ".join(r) + " |" for r in lines)


def aligned_table(text: str, columns: int = 3, least: int = 2) -> str:
    """The first run of lines that look like rows of one table, as a Markdown table; empty if there is none."""
    run: list[list[str]] = []
    for line in [*(text or "").splitlines(), ""]:
        flat = line.strip()
        row = [c for c in CELLS.split(flat) if c.strip()] if flat and ("|" in flat or re.search(r"[ \t]{2,}", flat)) and not (DIVIDER.fullmatch(flat) and "-" in flat) else []
        if len(row) >= columns:
            run.append(row)
            continue
        if len(run) >= least and len({len(r) for r in run}) == 1:
            return pipe_table(run)
        run = []
    return ""


#: The block of fields that may begin a text.
FRONT, FIELD = re.compile(r"^---\s*\n(.*?)\n---\s*\n", re.S), re.compile(r"^([A-Za-z_][\w\-]*)\s*:\s*(.+)$")


def front_matter(raw: str) -> tuple[dict, str]:
    """(title, author, subject, tags of a text's front matter; the text behind it)."""
    found = FRONT.match(raw)
    if not found:
        return {}, raw
    out: dict = {}
    for line in found[1].splitlines():
        if m := FIELD.match(line.strip()):
            name, value = m[1].lower(), m[2].strip().strip("\"'")
            if name in ("title", "author"):
                out[name] = value
            elif name in ("subject", "course"):
                out["subject"] = value
            elif name in ("tags", "keywords"):
                out["tags"] = [t.strip() for t in re.split("[,;]", value) if t.strip()][:12]
    return out, raw[found.end() :]


def decoded(raw: bytes) -> str:
    """UTF-8, with or without a mark, else Latin-1, which any bytes are."""
    try:
        return raw.decode("utf-8").removeprefix("\ufeff")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def delimiter_of(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample[:4096], delimiters=",;\t|").delimiter
    except csv.Error:
        first = sample.splitlines()[0] if sample.splitlines() else ""
        return "," if first.count(",") >= first.count(";") else ";"


def unescaped(text: str) -> str:
    return html.unescape(text)


def json_within(text: str | None):
    """The first JSON object or list in a text, in a fence or among prose, or its readable part if it is cut off; else None."""
    text = (text or "").translate(str.maketrans("“”‘’\u00a0", "\"\"'' "))
    fenced = re.search(r"```\w*\s*(.*?)```", text, re.S)
    for part in ([fenced[1]] if fenced else []) + [text]:
        at = 0
        while m := re.compile(r"[{\[]").search(part, at):
            closed, end = _closed(part[m.start() :])
            for attempt in (part[m.start() : m.start() + end], closed):
                try:
                    return json.loads(re.sub(r",\s*([}\]])", r"\1", attempt))
                except ValueError:
                    continue
            at = m.start() + 1
            if not end:  # nothing behind closes it either
                break
    return None


def _closed(part: str) -> tuple[str, int]:
    """(``part`` with what is open at its end closed, the length up to where its first bracket closes or 0)."""
    open_, quoted, skip = [], False, False
    for i, c in enumerate(part):
        if skip:
            skip = False
        elif quoted:
            quoted, skip = c != '"', c == "\\"
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]" and open_ and open_[-1] == c:
            open_.pop()
            if not open_:
                return part[: i + 1], i + 1
    tail = re.sub(r"[,:]\s*$", "", part + '"' * quoted)
    return tail + "".join(reversed(open_)), 0
