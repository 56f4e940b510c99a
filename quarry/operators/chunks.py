"""Cutting documents into passages for retrieval, along their sections.

Lines are read in order: headings open sections and stay with every passage of theirs as a path, tables
are never cut, blocks are packed up to the usual length, and blocks much longer than it are cut at
sentences with an overlap. A document is one row, so this is a map without shuffle; rows of texts of any
length go through one document at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The usual length of a passage, the overlap, the least length, in characters; a block this much longer is cut.
TARGET, OVERLAP, LEAST, LONG = 1100, 180, 180, 1.6
HASH = re.compile(r"^\s*(#{1,6})\s+(.*\S)\s*$")
ROW = re.compile(r"^\s*\|.*\|\s*$")
EQUATION = re.compile(r"\\[a-zA-Z]+|\$\$|^\s*\w+\s*=\s*[\w({\\^/]")
CHAPTER = re.compile(r"^\s*(chapter|unit|module|part|section|lecture|topic)\b", re.I)


def is_heading(line: str) -> bool:
    """The test of ``functions.text.is_heading``, for a line in Python."""
    s = line.strip()
    if not s or len(s) > 120 or (s[-1] in ".,;" and not re.match(r"\d+(\.\d+)*\s", s)):
        return False
    if re.match(r"#{1,6}\s+\S|(?i:chapter|section|unit|module|part|lecture|topic|appendix)\b|\d+(\.\d+){0,3}[.)]?\s+\S|[IVXLC]+[.)]\s+\S", s):
        return True
    letters, words = [c for c in s if c.isalpha()], s.split()
    if letters and all(c.isupper() for c in letters) and len(words) <= 12:
        return True
    return (s.startswith(("**", "__")) and s.endswith(("**", "__"))) or (len(words) <= 9 and s[0].isupper() and s[-1] != ":")


def level_of(line: str) -> int:
    s = line.strip()
    if m := re.match(r"(#{1,6})\s", s):
        return len(m[1])
    if m := re.match(r"(\d+(?:\.\d+){0,3})[.)]?\s", s):
        return min(m[1].count(".") + 2, 6)
    return 1 if re.match(r"(?i:chapter|part|unit)\b", s) else 2


def squeezed(text: str) -> str:
    text = re.sub(r"[ \t\u00a0]{2,}", " ", re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ", text))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)[ \t]+$", "", text)).strip()


def sentences(text: str, least: int = 40) -> list[str]:
    """Sentences; fragments below ``least`` characters go with what follows."""
    out, held = [], ""
    for part in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9(\[\"'“])", squeezed(text).replace("\n", " ")):
        joined = f"{held} {part}".strip()
        complete = len(joined) >= least or (joined.endswith((".", "!", "?")) and bool(out))
        if joined and complete:
            out.append(joined)
            held = ""
        else:
            held = joined
    return out + [held] * bool(held)


def pieces(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """A long block in passages of whole sentences, each beginning with the end of the one before."""
    out: list[str] = []
    now: list[str] = []
    size = 0
    for s in sentences(text) or [text]:
        if now and size + len(s) > target:
            out.append(" ".join(now))
            kept, room = 0, overlap
            while kept < len(now) and len(now[-kept - 1]) <= room:
                room -= len(now[-kept - 1]) + 1
                kept += 1
            now = now[len(now) - kept :]
            size = sum(map(len, now)) + len(now)
        now.append(s)
        size += len(s) + 1
    return [p.strip() for p in [*out, " ".join(now)] if p.strip()]


@dataclass
class Section:
    path: tuple[str, ...]
    chapter: str | None
    page: int
    blocks: list[tuple[str, str]] = field(default_factory=list)


def blocks_of(text: str):
    """(kind, block) in order: heading, text, equation or table."""
    held: list[str] = []
    table = False

    def flush():
        block = squeezed("\n".join(held))
        held.clear()
        if block:
            yield ("table" if table else "equation" if EQUATION.search(block) else "text"), block

    for line in text.splitlines():
        flat = line.strip()
        row = bool(ROW.match(line)) or (table and "|" in flat)
        if row != table or not flat:
            yield from flush()
            table = row
        if row:
            held.append(line.rstrip())
        elif flat and is_heading(flat):
            yield from flush()
            yield "heading", flat
        elif flat:
            held.append(line.rstrip())
    yield from flush()


def sections(pages: list[tuple[int, str]]):
    """Sections in order, each with the path of open headings."""
    stack: list[tuple[int, str]] = []
    now = Section((), None, pages[0][0] if pages else 1)
    for number, text in pages:
        for kind, block in blocks_of(text):
            if kind != "heading":
                now.blocks.append((kind, block))
                continue
            if now.blocks:
                yield now
            level, m = level_of(block), HASH.match(block)
            title = (m[2] if m else block).strip().strip("*_# ").strip()
            stack = [x for x in stack if x[0] < level] + [(level, title)]
            chapter = next((t for _, t in stack if CHAPTER.match(t)), None) or next((t for k, t in stack if k <= 2), None)
            now = Section(tuple(t for _, t in stack), chapter and chapter[:180], number)
    if now.blocks:
        yield now


def passages(section: Section, target: int = TARGET, least: int = LEAST) -> list[tuple[str, str]]:
    """(kind, text) of a section's passages; small ones at the end join the one before."""
    head = " > ".join(section.path)
    out: list[tuple[str, str]] = []
    held: list[str] = []

    def emit(kind: str, parts: list[str]) -> None:
        text = "\n\n".join(p.strip() for p in parts if p.strip())
        if not text:
            return
        if out and kind != "table" and out[-1][0] != "table" and len(text) < least and len(out[-1][1]) + len(text) <= 1.5 * target:
            out[-1] = (out[-1][0], f"{out[-1][1]}\n\n{text}")
        else:
            out.append((kind, text))

    def flush() -> None:
        if held:
            emit("text", held)
            held.clear()

    for kind, block in section.blocks:
        if kind == "table":
            flush()
            emit("table", [head, block])
        elif len(block) > LONG * target:
            flush()
            for p in pieces(block, target):
                emit(kind, [head, p])
        else:
            if held and sum(map(len, held)) + 2 * len(held) + len(block) > target:
                flush()
            held.append(block)
    flush()
    return out


SCHEMA = "doc_id bigint, chunk_index int, page int, chapter string, section string, heading_path string, kind string, text string, embed_text string, token_estimate int"


def chunk(docs: DataFrame, page_chars: int | None = None) -> DataFrame:
    """SCHEMA: the passages of every document (doc_id, text). Null and empty texts have none. ``embed_text`` is a
    passage behind its path, which is what gets embedded and searched."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = 0
                for s in sections([(1, text or "")]):
                    path = " > ".join(s.path)
                    for kind, body in passages(s):
                        full = f"{path}\n{body}" if path else body
                        rows.append((key, n, s.page, s.chapter, s.path[-1][:180] if s.path else None, path or "Document", kind, body, full, max(len(full.split()), len(full) // 4 + 1)))
                        n += 1
            kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 6, pa.int32()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return docs.select("doc_id", F.col("text")).mapInArrow(run, SCHEMA)
