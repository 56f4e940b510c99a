"""Loading files of several formats as documents of pages.

Files are read by Spark from any file system and parsed where they lie, one at a time; a format is a
function from bytes to a ``Parsed``, registered by extension. A file that cannot be parsed gives a row
with an error instead of stopping the job.
"""

from __future__ import annotations

import hashlib
import io
import re
import unicodedata
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.etree import ElementTree

import csv

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import structure as st
from quarry.operators.chunks import is_heading, squeezed


@dataclass
class Page:
    text: str
    tables: list[str] = field(default_factory=list)
    heading: str | None = None


@dataclass
class Parsed:
    pages: list[Page]
    title: str | None = None
    author: str | None = None
    subject: str | None = None
    tags: list[str] = field(default_factory=list)


#: Ligatures that are spelled out; rows of a table that is shown, and of samples.
LIGATURES = str.maketrans({"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"})
TABLE_ROWS, SAMPLE_ROWS, FIRST_TABLES = 200, 20, 3


def clean(text: str) -> str:
    """Compatibility characters folded, words joined over line ends, blanks squeezed."""
    text = unicodedata.normalize("NFKC", text or "").translate(LIGATURES).replace("\r\n", "\n").replace("\r", "\n")
    return squeezed(re.sub(r"(\w)-\n(\w)", r"\1\2", text))


def without_links(text: str) -> str:
    return re.sub(r"\[([^\]]+)\]\([^)]*\)", r"\1", re.sub(r"!\[[^\]]*\]\([^)]*\)", "", text))


def paged(text: str, chars: int = st.PAGE_CHARS) -> list[Page]:
    out: list[list[str]] = []
    size = 0
    for block in filter(None, (b.strip() for b in text.replace("\f", "\n\n").split("\n\n"))):
        if not out or size + len(block) > chars:
            out.append([])
            size = 0
        out[-1].append(block)
        size += len(block) + 2
    return [Page("\n\n".join(p)) for p in out]


def text_file(raw: bytes, name: str) -> Parsed:
    fields, body = st.front_matter(st.decoded(raw))
    body = without_links(clean(body))
    pages = paged(body)
    table = st.aligned_table(body)
    if table and pages:
        pages[0].tables.append(table)
    return Parsed(pages, fields.get("title"), fields.get("author"), fields.get("subject"), fields.get("tags", []))


def markdown_file(raw: bytes, name: str) -> Parsed:
    """A page for each heading, with what follows it."""
    doc = text_file(raw, name)
    parts: list[Page] = [Page("")]
    for page in doc.pages:
        for block in page.text.split("\n\n"):
            first, _, rest = block.strip().partition("\n")
            if re.match(r"#{1,3}\s+\S", first) or is_heading(first):
                title = first.lstrip("#").strip()
                parts.append(Page(f"## {title}" + (f"\n\n{rest.strip()}" if rest.strip() else ""), heading=title))
            elif block.strip():
                parts[-1].text += ("\n\n" if parts[-1].text else "") + block.strip()
        parts[-1].tables += page.tables
    parts = [p for p in parts if p.text or p.tables]
    if len(parts) > 1:
        doc.pages = parts
    return doc


def table_file(raw: bytes, name: str) -> Parsed:
    text, stem = st.decoded(raw), name.rsplit(".", 1)[0]
    rows = csv.reader(text.splitlines(), delimiter="\t" if name.lower().endswith(".tsv") else st.delimiter_of(text))
    rows = [r for r in rows if any(c.strip() for c in r)]
    if not rows:
        raise ValueError("the file has no rows")
    table = st.pipe_table(rows[:TABLE_ROWS], f"{name} (first {min(len(rows), TABLE_ROWS)} rows)")
    samples = ["- " + ", ".join(c.strip() for c in r if c.strip()) for r in rows[1 : SAMPLE_ROWS + 1]]
    doc = Parsed(paged("\n\n".join([f"# Dataset: {stem}", table, "## Sample rows", *samples])), stem)
    doc.pages[0].tables.append(table)
    return doc


def html_file(raw: bytes, name: str) -> Parsed:
    text = st.decoded(raw)
    bare = lambda part: st.unescaped(re.sub(r"<[^>]+>", " ", part)).strip()
    title = re.search(r"(?is)<title\b[^>]*>(.*?)</title>", text)
    found = re.findall(r"(?is)<table\b.*?</table>", text)
    tables = [st.pipe_table([[bare(c) for c in re.findall(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>", row)] for row in re.findall(r"(?is)<tr\b.*?</tr>", t)]) for t in found]
    body = re.sub(r"(?is)<(script|style|noscript|svg)\b.*?</\1>", " ", text)
    body = re.sub(r"(?is)<h([1-6])\b[^>]*>(.*?)</h\1>", lambda m: f"\n\n{'#' * int(m[1])} {m[2]}\n\n", body)
    body = re.sub(r"(?is)<table\b.*?</table>", "\n\n", body)
    body = re.sub(r"(?i)</(?:p|div|section|article|li|tr|blockquote|pre)\s*>|<br\s*/?>", "\n\n", body)
    body = clean(re.sub(r"[ \t]{2,}", " ", st.unescaped(re.sub(r"<[^>]+>", " ", body))))
    pages = paged(body)
    tables = [t for t in [*tables, st.aligned_table(body)] if t]
    if pages:
        pages[0].tables += tables[:FIRST_TABLES]
    return Parsed(pages, clean(re.sub("<[^>]+>", "", title[1]))[:200] if title else None)


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _attr(e, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), "")


def _text(e) -> str:
    """The text of an Office paragraph or cell: its runs, tabs and breaks; paragraphs on lines of their own."""
    out = []
    for x in e.iter():
        out.append({"t": x.text or "", "tab": "\t", "br": "\n", "cr": "\n"}.get(_tag(x), "\n" if _tag(x) == "p" and out else ""))
    return "".join(out)


def _find(e, *path: str):
    for name in path:
        e = next((x for x in e.iter() if _tag(x) == name), None) if e is not None else None
    return e


def _rows(table) -> list[list[str]]:
    return [[_text(c) for c in row if _tag(c) == "tc"] for row in table.iter() if _tag(row) == "tr"]


def _properties(z: zipfile.ZipFile, doc: Parsed) -> Parsed:
    if "docProps/core.xml" in z.namelist():
        of = {_tag(e): clean(e.text or "") for e in ElementTree.fromstring(z.read("docProps/core.xml")).iter()}
        doc.title, doc.author, doc.subject = of.get("title") or doc.title, of.get("creator") or None, of.get("subject") or None
        doc.tags = [t.strip() for t in re.split("[,;]", of.get("keywords", "")) if t.strip()][:12]
    return doc


def word_file(raw: bytes, name: str) -> Parsed:
    """Headings by their styles, then the tables."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = _find(ElementTree.fromstring(z.read("word/document.xml")), "body")
        blocks, tables = [], []
        for e in body:
            if _tag(e) == "tbl":
                tables.append(st.pipe_table(_rows(e)))
            elif _tag(e) == "p" and (text := clean(_text(e))):
                style = _find(e, "pStyle")
                style = _attr(style, "val").lower() if style is not None else ""
                level = int(re.search(r"\d|$", style)[0] or 1) if style.startswith("heading") else 1 if style in ("title", "subtitle") else 0
                blocks.append("#" * min(level, 6) + " " * bool(level) + text)
        return _properties(z, Parsed(paged("\n\n".join([*blocks, *filter(None, tables)]))))


def slides_file(raw: bytes, name: str) -> Parsed:
    """A page for each slide: its title, lines, tables and the speaker's notes."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        numbers = sorted(int(m[1]) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        pages = []
        for place, number in enumerate(numbers, 1):
            title, lines, tables = None, [], []
            for shape in ElementTree.fromstring(z.read(f"ppt/slides/slide{number}.xml")).iter():
                if _tag(shape) == "graphicFrame":
                    tables += filter(None, [st.pipe_table(_rows(t)) for t in shape.iter() if _tag(t) == "tbl"])
                elif _tag(shape) == "sp" and (body := _find(shape, "txBody")) is not None and (text := clean(_text(body))):
                    ph = _find(shape, "ph")
                    if ph is not None and _attr(ph, "type") in ("title", "ctrTitle"):
                        title = title or text
                    else:
                        lines += [x for x in text.splitlines() if x.strip()]
            if title is None and (short := next((x for x in lines if len(x) < 120), None)):
                title = short
                lines.remove(short)
            page = Page("\n".join([*([f"## Slide {place}: {title}"] if title else []), *lines]), tables, title)
            rels = f"ppt/slides/_rels/slide{number}.xml.rels"
            note = re.search(r'Target="\.\./(notesSlides/[^"]+)"', z.read(rels).decode()) if rels in z.namelist() else None
            if note:
                shapes = [s for s in ElementTree.fromstring(z.read(f"ppt/{note[1]}")).iter() if _tag(s) == "sp" and (ph := _find(s, "ph")) is not None and _attr(ph, "type") == "body"]
                if notes := clean("\n".join(map(_text, shapes))):
                    page.text += f"\n\n**Speaker notes:** {notes}"
            pages.append(page)
        doc = _properties(z, Parsed(pages))
        doc.title = doc.title or next((p.heading for p in pages if p.heading), None)
        return doc


def pdf_file(raw: bytes, name: str) -> Parsed:
    """Text that is shown by simple fonts on the pages of an unencrypted file; others give pages without text."""
    if not raw.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(?s)(\d+)\s+\d+\s+obj\b(.*?)endobj", raw)}

    def literal(part: bytes) -> str:
        escapes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}
        plain = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else escapes.get(m[1], m[1]), part)
        return plain[2:].decode("utf-16-be", "replace") if plain.startswith(b"\xfe\xff") else plain.decode("cp1252", "replace")

    def stream(number: int) -> bytes:
        m = re.search(rb"(?s)(.*?)stream\r?\n(.*?)\r?\n?endstream", objects.get(number, b""))
        if not m:
            return b""
        if b"FlateDecode" not in m[1]:
            return m[2]
        try:
            return zlib.decompressobj().decompress(m[2])
        except zlib.error:
            return b""

    def shown(content: bytes) -> str:
        out = []
        for m in re.finditer(rb"\(((?:[^()\\]|\\.)*)\)|(T[dDm*]|'|\"|TJ|Tj|ET)\b|\]|(-?\d{3,})(?=\s*[(\]])", content, re.S):
            if m[1] is not None:
                out.append(literal(m[1]))
            elif m[3] is not None and int(m[3]) < -200:
                out.append(" ")  # a wide gap within a line
            elif m[2] in (b"Td", b"TD", b"Tm", b"T*", b"'", b'"', b"ET"):
                out.append("\n")
        return clean("".join(out))

    pages = []
    for number in sorted(objects):
        if re.search(rb"/Type\s*/Page\b(?!s)", objects[number]):
            refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", objects[number])
            text = shown(b"\n".join(stream(int(r)) for r in re.findall(rb"(\d+)\s+\d+\s+R", refs[1]))) if refs else ""
            table = st.aligned_table(text)
            pages.append(Page(text, [table] if table else []))
    of = {k.decode().lower(): literal(v) for k, v in re.findall(rb"/(Title|Author|Subject)\s*\(((?:[^()\\]|\\.)*)\)", raw)}
    return Parsed(pages, of.get("title") or None, of.get("author") or None, of.get("subject") or None)


@dataclass(frozen=True)
class Format:
    name: str
    parse: Callable[[bytes, str], Parsed]


REGISTRY: dict[str, Format] = {}


def register(name: str, parse: Callable[[bytes, str], Parsed], *extensions: str) -> None:
    """Adds a format, or takes extensions over from another."""
    for e in extensions:
        REGISTRY[e.lower()] = Format(name, parse)


register("txt", text_file, ".txt", ".text", ".log")
register("markdown", markdown_file, ".md", ".markdown", ".mdx", ".rst")
register("csv", table_file, ".csv", ".tsv")
register("html", html_file, ".html", ".htm", ".xhtml")
register("docx", word_file, ".docx")
register("pptx", slides_file, ".pptx")
register("pdf", pdf_file, ".pdf")


def supported() -> list[str]:
    return sorted(REGISTRY)


def format_of(name: str) -> Format | None:
    return REGISTRY.get("." + name.rsplit(".", 1)[-1].lower()) if "." in name else None


PAGE = pa.struct([("page_number", pa.int32()), ("text", pa.string()), ("tables", pa.list_(pa.string())), ("heading", pa.string())])
FIELDS = [
    ("path", pa.string()), ("document_name", pa.string()), ("document_id", pa.string()), ("source_type", pa.string()), ("title", pa.string()), ("author", pa.string()),
    ("subject", pa.string()), ("tags", pa.list_(pa.string())), ("pages", pa.list_(PAGE)), ("full_text", pa.string()), ("page_count", pa.int32()), ("char_count", pa.int64()),
    ("size", pa.int64()), ("sha256", pa.string()), ("error", pa.string()),
]
SCHEMA = (
    "path string, document_name string, document_id string, source_type string, title string, author string, subject string, tags array<string>, "
    "pages array<struct<page_number:int,text:string,tables:array<string>,heading:string>>, full_text string, page_count int, char_count bigint, size bigint, sha256 string, error string"
)


def document(path: str, raw: bytes | None) -> dict:
    """A row of SCHEMA for one file."""
    raw = raw or b""
    name = path.rsplit("/", 1)[-1]
    digest, kind = hashlib.sha256(raw).hexdigest(), format_of(name)
    row = {"path": path, "document_name": name, "document_id": hashlib.sha256(digest.encode()).hexdigest()[:32], "source_type": kind.name if kind else "unknown", "size": len(raw), "sha256": digest}
    if kind is None or not raw:
        return row | {"error": "empty file" if kind else "unsupported extension"}
    try:
        doc = kind.parse(raw, name)
    except Exception as failure:  # noqa: BLE001 — whatever a file makes of its parser is that file's error
        return row | {"error": f"{type(failure).__name__}: {failure}"}
    pages = []
    for n, p in enumerate(doc.pages, 1):
        text, tables = clean(p.text), [clean(t) for t in p.tables if t.strip()]
        if text or tables:
            pages.append({"page_number": n, "text": text, "tables": tables, "heading": p.heading})
    heading = next((x.strip().strip("#* ") for p in pages for x in p["text"].splitlines() if is_heading(x) and len(x.strip()) > 3), None)
    full = "\n\n".join(f"{p['text']}\n{' '.join(p['tables'])}".strip() for p in pages)
    return row | {"title": doc.title or heading or name.rsplit(".", 1)[0], "author": doc.author, "subject": doc.subject, "tags": doc.tags, "pages": pages, "full_text": full, "page_count": len(pages), "char_count": sum(len(p["text"]) for p in pages), "error": None if pages else "no extractable text"}


def parse(files: DataFrame) -> DataFrame:
    """SCHEMA of every row of ``files`` (path, content); a narrow map, one file at a time."""

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0), batch.column(1), strict=True):
                row = document(path.as_py(), raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([row.get(n)], t) for n, t in FIELDS], [n for n, _ in FIELDS])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def load(spark: SparkSession, path: str, most_mb: float = 200.0) -> DataFrame:
    """All files below a path that have any bytes; those above ``most_mb`` are left unread, with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = F.col("length") <= int(most_mb * 1e6)
    parsed = parse(files.filter(small))
    large = files.filter(~small).select("path", F.element_at(F.split("path", "/"), -1).alias("document_name"), F.col("length").alias("size"), F.lit("file too large").alias("error"))
    return parsed.unionByName(large, allowMissingColumns=True)


def from_text(docs: DataFrame, text: str = "text", name: str = "document_name") -> DataFrame:
    """Rows of texts as files of plain text, for what never was a file."""
    return parse(docs.select(F.concat(F.col(name), F.lit(".txt")).alias("path"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content")))
