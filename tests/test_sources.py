"""Loaded files, stored tables, streams that go on, and points of extension."""

import io
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry import providers
from quarry.functions import structure
from quarry.functions import text as tx
from quarry.operators import bm25, chunks, vectors
from quarry.sources import loaders
from quarry.sources.store import Store
from quarry.streaming import events, ingest

SF = "/root/testdata/sf0.001"
NOTE = """# Thermal Notes

## Second Law
The entropy of a closed system never falls over time. Heat flows from hot bodies to cold ones without any help.
A machine that works in a cycle cannot turn all of its heat into work, whatever its parts are made of.

## Free Energy
The free energy of a system tells how much work it can give at a fixed temperature. It falls in changes that run by themselves.

| quantity | symbol | unit |
| --- | --- | --- |
| energy | G | J |

## Enthalpy
Enthalpy is the heat content of a system at a fixed pressure, its energy and the work that makes room for it.
"""


def office(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_rels", ".rels") if name.endswith("_rels") else name.replace("__", "/") + ".xml", body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://a" xmlns:p="http://p"'


def word():
    p = lambda text, style="": f"<w:p><w:pPr><w:pStyle w:val='{style}'/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
    body = p("Cells", "Heading2") + p("All of life is made of cells.") + f"<w:tbl>{row('name', 'size')}{row('yeast', '5')}</w:tbl>"
    core = '<c xmlns:dc="http://dc"><dc:title>Biology</dc:title><dc:creator>A. Author</dc:creator><keywords>x; y</keywords></c>'
    return office(word__document=f"<w:document {W}><w:body>{body}</w:body></w:document>", docProps__core=core)


def slides():
    sp = lambda text, kind="": f"<p:sp><p:nvPr>{f'<p:ph type={chr(34)}{kind}{chr(34)}/>' if kind else ''}</p:nvPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = f"<p:sld {A}>{sp('Waves', 'title')}{sp('A wave carries energy.')}</p:sld>"
    rels = '<Relationships><Relationship Id="r1" Target="../notesSlides/notesSlide1.xml"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide1.xml", slide)
        z.writestr("ppt/slides/_rels/slide1.xml.rels", rels)
        z.writestr("ppt/notesSlides/notesSlide1.xml", f"<p:notes {A}>{sp('say it slowly', 'body')}</p:notes>")
        z.writestr("ppt/slides/slide2.xml", f"<p:sld {A}>{sp('No title here')}{sp('More')}</p:sld>")
    return out.getvalue()


def pdf():
    content = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Gravity pulls \\(all\\) bodies) Tj 0 -14 Td [(to) -300 (gether)] TJ ET")
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(content), content), b"<< /Title (Physics) /Author (B) >>"]
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (i, p) for i, p in enumerate(parts, 1)) + b"\ntrailer << /Root 1 0 R /Info 5 0 R >>\n%%EOF"


def test_files_of_every_kind(spark, tmp_path):
    files = {
        "plain.txt": b"---\ntitle: 'Own title'\nauthor: Me\ntags: a, b; c\n---\nSome text with a [link](http://x).\n\nname | size | unit\nyeast | 5 | um\nvirus | 1 | um\n",
        "old.txt": "café time".encode("latin-1"), "mark.txt": "﻿with a mark of order".encode(), "note.md": NOTE.encode(),
        "cells.csv": b"organelle;size_um\nnucleus;6\n\nvacuole;40\n", "tabs.tsv": b"1\t2\n3\t4\n",
        "page.html": b"<title>T &amp; t</title><h1>Head</h1><p>Body &lt;x&gt;</p><script>no()</script><table><tr><th>name</th><td>n</td></tr><tr><td>a</td><td>1</td></tr></table>",
        "w.docx": word(), "s.pptx": slides(), "p.pdf": pdf(), "bad.exe": b"MZ", "empty.txt": b"", "broken.docx": b"not a zip", "fake.pdf": b"nothing",
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.document_name: r for r in loaders.load(spark, f"file://{tmp_path}").collect()}
    assert set(got) == set(files) - {"empty.txt"}  # Spark's reader passes over files without a byte
    ok = got["plain.txt"]
    assert (ok.title, ok.author, ok.tags, ok.page_count) == ("Own title", "Me", ["a", "b", "c"], 1)
    assert "Some text with a link." in ok.full_text and ok.pages[0].tables == ["| name | size | unit |\n| --- | --- | --- |\n| yeast | 5 | um |\n| virus | 1 | um |"]
    assert got["old.txt"].full_text == "café time" and got["mark.txt"].full_text == "with a mark of order"
    note = got["note.md"]
    assert [p.heading for p in note.pages if p.heading] == ["Thermal Notes", "Second Law", "Free Energy", "Enthalpy"] and note.title == "Thermal Notes"
    assert "| nucleus | 6 |" in got["cells.csv"].full_text and got["cells.csv"].title == "cells" and "- vacuole, 40" in got["cells.csv"].full_text
    assert "| Col 1 | Col 2 |" in got["tabs.tsv"].full_text
    page = got["page.html"]
    assert page.title == "T &amp; t" and page.pages[0].text.startswith("T & t\n\n# Head\n\nBody <x>") and "no()" not in page.full_text and "| a | 1 |" in page.pages[0].tables[0]
    assert got["w.docx"].title == "Biology" and got["w.docx"].full_text.startswith("## Cells\n\nAll of life") and "| yeast | 5 |" in got["w.docx"].full_text and got["w.docx"].tags == ["x", "y"]
    assert [p.text for p in got["s.pptx"].pages] == ["## Slide 1: Waves\nA wave carries energy.\n\n**Speaker notes:** say it slowly", "## Slide 2: No title here\nMore"]
    assert got["p.pdf"].title == "Physics" and got["p.pdf"].full_text == "Gravity pulls (all) bodies\nto gether"
    assert got["bad.exe"].error == "unsupported extension" and loaders.document("/x/empty.txt", b"")["error"] == "empty file" and got["broken.docx"].error and got["fake.pdf"].error
    assert {r.document_name: r.error for r in loaders.load(spark, f"file://{tmp_path}", most_mb=1e-4).collect()}["note.md"] == "file too large"


def test_chunks_keep_sections_and_tables(spark):
    got = chunks.chunk(spark.createDataFrame([(1, NOTE), (2, None), (3, "only three words"), (4, "Sentence number one is here. " * 200)], "doc_id bigint, text string")).collect()
    by = {i: [r for r in got if r.doc_id == i] for i in (1, 2, 3, 4)}
    assert [len(by[i]) for i in (2, 3)] == [0, 1]
    assert {r.heading_path for r in by[1]} == {"Thermal Notes > Second Law", "Thermal Notes > Free Energy", "Thermal Notes > Enthalpy"}
    assert all(r.embed_text.startswith(r.heading_path) and r.chapter == "Thermal Notes" for r in by[1])
    assert [r.kind for r in by[1]].count("table") == 1 and any("| energy | G | J |" in r.text for r in by[1])
    assert len(by[4]) > 4 and all(len(r.text) <= 1.7 * chunks.TARGET for r in by[4])
    tail = by[4][0].text[-29:].strip()
    assert by[4][1].text.startswith(tail)  # neighbours share whole sentences
    assert [r.chunk_index for r in by[4]] == list(range(len(by[4])))


def test_headings_in_python_are_those_of_columns(spark):
    lines = spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    more = spark.createDataFrame([(x,) for x in NOTE.splitlines() + ["1.2 Heat", "IV. War", "Chapter 3 the end,", "ALL CAPS HERE", "**bold**", "ends:", "", "a" * 130, "12 items.", "Lower and Upper"]], "line string")
    rows = lines.unionByName(more).select("line", tx.is_heading(F.col("line")).alias("h"), tx.heading_level(F.col("line")).alias("l")).collect()
    assert [r.line for r in rows if chunks.is_heading(r.line) != r.h] == []
    assert [r.line for r in rows if r.h and chunks.level_of(r.line) != r.l] == []


def test_paragraphs_pages_and_tokens(spark):
    from quarry.plans import answering_queries, store_queries

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    flat = lambda t: chunks.squeezed(t)
    for r in answering_queries.QUERIES["f07_paragraphs"][0](spark, SF).collect():
        parts = [p.strip() for p in re.split(r"\n\s*\n|(?<!\n)\n(?=\s*[A-Z0-9])", flat(docs[r.doc_id]))]
        assert r.n == len([p for p in parts if p])
    for r in store_queries.QUERIES["m08_trim_to_tokens"][0](spark, SF).collect():
        t = docs[r.doc_id]
        n = max(len(t.split()), len(t) // 4 + 1)
        assert r.kept == (len(t) if n <= 50 else len(t[: int(len(t) * (50 / n))].rstrip()))
    page = spark.createDataFrame([("a\n\nbb\f" + "c" * 10,), ("",), (None,)], "t string").select(structure.pages(F.col("t"), 8).alias("p")).collect()
    assert [r.p for r in page[:2]] == [["a\n\nbb", "c" * 10], []]


def test_json_within_text():
    assert structure.json_within('x ```json\n{"a": [1, 2,]}\n``` y') == {"a": [1, 2]}
    assert structure.json_within("before {not} [1, {“b”: 2}] after") == [1, {"b": 2}]
    assert structure.json_within('{"a": {"b": "c') == {"a": {"b": "c"}}
    assert structure.json_within("{" * 3000) is None and structure.json_within(None) is None


def test_store(spark):
    store = Store.fresh(spark, "t")
    rows = lambda *r: spark.createDataFrame([*r], "doc_id bigint, text string")
    assert store.load("x") is None and store.remove("x", F.lit(True)) == 0
    store.upsert("x", rows((1, "a"), (2, "b")), "doc_id")
    store.upsert("x", rows((2, "c"), (3, None)), "doc_id")
    assert sorted((r.doc_id, r.text) for r in store.load("x").collect() if r.text) == [(1, "a"), (2, "c")]
    assert store.remove("x", F.col("text") == "a") == 1 and store.load("x").count() == 2


def test_streams_go_on_where_they_were(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.filter("doc_id < 100").coalesce(1).write.parquet(f"{tmp_path}/in/documents.parquet")
    at = f"file://{tmp_path}/state"
    first = ingest.distinct_texts(spark, f"{tmp_path}/in", at).count()
    docs.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/documents.parquet")
    both = ingest.distinct_texts(spark, f"{tmp_path}/in", at)
    assert first < both.count() == both.select("id").distinct().count() == docs.select("text").distinct().count()
    log = spark.read.parquet(f"{SF}/events.parquet")
    log.filter("event_id % 2 = 0").coalesce(1).write.parquet(f"{tmp_path}/in/events.parquet")
    at = f"file://{tmp_path}/mastery"
    events.running_mastery(spark, f"{tmp_path}/in", at).count()
    log.filter("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/events.parquet")
    after = {(r.user_id, r.event_type): r.attempts for r in events.running_mastery(spark, f"{tmp_path}/in", at).collect()}
    assert after == {(r.user_id, r.event_type): r["count"] for r in log.groupBy("user_id", "event_type").count().collect()}


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).round(2)
    x[10], x[11], x[20] = x[5], x[5], 0
    rows = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, label bigint, embedding array<float>").repartition(5)
    queries = rows.filter("vec_id IN (5, 20, 77, 78)").select(F.col("vec_id").alias("query_id"), "embedding")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for size in (32 << 20, 100):  # at once, and in blocks of one query
        monkeypatch.setattr(vectors, "SENT", size)
        got = providers.FrameVectors(rows).query(queries, 4).orderBy("query_id", "rank").collect()
        for q in (5, 20, 77, 78):
            like = np.round(np.maximum(unit @ unit[q], 0), 6)
            assert [r.vec_id for r in got if r.query_id == q] == sorted(range(300), key=lambda i: (-like[i], i))[:4]
    assert vectors.nearest(rows, queries.limit(0), 3).count() == 0


def test_providers(spark):
    table = providers.FrameVectors(spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0])], "vec_id bigint, label bigint, embedding array<float>"))
    table.upsert(spark.createDataFrame([(2, 9, [1.0, 1.0])], "vec_id bigint, label bigint, embedding array<float>"))
    assert table.remove(F.col("label") == 1) == 1 and [r.label for r in table.rows().collect()] == [9]
    assert providers.embeddings("no-such-model").name in ("hashing", "model")
    pool = spark.createDataFrame([(1, "red cats", 1, "a red cat", 0.1), (1, "red cats", 2, "blue", 0.9)], "query_id bigint, question string, doc_id bigint, text string, score double")
    assert [r.doc_id for r in providers.reranker("cross_encoder", model="none").rerank(pool, 2).orderBy("rank").collect()] == [1, 2]
    given = spark.createDataFrame([(1, 1, 1.0)], "query_id bigint, doc_id bigint, given double")
    assert [round(r.rerank, 3) for r in providers.reranker("model", given=given).rerank(pool, 2).orderBy("rank").collect()] == [0.9, 0.685]

    class Flaky(providers.LanguageModel):
        calls = 0

        def complete(self, prompt):
            self.calls += 1
            if self.calls == 1:
                raise ConnectionError("busy")
            return "no json" if self.calls == 2 else 'ok {"a": 1}'

    waits = []
    assert Flaky().complete_json("x", sleep=waits.append) == {"a": 1} and waits == [2.0, 4.0]
    assert providers.backoff(9) == 20.0 and providers.backoff(0, 90) == 45.0
    said = providers.language_model("unknown").complete("Water boils at one hundred degrees there. Nothing else matters here at all.\n\nQUESTION: when does water boil")
    assert "Water boils" in said
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    assert "search_notes" in providers.register_tools(spark, docs)
    assert spark.sql("SELECT clip('abcdef', 3)").head()[0] == "abc…"
    term = bm25.postings(docs).orderBy(F.desc("tf"), "doc_id").head()
    assert spark.sql(f"SELECT * FROM search_notes('{term.term}', 3)").count() <= 3


@pytest.mark.parametrize("name", ["quarry.providers", "quarry.plans.catalog", "__spark_entry__"])
def test_modules_load_without_a_session(name):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    subprocess.run([sys.executable, "-c", f"import {name}"], cwd=root, check=True, env={"PYTHONPATH": str(root), "PATH": "/usr/bin:/bin"})
