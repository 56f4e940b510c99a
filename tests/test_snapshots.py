"""Versions of several tables, crashes between any two steps, writers at once; the index that is stored in them."""

import collections
import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry.sources import postings
from quarry.sources.postings import PostingsIndex, documents_index
from quarry.sources.snapshots import Append, Catalog, Conflict, Drop, Put
from quarry.sources.store import Store

SF = "/root/testdata/sf0.001"


class Crash(Exception):
    pass


class Failing(Catalog):
    """Stops at a step of a commit, by its number."""

    def __init__(self, *args, at):
        super().__init__(*args)
        self.left, self.seen = at, []

    def step(self, name):
        self.seen.append(name)
        if self.left == 0:
            raise Crash(name)
        self.left -= 1


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n bigint")


def read(catalog, name, version=None):
    rows = catalog.load(name, version)
    return None if rows is None else sorted(r.n for r in rows.collect())


def test_versions_and_older_ones(spark):
    c = Catalog.fresh(spark, "t")
    assert c.versions() == [] and read(c, "x") is None
    c.commit(lambda _: {"x": Put(numbers(spark, 1, 2)), "y": Put(numbers(spark, 5))})
    c.commit(lambda _: {"x": Append(numbers(spark, 3))})
    c.commit(lambda now: {"y": Drop(), "x": Put(now.load("x").filter("n > 1"))})
    assert c.versions() == [1, 2, 3]
    assert [read(c, "x", v) for v in (1, 2, 3)] == [[1, 2], [1, 2, 3], [2, 3]]
    assert read(c, "y", 2) == [5] and read(c, "y") is None
    with pytest.raises(KeyError):
        c.snapshot(9)
    assert c.commit(lambda _: {}).version == 3


def test_crash_at_every_step_leaves_whole_versions(spark):
    """Both tables are as before or both as after, whatever step a writer stops at; and the next writer goes on."""
    change = lambda now: {"x": Put(numbers(spark, 7)), "y": Append(numbers(spark, 8))}
    done, at = set(), 0
    while "committed" not in done:
        c = Catalog.fresh(spark, "t")
        c.commit(lambda _: {"x": Put(numbers(spark, 1)), "y": Put(numbers(spark, 2))})
        failing = Failing(spark, c.root, at=at)
        with pytest.raises(Crash) as stop:
            failing.commit(change)
        done.add(str(stop.value))
        after = str(stop.value) == "committed"
        assert (read(c, "x"), read(c, "y")) == (([7], [2, 8]) if after else ([1], [2]))
        c.commit(lambda now: {"x": Put(now.load("x").withColumn("n", F.col("n") + 100))})
        assert read(c, "x") == ([107] if after else [101])
        c.vacuum(older_than=0)
        assert (read(c, "x"), read(c, "y")) == (([107], [2, 8]) if after else ([101], [2]))
        at += 1
    assert done == {"changed", "staged x", "staged y", "written", "committed"}


def test_writers_at_once_lose_no_rows(spark):
    c = Catalog.fresh(spark, "t")
    c.commit(lambda _: {"sum": Put(numbers(spark, 0)), "log": Put(numbers(spark))})
    errors = []

    def work(k):
        try:
            for i in range(3):
                Catalog(spark, c.root).commit(lambda now: {"sum": Put(now.load("sum").select((F.col("n") + 1).alias("n"))), "log": Append(numbers(spark, 10 * k + i))}, tries=50)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not errors and read(c, "sum") == [12] and read(c, "log") == sorted(10 * k + i for k in range(4) for i in range(3))
    assert c.versions() == list(range(1, 14))


def test_appends_need_no_second_try_and_replacing_does(spark):
    """A writer that was overtaken: what it only appended stays; what it had read is read again."""
    for kind, calls in (("append", 1), ("replace", 2)):
        c, made = Catalog.fresh(spark, "t"), []
        c.commit(lambda _: {"x": Put(numbers(spark, 1))})

        class Overtaken(Catalog):
            def step(self, name, c=c):
                if name == "written" and not self.over:
                    self.over = True
                    c.commit(lambda _: {"x": Append(numbers(spark, 2))})

        mine = Overtaken(spark, c.root)
        mine.over = False

        def change(now, kind=kind, made=made):
            made.append(now.version)
            return {"x": Append(numbers(spark, 3))} if kind == "append" else {"x": Put(now.load("x").unionByName(numbers(spark, 3)))}

        mine.commit(change)
        assert len(made) == calls and read(c, "x") == [1, 2, 3]
        with pytest.raises(Conflict):
            mine.over = False
            mine.commit(change, tries=1)


def test_vacuum_keeps_what_versions_list(spark):
    c = Catalog.fresh(spark, "t")
    for v in range(4):
        c.commit(lambda now, v=v: {"x": Put(numbers(spark, v))})
    assert c.vacuum(keep=2, older_than=3600) == 0 and c.versions() == [3, 4]
    assert c.vacuum(keep=2, older_than=0) == 2
    assert [read(c, "x", v) for v in (3, 4)] == [[2], [3]]


def test_claims_by_rename_where_links_are_unknown(spark, monkeypatch):
    c = Catalog.fresh(spark, "t")
    real = Catalog._path

    class Fs:
        def __init__(self, fs):
            self.fs = fs

        def getUri(self):
            return type("U", (), {"getScheme": lambda _: "other"})()

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(Catalog, "_path", lambda self, name: (lambda fs, p: (Fs(fs), p))(*real(self, name)))
    c._write("log/.a", "1"), c._write("log/.b", "2")
    assert c._claim("log/.a", "log/5") and not c._claim("log/.b", "log/5") and c._read("log/5") == "1"


def test_store_reads_no_broken_manifest(spark):
    store = Store.fresh(spark, "t")
    store.save("x", numbers(spark, 1))
    assert store.load("x", 1).count() == 1 and store.load("x", 7) is None
    store.catalog._write(f"log/{2:020d}.json", "{")
    assert store.load("x") is None and store.load("x", 1).count() == 1


# The index.


def plain_search(docs, queries, k):
    """BM25 by its definition over {key: terms}."""
    n, mean = len(docs), sum(max(1, len(t)) for t in docs.values()) / len(docs)
    df = collections.Counter(t for terms in docs.values() for t in set(terms))
    out = []
    for q, asked in queries.items():
        scores = []
        for key, terms in docs.items():
            s = 0.0
            for t, c in collections.Counter(asked).items():
                tf = terms.count(t)
                if tf:
                    s += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (1 + math.log(c)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * max(1, len(terms)) / mean))
            if s > 0:
                scores.append((-round(s, 6), key))
        out += [(q, key, -s, i) for i, (s, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "shared"), [(128, 200_000), (4, 20)])
def test_index_finds_what_sorting_everything_finds(spark, monkeypatch, block, shared):
    """After adding, replacing, removing and compacting; also with small blocks, most of which are left out."""
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "SHARED", shared)
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("oo", "ak", "il", "ur")]
    text = lambda: " ".join(rng.choice(words, size=int(rng.integers(0, 30)), p=np.arange(20, 0, -1) / 210))
    docs = {i: text() for i in range(120)}
    frame = lambda d: spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in d.items()], "doc_id bigint, text string, source string")
    queries = {q: text() for q in range(8)} | {8: "", 9: "unknown", 10: "boo boo bak"}
    asked = spark.createDataFrame(list(queries.items()), "query_id bigint, text string")
    index = PostingsIndex(Catalog.fresh(spark, "t"))

    def same():
        want = plain_search({i: t.split() for i, t in docs.items()}, {q: t.split() for q, t in queries.items()}, 5)
        got = sorted(tuple(r) for r in index.search(asked, 5).select("query_id", "doc_id", "score", "rank").collect())
        assert [(q, d, r) for q, d, _, r in got] == [(q, d, r) for q, d, _, r in want]
        assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))

    assert index.search(asked, 5).count() == 0 and index.count() == 0 and index.passages() is None
    index.add(frame(docs))
    same()
    new = {i: text() for i in range(100, 150)}
    docs |= new
    index.add(frame(new))
    same()
    assert index.remove(F.col("source") == "s1") == sum(i % 3 == 1 for i in docs)
    docs = {i: t for i, t in docs.items() if i % 3 != 1}
    same()
    assert sorted(r.doc_id for r in index.passages().collect()) == sorted(docs) and index.count() == len(docs)
    index.compact()
    same()
    assert index.catalog.load("gone") is None and index.catalog.load("passages").count() == len(docs)
    want = plain_search({i: t.split() for i, t in docs.items()}, {10: ["boo", "boo", "bak"]}, 200)
    got = index.search(asked.filter("query_id = 10"), 200, F.col("source") == "s2").collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == [d for _, d, _, _ in sorted(want, key=lambda w: w[3]) if d % 3 == 2]
    index.reset()
    assert index.count() == 0 and index.search(asked, 5).count() == 0


def test_blocks_that_cannot_enter_are_not_read(spark):
    """One term, many passages: the floor of the first block leaves the lighter ones out."""
    rows = [(i, " ".join(["hit"] * (1 + i % 40) + [f"w{i}"] * 40)) for i in range(4000)]
    index = PostingsIndex(Catalog.fresh(spark, "t"))
    index.add(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert index.catalog.load("postings").filter("term = 'hit'").count() == math.ceil(4000 / 128)
    found = index.search(spark.createDataFrame([(1, "hit")], "query_id bigint, text string"), 3)
    assert [r.doc_id for r in found.orderBy("rank").collect()] == [39, 79, 119]
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters", 1)[1][:200]


def test_second_search_reads_no_text_and_prunes_buckets(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    first = documents_index(spark, str(tmp_path))
    again = documents_index(spark, str(tmp_path))
    assert first.catalog.root == again.catalog.root and again.catalog.versions() == [1]
    found = again.search(spark.createDataFrame([(1, "the water")], "query_id bigint, text string"), 5)
    assert found.count() == 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line or "Scan parquet" in line]
    assert scans and not any("documents.parquet" in s or "text#" in s for s in scans)
    # a changed table has an index of its own
    spark.read.parquet(f"{SF}/documents.parquet").limit(3).write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    assert documents_index(spark, str(tmp_path)).catalog.root != first.catalog.root


def test_rows_without_key_and_repeated_keys(spark):
    index = PostingsIndex(Catalog.fresh(spark, "t"))
    index.add(spark.createDataFrame([(None, "lost"), (1, "one"), (1, "one"), (2, None)], "doc_id bigint, text string"))
    assert index.count() == 2 and {r.term for r in index.frequencies().collect()} == {"one"}
