"""What a query's work grows with, held on plans and counts that are small and the same at any size."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry.functions import text as tx
from quarry.operators import hashing
from quarry.plans import catalog
from quarry.sources import postings
from quarry.sources.postings import PostingsIndex
from quarry.sources.snapshots import Catalog

SF = "/root/testdata/sf0.001"


def test_choice_is_worked_out_once(spark):
    """Steps that refer to one another are bound, not written out again in each place that names them."""
    plan = catalog.queries()["g04_resolve_choice"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 60


def test_ascii_forms(spark):
    raw = ["a", "A", "7", ".", "'", "dog", "DOGS", "ties", "Bodies", "glasses", "bus", "this", "grass", "sing", "Running", "rings", "it's", "re-use", "3.5", "42", "ss", "s-", "Is"]
    rows = spark.createDataFrame([(x,) for x in raw], "raw string").select("raw", tx.forms(F.col("raw")).alias("forms")).collect()
    assert [(r.raw, tx.ascii_forms(r.raw)) for r in rows] == [(r.raw, r.forms) for r in rows]


def test_long_queries_put_no_postings_together(spark, monkeypatch):
    """Many queries over common words: passages are scored where they are, with the results that the postings give."""
    monkeypatch.setattr(postings, "SENT", 40)  # several passes
    rng = np.random.default_rng(8)
    words = ["oak", "ash", "elms", "Ñu", "ñ", ".", "firs", "pining", "yew's", "x-1"]
    text = lambda n: " ".join(rng.choice(words, size=n, p=np.arange(10, 0, -1) / 55))
    docs = [(i, text(int(rng.integers(0, 12))) if i % 5 else "oak ash", f"s{i % 3}") for i in range(300)] + [(300, None, "s0")]
    index = PostingsIndex(Catalog.fresh(spark, "t"))
    index.add(spark.createDataFrame(docs, "doc_id bigint, text string, source string"))
    index.add(spark.createDataFrame([(7, "elms . ñ", "s1")], "doc_id bigint, text string, source string"))
    queries = [(q, text(20)) for q in range(30)] + [(30, "unknown"), (31, None)]
    asked = spark.createDataFrame(queries, "query_id bigint, text string")
    now = {i: t for i, t, _ in docs} | {7: "elms . ñ"}
    every = spark.createDataFrame([(t or "",) for t in {*now.values(), *dict(queries).values()}], "text string").select("text", tx.tokens(F.col("text")).alias("t")).collect()
    cut = {r.text: r.t for r in every}
    tokens = lambda t: cut[t or ""]
    n, mean = index.statistics()
    for allowed in (None, F.col("source") == "s1"):
        found = index.search(asked, 4, allowed)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "explode(found" not in plan
        got = sorted((r.query_id, r.doc_id, r.score, r.rank) for r in found.collect())
        assert len(got) == 4 * 30
        terms = {q: tokens(t) for q, t in queries}
        have = {i: tokens(t) for i, t in now.items()}
        df = {t: sum(t in d for d in have.values()) for d in have.values() for t in d}
        for q in range(30):
            score = {}
            for i, d in have.items():
                if allowed is not None and i % 3 != 1:
                    continue
                tf, dl = {t: d.count(t) for t in set(d)}, max(len(d), 1)
                score[i] = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * (1 + math.log(terms[q].count(t))) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * dl / mean)) for t in set(terms[q]) if t in tf)
            want = sorted((-round(x, 6), i) for i, x in score.items() if x > 0)[:4]
            mine = [(i, x) for k, i, x, _ in got if k == q]
            assert sorted(mine) == sorted((i, x) for i, x in mine if abs(x - round(score[i], 6)) < 2e-6)
            assert sorted(x for _, x in mine) == [pytest.approx(-w, abs=2e-6) for w, _ in want[::-1]]


def test_the_index_of_a_batch_is_built_from_one_pass(spark, monkeypatch, tmp_path):
    """Texts are cut into terms once, tables are written once, no text is dealt out, and postings wait until they are read."""
    spark.createDataFrame([(i, f"Öl oak ties {i % 7}", "s0") for i in range(50)], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    staged, real = [], Catalog._stage
    monkeypatch.setattr(Catalog, "_stage", lambda self, table, rows, by: staged.append((table, rows._jdf.queryExecution().optimizedPlan().toString())) or real(self, table, rows, by))
    index = postings.documents_index(spark, str(tmp_path))
    assert sorted(t for t, _ in staged) == ["forward", "frequencies", "passages", "sizes"]
    assert not any("Aggregate" in plan for t, plan in staged if t in ("passages", "forward"))
    found = index.search(spark.createDataFrame([(1, "öl 3")], "query_id bigint, text string"), 9)  # few postings: they are folded first
    assert [r.doc_id for r in found.orderBy("rank").collect()] == [3, 10, 17, 24, 31, 38, 45, 0, 1]
    assert [t for t, _ in staged][4:] == ["postings"]
    assert {r.term: (r.df, r.cf) for r in index.frequencies().collect()}["ö"] == (50, 50)


def test_passages_that_wait_are_folded_with_later_ones(spark):
    index = PostingsIndex(Catalog.fresh(spark, "t"))
    rows = lambda *ids: spark.createDataFrame([(i, f"oak n{i} " + "elm " * i) for i in ids], "doc_id bigint, text string")
    index.add(rows(1, 2, 3), fold=False)
    index.add(rows(3, 4))
    found = index.search(spark.createDataFrame([(1, "oak")], "query_id bigint, text string"), 9)
    assert [r.doc_id for r in found.orderBy("rank").collect()] == [1, 2, 3, 4]


def test_a_rebuild_folds_the_postings_once(spark, monkeypatch):
    staged, real = [], Catalog._stage
    monkeypatch.setattr(Catalog, "_stage", lambda self, table, rows, by: staged.append(table) or real(self, table, rows, by))
    catalog.queries()["k09_index_rebuild"](spark, SF)
    assert staged.count("postings") == 1 and staged.count("forward") == 3


@pytest.mark.parametrize("name", ["r07_local_rerank", "r13_build_context", "r14_build_citations", "r17_confidence", "r11_compress"])
def test_found_rows_are_sent_to_the_documents(spark, name):
    """Texts of what was found are joined where they are read: the documents are never shuffled, however large."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin [doc_id" not in plan


def test_shared_terms_are_counted_where_texts_are_read(spark, monkeypatch):
    """No posting is shuffled; repeated and missing ids are documents, and repeated ids of queries are queries, as groups have them."""
    monkeypatch.setattr(postings, "SENT", 3)  # several passes
    docs = spark.createDataFrame([(1, "Oak oaks ash"), (2, "elm"), (3, None), (3, "ash ash"), (None, "Oak"), (None, "ñ Ñ")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(7, "oak Ñ"), (7, "ash oak"), (8, "elms"), (9, None)], "query_id bigint, text string")
    want = {(7, 1): (2, 3), (7, 3): (1, 2), (7, None): (2, 3), (8, 2): (1, 1)}
    assert {(r.query_id, r.doc_id): (r.terms, r.hits) for r in postings.shared_terms(docs, queries).collect()} == want
    monkeypatch.undo()
    plan = catalog.queries()["j04_terms_and_postings"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Aggregate" not in plan


def test_one_link_counts_between_two_components(spark, monkeypatch):
    """A large group of near copies, in which nearly every two texts are linked somehow: each turn takes few links to what is there."""
    from quarry.llm import op03_bagminhash as op3

    rng = np.random.default_rng(3)

    def near(i):
        """One word of sixty is another one: alike are those whose places are next to each other."""
        words = [f"w{j}" for j in range(60)]
        words[4 + i % 52] = f"v{i}"
        return " ".join(words)

    order = rng.permutation(312)
    rows = spark.createDataFrame([(int(k), near(i)) for i, k in enumerate(order)], "doc_id bigint, text string")
    taken, real = [], op3.components
    monkeypatch.setattr(op3, "components", lambda links, *a: taken.append((links.count(), links.select("a").union(links.select("b")).distinct().count())) or real(links, *a))
    classes = op3.near_duplicates(rows)
    texts = {r.doc_id: r.text.split() for r in rows.collect()}
    bags = {i: {tuple(t[j : j + 5]) for j in range(len(t) - 4)} for i, t in texts.items()}
    root = {i: i for i in texts}
    for i in sorted(texts):
        for j in range(i):
            same = len(bags[i] & bags[j])
            if same >= 0.8 * (len(bags[i]) + len(bags[j]) - same) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if v == old else v for k, v in root.items()}
    assert {r.doc_id: r.class_id for r in classes.collect()} == root
    assert all(links <= 2 * nodes for links, nodes in taken), taken


def test_words_that_texts_share_are_hashed_once(spark, monkeypatch):
    """More words than are remembered: those of texts that are read together are hashed together all the same."""
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    counts = [Counter(words[i:] + words[:i] + words[i : i + 40]) for i in range(120)]
    alone = np.array([hashing._vectors([c], hashing.Places())[0] for c in counts])
    hashed, real = [], hashing.Places.place
    monkeypatch.setattr(hashing, "REMEMBERED", 50)
    monkeypatch.setattr(hashing, "WORDS", 70)  # several runs
    monkeypatch.setattr(hashing.Places, "place", lambda self, feature: hashed.append(feature) or real(self, feature))
    places = hashing.Places()
    together = np.concatenate([hashing._vectors(counts[at : at + 60], places) for at in (0, 60)])
    assert np.array_equal(alone, together)
    assert len(hashed) < 2 * 300 * 12 and sum(w in words for w in hashed) <= 2 * 300
    assert hashing._vectors([], places).shape == (0, hashing.WIDTH) and not hashing.vector("").any()


def test_many_short_queries_put_no_postings_together(spark, monkeypatch):
    """Some words of many queries come to many postings of a passage, fewer than it has tokens; the results are those that the postings give."""
    rng = np.random.default_rng(5)
    words = [f"{a}{b}ul" for a in "bcdfgklmnprt" for b in "aeio"]
    text = lambda n: " ".join(rng.choice(words, size=n))
    index = PostingsIndex(Catalog.fresh(spark, "t"))
    index.add(spark.createDataFrame([(i, text(int(rng.integers(60, 120))), [text(1)]) for i in range(80)], "doc_id bigint, text string, boost_terms array<string>"), fold=False)
    asked = spark.createDataFrame([(q, text(2)) for q in range(36)], "query_id bigint, text string")
    found = index.search(asked, 5)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString() and index.catalog.load("postings") is None
    monkeypatch.setattr(postings, "MANY", 1 << 30)
    same = index.search(asked, 5)
    assert index.catalog.load("postings") is not None
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, same.collect()))


def test_the_cache_of_vectors_is_worked_out_once(spark, monkeypatch):
    """Vectors of the cache are written; what reads it, twice, works none of them out again."""
    made, real = [], hashing.embed
    monkeypatch.setattr(hashing, "embed", lambda *a, **k: made.append(1) or real(*a, **k))
    plan = catalog.queries()["r03_embed_missing"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 2 and plan.count("MapInArrow") == 1


def test_boosted_search_folds_no_postings(spark, monkeypatch):
    staged, real = [], Catalog._stage
    monkeypatch.setattr(Catalog, "_stage", lambda self, table, rows, by: staged.append(table) or real(self, table, rows, by))
    assert catalog.queries()["r05_boosted_search"](spark, SF).count() > 0
    assert sorted(staged) == ["forward", "frequencies", "passages", "sizes"]
