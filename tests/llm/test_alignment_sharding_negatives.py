"""Alignment, sharding and hard negatives: brute force, odd rows, hot groups and recoveries of the law."""

import collections
import hashlib
import zlib
from pathlib import Path

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F
from quarry.llm import op11_alignment as al
from quarry.llm import op12_sharding as sh
from quarry.llm import op13_negatives as hn
from quarry.llm import queries as llm
from quarry.llm.shared import Stash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, block string, uid string, label string, size string, slot string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
SOLID = "".join(chr(97 + i * i % 26) for i in range(40_000))
#: Blanks, line breaks and what looks like them, in all places; marks, special tokens, bytes without pieces.
ODD = [
    None, "", " ", "   \n\t", "\n", "one", " lead", "trail ", "two  blanks   three", "a\nb\n\nc \n d\n", "same text here", "same text here", LONG, LONG + " tail", SOLID,
    "é été à demain naïve", "no break　wide em line x", "  x\u0085 y  z", "日本語 の テキスト", "😀 smile 😀\x00 zero", "mark ▁ here", "▁", "<|endoftext|> <s> </s> <unk>",
    "don't we'll  it's 'S", "a,b;c|d 12345 67,8", "tab\tx \t y", "\r\nwindows\r\n lines", "x" * 3000, "\x1c \x1f a\x7f b",
]


def odd_docs(spark):
    rows = [(i, t, "b", "u", "l", "s", "x") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[10], (10, "other text of one id", "", "", "", "", ""), (None, "no id at all", "b", "u", "l", "s", "x"), (None, None, "", "", "", "", "")], DOCS)


def plain_alignment(texts, tokenizers):
    """Numbers and groups of each text, by a walk over both token lists."""
    found, holders = [], collections.Counter()
    for text in texts:
        found.append(([], [], [], []))
        if not text:
            continue
        sides = [[tokens[i] for i in ids] for ids, tokens in zip(tokenizers.ids(" " + text), (tokenizers.a, tokenizers.b), strict=True)]
        if any(b"".join(s) != (" " + text).encode() for s in sides):
            continue
        a, b = tokenizers.ids(" " + text)
        spans = []
        for ids, pieces in zip((a, b), sides, strict=True):
            ends = np.cumsum([len(p) for p in pieces])
            spans.append([(int(e) - len(p), int(e), i) for e, p, i in zip(ends, pieces, ids, strict=True)])
        shared = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, at = [], [0, 0]
        links = []
        for end in shared:
            part = []
            for side in (0, 1):
                lo = at[side]
                while at[side] < len(spans[side]) and spans[side][at[side]][1] <= end:
                    at[side] += 1
                part.append(spans[side][lo : at[side]])
            groups.append(part)
            links += [(x[2], y[2]) for x in part[0] for y in part[1] if x[0] < y[1] and y[0] < x[1]]
        found[-1] = (a, b, groups, links)
        holders.update(set(links))
    most = collections.Counter()
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    out = []
    for a, b, groups, links in found:
        digest = ";".join("|".join(",".join(str(t[2]) for t in side) for side in g) for g in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(holders[p] == most[p[0]] for p in links), sum(holders[p] for p in links), hashlib.sha256(digest.encode()).hexdigest() if digest else ""))
    return out


@pytest.fixture(scope="module")
def tokenizers():
    return al.Tokenizers()


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def aligned_rows(docs):
    return [(r.doc_id, *(r[c] for c in NUMBERS), hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in al.align_documents(docs).collect()]


def test_op11_equals_brute_force(spark, tokenizers):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, plain_alignment([r.text for r in rows], tokenizers), strict=True)]
    got = llm.QUERIES["op11_token_alignment"](spark, SF)
    assert got.columns == ["doc_id", *NUMBERS, "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("block", [1 << 24, 200])
def test_op11_odd_rows(spark, tokenizers, monkeypatch, block):
    """Also with blocks of a few texts: the result is the same for any blocks."""
    monkeypatch.setattr(al, "BLOCK", block)
    monkeypatch.setattr(al, "CHUNKS", 16)
    docs = odd_docs(spark).coalesce(2)
    rows = docs.select("doc_id", "text").collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, plain_alignment([r.text for r in rows], tokenizers), strict=True)]
    assert sorted(aligned_rows(docs), key=repr) == sorted(want, key=repr)


def test_op11_shuffled_pair_counts(spark, monkeypatch):
    """Beyond the size to which counts are sent, they are joined by shuffle, with the same result."""
    docs = odd_docs(spark)
    want = sorted(aligned_rows(docs), key=repr)
    monkeypatch.setattr(al, "SENT_PAIRS", 0)
    assert sorted(aligned_rows(docs), key=repr) == want


def test_op11_other_tokenizers_are_refused(tmp_path):
    word = al.BYTE_BPE.replace("byte_bpe_50k", "word_bpe_49k")
    with pytest.raises(ValueError, match="byte-level"):
        al.Tokenizers(word)


def test_op11_links_stay_in_proportion_where_no_end_is_shared(spark):
    """Tokens of 3 and of 7 bytes share every 21st end; of 3 and 4999, almost none, in one group of 5,000 tokens."""
    n = 4999 * 3
    for width in (7, 4999):
        rows = [(0, "x", True, list(range(n // 3)), [3] * (n // 3), list(range(n // width)), [width] * (n // width))]
        tokens = spark.createDataFrame(rows, "uid bigint, stretch string, ok boolean, a array<int>, an array<int>, b array<int>, bn array<int>")
        if n % width:
            continue
        got = al.align(tokens, Stash(spark, "t"), f"aligned-{width}").collect()[0]
        ends_a, ends_b = set(range(3, n + 1, 3)), set(range(width, n + 1, width))
        assert got.n_groups == len(ends_a & ends_b) and len(got.links) == len(ends_a | ends_b)


def test_op11_leaves_little_on_disk(spark, tokenizers, monkeypatch):
    """Between steps only what is written is there: no shuffle files, and no kept rows, of the steps before."""
    texts = [" ".join(f"{(i * 7919 + j * 104_729) % 1_000_003:x}" for j in range(200)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    local = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    held = lambda: sum(f.stat().st_size for f in local.rglob("*") if f.is_file() and f.name.startswith(("shuffle_", "rdd_")))
    before, left, drop = held(), [], Stash.drop

    def dropped(stash, *names):
        left.append(held() - before)
        drop(stash, *names)

    monkeypatch.setattr(Stash, "drop", dropped)
    want = plain_alignment(texts, tokenizers)
    assert sorted(aligned_rows(docs)) == [(i, *x) for i, x in enumerate(want)]
    assert len(left) == 1 and left[0] <= 0


def test_op11_empty(spark):
    assert al.align_documents(spark.createDataFrame([], DOCS)).count() == 0


# Sharding


def test_op12_sql(spark):
    assert oracle.difference(spark, SF, llm.QUERIES["op12_virtual_slots"], llm.ORACLES["op12_virtual_slots"]) == ""


def test_op12_law_and_places(spark):
    rows = llm.QUERIES["op12_virtual_slots"](spark, "/root/testdata/sf0.01").collect()
    sizes, places = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert set(sizes) == set(range(16)) and max(sizes.values()) <= 1.001 * min(sizes.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_op12_odd_rows(spark):
    docs = odd_docs(spark)
    got = sh.shard_documents(docs, slots=64, shards=4).collect()
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for shard in {r.shard for r in got}:
        places = sorted(r.slot for r in got if r.shard == shard)
        assert places == list(range(len(places)))
    assert sh.shard_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_op12_hot_groups_are_dealt_out(spark):
    """A third of the rows are copies, a third have no id: neither is in one slot, and sizes stay equal."""
    rows = [(i, "copy " * 20 if i % 3 == 0 else f"text {i} " * (1 + i % 30)) for i in range(6000)]
    rows = [(None if i % 3 == 1 else i, t) for i, t in rows]
    out = sh.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
    sizes = [r.b for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(sizes) <= 1.001 * min(sizes)
    assert out.groupBy("virtual_slot").count().agg(F.max("count")).head()[0] < 20


def test_op12_versions_of_the_map(spark):
    """Rebalancing moves no more than it must; a new shard takes slots only into itself; old versions stay readable."""
    stash = Stash(spark, "map-test")
    rows = stash.keep(sh.records(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")), "records")
    m = sh.SlotMap(stash)
    m.start(sh.weights(rows))
    m.rebalance()
    m.grow(16)
    maps = [{r.virtual_slot: (r.shard, r.bytes) for r in m.at(v).collect()} for v in range(3)]
    assert all(len(x) == sh.SLOTS for x in maps)
    loads = []
    for x in maps:
        load = collections.Counter()
        for shard, size in x.values():
            load[shard] += size
        loads.append(load)
    share = sum(loads[0].values()) / 16
    moved = sum(size for v, (shard, size) in maps[0].items() if maps[1][v][0] != shard)
    largest = max(size for _, size in maps[0].values())
    assert moved <= sum(max(0, b - share + largest) for b in loads[0].values())
    assert {maps[2][v][0] for v in maps[2] if maps[2][v][0] != maps[1][v][0]} == {16}
    assert max(loads[2].values()) <= 1.03 * sum(loads[2].values()) / 17  # about 60 documents a shard


# Hard negatives

VECTORS = "vec_id bigint, embedding array<float>, label int, row bigint, cluster string"


def plain_negatives(rows):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) by sorting everything."""
    fine = []
    for vec_id, v, label, *_ in rows:
        if vec_id is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            fine.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    out = []
    for i, (anchor, label, q) in enumerate(fine):
        if anchor % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v, strict=False)), vec_id, other) for j, (vec_id, other, v) in enumerate(fine) if j != i]
        scored.sort()
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            band = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(anchor, positive, r, s[1], -p, -s[0]) for r, s in enumerate(band, 1)]
    return sorted(out)


def negatives(df):
    return sorted(map(tuple, hn.hard_negatives(df).collect()))


def test_op13_sql(spark):
    assert oracle.difference(spark, SF, llm.QUERIES["op13_pivot_negatives"], llm.ORACLES["op13_pivot_negatives"]) == ""


def test_op13_odd_rows(spark):
    rng = np.random.default_rng(5)
    bad = [(None, [0.1, 0.2], 1), (100, None, 1), (101, [0.1, None], 1), (102, [float("nan"), 0.1], 1), (103, [float("inf"), 0.1], 2), (104, [0.5, 0.5], None), (200, [], 3), (300, [0.0, 0.0, 0.0], 3), (400, [0.5], 3)]
    good = [(int(i), rng.normal(size=3).round(2).tolist(), int(i % 4)) for i in range(0, 500, 5)]
    rows = [(*r, 0, "c") for r in [*bad, *good, good[3], good[20], (100, [0.4, 0.4, 0.4], 1), (100, [0.4, 0.4, 0.4], 1)]]
    assert negatives(spark.createDataFrame(rows, VECTORS)) == plain_negatives(rows)
    assert hn.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(100, [], 1, 0, "c")], VECTORS)).count() == 0


@pytest.mark.parametrize("limits", [(1 << 16, 4096), (40, 3)])
def test_op13_clusters_and_ties(spark, monkeypatch, limits):
    """Tight clusters, where brackets leave few rows, and a third of all rows one vector; with small groups too."""
    monkeypatch.setattr(hn, "ROWS", limits[0])
    monkeypatch.setattr(hn, "ANCHORS", limits[1])
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(900):
        v = centres[0] if i % 3 == 0 else centres[i % 6] + 0.05 * rng.normal(size=8)
        rows.append((i, v.round(3).tolist(), int(rng.integers(10)), 0, "c"))
    assert negatives(spark.createDataFrame(rows, VECTORS).repartition(5)) == plain_negatives(rows)


def test_op13_brackets_prune(spark):
    """Far clusters: most rows never meet an anchor in an exact product."""
    rng = np.random.default_rng(2)
    far = np.concatenate([c + 0.01 * rng.normal(size=(400, 8)) for c in 5 * np.eye(8)])
    order = far.argsort(0, kind="stable").T
    kept = hn.survivors(far, order, np.take_along_axis(far.T, order, 1), far[0], 0.2)
    assert kept is not None and 0 < len(kept) <= 400
    assert set(kept.tolist()) == set(np.flatnonzero((np.abs(far - far[0]) <= 0.2).all(1)).tolist())


def test_op13_long_components(spark):
    """Products beyond what doubles hold are exact all the same."""
    rows = [(i, [float(2.0 ** (17 + i % 5)) + i, float(3 * i), float(i % 5)], i % 3, 0, "c") for i in range(0, 400, 20)]
    assert negatives(spark.createDataFrame(rows, VECTORS)) == plain_negatives(rows)
