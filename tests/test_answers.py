"""Operators without SQL, against plain versions of the same rules."""

import hashlib
import math
import re

from quarry.functions import text as tx
from quarry.operators import hashing, passages
from pyspark.sql import functions as F


def packed(sentences, target, overlap):
    out, now = [], []
    length = 0
    for s in sentences:
        if now and length + len(s) > target:
            out.append(" ".join(now))
            kept, n = [], 0
            for p in now[::-1]:
                if n + len(p) > overlap:
                    break
                kept, n = [p, *kept], n + len(p) + 1
            now, length = kept, n
        now.append(s)
        length += len(s) + 1
    return [*out, " ".join(now)] if now else out


def test_pack(spark):
    cases = [[], ["a" * 50], ["b" * 10, "c" * 300, "d" * 12, "e" * 7, "f" * 9], [chr(97 + i % 26) * (1 + i * 7 % 23) for i in range(60)], ["same"] * 20]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<string>")
    for row in df.select("i", passages.pack(F.col("s"), 60, 25).alias("p")).collect():
        assert row.p == packed(cases[row.i], 60, 25)


def test_compress(spark):
    whole = ["One about heat.", "Two about cold."]
    long = [f"Sentence {i} says nothing." for i in range(9)] + ["Here entropy and heat rise together.", "Entropy again."]
    df = spark.createDataFrame([(0, whole), (1, long)], "i int, s array<string>")
    got = {r.i: r.p for r in df.select("i", passages.compress(F.col("s"), F.array(F.lit("entropy"), F.lit("heat"))).alias("p")).collect()}
    assert got[0] == whole
    assert got[1][-2:] == long[-2:] and got[1] == sorted(got[1], key=long.index) and len(got[1]) <= 6


def embedded(text, keys):
    out, counts = [0.0] * 384, {}

    def put(feature, weight):
        out[int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big") % 384] += weight

    for w in re.findall(tx.WORD_OR_NUMBER, text.lower()):
        counts[w] = counts.get(w, 0) + 1
        for k in (3, 4, 5):
            for i in range(max(1, len(w) + 3 - k)):
                put(f"<{w}>"[i : i + k], 0.35)
    for w, n in counts.items():
        weight = (1 + math.log(n)) * (1.6 if w in keys else 1)
        put(w, weight)
        put(w + "~stem", 0.4 * weight)
    norm = math.sqrt(sum(x * x for x in out))
    return [x / norm for x in out] if norm else out


def test_embed(spark):
    texts = ["Entropy of a closed system never falls; entropy is 3.5 here", "", None, "…"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    keys = {r.doc_id: set(r.k) for r in df.select("doc_id", tx.key_terms(F.lower(F.coalesce("text", F.lit(""))), 8).alias("k")).collect()}
    got = {r.doc_id: r.embedding for r in hashing.embed(df).collect()}
    for i, t in enumerate(texts):
        assert max(abs(a - b) for a, b in zip(got[i], embedded(t or "", keys[i]), strict=True)) < 1e-6
    assert hashing.embed(df.limit(0)).count() == 0
