"""Points of extension: embeddings, vector tables, rerankers, language models, and tools as SQL functions.

Each is a small class with an implementation that needs nothing but this library. One that needs a package
or a service is only tried where it is asked for, and falls back to the local one.
"""

from __future__ import annotations

import abc
import importlib.util
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import structure
from quarry.functions import text as tx
from quarry.operators import answering, bm25, hashing, vectors


class Embeddings(abc.ABC):
    """Adds vectors to rows of texts."""

    name = "?"

    @abc.abstractmethod
    def embed(self, docs: DataFrame, key: str) -> DataFrame:
        """(key, embedding) of rows (key, text)."""


class HashingEmbeddings(Embeddings):
    name = "hashing"

    def __init__(self, width: int = hashing.WIDTH):
        self.width = width

    def embed(self, docs: DataFrame, key: str) -> DataFrame:
        return hashing.embed(docs, key, self.width)


class ModelEmbeddings(Embeddings):
    """By a sentence-transformers model, read once in each worker; vectors have unit length."""

    name = "model"

    def __init__(self, model: str):
        self.model = model

    @staticmethod
    def available() -> bool:
        return importlib.util.find_spec("sentence_transformers") is not None

    def embed(self, docs: DataFrame, key: str) -> DataFrame:
        model = self.model

        def run(frames):
            from sentence_transformers import SentenceTransformer

            encoder = SentenceTransformer(model)
            for frame in frames:
                frame["embedding"] = list(encoder.encode(frame["text"].fillna("").tolist(), normalize_embeddings=True))
                yield frame[[key, "embedding"]]

        return docs.select(key, "text").mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, embedding array<float>")


def embeddings(model: str | None = None) -> Embeddings:
    return ModelEmbeddings(model) if model and ModelEmbeddings.available() else HashingEmbeddings()


class VectorTable(abc.ABC):
    """A collection of vectors with labels."""

    @abc.abstractmethod
    def rows(self) -> DataFrame:
        """(vec_id, label, embedding)"""

    @abc.abstractmethod
    def upsert(self, rows: DataFrame) -> None: ...

    @abc.abstractmethod
    def remove(self, condition: Column) -> int: ...

    def query(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        """(query_id, vec_id, label, similarity, rank) of the k nearest rows of each query (query_id, embedding)."""
        rows = self.rows() if where is None else self.rows().filter(where)
        return bm25.best(vectors.nearest(rows, queries, k), k, "similarity", "vec_id")


class StoredVectors(VectorTable):
    """In a table of a ``sources.store.Store``."""

    def __init__(self, store, name: str = "vectors"):
        self.store, self.name = store, name

    def rows(self) -> DataFrame:
        found = self.store.load(self.name)
        return self.store.spark.createDataFrame([], "vec_id bigint, label bigint, embedding array<float>") if found is None else found

    def upsert(self, rows: DataFrame) -> None:
        self.store.upsert(self.name, rows, "vec_id")

    def remove(self, condition: Column) -> int:
        return self.store.remove(self.name, condition)


class FrameVectors(VectorTable):
    """Over a frame that is there already; changes make a new plan, and nothing is written."""

    def __init__(self, rows: DataFrame):
        self._rows = rows

    def rows(self) -> DataFrame:
        return self._rows

    def upsert(self, rows: DataFrame) -> None:
        self._rows = self._rows.join(rows.select("vec_id"), "vec_id", "left_anti").unionByName(rows.dropDuplicates(["vec_id"]))

    def remove(self, condition: Column) -> int:
        gone = self._rows.filter(condition).count()
        self._rows = self._rows.filter(~F.coalesce(condition, F.lit(False)))
        return gone


class Reranker(abc.ABC):
    """Orders candidates (query_id, question, doc_id, text, score) anew."""

    name = "?"

    @abc.abstractmethod
    def score(self, pool: DataFrame) -> DataFrame:
        """``pool`` with ``rerank``."""

    def rerank(self, pool: DataFrame, k: int) -> DataFrame:
        return bm25.best(self.score(pool), k, "rerank")


class LocalReranker(Reranker):
    """By the share of a question's tokens that a passage has, and its first score."""

    name = "local"

    def score(self, pool: DataFrame) -> DataFrame:
        words = F.struct(F.array_distinct(tx.tokens(F.col("question"))).alias("q"), tx.distinct_tokens(F.col("text")).alias("t"))
        share = tx.let(words, lambda v: F.size(F.array_intersect(v["q"], v["t"])) / F.greatest(F.size(v["q"]), F.lit(1)))
        return pool.withColumn("rerank", F.round(0.8 * share + 0.2 * F.least("score", F.lit(1.0)), 6))


class CrossEncoderReranker(Reranker):
    """By a sentence-transformers cross encoder, squashed to 0..1; the local one where the package is missing."""

    name = "cross_encoder"

    def __init__(self, model: str):
        self.model = model

    def score(self, pool: DataFrame) -> DataFrame:
        if not ModelEmbeddings.available():
            return LocalReranker().score(pool)
        model = self.model

        def run(frames):
            import numpy as np
            from sentence_transformers import CrossEncoder

            encoder = CrossEncoder(model)
            for frame in frames:
                raw = encoder.predict(list(zip(frame["question"], frame["text"], strict=True)))
                frame["rerank"] = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
                yield frame

        return pool.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in [*pool.dtypes, ("rerank", "double")]))


class ModelReranker(Reranker):
    """A blend of scores that a model gave (query_id, doc_id, given) with the first ones; those it did not give stay."""

    name = "model"
    GIVEN = 0.65

    def __init__(self, given: DataFrame):
        self.given = given

    def score(self, pool: DataFrame) -> DataFrame:
        blend = self.GIVEN * F.col("given") + (1 - self.GIVEN) * F.col("score")
        return pool.join(self.given, ["query_id", "doc_id"], "left").withColumn("rerank", F.coalesce(blend, F.col("score"))).drop("given")


def reranker(strategy: str = "local", *, model: str | None = None, given: DataFrame | None = None) -> Reranker:
    """By name; one whose means are missing gives way to the local one."""
    if strategy == "cross_encoder" and model:
        return CrossEncoderReranker(model)
    if strategy == "model" and given is not None:
        return ModelReranker(given)
    return LocalReranker()


class LanguageModel(abc.ABC):
    """Completes a prompt."""

    name = "?"

    @abc.abstractmethod
    def complete(self, prompt: str) -> str: ...

    def complete_json(self, prompt: str, retries: int = 2, wait: Callable[[int, BaseException | None], float] = lambda n, e: backoff(n), sleep=time.sleep):
        """The JSON within a completion; asked again, with a wait, where there is none or the call fails."""
        failure: BaseException | None = None
        for turn in range(retries + 1):
            if turn:
                sleep(wait(turn - 1, failure))
            try:
                found = structure.json_within(self.complete(prompt))
                failure = None
            except (ConnectionError, TimeoutError, OSError) as e:
                found, failure = None, e
            if found is not None:
                return found
        if failure is not None:
            raise failure
        return None


def backoff(turn: int, told: float | None = None) -> float:
    """Seconds before another try: what the server said, within bounds, or doubling ones."""
    return min(max(told, 0.5), 45.0) if told is not None else min(2.0 * 2**turn, 20.0)


class OfflineModel(LanguageModel):
    """Answers from the prompt's own context: the sentences that share most words with its question."""

    name = "offline"

    def complete(self, prompt: str) -> str:
        from quarry.operators import chunks

        context, question = prompt.rsplit("QUESTION:", 1) if "QUESTION:" in prompt else (prompt, prompt)
        words = {w for w in question.lower().split() if len(w) > 3}
        lines = list(enumerate(chunks.sentences(context)))
        best = sorted(lines, key=lambda x: (-sum(w in x[1].lower() for w in words), x[0]))[:5]
        return "\n".join(f"- {s}" for _, s in sorted(best)) or "I could not find this information in the material you have provided."


MODELS: dict[str, Callable[[], LanguageModel]] = {"offline": OfflineModel}


def register_model(name: str, make: Callable[[], LanguageModel]) -> None:
    MODELS[name] = make


def language_model(name: str = "offline") -> LanguageModel:
    """By name; an unknown one is the offline model."""
    return MODELS.get(name, OfflineModel)()


def register_tools(spark: SparkSession, docs: DataFrame) -> list[str]:
    """Tools that SQL can call: views over ``docs`` (doc_id, text, source) and functions with typed arguments.

    ``notes`` are the documents, ``note_terms`` their postings; ``clip(text, n)`` cuts a text.
    """
    docs.createOrReplaceTempView("notes")
    bm25.postings(docs).createOrReplaceTempView("note_terms")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION clip(body STRING COMMENT 'a text', n INT COMMENT 'characters') RETURNS STRING RETURN CASE WHEN length(body) <= n THEN body ELSE concat(left(body, n), '…') END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION search_notes(word STRING COMMENT 'a term', k INT COMMENT 'at most so many') RETURNS TABLE (doc_id BIGINT, tf BIGINT) RETURN SELECT doc_id, tf FROM (SELECT doc_id, tf, row_number() OVER (ORDER BY tf DESC, doc_id) AS place FROM note_terms WHERE term = lower(word)) WHERE place <= k")
    return ["notes", "note_terms", "clip", "search_notes"]


def refuses(confidence: float) -> bool:
    return confidence < answering.FLOOR
