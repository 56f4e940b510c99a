"""From raw documents to the token ids of a training mix, in five stages.

Each stage gets what the one before kept, and its decisions take effect: rejected documents and copies
go, secrets are replaced in the text, the mix is drawn, and what is left is encoded. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.op02_sentencepiece import encode_stage
from quarry.llm.op03_bagminhash import keep_one
from quarry.llm.op04_crf_quality import keep_good
from quarry.llm.op07_mixing import draw
from quarry.llm.op10_secrets import redact_secrets
from quarry.llm.shared import Stash, table

STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_one),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", draw),
    ("SentencePiece encoding and decoding", encode_stage),
]

#: A fitted field and sampled signatures have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``; each stage is written before the next one reads it."""
    stash = Stash(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stash.keep(stage(spark, docs, sf_dir), f"stage-{place}")
        if place:
            stash.drop(f"stage-{place - 1}")
    return docs
