"""A training corpus from raw documents, in stages that each call one operator of ``risewatch.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. ``run`` writes each stage's
result as Parquet into the shared folder and reads it back as the next stage's input. Extra columns pass through
(the last stage keeps doc_id, lang and source, which it asks for); null texts count as empty; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risewatch.llm import byte_bpe, line_runs, prob_minhash, spaced_seeds, toxicity
from risewatch.llm.common import stored, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated trees do not call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, "text", model)
    return scored.where(F.col(scored.columns[-1]) == 0).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated line runs; ``n_chars`` follows the text."""
    done = line_runs.dedup_lines(docs, "doc_id", "text")
    changed = F.col(done.columns[-1]) > 0
    return done.select(*(F.when(changed, F.length("text").cast("bigint")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of the least id."""
    return prob_minhash.keep_first(docs, "doc_id", "text").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    marked = spaced_seeds.mark(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return marked.where(F.size(F.col(marked.columns[-1])) == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    body = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    both = byte_bpe.encode_and_decode(body, "text", path, public_tokenizers.PATTERN)
    return both.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text").cast("binary")).alias("round_trip"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Trained trees and banded signatures are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
