"""From raw documents to piece ids: five stages, each a Parquet table that the next one reads.

All stages take null and empty texts as texts without words, very long ones whole, and tables without rows; columns beside
doc_id and text pass through under their names, whatever those are. Rows stand alone unless a stage says otherwise.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstream.llm import decontamination, near_duplicates, personal, quality, segmentation
from turnstream.llm.store import materialise


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.7, by a model of this very table and its labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    score = "score" + "_" * max(map(len, docs.columns))  # no column's name
    return quality.scored(docs, model, docs.columns, score_col=score).filter(F.col(score) >= quality.CUT).drop(score)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, a similarity of 0.8 or more): the smallest doc_id.

    Of rows with the same id and text one stays; of different texts with that id the one with the smallest text hash.
    Documents without words are like no other and all stay.
    """
    return near_duplicates.keep_one(docs, percent=80)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark. Null and empty items match nothing; copies go or stay together."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [kind] in place of each piece of personal data, and their new lengths."""
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    found = personal.find_personal_data(rows).select("document", personal.redact(F.col("text"), F.col("pii_spans")).alias("redacted"))
    changed = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("redacted").cast(docs.schema["n_chars"].dataType)
    return found.select(*[changed.get(c, F.col("document")[c]).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, the scores of its four best segmentations, whether all four decode to it, and the text decoded from the ids."""
    encoded = segmentation.encode_best(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])
    return encoded.select("doc_id", "ids", "n_ids", "best_scores", "round_trip", "decoded")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_unleaked),
    ("personal_data", redact_personal),
    ("sentencepiece", encode),
]

#: SQL can express neither the classifier nor the segmentation; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
