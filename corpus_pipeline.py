"""A corpus from documents to tokens, stage by stage.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; it is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents, whatever others there are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm import bpe, line_dedup, minhash, mixing, quality
from patchlens.llm.common import by_place, checkpoint_dir, is_held_out, remove_folder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules score at the threshold or above; learnt from the labels that aren't held out."""
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~is_held_out()))
    return quality.keep_good(docs, model)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines; n_chars follows where it is a column."""
    rows, at = by_place(docs)
    cut = line_dedup.drop_boilerplate(rows, at["source"], at["text"])
    if "n_chars" in at:
        shorter = F.length(at["text"]).cast(rows.schema[at["n_chars"]].dataType)
        cut = cut.withColumn(at["n_chars"], F.when(F.col("lines_dropped") > 0, shorter).otherwise(F.col(at["n_chars"])))
    return cut.select(*[F.col(v).alias(c) for c, v in at.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of them and of what they decode to."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", drop_boilerplate_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: The classifier's trees, near-duplicates' hashes and the tokenizer are beyond SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared checkpoint folder, where only the last one's rows stay."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
    return docs
