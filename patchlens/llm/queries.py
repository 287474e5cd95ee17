"""The queries of this package, as the entry file registers them, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, line_dedup, media, minhash, mixing, pii, quality, urlfilter
from .common import is_held_out, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learnt from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~is_held_out()))
    scored = quality.score(docs, model).select("doc_id", is_held_out().alias("held_out"), "score")
    return scored.withColumn("predicted", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the boilerplate of its source."""
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_total", "lines_dropped")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes."""
    return mixing.copies(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's token ids and of what they decode to."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near-duplicates."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a greymap, and what is read back from it."""
    return media.digest_media(media.store_documents(table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learnt from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn_dictionaries(docs, ~is_held_out()))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page's address; edges come from the pages' own redirect and canonical tags."""
    return urlfilter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th one."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: the fixed detectors' and what the field adds."""
    return pii.find_spans(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_line_dedup": op2_line_dedup,
        "op3_mixing": op3_mixing,
        "op4_bpe": op4_bpe,
        "op5_minhash": op5_minhash,
        "op6_media": op6_media,
        "op7_language_id": op7_language_id,
        "op8_url_filter": op8_url_filter,
        "op9_ann": op9_ann,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": line_dedup.SQL,
        "op3_mixing": mixing.SQL,
        "op8_url_filter": urlfilter.sql(),
        "op9_ann": ann.SQL,
    }
