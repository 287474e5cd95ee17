"""Applying a fitted model to a stream: codes and patch embeddings are row by row, so they need no state or watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Model

SCHEMA = "image_id long, split string, label int, pixels array<double>"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image tables as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def embed_patches(model: Model, images: DataFrame, test: bool = True) -> DataFrame:
    """Patch embeddings of streamed images. Centring works within an image's row only with full context."""
    if model.config.context_sz < model.grid - 1:
        raise ValueError("a smaller radius takes window sums, which streams don't have")
    return model.patch_embedding(images, test)


def write_image_vectors(model: Model, images: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Image vectors, pooled within each micro-batch (an image arrives whole), appended as Parquet."""

    def sink(batch: DataFrame, _: int) -> None:
        model.transform(batch, test=True).write.mode("append").parquet(path)

    return images.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
