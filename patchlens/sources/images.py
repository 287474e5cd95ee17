"""Image tables: image_id, split, label, height, width, channels, pixels (array<double>, row by row, channels fastest)."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LUMA = (0.2989, 0.587, 0.114)
#: Image files that are numbered in one task.
BUCKET = 10_000


@dataclass(frozen=True)
class Shape:
    height: int
    width: int
    channels: int


SHAPES = {"mnist": Shape(28, 28, 1), "cifar10": Shape(32, 32, 3), "fixture": Shape(8, 8, 1)}


def shape_of(dataset: str, grayscale_only: bool = False) -> Shape:
    if dataset not in SHAPES:
        raise NotImplementedError(dataset)
    s = SHAPES[dataset]
    return Shape(s.height, s.width, 1) if grayscale_only else s


def read_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 64 numbers as images of 8 x 8; every fifth is a test image."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    split = F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train")
    return rows.where(F.size("embedding") == 64).select(F.col("vec_id").alias("image_id"), split.alias("split"), "label", F.col("embedding").cast("array<double>").alias("pixels"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A table with the columns image_id, split, label, pixels."""
    return spark.read.parquet(path).select(F.col("image_id").cast("long"), "split", F.col("label").cast("int"), F.col("pixels").cast("array<double>"))


def read_files(spark: SparkSession, path: str, label: str = r"/(\d+)/[^/]*$", split: str = "train") -> DataFrame:
    """Image files that Spark's reader decodes (blue, green, red), scaled to [0, 1]; label is a group of the path's pattern.

    Ids are dense: files are dealt to buckets by a hash of their path, and numbered by path within them, behind the buckets before.
    """
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    byte = F.transform(F.sequence(F.lit(1), F.length("data")), lambda i: F.conv(F.hex(F.substring(F.col("data"), i, F.lit(1))), 16, 10).cast("double") / 255)
    n = F.col("nChannels")
    order = F.transform(F.sequence(F.lit(0), F.length("data") - 1), lambda k: F.element_at("bytes", (k - k % n + F.when(n == 3, 2 - k % n).otherwise(k % n) + 1).cast("int")))
    rows = raw.withColumn("bytes", byte).withColumn("pixels", order)
    names = raw.select("origin")
    n = max(1, names.count() // BUCKET)
    bucket = F.pmod(F.xxhash64("origin"), F.lit(n)).cast("int")
    sizes = sorted((r["bucket"], r["count"]) for r in names.groupBy(bucket.alias("bucket")).count().collect())
    before = F.element_at(F.create_map(*[F.lit(x) for (b, _), s in zip(sizes, accumulate([0] + [c for _, c in sizes])) for x in (b, s)]), F.col("bucket")) if sizes else F.lit(0)
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("origin"))
    numbered = rows.withColumn("bucket", bucket).withColumn("image_id", (before + place - 1).cast("long"))
    return numbered.select("image_id", F.lit(split).alias("split"), F.regexp_extract("origin", label, 1).cast("int").alias("label"), "pixels")


def grayscale(images: DataFrame, weights: tuple[float, float, float] = LUMA) -> DataFrame:
    """Three channels to one."""
    return images.withColumn("pixels", _grey("pixels", weights))


def _grey(pixels: str, weights: tuple[float, float, float] = LUMA) -> Column:
    at = lambda k, c: F.element_at(pixels, (k * 3 + c + 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), (F.size(pixels) / 3).cast("int") - 1), lambda k: at(k, 0) * weights[0] + at(k, 1) * weights[1] + at(k, 2) * weights[2])


def take_first(images: DataFrame, split: str, n: int) -> DataFrame:
    """Images of a split with ids below the n-th: a filter, so it is pushed down."""
    return images.where((F.col("split") == split) & (F.col("image_id") < n))


def as_configured(images: DataFrame, dataset: str, grayscale_only: bool) -> DataFrame:
    """Images in the shape that the parameters name: three channels become one on request (grey ones stay as they are)."""
    s = SHAPES[dataset]
    if not grayscale_only or s.channels == 1:
        return images
    whole = F.size("pixels") == s.height * s.width * s.channels
    return images.withColumn("pixels", F.when(whole, _grey("pixels")).otherwise(F.col("pixels")))


def first_samples(images: DataFrame, n: int) -> DataFrame:
    """The n images with the smallest ids (all, if there are fewer)."""
    if images.limit(n + 1).count() <= n:
        return images
    last = images.select("image_id").orderBy("image_id").limit(n).agg(F.max("image_id")).first()[0]
    return images.where(F.col("image_id") <= last)


def augment(images: DataFrame, shape: Shape) -> DataFrame:
    """Every image (even id) and its mirror image (odd id), in one pass."""
    w, c = shape.width, shape.channels
    mirrored = F.transform(F.sequence(F.lit(0), F.size("pixels") - 1), lambda k: F.element_at("pixels", (F.floor(k / (w * c)) * (w * c) + (w - 1 - F.floor(k / c) % w) * c + k % c + 1).cast("int")))
    both = images.withColumn("flip", F.explode(F.array(F.lit(0), F.lit(1))))
    return both.withColumns({"pixels": F.when(F.col("flip") == 1, mirrored).otherwise(F.col("pixels")), "image_id": F.col("image_id") * 2 + F.col("flip")})


def write_matrix(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Stages hand on as Parquet; an existing table isn't replaced unless told."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def append_matrix(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
