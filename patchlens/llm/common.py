"""Helpers that several operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(id_col: str = "doc_id") -> Column:
    """Rows of the fold that no model may learn from: crc32 of the id as text, modulo 5, is 0. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Without one, a temporary folder in local mode, else an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there: what follows survives lost executors.

    Shuffle files of earlier steps go when the driver's garbage is collected, which it seldom is by itself: so it is here.
    """
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    df.sparkSession._jvm.System.gc()
    return out


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store Spark reaches it."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def by_place(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1 and so on, and the new name of each old one: whatever they are called does no harm then."""
    at = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), at


def with_steps(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Adds columns that the optimiser doesn't merge into what uses them, so that each is worked out once and code stays short."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))
