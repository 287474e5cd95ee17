"""Sparse matrices as tables (row, col, v): row pointers, slices, products. Blocks are keys; shuffles place them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_pointers(matrix: DataFrame, n_rows: int) -> DataFrame:
    """(row, start, nnz) of all rows, empty ones too: counts, then a running sum over rows (not over elements). One task adds up n_rows^(1/3) totals."""
    counts = matrix.groupBy("row").agg(F.count("*").alias("nnz"))
    every = matrix.sparkSession.range(n_rows).select(F.col("id").alias("row")).join(counts, "row", "left").select("row", F.coalesce("nnz", F.lit(0)).cast("long").alias("nnz"))
    # blocks of blocks, so that no task has more than about the cube root of the rows: sums within, then before
    side = max(64, round(n_rows ** (1 / 3)) + 1)
    block = every.withColumn("b", F.floor(F.col("row") / side)).withColumn("s", F.sum("nnz").over(Window.partitionBy("b").orderBy("row")) - F.col("nnz"))
    totals = block.groupBy("b").agg(F.sum("nnz").alias("t")).withColumn("bb", F.floor(F.col("b") / side))
    inner = totals.withColumn("p", F.sum("t").over(Window.partitionBy("bb").orderBy("b")) - F.col("t"))
    outer = totals.groupBy("bb").agg(F.sum("t").alias("tt"))
    outer = outer.select("bb", (F.sum("tt").over(Window.orderBy("bb")) - F.col("tt")).alias("pp"))
    before = inner.join(outer, "bb").select("b", (F.col("p") + F.col("pp")).alias("base"))
    return block.join(before, "b").select("row", (F.col("base") + F.col("s")).alias("start"), "nnz")


def row_slice(matrix: DataFrame, start: int, end: int) -> DataFrame:
    """Rows from start to before end, numbered from 0."""
    return matrix.where((F.col("row") >= start) & (F.col("row") < end)).withColumn("row", F.col("row") - start)


def column_slices(matrix: DataFrame, chunk: int, transpose: bool = False) -> DataFrame:
    """(block, row, col, v): columns in blocks of chunk, numbered within; transposed on request."""
    cut = matrix.select(F.floor(F.col("col") / chunk).alias("block"), "row", (F.col("col") % chunk).alias("col"), "v")
    return cut.select("block", F.col("col").alias("row"), F.col("row").alias("col"), "v") if transpose else cut


def stack_columns(matrices: DataFrame, widths: int) -> DataFrame:
    """(b, row, col, v) side by side: each matrix b is widths columns wide."""
    return matrices.select("row", (F.col("b") * widths + F.col("col")).alias("col"), "v")


def multiply(a: DataFrame, b: DataFrame, upper: bool = False) -> DataFrame:
    """a b; upper keeps the part with row <= col, before products are summed."""
    right = b.select(F.col("row").alias("col"), F.col("col").alias("out"), F.col("v").alias("w"))
    both = a.join(right, "col").select("row", F.col("out").alias("col"), (F.col("v") * F.col("w")).alias("v"))
    if upper:
        both = both.where("row <= col")
    return both.groupBy("row", "col").agg(F.sum("v").alias("v"))


def multiply_dense(a: DataFrame, b: DataFrame) -> DataFrame:
    """a (row, vec) times sparse b (row, col, v): (row, col, v), dense elements meet sparse ones by position."""
    both = a.select("row", F.posexplode("vec").alias("k", "x"))
    right = b.select(F.col("row").alias("k"), "col", "v")
    return both.join(right, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("v")).alias("v"))
