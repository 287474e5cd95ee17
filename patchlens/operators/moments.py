"""Second moments as tables (i, j, v) with i <= j, and as driver matrices once aggregated.

Sums of outer products are taken by blocks: a task adds up dense blocks of ``SIDE`` x ``SIDE`` numbers over all its rows, one
matrix product a batch and block pair, and hands on each block once. Blocks of a pair are added up in the order in which they
come, so neither a pair of elements of a row nor a group of blocks is ever a set of rows in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers a side that may come to the driver (a matrix of doubles of this size is 512 MB).
MAX_SIDE = 8192
#: Numbers a side of a block (512 KB). A task holds the upper half of the blocks: 276 MB for 8192 a side.
SIDE = 256
#: Numbers of a batch's dense matrix.
BATCH_NUMBERS = 1 << 22
BLOCKS = "bi int, bj int, block binary"


class BlockSums:
    """Sums of x' y for matrices x, y of the same rows: the blocks of the upper triangle."""

    def __init__(self):
        self.blocks: dict[tuple[int, int], np.ndarray] = {}

    def add(self, x: np.ndarray, y: np.ndarray | None = None) -> None:
        y = x if y is None else y
        parts = range(0, x.shape[1], SIDE)
        left, right = [x[:, a : a + SIDE].any() for a in parts], [y[:, a : a + SIDE].any() for a in parts]
        for a in parts:
            for b in parts[a // SIDE :]:
                if left[a // SIDE] and right[b // SIDE]:
                    product = x[:, a : a + SIDE].T @ y[:, b : b + SIDE]
                    block = self.blocks.setdefault((a // SIDE, b // SIDE), np.zeros((SIDE, SIDE)))
                    block[: product.shape[0], : product.shape[1]] += product

    def batches(self) -> Iterator[pa.RecordBatch]:
        for (i, j), block in self.blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["bi", "bj", "block"])


def _entries(at: tuple[int, int], block: np.ndarray) -> pa.RecordBatch:
    if at[0] == at[1]:
        block = np.triu(block)
    i, j = np.nonzero(block)
    return pa.RecordBatch.from_arrays([pa.array((i + at[0] * SIDE).astype(np.int32)), pa.array((j + at[1] * SIDE).astype(np.int32)), pa.array(block[i, j])], ["i", "j", "v"])


def _added(batches):
    """Entries of the sums of blocks (bi, bj, block) that come in the order of bi and bj."""
    last, total = None, None
    for batch in batches:
        for i, j, block in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if last != (i, j):
                if last is not None:
                    yield _entries(last, total)
                last, total = (i, j), np.zeros((SIDE, SIDE))
            total += np.frombuffer(block).reshape(SIDE, SIDE)
    if last is not None:
        yield _entries(last, total)


def block_sums(rows: DataFrame, run) -> DataFrame:
    """(i, j, v), i <= j: the elements other than 0 of what run(batches of rows) makes of blocks."""
    blocks = rows.mapInArrow(run, BLOCKS)
    return blocks.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(_added, "i int, j int, v double")


def dense(atoms: pa.ListArray, side: int = 0) -> np.ndarray:
    """(rows, side): 1 where a row has the atom; side is at least what the atoms need."""
    sizes, flat = np.diff(atoms.offsets.to_numpy()), atoms.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(atoms), max(side, int(flat.max()) + 1 if len(flat) else 1)), np.float32)
    out[np.repeat(np.arange(len(atoms)), sizes), flat] = 1
    return out


def covariance(vectors: DataFrame, col: str = "vec") -> DataFrame:
    """Sample covariance (divided by n - 1) of every pair of elements. Each batch sums x and x x' by blocks; a row an element pair is shuffled."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                i, j = np.triu_indices(x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (i.astype(np.int32), j.astype(np.int32), (x.T @ x)[i, j], x.sum(0)[i], x.sum(0)[j], np.full(len(i), len(x), np.int64))], ["i", "j", "xy", "x", "y", "n"])

    parts = vectors.select(col).mapInArrow(run, "i int, j int, xy double, x double, y double, n long")
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "x", "y", "n")])
    return sums.select("i", "j", ((F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / (F.col("n") - 1)).alias("v"))


def _counted(batches):
    sums = BlockSums()
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.column(0).slice(at, 4096)
            x = dense(part)
            at += len(part)
            for a in range(0, len(x), step := max(1, BATCH_NUMBERS // x.shape[1])):
                sums.add(x[a : a + step])
    yield from sums.batches()


def coactivation(codes: DataFrame) -> DataFrame:
    """(i, j, n): patches that have both atoms, by products of batches of codes."""
    return block_sums(codes.select("atoms"), _counted).select("i", "j", F.col("v").cast("long").alias("n"))


def second_moment(codes: DataFrame) -> DataFrame:
    """Co-activation over the number of patches; not centred. Patches without atoms count: element (-1, -1) is their number."""

    def run(batches):
        n = 0

        def counting():
            nonlocal n
            for batch in batches:
                n += batch.num_rows
                yield batch

        yield from _counted(counting())
        total = np.zeros((SIDE, SIDE))
        total[-1, -1] = n
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["bi", "bj", "block"])

    both = block_sums(codes.select("atoms"), run)
    # one row; the shuffle of blocks is the same for both sides and runs once
    total = both.where("i = -1").select(F.col("v").alias("total"))
    return both.where("i >= 0").crossJoin(F.broadcast(total)).select("i", "j", (F.col("v") / F.col("total")).alias("v"))


def mirrored(matrix: DataFrame) -> DataFrame:
    return matrix.union(matrix.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def asymmetry(matrix: DataFrame) -> DataFrame:
    """One row: the largest difference of an element and its mirror image (absent ones are 0)."""
    other = matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
    both = matrix.join(other, ["i", "j"], "full")
    return both.agg(F.coalesce(F.max(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0)))), F.lit(0.0)).alias("max_asymmetry"))


def to_driver(matrix: DataFrame, side: int) -> np.ndarray:
    """The full symmetric matrix of an upper triangle."""
    if side > MAX_SIDE:
        raise ValueError(f"a matrix of more than {MAX_SIDE} a side doesn't fit the driver")
    out = np.zeros((side, side))
    rows = matrix.select("i", "j", "v").toPandas()
    out[rows["i"], rows["j"]] = rows["v"]
    out[rows["j"], rows["i"]] = rows["v"]
    return out
