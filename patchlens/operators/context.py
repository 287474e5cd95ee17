"""Context graph and loss matrices: inner = sum of y y' over patches (optim two) or pairs of patches (optim one).

The difference operator is never built. ``two``: y is a patch's code less the mean code of its live neighbours; ``one``: the
difference of two live neighbours' codes, a pair at a time. Live patches have an atom. With full context, both follow from
the images' own sums: with m live patches, co-activations G and atom counts S in an image, ``two`` is
(m / (m - 1))^2 (G - S S' / m) and ``one`` is m G - S S'. With a smaller radius ``two`` is the sum of y y', and ``one`` the sum
of x' (n x - A x) for codes x, neighbours A and their numbers n.

Codes are shuffled once, by image, and come image by image; all of these are sums of products of two matrices with a row a
patch or an image, which each task adds up by blocks (see ``moments``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .moments import BATCH_NUMBERS, BlockSums, block_sums, dense


def neighbours(spark: SparkSession, p: int, context_sz: int) -> DataFrame:
    """(r, c, r2, c2): ordered pairs of different grid positions at most context_sz rows and columns apart. The same for every image."""
    at = spark.range(p * p).select(F.floor(F.col("id") / p).cast("int").alias("r"), (F.col("id") % p).cast("int").alias("c"))
    span = lambda x: F.sequence(F.greatest(F.lit(0), F.col(x) - context_sz), F.least(F.lit(p - 1), F.col(x) + context_sz))
    return at.withColumn("r2", F.explode(span("r"))).withColumn("c2", F.explode(span("c"))).where("r <> r2 OR c <> c2")


def context_pairs(spark: SparkSession, p: int, context_sz: int) -> DataFrame:
    """(a, b): unordered pairs, a < b, as positions r * p + c."""
    at = neighbours(spark, p, context_sz).select((F.col("r") * p + F.col("c")).alias("a"), (F.col("r2") * p + F.col("c2")).alias("b"))
    return at.where("a < b")


def live_neighbours(codes: DataFrame, context_sz: int) -> DataFrame:
    """(patch_id, n): live neighbours of every live patch; those without any are left out. An image's P^2 patches are gathered once."""
    live = codes.where(F.size("atoms") > 0).select("image_id", F.struct("patch_id", "r", "c").alias("at"))
    near = lambda all_, x: F.size(F.filter(all_, lambda o: (F.abs(o["r"] - x["r"]) <= context_sz) & (F.abs(o["c"] - x["c"]) <= context_sz))) - 1
    of = live.groupBy("image_id").agg(F.collect_list("at").alias("all"))
    counted = F.transform("all", lambda x: F.struct(x["patch_id"].alias("patch_id"), near(F.col("all"), x).cast("long").alias("n")))
    return of.select(F.inline(counted)).where("n > 0")


def _images(batches) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray]]:
    """Rows (image_id, r, c, atoms), which come in the order of images, in groups of whole images, and where in a group images begin."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = batch.column(0).to_numpy()
        ends = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        if held and len(ids) and held[-1].column(0)[-1].as_py() != ids[0]:
            yield held, _starts(held)
            held = []
        if len(ends):
            held.append(batch.slice(0, ends[-1]))
            yield held, _starts(held)
            held = [batch.slice(ends[-1])]
        elif len(ids):
            held.append(batch)
    if held:
        yield held, _starts(held)


def _starts(held: list[pa.RecordBatch]) -> np.ndarray:
    ids = np.concatenate([b.column(0).to_numpy() for b in held])
    return np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])


def _by_image(codes: DataFrame, terms) -> DataFrame:
    """(i, j, v), i <= j: sums over images of x' y for each (x, y) of terms(codes of some images, where they begin, r, c)."""
    live = codes.where(F.size("atoms") > 0).select("image_id", "r", "c", "atoms")

    def run(batches):
        sums = BlockSums()
        for held, starts in _images(batches):
            table = pa.Table.from_batches(held).combine_chunks()
            r, c, atoms = table["r"].to_numpy(), table["c"].to_numpy(), table["atoms"].combine_chunks()
            side = max(1, int(pa.compute.max(atoms.flatten()).as_py()) + 1)
            first = 0
            while first < len(starts) - 1:  # as many images as a dense matrix may hold, one at least
                last = max(first + 1, int(np.searchsorted(starts, starts[first] + max(1, BATCH_NUMBERS // side), side="right")) - 1)
                rows = slice(int(starts[first]), int(starts[last]))
                x = dense(atoms.slice(rows.start, rows.stop - rows.start), side)
                for left, right in terms(x, starts[first : last + 1] - rows.start, r[rows], c[rows]):
                    sums.add(left, right)
                first = last
        yield from sums.batches()

    # elements that cancel out are rounding
    return block_sums(live.repartition("image_id").sortWithinPartitions("image_id"), run).where(F.abs("v") > 1e-9)


def full_context_loss(codes: DataFrame, optim: str) -> DataFrame:
    """(i, j, v) with i <= j for a radius that covers the grid."""

    def terms(x, starts, r, c):
        m = np.diff(starts).astype(float)
        weight = np.where(m > 1, (m / np.maximum(m - 1, 1)) ** 2 if optim == "two" else m, 0.0)
        share = weight / m if optim == "two" else np.where(m > 1, 1.0, 0.0)
        counts = np.add.reduceat(x, starts[:-1], axis=0).astype(float)
        yield x.astype(float) * np.repeat(weight, np.diff(starts))[:, None], x.astype(float)
        yield -counts * share[:, None], counts

    return _by_image(codes, terms)


def context_loss(codes: DataFrame, optim: str, context_sz: int, p: int) -> DataFrame:
    """(i, j, v) with i <= j for any radius."""
    if context_sz >= p - 1:
        return full_context_loss(codes, optim)

    def terms(x, starts, r, c):
        x = x.astype(float)
        y = np.zeros_like(x)
        for a, b in zip(starts[:-1], starts[1:]):
            rc = np.stack([r[a:b], c[a:b]], axis=1)
            near = (np.abs(rc[:, None] - rc[None]).max(axis=2) <= context_sz).astype(float) - np.eye(b - a)
            n = near.sum(axis=1)[:, None]
            around = near @ x[a:b]
            y[a:b] = np.where(n > 0, x[a:b] - around / np.maximum(n, 1), 0.0) if optim == "two" else n * x[a:b] - around
        yield (y, y) if optim == "two" else (x, y)

    return _by_image(codes, terms)
