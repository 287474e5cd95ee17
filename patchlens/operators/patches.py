"""Patches: patch_id, image_id, r, c, vec. Positions come from one explode; everything else is per row.

With full context (radius of the grid or more) the mean is one number an image, worked out within the image's row before
the explode, so nothing is shuffled. A smaller radius takes two window sums, along columns, then along rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from .codes import MAX_NUMBERS
from ..sources.images import Shape


def grid_size(shape: Shape, patch_sz: int) -> int:
    """Patches a side; images are square."""
    if shape.height != shape.width or patch_sz > shape.height:
        raise ValueError("images must be square and no smaller than a patch")
    return shape.height - patch_sz + 1


def patchify(images: DataFrame, shape: Shape, patch_sz: int, keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """Every patch_sz x patch_sz window, as (top, left, channel) with the channel fastest."""
    p, row = grid_size(shape, patch_sz), shape.width * shape.channels
    at = images.select("image_id", *keep, "pixels", F.explode(F.sequence(F.lit(0), F.lit(p * p - 1))).alias("at"))
    at = at.select("image_id", *keep, "pixels", F.floor(F.col("at") / p).cast("int").alias("r"), (F.col("at") % p).cast("int").alias("c"))
    line = lambda i: F.slice("pixels", (F.col("r") + i) * row + F.col("c") * shape.channels + 1, patch_sz * shape.channels)
    vec = F.flatten(F.array(*[line(i) for i in range(patch_sz)]))
    return at.select(((F.col("image_id") * p + F.col("r")) * p + F.col("c")).alias("patch_id"), "image_id", *keep, "r", "c", vec.alias("vec"))


def decode_key(patches: DataFrame, p: int) -> DataFrame:
    """image_id, r, c of a patch_id."""
    k = F.col("patch_id")
    return patches.select("patch_id", F.floor(k / (p * p)).alias("image_id"), F.floor(k % (p * p) / p).cast("int").alias("r"), (k % p).cast("int").alias("c"))


def full_context_mean(images: DataFrame, shape: Shape, patch_sz: int) -> DataFrame:
    """images with mu: the mean of all elements of all patches. A pixel counts once for every patch that covers it."""
    p = grid_size(shape, patch_sz)
    cover = lambda x: F.least(x, F.lit(patch_sz - 1), F.lit(p - 1), F.lit(shape.width - 1) - x) + 1
    k = lambda i: F.floor(i / shape.channels)
    weighed = F.transform("pixels", lambda x, i: x * cover(F.floor(k(i) / shape.width)) * cover(k(i) % shape.width))
    return images.withColumn("mu", V.total(weighed) / (p * p * patch_sz * patch_sz * shape.channels))


def context_mean(patches: DataFrame, context_sz: int, patch_dim: int) -> DataFrame:
    """patches with mu: the mean over the patches at most context_sz rows and columns away, one number a position."""
    first = Window.partitionBy("image_id", "r").orderBy("c").rangeBetween(-context_sz, context_sz)
    second = Window.partitionBy("image_id", "c").orderBy("r").rangeBetween(-context_sz, context_sz)
    sums = patches.withColumn("__s", V.total(F.col("vec")))
    sums = sums.withColumns({"__s": F.sum("__s").over(first), "__n": F.count("*").over(first)})
    return sums.withColumn("mu", F.sum("__s").over(second) / (F.sum("__n").over(second) * patch_dim)).drop("__s", "__n")


def centre(patches: DataFrame) -> DataFrame:
    return patches.withColumn("vec", F.transform("vec", lambda x: x - F.col("mu"))).drop("mu")


def centred_patches(images: DataFrame, shape: Shape, patch_sz: int, context_sz: int, keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """Patches less their context's mean, the cheaper way that the radius allows."""
    if context_sz >= grid_size(shape, patch_sz) - 1:
        return centre(patchify(full_context_mean(images, shape, patch_sz), shape, patch_sz, (*keep, "mu")))
    return centre(context_mean(patchify(images, shape, patch_sz, keep), context_sz, patch_sz * patch_sz * shape.channels))


def normalise(patches: DataFrame) -> DataFrame:
    return patches.withColumn("vec", V.unit(F.col("vec")))


def whiten(patches: DataFrame, w) -> DataFrame:
    """vec = w vec, by blocks of an Arrow batch; w is d x d for patches of d numbers."""
    import numpy as np
    import pyarrow as pa

    if np.size(w) > MAX_NUMBERS:
        raise ValueError("the whitening matrix is too large to broadcast")
    shared, names = patches.sparkSession.sparkContext.broadcast(np.asarray(w, float)), patches.columns

    def run(batches):
        for batch in batches:
            vec = batch.column(names.index("vec"))
            flat = vec.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(shared.value)))
            out = flat @ shared.value.T
            ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
            yield batch.set_column(names.index("vec"), "vec", pa.ListArray.from_arrays(ends, pa.array(out.ravel())))

    return patches.mapInArrow(run, patches.schema)
