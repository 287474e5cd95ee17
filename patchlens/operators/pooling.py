"""Patch embeddings to image vectors: hopping windows over the grid, then one array an image.

An image's patches are shuffled once, by image, and come image by image; each image's grid is summed in two steps (along rows,
then along columns), so that an element is never a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def windows(p: int, size: int, stride: int) -> int:
    return (p - size) // stride + 1


def average_pool(patches: DataFrame, p: int, size: int = 4, stride: int = 2, col: str = "beta", keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """(image_id, keep, wr, wc, col): means of size x size windows. Patches that are missing count as zeros."""
    s = windows(p, size, stride)
    if s < 1:
        raise ValueError("the grid is smaller than a window")
    edge = (s - 1) * stride + size
    slim = patches.where((F.col("r") < edge) & (F.col("c") < edge)).select("image_id", *keep, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col(col).cast("array<double>").alias("v"))
    names = ["image_id", *keep, "wr", "wc", col]
    n_keys = 1 + len(keep)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:n_keys]), "wr int, wc int", f"`{col}` array<double>"])

    def pooled(image: list[pa.RecordBatch]) -> pa.RecordBatch:
        r, c = (np.concatenate([b.column(n_keys + i).to_numpy() for b in image]) for i in (0, 1))
        flat = np.concatenate([b.column(n_keys + 2).flatten().to_numpy(zero_copy_only=False) for b in image]).reshape(len(r), -1)
        grid = np.zeros((edge, edge, flat.shape[1]))
        grid[r, c] = flat
        rows = sum(grid[i : i + (s - 1) * stride + 1 : stride] for i in range(size))
        out = sum(rows[:, i : i + (s - 1) * stride + 1 : stride] for i in range(size)).reshape(s * s, -1) / (size * size)
        keys = [pa.array([image[0].column(i)[0].as_py()] * (s * s), image[0].column(i).type) for i in range(n_keys)]
        ends = pa.array(np.arange(s * s + 1, dtype=np.int32) * out.shape[1])
        at = np.arange(s * s, dtype=np.int32)
        return pa.RecordBatch.from_arrays([*keys, pa.array(at // s), pa.array(at % s), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1), len(ids)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if a == b:
                    continue
                if held and held[-1].column(0)[-1].as_py() != ids[a]:
                    yield pooled(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield pooled(held)

    return slim.repartition("image_id").sortWithinPartitions("image_id").mapInArrow(run, fields)


def normalise_windows(pooled: DataFrame, col: str = "beta") -> DataFrame:
    return pooled.withColumn(col, V.damped_unit(F.col(col)))


def flatten_windows(pooled: DataFrame, s: int, col: str = "beta", keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """(image_id, keep, vec): element by element, each over the windows row by row."""
    rows = pooled.groupBy("image_id", *keep).agg(F.array_sort(F.collect_list(F.struct("wr", "wc", F.col(col).alias("v")))).alias("w"))
    n = F.size(F.element_at("w", 1)["v"])
    vec = F.transform(F.sequence(F.lit(0), n * s * s - 1), lambda k: F.element_at(F.element_at("w", (k % (s * s) + 1).cast("int"))["v"], (F.floor(k / (s * s)) + 1).cast("int")))
    return rows.select("image_id", *keep, vec.alias("vec"))
