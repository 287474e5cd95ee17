"""Greedy dictionary: patches in a pseudo-random order, kept if no kept one has a cosine above the threshold.

The order is by a hash of seed and patch id, so it is the same for any partitioning. Candidates come to the driver in batches,
smallest hashes first (a top-k, not a sort of the table); admission only depends on earlier admissions, so batches give what
one by one would. Each batch is a pass over the patches and twice as large as the one before (up to ``MOST`` numbers), so
passes are few.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 4000
#: Numbers that one batch brings to the driver at most.
MOST = 1 << 24


def random_order(seed: int, id_col: str = "patch_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")).cast("binary"))


def first_patches(patches: DataFrame, n: int, seed: int, id_col: str = "patch_id") -> DataFrame:
    """(atom, src_patch_id, vec): the first n in the random order, without a threshold."""
    order = random_order(seed, id_col)
    rows = patches.select(F.col(id_col).alias("src_patch_id"), "vec", order.alias("o")).orderBy("o", "src_patch_id").limit(n)
    kept = [(k, r["src_patch_id"], r["vec"]) for k, r in enumerate(rows.collect())]
    return patches.sparkSession.createDataFrame(kept, "atom int, src_patch_id long, vec array<double>")


def greedy(patches: DataFrame, size: int, threshold: float, seed: int, id_col: str = "patch_id") -> DataFrame:
    """(atom, src_patch_id, vec): size unit vectors, no two of them with a cosine above the threshold; ValueError if there aren't as many."""
    rows = patches.select(F.col(id_col).alias("src_patch_id"), "vec", random_order(seed, id_col).alias("o"))
    kept_ids: list[int] = []
    kept: np.ndarray | None = None
    after, n = None, max(BATCH, 2 * size)
    while len(kept_ids) < size:
        fresh = rows if after is None else rows.where((F.col("o") > after[0]) | ((F.col("o") == after[0]) & (F.col("src_patch_id") > after[1])))
        batch = fresh.orderBy("o", "src_patch_id").limit(n).collect()
        if not batch:
            raise ValueError(f"the patches give {len(kept_ids)} atoms, not {size}: lower the size or raise the threshold")
        if kept is None:
            kept = np.zeros((size, len(batch[0]["vec"])))
        for r in batch:
            v = np.array(r["vec"])
            if not len(kept_ids) or (kept[: len(kept_ids)] @ v).max() <= threshold:
                kept[len(kept_ids)] = v
                kept_ids.append(r["src_patch_id"])
                if len(kept_ids) == size:
                    break
        after = (batch[-1]["o"], batch[-1]["src_patch_id"])
        n = max(n, min(2 * n, MOST // kept.shape[1]))
    return patches.sparkSession.createDataFrame([(k, i, kept[k].tolist()) for k, i in enumerate(kept_ids)], "atom int, src_patch_id long, vec array<double>")


def matrix_of(dictionary: DataFrame) -> np.ndarray:
    """K x d, in the order of the atoms."""
    return np.array([r["vec"] for r in dictionary.orderBy("atom").collect()], float)
