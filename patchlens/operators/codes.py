"""Sparse binary codes: the atoms whose cosine with a patch reaches a threshold, as one sorted array a patch.

The dictionary is K x d numbers (its size is checked) and goes with the task; a batch of patches meets it in one matrix
product, and only active atoms leave it. Patches keep their row, so nothing after this needs a join to find a patch's codes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers of a dictionary that may be broadcast: 8192 atoms of 512 numbers.
MAX_NUMBERS = 1 << 22
ROWS = 4096


def sparse_codes(patches: DataFrame, dictionary: np.ndarray, threshold: float, forced: bool = False) -> DataFrame:
    """patches with atoms (array<int>, sorted) in place of vec. forced: the most similar atom (the first of equal ones) is always on."""
    if dictionary.size > MAX_NUMBERS:
        raise ValueError("the dictionary is too large to broadcast")
    shared = patches.sparkSession.sparkContext.broadcast(np.ascontiguousarray(dictionary.T))
    names = [c for c in patches.columns if c != "vec"]
    slim = patches.select(*names, "vec")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])

    def run(batches):
        phi = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = part.column(len(names)).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                cosine = x @ phi
                on = cosine >= threshold
                if forced:
                    on[np.arange(len(x)), cosine.argmax(axis=1)] = True
                ends = np.concatenate([[0], np.cumsum(on.sum(axis=1))]).astype(np.int32)
                atoms = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(on)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), atoms], [*names, "atoms"])

    return slim.mapInArrow(run, f"{fields}, atoms array<int>")


def edges(codes: DataFrame) -> DataFrame:
    """One row an active (patch, atom)."""
    return codes.select("patch_id", "image_id", "r", "c", F.explode("atoms").alias("atom"))


def zero_codes(codes: DataFrame) -> DataFrame:
    return codes.where(F.size("atoms") == 0)


def density(codes: DataFrame, dict_sz: int) -> DataFrame:
    """One row: patches, active codes, share of active codes, share of patches without any."""
    n = F.count("*")
    active = F.coalesce(F.sum(F.size("atoms")), F.lit(0)).cast("long")
    dead = F.coalesce(F.sum((F.size("atoms") == 0).cast("long")), F.lit(0))
    return codes.agg(n.alias("patches"), active.alias("active"), (active / (n * dict_sz)).alias("density"), (dead / n).alias("zero_share"))
