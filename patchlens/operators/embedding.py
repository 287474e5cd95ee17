"""Spectral embedding: eigenvectors of C inner C, with C the inverse square root of the codes' second moment, give P = U C."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions import vectors as V
from .codes import MAX_NUMBERS


def solve(second_moment: np.ndarray, inner: np.ndarray, embed_dim: int, skip: int, tol: float = 1e-15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(projection E x K, U E x K, values): eigenvectors of the symmetrised closed form after the first ``skip``, by size of their values."""
    c = L.inverse_sqrt(second_moment, tol)
    closed = c @ inner @ c
    values, u = L.smallest_eigenvectors((closed + closed.T) / 2, embed_dim, skip)
    return u @ c, u, values


def project(codes: DataFrame, projection: np.ndarray, normalised: bool = True) -> DataFrame:
    """codes with beta in place of atoms: the sum of the projection's columns over a patch's atoms. A patch without atoms stays zero.

    The projection (E x K numbers) goes with the task; an Arrow batch is one sparse product, and patches keep their rows.
    """
    if projection.size > MAX_NUMBERS:
        raise ValueError("the projection is too large to broadcast: see project_by_join")
    shared = codes.sparkSession.sparkContext.broadcast(np.ascontiguousarray(projection.T))
    names = [c for c in codes.columns if c != "atoms"]
    slim = codes.select(*names, "atoms")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])

    def run(batches):
        table = shared.value
        for batch in batches:
            atoms = batch.column(len(names))
            sizes = np.diff(atoms.offsets.to_numpy()) if batch.num_rows else np.zeros(0, int)
            beta = np.zeros((batch.num_rows, table.shape[1]))
            np.add.at(beta, np.repeat(np.arange(batch.num_rows), sizes), table[atoms.flatten().to_numpy(zero_copy_only=False)])
            if normalised:
                beta /= np.linalg.norm(beta, axis=1, keepdims=True) + V.EPSILON
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * table.shape[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.ListArray.from_arrays(ends, pa.array(beta.ravel()))], [*names, "beta"])

    return slim.mapInArrow(run, f"{fields}, beta array<double>")


def project_by_join(codes: DataFrame, projection: DataFrame) -> DataFrame:
    """(patch_id, e, v): the same from a table projection(e, atom, v), as join and sum; for projections beyond a broadcast."""
    return codes.select("patch_id", F.explode("atoms").alias("atom")).join(projection, "atom").groupBy("patch_id", "e").agg(F.sum("v").alias("v"))
