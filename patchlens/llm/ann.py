"""Nearest neighbours by inner product: a block matrix join on int8 tiles, with error bounds.

Vectors are dealt to blocks of about ``BLOCK`` rows by a hash of their place; a block of queries meets a group of candidate
blocks in one task. There every vector is rounded to int8 with its own scale, x = s q + e, and the tile of integer products
gives each inner product within |e_x| |s q_y| + |s q_x| |e_y| + |e_x| |e_y|. A pair survives if its upper bound reaches the
k-th largest lower bound that its query has seen; survivors are recomputed in double precision on the original vectors
(summed in the order of the components) and merged into the query's heap of k. Heaps of the groups are merged once more at
the end. Bounds only drop pairs that cannot be among the k, so the search is exact: recall is 1.

Vectors that are equal tie in every product, so within a block only the k + 1 smallest ids of equal ones can matter (the
query itself takes one of them); the rest of them leave before the products. A common vector thus costs no more than others.
Rows that repeat id and vector are counted first and dealt k + 1 times at most.

Nothing is broadcast. Queries are a stated share of all rows; each candidate is shuffled once for every ``QUERY_BLOCKS``
query blocks of ``BLOCK`` rows, and each query once for every group of candidates; a task holds one group of
candidates (16,384 vectors), one block of queries and their heaps of k.

Vectors that are null, empty, all zero, or that have null or non-finite components take no part, nor do rows without an id.
Vectors of another length than a query's are no candidates of it. Repeated rows are candidates each, but none of a query's
own id are its candidates; a query id that has several rows is answered by the smallest of its vectors. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048
#: Candidate blocks that one task goes through, one after the other.
GROUP = 8
SCHEMA = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, lengths of the rounded vectors, lengths of the errors), the lengths rounded up a little."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1.0
    codes = np.rint(x / scale[:, None])
    rounded = codes * scale[:, None]
    up = 1 + 1e-9
    return codes.astype(np.int8), scale, np.linalg.norm(rounded, axis=1) * up, np.linalg.norm(x - rounded, axis=1) * up + np.linalg.norm(x, axis=1) * 1e-12


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, summed from the first component to the last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def distinct_smallest(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows of a block without equal vectors beyond those of the k + 1 smallest ids."""
    order = np.lexsort((ids, *x.T))
    same = np.zeros(len(order), bool)
    same[1:] = (x[order[1:]] == x[order[:-1]]).all(axis=1)
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    return order[np.arange(len(order)) - start <= k]


class Heaps:
    """The k best (score, smaller id) of each query so far, and the k-th largest lower bound."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.x, self.k = query_ids, queries, k
        self.codes, self.scale, self.length, self.error = quantised(queries)
        self.codes = self.codes.astype(np.float32)
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(query_ids)
        self.floor = np.full(len(query_ids), -np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        keep = distinct_smallest(ids, x, self.k)
        ids, x = ids[keep], x[keep]
        codes, scale, length, error = quantised(x)
        # products of int8 codes are whole numbers that float32 holds while dimension * 127^2 < 2^24, float64 beyond
        kind = np.float32 if x.shape[1] * 127**2 < 2**24 else np.float64
        near = (self.codes.astype(kind) @ codes.astype(kind).T).astype(np.float64) * self.scale[:, None] * scale
        slack = self.error[:, None] * length + self.length[:, None] * error + self.error[:, None] * error
        low = near - slack
        low[self.ids[:, None] == ids] = -np.inf
        if len(ids) >= self.k:
            self.floor = np.maximum(self.floor, np.partition(low, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        q, c = np.nonzero((near + slack >= self.floor[:, None]) & (self.ids[:, None] != ids))
        bounds = np.searchsorted(q, np.arange(len(self.ids) + 1))
        scores = products(self.x[q], x[c])
        for i in np.flatnonzero(np.diff(bounds)):
            part = slice(bounds[i], bounds[i + 1])
            score, vec = np.concatenate([self.best[i][0], scores[part]]), np.concatenate([self.best[i][1], ids[c[part]]])
            order = np.lexsort((vec, -score))[: self.k]
            self.best[i] = score[order], vec[order]
            if len(order) == self.k:
                self.floor[i] = max(self.floor[i], score[order[-1]])

    def rows(self) -> pd.DataFrame:
        sizes = [len(s) for s, _ in self.best]
        empty = [(np.zeros(0), np.zeros(0, np.int64))]
        return pd.DataFrame({"query_id": np.repeat(self.ids, sizes), "vec_id": np.concatenate([v for _, v in self.best + empty]), "score": np.concatenate([s for s, _ in self.best + empty])})


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest inner products, ties to smaller ids."""
    slim = lambda df: df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    # rows that are equal as a whole would all be dealt to one place: more than k + 1 of them can't matter
    candidates = slim(vectors).groupBy("id", "x").agg(F.count("*").alias("n"))
    candidates = candidates.select("id", "x", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k + 1)).cast("int"))).alias("copy"))
    asked = slim(queries).groupBy("id").agg(F.min("x").alias("x"))
    n_candidates, n_queries = candidates.count(), asked.count()
    groups, blocks = max(1, -(-n_candidates // (BLOCK * GROUP))), max(1, -(-n_queries // BLOCK))
    place = F.xxhash64("id", "x")
    dim = F.size("x").alias("dim")
    none, one = F.lit(False).alias("asks"), F.lit(True).alias("asks")
    dealt = candidates.select(dim, F.pmod(place, F.lit(groups)).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "id", "x", none)
    asking = asked.select(dim, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), F.pmod(place, F.lit(blocks)).cast("int").alias("b"), "id", "x", one)

    def tile(_key, left: Iterator[pd.DataFrame] | pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        heaps = Heaps(left["id"].to_numpy(), _matrix(left["x"]), k)
        for at in range(0, len(right), BLOCK):
            part = right.iloc[at : at + BLOCK]
            heaps.add(part["id"].to_numpy(), _matrix(part["x"]))
        return heaps.rows()

    keys = ("dim", "g", "b")
    found = asking.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(tile, SCHEMA)
    # the limit a query is taken before the shuffle as well
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The query for DuckDB: every 20th vector against all.
SQL = """
WITH v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
),
q AS (SELECT vec_id AS query_id, min(x) AS y FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (SELECT query_id, vec_id, list_reduce(list_transform(list_zip(y, x), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score FROM q JOIN v ON v.vec_id <> q.query_id AND len(x) = len(y)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
