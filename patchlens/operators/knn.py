"""Weighted nearest-neighbour classes: cosine, top k, votes exp(similarity / T), shares of correct first and first five classes.

Training vectors and queries are dealt to blocks; a task multiplies a block pair and keeps k a query, and a window takes the
best k over the blocks (its limit a query is applied before the shuffle). Neither side is broadcast or collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

BLOCK = 4096
#: Each query has a row a class when classes are ranked.
MAX_CLASSES = 10_000
NEIGHBOURS = "query_id long, query_label int, neighbour_id long, label int, sim double"


def _unit(rows: pa.Table) -> np.ndarray:
    x = rows["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _dealt(train: DataFrame, test: DataFrame, id_col: str, vec_col: str):
    """(queries, training rows) with the keys of the block pair (t, q) that they go to."""
    slim = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col("label").cast("int").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    train, test = slim(train), slim(test)
    sizes = dict(train.select(F.lit(0).alias("of")).union(test.select(F.lit(1).alias("of"))).groupBy("of").count().collect())
    # at least a few blocks, so that small inputs use more than one core
    n, m = max(4, -(-sizes.get(0, 0) // BLOCK)), max(1, -(-sizes.get(1, 0) // BLOCK))
    deal = lambda c: F.pmod(F.xxhash64("id"), F.lit(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    return test.select(every(n).alias("t"), deal(m).alias("q"), "*"), train.select(deal(n).alias("t"), every(m).alias("q"), "*")


def _tiles(train: DataFrame, test: DataFrame, id_col: str, vec_col: str, floor) -> DataFrame:
    """Pairs of every block pair whose cosine is at least floor(cosines), a number a query."""

    def tile(q: pa.Table, t: pa.Table) -> pa.Table:
        sims = _unit(q) @ _unit(t).T if q.num_rows and t.num_rows else np.zeros((0, 0))
        rows, cols = np.nonzero(sims >= floor(sims)) if sims.size else (np.zeros(0, int), np.zeros(0, int))
        return pa.table({"query_id": q["id"].take(rows), "query_label": q["label"].take(rows), "neighbour_id": t["id"].take(cols), "label": t["label"].take(cols), "sim": sims[rows, cols]})

    left, right = _dealt(train, test, id_col, vec_col)
    return left.groupBy("t", "q").cogroup(right.groupBy("t", "q")).applyInArrow(tile, NEIGHBOURS)


def similar_pairs(train: DataFrame, test: DataFrame, threshold: float, id_col: str = "image_id", vec_col: str = "vec") -> DataFrame:
    """(query_id, query_label, neighbour_id, label, sim): all pairs with a cosine of at least the threshold."""
    return _tiles(train, test, id_col, vec_col, lambda sims: threshold)


def top_k(train: DataFrame, test: DataFrame, k: int, id_col: str = "image_id", vec_col: str = "vec") -> DataFrame:
    """(query_id, query_label, neighbour_id, label, sim, rank): the k most similar, ties to the smaller id."""
    def kth(sims: np.ndarray) -> np.ndarray:
        best = min(k, sims.shape[1])
        return -np.partition(-sims, best - 1, axis=1)[:, best - 1 : best]

    found = _tiles(train, test, id_col, vec_col, kth)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "neighbour_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k_by_functions(train: DataFrame, test: DataFrame, k: int, id_col: str = "image_id", vec_col: str = "vec") -> DataFrame:
    """The same by array functions; every pair is a row, so for small tables only."""
    q = test.select(F.col(id_col).alias("query_id"), F.col("label").alias("query_label"), V.divide(F.col(vec_col), V.norm(F.col(vec_col))).alias("a"))
    t = train.select(F.col(id_col).alias("neighbour_id"), "label", V.divide(F.col(vec_col), V.norm(F.col(vec_col))).alias("b"))
    pairs = q.crossJoin(t).select("query_id", "query_label", "neighbour_id", "label", V.dot(F.col("a"), F.col("b")).alias("sim"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "neighbour_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def votes(neighbours: DataFrame, temperature: float) -> DataFrame:
    """(query_id, query_label, label, weight): summed exp(sim / T) of each class."""
    return neighbours.groupBy("query_id", "query_label", "label").agg(F.sum(F.exp(F.col("sim") / temperature)).alias("weight"))


def ranked(vote: DataFrame, classes: DataFrame) -> DataFrame:
    """Every class of ``classes(label)`` a query by weight, ties to the smaller label; classes without a vote weigh 0."""
    labels = [r[0] for r in classes.select("label").distinct().limit(MAX_CLASSES + 1).collect()]
    if len(labels) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    every = vote.select("query_id", "query_label").distinct().withColumn("label", F.explode(F.array(*[F.lit(x).cast("int") for x in labels]) if labels else F.array().cast("array<int>")))
    full = every.join(vote, ["query_id", "query_label", "label"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return full.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("weight").desc(), "label")))


def predict(vote: DataFrame) -> DataFrame:
    """(query_id, query_label, predicted)"""
    best = F.min_by("label", F.struct((-F.col("weight")).alias("w"), "label"))
    return vote.groupBy("query_id", "query_label").agg(best.alias("predicted"))


def accuracy(vote: DataFrame, test: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """One row: top1 and top5 in percent, total. The five are fewer if k or the test's classes are."""
    first = F.least(F.lit(5), F.lit(k), F.col("n_class"))
    n_class = test.agg(F.countDistinct("label").alias("n_class"))
    rows = ranked(vote, classes).crossJoin(F.broadcast(n_class)).where("label = query_label")
    hit = rows.agg(F.sum((F.col("rank") == 1).cast("long")).alias("one"), F.sum((F.col("rank") <= first).cast("long")).alias("five"))
    total = test.agg(F.count("*").alias("total"))
    share = lambda c: (100.0 * F.coalesce(F.col(c), F.lit(0)) / F.col("total"))
    return total.crossJoin(hit).select(share("one").alias("top1"), share("five").alias("top5"), "total")


def classify(train: DataFrame, test: DataFrame, k: int, temperature: float, id_col: str = "image_id", vec_col: str = "vec") -> DataFrame:
    """Accuracy of the weighted vote."""
    classes = train.select("label").union(test.select("label")).distinct()
    return accuracy(votes(top_k(train, test, k, id_col, vec_col), temperature), test, classes, k)
