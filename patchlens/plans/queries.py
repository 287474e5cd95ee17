"""Queries over the fixture, one a operator, and the SQL that checks them.

Most stages that follow whitening take patches without it, so that each is checked for itself; the last ones are a whole fit.
Floating results are rounded: to 6 digits, votes as logarithms.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import linalg as L
from ..functions import vectors as V
from ..operators import blocks, context, dictionary, embedding, knn, moments, patches, pooling
from ..operators import codes as C
from ..sources import images as I
from . import pipeline

FIX = Config.fixture()
SHAPE = I.SHAPES["fixture"]
P, DIM, K, T = 6, 9, 64, 0.03
RAW_THRESHOLD, RAW_ATOMS, RAW_DICT_THRESHOLD = 0.3, 32, 0.25
Query = Callable[[SparkSession, str], DataFrame]


def _round(c: str | Column, digits: int = 6) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def _round_all(c: str) -> Column:
    return F.transform(c, lambda x: F.round(x, 6) + F.lit(0.0))


# --- stages that queries share -----------------------------------------------------------------------------------


def images(spark, sf_dir, split=None):
    df = I.read_fixture(spark, sf_dir)
    return df.where(F.col("split") == split) if split else df


def augmented(spark, sf_dir):
    return I.augment(images(spark, sf_dir, "train"), SHAPE)


def train_patches(spark, sf_dir):
    return patches.patchify(augmented(spark, sf_dir), SHAPE, 3)


def centred(spark, sf_dir):
    return patches.centred_patches(augmented(spark, sf_dir), SHAPE, 3, 8)


def units(spark, sf_dir):
    return patches.normalise(centred(spark, sf_dir))


def atoms(spark, sf_dir):
    return dictionary.first_patches(units(spark, sf_dir), K, FIX.seed)


def plain_codes(spark, sf_dir):
    """Codes of patches without whitening, for the SQL checks."""
    return C.sparse_codes(units(spark, sf_dir), dictionary.matrix_of(atoms(spark, sf_dir)), FIX.gq_thresh)


def projection_table() -> np.ndarray:
    """A fixed 4 x K projection: whole numbers from a formula that SQL has too."""
    return np.array([[(e * 7 + k * 3) % 11 - 5 for k in range(K)] for e in range(4)], float)


def projection_frame(spark):
    n = F.col("id")
    e, k = F.floor(n / K).cast("int"), (n % K).cast("int")
    return spark.range(4 * K).select(e.alias("e"), k.alias("atom"), ((e * 7 + k * 3) % 11 - 5).cast("double").alias("v"))


def sparse_a(spark, sf_dir):
    """Order lines as a sparse matrix of whole numbers: rows are orders modulo 40, columns parts modulo 500."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_orderkey") % 40).alias("row"), (F.col("l_partkey") % 500).alias("col"), F.col("l_linenumber").cast("double").alias("x"))
    return lines.groupBy("row", "col").agg(F.sum("x").alias("v"))


def sparse_b(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_partkey") % 500).alias("row"), (F.col("l_suppkey") % 20).alias("col"), F.col("l_linenumber").cast("double").alias("x"))
    return lines.groupBy("row", "col").agg(F.sum("x").alias("v"))


# --- queries -----------------------------------------------------------------------------------------------------


def scan_filter_split(spark, sf_dir):
    return I.take_first(images(spark, sf_dir), "train", 200).select("image_id", "split", "label", F.size("pixels").alias("n_pixels"))


def hflip_augment(spark, sf_dir):
    return augmented(spark, sf_dir).select("image_id", "flip", "label", "pixels")


def grayscale_project(spark, sf_dir):
    """Three channels made of one: the value, its half, its negative."""
    colour = images(spark, sf_dir).withColumn("pixels", F.flatten(F.transform("pixels", lambda x: F.array(x, x / 2, -x))))
    return I.grayscale(colour).select("image_id", _round_all("pixels").alias("pixels"))


def patchify(spark, sf_dir):
    return train_patches(spark, sf_dir).select("patch_id", "image_id", "r", "c", "vec")


def patch_key_decode(spark, sf_dir):
    return patches.decode_key(train_patches(spark, sf_dir).select("patch_id"), P)


def context_mean_ctx1(spark, sf_dir):
    return patches.context_mean(train_patches(spark, sf_dir), 1, DIM).select("patch_id", _round("mu", 9).alias("mu"))


def context_mean_full(spark, sf_dir):
    return patches.full_context_mean(augmented(spark, sf_dir), SHAPE, 3).select("image_id", _round("mu", 9).alias("mu"))


def center_patches(spark, sf_dir):
    return centred(spark, sf_dir).select("patch_id", _round_all("vec").alias("vec"))


def l2_normalize(spark, sf_dir):
    return units(spark, sf_dir).select("patch_id", _round_all("vec").alias("vec"))


def patch_covariance(spark, sf_dir):
    return moments.covariance(centred(spark, sf_dir)).select("i", "j", _round("v", 9).alias("v"))


def similarity_threshold_join(spark, sf_dir):
    """Test and training vectors with a cosine at the threshold or above."""
    rows = images(spark, sf_dir).withColumn("vec", F.col("pixels"))
    found = knn.similar_pairs(rows.where("split = 'train'"), rows.where("split = 'test'"), RAW_THRESHOLD)
    return found.select("query_id", "neighbour_id", _round("sim").alias("sim"))


def raw_knn(spark, sf_dir, k=30):
    rows = images(spark, sf_dir).withColumn("vec", F.col("pixels"))
    return knn.top_k(rows.where("split = 'train'"), rows.where("split = 'test'"), k)


def cosine_topk(spark, sf_dir):
    return raw_knn(spark, sf_dir, 10).select("query_id", "neighbour_id", "rank", _round("sim").alias("sim"))


def knn_topk(spark, sf_dir):
    return raw_knn(spark, sf_dir).select("query_id", "neighbour_id", "label", "rank", _round("sim").alias("sim"))


def knn_vote(spark, sf_dir):
    return knn.votes(raw_knn(spark, sf_dir), T).select("query_id", "label", _round(F.log("weight")).alias("log_weight"))


def knn_predict(spark, sf_dir):
    return knn.predict(knn.votes(raw_knn(spark, sf_dir), T)).select("query_id", "predicted", (F.col("predicted") == F.col("query_label")).alias("correct"))


def knn_class_ranks(spark, sf_dir):
    classes = images(spark, sf_dir).select("label")
    return knn.ranked(knn.votes(raw_knn(spark, sf_dir), T), classes).select("query_id", "label", "rank")


def knn_accuracy(spark, sf_dir):
    rows = images(spark, sf_dir)
    return knn.accuracy(knn.votes(raw_knn(spark, sf_dir), T), rows.where("split = 'test'"), rows.select("label"), 30)


def dictionary_greedy(spark, sf_dir):
    rows = images(spark, sf_dir).select(F.col("image_id").alias("patch_id"), V.divide(F.col("pixels"), V.norm(F.col("pixels"))).alias("vec"))
    return dictionary.greedy(rows, RAW_ATOMS, RAW_DICT_THRESHOLD, FIX.seed).select("atom", "src_patch_id")


def dictionary_first_k(spark, sf_dir):
    return atoms(spark, sf_dir).select("atom", "src_patch_id")


def sparse_codes(spark, sf_dir):
    return C.edges(plain_codes(spark, sf_dir)).select("patch_id", "atom")


def sparse_codes_forced(spark, sf_dir):
    test = patches.normalise(patches.centred_patches(images(spark, sf_dir, "test"), SHAPE, 3, 8))
    return C.edges(C.sparse_codes(test, dictionary.matrix_of(atoms(spark, sf_dir)), FIX.gq_thresh, forced=True)).select("patch_id", "atom")


def zero_code_patches(spark, sf_dir):
    return C.zero_codes(plain_codes(spark, sf_dir)).select("patch_id")


def code_density(spark, sf_dir):
    return C.density(plain_codes(spark, sf_dir), K).select("patches", "active", _round("density", 9).alias("density"), _round("zero_share", 9).alias("zero_share"))


def codes_per_patch(spark, sf_dir):
    return plain_codes(spark, sf_dir).select("patch_id", F.size("atoms").alias("n"))


def codes_per_atom(spark, sf_dir):
    return C.edges(plain_codes(spark, sf_dir)).groupBy("atom").agg(F.count("*").alias("n"))


def coactivation_counts(spark, sf_dir):
    return moments.coactivation(plain_codes(spark, sf_dir))


def second_moment(spark, sf_dir):
    return moments.second_moment(plain_codes(spark, sf_dir)).select("i", "j", _round("v", 9).alias("v"))


def mirror_symmetric(spark, sf_dir):
    return moments.mirrored(moments.coactivation(plain_codes(spark, sf_dir)).withColumnRenamed("n", "v"))


def symmetry_check(spark, sf_dir):
    """The mirrored matrix less its last column shows what is missing."""
    full = mirror_symmetric(spark, sf_dir).withColumn("v", F.col("v").cast("double"))
    return moments.asymmetry(full.where(F.col("j") < K - 1))


def context_pairs(spark, sf_dir):
    return context.context_pairs(spark, P, 1)


def context_neighbor_count(spark, sf_dir):
    return context.live_neighbours(plain_codes(spark, sf_dir), 1)


def _loss(optim, radius):
    def query(spark, sf_dir):
        loss = context.context_loss(plain_codes(spark, sf_dir), optim, radius, P)
        return loss.select("i", "j", _round("v", 4).alias("v")).where("v <> 0")

    return query


def projection_apply(spark, sf_dir):
    return embedding.project(plain_codes(spark, sf_dir).select("patch_id", "atoms"), projection_table(), normalised=False)


def projection_join(spark, sf_dir):
    return embedding.project_by_join(plain_codes(spark, sf_dir), projection_frame(spark))


def embed_normalize(spark, sf_dir):
    return embedding.project(plain_codes(spark, sf_dir).select("patch_id", "atoms"), projection_table()).select("patch_id", _round_all("beta").alias("beta"))


def _pooled(spark, sf_dir):
    """Pools the patches themselves (their elements stand for an embedding)."""
    return pooling.average_pool(train_patches(spark, sf_dir).withColumnRenamed("vec", "beta"), P)


def avg_pool_4x2(spark, sf_dir):
    return _pooled(spark, sf_dir).select("image_id", "wr", "wc", _round_all("beta").alias("beta"))


def pool_l2_normalize(spark, sf_dir):
    return pooling.normalise_windows(_pooled(spark, sf_dir)).select("image_id", "wr", "wc", _round_all("beta").alias("beta"))


def image_vector_flatten(spark, sf_dir):
    flat = pooling.flatten_windows(pooling.normalise_windows(_pooled(spark, sf_dir)), 2)
    return flat.select("image_id", "label", _round_all("vec").alias("vec"))


def coo_to_csr(spark, sf_dir):
    return blocks.row_pointers(sparse_a(spark, sf_dir), 50)


def row_block_slice(spark, sf_dir):
    return blocks.row_slice(sparse_a(spark, sf_dir), 10, 20)


def column_block_slice(spark, sf_dir):
    return blocks.column_slices(sparse_a(spark, sf_dir), 60)


def column_block_transpose(spark, sf_dir):
    return blocks.column_slices(sparse_a(spark, sf_dir), 60, transpose=True)


def matmul_sparse_sparse(spark, sf_dir):
    return blocks.multiply(sparse_a(spark, sf_dir), sparse_b(spark, sf_dir))


def matmul_symmetric(spark, sf_dir):
    a = sparse_a(spark, sf_dir)
    return blocks.multiply(a, a.select(F.col("col").alias("row"), F.col("row").alias("col"), "v"), upper=True)


def matmul_dense_sparse(spark, sf_dir):
    n = F.col("id")
    dense = spark.range(2).select(n.alias("row"), F.transform(F.sequence(F.lit(0), F.lit(499)), lambda k: ((k * 3 + n) % 7).cast("double")).alias("vec"))
    return blocks.multiply_dense(dense, sparse_b(spark, sf_dir))


def stack_columns(spark, sf_dir):
    b = column_block_slice(spark, sf_dir).withColumnRenamed("block", "b")
    return blocks.stack_columns(b, 60)


# --- a whole fit -------------------------------------------------------------------------------------------------


def _matrix_frame(spark, m, names=("i", "j", "v")):
    rows = [(int(i), int(j), round(float(m[i, j]), 6) + 0.0) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return spark.createDataFrame(rows, f"{names[0]} int, {names[1]} int, {names[2]} double")


def whitening_matrix(spark, sf_dir):
    return _matrix_frame(spark, pipeline.whitening_of(augmented(spark, sf_dir), FIX, SHAPE))


def whiten_apply(spark, sf_dir):
    both = augmented(spark, sf_dir)
    return pipeline.prepared(both, FIX, SHAPE, pipeline.whitening_of(both, FIX, SHAPE)).select("patch_id", _round_all("vec").alias("vec"))


def inverse_sqrt_second_moment(spark, sf_dir):
    return _matrix_frame(spark, L.inverse_sqrt(moments.to_driver(moments.second_moment(plain_codes(spark, sf_dir)), K)))


def embedding_matrix(spark, sf_dir):
    return _matrix_frame(spark, pipeline.fit(images(spark, sf_dir, "train"), FIX).projection, ("e", "atom", "v"))


def patch_embedding(spark, sf_dir):
    train = images(spark, sf_dir, "train")
    return pipeline.fit(train, FIX).patch_embedding(I.augment(train, SHAPE)).select("patch_id", _round_all("beta").alias("beta"))


def image_embedding(spark, sf_dir):
    train = images(spark, sf_dir, "train")
    return pipeline.fit(train, FIX).transform(images(spark, sf_dir, "test"), test=True).select("image_id", "label", _round_all("vec").alias("vec"))


def pipeline_accuracy(spark, sf_dir):
    return pipeline.run(spark, sf_dir)


def pipeline_accuracy_one(spark, sf_dir):
    return pipeline.run(spark, sf_dir, Config.fixture(optim="one", context_sz=1))


NAMES = (
    "scan_filter_split hflip_augment grayscale_project patchify patch_key_decode context_mean_ctx1 context_mean_full center_patches l2_normalize patch_covariance "
    "similarity_threshold_join cosine_topk dictionary_greedy dictionary_first_k sparse_codes sparse_codes_forced zero_code_patches code_density codes_per_patch "
    "codes_per_atom coactivation_counts second_moment mirror_symmetric symmetry_check context_pairs context_neighbor_count projection_apply projection_join embed_normalize "
    "avg_pool_4x2 pool_l2_normalize image_vector_flatten knn_topk knn_vote knn_predict knn_class_ranks knn_accuracy coo_to_csr row_block_slice column_block_slice column_block_transpose "
    "matmul_sparse_sparse matmul_symmetric matmul_dense_sparse stack_columns whitening_matrix whiten_apply inverse_sqrt_second_moment embedding_matrix patch_embedding image_embedding "
    "pipeline_accuracy pipeline_accuracy_one"
).split()


def queries() -> dict[str, Query]:
    out = {name: globals()[name] for name in NAMES}
    for optim in ("one", "two"):
        out[f"loss_{optim}_ctx1"], out[f"loss_{optim}_full"] = _loss(optim, 1), _loss(optim, 8)
    return out
