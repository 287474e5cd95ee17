"""Fit on training images, embed any images, evaluate on test images.

Fitting has four actions whose results fit the driver: the patches' covariance (d x d), the dictionary (K x d), co-activation
counts and the loss matrix (K x K); two eigen-decompositions follow. Embedding is a scan: patches, codes and projections keep
their rows, and only pooling shuffles.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import linalg as L
from ..operators import codes as C
from ..operators import context, dictionary, embedding, knn, moments, patches, pooling
from ..sources import images as I


@dataclass
class Model:
    """What fitting leaves: whitening (d x d), dictionary (K x d), projection (E x K)."""

    config: Config
    whitening: np.ndarray
    dictionary: np.ndarray
    projection: np.ndarray

    @property
    def shape(self) -> I.Shape:
        return I.shape_of(self.config.dataset, self.config.grayscale_only)

    @property
    def grid(self) -> int:
        return patches.grid_size(self.shape, self.config.patch_sz)

    def patch_vectors(self, images: DataFrame) -> DataFrame:
        grey = I.as_configured(images, self.config.dataset, self.config.grayscale_only)
        return prepared(grey, self.config, self.shape, self.whitening)

    def codes(self, images: DataFrame, test: bool = False) -> DataFrame:
        return C.sparse_codes(self.patch_vectors(images), self.dictionary, self.config.gq_thresh, forced=test or self.config.zero_code_disable)

    def patch_embedding(self, images: DataFrame, test: bool = False) -> DataFrame:
        return embedding.project(self.codes(images, test), self.projection)

    def transform(self, images: DataFrame, test: bool = False) -> DataFrame:
        """(image_id, label, vec): pooled, normalised by window, flattened."""
        c = self.config
        pooled = pooling.normalise_windows(pooling.average_pool(self.patch_embedding(images, test), self.grid, c.pool_size, c.pool_stride))
        return pooling.flatten_windows(pooled, pooling.windows(self.grid, c.pool_size, c.pool_stride))

    def evaluate(self, train: DataFrame, test: DataFrame) -> DataFrame:
        """top1, top5, total of the vote of train's (augmented) embeddings on test's, of as many samples as configured."""
        c = self.config
        train, test = (I.as_configured(I.first_samples(x, n), c.dataset, c.grayscale_only) for x, n in ((train, c.samples), (test, c.test_samples)))
        return knn.classify(self.transform(I.augment(train, self.shape)), self.transform(test, test=True), c.nnclass_k, c.knn_temp)

    def save(self, spark: SparkSession, path: str, overwrite: bool = False) -> None:
        """A Parquet table of named rows, written by Spark, so any store that it reaches will do."""
        rows = [(name, k, row.tolist()) for name in ("whitening", "dictionary", "projection") for k, row in enumerate(getattr(self, name))]
        df = spark.createDataFrame([*rows, (json.dumps(asdict(self.config)), -1, [])], "name string, k int, row array<double>")
        I.write_matrix(df.coalesce(1), path, overwrite)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        rows = I.read_matrix(spark, path).orderBy("name", "k").collect()
        config = next(json.loads(r["name"]) for r in rows if r["k"] < 0)
        return cls(Config(**config), *(np.array([r["row"] for r in rows if r["name"] == n]) for n in ("whitening", "dictionary", "projection")))


def centred(images: DataFrame, config: Config, shape: I.Shape) -> DataFrame:
    return patches.centred_patches(images, shape, config.patch_sz, config.context_sz)


def prepared(images: DataFrame, config: Config, shape: I.Shape, whitening: np.ndarray) -> DataFrame:
    """Patches after centring, whitening and normalising."""
    return patches.normalise(patches.whiten(centred(images, config, shape), whitening))


def whitening_of(images: DataFrame, config: Config, shape: I.Shape) -> np.ndarray:
    dim = config.patch_sz**2 * shape.channels
    return L.inverse_sqrt(moments.to_driver(moments.covariance(centred(images, config, shape)), dim), config.whiten_tol)


def fit(train: DataFrame, config: Config) -> Model:
    """A model of the configured number of training images (without their mirror images, which are added here)."""
    shape = I.shape_of(config.dataset, config.grayscale_only)
    both = I.augment(I.as_configured(I.first_samples(train, config.samples), config.dataset, config.grayscale_only), shape)
    whitening = whitening_of(both, config, shape)
    vectors = prepared(both, config, shape, whitening)
    atoms = dictionary.matrix_of(dictionary.greedy(vectors, config.dict_sz, config.dict_thresh, config.seed))
    codes = C.sparse_codes(vectors, atoms, config.gq_thresh, config.zero_code_disable).persist()
    try:
        second = moments.to_driver(moments.second_moment(codes), config.dict_sz)
        inner = moments.to_driver(context.context_loss(codes, config.optim, config.context_sz, patches.grid_size(shape, config.patch_sz)), config.dict_sz)
    finally:
        codes.unpersist()
    projection, _, _ = embedding.solve(second, inner, config.embed_dim, config.skip, config.cov_tol)
    return Model(config, whitening, atoms, projection)


def run(spark: SparkSession, sf_dir: str, config: Config | None = None) -> DataFrame:
    """Fit and evaluate on the fixture."""
    config = config or Config.fixture()
    images = I.read_fixture(spark, sf_dir)
    train, test = images.where(F.col("split") == "train"), images.where(F.col("split") == "test")
    return fit(train, config).evaluate(train, test)
