"""Readers of the public image sets in their published binary forms, as image tables with dense ids (0, 1, ...) in each split.

* colour images of 32 x 32: ``data_batch_*.bin`` and ``test_batch.bin``, records of a label byte and three planes;
* digits of 28 x 28: ``train-images-idx3-ubyte`` and ``train-labels-idx1-ubyte`` (``t10k-...`` for the test split), gzipped or not.

Files are read by Spark, so any store that it reaches will do; a file is one task's, and its records leave it in small batches.
"""

from __future__ import annotations

import gzip

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = 512
CIFAR_RECORD = 1 + 3 * 32 * 32
#: The first numbers of idx files of images and of labels.
IDX_IMAGES, IDX_LABELS = 2051, 2049


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def _list(values: np.ndarray) -> pa.ListArray:
    """A list a row of a matrix."""
    ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(values.ravel()))


def read_cifar10(spark: SparkSession, path: str, split: str) -> DataFrame:
    """image_id, split, label, pixels (row by row, channels fastest, 0 to 1)."""
    files = _files(spark, path, "data_batch_*.bin" if split == "train" else "test_batch.bin")
    # a handful of files: where each one's records begin
    sizes = sorted((r["path"], r["length"]) for r in files.select("path", "length").collect())
    if not sizes or any(n % CIFAR_RECORD for _, n in sizes):
        raise ValueError(f"no whole records of {CIFAR_RECORD} bytes under {path}")
    starts, at = {}, 0
    for name, n in sizes:
        starts[name] = at
        at += n // CIFAR_RECORD

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                records = np.frombuffer(data, np.uint8).reshape(-1, CIFAR_RECORD)
                for a in range(0, len(records), BATCH):
                    part = records[a : a + BATCH]
                    pixels = part[:, 1:].reshape(-1, 3, 1024).transpose(0, 2, 1).reshape(len(part), -1) / 255.0
                    ids = starts[name] + a + np.arange(len(part), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([split] * len(part)), pa.array(part[:, 0].astype(np.int32)), _list(pixels)], ["image_id", "split", "label", "pixels"])

    return files.select("path", "content").mapInArrow(run, "image_id long, split string, label int, pixels array<double>")


def _idx(data: bytes, magic: int, header: int) -> np.ndarray:
    """The bytes behind the header of an idx file, as many as it says."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    numbers = np.frombuffer(data, ">i4", header)
    body = np.frombuffer(data, np.uint8, offset=4 * header)
    if numbers[0] != magic or len(body) != np.prod(numbers[1:], dtype=np.int64):
        raise ValueError("not an idx file of this kind")
    return body.reshape(int(numbers[1]), -1)


def read_mnist(spark: SparkSession, path: str, split: str) -> DataFrame:
    """image_id, split, label, pixels (row by row, 0 to 1)."""
    name = "train" if split == "train" else "t10k"

    def images(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                body = _idx(data, IDX_IMAGES, 4)
                for a in range(0, len(body), BATCH):
                    part = body[a : a + BATCH]
                    yield pa.RecordBatch.from_arrays([pa.array(a + np.arange(len(part), dtype=np.int64)), _list(part / 255.0)], ["image_id", "pixels"])

    def labels(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                body = _idx(data, IDX_LABELS, 2)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(body), dtype=np.int64)), pa.array(body.astype(np.int32))], ["image_id", "label"])

    left = _files(spark, path, f"{name}-images?idx3-ubyte*").select("content").mapInArrow(images, "image_id long, pixels array<double>")
    right = _files(spark, path, f"{name}-labels?idx1-ubyte*").select("content").mapInArrow(labels, "image_id long, label int")
    return left.join(right, "image_id").select("image_id", F.lit(split).alias("split"), "label", "pixels")


def read(spark: SparkSession, dataset: str, path: str, split: str) -> DataFrame:
    """One split of a data set by name."""
    readers = {"cifar10": read_cifar10, "mnist": read_mnist}
    if dataset not in readers or split not in ("train", "test"):
        raise NotImplementedError(f"{dataset}, {split}")
    return readers[dataset](spark, path, split)
