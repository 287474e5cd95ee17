"""Readers of public image sets from written files, parameters that select and convert images, and the command line."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlens import __main__ as command
from patchlens.config import Config
from patchlens.operators import codes, context, moments
from patchlens.plans import pipeline
from patchlens.sources import datasets
from patchlens.sources import images as I


@pytest.fixture(scope="module")
def colour_files(tmp_path_factory):
    """Two batches of 20 and one of 12 colour images in the published binary form: (folder, labels, images by split)."""
    folder, rng, kept = tmp_path_factory.mktemp("colour"), np.random.default_rng(1), {"train": [], "test": []}
    for name, n, split in (("data_batch_1", 20, "train"), ("data_batch_2", 20, "train"), ("test_batch", 12, "test")):
        labels = rng.integers(0, 3, n).astype(np.uint8)
        planes = rng.integers(0, 256, (n, 3, 32, 32)).astype(np.uint8)
        planes[:, 0, :16] = np.clip(planes[:, 0, :16] // 8 + 70 * labels[:, None, None], 0, 255)
        (folder / f"{name}.bin").write_bytes(b"".join(bytes([y]) + x.tobytes() for y, x in zip(labels, planes)))
        kept[split] += list(zip(labels.tolist(), planes))
    return str(folder), kept


def test_colour_images(spark, colour_files):
    folder, kept = colour_files
    for split, n in (("train", 40), ("test", 12)):
        rows = datasets.read(spark, "cifar10", folder, split).orderBy("image_id").collect()
        assert [r.image_id for r in rows] == list(range(n)) and {r.split for r in rows} == {split}
        assert [r.label for r in rows] == [y for y, _ in kept[split]]
        assert np.allclose([r.pixels for r in rows], [x.transpose(1, 2, 0).ravel() / 255 for _, x in kept[split]])
    with pytest.raises(ValueError):
        datasets.read(spark, "cifar10", folder + "/..", "train").count()
    with pytest.raises(NotImplementedError):
        datasets.read(spark, "other", folder, "train")


@pytest.mark.parametrize("packed", [False, True])
def test_digits(spark, tmp_path, packed):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 256, (600, 28, 28)).astype(np.uint8), rng.integers(0, 10, 600).astype(np.uint8)
    pack, end = (gzip.compress, ".gz") if packed else (bytes, "")
    (tmp_path / f"train-images-idx3-ubyte{end}").write_bytes(pack(struct.pack(">4i", 2051, 600, 28, 28) + x.tobytes()))
    (tmp_path / f"train-labels-idx1-ubyte{end}").write_bytes(pack(struct.pack(">2i", 2049, 600) + y.tobytes()))
    rows = datasets.read(spark, "mnist", str(tmp_path), "train").orderBy("image_id").collect()
    assert [r.image_id for r in rows] == list(range(600)) and [r.label for r in rows] == y.tolist()
    assert np.allclose([r.pixels for r in rows], x.reshape(600, -1) / 255)


def test_grey_only_converts_pixels(spark, colour_files):
    folder, kept = colour_files
    train = datasets.read(spark, "cifar10", folder, "train")
    grey = I.as_configured(train, "cifar10", True)
    want = [x.transpose(1, 2, 0).reshape(-1, 3) @ np.array(I.LUMA) / 255 for _, x in kept["train"]]
    assert np.allclose([r.pixels for r in grey.orderBy("image_id").collect()], want)
    again = I.as_configured(grey, "cifar10", True)
    assert np.allclose([r.pixels for r in again.orderBy("image_id").collect()], want)
    assert I.as_configured(train, "cifar10", False) is train


def test_samples_are_the_smallest_ids(spark):
    df = spark.range(5, 40).select((F.col("id") * 3).alias("image_id"))
    assert sorted(r.image_id for r in I.first_samples(df, 4).collect()) == [15, 18, 21, 24]
    assert I.first_samples(df, 35).count() == I.first_samples(df, 99).count() == 35


SMALL = "--patch-sz 14 --dict-sz 40 --dict_thresh 0.95 --gq_thresh 0.05 --embed-dim 8 --nnclass-k 5 --inner_chunk 64".split()


def test_command_line_on_grey_images(spark, colour_files, tmp_path):
    """From files to accuracy, with a part of the samples and pixels converted; the saved model has the grey patches' size."""
    args = ["--dataset", "cifar10", "--dataset-path", colour_files[0], "--samples", "30", "--test-samples", "10", "--grayscale_only", "--model", str(tmp_path / "model"), "--result", str(tmp_path / "result"), *SMALL]
    top1, top5, total = command.main(args)
    assert total == 10 and 0 <= top1 <= top5 <= 100
    model = pipeline.Model.load(spark, str(tmp_path / "model"))
    assert model.whitening.shape == (14 * 14, 14 * 14) and model.config.samples == 30 and model.config.grayscale_only
    assert spark.read.parquet(str(tmp_path / "result")).first()["total"] == 10


def _bmp(image):
    h, w, _ = image.shape
    body = b"".join(line[:, ::-1].tobytes() + b"\0" * (-3 * w % 4) for line in image[::-1])
    head = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, 0, 0, 0, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + head + body


def test_image_files_have_dense_ids(spark, tmp_path, monkeypatch):
    """Their ids can be doubled, multiplied and compared with a number of samples, from files to patches."""
    monkeypatch.setattr(I, "BUCKET", 4)
    rng = np.random.default_rng(3)
    made = {}
    for k in range(11):
        (tmp_path / str(k % 3)).mkdir(exist_ok=True)
        image = rng.integers(0, 256, (8, 8, 3)).astype(np.uint8)
        (tmp_path / str(k % 3) / f"i{k}.bmp").write_bytes(_bmp(image))
        made[k] = image
    rows = I.read_files(spark, str(tmp_path) + "/*")
    found = rows.collect()
    assert sorted(r.image_id for r in found) == list(range(11)) and sorted(r.label for r in found) == sorted(k % 3 for k in range(11))
    assert sorted(tuple(np.round(np.array(r.pixels) * 255).astype(int)) for r in found) == sorted(tuple(v.ravel().tolist()) for v in made.values())
    assert I.take_first(rows, "train", 5).count() == 5
    from patchlens.operators import patches

    shape = I.Shape(8, 8, 3)
    ids = [r.patch_id for r in patches.patchify(I.augment(rows, shape), shape, 3).select("patch_id").collect()]
    assert len(ids) == len(set(ids)) == 11 * 2 * 36


def test_sums_of_many_atoms(spark):
    """2,048 atoms, patches of 108 numbers: blocks of several a side, against numpy."""
    rng = np.random.default_rng(4)
    n, k, d = 3000, 2048, 108
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x, phi = unit(rng.normal(size=(n, d))), unit(rng.normal(size=(k, d)))
    rows = [(i, i // 25, i % 25 // 5, i % 5, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "patch_id long, image_id long, r int, c int, vec array<double>").repartition(3)
    made = codes.sparse_codes(df, phi, 0.18).persist()
    on = (x @ phi.T >= 0.18).astype(float)
    assert 0.01 < on.mean() < 0.1
    assert np.allclose(moments.to_driver(moments.coactivation(made).withColumnRenamed("n", "v"), k), on.T @ on)
    assert np.allclose(moments.to_driver(moments.second_moment(made), k), on.T @ on / n)
    live = on.reshape(-1, 25, k)
    assert (on.sum(1) > 0).all()
    two = sum((25 / 24) ** 2 * (g.T @ g - np.outer(g.sum(0), g.sum(0)) / 25) for g in live)
    assert np.allclose(moments.to_driver(context.full_context_loss(made, "two"), k), two, atol=1e-6)
    made.unpersist()


def test_second_moment_of_nothing(spark):
    empty = spark.createDataFrame([], "patch_id long, image_id long, r int, c int, atoms array<int>")
    assert moments.coactivation(empty).count() == 0 and moments.second_moment(empty).count() == 0
    assert context.full_context_loss(empty, "one").count() == 0 and context.live_neighbours(empty, 1).count() == 0


def test_long_vectors_are_normalised_in_proportion(spark):
    """The length is worked out once a row: 1,600 numbers cost about 16 times what 100 cost, not 256 times."""
    from patchlens.functions import vectors as V

    import time

    took = {}
    for d in (100, 1600):
        df = spark.range(3000).select(F.transform(F.sequence(F.lit(1), F.lit(d)), lambda k: (k + F.col("id")).cast("double")).alias("v"))
        out = df.select(V.unit(F.col("v")).alias("v"))
        assert all(abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in out.limit(3).collect())
        began = time.perf_counter()
        out.write.format("noop").mode("overwrite").save()
        took[d] = time.perf_counter() - began
    assert took[1600] < 60 * max(took[100], 0.2)


def test_config_rejects_what_cannot_be():
    with pytest.raises(ValueError):
        Config(samples=0)
