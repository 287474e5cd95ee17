"""Stages against numpy brute force, invariants, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlens.config import Config
from patchlens.functions import linalg as L
from patchlens.functions import vectors as V
from patchlens.operators import blocks, codes, context, dictionary, embedding, knn, moments, patches, pooling
from patchlens.plans import pipeline
from patchlens.sources import images as I

from .conftest import SF

COLOUR = I.Shape(5, 5, 3)


def _images(spark, x, shape_ok=True):
    rows = [(i, "train", i % 3, v.ravel().tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "image_id long, split string, label int, pixels array<double>")


def _codes(spark, code, image_id, r, c):
    rows = [(k, int(image_id[k]), int(r[k]), int(c[k]), np.flatnonzero(code[k]).tolist()) for k in range(len(code))]
    return spark.createDataFrame(rows, "patch_id long, image_id long, r int, c int, atoms array<int>")


@pytest.fixture(scope="module")
def colour():
    return np.random.default_rng(1).random((4, 5, 5, 3))


def test_patch_order_and_keys(spark, colour):
    out = patches.patchify(_images(spark, colour), COLOUR, 2).orderBy("patch_id").collect()
    assert len(out) == 4 * 16
    for row in out:
        want = colour[row.image_id, row.r : row.r + 2, row.c : row.c + 2].ravel()
        assert np.array_equal(row.vec, want)
        assert row.patch_id == (row.image_id * 4 + row.r) * 4 + row.c


def test_flip_keeps_channels(spark, colour):
    out = {r.image_id: r for r in I.augment(_images(spark, colour), COLOUR).collect()}
    for i in range(4):
        assert np.array_equal(out[2 * i].pixels, colour[i].ravel())
        assert np.array_equal(out[2 * i + 1].pixels, colour[i][:, ::-1].ravel())
        assert out[2 * i + 1].label == i % 3


def test_grayscale(spark, colour):
    out = I.grayscale(_images(spark, colour)).orderBy("image_id").collect()
    assert np.allclose([r.pixels for r in out], (colour @ np.array(I.LUMA)).reshape(4, -1))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 9])
def test_context_mean(spark, colour, radius):
    df = _images(spark, colour)
    got = {r.patch_id: r.vec for r in patches.centred_patches(df, COLOUR, 2, radius).collect()}
    for i in range(4):
        p = np.array([[colour[i, r : r + 2, c : c + 2].ravel() for c in range(4)] for r in range(4)])
        for r in range(4):
            for c in range(4):
                near = p[max(0, r - radius) : r + radius + 1, max(0, c - radius) : c + radius + 1]
                assert np.allclose(got[(i * 4 + r) * 4 + c], p[r, c] - near.mean())


def test_covariance_and_whitening(spark, colour):
    df = patches.patchify(_images(spark, colour), COLOUR, 2)
    x = np.array([r.vec for r in df.collect()])
    cov = moments.to_driver(moments.covariance(df), 12)
    assert np.allclose(cov, np.cov(x.T))
    w = L.inverse_sqrt(cov, 1e-3)
    assert np.allclose(w @ (cov + 1e-3 * np.eye(12)) @ w, np.eye(12))
    out = patches.normalise(patches.whiten(df, w)).orderBy("patch_id").collect()
    z = np.array([r.vec for r in df.orderBy("patch_id").collect()]) @ w
    assert np.allclose([r.vec for r in out], z / np.linalg.norm(z, axis=1, keepdims=True))


def test_constant_image_gives_uniform_unit_vectors(spark):
    df = _images(spark, np.full((1, 5, 5, 1), 0.25))
    out = patches.normalise(patches.centred_patches(df, I.Shape(5, 5, 1), 2, 9)).collect()
    assert np.allclose([r.vec for r in out], 0.5)


def test_linear_algebra():
    rng = np.random.default_rng(2)
    m = rng.normal(size=(6, 9))
    m = m @ m.T
    assert np.allclose(L.fractional_power(m, 0.5) @ L.fractional_power(m, 0.5), m)
    assert np.allclose(L.mirror_upper(np.triu(m)), m)
    assert L.is_symmetric(m) and not L.is_symmetric(np.triu(m)) and not L.is_symmetric(m * 1j)
    with pytest.raises(ValueError):
        L.fractional_power(np.triu(m), 0.5)
    with pytest.raises(ValueError):
        L.inverse_sqrt(np.zeros((3, 3)), 0.0)
    values, u = L.smallest_eigenvectors(m, 3, 2)
    assert np.allclose(u @ u.T, np.eye(3)) and np.all(np.diff(values) >= 0) and np.allclose(u @ m, values[:, None] * u)
    assert (u[np.arange(3), np.abs(u).argmax(1)] > 0).all()
    with pytest.raises(ValueError):
        L.smallest_eigenvectors(m, 5, 2)


def _greedy(x, order, size, threshold):
    kept = []
    for k in order:
        if all(x[k] @ x[j] <= threshold for j in kept):
            kept.append(k)
            if len(kept) == size:
                break
    return kept


@pytest.mark.parametrize("batch", [7, 4000])
def test_greedy_dictionary(spark, monkeypatch, batch):
    import hashlib

    monkeypatch.setattr(dictionary, "BATCH", batch)
    x = np.random.default_rng(3).normal(size=(200, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "patch_id long, vec array<double>")
    order = sorted(range(200), key=lambda i: (hashlib.md5(f"7-{i}".encode()).hexdigest(), i))
    got = [r.src_patch_id for r in dictionary.greedy(df.repartition(5), 12, 0.5, 7).orderBy("atom").collect()]
    assert got == _greedy(x, order, 12, 0.5)
    with pytest.raises(ValueError):
        dictionary.greedy(df, 100, 0.0, 7)


def test_sparse_codes(spark):
    rng = np.random.default_rng(4)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(n, 6)))
    x, phi = unit(50), unit(9)
    x[0], x[1] = phi[3], -phi[2]
    rows = [(i, i // 9, i % 9 // 3, i % 3, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "patch_id long, image_id long, r int, c int, vec array<double>")
    cosine = x @ phi.T
    for forced in (False, True):
        on = cosine >= 0.6
        if forced:
            on[np.arange(50), cosine.argmax(1)] = True
        out = codes.sparse_codes(df, phi, 0.6, forced)
        assert {r.patch_id: r.atoms for r in out.collect()} == {i: np.flatnonzero(on[i]).tolist() for i in range(50)}
        assert codes.zero_codes(out).count() == (~on.any(1)).sum()
        d = codes.density(out, 9).first()
        assert (d.patches, d.active) == (50, on.sum()) and d.density == pytest.approx(on.mean())
    assert codes.sparse_codes(df.limit(0), phi, 0.6).count() == 0


@pytest.fixture(scope="module")
def grid_codes():
    """Three images of 4 x 4 patches: many dead patches, an isolated live one, one image with a single live patch, one dead."""
    rng = np.random.default_rng(5)
    image_id, pos = np.repeat(np.arange(4), 16), np.tile(np.arange(16), 4)
    code = rng.random((64, 6)) < 0.25
    code[rng.random(64) < 0.3] = False
    code[32:48] = False
    code[32 + 5, 2] = True
    code[48:] = False
    return code.astype(float), image_id, pos // 4, pos % 4


def _loss(code, image_id, r, c, optim, radius):
    live = code.any(1)
    total = np.zeros((code.shape[1],) * 2)
    for p in np.flatnonzero(live):
        near = [q for q in np.flatnonzero(live) if q != p and image_id[q] == image_id[p] and abs(r[q] - r[p]) <= radius and abs(c[q] - c[p]) <= radius]
        if optim == "two" and near:
            y = code[p] - code[near].mean(0)
            total += np.outer(y, y)
        elif optim == "one":
            for q in near:
                if q > p:
                    total += np.outer(code[p] - code[q], code[p] - code[q])
    return total


@pytest.mark.parametrize("optim", ["one", "two"])
@pytest.mark.parametrize("radius", [1, 2, 3, 9])
def test_context_loss(spark, grid_codes, optim, radius):
    got = moments.to_driver(context.context_loss(_codes(spark, *grid_codes), optim, radius, 4), 6)
    want = _loss(*grid_codes, optim, radius)
    assert np.isfinite(got).all() and np.allclose(got, want) and np.abs(want).max() > 0
    assert np.linalg.eigvalsh(got).min() > -1e-9
    assert not np.allclose(got, _loss(*grid_codes, optim, 0))


def test_context_graph(spark, grid_codes):
    pairs = {tuple(x) for x in context.context_pairs(spark, 4, 1).collect()}
    assert pairs == {(a, b) for a in range(16) for b in range(a + 1, 16) if abs(a // 4 - b // 4) <= 1 and abs(a % 4 - b % 4) <= 1}
    code, image_id, r, c = grid_codes
    live = code.any(1)
    want = {}
    for p in np.flatnonzero(live):
        n = sum(live[q] and q != p and image_id[q] == image_id[p] and abs(r[q] - r[p]) <= 1 and abs(c[q] - c[p]) <= 1 for q in range(64))
        if n:
            want[p] = n
    assert {x.patch_id: x.n for x in context.live_neighbours(_codes(spark, *grid_codes), 1).collect()} == want


def test_second_moment(spark, grid_codes):
    code = grid_codes[0]
    df = moments.second_moment(_codes(spark, *grid_codes))
    assert np.allclose(moments.to_driver(df, 6), code.T @ code / 64)
    full = moments.mirrored(df)
    assert moments.asymmetry(full).first()[0] == 0 and moments.asymmetry(full.where("i <= j")).first()[0] > 0


def test_projection_and_pooling(spark, grid_codes):
    code, image_id, r, c = grid_codes
    p = np.random.default_rng(6).normal(size=(3, 6))
    df = _codes(spark, *grid_codes)
    out = embedding.project(df.withColumn("label", F.col("image_id").cast("int")), p)
    beta = code @ p.T
    beta = beta / (np.linalg.norm(beta, axis=1, keepdims=True) + 1e-20)
    assert np.allclose([x.beta for x in out.orderBy("patch_id").collect()], beta)
    table = spark.createDataFrame([(e, k, float(p[e, k])) for e in range(3) for k in range(6)], "e int, atom int, v double")
    joined = {(x.patch_id, x.e): x.v for x in embedding.project_by_join(df, table).collect()}
    assert all(joined[k, e] == pytest.approx(v) for k in range(64) if code[k].any() for e, v in enumerate(code[k] @ p.T))
    pooled = pooling.normalise_windows(pooling.average_pool(out, 4, size=2, stride=1))
    vec = {x.image_id: x.vec for x in pooling.flatten_windows(pooled, pooling.windows(4, 2, 1)).collect()}
    for i in range(4):
        grid = beta[image_id == i].reshape(4, 4, 3)
        want = np.array([[grid[a : a + 2, b : b + 2].mean((0, 1)) for b in range(3)] for a in range(3)])
        want /= np.linalg.norm(want, axis=2, keepdims=True) + 1e-20
        assert np.allclose(vec[i], want.transpose(2, 0, 1).ravel())


def _knn(train, labels, test, test_labels, k, t, classes):
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (train, test))
    sims = y @ x.T
    one = five = 0
    first = min(5, k, len(set(test_labels)))
    for q in range(len(y)):
        top = sorted(range(len(x)), key=lambda i: (-sims[q, i], i))[:k]
        weight = {c: sum(np.exp(sims[q, i] / t) for i in top if labels[i] == c) for c in classes}
        order = sorted(classes, key=lambda c: (-weight[c], c))
        one += order[0] == test_labels[q]
        five += test_labels[q] in order[:first]
    return 100 * one / len(y), 100 * five / len(y), len(y)


@pytest.mark.parametrize("k", [1, 5, 500])
def test_knn(spark, k):
    rng = np.random.default_rng(7)
    train, test = rng.normal(size=(90, 8)), rng.normal(size=(30, 8))
    labels, test_labels = rng.integers(0, 7, 90), rng.integers(0, 8, 30)
    frame = lambda x, y: spark.createDataFrame([(i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y))], "image_id long, label int, vec array<double>")
    a, b = frame(train, labels), frame(test, test_labels)
    assert tuple(knn.classify(a, b, k, 0.03).first()) == pytest.approx(_knn(train, labels, test, test_labels, k, 0.03, sorted({*labels.tolist(), *test_labels.tolist()})))
    pick = lambda df: [(r.query_id, r.neighbour_id, r["rank"]) for r in df.orderBy("query_id", "rank").collect()]
    assert pick(knn.top_k(a, b, k)) == pick(knn.top_k_by_functions(a, b, k))
    same = knn.top_k(a, a, 1).where("query_id = neighbour_id").count()
    assert same == 90


def test_sparse_blocks(spark):
    rng = np.random.default_rng(8)
    a, b = (np.where(rng.random(s) < 0.1, rng.integers(1, 9, s), 0).astype(float) for s in ((20, 50), (50, 12)))
    a[3] = 0
    frame = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "row long, col long, v double")
    dense = lambda df, s: (lambda out, rows: [out.__setitem__((r.row, r.col), r.v) for r in rows] and out)(np.zeros(s), df.collect())
    fa, fb = frame(a), frame(b)
    assert np.array_equal(dense(blocks.multiply(fa, fb), (20, 12)), a @ b)
    assert np.array_equal(dense(blocks.multiply(fa, frame(a.T), upper=True), (20, 20)), np.triu(a @ a.T))
    x = rng.integers(0, 9, (2, 50)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row long, vec array<double>")
    assert np.array_equal(dense(blocks.multiply_dense(rows, fb), (2, 12)), x @ b)
    nnz = (a != 0).sum(1)
    assert [(r.row, r.start, r.nnz) for r in blocks.row_pointers(fa, 20).orderBy("row").collect()] == list(zip(range(20), (np.cumsum(nnz) - nnz).tolist(), nnz.tolist()))
    cut = blocks.column_slices(fa, 15)
    assert np.array_equal(dense(cut.where("block = 3"), (20, 5)), a[:, 45:])
    assert np.array_equal(dense(blocks.column_slices(fa, 15, transpose=True).where("block = 1"), (15, 20)), a[:, 15:30].T)
    assert np.array_equal(dense(blocks.stack_columns(cut.withColumnRenamed("block", "b"), 15), (20, 50)), a)
    assert np.array_equal(dense(blocks.row_slice(fa, 5, 9), (4, 50)), a[5:9])


@pytest.mark.parametrize("optim,radius", [("two", 8), ("one", 1)])
def test_fit_save_stream(spark, tmp_path, optim, radius):
    config = Config.fixture(optim=optim, context_sz=radius)
    rows = I.read_fixture(spark, SF)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    model = pipeline.fit(train, config)
    gram = model.dictionary @ model.dictionary.T
    assert np.allclose(np.diag(gram), 1) and (gram - 2 * np.eye(64)).max() <= config.dict_thresh
    assert model.projection.shape == (16, 64) and np.isfinite(model.projection).all()
    model.save(spark, str(tmp_path / "model"))
    again = pipeline.Model.load(spark, str(tmp_path / "model"))
    assert again.config == config and np.array_equal(again.projection, model.projection)
    vec = {r.image_id: r.vec for r in again.transform(test, test=True).collect()}
    assert len(vec) == 100 and all(len(v) == 64 for v in vec.values())
    assert np.allclose([np.linalg.norm(v) for v in vec.values()], 2)  # four unit windows
    score = again.evaluate(train, test).first()
    assert score.total == 100 and 0 <= score.top1 <= score.top5 <= 100
    if radius == 8:
        from patchlens.streaming import embed

        test.select("image_id", "split", "label", "pixels").write.parquet(str(tmp_path / "in"))
        stream = embed.read_images(spark, str(tmp_path / "in"))
        embed.write_image_vectors(again, stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        got = {r.image_id: r.vec for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got.keys() == vec.keys() and all(np.allclose(got[k], vec[k]) for k in vec)
        assert embed.embed_patches(again, stream).isStreaming


def test_config():
    with pytest.raises(ValueError):
        Config(dict_sz=20, embed_dim=16)
    with pytest.raises(ValueError):
        Config(optim="three")
    with pytest.raises(NotImplementedError):
        I.shape_of("other")
    assert Config().skip == 16 and Config(disable_color_embed_drop=True).skip == 1 and I.shape_of("cifar10", True).channels == 1


def test_tables(spark, tmp_path):
    df = spark.range(3)
    I.write_matrix(df, str(tmp_path / "t"))
    I.append_matrix(df, str(tmp_path / "t"))
    assert I.read_matrix(spark, str(tmp_path / "t")).count() == 6
    with pytest.raises(Exception, match="(?i)exists"):
        I.write_matrix(df, str(tmp_path / "t"))


def test_vectors(spark):
    a, b = F.array(*map(F.lit, (3.0, 4.0))), F.array(*map(F.lit, (1.0, -2.0)))
    r = spark.range(1).select(V.dot(a, b).alias("d"), V.norm(a).alias("n"), V.add(a, b).alias("s"), V.subtract(a, b).alias("m"), V.argmax(a).alias("x"), V.scale(a, 2.0).alias("t"), V.damped_unit(F.array(F.lit(0.0))).alias("z")).first()
    assert (r.d, r.n, r.s, r.m, r.x, r.t, r.z) == (-5.0, 5.0, [4.0, 2.0], [2.0, 6.0], 1, [6.0, 8.0], [0.0])
