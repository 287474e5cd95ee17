"""The checks' SQL: every query of ``queries`` that SQL can express, over the same tables, for DuckDB."""

from __future__ import annotations

import re

from .queries import DIM, FIX, K, P, RAW_ATOMS, RAW_DICT_THRESHOLD, RAW_THRESHOLD, T


def dot(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]), lambda s, t: s + t)"


def rounded(v: str) -> str:
    return f"list_transform({v}, lambda x: round(x, 6) + 0.0)"


#: Common table expressions by name, each after those it reads.
STEPS = {
    "images": "SELECT vec_id AS image_id, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, label, CAST(embedding AS DOUBLE[]) AS pixels FROM embeddings WHERE len(embedding) = 64",
    "aug": "SELECT image_id * 2 + flip AS image_id, flip, label, CASE WHEN flip = 0 THEN pixels ELSE list_transform(range(0, 64), lambda k: pixels[(k // 8) * 8 + 8 - k % 8]) END AS pixels FROM images, (VALUES (0), (1)) f(flip) WHERE split = 'train'",
    "patches": f"SELECT (image_id * {P} + r) * {P} + c AS patch_id, image_id, label, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, list_transform(range(0, {DIM}), lambda k: pixels[(r + k // 3) * 8 + c + k % 3 + 1]) AS vec FROM aug, range(0, {P}) a(r), range(0, {P}) b(c)",
    "means": f"SELECT image_id, sum(list_sum(vec)) / {P * P * DIM} AS mu FROM patches GROUP BY image_id",
    "centred": "SELECT patch_id, image_id, r, c, list_transform(vec, lambda x: x - mu) AS vec FROM patches JOIN means USING (image_id)",
    "lifted": "SELECT patch_id, image_id, r, c, list_transform(vec, lambda x: x + 1e-20) AS vec FROM centred",
    "lengths": f"SELECT *, sqrt({dot('vec', 'vec')}) AS n FROM lifted",
    "units": "SELECT patch_id, image_id, r, c, list_transform(vec, lambda x: x / n) AS vec FROM lengths",
    "dict": f"SELECT CAST(row_number() OVER (ORDER BY md5('{FIX.seed}-' || patch_id), patch_id) - 1 AS INTEGER) AS atom, patch_id AS src_patch_id, vec FROM units ORDER BY md5('{FIX.seed}-' || patch_id), patch_id LIMIT {K}",
    "cosines": f"SELECT u.patch_id, u.image_id, u.r, u.c, atom, {dot('u.vec', 'd.vec')} AS sim FROM units u, dict d",
    "codes": f"SELECT patch_id, image_id, r, c, atom FROM cosines WHERE sim >= {FIX.gq_thresh}",
    "live": "SELECT DISTINCT patch_id, image_id, r, c FROM codes",
    "raw": f"SELECT image_id, split, label, list_transform(pixels, lambda x: x / n) AS u FROM (SELECT *, sqrt({dot('pixels', 'pixels')}) AS n FROM images)",
    "sims": f"SELECT q.image_id AS query_id, q.label AS query_label, t.image_id AS neighbour_id, t.label, {dot('q.u', 't.u')} AS sim FROM raw q, raw t WHERE q.split = 'test' AND t.split = 'train'",
    "top": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, neighbour_id) AS rank FROM sims",
    "votes": f"SELECT query_id, query_label, label, sum(exp(sim / {T})) AS weight FROM top WHERE rank <= 30 GROUP BY ALL",
    "ranked": "SELECT q.query_id, q.query_label, l.label, coalesce(weight, 0) AS weight, row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(weight, 0) DESC, l.label) AS rank FROM (SELECT DISTINCT query_id, query_label FROM votes) q CROSS JOIN (SELECT DISTINCT label FROM images) l LEFT JOIN votes v ON v.query_id = q.query_id AND v.label = l.label",
    "coact": "SELECT a.atom AS i, b.atom AS j, count(*) AS n FROM codes a JOIN codes b ON a.patch_id = b.patch_id AND a.atom <= b.atom GROUP BY ALL",
    "near1": "SELECT a.patch_id, b.patch_id AS other, a.image_id FROM live a JOIN live b ON a.image_id = b.image_id AND a.patch_id <> b.patch_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1",
    "near8": "SELECT a.patch_id, b.patch_id AS other, a.image_id FROM live a JOIN live b ON a.image_id = b.image_id AND a.patch_id <> b.patch_id",
    "mata": "SELECT l_orderkey % 40 AS row, l_partkey % 500 AS col, CAST(sum(l_linenumber) AS DOUBLE) AS v FROM lineitem GROUP BY ALL",
    "matb": "SELECT l_partkey % 500 AS row, l_suppkey % 20 AS col, CAST(sum(l_linenumber) AS DOUBLE) AS v FROM lineitem GROUP BY ALL",
    "proj": f"SELECT CAST(e AS INTEGER) AS e, CAST(k AS INTEGER) AS atom, CAST((e * 7 + k * 3) % 11 - 5 AS DOUBLE) AS v FROM range(0, 4) a(e), range(0, {K}) b(k)",
    "beta": "SELECT patch_id, list(coalesce(s, 0) ORDER BY e) AS beta FROM (SELECT u.patch_id, x.e, sum(p.v) AS s FROM units u CROSS JOIN range(0, 4) x(e) LEFT JOIN codes c ON c.patch_id = u.patch_id LEFT JOIN proj p ON p.atom = c.atom AND p.e = x.e GROUP BY ALL) GROUP BY patch_id",
    "pooled": f"SELECT image_id, label, CAST(wr AS INTEGER) AS wr, CAST(wc AS INTEGER) AS wc, list_transform(range(0, {DIM}), lambda k: list_sum(list_transform(v, lambda x: x[k + 1])) / 16) AS beta FROM (SELECT image_id, label, wr, wc, list(vec) AS v FROM patches, range(0, 2) a(wr), range(0, 2) b(wc) WHERE r BETWEEN wr * 2 AND wr * 2 + 3 AND c BETWEEN wc * 2 AND wc * 2 + 3 GROUP BY ALL)",
    "pool_unit": f"SELECT image_id, label, wr, wc, list_transform(beta, lambda x: x / n) AS beta FROM (SELECT *, sqrt({dot('beta', 'beta')}) + 1e-20 AS n FROM pooled)",
}


def with_steps(select: str) -> str:
    """select, after the steps that it reads or that those read."""
    todo, found = [select], set()
    while todo:
        text = todo.pop()
        new = {n for n in STEPS if n not in found and re.search(rf"\b{n}\b", text)}
        found |= new
        todo += [STEPS[n] for n in new]
    # a step that reads itself is recursive; each step comes after those it reads
    order: list[str] = []

    def put(n: str) -> None:
        for other in STEPS:
            if other != n and other in found and other not in order and re.search(rf"\b{other}\b", STEPS[n]):
                put(other)
        if n not in order:
            order.append(n)

    for n in STEPS:
        if n in found:
            put(n)
    recursive = {n for n in order if re.search(rf"\b{n}\b", STEPS[n])}
    steps = ", ".join(f"{n} AS {'' if n in recursive else 'MATERIALIZED '}({STEPS[n]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{steps} {select}" if steps else select


def _loss(optim: str, near: str, value: str = "round(sum(a.v * b.v), 4) + 0.0") -> str:
    """Pairs of y's elements, from the difference vectors themselves."""
    if optim == "two":
        rows = f"""
            WITH m AS (SELECT patch_id, count(*) AS m FROM {near} GROUP BY patch_id),
            y AS (
                SELECT patch_id AS p, atom, sum(v) AS v FROM (
                    SELECT c.patch_id, c.atom, 1.0::DOUBLE AS v FROM codes c JOIN m USING (patch_id)
                    UNION ALL SELECT n.patch_id, c.atom, -1.0::DOUBLE / m.m FROM {near} n JOIN m USING (patch_id) JOIN codes c ON c.patch_id = n.other
                ) GROUP BY ALL
            )"""
    else:
        rows = f"""
            WITH y AS (
                SELECT p, atom, sum(v) AS v FROM (
                    SELECT n.patch_id * 1000000000 + n.other AS p, c.atom, 1.0::DOUBLE AS v FROM {near} n JOIN codes c ON c.patch_id = n.patch_id WHERE n.patch_id < n.other
                    UNION ALL SELECT n.patch_id * 1000000000 + n.other, c.atom, -1.0::DOUBLE FROM {near} n JOIN codes c ON c.patch_id = n.other WHERE n.patch_id < n.other
                ) GROUP BY ALL HAVING sum(v) <> 0
            )"""
    return f"SELECT * FROM ({rows} SELECT a.atom AS i, b.atom AS j, {value} AS v FROM y a JOIN y b ON a.p = b.p AND a.atom <= b.atom GROUP BY ALL) WHERE v <> 0"


GREEDY = f"""
WITH RECURSIVE raw AS (SELECT vec_id, list_transform(x, lambda e: e / n) AS u FROM (SELECT *, sqrt({dot('x', 'x')}) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE len(embedding) = 64))),
o AS (SELECT row_number() OVER (ORDER BY md5('{FIX.seed}-' || vec_id), vec_id) AS k, vec_id, u FROM raw),
g AS (
    SELECT 0::BIGINT AS k, []::BIGINT[] AS ids, []::DOUBLE[][] AS kept
    UNION ALL
    SELECT o.k, CASE WHEN ok THEN list_append(ids, vec_id) ELSE ids END, CASE WHEN ok THEN list_append(kept, u) ELSE kept END
    FROM (SELECT o.*, g.ids, g.kept, len(list_filter(g.kept, lambda w: list_inner_product(w, o.u) > {RAW_DICT_THRESHOLD})) = 0 AS ok FROM g JOIN o ON o.k = g.k + 1 WHERE len(g.ids) < {RAW_ATOMS}) o
)
SELECT CAST(unnest(range(0, {RAW_ATOMS})) AS INTEGER) AS atom, unnest(ids) AS src_patch_id FROM g WHERE len(ids) = {RAW_ATOMS} ORDER BY k LIMIT {RAW_ATOMS}
"""

SELECTS = {
    "scan_filter_split": "SELECT image_id, split, label, CAST(len(pixels) AS INTEGER) AS n_pixels FROM images WHERE split = 'train' AND image_id < 200",
    "hflip_augment": "SELECT image_id, flip, label, pixels FROM aug",
    "grayscale_project": "SELECT image_id, list_transform(pixels, lambda x: round(x * 0.2989 + x / 2 * 0.587 + -x * 0.114, 6) + 0.0) AS pixels FROM images",
    "patchify": "SELECT patch_id, image_id, r, c, vec FROM patches",
    "patch_key_decode": f"SELECT patch_id, patch_id // {P * P} AS image_id, CAST(patch_id % {P * P} // {P} AS INTEGER) AS r, CAST(patch_id % {P} AS INTEGER) AS c FROM patches",
    "context_mean_ctx1": f"SELECT a.patch_id, round(sum(list_sum(b.vec)) / (count(*) * {DIM}), 9) + 0.0 AS mu FROM patches a JOIN patches b ON a.image_id = b.image_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY a.patch_id",
    "context_mean_full": "SELECT image_id, round(mu, 9) + 0.0 AS mu FROM means",
    "center_patches": f"SELECT patch_id, {rounded('vec')} AS vec FROM centred",
    "l2_normalize": f"SELECT patch_id, {rounded('vec')} AS vec FROM units",
    "patch_covariance": f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(covar_samp(vec[i + 1], vec[j + 1]), 9) + 0.0 AS v FROM centred, range(0, {DIM}) a(i), range(0, {DIM}) b(j) WHERE i <= j GROUP BY ALL",
    "similarity_threshold_join": f"SELECT query_id, neighbour_id, round(sim, 6) + 0.0 AS sim FROM sims WHERE sim >= {RAW_THRESHOLD}",
    "cosine_topk": "SELECT query_id, neighbour_id, CAST(rank AS INTEGER) AS rank, round(sim, 6) + 0.0 AS sim FROM top WHERE rank <= 10",
    "knn_topk": "SELECT query_id, neighbour_id, label, CAST(rank AS INTEGER) AS rank, round(sim, 6) + 0.0 AS sim FROM top WHERE rank <= 30",
    "knn_vote": "SELECT query_id, label, round(ln(weight), 6) + 0.0 AS log_weight FROM votes",
    "knn_predict": "SELECT query_id, label AS predicted, label = query_label AS correct FROM ranked WHERE rank = 1",
    "knn_class_ranks": "SELECT query_id, label, CAST(rank AS INTEGER) AS rank FROM ranked",
    "knn_accuracy": "SELECT 100.0::DOUBLE * count(*) FILTER (WHERE rank = 1) / (SELECT count(*) FROM images WHERE split = 'test') AS top1, 100.0::DOUBLE * count(*) FILTER (WHERE rank <= least(5, 30, (SELECT count(DISTINCT label) FROM images WHERE split = 'test'))) / (SELECT count(*) FROM images WHERE split = 'test') AS top5, (SELECT count(*) FROM images WHERE split = 'test') AS total FROM ranked WHERE label = query_label",
    "dictionary_first_k": "SELECT atom, src_patch_id FROM dict",
    "sparse_codes": "SELECT patch_id, atom FROM codes",
    "zero_code_patches": "SELECT patch_id FROM units WHERE patch_id NOT IN (SELECT patch_id FROM codes)",
    "code_density": f"SELECT n AS patches, a AS active, round(a / (n * {K}), 9) AS density, round(z / n, 9) AS zero_share FROM (SELECT (SELECT count(*) FROM units) AS n, (SELECT count(*) FROM codes) AS a, (SELECT count(*) FROM units WHERE patch_id NOT IN (SELECT patch_id FROM codes)) AS z)",
    "codes_per_patch": "SELECT u.patch_id, CAST(count(atom) AS INTEGER) AS n FROM units u LEFT JOIN codes c USING (patch_id) GROUP BY u.patch_id",
    "codes_per_atom": "SELECT atom, count(*) AS n FROM codes GROUP BY atom",
    "coactivation_counts": "SELECT i, j, n FROM coact",
    "second_moment": "SELECT i, j, round(n / (SELECT count(*) FROM units), 9) + 0.0 AS v FROM coact",
    "mirror_symmetric": "SELECT i, j, n AS v FROM coact UNION ALL SELECT j, i, n FROM coact WHERE i < j",
    "symmetry_check": f"SELECT coalesce(max(n), 0)::DOUBLE AS max_asymmetry FROM coact WHERE j = {K - 1} AND i < {K - 1}",
    "context_pairs": f"SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM range(0, {P * P}) x(a), range(0, {P * P}) y(b) WHERE a < b AND abs(a // {P} - b // {P}) <= 1 AND abs(a % {P} - b % {P}) <= 1",
    "context_neighbor_count": "SELECT patch_id, count(*) AS n FROM near1 GROUP BY patch_id",
    "loss_one_ctx1": _loss("one", "near1"),
    "loss_two_ctx1": _loss("two", "near1"),
    "loss_one_full": _loss("one", "near8"),
    "loss_two_full": _loss("two", "near8"),
    "projection_apply": "SELECT patch_id, beta FROM beta",
    "projection_join": "SELECT patch_id, e, sum(v) AS v FROM codes JOIN proj USING (atom) GROUP BY ALL",
    "embed_normalize": f"SELECT patch_id, list_transform(beta, lambda x: round(x / n, 6) + 0.0) AS beta FROM (SELECT *, sqrt({dot('beta', 'beta')}) + 1e-20 AS n FROM beta)",
    "avg_pool_4x2": f"SELECT image_id, wr, wc, {rounded('beta')} AS beta FROM pooled",
    "pool_l2_normalize": f"SELECT image_id, wr, wc, {rounded('beta')} AS beta FROM pool_unit",
    "image_vector_flatten": f"SELECT image_id, label, list_transform(range(0, {DIM * 4}), lambda k: round(w[k % 4 + 1][k // 4 + 1], 6) + 0.0) AS vec FROM (SELECT image_id, label, list(beta ORDER BY wr, wc) AS w FROM pool_unit GROUP BY ALL)",
    "coo_to_csr": "SELECT r AS row, CAST(coalesce(sum(n) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, n AS nnz FROM (SELECT r, count(col) AS n FROM range(0, 50) x(r) LEFT JOIN mata ON mata.row = r GROUP BY r)",
    "row_block_slice": "SELECT row - 10 AS row, col, v FROM mata WHERE row >= 10 AND row < 20",
    "column_block_slice": "SELECT col // 60 AS block, row, col % 60 AS col, v FROM mata",
    "column_block_transpose": "SELECT col // 60 AS block, col % 60 AS row, row AS col, v FROM mata",
    "matmul_sparse_sparse": "SELECT a.row, b.col, sum(a.v * b.v) AS v FROM mata a JOIN matb b ON a.col = b.row GROUP BY ALL",
    "matmul_symmetric": "SELECT a.row, b.row AS col, sum(a.v * b.v) AS v FROM mata a JOIN mata b ON a.col = b.col AND a.row <= b.row GROUP BY ALL",
    "matmul_dense_sparse": "SELECT n AS row, b.col, CAST(sum(((b.row * 3 + n) % 7) * b.v) AS DOUBLE) AS v FROM range(0, 2) x(n), matb b GROUP BY ALL",
    "stack_columns": "SELECT row, col, v FROM mata",
}

#: Test images, without mirror images, at the steps that training images take; the dictionary stays that of training.
FORCED = {
    "tp": f"SELECT (image_id * {P} + r) * {P} + c AS patch_id, image_id, list_transform(range(0, {DIM}), lambda k: pixels[(r + k // 3) * 8 + c + k % 3 + 1]) AS vec FROM images, range(0, {P}) a(r), range(0, {P}) b(c) WHERE split = 'test'",
    "tm": f"SELECT image_id, sum(list_sum(vec)) / {P * P * DIM} AS mu FROM tp GROUP BY image_id",
    "tl": "SELECT patch_id, list_transform(vec, lambda x: x - mu + 1e-20) AS vec FROM tp JOIN tm USING (image_id)",
    "tu": f"SELECT patch_id, list_transform(vec, lambda x: x / n) AS vec FROM (SELECT *, sqrt({dot('vec', 'vec')}) AS n FROM tl)",
    "tc": f"SELECT u.patch_id, atom, {dot('u.vec', 'd.vec')} AS sim FROM tu u, dict d",
}


# --- matrices as lists, row by row ---------------------------------------------------------------------------------


def product(a: str, b: str, n: int) -> str:
    """a b of n x n matrices."""
    return f"list_transform(range(0, {n * n}), lambda k: list_sum(list_transform(range(0, {n}), lambda m: {a}[k // {n} * {n} + m + 1] * {b}[m * {n} + k % {n} + 1])))"


def inverse_root(name: str, source: str, n: int, rounds: int = 40) -> dict[str, str]:
    """Steps up to name(a): the inverse square root of the symmetric matrix of source(a), by coupled Newton-Schulz iteration."""
    one = f"list_transform(range(0, {n * n}), lambda k: CASE WHEN k // {n} = k % {n} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    size = f"list_sum(list_transform(range(0, {n}), lambda k: a[k * {n + 1} + 1]))"
    step = f"SELECT k + 1 AS k, y, z, list_transform({product('z', 'y', n)}, lambda x, k: (CASE WHEN (k - 1) // {n} = (k - 1) % {n} THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END - x) / 2) AS t FROM {name}_steps WHERE k < {rounds}"
    return {
        f"{name}_steps": f"SELECT 0 AS k, list_transform(a, lambda x: x / {size}) AS y, {one} AS z FROM {source} UNION ALL SELECT k, {product('y', 't', n)}, {product('t', 'z', n)} FROM ({step})",
        name: f"SELECT list_transform(z, lambda x: x / sqrt({size})) AS a FROM {name}_steps, {source} WHERE k = {rounds}",
    }


def eigenvectors(name: str, source: str, n: int, sweeps: int = 12) -> dict[str, str]:
    """Steps up to name(i, value, vec): eigenvalues and vectors of the symmetric matrix of source(a), by Jacobi rotations of n / 2 disjoint pairs at a time."""
    m = n - 1  # pairs of round k: the last index meets k, and p meets 2 k - p modulo the others
    at = lambda i, j: f"a[({i}) * {n} + ({j}) + 1]"
    partner = f"list_transform(range(0, {n}), lambda p: CASE WHEN p = {m} THEN k % {m} WHEN p = k % {m} THEN {m} ELSE (2 * k - p) % {m} + CASE WHEN (2 * k - p) % {m} < 0 THEN {m} ELSE 0 END END)"
    low, high = "least(p, q[p + 1])", "greatest(p, q[p + 1])"
    theta = f"(({at(high, high)} - {at(low, low)}) / (2 * {at(low, high)}))"
    tangent = f"CASE WHEN abs({at(low, high)}) < 1e-300 THEN 0.0::DOUBLE ELSE (CASE WHEN {theta} >= 0 THEN 1 ELSE -1 END) / (abs({theta}) + sqrt({theta} * {theta} + 1)) END"
    rows = lambda x: f"list_transform(range(0, {n * n}), lambda e: c[e // {n} + 1] * {x}[e + 1] + s[e // {n} + 1] * {x}[q[e // {n} + 1] * {n} + e % {n} + 1])"
    columns = f"list_transform(range(0, {n * n}), lambda e: c[e % {n} + 1] * b[e + 1] + s[e % {n} + 1] * b[e // {n} * {n} + q[e % {n} + 1] + 1])"
    one = f"list_transform(range(0, {n * n}), lambda k: CASE WHEN k // {n} = k % {n} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    return {
        f"{name}_steps": f"""SELECT 0 AS k, a, {one} AS u FROM {source}
            UNION ALL SELECT k + 1, {columns}, u FROM (SELECT k, q, c, s, {rows('a')} AS b, {rows('u')} AS u FROM (
                SELECT k, a, u, q, list_transform(t, lambda x: 1 / sqrt(x * x + 1)) AS c, list_transform(t, lambda x, i: CASE WHEN i - 1 < q[i] THEN -1 ELSE 1 END * x / sqrt(x * x + 1)) AS s FROM (
                    SELECT k, a, u, q, list_transform(range(0, {n}), lambda p: {tangent}) AS t FROM (SELECT k, a, u, {partner} AS q FROM {name}_steps WHERE k < {sweeps * m}))))""",
        name: f"SELECT i, a[i * {n + 1} + 1] AS value, u[i * {n} + 1 : i * {n} + {n}] AS vec FROM {name}_steps, range(0, {n}) x(i) WHERE k = {sweeps * m}",
    }


def whole_chain(p: str, centred: str, optim: str, near: str) -> dict[str, str]:
    """Steps of a whole fit, their names behind p: whitening, greedy dictionary, codes, moments, eigenvectors, embeddings, votes."""
    own = lambda text: re.sub(r"\b(units|dict|cosines|codes|live|coact|near1|near8|sims|top|votes|ranked)\b", rf"{p}\1", text)
    e, skip = FIX.embed_dim, FIX.skip
    steps = {
        f"{p}cov": f"SELECT list(v ORDER BY i, j) AS a FROM (SELECT i, j, covar_samp(vec[i + 1], vec[j + 1]) + CASE WHEN i = j THEN {FIX.whiten_tol}::DOUBLE ELSE 0 END AS v FROM {centred}, range(0, {DIM}) a(i), range(0, {DIM}) b(j) GROUP BY i, j)",
        **inverse_root(f"{p}whitening", f"{p}cov", DIM),
    }

    def vectors(name: str, source: str) -> dict[str, str]:
        turned = f"list_transform(range(0, {DIM}), lambda i: list_sum(list_transform(range(0, {DIM}), lambda k: a[i * {DIM} + k + 1] * vec[k + 1])) + 1e-20)"
        return {
            f"{name}lifted": f"SELECT patch_id, image_id, label, r, c, {turned} AS vec FROM {source}, {p}whitening",
            f"{name}units": f"SELECT patch_id, image_id, label, r, c, list_transform(vec, lambda x: x / n) AS vec FROM (SELECT *, sqrt({dot('vec', 'vec')}) AS n FROM {name}lifted)",
        }

    steps |= vectors(p, centred)
    order = f"md5('{FIX.seed}-' || patch_id), patch_id"
    steps |= {
        f"{p}queue": f"SELECT row_number() OVER (ORDER BY {order}) AS k, patch_id, vec FROM {p}units",
        f"{p}greedy": f"""SELECT 0::BIGINT AS k, []::BIGINT[] AS ids, []::DOUBLE[][] AS kept UNION ALL
            SELECT k, CASE WHEN ok THEN list_append(ids, patch_id) ELSE ids END, CASE WHEN ok THEN list_append(kept, vec) ELSE kept END
            FROM (SELECT o.*, g.ids, g.kept, len(list_filter(g.kept, lambda w: list_inner_product(w, o.vec) > {FIX.dict_thresh})) = 0 AS ok FROM {p}greedy g JOIN {p}queue o ON o.k = g.k + 1 WHERE len(g.ids) < {K})""",
        f"{p}dict": f"SELECT CAST(unnest(range(0, {K})) AS INTEGER) AS atom, unnest(ids) AS src_patch_id, unnest(kept) AS vec FROM {p}greedy WHERE len(ids) = {K}",
        **{f"{p}{name}": own(STEPS[name]) for name in ("cosines", "codes", "live", "coact", near)},
        f"{p}moment": f"SELECT list(coalesce(n, 0) / total + CASE WHEN i = j THEN {FIX.cov_tol}::DOUBLE ELSE 0 END ORDER BY i, j) AS a FROM (SELECT a.i, b.j, x.n FROM range(0, {K}) a(i) CROSS JOIN range(0, {K}) b(j) LEFT JOIN {p}coact x ON x.i = least(a.i, b.j) AND x.j = greatest(a.i, b.j)), (SELECT count(*) AS total FROM {p}units)",
        **inverse_root(f"{p}root", f"{p}moment", K),
        f"{p}pairs": own(_loss(optim, near, "sum(a.v * b.v)")),
        f"{p}loss": f"SELECT list(coalesce(v, 0) ORDER BY i, j) AS a FROM (SELECT a.i, b.j, x.v FROM range(0, {K}) a(i) CROSS JOIN range(0, {K}) b(j) LEFT JOIN {p}pairs x ON x.i = least(a.i, b.j) AND x.j = greatest(a.i, b.j))",
        f"{p}half": f"SELECT {product('r.a', 'l.a', K)} AS a FROM {p}root r, {p}loss l",
        f"{p}product": f"SELECT {product('h.a', 'r.a', K)} AS a FROM {p}half h, {p}root r",
        f"{p}closed": f"SELECT list_transform(range(0, {K * K}), lambda k: (a[k + 1] + a[k % {K} * {K} + k // {K} + 1]) / 2) AS a FROM {p}product",
        **eigenvectors(f"{p}eigen", f"{p}closed", K),
        f"{p}chosen": f"SELECT o - {skip} - 1 AS e, CASE WHEN list_max(vec) >= -list_min(vec) THEN vec ELSE list_transform(vec, lambda x: -x) END AS vec FROM (SELECT *, row_number() OVER (ORDER BY abs(value), i) AS o FROM {p}eigen) WHERE o > {skip} AND o <= {skip + e}",
        f"{p}proj": f"SELECT CAST(e AS INTEGER) AS e, CAST(k AS INTEGER) AS atom, list_sum(list_transform(range(0, {K}), lambda m: vec[m + 1] * a[m * {K} + k + 1])) AS v FROM {p}chosen, {p}root, range(0, {K}) x(k)",
        f"{p}beta": f"SELECT patch_id, list(coalesce(s, 0) ORDER BY e) AS beta FROM (SELECT u.patch_id, x.e, sum(p.v) AS s FROM {p}units u CROSS JOIN range(0, {e}) x(e) LEFT JOIN {p}codes c ON c.patch_id = u.patch_id LEFT JOIN {p}proj p ON p.atom = c.atom AND p.e = x.e GROUP BY ALL) GROUP BY patch_id",
    }
    # test images: no mirror images, the most similar atom always on
    grid = f"SELECT (image_id * {P} + r) * {P} + c AS patch_id, image_id, label, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, list_transform(range(0, {DIM}), lambda k: pixels[(r + k // 3) * 8 + c + k % 3 + 1]) AS vec FROM images, range(0, {P}) a(r), range(0, {P}) b(c) WHERE split = 'test'"
    steps |= {f"{p}t_patches": grid, f"{p}t_centred": _centred(f"{p}t_patches", 8 if near == "near8" else 1), **vectors(f"{p}t_", f"{p}t_centred")}
    steps |= {
        f"{p}t_sims": f"SELECT u.patch_id, atom, {dot('u.vec', 'd.vec')} AS sim FROM {p}t_units u, {p}dict d",
        f"{p}t_codes": f"SELECT patch_id, atom FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY sim DESC, atom) AS k FROM {p}t_sims) WHERE sim >= {FIX.gq_thresh} OR k = 1",
        f"{p}t_beta": f"SELECT patch_id, list(coalesce(s, 0) ORDER BY e) AS beta FROM (SELECT u.patch_id, x.e, sum(p.v) AS s FROM {p}t_units u CROSS JOIN range(0, {e}) x(e) LEFT JOIN {p}t_codes c ON c.patch_id = u.patch_id LEFT JOIN {p}proj p ON p.atom = c.atom AND p.e = x.e GROUP BY ALL) GROUP BY patch_id",
    }
    for part in ("", "t_"):
        unit = lambda source: f"SELECT * EXCLUDE (beta, n), list_transform(beta, lambda x: x / n) AS beta FROM (SELECT *, sqrt({dot('beta', 'beta')}) + 1e-20 AS n FROM {source})"
        steps |= {
            f"{p}{part}embedded": unit(f"{p}{part}beta"),
            f"{p}{part}pooled": f"SELECT image_id, label, wr, wc, list_transform(range(0, {e}), lambda k: list_sum(list_transform(v, lambda x: x[k + 1])) / 16) AS beta FROM (SELECT image_id, label, wr, wc, list(beta) AS v FROM {p}{part}embedded JOIN {p}{part}units USING (patch_id), range(0, 2) a(wr), range(0, 2) b(wc) WHERE r BETWEEN wr * 2 AND wr * 2 + 3 AND c BETWEEN wc * 2 AND wc * 2 + 3 GROUP BY ALL)",
            f"{p}{part}windows": unit(f"{p}{part}pooled"),
            f"{p}{part}images": f"SELECT image_id, label, list_transform(range(0, {e * 4}), lambda k: w[k % 4 + 1][k // 4 + 1]) AS vec FROM (SELECT image_id, label, list(beta ORDER BY wr, wc) AS w FROM {p}{part}windows GROUP BY ALL)",
            f"{p}{part}raw": f"SELECT image_id, label, list_transform(vec, lambda x: x / n) AS u FROM (SELECT *, sqrt({dot('vec', 'vec')}) AS n FROM {p}{part}images)",
        }
    steps |= {
        f"{p}sims": f"SELECT q.image_id AS query_id, q.label AS query_label, t.image_id AS neighbour_id, t.label, {dot('q.u', 't.u')} AS sim FROM {p}t_raw q, {p}raw t",
        **{f"{p}{name}": own(STEPS[name]) for name in ("top", "votes", "ranked")},
    }
    return steps


def _centred(patches: str, radius: int) -> str:
    near = f"abs(a.r - b.r) <= {radius} AND abs(a.c - b.c) <= {radius}"
    means = f"SELECT a.patch_id, sum(list_sum(b.vec)) / (count(*) * {DIM}) AS mu FROM {patches} a JOIN {patches} b ON a.image_id = b.image_id AND {near} GROUP BY a.patch_id"
    return f"SELECT patch_id, image_id, label, r, c, list_transform(vec, lambda x: x - mu) AS vec FROM {patches} JOIN ({means}) USING (patch_id)"


STEPS |= {"y_centred": _centred("patches", 1)} | whole_chain("y_", "y_centred", "one", "near1")
STEPS |= {"z_centred": _centred("patches", 8)} | whole_chain("z_", "z_centred", "two", "near8")

_ACCURACY = "SELECT 100.0::DOUBLE * count(*) FILTER (WHERE rank = 1) / (SELECT count(*) FROM images WHERE split = 'test') AS top1, 100.0::DOUBLE * count(*) FILTER (WHERE rank <= least(5, 30, (SELECT count(DISTINCT label) FROM images WHERE split = 'test'))) / (SELECT count(*) FROM images WHERE split = 'test') AS top5, (SELECT count(*) FROM images WHERE split = 'test') AS total FROM ranked WHERE label = query_label"
_MATRIX = "SELECT CAST(k // {n} AS INTEGER) AS i, CAST(k % {n} AS INTEGER) AS j, round(a[k + 1], 6) + 0.0 AS v FROM {name}, range(0, {n} * {n}) x(k)"
STEPS |= inverse_root("root_of_codes", "moment_of_codes", K)
STEPS["moment_of_codes"] = f"SELECT list(coalesce(n, 0) / total + CASE WHEN i = j THEN {FIX.cov_tol}::DOUBLE ELSE 0 END ORDER BY i, j) AS a FROM (SELECT a.i, b.j, x.n FROM range(0, {K}) a(i) CROSS JOIN range(0, {K}) b(j) LEFT JOIN coact x ON x.i = least(a.i, b.j) AND x.j = greatest(a.i, b.j)), (SELECT count(*) AS total FROM units)"
SELECTS |= {
    "whitening_matrix": _MATRIX.format(n=DIM, name="z_whitening"),
    "whiten_apply": f"SELECT patch_id, {rounded('vec')} AS vec FROM z_units",
    "inverse_sqrt_second_moment": _MATRIX.format(n=K, name="root_of_codes"),
    "embedding_matrix": "SELECT e, atom, round(v, 6) + 0.0 AS v FROM z_proj",
    "patch_embedding": f"SELECT patch_id, {rounded('beta')} AS beta FROM z_embedded",
    "image_embedding": f"SELECT image_id, label, {rounded('vec')} AS vec FROM z_t_images",
    "pipeline_accuracy": _ACCURACY.replace("ranked", "z_ranked"),
    "pipeline_accuracy_one": _ACCURACY.replace("ranked", "y_ranked"),
}


def oracle_sql() -> dict[str, str]:
    out = {name: with_steps(select) for name, select in SELECTS.items()}
    base = with_steps("SELECT * FROM dict, images").removesuffix("SELECT * FROM dict, images").rstrip()
    more = ", ".join(f"{n} AS MATERIALIZED ({s})" for n, s in FORCED.items())
    out["sparse_codes_forced"] = f"{base}, {more} SELECT patch_id, atom FROM (SELECT *, row_number() OVER (PARTITION BY patch_id ORDER BY sim DESC, atom) AS k FROM tc) WHERE sim >= {FIX.gq_thresh} OR k = 1"
    out["dictionary_greedy"] = GREEDY
    return out
