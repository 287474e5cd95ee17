"""Near-duplicate documents by ProbMinHash.

Weighted shingles: five words (runs without white space) and how often a text has them; a text of fewer words is one shingle.
Each shingle is a Poisson process whose rate is its weight and whose arrivals, drawn from the shingle's hash, fall on
``REGISTERS`` registers; a register keeps the shingle that arrives there first, and a text stops when no process can arrive
before the latest register. Two texts agree in a register with the probability Jaccard similarity of their weights. Registers
are banded (24 bands of 5: a pair at 0.8 is missed with probability 7e-5), candidates are verified on their whole texts:
linked if the probability Jaccard similarity, or the plain one of the sets of shingles, is 0.8 or more. Classes are the
connected components of links.

The plain similarity has registers of its own, drawn with unit weights. They equal the weighted ones unless a text repeats
some shingles more often than others; such a text has both kinds, in the same buckets, and so up to twice the bands. The
estimate of a pair is the larger of the agreement of both kinds.

How candidates stay in proportion to the texts, without caps:

* Equal texts collapse to one node first (md5 of the text).
* Round 1: the nodes of a bucket meet its ``PIVOTS`` pivots, which are the extremes of different orders of the nodes' hashes and
  so mostly the same in all buckets of a group of copies. Registers are compared, and each node is verified against the
  ``BEST`` pivots that agree with it most.
* Round 2: only buckets whose nodes round 1 left in several classes. Nodes outside the class of the bucket's first node meet
  those inside it and each other in tiles of ``BLOCK`` nodes a side, first by registers alone (a node is ``BLOCK`` times fewer
  rows than it has partners). Pairs of different classes whose estimate could belong to 0.8 (5 standard deviations) count in
  the first band that they share; nodes without any go. For the others texts come along, and pairs are verified, most similar
  first, until their classes have met. So no pair of different classes that shares a bucket is left out, within a class no
  pair needs a look, and a tile gives fewer links than it has nodes.

Texts are read for nodes that take part in a verification only: once for each of a node's pivots (a pivot's once for every
``GROUP`` nodes), or for each tile. Names of nodes are broadcast up to a counted bound and joined by a shuffle beyond it. Python
works through rows in order, about ``SLICE_BYTES`` of text at a time, and holds one pivot or one tile besides.

Null texts are in a class of their own each; empty texts, and texts of white space only, are copies of texts equal to them.
Repeated rows are copies. A class is named by its smallest id (null ids come last), which is no unique name where
ids repeat or are null: ``root`` tells such classes apart. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Nodes a side of a tile: 120 or 240 bytes of registers each.
BLOCK = 512
#: 0.8 less five standard deviations of the estimate
LEAST_ESTIMATE = SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5
#: Names of nodes (32 characters each) that are broadcast at most.
BROADCAST_NODES = 64_000
#: Constants that flip bits of the nodes' hashes: each makes another order, whose smallest node is a pivot.
PIVOTS = (0, -1, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)
BEST = 2
#: Rows that meet one copy of a pivot's text.
GROUP = 500
CLASS_PARTS = 64
#: Bytes of texts that are worked on at once, and arrivals; a longer text stands alone.
SLICE_BYTES, ARRIVALS = 1 << 20, 1 << 18
TILE = ["key", "i", "j", "side", "band", "node", "class", "sig"]

# Odd 64-bit constants of the splitmix64 generator.
GOLDEN, MIX1, MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


#: Code points that end a word: those that ``str.isspace`` names.
_SPACE = np.zeros(0x3002, bool)
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True
#: An odd base of words' polynomials, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(x))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingles_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, 64-bit hash, count) of the distinct shingles of each text, in the order of texts and hashes."""
    chars = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    blank = _SPACE[np.minimum(chars, 0x3001)]
    edges = np.flatnonzero(np.diff(blank, prepend=True))
    starts, ends = edges[::2], edges[1::2]
    # a word's hash: its polynomial, from sums up to its ends, then mixed with its length
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(chars * _powers(BASE, len(chars)), dtype=np.uint64, out=sums[1:])
    words = mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(chars) + 1)[starts] + (ends - starts).astype(np.uint64) * GOLDEN)
    of = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    first, n = np.searchsorted(of, np.arange(len(texts) + 1)), np.bincount(of, minlength=len(texts))
    place = np.arange(len(words)) - first[of]
    at = np.flatnonzero(place < np.maximum(1, n[of] - WORDS + 1))
    s = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        more = (s ^ (s >> np.uint64(29))) * GOLDEN + words[np.minimum(at + k, len(words) - 1)] if len(words) else s
        s = np.where(k < n[of[at]], more, s)
    s, of = mixed(s), of[at]
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (of[1:] != of[:-1])])[: len(s)])
    return of[new], s[new], np.diff(new, append=len(s))


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(sorted 64-bit hashes of the distinct shingles, their counts)"""
    return shingles_of([text])[1:]


def registers_of(of: np.ndarray, s: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """(n, REGISTERS): the shingle that arrives first in each register of each of n texts; of is sorted."""
    least, first = np.full(n * REGISTERS, np.inf), np.zeros(n * REGISTERS, np.uint64)
    t, w, done = np.zeros(len(s)), weights.astype(float), np.zeros(len(s), np.int64)
    while len(s):
        # several arrivals of each process at once (a power of two), so that few shingles fill the registers in a few steps
        unfilled = np.isinf(least.reshape(n, REGISTERS)).any(axis=1)[of]
        wanted = np.where(unfilled, np.maximum(1, 6 * REGISTERS // np.bincount(of, minlength=n)[of]), 1)
        steps = np.left_shift(1, np.ceil(np.log2(wanted)).astype(np.int64))
        for m in np.unique(steps):
            rows = np.flatnonzero(steps == m)
            for a in range(0, len(rows), max(1, ARRIVALS // m)):
                i = rows[a : a + max(1, ARRIVALS // m)]
                x = mixed(s[i, None] + GOLDEN * (done[i, None] + np.arange(1, m + 1)).astype(np.uint64))
                gaps = -np.log(((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / w[i, None]
                gaps[:, 0] += t[i]
                times = np.cumsum(gaps, axis=1)
                t[i] = times[:, -1]
                at = (of[i, None] * REGISTERS + (mixed(x + GOLDEN) % np.uint64(REGISTERS)).astype(np.int64)).ravel()
                flat = times.ravel()
                early = np.flatnonzero(flat < least[at])
                at, flat = at[early], flat[early]
                np.minimum.at(least, at, flat)
                won = flat == least[at]
                first[at[won]] = s[i[early // m]][won]
        done = done + steps
        on = t < least.reshape(n, REGISTERS).max(axis=1)[of]
        of, s, w, t, done = of[on], s[on], w[on], t[on], done[on]
    return first.reshape(n, REGISTERS)


def registers(s: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return registers_of(np.zeros(len(s), np.int64), s, weights, 1)[0]


def signatures(texts: list[str]) -> list[np.ndarray]:
    """Each text's registers by weights, then (a second row) those by unit weights where these may differ; no row without shingles."""
    of, s, w = shingles_of(texts)
    n = len(texts)
    has = np.bincount(of, minlength=n) > 0
    low, high = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    np.minimum.at(low, of, w)
    np.maximum.at(high, of, w)
    uneven = low < high
    units = registers_of(of, s, np.ones(len(s)), n)
    more = np.flatnonzero(uneven)
    part = uneven[of]
    weighted = registers_of(np.searchsorted(more, of[part]), s[part], w[part], len(more))
    second = dict(zip(more.tolist(), weighted, strict=True))
    return [np.zeros((0, REGISTERS), np.uint64) if not has[i] else np.stack([second[i], units[i]]) if i in second else units[i : i + 1] for i in range(n)]


def band_keys(first: np.ndarray) -> np.ndarray:
    """Keys of the bands of one or more rows of registers, one row after the other."""
    key = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN), (len(first), BANDS))
    for k in range(ROWS):
        key = mixed(key + first.reshape(-1, BANDS, ROWS)[:, :, k])
    return key.reshape(-1).view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the probability Jaccard similarity of the weights and the Jaccard similarity of the sets."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    wa, wb = a[1][ia].astype(float), b[1][ib].astype(float)
    ratio = wa / wb
    order = np.argsort(ratio, kind="stable")
    ratio, wa, wb = ratio[order], wa[order], wb[order]
    # sum over j of max(a_j / a_i, b_j / b_i): a's share from ratios of at least i's, b's from smaller ones
    above = np.concatenate([np.cumsum(wa[::-1])[::-1], [0.0]]) + (a[1].sum() - wa.sum())
    below = np.concatenate([[0.0], np.cumsum(wb)]) + (b[1].sum() - wb.sum())
    i = np.searchsorted(ratio, ratio, side="left")
    p = (1 / (above[i] / wa + below[i] / wb)).sum()
    return float(max(p, len(both) / (len(a[0]) + len(b[0]) - len(both))))


def _slices(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive rows that hold about ``most`` at most (a larger row stands alone)."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(start, i)
            start = i
            held = 0
        held += n + 64
    if start < len(sizes):
        yield slice(start, len(sizes))


def _text_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = [x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()]
    for part in _slices(sizes, SLICE_BYTES):
        yield batch.slice(part.start, part.stop - part.start)


def _signatures(batches):
    for batch in batches:
        for part in _text_slices(batch, 1):
            found = signatures(part.column(1).to_pylist())
            keys = pa.array([band_keys(x) if len(x) else None for x in found], pa.list_(pa.int64()))
            kept = pa.array([x.astype(np.uint8).tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), keys, kept], ["node", "keys", "sig"])


def _both(signatures: list[bytes]) -> np.ndarray:
    """(text, kind, register): a text of one kind of registers has it twice."""
    return np.frombuffer(b"".join(x if len(x) > REGISTERS else x + x for x in signatures), np.uint8).reshape(-1, 2, REGISTERS)


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The larger share of equal registers (their last bytes) by weights and by unit weights."""
    return (a == b).mean(axis=-1).max(axis=-1)


def _agreement(batches):
    """Estimates of (u, v, a, b)."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            a, b = (_both(part.column(i).to_pylist()) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(_estimate(a, b))], ["u", "v", "near"])


def _sets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    of, s, w = shingles_of(texts)
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield s[a:b], w[a:b]


def _verified(batches):
    """Links of rows (u, v, text) in the order of u, the row of u itself (v is null) before the others."""
    held: tuple = (None, None)
    for batch in batches:
        for part in _text_slices(batch, 2):
            links = []
            for u, v, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _sets(part.column(2).to_pylist())):
                if v is None:
                    held = (u, own)
                elif held[0] == u and similarity(held[1], own) >= SIMILARITY:
                    links.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.string()), pa.array([x for _, x in links], pa.string())], ["u", "v"])


class _Tile:
    """Rows of one tile: nodes with classes and registers, and texts if it comes to verification. side 2 is a block that meets itself."""

    def __init__(self, rows: pa.Table):
        column = lambda c: rows[c].to_pylist()
        self.node, self.kind, self.side = column("node"), np.unique(rows["class"].to_numpy(), return_inverse=True)[1], rows["side"].to_numpy()
        self.band = rows["band"][0].as_py()
        self.text = rows["text"] if "text" in rows.column_names else None
        self.sig = _both(column("sig"))
        self.sets: dict[int, tuple] = {}

    def shingles(self, i: int) -> tuple:
        if i not in self.sets:
            self.sets[i] = shingles(self.text[i].as_py())
        return self.sets[i]

    def candidates(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, rows of other classes whose estimate could belong to 0.8, estimates). A pair's turn is in the first band that it shares, of whichever kinds."""
        right = np.flatnonzero(self.side != 0)
        for i in np.flatnonzero(self.side != 1):
            other = right[self.kind[right] != self.kind[i]]
            if self.side[i] == 2:
                other = other[other > i]
            agree = _estimate(self.sig[other], self.sig[i])
            other, agree = other[agree >= LEAST_ESTIMATE], agree[agree >= LEAST_ESTIMATE]
            if len(other):
                same = (self.sig[other][:, :, None] == self.sig[i]).reshape(len(other), 4, BANDS, ROWS).all(axis=3).any(axis=1)
                turn = same.argmax(axis=1) == self.band
                if turn.any():
                    yield int(i), other[turn], agree[turn]

    def busy(self) -> np.ndarray:
        """Rows that are in a candidate pair."""
        out = np.zeros(len(self.node), bool)
        for i, other, _ in self.candidates():
            out[i] = True
            out[other] = True
        return out

    def links(self) -> list[tuple[str, str]]:
        parent = list(range(int(self.kind.max()) + 1))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        pairs = [(-a, i, j) for i, other, agree in self.candidates() for j, a in zip(other.tolist(), agree.tolist(), strict=True)]
        for _, i, j in sorted(pairs):
            a, b = root(self.kind[i]), root(self.kind[j])
            if a != b and similarity(self.shingles(i), self.shingles(j)) >= SIMILARITY:
                parent[a] = b
                out.append((self.node[i], self.node[j]))
        return out


def _tiles_of(batches) -> Iterator[pa.Table]:
    """The rows of one tile after the other; they come in the order of tiles."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        ids = np.array([rows[c].to_numpy() for c in ("key", "i", "j")])
        starts = np.concatenate([[0], np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1, [rows.num_rows]]) if rows.num_rows else []
        for a, b in zip(starts[:-1], starts[1:]):
            if last is not None and tuple(ids[:, a]) != last:
                yield pa.concat_tables(held).combine_chunks()
                held = []
            last = tuple(ids[:, a])
            held.append(rows.slice(a, b - a))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _busy_rows(batches):
    """Rows of tiles that are in a candidate pair of their tile."""
    for rows in _tiles_of(batches):
        if rows.num_rows > 1 and (busy := _Tile(rows).busy()).any():
            yield from rows.select(TILE).filter(pa.array(busy)).to_batches()


def _tile_links(batches):
    for rows in _tiles_of(batches):
        if rows.num_rows > 1 and (found := _Tile(rows).links()):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], ["u", "v"])


def _with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows with the text of their node; only texts of these nodes are shuffled, once each."""
    ends = cut(rows.select("node").distinct())
    if ends.count() <= BROADCAST_NODES:
        ends = F.broadcast(ends)
    return rows.join(texts.join(ends, "node", "left_semi").dropDuplicates(["node"]), "node")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs(u, v) of nodes that are similar; texts(node, text). A node u meets its v in groups of about ``GROUP``, each with one copy of its text."""
    pairs = cut(pairs)
    sizes = pairs.groupBy("u").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups")).where("groups > 1")
    group = F.pmod(F.xxhash64("v"), F.coalesce("groups", F.lit(1))).cast("int")
    dealt = pairs.join(sizes, "u", "left").select("u", group.alias("g"), "v")
    rows = dealt.select("u", "g", "v", F.col("v").alias("node")).union(dealt.select("u", "g", F.lit(None).cast("string").alias("v"), F.col("u").alias("node")).distinct())
    full = _with_texts(rows, texts).repartition("u", "g").sortWithinPartitions("u", "g", F.col("v").asc_nulls_first())
    return cut(full.select("u", "v", "text").mapInArrow(_verified, "u string, v string"))


def _round_one(nodes: DataFrame, shared: DataFrame, buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links of nodes and the pivots that agree with them most."""
    met = shared.join(buckets, "key").select("h", F.explode(F.array_distinct(F.array(*[f"p{k}" for k in range(len(PIVOTS))]))).alias("p")).where("h <> p").distinct()
    sig = lambda h, node, col: nodes.select(F.col("h").alias(h), F.col("node").alias(node), F.col("sig").alias(col))
    pairs = met.join(sig("h", "v", "b"), "h").join(sig("p", "u", "a"), "p").select("u", "v", "a", "b")
    near = pairs.mapInArrow(_agreement, "u string, v string, near double").where(F.col("near") >= LEAST_ESTIMATE)
    best = F.row_number().over(Window.partitionBy("v").orderBy(F.col("near").desc(), "u"))
    chosen = near.withColumn("k", best).where(F.col("k") <= BEST)
    # two pivots may have chosen each other: once is enough
    one_way = F.when(F.col("u") < F.col("v"), F.struct("u", "v")).otherwise(F.struct(F.col("v").alias("u"), F.col("u").alias("v"))).alias("pair")
    return _verify(chosen.groupBy(one_way).agg(F.min(F.struct("u", "v")).alias("p")).select("p.*"), texts)


def _classes(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with ``class``: the root of their component, themselves if they have no link."""
    found = connected_components(links).withColumnRenamed("root", "class")
    return nodes.join(found, "node", "left").withColumn("class", F.coalesce("class", "node"))


def _round_two(nodes: DataFrame, shared: DataFrame, texts: DataFrame, links: DataFrame) -> DataFrame:
    """Verified links across classes, in buckets that still hold several."""
    classes = _classes(nodes.select("node", "h"), links).select("h", "node", F.xxhash64("class").alias("class"))
    at = shared.join(classes, "h").drop("h")
    main = F.min(F.struct("node", "class"))["class"]
    mixed_up = at.groupBy("key").agg(main.alias("main"), F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("key", "main")
    at = cut(at.join(mixed_up, "key").withColumn("outside", F.col("class") != F.col("main")).drop("main"))
    sizes = at.groupBy("key").agg(F.sum((~F.col("outside")).cast("long")).alias("n0"), F.sum(F.col("outside").cast("long")).alias("n1"))
    sizes = sizes.select("key", F.ceil(F.col("n0") / BLOCK).cast("int").alias("b0"), F.ceil(F.col("n1") / BLOCK).cast("int").alias("b1"))
    at = at.join(sizes, "key")
    of = lambda n: F.pmod(F.xxhash64("node", F.lit("block")), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inside = at.where("not outside").select("key", "band", of("b0").alias("i"), upto("b1").alias("j"), F.lit(0).alias("side"), "node", "class")
    outside = at.where("outside").withColumn("j", of("b1"))
    meets = outside.select("key", "band", upto("b0").alias("i"), "j", F.lit(1).alias("side"), "node", "class")
    # blocks of nodes outside meet each other: tile (-1 - low, high); the block itself where they are the same
    among = outside.select("key", "band", "j", upto("b1").alias("o"), "node", "class").select(
        "key", "band", (-1 - F.least("j", "o")).alias("i"), F.greatest("j", "o").alias("j"), F.when(F.col("j") == F.col("o"), 2).when(F.col("j") < F.col("o"), 0).otherwise(1).alias("side"), "node", "class"
    )
    tiles = inside.union(meets).union(among)
    in_order = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node")
    fields = "key long, i int, j int, side int, band int, node string, class long, sig binary"
    # first by registers alone, which tells who is in any candidate pair; texts travel for those only
    busy = cut(in_order(tiles.join(nodes.select("node", "sig"), "node").select(*TILE)).mapInArrow(_busy_rows, fields))
    return cut(in_order(_with_texts(busy, texts)).mapInArrow(_tile_links, "u string, v string"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id, digest, root for every row; class_id is the smallest id of the class, digest the md5 of the text.

    root is the smallest digest of the class: it tells classes apart whose smallest ids are equal or null. Null texts have none.
    """
    digest = F.md5(F.col(text_col).cast("binary"))
    slim = docs.select(F.col(id_col).alias("id"), digest.alias("node"), F.col(text_col).alias("text"))
    texts = slim.where("text is not null").select("node", "text")
    nodes = texts.mapInArrow(_signatures, "node string, keys array<long>, sig binary").dropDuplicates(["node"])
    nodes = cut(nodes.withColumn("h", F.xxhash64("node")))
    banded = F.array_distinct(F.transform("keys", lambda k, i: F.struct(k.alias("key"), (i % BANDS).alias("band"))))
    rows = nodes.select("h", F.inline(banded))
    pivots = [F.min(F.col("h").bitwiseXOR(F.lit(x).cast("long"))).bitwiseXOR(F.lit(x).cast("long")).alias(f"p{k}") for k, x in enumerate(PIVOTS)]
    buckets = cut(rows.groupBy("key").agg(F.count("*").alias("n"), *pivots).where("n > 1").drop("n"))
    shared = cut(rows.join(buckets.select("key"), "key"))
    links = _round_one(nodes, shared, buckets, texts)
    more = _round_two(nodes, shared, texts, links)
    classes = connected_components(links.union(more)).withColumnRenamed("root", "class")
    low = slim.where("node is not null").groupBy("node").agg(F.min("id").alias("low"))
    named = low.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    # by parts of classes first: a large class is then no task's own, and the planner may split its join
    part = F.pmod(F.xxhash64("node", F.lit("part")), F.lit(CLASS_PARTS))
    names = named.groupBy("class", part.alias("part")).agg(F.min("low").alias("low")).groupBy("class").agg(F.min("low").alias("class_id"))
    named = named.join(names, "class").select("node", "class_id", F.col("class").alias("root"))
    out = slim.select("id", "node").join(named, "node", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.col("node").alias("digest"), "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs that stand for their class: the row of its smallest id (one, if several rows have it); rows without text stay."""
    found = near_duplicates(docs, id_col, text_col).toDF("id", "low", "digest", "root").where("digest is not null and id <=> low")
    # by root: unrelated classes may have the same smallest id, or null
    stay = found.groupBy("root").agg(F.min("digest").alias("digest"), F.first("low").alias("low")).select(F.struct("digest", "low").alias("stands"))
    # names by position: whatever the columns are called
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own_id, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    rows = named.where(text.isNotNull()).withColumn("stands", F.struct(F.md5(text.cast("binary")).alias("digest"), own_id.alias("low")))
    kept = rows.dropDuplicates(["stands"]).join(stay, "stands", "left_semi")
    return kept.drop("stands").union(named.where(text.isNull())).toDF(*docs.columns)
