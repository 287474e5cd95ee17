"""Byte-level BPE by recursive queries.

Texts are split by the tokenizer's pattern; each distinct piece of a batch is encoded once. Pieces that are a token stand
for themselves. The others become token-position rows in an in-memory DuckDB: a recursive query joins neighbouring tokens
with the merge table, contracts each piece's leftmost pair of minimum rank, and goes on until no pair is left. Decoding
joins ids with the vocabulary and puts the bytes together by ordered aggregation, for whole documents in both
``decode_documents`` and ``round_trip``.

In long pieces (runs without a break) all pairs contract in a round whose neighbours can't be first, which is what one by one
would give: rounds grow with the depth of merges (some 3 to 6), not with the piece.

Everything happens within a task, batch by batch: no shuffle, memory bounded by a batch and a bounded cache of pieces, and
a lost executor's tasks simply run again. The rank file is read by the driver and broadcast (its size is fixed, about 1 MB).

Null texts count as empty; an empty text has no tokens. Repeated rows each get their row; other columns than the two
named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_BYTES = 4 << 20
#: Bytes of pieces that one recursive query takes at once.
ROUND_BYTES = 1 << 17
CACHE_PIECES = 300_000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Pieces of fewer bytes contract one pair a round, longer ones every pair that is settled; both give the same.
SHORT = 64
#: More than the places that one query of short pieces has (``ROUND_BYTES`` and a piece).
PLACES = 1 << 20

#: Table pieces(w, pos, tok, stop) -> each piece's ids in order; stop is the place of the next token of the piece, -1 behind
#: the last. Of a pair that contracts, the left place takes the new token, and the right one's is -1 from then on.
ENCODE_SHORT = f"""
WITH RECURSIVE state(w, pos, tok, stop) USING KEY (pos) AS (
    SELECT w, pos, tok, stop FROM pieces
  UNION ALL
    (
        WITH pairs AS MATERIALIZED (
            SELECT s.w, s.pos, s.tok, s.stop, n.stop AS after, m.rank
            FROM (SELECT * FROM state WHERE tok >= 0) s LEFT JOIN state n ON n.pos = s.stop LEFT JOIN merges m ON m.l = s.tok AND m.r = n.tok
        ),
        firsts AS (SELECT w, min(rank::BIGINT * {PLACES} + pos) AS first, arg_min(stop, rank::BIGINT * {PLACES} + pos) AS gone FROM pairs WHERE rank IS NOT NULL GROUP BY w)
        SELECT w, pos, CASE WHEN pos = first % {PLACES} THEN first // {PLACES} WHEN pos = gone THEN -1 ELSE tok END::INTEGER AS tok, CASE WHEN pos = first % {PLACES} THEN after ELSE stop END AS stop
        FROM pairs JOIN firsts USING (w)
    )
)
SELECT w, list(tok ORDER BY pos) AS toks FROM state WHERE tok >= 0 GROUP BY w ORDER BY w
"""
#: A pair (a, b) of rank r is settled if no longer token that could still form ends where a ends at a rank of r or less, and
#: none begins where b begins at one below r: only those could take a or b first. Table places(w, pos, stop, rank) has every
#: token that stands anywhere in a piece's text; those between present tokens' bounds could still form. In a run of
#: overlapping pairs of one rank every second one contracts, from the run's left, as far as all are settled. The leftmost pair
#: of minimum rank always goes.
ENCODE_LONG = """
WITH RECURSIVE state(w, pos, tok, round) USING KEY (w, pos) AS (
    SELECT w, pos, tok, 0 FROM pieces
  UNION ALL
    (
        WITH live AS MATERIALIZED (
            SELECT w, pos, tok, round, lead(tok) OVER near AS next, lead(pos) OVER near AS stop, row_number() OVER near AS nth
            FROM state WHERE tok >= 0 WINDOW near AS (PARTITION BY w ORDER BY pos)
        ),
        open AS MATERIALIZED (
            SELECT p.w, p.pos, p.stop, p.rank FROM places p JOIN live a ON a.w = p.w AND a.pos = p.pos LEFT JOIN live b ON b.w = p.w AND b.pos = p.stop
            WHERE p.rank <> a.tok AND (p.last OR b.pos IS NOT NULL)
        ),
        pairs AS (
            SELECT l.*, m.rank, coalesce(e.rank, 2147483647) AS ends, coalesce(b.rank, 2147483647) AS begins
            FROM live l LEFT JOIN merges m ON m.l = l.tok AND m.r = l.next
            LEFT JOIN (SELECT w, stop, min(rank) AS rank FROM open GROUP BY ALL) e ON e.w = l.w AND e.stop = l.stop
            LEFT JOIN (SELECT w, pos, min(rank) AS rank FROM open GROUP BY ALL) b ON b.w = l.w AND b.pos = l.stop
        ),
        beside AS (SELECT *, lag(rank) OVER (PARTITION BY w ORDER BY pos) AS before, min(rank) OVER (PARTITION BY w) AS lowest FROM pairs),
        judged AS (SELECT *, coalesce(rank = before, false) AS same, coalesce((rank < ends OR rank = before AND rank = ends) AND rank <= begins, false) AS settled FROM beside WHERE lowest IS NOT NULL),
        runs AS (
            SELECT *, rank = lowest AND row_number() OVER (PARTITION BY w, rank ORDER BY pos) = 1 AS leftmost,
                max(CASE WHEN NOT same THEN nth END) OVER upto AS run, max(CASE WHEN NOT settled THEN nth ELSE -1 END) OVER upto AS unsettled
            FROM judged WINDOW upto AS (PARTITION BY w ORDER BY pos)
        ),
        hits AS (SELECT *, rank IS NOT NULL AND (leftmost OR (nth - run) % 2 = 0 AND run > unsettled) AS hit FROM runs)
        SELECT w, pos, CASE WHEN hit THEN rank WHEN lag(hit) OVER (PARTITION BY w ORDER BY pos) THEN -1 ELSE tok END AS tok, round + 1 FROM hits
    )
)
SELECT w, list(tok ORDER BY pos) AS toks FROM state WHERE tok >= 0 GROUP BY w ORDER BY w
"""

DECODE = """
SELECT i.doc, string_agg(v.text, '' ORDER BY i.pos) AS text
FROM ids i JOIN vocabulary v ON v.id = i.id GROUP BY i.doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(l, r, rank): every way to put two tokens together to one."""
    rows = []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                rows.append((left, right, rank))
    return pa.table(dict(zip(("l", "r", "rank"), np.array(rows, np.int32).reshape(-1, 3).T, strict=True)))


class Places:
    """Finds the tokens that stand anywhere in pieces, by polynomials of their bytes modulo 2^64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, ranks: dict[bytes, int]):
        by_size: dict[int, list[tuple[bytes, int]]] = {}
        for token, rank in ranks.items():
            by_size.setdefault(len(token), []).append((token, rank))
        self.tables = []
        for n in sorted(by_size.keys() - {1}):
            tokens = np.frombuffer(b"".join(t for t, _ in by_size[n]), np.uint8).reshape(-1, n).astype(np.uint64) + np.uint64(1)
            hashes = (tokens * self.powers(self.BASE, n)).sum(axis=1, dtype=np.uint64)
            order = np.argsort(hashes)
            self.tables.append((n, hashes[order], np.array([r for _, r in by_size[n]], np.int32)[order]))

    @staticmethod
    def powers(x: int, n: int) -> np.ndarray:
        out = np.full(n, np.uint64(x))
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)

    def of(self, data: np.ndarray, w: np.ndarray) -> pa.Table:
        """(w, pos, stop, rank, last) of the tokens of two bytes or more in pieces, whose bytes follow one another; w says which piece a byte is in."""
        size = len(data)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers(self.BASE, size), dtype=np.uint64, out=sums[1:])
        back = self.powers(pow(self.BASE, -1, 1 << 64), size + 1)
        first, end = np.searchsorted(w, w), np.searchsorted(w, w, side="right")
        found = []
        for n, hashes, ranks in self.tables:
            at = np.arange(max(0, size - n + 1))
            at = at[end[at] >= at + n]
            own = (sums[at + n] - sums[at]) * back[at]
            i = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            hit = hashes[i] == own
            at, i = at[hit], i[hit]
            found.append((w[at], at - first[at], at - first[at] + n, ranks[i], end[at] == at + n))
        w, pos, stop, rank, last = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"w": w.astype(np.int32), "pos": pos.astype(np.int32), "stop": stop.astype(np.int32), "rank": rank, "last": last})


#: The pattern that ``Splitter`` follows by arrays; any other one is left to the regular expression engine.
KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, OTHER, SPACE = range(4)


class Splitter:
    """Cuts texts into a pattern's matches. For the known pattern, from the bounds of runs of letters, numbers, others, spaces."""

    def __init__(self, pattern: str):
        import regex

        self.find = None
        if pattern != KNOWN_PATTERN:
            self.find = regex.compile(pattern).findall
            return
        self.kinds = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, chars in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(chars, every):
                self.kinds[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
        self.kinds[0xD800:0xE000] = OTHER

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(all pieces in order, how many each text has)"""
        if self.find:
            split = [self.find(t) for t in texts]
            return [x for pieces in split for x in pieces], np.array([len(x) for x in split], np.int64)
        text = "".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        if not text:
            return [], np.zeros(len(texts), np.int64)
        chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kinds = self.kinds[chars]
        first = np.zeros(len(chars) + 1, bool)  # of a text
        first[0] = first[ends] = True
        cut = first.copy()
        cut[1:-1] |= kinds[1:] != kinds[:-1]
        runs = np.flatnonzero(cut[:-1])
        stops = np.append(runs[1:], len(chars))
        kind = kinds[runs]
        # white space before something else: its last character is on its own, or, if a plain space, goes with what follows
        before = (kind == SPACE) & ~first[stops]
        last = stops[before] - 1
        plain = chars[last] == 32
        cut[last] = True
        cut[last[plain] + 1] = False
        # an apostrophe that begins a piece, and the letters that it takes
        for at in runs[(kind == OTHER) & (stops - runs == 1) & (chars[runs] == 39) & cut[runs]]:
            tail = text[at + 1 : at + 3]
            n = 2 if tail in ("re", "ve", "ll") else 1 if tail[:1] in ("s", "t", "m", "d") and tail else 0
            if n and not first[at + 1 : at + 1 + n].any():
                cut[at + 1] = False
                cut[at + 1 + n] = True
        starts = np.flatnonzero(cut[:-1]).tolist()
        pieces = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=True)]
        counts = np.searchsorted(starts, ends, side="left")
        return pieces, np.diff(counts, prepend=0)


class Codec:
    """Encodes and decodes batches of texts in one Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb

        self.ranks = ranks
        self.split = Splitter(pattern)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.places: Places | None = None
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "max_temp_directory_size": "0B"})
        self.db.register("merge_rows", merge_table(ranks))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        ids, tokens = list(ranks.values()), list(ranks)
        self.db.register("vocabulary_rows", pa.table({"id": pa.array(ids, pa.int32()), "text": [t.decode("latin-1") for t in tokens]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_rows")
        self.bytes = np.zeros(256, np.int32)
        for b in range(256):
            self.bytes[b] = ranks[bytes([b])]

    def contract(self, pieces: list[bytes], query: str) -> Iterator[bytes]:
        """The ids of each piece."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        w = np.repeat(np.arange(len(pieces)), sizes)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(pieces), np.uint8)
        rows = {"w": w.astype(np.int32), "pos": np.arange(len(w), dtype=np.int32), "tok": self.bytes[data]}
        if query == ENCODE_LONG:
            self.places = self.places or Places(self.ranks)
            self.db.register("places", self.places.of(data, w))
            rows["pos"] -= starts[w].astype(np.int32)
        else:
            rows["stop"] = rows["pos"] + 1
            rows["stop"][starts + sizes - 1] = -1
        self.db.register("pieces", pa.table(rows))
        found = self.db.sql(query).to_arrow_table().combine_chunks()
        toks = found["toks"].combine_chunks()
        values, ends = toks.flatten().to_numpy(zero_copy_only=False).astype("<u4"), toks.offsets.to_numpy()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield values[a:b].tobytes()

    def learn(self, words: set[str]) -> None:
        """Puts the ids of pieces that aren't in the cache there. What a full cache held is only looked up again."""
        if len(self.words) + len(words) > CACHE_PIECES:
            self.words, self.older = {}, self.words
        new = [x for x in words if x not in self.words]
        if self.older:
            self.words |= {x: self.older[x] for x in new if x in self.older}
            new = [x for x in new if x not in self.older]
        short, long = [], []
        for x in new:
            data = x.encode()
            rank = self.ranks.get(data)
            if rank is not None:
                self.words[x] = rank.to_bytes(4, "little")
            else:
                (short if len(data) < SHORT else long).append((x, data))
        for pieces, query in ((short, ENCODE_SHORT), (long, ENCODE_LONG)):
            for part in parts(pieces, lambda p: len(p[1]), ROUND_BYTES):
                self.words |= zip((x for x, _ in pieces[part]), self.contract([p for _, p in pieces[part]], query), strict=True)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        pieces, counts = self.split(texts)
        self.learn(set(pieces))
        ends = np.cumsum(counts).tolist()
        return [b"".join(map(self.words.__getitem__, pieces[a:b])) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        arrays = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
        sizes = np.fromiter(map(len, arrays), np.int64, len(arrays))
        doc = np.repeat(np.arange(len(arrays), dtype=np.int32), sizes)
        flat = np.concatenate([*arrays, np.zeros(0, np.int32)])
        self.db.register("ids", pa.table({"doc": doc, "pos": np.arange(len(flat), dtype=np.int64), "id": flat}))
        out = [b""] * len(arrays)
        for d, text in self.db.execute(DECODE).fetchall():
            out[d] = text.encode("latin-1")
        return out


def parts(values: list, size_of, most: int) -> Iterator[slice]:
    """Slices of consecutive values that hold about ``most`` at most (a larger value stands alone)."""
    start = held = 0
    for i, v in enumerate(values):
        n = size_of(v)
        if held and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(values):
        yield slice(start, len(values))


def _rows(batches, codec: Codec, make) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for part in parts(texts, len, BATCH_BYTES // 4):
            yield make(codec, batch.slice(part.start, part.stop - part.start).column(0), texts[part])


def _codec_of(broadcast, pattern: str) -> Codec:
    """One codec a Python worker: building it takes a second."""
    global _CODEC
    key = (broadcast.value["name"], pattern)
    if _CODEC is None or _CODEC[0] != key:
        _CODEC = (key, Codec(broadcast.value["ranks"], pattern))
    return _CODEC[1]


_CODEC = None


def default_tokenizer() -> tuple[str, str]:
    """(path, pattern) of the rank file of the box."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (binary: little-endian unsigned 32-bit) of every text."""
    if path is None or pattern is None:
        path, pattern = default_tokenizer()
    ranks = docs.sparkSession.sparkContext.broadcast({"name": path, "ranks": read_ranks(path)})

    def make(codec, keys, texts):
        ids = codec.encode(texts)
        return pa.RecordBatch.from_arrays([keys, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    slim = docs.select(id_col, text_col)
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(lambda it: _rows(it, _codec_of(ranks, pattern), make), f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """id, decoded (binary) of every row of ids."""
    if path is None:
        path = default_tokenizer()[0]
    ranks = encoded.sparkSession.sparkContext.broadcast({"name": path, "ranks": read_ranks(path)})

    def run(it):
        codec = _codec_of(ranks, "")
        for batch in it:
            ids = [x or b"" for x in batch.column(1).to_pylist()]
            for part in parts(ids, len, BATCH_BYTES // 2):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), pa.array(codec.decode(ids[part]), pa.binary())], ["id", "decoded"])

    slim = encoded.select(id_col, "ids")
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def _digests(codec: Codec, keys: pa.Array, texts: list[str]) -> pa.RecordBatch:
    """Digests of each text's ids, and of what these ids decode to as a whole."""
    ids = codec.encode(texts)
    decoded = [x for part in parts(ids, len, BATCH_BYTES // 2) for x in codec.decode(ids[part])]
    digest = lambda rows: pa.array([hashlib.sha256(x).hexdigest() for x in rows])
    return pa.RecordBatch.from_arrays([keys, pa.array([len(x) // 4 for x in ids], pa.int64()), digest(ids), digest(decoded)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes the ids, and keeps digests of both within the same task."""
    if path is None or pattern is None:
        path, pattern = default_tokenizer()
    ranks = docs.sparkSession.sparkContext.broadcast({"name": path, "ranks": read_ranks(path)})
    slim = docs.select(id_col, text_col)
    kind = slim.schema[0].dataType.simpleString()
    return slim.mapInArrow(lambda it: _rows(it, _codec_of(ranks, pattern), _digests), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
