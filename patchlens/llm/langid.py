"""Language identification by compression.

Each language's raw-content zstandard dictionary is made of passages from a bounded sample of its labelled documents. A text
is cut into chunks (so that a long text cannot become its own dictionary), every chunk is compressed with every dictionary,
and the language with the smallest total wins. Letters are lower-cased first, so shouting compresses like prose.

The margin is how much smaller the best total is than the second best, as a share of the latter; ``rejected`` says that
it is below ``MIN_MARGIN``. The score is the best language's share when languages are weighed by 2^(-bits saved / text length).

Learning takes a bounded sample of the rows that the caller calls labelled (null languages are left out): their whole texts
are cut into passages of ``PASSAGE`` characters, and each language's dictionary is made of the ``SAMPLE_PASSAGES`` passages
with the smallest hashes of id and place (reruns agree). Of more than ``MAX_LANGUAGES`` languages the most frequent ones are
learnt, ties by name. Scoring covers every text whole, within its task; nothing is shuffled.

Null texts and texts without a letter are ``und`` with score 0; so is everything if there is no labelled row. Repeated rows
each get their row; other columns are ignored. Languages of equal size tie to the more frequent one, then by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_PASSAGES = 150
PASSAGE = 600
MAX_LANGUAGES = 500
CHUNK = 1000
MIN_MARGIN = 0.01
UNDETERMINED = "und"


def learn_dictionaries(docs: DataFrame, labelled: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Language -> dictionary content, the most frequent language first: it wins ties."""
    known = docs.where(labelled & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.lower(text_col).alias("text"))
    pieces = F.ceil(F.length("text") / PASSAGE).cast("long")
    counts = known.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(pieces).alias("pieces")).orderBy(F.col("rows").desc(), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return {}
    every = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], max(1, r["pieces"] // (2 * SAMPLE_PASSAGES)))])
    # hashes first, so that only chosen passages are cut out of their texts
    key = lambda i: F.xxhash64("id", i, F.length("text"), F.lit("passage"))
    chosen = F.filter(F.sequence(F.lit(0).cast("long"), pieces - 1), lambda i: F.pmod(key(i), F.element_at(every, F.col("lang"))) == 0)
    passages = known.where(F.element_at(every, F.col("lang")).isNotNull()).select("lang", "id", "text", F.explode(chosen).alias("i"))
    passages = passages.select("lang", key(F.col("i")).alias("key"), F.substring("text", F.col("i").cast("int") * PASSAGE + 1, F.lit(PASSAGE)).alias("passage")).distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("key", "passage"))
    of: dict[str, list[tuple[int, str]]] = {}
    for r in passages.withColumn("k", first).where(F.col("k") <= SAMPLE_PASSAGES).collect():
        of.setdefault(r["lang"], []).append((r["k"], r["passage"]))
    rows = {r["lang"]: r["rows"] for r in counts}
    return {k: "\n".join(p for _, p in sorted(of[k])).encode() for k in sorted(of, key=lambda k: (-rows[k], k))}


class Compressors:
    """Digested dictionaries of one Python worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as zstd

        self.languages = list(dictionaries)
        self.tools = []
        how = zstd.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=17, search_log=3, min_match=4, target_length=8, strategy=zstd.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
        for content in dictionaries.values():
            content = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=how)
            self.tools.append(zstd.ZstdCompressor(dict_data=content, compression_params=how))

    def sizes(self, text: str) -> np.ndarray:
        """Total compressed bytes of the chunks under each dictionary."""
        text = " " + text.lower()
        chunks = [text[i : i + CHUNK].encode() for i in range(0, len(text), CHUNK)]
        return np.array([sum(len(t.compress(c)) for c in chunks) for t in self.tools], float)

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        if not text or not self.tools or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        sizes = self.sizes(text)
        order = np.argsort(sizes, kind="stable")
        best = sizes[order[0]]
        weights = np.exp2(-64 * (sizes - best) / max(best, 1.0))
        margin = 1.0 if len(sizes) == 1 else float((sizes[order[1]] - best) / max(sizes[order[1]], 1.0))
        return self.languages[order[0]], float(1 / weights.sum()), margin < MIN_MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, rejected for every row. Dictionaries (bounded, see above) are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        tools = Compressors(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = list(zip(*map(tools.classify, part.column(1).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found)], ["id", "lang_pred", "score", "rejected"])

    slim = docs.select(id_col, text_col)
    return slim.mapInArrow(run, f"id {slim.schema[0].dataType.simpleString()}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
