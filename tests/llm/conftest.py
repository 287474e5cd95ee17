import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as columns of the input.
CLASHES = ["id", "node", "key", "keys", "sig", "size", "target", "taken", "copies", "place", "score", "stats", "site", "line", "total", "lines_total", "u", "v", "class", "class_id", "hash", "media", "host", "path", "rule", "rank", "x", "c0", "c1", "kept", "boilerplate", "lines_dropped", "stands", "digest", "root", "low", "n", "rows", "nth", "each", "copy", "stratum", "s", "__site", "__lines", "__n", "__kept", "__key", "__nth", "__each", "__copy", "__rows", "__d", "__id", "__digest", "__text", "__words"]


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, clashes=False):
        full = [(*r, *[None] * (5 - len(r)))[:5] for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES]) if clashes else df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return [(1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (2, None, None, None), (None, "seven eight nine ten eleven", "en", None), (3, "", "fr", "a"), (4, "", "fr", "b"),
            (5, " \n \t", "en", "b"), (6, long, "en", "a"), (7, "x", None, "b"), (None, None, None, None), (8, "été à l'école — ß 日本 🙂\n\nfin", "fr", "b")]
