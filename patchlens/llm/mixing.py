"""Mixing sources to target weights by systematic sampling.

Size of a document: its words, ``[^\\x20\\x09-\\x0D]+``. Sources, in code point order with null last, weigh 1, 2, 3 and so
on in turn, and share 100 % of all sizes; a target stops at 3 times its source's size, and the excess is shared among the
others by weight until none is above. That is a water level: sources sorted by cap / weight fill up while the level that
would be left for the rest exceeds theirs.

Every document of a source is expected target / size times (3 at most). Documents of more than 0.5 % of their source's target
are settled first, largest first: their expected words are prefix-summed, and each is emitted as often as brings the words
taken so far up to that sum, rounded by the random offset. What they miss or exceed is shared by the source's other documents
as expected copies: these are prefix-summed, the offset is added, and a document is emitted once for every integer boundary
that its stretch crosses. They come in the order of strata (a hash of the id); within, sizes rise in one stratum and fall in
the next, so that what the rounding adds on the way up is given back on the way down. So sums miss a target by about 0.5 %,
unless a source has hardly any other than such documents.

Only DataFrame functions are used. Texts are read once, within the scan, and only (id, source, size) is shuffled. No task
gathers a source: settled documents hold more than a ``MOST``-th of their source each, so they are fewer than that; for the
others the prefix sum is taken over the strata's counts and within each stratum, of which there are about sqrt(rows of the
source) / 32 (an even number).

Null texts have no words: their size is 0, as for empty texts; they are drawn like others. A null source is a source of its
own. Repeated rows are documents each, and which of two equal rows is drawn makes no difference; documents of one size come in
the order of their ids, nulls first. If all sizes are 0, nothing is taken. Extra columns are ignored by ``copies`` and kept by
``mix``, whatever they are called.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_place, cut

CYCLE = 3
CAP = 3
SEED = 7
#: Documents beyond this share of their source's target, and beyond 1 / MOST of the source, are settled one by one.
LARGE, MOST = 0.005, 4096
STRATA = 64
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 100_000


def offset(seed: int = SEED) -> float:
    """The random offset in [0, 1)."""
    return random.Random(seed).random()


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, n, source_size, target) of ``sizes(source, n, source_size)``, a row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", (F.row_number().over(order) - 1) % CYCLE + 1)
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    left = F.sum("source_size").over(every) - CAP * F.coalesce(F.sum("source_size").over(before), zero)
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero)
    # the level if this source and all later ones share what earlier ones, filled up, leave
    filled = weighed.select("*", (left / weights).alias("level")).withColumn("open", F.col("level") * F.col("weight") <= CAP * F.col("source_size"))
    first = F.min(F.when(F.col("open"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("source").isNull().alias("z"), "source", "level"))).over(every)
    target = F.least(F.lit(float(CAP)) * F.col("source_size"), F.coalesce(first["level"], F.lit(0.0)) * F.col("weight"))
    return filled.select("source", "n", "source_size", target.alias("target"))


def _settled(rows: DataFrame, seed: int) -> DataFrame:
    """(source, large): the copies of each source's large rows(source, id, size, source_size, target), an array of (id, size, copies)."""
    listed = rows.groupBy("source", "source_size", "target").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("size"), "id"))).alias("all"))
    kind = rows.schema["id"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("taken"), F.array().cast(f"array<struct<id:{kind},size:bigint,copies:bigint>>").alias("out"))

    def add(state: Column, x: Column) -> Column:
        size = -x["size"]
        expected = F.col("target") / F.col("source_size") * (state["sum"] + size)
        n = F.least(F.greatest(F.floor((expected - state["taken"]) / size + F.lit(offset(seed))), F.lit(0).cast("long")), F.lit(CAP).cast("long"))
        return F.struct((state["sum"] + size).alias("sum"), (state["taken"] + n * size).alias("taken"), F.concat(state["out"], F.array(F.struct(x["id"].alias("id"), size.alias("size"), n.alias("copies")))).alias("out"))

    return listed.select("source", F.aggregate("all", start, add, lambda state: state["out"]).alias("large"))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """id, size, source_size, target, copies, taken (= copies x size) for every row."""
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")))
    goals = cut(targets(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))))
    few = goals.count() <= BROADCAST_ROWS
    small_side = lambda df: F.broadcast(df) if few else df
    same = lambda other: F.col("source").eqNullSafe(F.col(other))
    both = rows.join(small_side(goals.withColumnRenamed("source", "s")), same("s")).drop("s")
    is_large = F.col("size") > F.greatest(LARGE * F.col("target"), F.col("source_size") / MOST)
    settled = cut(_settled(both.where(is_large), seed))
    words = F.aggregate("large", F.lit(0).cast("long"), lambda t, x: t + x["copies"] * x["size"])
    large_size = F.aggregate("large", F.lit(0).cast("long"), lambda t, x: t + x["size"])
    rest = goals.join(small_side(settled.select(F.col("source").alias("s"), words.alias("words"), large_size.alias("large_size"))), same("s"), "left")
    zero = F.lit(0).cast("long")
    left, small = F.col("target") - F.coalesce("words", zero), F.col("source_size") - F.coalesce("large_size", zero)
    each = F.when(small > 0, F.least(F.greatest(left / small, F.lit(0.0)), F.lit(float(CAP)))).when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    strata = 2 * F.greatest(F.lit(1), F.ceil(F.floor(F.sqrt("n")) / STRATA)).cast("long")
    rest = cut(rest.select(F.col("source").alias("s"), "source_size", "target", strata.alias("strata"), each.alias("each")))
    key = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    others = rows.join(small_side(rest), same("s")).where(~is_large).withColumn("stratum", key % F.col("strata")).drop("s")
    cells = others.groupBy("source", "stratum").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)), zero)
    cells = cut(cells.select(F.col("source").alias("s"), F.col("stratum").alias("t"), before.alias("before")))
    if cells.count() <= BROADCAST_ROWS:
        cells = F.broadcast(cells)
    rising = F.when(F.col("stratum") % 2 == 0, F.col("size")).otherwise(-F.col("size"))
    place = F.row_number().over(Window.partitionBy("source", "stratum").orderBy(rising, "id"))
    placed = others.withColumn("place", place).join(cells, same("s") & (F.col("stratum") == F.col("t")))
    edge = lambda i: F.floor(F.col("each") * i + F.lit(offset(seed)))
    last = F.col("before") + F.col("place")
    drawn = placed.select("id", "source", "size", "source_size", "target", (edge(last) - edge(last - 1)).cast("long").alias("copies"))
    goal_of = goals.select(F.col("source").alias("s"), "source_size", "target")
    large = settled.select("source", F.inline("large")).join(small_side(goal_of), same("s")).select("id", "source", "size", "source_size", "target", "copies")
    drawn = drawn.union(large)
    return drawn.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """Rows of docs, each as often as it is drawn. Rows of the same id, source and size share their draws evenly, in the order of their texts."""
    rows, at = by_place(docs)
    key = lambda id_, source, size: F.to_json(F.struct(F.col(id_).alias("id"), F.col(source).alias("source"), size.alias("size")))
    drawn = copies(rows.select(at[id_col], at[source_col], at[text_col]), at[id_col], at[text_col], at[source_col], seed)
    drawn = drawn.groupBy(key(at[id_col], at[source_col], F.col("size")).alias("key")).agg(F.sum("copies").alias("n"), F.count("*").alias("rows")).where("n > 0")
    nth = F.row_number().over(Window.partitionBy("key").orderBy(at[text_col]))
    both = rows.withColumn("key", key(at[id_col], at[source_col], size_of(F.col(at[text_col])))).withColumn("nth", nth).join(drawn, "key")
    each = F.expr("CAST(n DIV rows + IF(nth <= n % rows, 1, 0) AS INT)")
    both = both.withColumn("each", each).where("each > 0")
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), "each"))).select(*[F.col(v).alias(c) for c, v in at.items()])


SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2 * greatest(1, CAST(ceil(floor(sqrt(count(*))) / {STRATA}) AS BIGINT)) AS strata FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {CYCLE} + 1 AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST) AS i FROM w),
l AS (
    SELECT *, CAST(sum(source_size) OVER () - {CAP} * (sum(source_size) OVER (ORDER BY i) - source_size) AS DOUBLE)
        / CAST(sum(weight) OVER () - (sum(weight) OVER (ORDER BY i) - weight) AS DOUBLE) AS level
    FROM o
),
g AS (SELECT i AS s, source, source_size, strata, least({CAP}.0::DOUBLE * source_size, coalesce((SELECT arg_min(level, i) FROM l WHERE level * weight <= {CAP} * source_size), 0) * weight) AS target FROM l),
a AS (
    SELECT d.doc_id, d.size, g.*, d.size > greatest({LARGE}::DOUBLE * target, CAST(source_size AS DOUBLE) / {MOST}) AS is_large,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % strata AS stratum
    FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
),
b AS (SELECT s, doc_id, size, target / source_size AS e, row_number() OVER (PARTITION BY s ORDER BY size DESC, doc_id NULLS FIRST) AS i FROM a WHERE is_large),
f AS (
    SELECT DISTINCT s, 0::BIGINT AS i, NULL::BIGINT AS doc_id, 0::BIGINT AS size, 0::BIGINT AS total, 0::BIGINT AS taken, 0::BIGINT AS n FROM b
    UNION ALL
    SELECT s, i, doc_id, size, total, taken + n * size, n
    FROM (
        SELECT b.s, b.i, b.doc_id, b.size, f.total + b.size AS total, f.taken, least(greatest(CAST(floor((b.e * (f.total + b.size) - f.taken) / b.size + {offset()!r}::DOUBLE) AS BIGINT), 0), {CAP}) AS n
        FROM f JOIN b ON b.s = f.s AND b.i = f.i + 1
    )
),
t AS (SELECT s, sum(n * size) AS words, sum(size) AS large_size FROM f GROUP BY s),
r AS (
    SELECT g.s, CASE WHEN source_size > coalesce(large_size, 0) THEN least(greatest((target - CAST(coalesce(words, 0) AS DOUBLE)) / CAST(source_size - coalesce(large_size, 0) AS DOUBLE), 0.0::DOUBLE), {CAP}.0::DOUBLE) ELSE 0.0::DOUBLE END AS e
    FROM g LEFT JOIN t USING (s)
),
p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY stratum, CASE WHEN stratum % 2 = 0 THEN size ELSE -size END, doc_id NULLS FIRST) AS i FROM a WHERE NOT is_large)
SELECT doc_id, size, source_size, target, CAST(floor(e * i + {offset()!r}::DOUBLE) - floor(e * (i - 1) + {offset()!r}::DOUBLE) AS BIGINT) * size AS taken FROM p JOIN r USING (s)
UNION ALL
SELECT doc_id, size, source_size, target, n * size AS taken FROM f JOIN g USING (s) WHERE f.i > 0
"""
