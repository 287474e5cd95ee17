"""Line dedup by site-relative frequency.

A line's ratio on a site is the number of the site's pages that contain it (repeats within a page count once) by the number of
all its pages. Lines whose ratio is above ``max_ratio`` are boilerplate there and are dropped from the site's pages. A line
that stands on one page only repeats nothing and stays, whatever the site's size: else a site of one page would lose its whole
text. There is no other condition, so large and small sites are alike. Lines are compared without white space at their ends;
blank lines are kept and never counted. A page of nothing but boilerplate keeps its blank lines only, or becomes empty.

Only DataFrame functions are used. Lines travel as 128-bit hashes, pre-aggregated before their shuffle; page texts aren't
shuffled at all while the boilerplate table is small (its rows are counted; a site's are at most lines-a-page / max_ratio).
Beyond the bound, page texts are joined by site, and the planner splits large sites.

Null texts stay null, empty ones empty, and both count as pages. A null site is a site of its own. Repeated rows are pages
each, and so count as pages that share their lines. Lines of one ratio are treated alike: there are no ties to break. Extra
columns are kept, whatever they are called; the two columns of counts are added, or replace those of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_place, cut

MAX_RATIO = 0.05
#: Rows of (site, line) that are broadcast at most: 36 bytes each.
BROADCAST_LINES = 100_000


def _key(line: Column) -> Column:
    """128 bits of a line without white space at its ends, as text; null for blank lines."""
    bare = F.regexp_replace(line, r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "")
    return F.when(bare != "", F.md5(bare))


def boilerplate(pages: DataFrame, site_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """(site, line, pages, total): lines above the ratio; line is the md5 of the line without white space at its ends."""
    slim = pages.select(F.col(site_col).alias("site"), F.col(text_col).alias("text"))
    totals = slim.groupBy("site").agg(F.count("*").alias("total")).withColumnRenamed("site", "site_")
    lines = slim.select("site", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), _key))).alias("line"))
    counts = lines.where("line is not null").groupBy("site", "line").agg(F.count("*").alias("pages")).where("pages > 1")
    both = counts.join(totals, F.col("site").eqNullSafe(F.col("site_")))
    return both.where(F.col("pages") > max_ratio * F.col("total")).select("site", "line", "pages", "total")


def drop_boilerplate(pages: DataFrame, site_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """All rows and columns of pages, text_col without its site's boilerplate, and lines_total, lines_dropped (int) added or replaced."""
    rows, at = by_place(pages)
    text = F.col(at[text_col])
    found = cut(boilerplate(rows, at[site_col], at[text_col], max_ratio).select("site", "line"))
    # one row a site; a site has few such lines, see above
    by_site = found.groupBy("site").agg(F.collect_set("line").alias("boilerplate"))
    if found.count() <= BROADCAST_LINES:
        by_site = F.broadcast(by_site)
    joined = rows.join(by_site, F.col(at[site_col]).eqNullSafe(F.col("site")), "left")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains("boilerplate", _key(x)), F.lit(False)))
    joined = joined.select(*at.values(), F.coalesce(F.size(lines), F.lit(0)).alias("total"), F.when(F.col("boilerplate").isNotNull() & text.isNotNull(), kept).alias("kept"))
    dropped = F.coalesce(F.col("total") - F.size("kept"), F.lit(0))
    shorter = F.when(dropped > 0, F.array_join("kept", "\n")).otherwise(text)
    names = [c for c in pages.columns if c not in ("lines_total", "lines_dropped")]
    total = F.when(text.isNull(), 0).otherwise(F.col("total"))
    return joined.select(*[(shorter if c == text_col else F.col(at[c])).alias(c) for c in names], total.alias("lines_total"), dropped.alias("lines_dropped"))


#: The query on documents, for DuckDB.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, regexp_replace(line, '^[\\x09-\\x0D\\x20]+|[\\x09-\\x0D\\x20]+$', '', 'g') AS bare FROM l),
t AS (SELECT source, count(*) AS total FROM d GROUP BY source),
b AS (
    SELECT k.source, bare FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
    WHERE bare <> '' GROUP BY k.source, bare, total
    HAVING count(DISTINCT r) > 1 AND count(DISTINCT r) > CAST({MAX_RATIO} AS DOUBLE) * total
),
m AS (SELECT k.*, EXISTS (SELECT 1 FROM b WHERE b.bare = k.bare AND b.source IS NOT DISTINCT FROM k.source) AS hit FROM k),
s AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT hit) AS kept FROM m GROUP BY r)
SELECT d.doc_id, CASE WHEN hits > 0 THEN coalesce(kept, '') ELSE text END AS text,
    CAST(CASE WHEN text IS NULL THEN 0 ELSE n END AS INTEGER) AS lines_total, CAST(coalesce(hits, 0) AS INTEGER) AS lines_dropped
FROM d LEFT JOIN s USING (r)
"""
