r"""Line dedup: cross-site boilerplate by distinct-site spread, in DataFrame functions alone.

A line (texts split at \n; at least one character that isn't ASCII white space) is boilerplate if MIN_SITES or more
distinct sites have it.  HyperLogLog sketches of the sites, one per line hash, merge by aggregation and give an
estimate; lines near the threshold get an exact distinct count.  The first place of a boilerplate line (smallest id, then
position) stays, so one copy of its words survives; its other places go.

Defined cases: a null text has no lines and stays null; blank lines are never boilerplate; a null site counts as no
site; a null id sorts first; rows with the same id and text get the same result; other columns are ignored or, in
`without_boilerplate`, kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm.common import free_prefix, frequent, key, row_key, table, written

MIN_SITES = 8
#: log2 of a sketch's registers; a relative error of about 2 % above a few hundred sites, none to speak of below.
LG_K = 12
#: Estimates within this factor of the threshold are counted exactly: tens of standard errors.
NEAR = 1.5
#: Lines that are broadcast, some 60 bytes each: all wanted ones if they are no more, or else the most frequent.
HOT = 200_000
#: A line, and a row, by 128 bits each.
LINE, ROW = ["h1", "h2"], ["k1", "k2"]


def lines_of(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, ROW, site, pos, LINE) for every line that isn't blank."""
    rows = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col, ROW), F.when(F.col(site_col).isNotNull(), F.xxhash64(site_col)).alias("site"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("id", *ROW, "site", "pos", *key(LINE, F.col("line")))


def meeting(lines: DataFrame, wanted: DataFrame, most: int = HOT) -> DataFrame:
    """lines joined with wanted (LINE, n, ...), n being how often a line occurs.

    Few wanted lines are broadcast.  Of many, the most frequent are, so that no line in the shuffle join that meets the others has more than
    a share of about 1 / most of all lines.
    """
    if wanted.count() <= most:
        return lines.join(F.broadcast(wanted), LINE)
    hot = frequent(wanted, "n", most)
    rest = wanted.join(F.broadcast(hot.select(*LINE)), LINE, "left_anti")
    cold = lines.join(F.broadcast(hot.select(*LINE)), LINE, "left_anti")
    return lines.join(F.broadcast(hot), LINE).unionByName(cold.join(rest, LINE))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, most: int = HOT) -> DataFrame:
    """(LINE, n, first): boilerplate lines with how often they occur and their first place."""
    spread = lines.groupBy(*LINE).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.count("*").alias("n"), F.min(F.struct("id", "pos")).alias("first"))
    likely = written(spread.where(F.col("sites") >= min_sites / NEAR), "lines")
    sure, near = likely.where(F.col("sites") > min_sites * NEAR), likely.where(F.col("sites") <= min_sites * NEAR)
    # each task meets a pair of line and site once, however often it occurs
    pairs = meeting(lines.select(*LINE, "site"), near.select(*LINE, "n"), most).select(*LINE, "site").distinct()
    exact = pairs.groupBy(*LINE).agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites)
    return written(sure.unionByName(near.join(exact.select(*LINE), LINE, "left_semi")).select(*LINE, "n", "first"), "boilerplate")


def removals(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", most: int = HOT) -> DataFrame:
    """(ROW, gone): per row key, the positions of the lines that go."""
    lines = lines_of(docs, id_col, text_col, site_col)
    hit = meeting(lines, boilerplate(lines, min_sites, most), most)
    gone = hit.where(~(F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.pos") == F.col("pos"))))
    return gone.groupBy(*ROW).agg(F.collect_set("pos").alias("gone"))


def cleaned(text: Column, gone: Column) -> Column:
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.coalesce(F.array_contains(gone, i), F.lit(False)))
    return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))


def marked(docs: DataFrame, gone: str, min_sites: int, id_col: str, text_col: str, site_col: str, most: int = HOT) -> DataFrame:
    """docs with a column `gone`: null, or the positions of the lines that go."""
    names = [gone + "1", gone + "2"]
    found = removals(docs, min_sites, id_col, text_col, site_col, most).select(F.col(ROW[0]).alias(names[0]), F.col(ROW[1]).alias(names[1]), F.col("gone").alias(gone))
    return docs.select("*", *row_key(id_col, text_col, names)).join(found, names, "left").drop(*names)


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", most: int = HOT) -> DataFrame:
    """docs with boilerplate lines gone from the texts; all other columns as they were."""
    gone = free_prefix(docs.columns) + "gone"
    rows = marked(docs, gone, min_sites, id_col, text_col, site_col, most)
    return rows.select(*(cleaned(F.col(c), F.col(gone)).alias(c) if c == text_col else F.col(c) for c in docs.columns))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those removed, and the length and MD5 of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = marked(docs, "gone", MIN_SITES, "doc_id", "text", "source").withColumn("clean", cleaned(F.col("text"), F.col("gone")))
    return rows.select("doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.length("clean").cast("long").alias("n_chars"), F.md5(F.encode("clean", "UTF-8")).alias("text_md5"))


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d WHERE ls IS NOT NULL),
b AS (SELECT line, min((doc_id, pos)) AS f FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
      GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
g AS (SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AND (l.doc_id, l.pos) <> b.f AS gone FROM l LEFT JOIN b ON l.line = b.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS n_chars,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_md5
FROM g GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL, NULL FROM documents WHERE text IS NULL
"""
