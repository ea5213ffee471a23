"""Line dedup over overlapping three-line windows, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import skew_join, written

SIZE = 3


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """(id, own, pos, hash): every window of ``size`` consecutive lines with a word in it, lines and their order hashed to 128 bits."""
    rows = docs.select("id", "own", F.split("text", "\n").alias("lines")).where(F.size("lines") >= size)
    spot = rows.select("id", "own", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - size)).alias("pos"))
    text = F.concat_ws("\n", F.slice("lines", F.col("pos") + 1, size))
    return spot.select("id", "own", "pos", text.alias("w")).where(F.col("w").rlike("[^ \t\n\r\f\x0b]")).select("id", "own", "pos", F.unhex(F.md5("w")).alias("hash"))


def repeated_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(id, own, pos) of each window that occurred before: in the order of (id, own, place), all occurrences but the first. docs: (id, own, text), where ``own`` tells texts of one id apart."""
    spots = written(_windows(docs, size), "windows")
    first = spots.groupBy("hash").agg(F.min(F.struct("id", "own", "pos")).alias("first"), F.count("*").alias("w")).where(F.col("w") > 1)
    total = spots.count()
    met = skew_join(spots, first, "hash", "w", total, "id", "inner")
    return met.where(F.struct("id", "own", "pos") > F.col("first")).select("id", "own", "pos")


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` with the text of each document less the lines that later occurrences of a window cover, and the columns lines_before and lines_removed.

    Lines end at \\n and are compared exactly. A window is ``size`` consecutive lines of one document
    with a word among them. Of equal windows the one with the smallest (id, place) stays; the lines of
    all others go, windows that overlap being merged, so a repeated passage of any length goes whole.
    Texts with fewer lines than a window, null and empty texts stay as they are. Rows that repeat an
    id and a text are one document and are treated alike; rows with equal ids and different texts are
    documents of their own, in the order of a hash of their texts. Rows without an id are never compared. Other columns stay, whatever
    their names, but for ones named lines_before or lines_removed, which are replaced; an empty table
    stays empty. Passages that fill one or two lines only are no window and stay.
    """
    base = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("own", F.xxhash64("text"))
    gone = repeated_windows(base, size).groupBy("id", "own").agg(F.collect_set("pos").alias("starts"))
    # rows go as one column, so that their names cannot clash with others
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("key"), F.xxhash64(text_col).alias("hash"))
    out = rows.join(gone, (rows["key"] == gone["id"]) & (rows["hash"] == gone["own"]), "left")
    # a transform calls its function for each line: the lines are cut once, above it
    out = out.withColumn("lines", F.split(F.col("row")[text_col], "\n"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + size - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered)
    out = out.withColumn("kept", F.when(F.col("starts").isNotNull(), kept))
    rest = F.array_join(F.transform("kept", lambda k: F.get("lines", k)), "\n")
    removed = F.when(F.col("starts").isNotNull(), F.size("lines") - F.size("kept")).otherwise(0)
    text = F.when(F.col("starts").isNotNull(), rest).otherwise(F.col("row")[text_col])
    out = out.select("row", F.struct(text.alias("text"), F.coalesce(F.size("lines"), F.lit(0)).alias("before"), removed.alias("removed")).alias("new"))
    others = [F.col("row")[c].alias(c) for c in docs.columns if c not in (text_col, "lines_before", "lines_removed")]
    return out.select(*others, F.col("new.text").alias(text_col), F.col("new.before").alias("lines_before"), F.col("new.removed").alias("lines_removed"))


ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
w AS (SELECT doc_id, pos, array_to_string(lines[pos + 1 : pos + 3], chr(10)) AS w
      FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM d WHERE len(lines) >= 3)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM w WHERE regexp_matches(w, '[^ \t\n\r\f\x0b]')),
g AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE k > 1),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS pos FROM d),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS text, count(*) AS n FROM l ANTI JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT a.doc_id, CASE WHEN d.doc_id IS NULL THEN a.text ELSE coalesce(k.text, '') END AS text, CAST(coalesce(len(d.lines), 0) AS INTEGER) AS lines_before,
       CAST(CASE WHEN d.doc_id IS NULL THEN 0 ELSE len(d.lines) - coalesce(k.n, 0) END AS INTEGER) AS lines_removed
FROM documents a LEFT JOIN d USING (doc_id) LEFT JOIN k ON k.doc_id = a.doc_id
"""
