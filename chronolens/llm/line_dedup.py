"""Line dedup: overlapping three-line windows, repeated anywhere in the corpus, lose their later occurrences.

A window is three consecutive lines of one document, identified by 128 bits of hash. The first occurrence in
(doc_id, line) order stays; every line covered by a later occurrence goes. The windows are counted with map-side partial
aggregation, only repeated ones are joined back, and the join is a plain shuffled equi-join that adaptive execution can
split where one passage holds a third of the windows.

Defined cases: texts that are null or have fewer than three lines have no window and stay as they are; three blank lines
are no window; rows that agree in doc_id and text count as one document and share its result; a document may lose all
its lines, its text is then empty and lines_kept 0; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

WIDTH = 3


def line_windows(docs: DataFrame, row: str) -> DataFrame:
    """doc_id, row (hash of id and text), h1, h2 (window hash) and at (first line, from 0) of every window."""
    windows = F.transform(
        F.sequence(F.lit(1), F.size("lines") - (WIDTH - 1)),
        lambda i: F.array_join(F.slice("lines", i, WIDTH), "\n"),
    )
    return (
        docs.select("doc_id", F.col(row).alias("row"), F.split("text", "\n").alias("lines"))
        .filter(F.size("lines") >= WIDTH)
        .select("doc_id", "row", F.posexplode(windows).alias("at", "window"))
        .filter(F.col("window").rlike(r"[^\s]"))
        .select("doc_id", "row", "at", F.xxhash64("window").alias("h1"), F.xxhash64(F.lit("second"), "window").alias("h2"))
    )


def dedup_lines(docs: DataFrame, counts: tuple[str, str] = ("lines_in", "lines_kept")) -> DataFrame:
    """docs with text cut to the lines that stay, plus the lines of before and after (null text: 0 and 0), named by counts; columns of these names are replaced."""
    lines_in, lines_kept = counts
    docs = docs.drop(*counts)
    row, id_, same, starts = free_name(docs.select("*", F.lit(0).alias(lines_in), F.lit(0).alias(lines_kept)), "row", "id", "same", "starts")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    windows = line_windows(keyed, row)
    repeated = (
        windows.groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "row", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").drop("n")
    )
    later = windows.join(repeated, ["h1", "h2"]).filter(F.struct("doc_id", "row", "at") > F.col("first"))
    covered = later.groupBy(F.col("doc_id").alias(id_), F.col("row").alias(same)).agg(F.collect_set("at").alias(starts))
    lines = F.split("text", "\n")
    gone = F.flatten(F.transform(starts, lambda p: F.sequence(p, p + (WIDTH - 1))))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return (
        keyed.join(covered, F.col(id_).eqNullSafe(F.col("doc_id")) & (F.col(same) == F.col(row)), "left")
        .withColumn(lines_in, F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
        .withColumn(lines_kept, F.when(F.col(starts).isNull(), F.col(lines_in)).otherwise(F.size(stay)).cast("long"))
        .withColumn("text", F.when(F.col(starts).isNull(), F.col("text")).otherwise(kept))
        .drop(row, id_, same, starts)
    )


def op8_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_in", "lines_kept")


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
  FROM documents
), windows AS (
  SELECT doc_id, line_no, line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w AS win
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), ranked AS (
  SELECT doc_id, line_no, row_number() OVER (PARTITION BY win ORDER BY doc_id, line_no) AS nth
  FROM windows WHERE win IS NOT NULL AND regexp_matches(win, '[^\\s]')
), gone AS (
  SELECT DISTINCT doc_id, line_no + d AS line_no FROM ranked, (VALUES (0), (1), (2)) AS v(d) WHERE nth > 1
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.line_no) AS text, count(*) AS lines_kept
  FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS lines_in, coalesce(k.lines_kept, 0)::BIGINT AS lines_kept
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
