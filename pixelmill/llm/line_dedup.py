"""Line deduplication over overlapping three-line windows, in DataFrame functions only.

Every run of three consecutive lines is hashed (128 bits). A window that occurs more than once in the whole table keeps
its first occurrence, by (doc_id, a hash of the text, position); the lines of every later occurrence go. Occurrences in one document that
overlap the first one there belong to the same run and are not later ones. The covered positions of a document are
merged before its lines are rebuilt, so overlapping windows remove each line once.

Passages on one or two lines, or whose neighbours differ, are in no repeated window and stay.

Defined cases: null and empty texts, and texts of fewer than three lines, have no windows and stay as they are; a null
doc_id counts as the smallest; rows that share a doc_id, null ones too, are documents of their own, told apart by their
texts; rows of one doc_id and one text are one document that was given twice: they do not repeat each other, and lose the
same positions; an empty table gives no rows; columns named as an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import shared

WIDTH = 3


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _row(key: str, text: str) -> Column:
    """What tells a row from others, and their order: its key and a hash of its text."""
    return F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("hash"))


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, pos, h1, h2): one row for each window of ``WIDTH`` lines; ``doc``: key and hash of the text."""
    at = [F.get("lines", F.col("pos") + i) for i in range(WIDTH)]
    return (
        docs.select(_row(key, text).alias("doc"), _lines(text).alias("lines"))
        .where(F.size("lines") >= WIDTH)
        .select("doc", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - WIDTH)).alias("pos"))
        .select("doc", "pos", F.xxhash64(*at).alias("h1"), F.xxhash64(F.lit(WIDTH), *at[::-1]).alias("h2"))
    )


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, starts): where later occurrences of windows begin. A document's starts are no more than its lines."""
    found = windows(docs, key, text)
    firsts = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "pos")).alias("first")).where("n > 1")
    # Written, so that both sides of the join come from exchanges of their own and a hot window's partition can be split.
    firsts, _ = shared.cut(firsts.select("h1", "h2", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos")), "firsts")
    same_run = (F.col("doc") == F.col("first_doc")) & (F.col("pos") < F.col("first_pos") + WIDTH)
    later = found.join(shared.small(firsts), ["h1", "h2"]).where(~same_run)
    return later.groupBy("doc").agg(F.collect_set("pos").alias("starts"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``n_lines`` and ``n_removed`` (long; null text: 0)."""
    docs = docs.drop("n_lines", "n_removed")
    cols = docs.columns
    starts, _ = shared.cut(repeated(docs, key, text).toDF("__pm_doc", "__pm_starts").withColumn("__pm_bytes", F.size("__pm_starts") * 4 + 64), "starts")
    starts = shared.small(starts, weight="__pm_bytes")  # texts are shuffled only where the starts are too many to broadcast
    covered = F.flatten(F.transform("__pm_starts", lambda p: F.sequence(p, p + WIDTH - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__pm_lines") - 1), covered)
    return (
        docs.join(starts, _row(key, text) == F.col("__pm_doc"), "left")
        .withColumn("__pm_lines", _lines(text))
        .withColumn("__pm_kept", F.when(F.col("__pm_starts").isNotNull(), kept))
        .select(
            *[c for c in cols if c != text],
            F.when(F.col("__pm_kept").isNull(), F.col(text)).otherwise(F.array_join(F.transform("__pm_kept", lambda i: F.get("__pm_lines", i)), "\n")).alias(text),
            F.coalesce(F.size("__pm_lines").cast("long"), F.lit(0)).alias("n_lines"),
            F.when(F.col("__pm_kept").isNull(), F.lit(0)).otherwise(F.size("__pm_lines") - F.size("__pm_kept")).cast("long").alias("n_removed"),
        )
        .withColumn("n_lines", F.when(F.col("n_lines") < 0, F.lit(0)).otherwise(F.col("n_lines")))
        .select(*cols, "n_lines", "n_removed")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op3: what the documents keep."""
    out = dedup(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, p - 1 AS pos, l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2] AS w
  FROM (SELECT doc_id, l, unnest(generate_series(1, len(l) - 2)) AS p FROM lines WHERE len(l) >= 3)
), firsts AS (
  SELECT w, count(*) AS n, min((doc_id, pos)) AS f FROM windows GROUP BY w HAVING count(*) > 1
), later AS (
  SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS line
  FROM (SELECT windows.doc_id, pos FROM windows JOIN firsts USING (w)
        WHERE NOT (doc_id = f[1] AND pos < f[2] + 3))
), kept AS (
  SELECT a.doc_id, string_agg(a.t, chr(10) ORDER BY a.line) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(l) AS t, unnest(generate_series(0, len(l) - 1)) AS line FROM lines) a
  ANTI JOIN later b ON a.doc_id = b.doc_id AND a.line = b.line
  GROUP BY a.doc_id
)
SELECT d.doc_id, coalesce(len(l.l), 0) AS n_lines, coalesce(len(l.l), 0) - coalesce(k.n, 0) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN lines l ON d.doc_id = l.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
