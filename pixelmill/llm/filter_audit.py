"""What filters do to a corpus in every order: direct replay of all documents through all orders.

1. Each document is measured once: whether it fails each filter, and its labels. That is a narrow table, written; no text
   goes further.
2. Every document meets every order (120 of five filters, a broadcast table of that size whatever the corpus), its first
   failing step is computed, and its five steps are exploded. A conditional aggregate by part, order and step counts them;
   it combines in the tasks, so a shuffle gets parts x 600 rows from each, however many documents a part holds.
3. A filter's share (``shapley``) is the sum of what it removes over all orders.

Exact copies are found by the least key of each text's 128-bit hash, in an aggregate that combines in the tasks too; only
texts that come again are joined back.

Defined cases: null texts are empty ones; documents without a part (null) are in the part of the empty string; labels that
are missing or null mark nothing, and of several rows of a key any that marks it counts; a document without a key has no
labels, repeats nothing and is repeated by nothing; rows that share key and text are documents of their own and no copies of
each other; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import shared

#: The least words, the least per cent of distinct ones, the most per cent of capitals, and the characters of junk.
WORDS, DISTINCT, CAPITALS, JUNK = 200, 50, 3, "[#$%&*|]"
SPACE = " \t\n\x0b\f\r"
#: Most filters whose orders are replayed; 720 orders.
MOST = 6


def words(text: Column) -> Column:
    """A text's words, apart by the six white-space characters of ASCII."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def copies(rows: DataFrame) -> DataFrame:
    """``rows`` (key, h1, h2, ...), written, with ``copy``: whether a smaller key has the same text."""
    least = rows.where("key is not null").groupBy("h1", "h2").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").drop("most")
    # Written, so that both sides of the join come from exchanges of their own and a hot text's partition can be split.
    least, _ = shared.cut(least, "least")
    return rows.join(shared.small(least), ["h1", "h2"], "left").withColumn("copy", F.coalesce(F.col("key") > F.col("least"), F.lit(False))).drop("least")


def measured(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, A, B, C, D, E, good, toxic), booleans: which filters each document fails, and how it is labelled."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("text"), F.xxhash64(F.lit(1), whole).alias("h1"), F.xxhash64(F.lit(2), whole).alias("h2"))
    rows = rows.withColumn("words", words(F.col("text"))).withColumn("n", F.size("words"))
    capitals = F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    rows = rows.select(
        "key",
        "part",
        "h1",
        "h2",
        (F.col("n") < WORDS).alias("A"),
        (F.size(F.array_distinct("words")) * 100 < F.col("n") * DISTINCT).alias("B"),
        (capitals * 100 > F.length("text") * CAPITALS).alias("C"),
        F.col("text").rlike(JUNK).alias("D"),
    )
    rows, _ = shared.cut(rows, "measured")
    marked = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(marked("quality"), marked("toxic")).where("quality or toxic")
    known, _ = shared.cut(known, "labels")
    out = copies(rows).join(shared.small(known), "key", "left")
    said = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    return out.select("part", "A", "B", "C", "D", F.col("copy").alias("E"), said("quality", "good"), said("toxic", "toxic"))


def orders(spark, filters: list[str]) -> DataFrame:
    """(filter_order, turns): every order of the filters, and their numbers in it."""
    if not 0 < len(filters) <= MOST or any(len(f) != 1 for f in filters) or len(set(filters)) < len(filters):
        raise ValueError(f"filters are one to {MOST} different letters")
    every = [F.struct(F.lit("".join(filters[i] for i in p)).alias("filter_order"), F.array(*map(F.lit, p)).alias("turns")) for p in permutations(range(len(filters)))]
    return spark.range(1).select(F.explode(F.array(*every)).alias("o")).select("o.*")


def replayed(flags: DataFrame, filters: list[str], part: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """By (part, filter_order, step): kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley of documents with
    a boolean column for each filter, true where it fails them, and the booleans ``good`` and ``toxic``."""
    every, fails = F.broadcast(orders(flags.sparkSession, filters)), F.array(*[F.col(f) for f in filters])
    docs = flags.select(F.col(part).alias("part"), F.col(good).alias("good"), F.col(toxic).alias("toxic"), fails.alias("fails"))
    docs = docs.withColumn("n_fails", sum((F.get("fails", F.lit(i)).cast("int") for i in range(1, len(filters))), F.get("fails", F.lit(0)).cast("int")))
    # The one cross join: every document with a number of orders that the filters alone decide.
    every = docs.crossJoin(every)
    failed = lambda step: F.get("fails", F.get("turns", F.lit(step)))
    first = F.coalesce(*[F.when(failed(i), i + 1) for i in range(len(filters))], F.lit(len(filters) + 1))
    steps = every.withColumn("first", first).select("*", F.explode(F.array(*[F.lit(i + 1) for i in range(len(filters))])).alias("step"))
    own, here = F.get("fails", F.get("turns", F.col("step") - 1)), F.col("first") == F.col("step")
    counted = steps.groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if(own & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(own & (F.col("n_fails") == 1)).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    filter_ = F.substr("filter_order", F.col("step"), F.lit(1))
    return counted.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", filter_)))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the five filters on all documents, by language."""
    flags = measured(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))
    return replayed(flags, list("ABCDE"))


ORACLE = r"""
WITH l(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), m AS (
  SELECT t.doc_id, part, coalesce(q.quality = 1, false) AS good, coalesce(q.toxic = 1, false) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM t LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) q ON t.doc_id = q.doc_id
), r AS (
  SELECT part, good, toxic, fails, filter_order,
    list_min(list_transform(string_split(fails || 'X', ''), lambda x: CASE WHEN x = 'X' THEN 6 ELSE strpos(filter_order, x) END)) AS first FROM m, o
), s AS (
  SELECT part, filter_order, step, filter_order[step] AS f,
    count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
    count(*) FILTER (contains(fails, filter_order[step]) AND first < step) AS redundant, count(*) FILTER (fails = filter_order[step]) AS unique_fails,
    count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM r, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM s
"""
