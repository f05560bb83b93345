"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are hashed, k-grams of words are hashed, and of every ``WINDOW - K + 1`` consecutive k-grams the least hash (the
rightmost of ties) is kept with its place. Any ``WINDOW`` words that a document shares with an item hold the same least
k-gram on both sides, so every shared span of that length meets in the join of the fingerprints; a meeting is extended
word by word to both sides, and counts where ``WINDOW`` words or more agree. Items of fewer words than ``WINDOW`` are one
window each; the words that begin one are looked for first, in one pass, and where one stands, the hash of as many words
as an item of that beginning has is looked up.

Defined cases: null, empty and wordless texts have no words and are clean; items without words occur nowhere; repeated
items count by their item_id; rows that share a doc_id, null ones too, are told apart by their texts and reported each with
its own hits; null ids are kept (a null item_id is not listed); empty tables give clean documents or none; columns named
as an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import shared

WINDOW, K = 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in texts that still have upper-case letters.
CASED_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The lower case of the first depends on what stands beside the word; the second is one of its two.
SIGMA = "\u03a3", "\u03c3"


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def count_words(text: Column) -> Column:
    """How many words a text has: the parts that separators leave, but for an empty first and an empty last one."""
    parts = F.split(F.coalesce(text, F.lit("")), CASED_GAP)
    empty = lambda at: (F.element_at(parts, at) == "").cast("int")
    return F.greatest(F.size(parts) - empty(1) - empty(-1), F.lit(0)).cast("long")


def _hash(array: str, at: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(array, at + i) for i in range(n)])


def _grams(array: str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(array) - K), lambda i: _hash(array, i, K))


def _winnowed(texts: DataFrame, *carry: str) -> DataFrame:
    """(carry, gram, pos) of texts with k-grams ``g``: the least of each window, each place once.

    A hash's low three bits give way to its place, which makes the least of a window one place. Which of equal k-grams
    that is does not matter, as items are taken with all of them (``tied``).
    """
    span, w = WINDOW - K + 1, F.col("w")
    value = lambda i: F.get("g", w + i).bitwiseAND(F.lit(-8)).bitwiseOR((w + i).bitwiseAND(F.lit(7)).cast("long"))
    return (
        texts.select(*carry, "g", F.explode(F.sequence(F.lit(0), F.size("g") - span)).alias("w"))
        .select(*carry, "w", F.least(*[value(i) for i in range(span - 1)]).alias("inside"), value(-1).alias("before"), value(span - 1).alias("after"))
        .select(*carry, "w", F.least("inside", "after").alias("least"), F.least("inside", "before").alias("previous"))
        .where((F.col("w") == 0) | (F.col("least") != F.col("previous")))
        .select(*carry, F.col("least").bitwiseAND(F.lit(-8)).alias("gram"), (w + (F.col("least").bitwiseAND(F.lit(7)).cast("int") - w).bitwiseAND(F.lit(7))).alias("pos"))
    )


def tied(texts: DataFrame, *carry: str) -> DataFrame:
    """(carry, gram, pos) of texts with k-grams ``g``: every place that holds the least of a window."""
    span = WINDOW - K + 1
    low = F.transform("g", lambda x: x.bitwiseAND(F.lit(-8)))
    each = texts.select(*carry, low.alias("g")).select(*carry, "g", F.explode(F.sequence(F.lit(0), F.size("g") - span)).alias("w"))
    each = each.select(*carry, "g", "w", F.array_min(F.slice("g", F.col("w") + 1, F.lit(span))).alias("gram"))
    places = F.filter(F.sequence(F.col("w"), F.col("w") + span - 1), lambda p: F.get("g", p) == F.col("gram"))
    return each.select(*carry, "gram", F.explode(places).alias("pos")).distinct()


def _near(found: DataFrame, key: str) -> DataFrame:
    """With the words within reach of an extension: word ``pos + i`` is ``near[lead + i]``."""
    reach = WINDOW - K
    near = F.slice("h", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.lit(WINDOW + reach))
    return found.select(key, "gram", "pos", near.alias("near"), F.least("pos", F.lit(reach)).alias("lead"))


def _lowered(text: Column) -> Column:
    return F.lower(F.replace(F.coalesce(text, F.lit("")), *map(F.lit, SIGMA)))


def suspects(docs: DataFrame, theirs: DataFrame) -> DataFrame:
    """(doc): the texts that share a winnowed k-gram with an item, words taken in Unicode's lower case.

    Words that are equal but for A-Z are equal in Unicode's lower case too, and that case is much faster to make; so this
    pass over all texts is the cheap one, and the exact one sees suspects alone.
    """
    hashed = F.transform(F.split(_lowered(F.col("text")), GAP), lambda t: F.xxhash64(t))
    grams = docs.select("doc", hashed.alias("h")).where(F.size("h") >= WINDOW).select("doc", _grams("h").alias("g"))
    return _winnowed(grams, "doc").select("doc", "gram").join(shared.small(theirs), "gram", "left_semi").select("doc").distinct()


def low_grams(items: DataFrame) -> DataFrame:
    """(gram): the winnowed k-grams of items, as ``suspects`` makes them."""
    hashed = F.transform(F.array_remove(F.split(_lowered(F.col("text")), GAP), ""), lambda t: F.xxhash64(t))
    return tied(items.select(hashed.alias("h")).where(F.size("h") >= WINDOW).select(_grams("h").alias("g"))).select("gram").distinct()


def _run(equal: list[Column]) -> Column:
    """How many of the conditions hold before the first that does not."""
    out = F.when(~equal[0], 0)
    for i, e in enumerate(equal[1:], 1):
        out = out.when(~e, i)
    return out.otherwise(len(equal))


def _row(key: str, text: str) -> Column:
    """What tells a row from others: its key and a hash of its text."""
    return F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("hash"))


def _short(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc, item, start, n): where items (item, h) of fewer words than ``WINDOW`` stand in documents (doc, h)."""
    short = items.select("item", F.size("h").cast("int").alias("n"), F.xxhash64("h").alias("gram"), F.get("h", F.lit(0)).alias("word"))
    lengths = short.groupBy("word").agg(F.collect_set("n").alias("lengths"))  # 9 a word at most
    at = docs.select("doc", "h", F.posexplode("h").alias("start", "word")).join(shared.small(lengths), "word")
    at = at.select("doc", "h", "start", F.explode("lengths").alias("n")).where(F.col("start") + F.col("n") <= F.size("h"))
    at = at.select("doc", "start", "n", F.xxhash64(F.slice("h", F.col("start") + 1, F.col("n"))).alias("gram"))
    return at.join(shared.small(short.drop("word").distinct()), ["n", "gram"]).select("doc", "item", "start", "n")


def occurrences(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(doc, item, start, n): spans of words in documents (``doc``: key and hash of the text), each covered by windows of
    the item that occur there; every occurrence of a window is in one of the item's spans."""
    hashed = lambda df, of: df.select(of, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    raw = docs.select(_row(key, text).alias("doc"), F.col(text).alias("text"))
    items = items.select(F.col(item).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    low, _ = shared.cut(low_grams(items), "low")
    near, _ = shared.cut(suspects(raw, low), "suspects")
    # Written, else conditions on the words are pushed below the join and evaluated on every text.
    suspected, _ = shared.cut(raw.join(shared.small(near), "doc", "left_semi"), "texts")
    items, _ = shared.cut(hashed(items, "item").where(F.size("h") > 0), "items")
    long = lambda df, of: df.where(F.size("h") >= WINDOW).select(of, "h", _grams("h").alias("g"))
    theirs, _ = shared.cut(_near(tied(long(items, "item"), "item", "h"), "item").toDF("item", "gram", "ipos", "inear", "ilead"), "fingerprints")
    same = lambda i: F.coalesce(F.get("near", F.col("lead") + i) == F.get("inear", F.col("ilead") + i), F.lit(False))
    ours = _near(_winnowed(long(hashed(suspected, "doc"), "doc"), "doc", "h"), "doc")
    met = ours.join(shared.small(theirs), "gram")
    seed = same(0)
    for i in range(1, K):
        seed = seed & same(i)
    back, on = _run([same(-i) for i in range(1, WINDOW - K + 1)]), _run([same(K + i) for i in range(WINDOW - K)])
    spans = met.where(seed).select("doc", "item", (F.col("pos") - back).alias("start"), (back + K + on).alias("n")).where(F.col("n") >= WINDOW)
    short = items.where(F.size("h") < WINDOW)
    if not short.isEmpty():
        spans = spans.unionByName(_short(hashed(raw, "doc"), short))
    return spans.distinct()


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated."""
    out = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    docs = docs.drop(*out)
    covered = F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("n") - 1))))
    hits = occurrences(docs, items, key, text).groupBy(F.col("doc").alias("__pm_doc")).agg(
        F.size(covered).cast("long").alias("__pm_hit"), F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("__pm_items")
    )
    hits, _ = shared.cut(hits.withColumn("__pm_bytes", F.size("__pm_items") * 32 + 64), "hits")
    none = F.lit(0).cast("long")
    return (
        docs.withColumn("n_words", count_words(F.col(text)))
        .withColumn("__pm_row", _row(key, text))  # so that a caller who drops the text has none shuffled
        .join(shared.small(hits, weight="__pm_bytes"), F.col("__pm_row") == F.col("__pm_doc"), "left")
        .withColumn("n_hit", F.coalesce("__pm_hit", none))
        .withColumn("n_items", F.when(F.col("__pm_items").isNull(), none).otherwise(F.size("__pm_items").cast("long")))
        .withColumn("items_sha256", F.sha2(F.coalesce(F.array_join("__pm_items", ","), F.lit("")).cast("binary"), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
        .select(*docs.columns, *out)
    )


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of an item."""
    hit, _ = shared.cut(occurrences(docs, items, key, text).select(F.col("doc").alias("__pm_doc")).distinct(), "hit")
    return docs.join(shared.small(hit), _row(key, text) == F.col("__pm_doc"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the documents held against the benchmark."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, shared.table(spark, sf_dir, "benchmark")).drop("text")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM iw WHERE len(w) > 0)
), found AS (
  SELECT doc_id, item_id, p, n
  FROM (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p
              FROM dw, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n))
  JOIN windows USING (n, g)
), hit AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS spot FROM found) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""
