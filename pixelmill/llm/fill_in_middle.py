"""Fill-in-middle: texts are cut into units, and a drawn middle is moved to the end behind marks, reversibly.

A unit grammar is given by the classes of neighbouring characters between which a unit ends. It becomes a regular expression
of zero width, a lookbehind and a lookahead for each pair, and Spark's ``split`` at it keeps every character: its pieces are
the units. The two cuts are drawn from a hash of the row's key, so a row is cut the same wherever and how often it runs.

Texts of up to ``SLICE`` code points are split once. Longer ones are split a slice at a time, so that a task never holds the
units of a whole one; where a unit goes on over the end of a slice, its first piece in the next slice is not counted again.

Defined cases: a null text is an empty one and has no units (``split`` would give one); an empty text, one that holds a mark
and one that is not drawn are plain and come back unchanged; a null key counts as empty decimal text; rows that share a key
get the same draws; an empty table gives no rows; extra columns are carried, and those named as an output column replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import shared

ANY = r"[\s\S]"
#: Grammars: a unit ends between a character of the first class and one of the second.
GRAMMARS = {
    "letters": [("[^A-Za-z]", ANY), ("[A-Za-z]", "[^A-Za-z]")],  # runs of letters, other characters alone
    "characters": [(ANY, ANY)],
    "words": [(r"\s", r"\S")],  # a word with the white space behind it
    "lines": [("\n", ANY)],
}
#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Per cent of texts that are drawn, and of those per cent with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Code points that are split at a time.
SLICE = 1 << 16
OUT = ["n", "form", "prefix_chars", "middle_chars", "output"]


def boundary(grammar: list[tuple[str, str]]) -> str:
    """The regular expression of zero width that matches where a unit ends and another begins."""
    return "|".join(f"(?<={left})(?={right})" for left, right in grammar)


def checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """The marks, if no text without them can make one of them appear at its edge."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or any(a.startswith(b[k:]) for k in range(i == j, len(b))) or (i != j and b in a):
                raise ValueError(f"marks must neither be empty nor overlap: {a!r}, {b!r}")
    return marks


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers under 2^32 of a key: the first 8-digit groups of the hexadecimal SHA-256 of seed, colon, key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _between(text: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` (0 is the first) to before ``end``."""
    return F.substr(text, (start + 1).cast("int"), (end - start).cast("int"))


def _counted(rows: DataFrame, regex: str) -> DataFrame:
    """With ``pieces`` (of a text of one slice, else null), ``goes_on`` (of each slice, whether its first piece belongs to the unit
    before it), ``before`` (units that begin before each slice) and ``n`` (units)."""
    rows = rows.withColumn("pieces", F.when(F.length("text") <= SLICE, F.split("text", regex)))
    slices = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / SLICE).cast("int")))
    goes_on = F.transform(slices, lambda i: ((i > 0) & ~F.substr(F.col("text"), i * SLICE, F.lit(2)).rlike(regex)).cast("int"))
    rows = rows.withColumn("goes_on", goes_on)
    begun = F.transform("goes_on", lambda on, i: F.size(F.split(F.substr(F.col("text"), i * SLICE + 1, F.lit(SLICE)), regex)) - on)
    rows = rows.withColumn("begun", F.when(F.length("text") == 0, F.array(F.lit(0))).when(F.col("pieces").isNotNull(), F.array(F.size("pieces"))).otherwise(begun))
    total = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x)
    before = F.transform("begun", lambda _, i: total(F.slice("begun", F.lit(1), i)))
    return rows.withColumns({"before": before, "n": total(F.col("begun"))}).drop("begun")


def _place(unit: Column, regex: str) -> Column:
    """The code points before the unit of that number (from 0; ``n`` is the text's end)."""
    at = F.size(F.filter("before", lambda b: b <= unit)) - 1
    pieces = F.when(F.col("pieces").isNotNull(), F.col("pieces")).otherwise(F.split(F.substr(F.col("text"), at * SLICE + 1, F.lit(SLICE)), regex))
    many = (unit - F.get("before", at) + F.get("goes_on", at)).cast("int")
    return F.when(unit >= F.col("n"), F.length("text")).otherwise(at * SLICE + F.length(F.array_join(F.slice(pieces, F.lit(1), many), "")))


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", grammar: list[tuple[str, str]] | str = "letters", seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    regex = boundary(GRAMMARS[grammar] if isinstance(grammar, str) else grammar)
    p, s, m = map(F.lit, checked(marks))
    docs = docs.drop(*OUT)
    # The row goes through as one column, so that no name of its own can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = _counted(rows, regex).withColumns({f"h{i}": h for i, h in enumerate(draws(F.col("key"), seed), 1)})
    held = F.contains("text", p) | F.contains("text", s) | F.contains("text", m)
    plain = (F.col("n") == 0) | held | (F.col("h3") % 100 >= rate)
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    rows = rows.withColumns({"form": F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm"), "a": F.least(*cuts), "b": F.greatest(*cuts)})
    drawn = F.col("form") != "plain"
    rows = rows.withColumns({"x": F.when(drawn, _place(F.col("a"), regex)), "y": F.when(drawn, _place(F.col("b"), regex))})
    x, y, whole = F.col("x"), F.col("y"), F.col("text")
    prefix, middle, suffix = _between(whole, F.lit(0), x), _between(whole, x, y), _between(whole, y, F.length(whole))
    output = F.when(~drawn, whole).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    return rows.select("row.*", "n", "form", x.cast("long").alias("prefix_chars"), (y - x).cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text, from what ``transformed`` made of it."""
    parts = F.split(output, "|".join(rf"\Q{x}\E" for x in marks))  # nothing, then the three parts
    first, second, middle = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: all documents, cut into runs of letters and single other characters."""
    out = transformed(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", *OUT[:4], digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
), h AS (
  SELECT doc_id, t, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(x, i, 8))::BIGINT) AS h FROM d
), c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
