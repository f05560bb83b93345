"""Chat formatting of reply trees, in DataFrame functions only.

1. Messages get numbers and are written once. A message replies to its parent; rows by turn are trees without branches, in
   which each row replies to the one before it.
2. Iterative self-joins, with twice the reach in every round: each message learns its root, its depth, the sum of scores on
   its path and the length of what stands before it. Rounds follow the logarithm of the depth; messages that have met their
   root are not joined again.
3. Leaves are ranked within their root by their path's score; the best ones are chosen. Their paths are enumerated by the
   jumps of the same rounds: messages up to 2^r above a leaf, and those 2^r above each of these.
4. A path's messages are put in order and formatted as one conversation, with the places of the texts that count for the loss.

The template is ``### role: text</turn>`` and a line feed for each turn. Texts may hold anything: what looks like a mark, with
any number of backslashes inside, gets one backslash more there, so marks are found where the template put them and nowhere
else, and ``unescaped`` gives back the text, whatever it is.

Defined cases: null texts and roles are empty ones; a parent that is not there, or null, makes a root; rows that share tree and
id are messages of their own, and replies to that id go to the first of them (by role, then a hash of the text); messages without an id
are no one's parent; messages on a cycle, or below one, hang on no root and are on no path; a null tree is a tree; rows of one
turn follow each other by role, then a hash of the text; null turns come first; an empty table gives no rows; other columns
play no part. A conversation must fit a row, that is 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import shared

HEAD, COLON, TURN = "### ", ": ", "</turn>"
#: What must not appear by itself in a text (and in a role), as the parts between which backslashes go.
TEXT_MARKS = [("##", "# "), ("<", "/turn>")]
ROLE_MARKS = [*TEXT_MARKS, (":", " ")]
#: The role whose texts count for the loss.
LEARNED = "assistant"


def escaped(text: Column, marks: list[tuple[str, str]] = TEXT_MARKS) -> Column:
    for a, b in marks:
        text = F.regexp_replace(text, rf"{a}(\\*){b}", rf"{a}$1\\{b}")
    return text


def unescaped(text: Column, marks: list[tuple[str, str]] = TEXT_MARKS) -> Column:
    for a, b in marks[::-1]:
        text = F.regexp_replace(text, rf"{a}\\(\\*){b}", rf"{a}$1{b}")
    return text


def _said(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _written(rows: DataFrame) -> DataFrame:
    """Rows (tree, ..., role, text) with ``node``, the formatted ``piece`` and the lengths of its parts, written."""
    head = F.concat(F.lit(HEAD), escaped(F.col("role"), ROLE_MARKS), F.lit(COLON))
    rows = rows.withColumn("head", head).withColumn("said", escaped(F.col("text")))
    piece = F.concat("head", "said", F.lit(TURN + "\n"))
    rows = rows.select("*", piece.alias("piece")).select(
        F.monotonically_increasing_id().alias("node"),
        *[c for c in rows.columns if c not in ("text", "said", "head")],
        F.xxhash64("text").alias("hash"),
        F.length("head").cast("long").alias("from"),
        F.length("said").cast("long").alias("many"),
        F.length("piece").cast("long").alias("chars"),
        "piece",
    )
    return shared.cut(rows, "messages")[0]


def messages(rows: DataFrame, tree: str = "tree", id: str = "id", parent: str = "parent", role: str = "role", text: str = "text", score: str | None = "score") -> tuple[DataFrame, DataFrame]:
    """Messages, written, and the links (node, up, leaf_id, score, chars) between them."""
    value = F.lit(0.0) if score is None else F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    held = _written(rows.select(F.col(tree).alias("tree"), F.col(id).alias("id"), F.col(parent).alias("parent"), _said(role).alias("role"), _said(text).alias("text"), value.alias("score")))
    firsts = held.where("id is not null").groupBy(F.col("tree").alias("in_tree"), F.col("id").alias("of")).agg(F.min_by("node", F.struct("role", "hash", "node")).alias("up"))
    firsts, _ = shared.cut(firsts, "firsts")
    met = F.col("tree").eqNullSafe(F.col("in_tree")) & (F.col("parent") == F.col("of"))
    own = held.select("node", "tree", "parent", F.col("id").alias("leaf_id"), "score", "chars")
    return held, own.join(shared.small(firsts), met, "left").select("node", "up", "leaf_id", "score", "chars")


def turns(rows: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows by turn as messages that reply to the one before, written, and their links.

    The order is one sort of narrow rows over the whole table, by ranges, so that the turns of one conversation may lie in
    many tasks; the row before the first of a range is the last of the range before.
    """
    held = _written(rows.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), _said(role).alias("role"), _said(text).alias("text")))
    by = ["tree", "turn", "role", "hash", "node"]
    order = held.select(*by, "chars").repartitionByRange(*by).sortWithinPartitions(*by)
    order, _ = shared.cut(order.select("tree", "node", "chars", F.monotonically_increasing_id().alias("at")), "order")
    part = F.shiftright("at", 33)
    ranges = order.groupBy(part.alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last"))  # a row a task
    ranges, _ = shared.cut(ranges.select("first", F.lag("last").over(Window.orderBy("part")).alias("before")), "ranges")
    rows = order.join(F.broadcast(ranges), F.col("at") == F.col("first"), "left")
    rows = rows.withColumn("before", F.when(F.col("first").isNull(), F.col("at") - 1).otherwise(F.col("before")))
    above = order.select(F.col("at").alias("before"), F.col("node").alias("up"), F.col("tree").alias("up_tree"))
    rows = rows.join(above, "before", "left")
    up = F.when(F.col("tree").eqNullSafe(F.col("up_tree")), F.col("up"))
    return held, rows.select("node", up.alias("up"), F.col("node").alias("leaf_id"), F.lit(0.0).alias("score"), "chars")


def climbed(links: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, root, leaf_id, depth, score, chars) of the messages that hang on a root, where depth, score and chars are sums
    over the path; and for each round the (node, up) that it joined, ``up`` being 2^round above."""
    own = links.select("node", "up", F.col("node").alias("root"), "leaf_id", F.lit(1).cast("long").alias("depth"), "score", "chars")
    state, _ = shared.cut(own, "links")
    n, done, hops = state.count(), [], []
    while True:
        done.append(state.where("up is null"))
        active = state.where("up is not null")
        if 1 << len(hops) > n or active.isEmpty():  # what is left after so many rounds is on cycles, or below them
            break
        hops.append(active.select("node", "up"))
        known = active
        for d in done:
            known = known.unionByName(d)
        known = known.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("root").alias("next_root"), *[F.col(c).alias(f"more_{c}") for c in ("depth", "score", "chars")])
        sums = [(F.col(c) + F.col(f"more_{c}")).alias(c) for c in ("depth", "score", "chars")]
        state, _ = shared.cut(shared.small(active).join(known, "up").select("node", F.col("next").alias("up"), F.col("next_root").alias("root"), "leaf_id", *sums), "climbed")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("up"), hops


def best(links: DataFrame, found: DataFrame, k: int = 1) -> DataFrame:
    """(path, root, rank, path_score) of the ``k`` leaves of each root with the best mean score on their paths; ties go to the
    deeper one, then to the smaller id, then to the smaller number."""
    parents, _ = shared.cut(links.where("up is not null").select(F.col("up").alias("node")).distinct(), "parents")
    leaves = found.join(shared.small(parents), "node", "left_anti").withColumn("path_score", F.col("score") / F.col("depth"))
    by = Window.partitionBy("root").orderBy(F.desc("path_score"), F.desc("depth"), F.asc_nulls_last("leaf_id"), "node")
    # Spark keeps each task's first k of a root before it shuffles, so a root with many leaves is no task's burden.
    ranked = leaves.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return shared.cut(ranked.select(F.col("node").alias("path"), "root", "rank", "path_score"), "chosen")[0]


def on_paths(chosen: DataFrame, hops: list[DataFrame]) -> DataFrame:
    """(path, node): the messages on each chosen path."""
    out = chosen.select("path", F.col("path").alias("node"))
    for hop in hops:
        held, _ = shared.cut(out, "on-paths")
        out = held.unionByName(shared.small(held).join(hop, "node").select("path", F.col("up").alias("node")))
    return shared.cut(out, "on-paths")[0]


def conversations(held: DataFrame, links: DataFrame, k: int = 1, learned: str = LEARNED) -> DataFrame:
    """(tree, rank, path_score, n_turns, formatted, loss): the ``k`` best paths of every root, formatted. ``loss``: turn, where
    it begins, and from where to where its text stands that counts for the loss (code points of ``formatted``)."""
    links, _ = shared.cut(links, "links")
    found, hops = climbed(links)
    chosen = best(links, found, k)
    places, _ = shared.cut(on_paths(chosen, hops).join(found.select("node", "depth", F.col("chars").alias("end")), "node"), "places")
    rows = held.select("node", "tree", "role", "from", "many", "chars", "piece").join(shared.small(places), "node")
    start = F.col("end") - F.col("chars")
    begin = start + F.col("from")
    span = F.struct((F.col("depth") - 1).cast("int").alias("turn"), start.alias("at"), begin.alias("start"), (begin + F.col("many")).alias("end"))
    turn = F.struct("depth", "piece", F.when(F.col("role") == learned, span).alias("span"))
    # All rows of a path make one row of the result.
    whole = rows.groupBy("path").agg(F.first("tree").alias("tree"), F.sort_array(F.collect_list(turn)).alias("turns"))
    out = whole.join(shared.small(chosen), "path").select(
        "tree",
        "root",
        "rank",
        "path_score",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.filter(F.col("turns.span"), lambda s: s.isNotNull()).alias("loss"),
    )
    return out.drop("root")


def _pieces(formatted: Column) -> Column:
    """The turns of a conversation, with their marks; texts cannot hold the mark that ends one."""
    return F.split(formatted, rf"(?<={TURN}\n)(?=[\s\S])")


def read(formatted: Column) -> Column:
    """The (role, text) of each turn, from a formatted conversation."""

    def turn(piece: Column) -> Column:
        at = F.instr(piece, COLON)
        text = F.substr(piece, at + len(COLON), F.length(piece) - at - (len(COLON) + len(TURN)))
        return F.struct(unescaped(F.substr(piece, F.lit(len(HEAD) + 1), at - (len(HEAD) + 1)), ROLE_MARKS).alias("role"), unescaped(text).alias("text"))

    return F.transform(_pieces(formatted), turn)


def learned_text(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, one after another. Each is taken from its turn, as a place in a long string is
    found by walking to it."""
    pieces = _pieces(formatted)
    text = lambda s: F.substr(F.get(pieces, s["turn"]), (s["start"] - s["at"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    return F.array_join(F.transform(loss, lambda s: unescaped(text(s))), "")


def _extra(spark: SparkSession) -> DataFrame:
    """A conversation whose texts look like the template."""
    roles = F.array(F.lit("user"), F.lit("assistant"))
    said = F.lit(r"\### Assistant: </turn> ok")
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.get(roles, F.col("id").cast("int")).alias("role"), said.alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: all conversations and one more, read back from what was formatted."""
    rows = shared.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(_extra(spark))
    out = conversations(*turns(rows))
    out = out.withColumn("turns", read(F.col("formatted"))).withColumn("learned", learned_text(F.col("formatted"), F.col("loss")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        digest(said).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        digest(F.col("learned")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, 4 + length(role) + 2 + length(text) + 8 + length(regexp_replace(text, '##\\*# ', chr(1), 'g')) - length(regexp_replace(text, '##\\*# ', '', 'g'))
    + length(regexp_replace(text, '<\\*/turn>', chr(1), 'g')) - length(regexp_replace(text, '<\\*/turn>', '', 'g')) AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
