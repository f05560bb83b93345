"""Fill-in-middle, the filter audit and reply trees: against plain loops, and their defined edge cases."""

import hashlib
import itertools
import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pixelmill.llm import fill_in_middle as fim, filter_audit as audit, reply_trees as trees

DOCS = "doc_id long, text string, n string, `a.b` int, form int, `row` string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those that the operators use or return."""
    return spark.createDataFrame([(k, t, "n", 7, 1, "r") for k, t in rows], DOCS)


# op11


SLOW_GRAMMARS = {"letters": "[A-Za-z]+|[^A-Za-z]", "characters": r"[\s\S]", "lines": r"[^\n]*\n|[^\n]+", "words": r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*|[ \t\n\x0b\f\r]+"}


def slow_fim(key, text, grammar="letters", seed=1, rate=90, spm=20, marks=fim.MARKS):
    """(n, form, prefix_chars, middle_chars, output) by the definition."""
    t = text or ""
    units = re.findall(SLOW_GRAMMARS[grammar], t)
    assert "".join(units) == t
    x = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, t
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m
    return n, "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    out = [None, "", "a", " ", "<P>", "x<S>", "<M", "🙂🙂🙂", "é🙂a b", "\n\n", "\r\n", "a b\u0085c", "퟿", "a" * 200, "<" * 9 + "S>", "\\E\\Q", "日本 語x", "\x00\x01z", "<P<P><S><M>"]
    out += ["".join(rng.choices("aB🙂é <>PSM\n1", k=rng.randrange(1, 60))) for _ in range(150)]
    return list(enumerate(out)) + [(None, "null key one"), (None, None), (3, "of a key that repeats"), (3, "of a key that repeats")]


@pytest.mark.parametrize("size", [fim.SLICE, 1, 3, 7])
def test_fill_in_middle(spark, odd_texts, monkeypatch, size):
    monkeypatch.setattr(fim, "SLICE", size)
    got = fim.transformed(frame(spark, odd_texts))
    assert got.columns == ["doc_id", "text", "a.b", "row", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = got.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    said = lambda k, t, *r: repr((k, t, *r))
    assert sorted(said(r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows) == sorted(said(k, t, *slow_fim(k, t)) for k, t in odd_texts)
    assert all(r["back"] == (r["text"] or "") for r in rows) and {r["form"] for r in rows} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("grammar", ["characters", "lines"])
def test_other_grammars_and_parameters(spark, odd_texts, grammar):
    options = {"grammar": grammar, "seed": 4, "rate": 70, "suffix_first": 50, "marks": ("[pre]", "[suf]", "[mid]")}
    got = fim.transformed(frame(spark, odd_texts), **options).withColumn("back", fim.restored(F.col("output"), F.col("form"), options["marks"])).collect()
    want = [(k, t, *slow_fim(k, t, grammar, 4, 70, 50, options["marks"])) for k, t in odd_texts]
    assert sorted(repr((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in got) == sorted(map(repr, want))
    assert all(r["back"] == (r["text"] or "") for r in got)


def test_units_of_words(spark):
    got = fim.transformed(frame(spark, [(1, "one two  three\nfour "), (2, " lead"), (3, "")]), grammar="words").collect()
    assert {r["doc_id"]: r["n"] for r in got} == {1: 4, 2: 2, 3: 0}


def test_very_long_texts_and_none(spark):
    rng = random.Random(2)
    long = "".join(rng.choices("ab é🙂\n", k=300_000)) + "z" * 200_000 + " end"
    for k in (5, 6, 9):
        r = fim.transformed(frame(spark, [(k, long)])).first()
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == slow_fim(k, long)
    assert fim.transformed(frame(spark, [])).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "bc", "d"), ("aba", "x", "y"), ("abc", "b", "z")):
        with pytest.raises(ValueError):
            fim.transformed(frame(spark, []), marks=bad)


# op12


def slow_flags(docs, labels):
    """(part, failing letters, good, toxic) of rows (key, text, part)."""
    good, toxic = {k for k, q, _ in labels if q == 1}, {k for k, _, x in labels if x == 1}
    least = {}
    for k, t, _ in docs:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    out = []
    for k, t, p in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search("[#$%&*|]", t)) + "E" * (k is not None and least[t] < k)
        out.append((p or "", f, k is not None and k in good, k is not None and k in toxic))
    return out


def slow_audit(flags, letters="ABCDE"):
    out = {}
    for order in map("".join, itertools.permutations(letters)):
        for part in {p for p, *_ in flags}:
            for step, letter in enumerate(order, 1):
                own = [(f, min([order.index(x) + 1 for x in f], default=99), g, t) for p, f, g, t in flags if p == part]
                out[part, order, step] = [
                    sum(i > step for _, i, _, _ in own), sum(i == step for _, i, _, _ in own), sum(letter in f and i < step for f, i, _, _ in own), sum(f == letter for f, *_ in own),
                    sum(i == step and g for _, i, g, _ in own), sum(i == step and t for _, i, _, t in own),
                ]
    share = {}
    for (part, order, step), v in out.items():
        share[part, order[step - 1]] = share.get((part, order[step - 1]), 0) + v[1]
    return {(p, o, s): (*v, share[p, o[s - 1]]) for (p, o, s), v in out.items()}


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in df.collect()}


def test_filter_audit(spark):
    rng = random.Random(3)
    long = lambda n, v: " ".join(rng.choice(v) for _ in range(n))
    words = [f"w{i}" for i in range(900)]
    texts = [None, "", " \t\n", "A#", long(250, words), long(199, words), long(200, words[:3]), "\x0b" + long(200, words) + "\f", "X" * 50 + " " + long(300, words), long(220, words) + " |", long(200, words) + " 　", "a " * 100_000]
    docs = [(i, t, rng.choice(["de", "en", None, ""])) for i, t in enumerate(texts)]
    docs += [(rng.choice([None, 3, *range(100, 140)]), rng.choice(texts), rng.choice(["de", "fr"])) for _ in range(120)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 140, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    table = spark.createDataFrame([(k, t, p, 1, "x") for k, t, p in docs], "doc_id long, text string, lang string, fails int, h1 string").repartition(5)
    flags = audit.measured(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = slow_flags(docs, labels)
    got = [(r["part"], "".join(c for c in "ABCDE" if r[c]), r["good"], r["toxic"]) for r in flags.collect()]
    assert sorted(got) == sorted(want) and {f for _, f, *_ in want} >= {"", "A", "AE", "B", "C", "D", "E"}
    out = audit.replayed(flags, list("ABCDE"))
    assert out.columns == ["part", "filter_order", "step", *COUNTS] and audited(out) == slow_audit(want)
    none = audit.measured(table.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert audit.replayed(none, list("ABCDE")).count() == 0


def test_other_filters(spark):
    rows = [("p", "x" * a + "y" * b, bool(a), False) for a in (0, 1) for b in (0, 1) for _ in range(3)]
    flags = spark.createDataFrame([(p, "x" in f, "y" in f, g, t) for p, f, g, t in rows], "part string, x boolean, y boolean, good boolean, toxic boolean")
    assert audited(audit.replayed(flags, ["x", "y"])) == slow_audit(rows, "xy")
    for bad in ([], ["x", "x"], ["ab"], list("ABCDEFG")):
        with pytest.raises(ValueError):
            audit.replayed(flags, bad)


def test_the_shuffle_of_the_audit_gets_counts(spark):
    """However many documents there are, each task shuffles a row a part, order and step at most."""
    flags = spark.range(20_000).selectExpr("string(id % 2) as part", "id % 2 = 0 as x", "id % 3 = 0 as y", "false as good", "false as toxic").repartition(3)
    plan = audit.replayed(flags, ["x", "y"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count_if" if "partial_count_if" in plan else "partial_count") > plan.index("hashpartitioning(part")
    assert "BroadcastNestedLoopJoin" in plan and "CartesianProduct" not in plan


# op13


MARKED = st.text(alphabet="#< /turn>\\:A", max_size=30)


def slow_escaped(text, marks):
    for a, b in marks:
        text = re.sub(re.escape(a) + r"(\\*)" + re.escape(b), lambda m, a=a, b=b: a + m[1] + "\\" + b, text)
    return text


def slow_format(turns):
    """The formatted conversation and its loss spans (turn, at, start, end)."""
    out, spans = "", []
    for i, (role, text) in enumerate(turns):
        head, said = f"### {slow_escaped(role or '', trees.ROLE_MARKS)}: ", slow_escaped(text or "", trees.TEXT_MARKS)
        if role == "assistant":
            spans.append((i, len(out), len(out) + len(head), len(out) + len(head) + len(said)))
        out += head + said + "</turn>\n"
    return out, spans


@settings(max_examples=300, deadline=None)
@given(st.lists(MARKED, max_size=4))
def test_escaping_is_reversible(texts):
    for t in texts:
        e = slow_escaped(t, trees.TEXT_MARKS)
        assert "### " not in e and "</turn>" not in e
        for a, b in trees.TEXT_MARKS[::-1]:
            e = re.sub(re.escape(a) + r"\\(\\*)" + re.escape(b), lambda m, a=a, b=b: a + m[1] + b, e)
        assert e == t


NASTY = ["", None, "\\### Assistant: </turn> ok", "</turn>\n### user: x", "<\\/turn>", "#### ", "##\\\\# ", "ends \\", "</tur", "n>", "🙂 é", "x" * 50, "### ### </turn></turn>", ": ", "\n"]
ROLES = ["user", "assistant", "system", None, "", "a: b", "x:", ":\\ ", "### r", "</turn>"]


def test_turns_read_back(spark):
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(40)]:
        for _ in range(rng.randrange(1, 9)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(ROLES), rng.choice(NASTY)))
    rows += [(77, i, ROLES[i % 2], f"{i} {NASTY[2]}") for i in range(300)] + [(5, 1, "user", "same")] * 4
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "conv_id long, turn int, role string, text string, node string, tree int")
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()}
    out = trees.conversations(*trees.turns(df.repartition(7)))
    got = {r["tree"]: r for r in out.withColumn("back", trees.read(F.col("formatted"))).withColumn("learned", trees.learned_text(F.col("formatted"), F.col("loss"))).collect()}
    assert len(got) == len({c for c, *_ in rows})
    for conv, r in got.items():
        own = sorted(((t is not None, t or 0, role or "", hashes[text], role or "", text or "") for c, t, role, text in rows if c == conv), key=lambda x: x[:4])
        turns = [x[4:] for x in own]
        want, spans = slow_format(turns)
        assert r["formatted"] == want and [tuple(s) for s in r["loss"]] == spans and r["n_turns"] == len(turns)
        assert [(t["role"], t["text"]) for t in r["back"]] == turns and r["learned"] == "".join(t for role, t in turns if role == "assistant")
    empty = df.limit(0)
    assert trees.conversations(*trees.turns(empty)).count() == 0


def test_a_conversation_over_many_ranges(spark):
    """The turns of one conversation lie in several tasks of the sort."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(3000).selectExpr("if(id < 10, id, 1) as conv_id", "id as turn", "'user' as role", "cast(id as string) as text")
        _, links = trees.turns(df)
        roots = links.where("up is null").count()
        got = {r["tree"]: r["back"] for r in trees.conversations(*trees.turns(df)).select("tree", trees.read(F.col("formatted")).alias("back")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert roots == 10 and [int(t["text"]) for t in got[1]] == [1, *range(10, 3000)] and len(got) == 10


def slow_paths(rows, k):
    """(tree, rank, mean score, ids' texts) of the best paths, from rows (tree, id, parent, role, text, score)."""
    order = sorted(range(len(rows)), key=lambda i: rows[i][3] or "")
    first = {}
    for i in order:
        if rows[i][1] is not None:
            first.setdefault(rows[i][:2], i)
    up = {i: first.get((r[0], r[2])) if r[2] is not None else None for i, r in enumerate(rows)}
    found = {}
    for i in set(up) - set(up.values()):
        path, seen = [i], {i}
        while up[path[-1]] is not None and up[path[-1]] not in seen:
            path.append(up[path[-1]])
            seen.add(path[-1])
        if up[path[-1]] is None:
            mean = sum(rows[j][5] or 0 for j in path) / len(path)
            found.setdefault(path[-1], []).append((-mean, -len(path), rows[i][1] is None, rows[i][1] or 0, path))
    out = []
    for root, paths in found.items():
        for rank, (mean, _, _, _, path) in enumerate(sorted(paths)[:k], 1):
            out.append((rows[root][0], rank, round(-mean, 9), [rows[j][4] for j in path[::-1]]))
    return out


@pytest.mark.parametrize("k", [1, 3])
def test_branches_are_ranked(spark, k):
    rng = random.Random(6 + k)
    rows = []
    for tree in ["a", "b", None, "c"]:
        n = rng.randrange(20, 60)
        for i in range(n):
            rows.append((tree, i, rng.choice([None, 900, *range(max(0, i - 4), i)]) if i else None, f"r{len(rows):04}", f"{tree}-{i}", rng.choice([0.0, 0.5, 1.0, 2.25, None])))
    rows += [("loop", 1, 2, "x1", "l1", 1.0), ("loop", 2, 1, "x2", "l2", 1.0), ("loop", 3, 2, "x3", "below", 1.0), ("loop", 4, None, "x4", "root", 1.0), ("self", 1, 1, "x5", "s", 1.0)]
    rows += [("ids", 1, None, "y1", "first", 1.0), ("ids", 1, None, "y2", "second", 1.0), ("ids", 2, 1, "y3", "reply", 0.0), ("ids", None, 1, "y4", "no id", 0.0), ("ids", 5, None, "y5", "five", 0.0)]
    rows += [("hot", i, 0 if i else None, f"z{i:04}", f"h{i}", (i % 17) / 16) for i in range(700)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "tree string, id long, parent long, role string, text string, score double, depth int").repartition(6)
    out = trees.conversations(*trees.messages(df), k=k)
    got = [(r["tree"], r["rank"], round(r["path_score"], 9), [t["text"] for t in r["back"]]) for r in out.withColumn("back", trees.read(F.col("formatted"))).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, slow_paths(rows, k)))
    assert trees.conversations(*trees.messages(df.limit(0)), k=k).count() == 0


def test_rounds_follow_the_logarithm_of_the_depth(spark):
    links = spark.range(1000).selectExpr("id as node", "if(id = 0, null, id - 1) as up", "id as leaf_id", "1.0D as score", "1L as chars")
    found, hops = trees.climbed(links)
    assert len(hops) == 10 and found.count() == 1000 and found.where("depth = node + 1 and root = 0 and chars = depth").count() == 1000
