"""Near-duplicates by SetSketch: mergeable registers of exponentially spaced, truncated minima.

1. Each text's distinct five-word shingles are hashed to 64 bits; texts of one set are one class, held once.
2. Register i of a sketch is ``floor(1 - log_B(h))``, clamped to [0, TOP + 1], where h is the least of exponential
   variates drawn from the shingles by hash function i. The register-wise maximum of two sketches is the sketch of the
   union.
3. ``ROWS`` neighbouring registers make a band; classes that agree in a band meet in a bucket. A pair of similarity 0.75
   agrees in none of the 40 bands with probability 2.5e-7.
4. A bucket's registers are compared in numpy. A pair counts in the first band in which it agrees, and only if its joint
   likelihood estimate is not far below the threshold. What such pairs connect is a family: every likely pair lies in one.
5. A family's sets are intersected exactly.
6. Components: the smallest key that is reachable over links, by large and small stars over written tables.

Buckets and families of any size are worked in two passes, in which no pair is ever a row. Pass one deals the members into
chunks of bounded size, each with the group's pivots (a few members, chosen by hash) beside it; each chunk finds its trees
of linked members, and the pivots tie the chunks together. Pass two takes the members that are still outside their group's
largest tree and holds them against all members in other trees, block by block. A pair that neither pass looks at lies in
one tree already. Rows are members plus pivots times chunks, and in pass two members times blocks of the rest and back.

A family of which more than ``REST`` members are outside falls apart, and is indexed instead: a shingle that over ``RARE`` of its
members hold is common, the others are rare. Two members share as many common shingles as the one of fewer has, at most; so
they are linked only if they share enough rare ones (they meet in the lists of those, of ``RARE`` members each at most, and
what they share there is counted), or if their common shingles alone could be enough. Only members that have a partner of
the latter kind by size and number of common shingles go block by block. Pairs that are left are intersected exactly.

Defined cases: null, empty and blank texts have no set (n_shingles 0) and are linked with nothing, not even each other;
a text of fewer than five words is one shingle; rows that share a key are one document, linked with whatever any of its
texts is linked with (``dedup`` goes by texts: see there); null keys have n_shingles but are linked with nothing
(component null, kept); empty tables give no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import shared

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Registers; those of the bands come first.
M, ROWS, BANDS = 256, 4, 40
#: Base of the exponential spacing, rate of the variates and largest register.
BASE, RATE, TOP = 1.001, 20.0, 40_000
#: Pairs with a likelihood estimate below this join no family. The estimate's standard deviation at 0.75 is 0.027, so a
#: link falls below with a probability of 1e-8.
LEAST_ESTIMATE = 0.6
#: Members of a chunk of a bucket or family, shingles of a family's chunk, pivots (as expected) that go to every chunk of
#: a group of several, chunks that make a block of pass two.
CHUNK, CHUNK_SHINGLES, PIVOTS, WIDE = 64, 1 << 19, 8, 8
#: Members outside a family's largest tree that are still held against all others; most members that hold a rare shingle.
REST, RARE = 4096, 32
#: Links that a task contracts at a time.
LINKS = 1 << 21
_RNG = np.random.default_rng(20240607)
#: Register i hashes a shingle's x to x * MULTIPLIERS[i] + SHIFTS[i] modulo 2^32.
MULTIPLIERS = _RNG.integers(0, 1 << 31, M, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _RNG.integers(0, 1 << 32, M, dtype=np.uint32)
#: Of the words of a shingle, by place.
PLACES = _RNG.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A full avalanche of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles. Bytes are split at exactly the six white-space characters
    that are meant, and lower-cased in exactly A-Z."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(w) - SHINGLE + 1
    out = w[:n] * PLACES[0]
    for i in range(1, SHINGLE):
        out += w[i : i + n] * PLACES[i]
    return np.unique(_mix(out))


def registers(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The registers of the sets that begin at ``starts`` in ``x``, a row a set."""
    x, least = (x >> np.uint64(32)).astype(np.uint32), np.empty((M, len(starts)), np.uint32)
    for i in range(M):
        least[i] = np.minimum.reduceat(x * MULTIPLIERS[i] + SHIFTS[i], starts)
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP + 1).astype("<u2").T


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint likelihood estimates of the similarity of pairs, from registers (a row a pair) and the sets' sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    with np.errstate(divide="ignore", invalid="ignore"):
        log = lambda k, q: np.where(k > 0, k * np.log(np.maximum(q, 1e-12)), 0.0)
        best = (log(more, up) + log(less, down) + log(M - more - less, 1 - up - down)).argmax(1)
    return j[np.arange(len(best)), best]


def _batches(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[list[np.ndarray], int]]:
    """The sets of consecutive texts, about ``most`` shingles at a time."""
    sets, held = [], 0
    for text in column:
        sets.append(shingles(text.as_py()))
        held += len(sets[-1])
        if held > most // 8:
            yield sets, held
            sets, held = [], 0
    if sets:
        yield sets, held


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row, n, h1, h2, regs): a hash of the text, then size, 128-bit fingerprint and registers of the row's set (no
    set: 0, null, null)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            at = 0
            for sets, _ in _batches(batch.column("text")):
                n = np.array([len(s) for s in sets], np.int64)
                full = [s for s in sets if len(s)]
                regs: list[bytes | None] = [None] * len(sets)
                if full:
                    sizes = n[n > 0]
                    rows = registers(np.concatenate(full), np.cumsum(sizes) - sizes)
                    for i, r in zip(np.flatnonzero(n), rows, strict=True):
                        regs[i] = r.tobytes()
                prints = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") if len(s) else (None, None) for s in sets]
                own = [batch.column(c).slice(at, len(sets)) for c in ("key", "row")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(n), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array(regs, pa.binary())],
                    names=["key", "row", "n", "h1", "h2", "regs"],
                )
                at += len(sets)

    return _rows(docs, key, text).mapInArrow(shared.lean(task), "key long, row long, n long, h1 long, h2 long, regs binary")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))


def _buckets(words: np.ndarray) -> np.ndarray:
    """The buckets of rows of bands, each band's four registers as one word."""
    return _mix(words + np.arange(1, BANDS + 1, dtype=np.uint64) * PLACES[0]).view(np.int64)


def _bands(nodes: DataFrame) -> DataFrame:
    """(bucket, node), a row for each band: the hash of a band's registers and its number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), "<u2").reshape(-1, M)[:, : BANDS * ROWS]
                own = _buckets(np.ascontiguousarray(regs).view("<u8"))
                for i in range(0, len(own), 1024):
                    part = own[i : i + 1024]
                    held = pa.array(np.repeat(batch.column("node").to_numpy()[i : i + 1024], BANDS))
                    yield pa.RecordBatch.from_arrays([pa.array(part.reshape(-1)), held], names=["bucket", "node"])

    return nodes.select("node", "regs").mapInArrow(shared.lean(task), "bucket long, node long")


# Components.


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of links, and of each the least end that it is connected with."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, up = at[: len(a)], at[len(a) :], np.arange(len(ends))
    while True:
        low, high = np.minimum(up[x], up[y]), np.maximum(up[x], up[y])
        apart = low != high
        if not apart.any():
            return ends, ends[up]
        np.minimum.at(up, high[apart], low[apart])
        while not np.array_equal(up, up[up]):
            up = up[up]


def _contracted(links: DataFrame) -> DataFrame:
    """Links (v, u) that connect the same: within each task, ``LINKS`` at a time, every end points to the least one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars() -> pa.RecordBatch:
            ends, least = roots(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("v", "u")))
            own = ends != least
            return pa.RecordBatch.from_arrays([pa.array(ends[own]), pa.array(least[own])], names=["v", "u"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if held and sum(h.num_rows for h in held) + batch.num_rows > LINKS:
                yield stars()
                held = []
            if batch.num_rows:
                held.append(batch)
        if held:
            yield stars()

    return links.mapInArrow(shared.lean(task), "v long, u long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of written links (a, b), without the nodes that are their component's least. Tasks contract ``LINKS``
    links each, again and again while that halves them; it is all where one task takes all. Else large and small stars in
    turn until nothing changes, each round from a written table and contracted again."""
    edges = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u")
    while True:
        n = edges.count()
        edges, _ = shared.cut(_contracted(edges.coalesce(max(1, -(-n // LINKS)))), "edges")
        if n <= LINKS:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("comp"))
        if 2 * edges.count() <= n:
            continue
        # Done when every node either points to one other or is pointed to.
        ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(edges.select(F.col("u").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("low")).distinct())
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 or up > 0 and low > 0").isEmpty():
            return edges.select(F.col("v").alias("node"), F.col("u").alias("comp"))
        # A star's centre has many links and one least end; that is written first, so that the join's many can be split.
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least, _ = shared.cut(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m")), "least")
        large = both.where("u > v").join(shared.small(least), "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        large, _ = shared.cut(large, "large")
        least, _ = shared.cut(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        small = large.join(shared.small(least), "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u")).where("v <> u")
        edges, _ = shared.cut(small.unionByName(least.select("v", F.col("m").alias("u"))).distinct(), "edges")


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after links (a, b) between labels; a node without a row is its own label."""
    more = components(links).toDF("label", "to")
    held = labels.join(shared.small(more), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return shared.cut(held.unionByName(more.select(F.col("label").alias("node"), F.col("to").alias("label"))), "labels")[0]


# Groups: buckets and families.


def _dealt(members: DataFrame, group: str) -> DataFrame:
    """Pass one. ``members`` (group, of, chunks, node, ...) with ``i``, ``j`` (0), ``side`` (-1) and ``label`` (the node):
    each in a chunk of its group, pivots in all of them."""
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pivot = (F.col("chunks") > 1) & (F.pmod(F.xxhash64(F.lit(7), "node"), F.col("of")) < PIVOTS)
    at = F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own)))
    rest = [c for c in members.columns if c not in ("of", "chunks")]
    return members.select(*rest, at.alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("side"), F.col("node").alias("label"))


def _rest(members: DataFrame, labels: DataFrame, group: str, most: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """Pass two. Of groups of several chunks (group, of, chunks, node): (group, node, label, i, j, side), the members
    outside their group's largest tree (side 1) against all (side 0); and (group, node, label) of groups with over ``most``
    members outside. None where there are none."""
    members = members.where("chunks > 1").select(group, "of", F.ceil(F.col("chunks") / WIDE).cast("int").alias("chunks"), "node")
    held = members.join(shared.small(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    held, _ = shared.cut(held, "held")
    counts = held.groupBy(group, "of", "chunks", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy(group, "of", "chunks").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    largest, _ = shared.cut(largest.select(group, "largest", "rest", F.ceil(F.col("rest") * F.col("chunks") / F.col("of")).cast("int").alias("blocks")), "largest")
    apart = None
    if most is not None:
        many = largest.where(F.col("rest") > most).select(group)
        apart = None if many.isEmpty() else held.join(shared.small(shared.cut(many, "apart")[0]), group).select(group, "node", "label")
        largest = largest.where(F.col("rest") <= most)
    if largest.isEmpty():
        return None, apart
    held = held.join(shared.small(largest.drop("rest")), group)
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    all_ = held.select(group, "node", "label", place("chunks").alias("i"), every("blocks").alias("j"), F.lit(0).alias("side"))
    return all_.unionByName(held.where("label <> largest").select(group, "node", "label", every("chunks").alias("i"), place("blocks").alias("j"), F.lit(1).alias("side"))), apart


# Families that fall apart.


def _shingled(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(family, node, shingle) of the nodes ``wanted`` (key, row, node, family); docs: (key, row, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets, _ in _batches(batch.column("text")):
                n = [len(s) for s in sets]
                own = [np.repeat(batch.column(c).slice(at, len(sets)).to_numpy(), n) for c in ("family", "node")]
                flat = np.concatenate(sets).view(np.int64)
                for i in range(0, len(flat), 1 << 17):
                    yield pa.RecordBatch.from_arrays([*(pa.array(o[i : i + (1 << 17)]) for o in own), pa.array(flat[i : i + (1 << 17)])], names=["family", "node", "shingle"])
                at += len(sets)

    own = docs.join(shared.small(wanted), ["key", "row"]).select("family", "node", "text")
    return own.dropDuplicates(["node"]).mapInArrow(shared.lean(task), "family long, node long, shingle long")


def _rare(shingled: DataFrame) -> DataFrame:
    """The rows (family, node, shingle), written, of shingles that ``RARE`` members of their family hold at most."""
    counts = shingled.groupBy("family", "shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RARE)
    common, _ = shared.cut(counts.select("family", "shingle"), "common")
    return shared.cut(shingled.join(shared.small(common), ["family", "shingle"], "left_anti"), "rare")[0]


def _counted(apart: DataFrame, nodes: DataFrame, rare: DataFrame) -> DataFrame:
    """(family, node, label, n, c), written: each member's shingles, and how many of them are common."""
    few = rare.groupBy("node").agg(F.count(F.lit(1)).alias("rare"))
    held = apart.join(nodes.select("node", "n"), "node").join(few, "node", "left")
    return shared.cut(held.select("family", "node", "label", "n", (F.col("n") - F.coalesce("rare", F.lit(0))).alias("c")), "counted")[0]


def _enough(both: str, x: str, y: str) -> Column:
    """Whether ``both`` shared shingles link sets of ``x`` and ``y``: 100 both >= PERCENT (x + y - both)."""
    return (100 + PERCENT) * F.expr(both) >= PERCENT * (F.col(x) + F.col(y))


def _met(rare: DataFrame, counted: DataFrame) -> DataFrame:
    """(a, b, label_a, label_b), written: members in different trees that share a rare shingle, and whose shared rare ones and
    the common ones that they may share would be enough."""
    lists = rare.groupBy("family", "shingle").agg(F.collect_list("node").alias("own")).where(F.size("own") > 1)  # RARE at most
    pairs = F.flatten(F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))
    both = lists.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("both"))
    for end in ("a", "b"):
        own = counted.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("label", "n", "c")])
        both = both.join(shared.small(own), end)
    found = both.where((F.col("label_a") != F.col("label_b")) & _enough("both + least(c_a, c_b)", "n_a", "n_b"))
    return shared.cut(found.select("a", "b", "label_a", "label_b"), "met")[0]


def _dense(counted: DataFrame) -> DataFrame:
    """(family, of, chunks, node) of members with whom another's common shingles alone could be enough: x has such a partner y
    only if c(x) and c(y) both are, that is if y's size is at most what c(x) allows, and x's what c(y) does."""
    allows = ((100 + PERCENT) * F.col("c") - PERCENT * F.col("n")).alias("allows")  # PERCENT times the largest partner's size
    rows = counted.select("family", "node", "n", allows)
    by_size = rows.groupBy("family", "n").agg(F.max("allows").alias("most"))
    sizes, _ = shared.cut(by_size.groupBy("family").agg(F.collect_list(F.struct("n", "most")).alias("sizes")), "by-size")  # a family's sizes
    partner = F.exists("sizes", lambda s: (PERCENT * s["n"] <= F.col("allows")) & (PERCENT * F.col("n") <= s["most"]))
    rows = rows.join(shared.small(sizes), "family").where(partner).select("family", "node", "n")
    of = rows.groupBy("family").agg(F.count(F.lit(1)).alias("of"), F.sum("n").alias("weight"))
    chunks = F.greatest(F.lit(2), F.ceil(F.col("of") / CHUNK), F.ceil(F.col("weight") / CHUNK_SHINGLES)).cast("int")
    return rows.join(shared.small(shared.cut(of.where("of > 1").select("family", "of", chunks.alias("chunks")), "dense")[0]), "family").select("family", "of", "chunks", "node")


def _indexed(docs: DataFrame, nodes: DataFrame, apart: DataFrame, labels: DataFrame, wanted) -> DataFrame:
    """Links (a, b) between the labels of members (family, node, label) of families that fall apart."""
    apart, _ = shared.cut(apart, "apart")
    shingled, _ = shared.cut(_shingled(docs, shared.cut(wanted(apart).join(apart.select("node", "family"), "node"), "wanted")[0]), "shingled")
    rare = _rare(shingled)
    counted = _counted(apart, nodes, rare)
    met = _met(rare, counted).withColumn("family", F.monotonically_increasing_id())  # a pair is a group of its own
    sides = [met.select("family", F.col(e).alias("node"), F.col(f"label_{e}").alias("label"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(-1).alias("side")) for e in ("a", "b")]
    pairs, _ = shared.cut(sides[0].unionByName(sides[1]), "pairs")
    links, _ = shared.cut(_linked_in(pairs.join(_sets(docs, wanted(pairs)), "node")), "links")
    rest, _ = _rest(_dense(counted), labels, "family")
    if rest is None:
        return links
    more, _ = shared.cut(_linked_in(rest.join(_sets(docs, wanted(rest)), "node")), "links")
    return links.unionByName(more)


def _together(rows: DataFrame, group: str) -> DataFrame:
    return rows.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j", "node")


def _whole(batches: Iterator[pa.RecordBatch], group: str, rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, ``rows`` rows or more where there are so many, and the number of each row's group."""
    held: list[pa.RecordBatch] = []

    def numbered(table: pa.Table) -> np.ndarray:
        key = np.stack([table[c].to_numpy() for c in (group, "i", "j")])
        return np.concatenate([[0], np.cumsum((key[:, 1:] != key[:, :-1]).any(0))])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held)
            number = numbered(table)
            cut = int(np.searchsorted(number, number[-1]))  # the last group may go on
            if cut:
                yield table.slice(0, cut), number[:cut]
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, numbered(table)


def _pairs(group: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group (equal ``group``, consecutive), some tens of thousands at a time. Groups with two sides
    (0 and 1; else -1) pair across them."""
    n, d, held_a, held_b, held = len(group), 1, [], [], 0
    live = np.arange(n)
    while True:
        live = live[live + d < n]
        live = live[group[live] == group[live + d]]
        if not len(live):
            break
        own = live[(side[live] < 0) | (side[live] != side[live + d])]
        held_a.append(own)
        held_b.append(own + d)
        held += len(own)
        d += 1
        if held > 30_000:
            yield np.concatenate(held_a), np.concatenate(held_b)
            held_a, held_b, held = [], [], 0
    if held:
        yield np.concatenate(held_a), np.concatenate(held_b)


def _edges(a: list | np.ndarray, b: list | np.ndarray) -> pa.RecordBatch:
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _likely(members: DataFrame) -> DataFrame:
    """A forest (a, b) over the labels of likely pairs of rows (bucket, i, j, side, label, node, n, regs)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole(batches, "bucket", 8192):
            label, n, side = (table[c].to_numpy() for c in ("label", "n", "side"))
            regs = np.frombuffer(b"".join(table["regs"].to_pylist()), "<u2").reshape(-1, M)
            words = np.ascontiguousarray(regs[:, : BANDS * ROWS]).view("<u8")
            band = (_buckets(words) == table["bucket"].to_numpy()[:, None]).argmax(1)
            # Rows of one tree need no comparison, so a chunk of near copies costs about its size, not its square.
            _, tree = np.unique(label, return_inverse=True)
            kept = []
            for a, b in _pairs(group, side):
                fit = np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * PERCENT
                a, b = a[fit], b[fit]
                for k in range(0, len(a), 1024):
                    x, y = a[k : k + 1024], b[k : k + 1024]
                    apart = tree[x] != tree[y]
                    x, y = x[apart], y[apart]
                    first = (words[x] == words[y]).argmax(1) == band[x]
                    x, y = x[first], y[first]
                    near = (regs[x] == regs[y]).sum(1) >= (LEAST_ESTIMATE - 0.05) * M
                    x, y = x[near], y[near]
                    if len(x):
                        ok = estimate(regs[x], regs[y], n[x].astype(float), n[y].astype(float)) >= LEAST_ESTIMATE
                        for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                            if tree[i] != tree[j]:
                                tree[tree == tree[j]] = tree[i]
                                kept.append((label[i], label[j]))
            if kept:
                yield _edges(*zip(*kept, strict=True))

    return _together(members, "bucket").mapInArrow(shared.lean(task), "a long, b long")


def overlaps(one: np.ndarray, codes: np.ndarray, starts: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """How many of its codes each set (codes from ``starts`` on) shares with ``one``; ``mark``: false for every code."""
    mark[one] = True
    out = np.add.reduceat(mark[codes], starts, dtype=np.int64)
    mark[one] = False
    return out


def linked(sets: list[np.ndarray], side: np.ndarray, label: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs (places in ``sets``, which are sorted, distinct and not empty) of linked sets that connect all that links
    connect. Sets of one label are connected; with sides (0 and 1; else -1), links are across them."""
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark, a, b = np.zeros(int(codes.max()) + 1, bool), [], []

    def near(i: int, others: np.ndarray) -> np.ndarray:
        others = others[np.minimum(size[others], size[i]) * 100 >= np.maximum(size[others], size[i]) * PERCENT]
        if not len(others):
            return others
        own = size[others]
        at = np.repeat(ends[others] - np.cumsum(own), own) + np.arange(own.sum())
        both = overlaps(codes[ends[i] - size[i] : ends[i]], codes[at], np.cumsum(own) - own, mark)
        return others[both * 100 >= (own + size[i] - both) * PERCENT]

    _, tree = np.unique(label, return_inverse=True)
    if side[0] < 0:
        # From set to set; what has been reached need not be compared again.
        left = np.arange(len(sets))
        while len(left):
            reached, left = [left[0]], left[1:]
            while reached and len(left):
                i = reached.pop()
                found = near(int(i), left)
                if len(found):
                    a += [int(i)] * len(found)
                    b += found.tolist()
                    reached += found.tolist()
                    left = left[~np.isin(left, found)]
        return a, b
    many, few = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for i in few.tolist():
        for j in near(i, many[tree[many] != tree[i]]).tolist():
            if tree[i] != tree[j]:
                tree[tree == tree[j]] = tree[i]
                a.append(i)
                b.append(j)
    return a, b


def _linked_in(sets: DataFrame) -> DataFrame:
    """A forest (a, b) over the labels of links within the groups of rows (family, i, j, side, label, node, set)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in _whole(batches, "family", 1):
            label, side = table["label"].to_numpy(), table["side"].to_numpy()
            sets = [np.frombuffer(x, "<u8") for x in table["set"].to_pylist()]
            found_a, found_b = [], []
            for begin, end in zip(*(np.searchsorted(group, np.arange(group[-1] + 1), s) for s in ("left", "right")), strict=True):
                if end - begin > 1:
                    a, b = linked(sets[begin:end], side[begin:end], label[begin:end])
                    found_a += label[begin:end][a].tolist()
                    found_b += label[begin:end][b].tolist()
            if found_a:
                yield _edges(found_a, found_b)

    return _together(sets, "family").mapInArrow(shared.lean(task), "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of the nodes ``wanted`` (key, row, node), sets as sorted little-endian u64; docs: (key, row, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets, _ in _batches(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, len(sets)), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], names=["node", "set"])
                at += len(sets)

    own = docs.join(shared.small(wanted), ["key", "row"]).select("node", "text")
    return own.dropDuplicates(["node"]).mapInArrow(shared.lean(task), "node long, set binary")  # rows that are equal come once


def _families(nodes: DataFrame) -> DataFrame | None:
    """(node, label) of the nodes that likely pairs connect; None without any."""
    entries = _bands(nodes)
    buckets = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("of")).where("of > 1")
    buckets, _ = shared.cut(buckets.withColumn("chunks", F.ceil(F.col("of") / CHUNK).cast("int")), "buckets")
    held = nodes.select("node", "n", "regs")
    likely, _ = shared.cut(_likely(_dealt(entries.join(buckets, "bucket").join(held, "node"), "bucket")), "likely")
    if likely.isEmpty():
        return None
    labels, _ = shared.cut(components(likely).toDF("node", "label"), "labels")
    hot = buckets.where("chunks > 1")
    if not hot.isEmpty() and (rest := _rest(entries.join(shared.small(hot), "bucket"), labels, "bucket")[0]) is not None:
        more, _ = shared.cut(_likely(rest.join(held, "node")), "likely")
        labels = labels if more.isEmpty() else _relabelled(labels, more)
    return labels


def _linked(docs: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame | None:
    """(node, label) of the classes that links connect, without those that are their component's least; None without any."""
    labels = _families(nodes)
    if labels is None:
        return None
    members = labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct()).toDF("node", "family")
    members, _ = shared.cut(members.join(nodes.select("node", "n"), "node"), "members")
    chunks = F.greatest(F.ceil(F.col("of") / CHUNK), F.ceil(F.col("weight") / CHUNK_SHINGLES)).cast("int")
    sizes, _ = shared.cut(members.groupBy("family").agg(F.count(F.lit(1)).alias("of"), F.sum("n").alias("weight")).withColumn("chunks", chunks).drop("weight"), "sizes")
    members = members.join(shared.small(sizes), "family").select("family", "of", "chunks", "node")
    wanted = lambda df: shared.cut(df.select("node").distinct().join(classes.select("node", "key", "row"), "node"), "wanted")[0]
    links, _ = shared.cut(_linked_in(_dealt(members, "family").join(_sets(docs, wanted(members)), "node")), "links")
    if links.isEmpty():
        labels = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    else:
        labels, _ = shared.cut(components(links).toDF("node", "label"), "labels")
    hot = sizes.where("chunks > 1")
    if not hot.isEmpty():
        rest, apart = _rest(members, labels, "family", REST)
        if rest is not None:
            more, _ = shared.cut(_linked_in(rest.join(_sets(docs, wanted(rest)), "node")), "links")
        if apart is not None:
            found = _indexed(docs, nodes, apart, labels, wanted)
            more = found if rest is None else more.unionByName(found)
        if (rest is not None or apart is not None) and not more.isEmpty():
            labels = _relabelled(labels, more)
    return None if labels.isEmpty() else labels


def _sorted_out(docs: DataFrame, key: str, text: str, by_key: bool) -> tuple[DataFrame, DataFrame]:
    """(key, row, n, component) of the rows that take part, and (key, n) of the others. ``by_key``: rows that share a key
    are linked."""
    found, _ = shared.cut(sketches(docs, key, text), "sketches")
    with_set = found.where("n > 0 and key is not null")
    classes = with_set.groupBy("h1", "h2").agg(F.min(F.struct("key", "row")).alias("first")).select("h1", "h2", "first.key", "first.row", F.monotonically_increasing_id().alias("node"))
    classes, _ = shared.cut(classes, "classes")
    members = with_set.select("key", "row", "n", "h1", "h2").join(classes.select("h1", "h2", "node", F.col("key").alias("least")), ["h1", "h2"])
    members, _ = shared.cut(members.select("key", "row", "n", "node", "least"), "members")
    first = ["h1", "h2", "key", "row"]
    nodes, _ = shared.cut(with_set.join(classes, first).dropDuplicates(first).select("node", "n", "regs"), "nodes")
    labels = _linked(_rows(docs, key, text), nodes, classes)
    if by_key:
        several = members.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key", "a")
        several, _ = shared.cut(several, "several")
        if not several.isEmpty():
            none = members.select("node", F.col("node").alias("label")).limit(0)
            labels = none if labels is None else labels
            own = members.join(shared.small(several), "key").select("a", F.col("node").alias("b")).distinct()
            for end in ("a", "b"):
                own = own.join(shared.small(labels.toDF(end, "label")), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
            own, _ = shared.cut(own.where("a <> b").select("a", "b"), "keys")
            labels = labels if own.isEmpty() else _relabelled(labels, own)
    if labels is None:
        named = members.withColumn("component", F.col("least"))
    else:
        every = labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
        least, _ = shared.cut(every.join(classes.select("node", "key"), "node").groupBy("label").agg(F.min("key").alias("component")), "least")
        named = members.join(shared.small(shared.cut(every.join(shared.small(least), "label").select("node", "component"), "components")[0]), "node", "left")
        named = named.withColumn("component", F.coalesce("component", "least"))
    return named.select("key", "row", "n", "component"), found.where("n = 0 or key is null").select("key", "n")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept), a row for each row of ``docs``."""
    named, alone = _sorted_out(docs, key, text, True)
    return named.select("key", "n", "component").unionByName(alone.withColumn("component", F.col("key"))).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("key").isNull() | (F.col("key") == F.col("component"))).alias("kept")
    )


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is the least of the texts that theirs is linked with; rows with null keys stay. A
    text goes for its own links alone, not for those of other rows that share its key."""
    named, _ = _sorted_out(docs, key, text, False)
    copies, _ = shared.cut(named.where("key <> component").select(F.col("key").alias("__pm_key"), F.col("row").alias("__pm_row")).distinct(), "copies")
    return docs.join(shared.small(copies), (docs[key].cast("long") == F.col("__pm_key")) & (F.xxhash64(docs[text]) == F.col("__pm_row")), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the documents' near-duplicate components."""
    return near_duplicates(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))
