"""Approximate nearest neighbours by largest inner product: a hierarchical navigable small-world graph per shard.

A shard is a bounded number of vectors; equal vectors of a shard are one node. Nodes within ``CLOSE`` of another, relative to
its length, are followers of it: only leaders are in the graph, so that a large group of near copies takes one place of a
beam, and a leader's followers are compared where one of them could be an answer. Each level of a shard's graph holds a
geometrically smaller share of its nodes, drawn at random, and of every node one among its ``COVER`` nearest, so that no
group of near copies is without a node above. A shard is built as a whole, not node by node. A node's neighbours on a level
are those there with the ``NEAR`` largest inner products, and its nearest ones after vectors are lifted to equal norms (one
more component), thinned so that each is nearer to the node than to any kept one, with back links: the former lead to long
vectors, which are most queries' answers, the latter everywhere. A few are chosen likewise from the nearest nodes of each
higher level, which lead out of groups larger than ``CHOICE``; every node of a level can be reached from the level above. A
search begins at the highest level, which holds ``TOP`` nodes at most, and goes down all of them, with a beam of ``UPPER``
nodes, and of ``BEAM`` nodes on the lowest, for all queries of a block at once.

Shards are parts of cells: vectors go to the nearest of at most ``CELLS`` centres (fitted on ``SAMPLE`` vectors), and a
cell of more than a shard is dealt over several. Graphs are files in the shared folder; a search task holds its queries and
reads one graph after another, so neither graphs nor queries are copied through a shuffle, and merges the shards' results
itself. A shard is left out for a query only where no vector in it can reach the query's twentieth score yet, by the
shard's centre and radius, which loses nothing. Scores are computed on the original vectors in double precision.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of
different lengths are never compared; null ids take no part; ties go to the smaller id; rows that share the query's id
are its own; rows of one id and different vectors are candidates each, and queries each; rows equal in id and vector count
once; fewer candidates than K are all returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import shared

#: Neighbours returned; of each node on a level: neighbours by inner product, neighbours by distance, nearest ones that
#: the latter are chosen from; beam of a search, which is 3 K where more than these are asked for.
K, NEAR, LINKS, CHOICE, BEAM = 20, 36, 8, 96, 56
#: Neighbours by inner product on the higher levels, which only lead on.
NEAR_ABOVE = 2
#: Links to nodes of higher levels, nearest ones of each level that they are chosen from, beam on the higher levels, most
#: nodes of the highest.
FAR, FAR_CHOICE, UPPER, TOP = 8, 32, 48, 64
#: Vectors in a shard, queries in a task, queries that walk a graph at once.
SHARD, QUERIES, BLOCK = 8192, 512, 128
#: Centres of cells, and vectors that they are fitted on (as expected; drawn by a hash of the id).
CELLS, SAMPLE = 256, 4096
SHRINK = 16
#: Of every node, it or one of so many nearest ones is on the level above.
COVER = 64
#: Nodes of a beam that a step expands.
STEPS = 1
#: Followers are nearer to their leader than this share of its length.
CLOSE = 0.2
RESULT = "query_id long, rank int, vec_id long, score double"


def _nearest(x: np.ndarray, k: int, among: np.ndarray | None = None, block: int = 1024) -> np.ndarray:
    """The k nearest rows of each row (not itself; of ``among``), nearest first, by inner product of rows of equal norm."""
    among = np.arange(len(x)) if among is None else among
    if not k:
        return np.empty((len(x), 0), np.int32)
    out, y = np.empty((len(x), k), np.int32), x[among]
    for i in range(0, len(x), block):
        near = x[i : i + block] @ y.T
        own = np.flatnonzero((among >= i) & (among < i + len(near)))
        near[among[own] - i, own] = -np.inf
        best = np.argpartition(near, -k, axis=1)[:, -k:] if k < near.shape[1] else np.argsort(near, axis=1)[:, -k:]
        order = np.argsort(-np.take_along_axis(near, best, 1), axis=1, kind="stable")
        out[i : i + block] = among[np.take_along_axis(best, order, 1)]
    return out


def _thinned(x: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each node's candidates, nearest first, those that are nearer to it than to any kept one; -1 where there is none."""
    n = len(x)
    out, count = np.full((n, most), -1, np.int32), np.zeros(n, np.int64)
    score = np.empty(near.shape, np.float32)
    for i in range(0, n, 4096):
        score[i : i + 4096] = np.einsum("nd,nkd->nk", x[i : i + 4096], x[near[i : i + 4096]])
    for j in range(near.shape[1]):
        open_ = np.flatnonzero((count < most) & (near[:, j] != np.arange(n)))
        c = near[open_, j]
        kept = out[open_]
        between = np.einsum("nd,nkd->nk", x[c], x[kept])
        between[kept < 0] = -np.inf
        own = open_[(between.max(1) < score[open_, j]) | (count[open_] == 0)]
        out[own, count[own]] = near[own, j]
        count[own] += 1
    return out


def _above(near: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """The nodes of the next level: the drawn ones, and more until each node or one of its nearest is there."""
    held = np.zeros(len(near), bool)
    held[drawn] = True
    near = near[:, :COVER]
    for i in np.flatnonzero(~held & ~held[near].any(1)):
        held[i] = not held[near[i]].any()
    return np.flatnonzero(held)


def _links(x: np.ndarray, near: np.ndarray, upper: list[np.ndarray], by_product: int) -> np.ndarray:
    """A level's neighbour array, a row a node, -1 where there is none. ``x``: lifted; ``upper``: the nodes of each higher
    level; ``by_product``: neighbours by inner product."""
    n, most = len(x), LINKS
    if n < 2:
        return np.full((n, 1), -1, np.int32)
    out = np.full((n, 2 * most), -1, np.int32)
    out[:, :most] = _thinned(x, near, most)
    # Back links into the second half of the rows, nearest first, as far as there is room.
    a, k = np.nonzero(out[:, :most] >= 0)
    b = out[a, k]
    order = np.lexsort((-np.einsum("nd,nd->n", x[a], x[b]), b))
    a, b = a[order], b[order]
    place = np.arange(len(b)) - np.searchsorted(b, b)
    room = place < most
    out[b[room], most + place[room]] = a[room]
    out = _merged(out, _nearest(x[:, :-1], min(by_product, n - 1)))
    if not upper:
        return out
    far = np.hstack([_nearest(x, min(FAR_CHOICE, len(u)), u) for u in upper])
    far_score = np.empty(far.shape, np.float32)
    for i in range(0, n, 4096):
        far_score[i : i + 4096] = np.einsum("nd,nkd->nk", x[i : i + 4096], x[far[i : i + 4096]])
    far = np.take_along_axis(far, np.argsort(-far_score, axis=1, kind="stable"), 1)
    return _joined(x, _merged(out, _thinned(x, far, FAR)), near, upper[0])


def _merged(*links: np.ndarray) -> np.ndarray:
    """Neighbour arrays side by side, each neighbour once, -1 at the end."""
    out = np.sort(np.hstack(links), axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    out = np.take_along_axis(out, np.argsort(out < 0, axis=1, kind="stable"), 1)
    return np.ascontiguousarray(out[:, : max(1, (out >= 0).sum(1).max(initial=0))])


def _joined(x: np.ndarray, links: np.ndarray, near: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The links, and more until every node can be reached from the entries."""
    reached = np.zeros(len(x), bool)

    def walk(at: np.ndarray) -> None:
        reached[at] = True
        while len(at):
            at = np.unique(links[at])
            at = at[(at >= 0) & ~reached[at]]
            reached[at] = True

    walk(entries)
    for i in range(len(x)):
        if reached[i]:
            continue
        free = near[i][reached[near[i]] & (links[near[i]] < 0).any(1)]
        if not len(free):
            if not len(free := np.flatnonzero(reached & (links < 0).any(1))):
                links = np.hstack([links, np.full((len(x), 1), -1, np.int32)])
                free = np.flatnonzero(reached)
            free = free[np.argsort(-(x[free] @ x[i]), kind="stable")]
        links[free[0], (links[free[0]] < 0).argmax()] = i
        walk(np.array([i]))
    return links


def _led(x: np.ndarray) -> np.ndarray:
    """Of each row its leader: itself, or an earlier leader that it is close to."""
    lead, norm = np.arange(len(x)), np.einsum("nd,nd->n", x, x)
    lifted = np.hstack([x, np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))[:, None]]).astype(np.float32)
    nearest = _nearest(lifted, 1)[:, 0] if len(x) > 1 else lead
    apart = lambda i, j: norm[i] + norm[j] - 2 * np.einsum("nd,nd->n", x[i], x[j])
    open_ = np.flatnonzero(apart(lead, nearest) <= 4 * CLOSE**2 * norm) if len(x) > 1 else lead[:0]
    while len(open_):
        i, open_ = open_[0], open_[1:]
        near = norm[open_] + norm[i] - 2 * (x[open_] @ x[i]) <= CLOSE**2 * norm[i]
        lead[open_[near]] = i
        open_ = open_[~near]
    return lead


class Graph:
    """A shard's graph. ``vectors``: of each node, in single precision, up to a common factor; ``originals``: in double, if
    they are others; ``ids`` and ``ends``: of each node the ids that share its vector, ascending. ``followers`` and ``until``: of
    each node the nodes that follow it; ``reach``: how far away the farthest is. ``scored``: how many nodes searches have held
    against a query so far."""

    scored = 0

    def __init__(self, vectors: np.ndarray, originals: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        self.vectors, self.originals, self.ids, self.ends = vectors, originals, ids, ends

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Graph:
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(1)
        again = np.zeros(len(ids), bool)
        again[1:] = ~new[1:] & (ids[1:] == ids[:-1])
        ids, vectors, new = ids[~again], vectors[~again], new[~again]
        first = np.flatnonzero(new)
        originals = vectors[first]
        single = np.ascontiguousarray(originals / max(1.0, np.abs(originals).max() / 1e15), np.float32)
        same = single.dtype == originals.dtype or np.array_equal(single, originals)
        out = cls(single, single if same else originals, ids, np.cumsum(np.bincount(np.cumsum(new) - 1, minlength=len(first))))
        norm = (single.astype(float) ** 2).sum(1)
        lifted = np.hstack([single, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]]).astype(np.float32)
        lead = _led(single)
        follow = np.flatnonzero(lead != np.arange(len(lead)))
        out.followers = follow[np.argsort(lead[follow], kind="stable")].astype(np.int32)
        out.until = np.cumsum(np.bincount(lead[follow], minlength=len(lead)))
        out.reach = np.zeros(len(lead), np.float32)
        np.maximum.at(out.reach, lead[follow], np.sqrt(((single[follow] - single[lead[follow]]) ** 2).sum(1)) * np.float32(1 + 1e-5))
        leaders = np.flatnonzero(lead == np.arange(len(lead)))
        # A node's level: geometric, by a fixed permutation of the nodes, and where a neighbourhood has no node above.
        rank = np.argsort(np.random.default_rng(3).permutation(len(lifted)))
        levels, size = [(leaders, _nearest(lifted[leaders], min(CHOICE, len(leaders) - 1)))], len(lifted)
        while len(levels[-1][0]) > TOP:
            size //= SHRINK
            nodes, near = levels[-1]
            nodes = nodes[_above(near, np.flatnonzero(rank[nodes] < size))]
            if 2 * len(nodes) > len(levels[-1][0]):
                break
            levels.append((nodes, _nearest(lifted[nodes], min(CHOICE, len(nodes) - 1))))
        out.levels = []
        for i, (nodes, near) in enumerate(levels):
            local = _links(lifted[nodes], near, [np.searchsorted(nodes, u) for u, _ in levels[i + 1 :]], NEAR if not i else NEAR_ABOVE)
            out.levels.append((nodes.astype(np.int32), np.where(local >= 0, nodes[local], -1).astype(np.int32)))
        return out

    def search(self, queries: np.ndarray, beam: int = BEAM, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """The best ``beam`` nodes found and their scores for each query, best first (-1 and -inf where there are fewer)."""
        # Only the order counts here, so queries may be scaled.
        q, at = (queries / np.maximum(np.abs(queries).max(1, keepdims=True), 1e-300)).astype(np.float32), None
        for nodes, links in self.levels[:0:-1]:
            at, _ = self._beam(q, at, nodes, links, UPPER)
        return self._followed(q, *self._beam(q, at, *self.levels[0], beam), beam, k)

    def _followed(self, q: np.ndarray, node: np.ndarray, score: np.ndarray, beam: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam with the followers of its leaders, where one of them may be among the ``k`` best: first of the best leaders,
        as far as k nodes need, then of those that can still reach the k-th of what that gave."""
        begin = np.concatenate([[0], self.until])
        many = np.where(node >= 0, self.until[node] - begin[node], 0)
        if not many.any():
            return node, score
        norm = np.sqrt(np.einsum("nd,nd->n", q, q)) * np.float32(1 + 1e-5)
        before, reach = np.cumsum(many + 1, axis=1) - many - 1, score + self.reach[node] * norm[:, None]
        out, best = node, score
        for first in (True, False):
            least = best[:, k - 1] if best.shape[1] >= k else np.full(len(q), -np.inf, np.float32)
            row, column = np.nonzero((many > 0) & ((before < k) == first) & (reach >= least[:, None]))
            at, n = node[row, column], many[row, column]
            more = self.followers[np.repeat(begin[at] + n - np.cumsum(n), n) + np.arange(n.sum())]
            row, found = np.repeat(row, n), np.empty(len(more), np.float32)
            for i in range(0, len(more), 1 << 17):
                found[i : i + (1 << 17)] = np.einsum("fd,fd->f", q[row[i : i + (1 << 17)]], self.vectors[more[i : i + (1 << 17)]])
            self.scored += len(more)
            held, place = np.nonzero(out >= 0)
            row, more, found = np.concatenate([held, row]), np.concatenate([out[held, place], more]), np.concatenate([best[held, place], found])
            order = np.lexsort((-found, row))
            row, more, found = row[order], more[order], found[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            kept = place < beam
            width = int(place[kept].max()) + 1
            out, best = np.full((len(q), width), -1, np.int32), np.full((len(q), width), -np.inf, np.float32)
            out[row[kept], place[kept]], best[row[kept], place[kept]] = more[kept], found[kept]
        return out, best

    def candidates(self, ids: np.ndarray, queries: np.ndarray, k: int = K, beam: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, score on the originals) of the ids in the beams, the queries' own left out; of the ids that
        share a vector the k + 1 smallest, as these win ties and one may be the query's own."""
        beam = beam or (BEAM if k <= K else 3 * k)
        dim, begin = queries.shape[1], np.concatenate([[0], self.ends])
        step, out = max(8, min(BLOCK, (8 << 20) // (beam * dim))), []
        for i in range(0, len(queries), step):
            node, _ = self.search(queries[i : i + step], beam, k + 1)
            at, column = np.nonzero(node >= 0)
            node = node[at, column]
            found, score = self.originals[node], np.zeros(len(node))
            for d in range(dim):  # one sum in one order, so that equal vectors score the same everywhere
                score += queries[i + at, d] * found[:, d]
            many = np.minimum(self.ends[node] - begin[node], k + 1)
            at, score = np.repeat(at + i, many), np.repeat(score, many)
            own = self.ids[np.repeat(begin[node] + many - np.cumsum(many), many) + np.arange(many.sum())]
            other = own != ids[at]
            out.append((at[other], own[other], score[other]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _beam(self, q: np.ndarray, at: np.ndarray | None, nodes: np.ndarray, links: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """From the nodes ``at`` (-1: none) of each query; on the level that is entered, where nothing leads to, from all."""
        n, rows = len(q), np.arange(len(q))
        if at is None:
            self.scored += n * len(nodes)
            s = q @ self.vectors[nodes].T
            keep = np.argpartition(-s, beam - 1, axis=1)[:, :beam] if beam < len(nodes) else np.broadcast_to(np.arange(len(nodes)), s.shape)
            best = np.take_along_axis(s, keep, 1)
            order = np.argsort(-best, axis=1, kind="stable")
            return nodes[np.take_along_axis(keep, order, 1)], np.take_along_axis(best, order, 1)
        at, place = at[:, :beam], np.zeros(len(self.vectors), np.int32)
        place[nodes] = np.arange(len(nodes))
        # Where a query has seen a node, the number under which it did.
        stamp, serial = np.full((n, len(self.vectors)), -1, np.int32), 0
        node, score, done = np.full((n, beam), -1, np.int32), np.full((n, beam), -np.inf, np.float32), np.ones((n, beam), bool)
        m = at.shape[1]
        row, column = np.nonzero(at >= 0)
        node[:, :m], done[:, :m] = at, at < 0
        score[row, column] = np.einsum("fd,fd->f", q[row], self.vectors[at[row, column]])
        stamp[row, at[row, column]] = 0
        self.scored += len(row)
        open_ = rows
        while len(open_):
            masked = np.where(done[open_], -np.inf, score[open_])
            best = np.argpartition(-masked, STEPS - 1, axis=1)[:, :STEPS] if STEPS < beam else np.broadcast_to(np.arange(beam), masked.shape)
            going = np.take_along_axis(masked, best, 1) > -np.inf
            live = going.any(1)
            open_, best, going = open_[live], best[live], going[live]
            if not len(open_):
                break
            of, column = np.nonzero(going)
            at_row, column = open_[of], best[of, column]
            done[at_row, column] = True
            near = links[place[node[at_row, column]]]
            near, at_row = near.ravel(), np.repeat(at_row, links.shape[1])
            new = near >= 0
            new[new] = stamp[at_row[new], near[new]] < 0
            near, at_row = near[new], at_row[new]
            mine = np.arange(serial, serial + len(near), dtype=np.int32)
            stamp[at_row, near] = mine
            once = stamp[at_row, near] == mine  # a node that several links lead to is taken once
            near, at_row, serial = near[once], at_row[once], serial + len(mine)
            self.scored += len(near)
            s = np.einsum("fd,fd->f", q[at_row], self.vectors[near])
            good = s > score.min(1)[at_row]
            near, at_row, s = near[good], at_row[good], s[good]
            if not len(near):
                continue
            many = np.bincount(at_row, minlength=n)
            order = np.argsort(at_row, kind="stable")
            column = np.arange(len(near)) - np.repeat(np.cumsum(many) - many, many)
            own = np.flatnonzero(many)
            line = (np.cumsum(many > 0) - 1)[at_row[order]]
            more_s, more_n = np.full((len(own), many.max()), -np.inf, np.float32), np.full((len(own), many.max()), -1, np.int32)
            more_s[line, column], more_n[line, column] = s[order], near[order]
            all_s, all_n = np.hstack([score[own], more_s]), np.hstack([node[own], more_n])
            all_d = np.hstack([done[own], more_n < 0])
            keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            score[own], node[own], done[own] = (np.take_along_axis(v, keep, 1) for v in (all_s, all_n, all_d))
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(node, order, 1), np.take_along_axis(score, order, 1)


def _pack(g: Graph) -> bytes:
    import io

    out = io.BytesIO()
    more = {} if g.originals is g.vectors else {"originals": g.originals}
    np.savez(out, vectors=g.vectors, ids=g.ids, ends=g.ends, followers=g.followers, until=g.until, reach=g.reach, **more, **{f"n{i}": n for i, (n, _) in enumerate(g.levels)}, **{f"l{i}": x for i, (_, x) in enumerate(g.levels)})
    return out.getvalue()


def _unpack(data: bytes) -> Graph:
    import io

    z = np.load(io.BytesIO(data))
    vectors = z["vectors"]
    g = Graph(vectors, z["originals"] if "originals" in z.files else vectors, z["ids"], z["ends"])
    g.followers, g.until, g.reach = z["followers"], z["until"], z["reach"]
    g.levels = [(z[f"n{i}"], z[f"l{i}"]) for i in range(sum(k[0] == "n" for k in z.files))]
    return g


def usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, dim) of the rows that take part, once each."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vector).cast("array<double>")
    rows = table.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    return rows.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def centres(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """``n`` centres of a sample of vectors (fewer, if it is smaller), by Lloyd's rounds from its first ones."""
    c = sample[:n].copy()
    for _ in range(rounds):
        own = _cell(sample, c)
        for i in np.unique(own):
            c[i] = sample[own == i].mean(0)
    return c


def _cell(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) / 2 - x @ c.T).argmin(1)


def _rows(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _celled(vectors: DataFrame, by_dim: dict[int, np.ndarray]) -> DataFrame:
    """With ``cell``, the nearest centre's number (0 where a length has no centres)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims):
                if int(dim) in by_dim:
                    own = np.flatnonzero(dims == dim)
                    cell[own] = _cell(_rows(batch.column("v").take(pa.array(own))), by_dim[int(dim)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return vectors.select("id", "v", "dim").mapInArrow(task, "id long, v array<double>, dim int, cell int")


def build(vectors: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """(dim, shard, path, centre, radius): a row a graph, written to the shared folder. Files are named by attempt, so what
    a lost attempt left behind is never read."""
    spark, schema = vectors.sparkSession, "dim int, shard long, path string, centre array<double>, radius double"
    counts = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a vector length
    if not counts:
        return spark.createDataFrame([], schema)
    by_dim = {}
    for dim, n in counts.items():
        if n > shard_rows:  # a row a shard's worth of vectors, CELLS at most
            drawn = vectors.where((F.col("dim") == dim) & (F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(n)) < SAMPLE)).orderBy(F.xxhash64("id")).limit(2 * SAMPLE)
            x = np.array([r["v"] for r in drawn.select("v").collect()], float).reshape(-1, dim)
            by_dim[dim] = centres(x / max(1.0, np.abs(x).max(initial=0) / 1e100), min(-(-n // shard_rows), CELLS))
    vectors, _ = shared.cut(_celled(vectors, by_dim), "cells")
    sizes = vectors.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("parts"))
    # By id and vector, as one id may have any number of vectors; rows equal in both meet, and count once.
    shard = F.col("cell").cast("long") + F.lit(CELLS) * F.pmod(F.xxhash64("id", "v"), F.col("parts"))
    dealt = vectors.join(F.broadcast(sizes), ["dim", "cell"]).select("dim", shard.alias("shard"), "id", "v")  # CELLS rows a length at most
    folder = shared.new_path(spark, "graphs")
    shared.make_dirs(spark, folder)

    def task(key: tuple, rows: pa.Table) -> pa.Table:
        import uuid

        x = _rows(rows["v"].combine_chunks())
        path = f"{folder}/{key[0].as_py()}-{key[1].as_py()}-{uuid.uuid4().hex}.npz"
        shared.write_bytes(path, _pack(Graph.build(rows["id"].to_numpy(), x)))
        centre = x.mean(0)
        with np.errstate(over="ignore"):
            radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
        return pa.table([[key[0]], [key[1]], [path], [centre.tolist()], [radius]], schema=pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("path", pa.string()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64())]))

    return shared.cut(dealt.groupBy("dim", "shard").applyInArrow(task, schema), "graphs")[0]


class Best:
    """The K best of each query so far."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.at, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.least = np.full(n, -np.inf)

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        at, ids, scores = (np.concatenate(c) for c in ((self.at, at), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        order, at = order[place < self.k], at[place < self.k]
        self.at, self.ids, self.scores = at, ids[order], scores[order]
        full = place[place < self.k] == self.k - 1
        self.least[at[full]] = self.scores[full]


def best_of(graphs: list[tuple], ids: np.ndarray, queries: np.ndarray, k: int, beam: int | None = None) -> Best:
    """The best of all graphs (path, centre, radius) for queries of one length."""
    best = Best(len(ids), k)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((queries**2).sum(1))
        bound = np.stack([queries @ c + norm * (r * (1 + 1e-9) + 1e-9 * np.sqrt(c @ c)) for _, c, r in graphs], 1)
    first = np.where(np.isnan(bound), np.inf, bound).argmax(1)
    for turn in (True, False):  # the most promising shard of each query, then the others
        for s, (path, _, _) in enumerate(graphs):
            own = np.flatnonzero(first == s if turn else (first != s) & ~(bound[:, s] < best.least))
            if len(own):
                at, found, score = _unpack(shared.read_bytes(path)).candidates(ids[own], queries[own], k, beam)
                best.add(own[at], found, score)
    return best


@lru_cache(maxsize=1)
def _listed(lists: tuple[str, ...]) -> dict[int, list[tuple]]:
    """By vector length the graphs (path, centre, radius) that the files of a written table list; a row for some thousands of
    vectors."""
    import io

    from pyarrow import parquet

    held: dict[int, list[tuple]] = {}
    for path in lists:
        for r in parquet.read_table(io.BytesIO(shared.read_bytes(unquote(path)))).to_pylist():
            held.setdefault(r["dim"], []).append((r["path"], np.array(r["centre"]), r["radius"]))
    return {dim: sorted(rows, key=lambda r: r[0]) for dim, rows in held.items()}


def search(graphs: DataFrame, queries: DataFrame, k: int = K, beam: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (id, v, dim) in the graphs that ``build`` wrote; ``beam``: nodes that a search of
    a graph keeps."""
    queries, _ = shared.cut(queries.dropDuplicates(["id", "v"]), "queries")
    lists = tuple(sorted(graphs.inputFiles()))  # of the written table; tasks read it themselves

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}

        def done(dim: int) -> pa.RecordBatch:
            ids, x = (np.concatenate(c) for c in zip(*parts.pop(dim), strict=True))
            best = best_of(_listed(lists)[dim], ids, x, k, beam)
            rank = np.arange(len(best.at)) - np.searchsorted(best.at, best.at) + 1
            return pa.RecordBatch.from_arrays([pa.array(ids[best.at]), pa.array(rank.astype(np.int32)), pa.array(best.ids), pa.array(best.scores)], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in map(int, np.unique(dims)):
                if dim in _listed(lists):
                    own = batch.filter(pa.array(dims == dim))
                    parts.setdefault(dim, []).append((own.column("id").to_numpy(), _rows(own.column("v"))))
                    if sum(len(i) for i, _ in parts[dim]) >= 4 * QUERIES:
                        yield done(dim)
        for dim in list(parts):
            yield done(dim)

    dealt = queries.repartition(max(1, -(-queries.count() // QUERIES)), "id")
    return dealt.select("id", "v", "dim").mapInArrow(task, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the nearest of every row whose vec_id is divisible by 20."""
    vectors, _ = shared.cut(usable(shared.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return search(build(vectors), vectors.where("id % 20 = 0"))
