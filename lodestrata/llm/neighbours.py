"""The k most similar vectors of every vector: a hierarchical navigable small-world graph per shard, shard results merged.

Shards are balanced groups of the cells of many centroids, so that similar vectors share a shard; a vector nearly as close to a cell
of another shard also visits that. The first level of cells is fitted on a bounded sample; where that makes too few, every cell is divided again,
by centroids fitted in tasks of their own. In a shard the graph is held as flat neighbour arrays, one per level, and all queries of a
block walk it in step, own ones from what they were linked by, visitors from their descent and the cells nearest to them. The walk compares vectors rotated to their leading components; what it finds is ranked by the exact cosine of the
whole vectors. Vectors of one direction are joined before there are shards and are one graph node; ids behind the k + 1 smallest of a direction
are settled by these without any graph. A shard with too many visitors is built in several tasks, each for a part of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.session import cut

#: Rows the first centroids and the rotation are fitted on, at most about.
SAMPLE = 12_000
#: Vectors a shard should hold, and the most that one task's graph holds; larger shards are cut into parts by hash.
SHARD, MOST = 20_000, 60_000
#: Visitors that one task serves, about.
VISITORS = 120_000
#: Cells of the first level, at most, components they are told apart by, parts of a cell on the second level, and sampled rows that
#: one such part is fitted on.
CELLS, CELL_COMPONENTS, SUB, SUB_ROWS = 2048, 128, 64, 4
#: Slots that keys held by more than one vector are noted in, as a power of two.
SLOTS = 22
#: Components that a vector's group key is made of, the grid they are put on, and how far the components of one direction may differ.
KEYED, GRID, SAME = 16, 4.0, 5e-7
#: A vector visits the shard of every cell, of its NEAR nearest ones, that is less than GAP farther in cosine than its own.
GAP, NEAR = 0.04, 8
#: Leading components the walk compares; neighbours a node keeps on its own account and in all; nodes per node of the level above.
COMPONENTS, LINKS, MOST_LINKS, LEVEL = 192, 12, 24, 16
#: Breadth of the walk and nodes opened at a step.
BREADTH, STEP = 20, 6
#: Cells a node's links are looked for in, cells a visitor enters by, and rows that a walk starts at.
LINK_CELLS, ENTRY_CELLS, ENTRIES = 16, 8, 16
_BLOCK = 512
_CACHED = 512


def pack(vector: np.ndarray) -> bytes:
    """A vector's bytes: half precision where that loses nothing, else single."""
    half = vector.astype(np.float16)
    return half.tobytes() if np.array_equal(half.astype(np.float32), vector) else vector.tobytes()


def unpack(data: list[bytes], width: int) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float16 if len(b) == 2 * width else np.float32).astype(np.float32) for b in data])


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-30).astype(np.float32)


def usable_rows(matrix: np.ndarray) -> np.ndarray:
    return np.isfinite(matrix).all(axis=1) & (np.abs(matrix) > 0).any(axis=1)


def direction_keys(units: np.ndarray) -> np.ndarray:
    """A 64-bit key of some coarsely rounded components: vectors of one direction share it, but for a few in a million."""
    width = units.shape[1]
    at = np.linspace(0, width - 1, min(KEYED, width)).astype(int)
    grid = np.floor(units[:, at] * (np.sqrt(width) * GRID) + 0.37).astype(np.int64).astype(np.uint64)
    key = np.zeros(len(units), np.uint64)
    for k in range(grid.shape[1]):
        key = (key ^ grid[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def directions(units: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
    """Row numbers of every group of vectors of one direction, each in the given order; the first row of a key stands for its group,
    and rows of the key that differ from it are grouped by their own first."""
    keys = direction_keys(units)[order]
    by = np.argsort(keys, kind="stable")
    edges = np.nonzero(np.diff(keys[by]))[0] + 1
    found = []
    for part in np.split(order[by], edges):
        if len(part) == 1:
            found.append(part)
            continue
        while len(part):
            same = np.abs(units[part] - units[part[0]]).max(axis=1) <= SAME if len(part) > 1 else np.ones(1, bool)
            found.append(part[same])
            part = part[~same]
    return found


def centroids(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    k = min(k, len(sample))
    centre = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        home = np.concatenate([(sample[i : i + 2000] @ centre.T).argmax(axis=1) for i in range(0, len(sample), 2000)])
        sums = np.zeros_like(centre)
        np.add.at(sums, home, sample)
        full = np.linalg.norm(sums, axis=1) > 1e-6
        centre[full] = unit(sums[full])
    return centre


def shards_of(cells: np.ndarray, weights: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every cell: cells are halved by weight along their leading direction until there are enough groups."""
    home = np.zeros(len(cells), np.int32)
    waiting = [(np.arange(len(cells)), shards)]
    made = 0
    while waiting:
        rows, parts = waiting.pop()
        if parts < 2 or len(rows) < 2:
            home[rows] = made
            made += 1
            continue
        centred = cells[rows] - np.average(cells[rows], axis=0, weights=weights[rows] + 1e-9)
        direction = np.linalg.svd(centred * np.sqrt(weights[rows] + 1e-9)[:, None], full_matrices=False)[2][0]
        rows = rows[np.argsort(centred @ direction, kind="stable")]
        share = np.cumsum(weights[rows] + 1e-9)
        cut = int(np.clip(np.searchsorted(share, share[-1] * (parts // 2) / parts), 1, len(rows) - 1))
        waiting += [(rows[cut:], parts - parts // 2), (rows[:cut], parts // 2)]
    return home


class SmallWorld:
    """A navigable small world in levels, over the rows of `points`; neighbour arrays hold row numbers, -1 where free."""

    def __init__(self, points: np.ndarray, seed: int = 11) -> None:
        self.points = np.ascontiguousarray(points, dtype=np.float32)
        rng = np.random.default_rng(seed)
        rows = np.arange(len(points))
        self.levels: list[np.ndarray] = []
        while True:
            self.levels.append(self._link(rows, len(self.levels)))
            if len(rows) <= 64:
                break
            rows = np.sort(rng.permutation(rows)[: max(1, len(rows) // LEVEL)])
        self.top = rows

    def _link(self, rows: np.ndarray, seed: int) -> np.ndarray:
        """The neighbour array of one level: diverse near neighbours, and links back."""
        n, graph = len(rows), np.full((len(self.points), MOST_LINKS), -1, np.int32)
        if n < 2:
            if not self.levels:
                self.cells, self.by_cell = self.points[rows], [rows]
                self.near, self.near_sims = np.full((n, ENTRIES), -1, np.int32), np.full((n, ENTRIES), -3.0, np.float32)
            return graph
        own = self.points[rows]
        cells = max(1, n // 200)
        centre = centroids(own[:: max(1, n // 4000)].copy(), cells, 3, seed) if cells > 1 else own[:1]
        home = (own @ centre.T).argmax(axis=1)
        near_cells = np.argsort(-(centre @ centre.T), axis=1)[:, :LINK_CELLS]
        by_cell = np.split(np.argsort(home, kind="stable"), np.cumsum(np.bincount(home, minlength=len(centre)))[:-1])
        src, dst, sim = [], [], []
        if not self.levels:
            self.cells, self.by_cell = centre, by_cell
            self.near, self.near_sims = np.full((n, ENTRIES), -1, np.int32), np.full((n, ENTRIES), -3.0, np.float32)
        for cell, mine in enumerate(by_cell):
            if not len(mine):
                continue
            others = np.concatenate([by_cell[c] for c in near_cells[cell]])
            k = min(2 * LINKS, len(others) - 1)
            for start in range(0, len(mine), 1024):
                some = mine[start : start + 1024]
                s = own[some] @ own[others].T
                s[some[:, None] == others[None, :]] = -2.0
                if k < 1:
                    continue
                at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                v = np.take_along_axis(s, at, 1)
                order = np.argsort(-v, axis=1, kind="stable")
                at, v = np.take_along_axis(at, order, 1), np.take_along_axis(v, order, 1)
                if not self.levels:
                    self.near[some, : min(k, ENTRIES)], self.near_sims[some, : min(k, ENTRIES)] = others[at[:, :ENTRIES]], v[:, :ENTRIES]
                keep = self._diverse(own[others[at]], v)
                i, j = np.nonzero(keep)
                src.append(some[i])
                dst.append(others[at[i, j]])
                sim.append(v[i, j])
        if not src:
            return graph
        a, b, s = np.concatenate(src), np.concatenate(dst), np.concatenate(sim)
        a, b, s, back = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s]), np.repeat([0, 1], len(a))
        first = np.unique(a.astype(np.int64) * n + b, return_index=True)[1]
        a, b, s, back = a[first], b[first], s[first], back[first]
        order = np.lexsort((-s, back, a))
        a, b = a[order], b[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        fit = rank < MOST_LINKS
        graph[rows[a[fit]], rank[fit]] = rows[b[fit]]
        return graph

    @staticmethod
    def _diverse(near: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Which of the sorted candidates to link: those nearer to the node than to any candidate linked before, LINKS at most."""
        between = np.matmul(near, near.transpose(0, 2, 1))
        keep = np.zeros(sims.shape, bool)
        for j in range(sims.shape[1]):
            shaded = ((between[:, j, :] > sims[:, j, None]) & keep).any(axis=1)
            keep[:, j] = ~shaded & (keep.sum(axis=1) < LINKS)
        keep[:, :4] = True  # the very nearest stay, lest tight groups fall apart
        return keep

    def _walk(self, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, breadth: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, similarities), best first, of a best-first walk from `entries` (one row of entries a query; known: their similarities)."""
        b = len(queries)
        n = len(self.points)
        seen = np.zeros(b * n, bool)
        ids = np.full((b, max(breadth, entries.shape[1])), -1, np.int32)
        sims = np.full(ids.shape, -3.0, np.float32)
        ids[:, : entries.shape[1]] = entries
        sims[:, : entries.shape[1]] = np.where(entries >= 0, np.einsum("ikj,ij->ik", self.points[entries], queries), -3.0) if known is None else known
        seen[(np.arange(b)[:, None] * n + entries)[entries >= 0]] = True
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        open_ = ids >= 0
        live = np.arange(b)
        while True:
            waiting = open_[live]
            some = waiting.any(axis=1)
            live, waiting = live[some], waiting[some]
            if not len(live):
                return ids, sims
            r, c = np.nonzero(waiting & (np.cumsum(waiting, axis=1) <= STEP))
            open_[live[r], c] = False
            found = graph[ids[live[r], c]]
            there = found >= 0
            local, node = np.repeat(r, there.sum(axis=1)), found[there]
            place = live[local] * n + node
            fresh = ~seen[place]
            local, node, place = local[fresh], node[fresh], place[fresh]
            if not len(node):
                continue
            seen[place] = True
            s, asked = np.empty(len(node), np.float32), live[local]
            for at in range(0, len(node), _CACHED):  # few enough rows at a time to stay in the processor's cache
                some = slice(at, at + _CACHED)
                np.einsum("ij,ij->i", self.points[node[some]], queries[asked[some]], out=s[some])
            count = np.bincount(local, minlength=len(live))
            place = np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count)
            width = int(count.max())
            new_ids, new_sims = np.full((len(live), width), -1, np.int32), np.full((len(live), width), -3.0, np.float32)
            new_ids[local, place], new_sims[local, place] = node, s
            all_ids, all_sims = np.concatenate([ids[live], new_ids], 1), np.concatenate([sims[live], new_sims], 1)
            all_open = np.concatenate([open_[live], new_ids >= 0], 1)
            order = np.argsort(-all_sims, axis=1)[:, : ids.shape[1]]
            best, worth, new = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1), np.take_along_axis(all_open, order, 1)
            again = (best[:, 1:] == best[:, :-1]) & (best[:, 1:] >= 0)  # a node reached twice in one step lies beside itself
            best[:, 1:][again], worth[:, 1:][again], new[:, 1:][again] = -1, -3.0, False
            ids[live], sims[live], open_[live] = best, worth, new

    def _in_cells(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, similarities) of the best rows of the cells nearest to each query; -1 where there are fewer."""
        ids, sims = np.full((len(queries), ENTRIES), -1, np.int32), np.full((len(queries), ENTRIES), -3.0, np.float32)
        n = min(ENTRY_CELLS, len(self.cells))
        cells = np.argpartition(-(queries @ self.cells.T), n - 1, axis=1)[:, :n]
        which, cell = np.repeat(np.arange(len(queries)), n), cells.ravel()
        order = np.argsort(cell, kind="stable")
        for some in np.split(order, np.nonzero(np.diff(cell[order]))[0] + 1):
            if not len(some) or not len(rows := self.by_cell[cell[some[0]]]):
                continue
            asked = which[some]
            s = queries[asked] @ self.points[rows].T
            k = min(ENTRIES, s.shape[1])
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            all_ids = np.concatenate([ids[asked], rows[at].astype(np.int32)], 1)
            all_sims = np.concatenate([sims[asked], np.take_along_axis(s, at, 1)], 1)
            best = np.argpartition(-all_sims, ENTRIES - 1, axis=1)[:, :ENTRIES]
            ids[asked], sims[asked] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_sims, best, 1)
        return ids, sims

    def search(self, queries: np.ndarray, breadth: int, start: np.ndarray | None = None) -> np.ndarray:
        """Rows near each query, best first. A query that is a row starts at itself and what it was compared with when it was linked; any
        other descends from the top level, and starts at what it comes to and at the best rows of the cells nearest to it."""
        if start is not None:
            known = np.concatenate([np.einsum("ij,ij->i", queries, queries)[:, None], self.near_sims[start]], 1)
            return self._walk(self.levels[0], queries, np.concatenate([start[:, None], self.near[start]], 1), breadth, known)[0]
        k = min(4, len(self.top))
        sims = queries @ self.points[self.top].T
        at = np.argsort(-sims, axis=1)[:, :k]
        entries, sims = self.top[at].astype(np.int32), np.take_along_axis(sims, at, 1)
        for graph in self.levels[-2:0:-1]:
            entries, sims = (x[:, :4] for x in self._walk(graph, queries, entries, 8, sims))
        ids, known = self._in_cells(queries)
        twice = (entries[:, :, None] == ids[:, None, :]).any(axis=2)
        entries, sims = np.where(twice, -1, entries), np.where(twice, np.float32(-3.0), sims)
        return self._walk(self.levels[0], queries, np.concatenate([ids, entries], 1), breadth, np.concatenate([known, sims], 1))[0]


def _exact(found: np.ndarray, queries: np.ndarray, vectors: np.ndarray, whole: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The `keep` best of the rows found, by the cosine of the whole vectors, rounded to 6 decimals; -3 where there are fewer."""
    rows = max(1, _CACHED // found.shape[1])
    s = np.concatenate([np.matmul(whole[found[i : i + rows]], queries[i : i + rows, :, None])[:, :, 0] for i in range(0, len(found), rows)])
    s[found < 0] = -3.0
    at = np.argsort(-s, axis=1)[:, :keep]
    found, s = np.take_along_axis(found, at, 1), np.take_along_axis(s, at, 1)
    wide, q = vectors[found].astype(np.float64), queries.astype(np.float64)
    cosine = np.matmul(wide, q[:, :, None])[:, :, 0] / (np.linalg.norm(wide, axis=2) * np.linalg.norm(q, axis=1)[:, None])
    return found, np.where(s > -3.0, np.round(cosine, 6), -3.0)


def _pairs(qid: int, groups: list[list[int]], cosines: list[float], k: int, least: float) -> list[tuple[int, int, float]]:
    near = sorted((-c, i) for g, c in zip(groups, cosines, strict=True) if c >= least for i in g if i != qid)
    return [(qid, i, -c) for c, i in near[:k]]


class Cells:
    """Centroids in one level, or in two: `parts` holds the centroids that divide a cell. Leaves are numbered through."""

    def __init__(self, centre: np.ndarray, parts: dict[int, np.ndarray] | None = None) -> None:
        self.centre = centre
        self.leaves = [parts[c] if parts and c in parts else centre[c : c + 1] for c in range(len(centre))]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in self.leaves])])
        self.flat = np.concatenate(self.leaves)
        self.one_level = len(self.flat) == len(centre)

    def near(self, short: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(leaves, similarities) of up to `most` near leaves of every row; leaf -1 where there are fewer."""
        sims = short @ self.centre.T
        n = min(most, sims.shape[1])
        order = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        near = np.take_along_axis(sims, order, 1)
        if self.one_level:
            return order, near
        rows, leaf, sim = [], [], []
        for c in np.unique(order):
            r = np.nonzero((order == c).any(axis=1))[0]
            s = short[r] @ self.leaves[c].T
            k = min(n, s.shape[1])
            at = np.argpartition(-s, k - 1, axis=1)[:, :k]
            rows.append(np.repeat(r, k)), leaf.append((self.first[c] + at).ravel()), sim.append(np.take_along_axis(s, at, 1).ravel())
        rows, leaf, sim = np.concatenate(rows), np.concatenate(leaf), np.concatenate(sim)
        by = np.lexsort((-sim, rows))
        rows, leaf, sim = rows[by], leaf[by], sim[by]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < n
        out, worth = np.full((len(short), n), -1), np.full((len(short), n), -3.0, np.float32)
        out[rows[keep], rank[keep]], worth[rows[keep], rank[keep]] = leaf[keep], sim[keep]
        return out, worth


def search_shard(own: pd.DataFrame, visitors: pd.DataFrame, width: int, rotation: np.ndarray, k: int, least: float) -> pd.DataFrame:
    """a, b, cosine: per id up to k others of at least `least`. own, visitors: ids (list), v (bytes); own also asks, which tells
    the rows that are queries themselves."""
    raw = unpack(list(own.v), width)
    whole = unit(raw)
    ids, asks = own.ids.tolist(), own.asks.to_numpy(bool)
    order = np.argsort(np.array([min(x) for x in ids], np.int64), kind="stable")
    groups = directions(whole, order)
    members = [sorted({int(i) for r in g for i in ids[r]})[: k + 1] for g in groups]
    first_rows = np.array([g[0] for g in groups])
    raw, whole, asks = raw[first_rows], whole[first_rows], np.array([asks[g].any() for g in groups])
    short = whole @ rotation
    world = SmallWorld(short)
    alone = np.array([len(m) == 1 for m in members])
    first = np.array([m[0] for m in members], np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settle(found: np.ndarray, queries: np.ndarray, ids: list[list[int]], skip: np.ndarray | None) -> None:
        found, cosine = _exact(found, queries, raw, whole, k + 3 + (skip is not None))
        if skip is not None:
            cosine[found == skip[:, None]] = -3.0
        good = cosine >= least
        plain = np.array([len(i) == 1 for i in ids]) & (alone[found] | ~good).all(axis=1)
        key = np.where(good, first[found], np.iinfo(np.int64).max)
        order = np.lexsort((key, -cosine), axis=1)[:, :k]
        b, c, g = (np.take_along_axis(x, order, 1) for x in (first[found], cosine, good))
        g &= plain[:, None]
        i, j = np.nonzero(g)
        out.append((np.array([x[0] for x in ids], np.int64)[i], b[i, j], c[i, j]))
        rest: list[tuple[int, int, float]] = []
        for n in np.nonzero(~plain)[0]:
            near = [members[x] for x in found[n]]
            cosines = cosine[n].tolist()
            if skip is not None:
                near, cosines = [*near, ids[n]], [*cosines, 1.0]
            for qid in ids[n]:
                rest += _pairs(qid, near, cosines, k, least)
        if rest:
            out.append(tuple(np.array(x) for x in zip(*rest, strict=True)))

    asking = np.nonzero(asks)[0].astype(np.int32)
    for at in range(0, len(asking), _BLOCK):
        rows = asking[at : at + _BLOCK]
        settle(world.search(short[rows], BREADTH, rows), raw[rows], [members[r] for r in rows], rows)
    for at in range(0, len(visitors), _BLOCK):
        some = visitors.iloc[at : at + _BLOCK]
        queries = unpack(list(some.v), width)
        settle(world.search(unit(queries) @ rotation, BREADTH), queries, [sorted(int(i) for i in x)[: k + 1] for x in some.ids], None)
    if not out:
        return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "cosine": np.empty(0)})
    return pd.DataFrame({"a": np.concatenate([x[0] for x in out]).astype(np.int64), "b": np.concatenate([x[1] for x in out]).astype(np.int64), "cosine": np.concatenate([x[2] for x in out]).astype(float)})


def _chunks(batches, width: int):
    """(ids, vectors) of the usable rows of Arrow batches of id and v, all of them `width` wide, some thousands at a time."""
    for batch in batches:
        ids, flat = batch.column("id").to_numpy(zero_copy_only=False), batch.column("v").flatten().to_numpy(zero_copy_only=False)
        matrix = flat.astype(np.float32, copy=False).reshape(-1, width)
        for start in range(0, len(ids), 4000):
            some = slice(start, start + 4000)
            good = usable_rows(matrix[some])
            if good.any():
                yield ids[some][good], matrix[some][good]


def _batch(schema: str, *columns) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def one_direction(vectors: DataFrame, width: int, k: int, flags: np.ndarray, slot: int) -> DataFrame:
    """ids, v, rest: the vectors of flagged keys (see _flags), one row a direction with its k + 1 smallest ids. Directions with more ids have
    rows without v besides: further ids (rest), whose k nearest are the k smallest (ids).

    Rows of one direction in a batch go on as one, so that the rows of a key are no more than the batches, however many ids it has."""
    shared = vectors.sparkSession.sparkContext.broadcast(np.packbits(flags))

    def flagged(batches):
        bits = np.unpackbits(shared.value).view(bool)
        for ids, matrix in _chunks(batches, width):
            units = unit(matrix)
            keys = direction_keys(units)
            mine = np.nonzero(bits[_slots(keys, slot)])[0]
            if len(mine):
                groups = directions(units[mine], np.argsort(ids[mine], kind="stable"))
                first = mine[[g[0] for g in groups]]
                held = [ids[mine[g]] for g in groups]
                yield _batch("h long, first long, ids array<long>, v binary", keys[first], ids[first], held, [pack(x) for x in matrix[first]])

    def merged(batches):
        waiting = None
        for pdf in _frames(batches):
            if waiting is not None:
                pdf = pd.concat([waiting, pdf], ignore_index=True)
            last = (pdf.h == pdf.h.iloc[-1]).to_numpy()
            waiting, pdf = pdf[last], pdf[~last]
            if len(pdf):
                yield from settled(pdf)
        if waiting is not None:
            yield from settled(waiting)

    def settled(pdf: pd.DataFrame):
        held, data = pdf.ids.tolist(), pdf.v.tolist()
        ids, v, rest = [], [], []
        for group in directions(unit(unpack(data, width)), np.arange(len(pdf))):
            own = held[group[0]] if len(group) == 1 else np.concatenate([held[i] for i in group])
            own = np.sort(own)
            ids.append(own[: k + 1]), v.append(data[group[0]]), rest.append(None)
            for at in range(k + 1, len(own), 1000):
                ids.append(own[:k]), v.append(None), rest.append(own[at : at + 1000])
        yield _batch("ids array<long>, v binary, rest array<long>", ids, v, rest)

    rows = vectors.mapInArrow(flagged, "h long, first long, ids array<long>, v binary")
    return rows.repartition("h").sortWithinPartitions("h", "first").mapInArrow(merged, "ids array<long>, v binary, rest array<long>")


def _frames(batches):
    for batch in batches:
        if batch.num_rows:
            yield batch.to_pandas()


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def _flags(groups: DataFrame, bits: int) -> np.ndarray:
    """Which of 2^bits slots hold a key of more than one row: to the driver comes at most one number a slot."""
    slot = F.shiftrightunsigned("h", 64 - bits).cast("int")
    flags = np.zeros(1 << bits, bool)
    flags[groups.filter("n > 1").select(slot.alias("slot")).distinct().toPandas().slot.to_numpy(np.int64)] = True
    return flags


def nearest(vectors: DataFrame, width: int, k: int = 10, least: float = -1.0) -> DataFrame:
    """a, b, cosine: for every id its k most similar others of cosine at least `least` (rounded to 6 decimals, ties to the smaller id).

    vectors: id, v (array of float). Null, all-zero, non-finite and otherwise wide vectors are left out; equal vectors, and those of one
    direction, are each other's nearest; no usable vector gives no rows. Approximate: see README for the recall measured.
    """
    found, same = _nearest(vectors, width, k, least)
    return found.unionByName(same)


def _nearest(vectors: DataFrame, width: int, k: int, least: float) -> tuple[DataFrame, DataFrame]:
    """The rows of `nearest`, those of ids that lie behind the k + 1 smallest of their direction apart: no others hold such an id."""
    usable = vectors.filter(F.col("id").isNotNull() & (F.size("v") == width)).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v"))
    spark = vectors.sparkSession

    def keyed(batches):
        for _, matrix in _chunks(batches, width):
            yield _batch("h long", direction_keys(unit(matrix)))

    groups = cut(usable.mapInArrow(keyed, "h long").groupBy("h").agg(F.count("*").alias("n")))
    rows, total = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sample = _sample(usable, rows, width)
    if not len(sample):
        sample = np.eye(1, width, dtype=np.float32)
    sample = unit(sample)
    sample = sample[np.sort(np.unique(direction_keys(sample), return_index=True)[1])]
    rotation = np.ascontiguousarray(np.linalg.eigh(sample.T @ sample)[1][:, ::-1][:, :COMPONENTS], dtype=np.float32)
    short = sample @ rotation[:, :CELL_COMPONENTS]
    cells = Cells(centroids(short, min(CELLS, max(1, len(short) // 4)), rounds=4))
    if total > SHARD * len(cells.centre):
        cells, weights = _divided(usable, total, rows, width, rotation, cells)
    else:
        weights = np.bincount((short @ cells.flat.T).argmax(axis=1), minlength=len(cells.flat)) * (total / len(sample))
    home = shards_of(cells.flat, weights, max(1, round(total / SHARD)))
    held = np.bincount(home, weights=weights)
    cuts = np.maximum(1, np.ceil(held / MOST)).astype(int)  # parts of every shard that cells could not divide
    gap = GAP
    goes, _ = _visits(cells, home, len(cuts), short, gap)
    guests = goes.sum(axis=0) * (total / len(sample)) - held
    lots = np.maximum(1, np.ceil(guests / VISITORS)).astype(int)  # tasks that share a shard's visitors
    slot, flags = SLOTS, _flags(groups, SLOTS)
    shared = spark.sparkContext.broadcast((cells, home, rotation, cuts, lots, np.packbits(flags)))
    schema = "ids array<long>, v binary, shard int, part int, lot int, visits boolean, asks boolean"

    def assign(ids: pa.Array, first: np.ndarray, data: list[bytes], units: np.ndarray) -> pa.RecordBatch:
        cells, home, rotation, cuts, lots, _ = shared.value
        goes, own = _visits(cells, home, len(cuts), units @ rotation[:, :CELL_COMPONENTS], gap)
        row, shard = np.nonzero(goes)
        # every part of a cut shard is asked, one of them is home, and there the row goes to every lot of visitors
        spare = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
        parts = cuts[shard]
        part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        row, shard = np.repeat(row, parts), np.repeat(shard, parts)
        at_home = (shard == own[row]) & (part == spare[row].astype(np.int64) % cuts[shard])
        copies = np.where(at_home, lots[shard], 1)
        at = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        row, shard, part, at_home = (np.repeat(x, copies) for x in (row, shard, part, at_home))
        lot = np.where(at_home, at, (spare[row].astype(np.int64) >> 8) % lots[shard])
        return _batch(schema, ids.take(pa.array(row)), pa.array(data, pa.binary()).take(pa.array(row)), shard.astype(np.int32), part.astype(np.int32), lot.astype(np.int32), ~at_home, at_home & (at == 0))

    def lone(batches):
        bits = np.unpackbits(shared.value[5]).view(bool)
        for ids, matrix in _chunks(batches, width):
            units = unit(matrix)
            mine = ~bits[_slots(direction_keys(units), slot)]
            if mine.any():
                own = pa.ListArray.from_arrays(pa.array(np.arange(mine.sum() + 1, dtype=np.int32)), pa.array(ids[mine], pa.int64()))
                yield assign(own, ids[mine], [pack(x) for x in matrix[mine]], units[mine])

    def grouped(batches):
        for pdf in _frames(batches):
            for start in range(0, len(pdf), 4000):
                some = pdf.iloc[start : start + 4000]
                ids, data = some.ids.tolist(), some.v.tolist()
                yield assign(pa.array(ids, pa.list_(pa.int64())), np.array([i[0] for i in ids], np.int64), data, unit(unpack(data, width)))

    placed = usable.mapInArrow(lone, schema)
    same = spark.createDataFrame([], "a long, b long, cosine double")
    if flags.any():
        joined = cut(one_direction(usable, width, k, flags, slot))
        placed = placed.unionByName(joined.filter("v is not null").select("ids", "v").mapInArrow(grouped, schema))
        same = joined.filter("v is null").select(F.explode("rest").alias("a"), "ids").select("a", F.explode("ids").alias("b"), F.lit(1.0).alias("cosine"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[~pdf.visits]
        if own.empty:
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "cosine": np.empty(0)})
        return search_shard(own, pdf[pdf.visits], width, shared.value[2], k, least)

    found = placed.groupBy("shard", "part", "lot").applyInPandas(find, "a long, b long, cosine double")
    return _best(found, k), same.filter(F.col("cosine") >= least)


def _visits(cells: Cells, home: np.ndarray, shards: int, short: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """(whether each row goes to each shard, each row's own shard)."""
    order, near = cells.near(short, NEAR)
    own = home[order[np.arange(len(order)), near.argmax(axis=1)]]
    goes = np.zeros((len(short), shards), bool)
    row, column = np.nonzero((near >= near.max(axis=1)[:, None] - gap) & (order >= 0))
    goes[row, home[order[row, column]]] = True
    return goes, own


def _divided(usable: DataFrame, total: int, held: int, width: int, rotation: np.ndarray, cells: Cells) -> tuple[Cells, np.ndarray]:
    """(cells in two levels, vectors in each leaf): every cell is divided by centroids fitted in its own task, on a sample of about
    SUB_ROWS rows a part of the `held` there are; to the driver come at most CELLS * SUB centroids."""
    parts = int(np.clip(np.ceil(2 * total / SHARD / len(cells.centre)), 2, SUB))
    share = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, SUB_ROWS * parts * len(cells.centre) / held)) + 1)
    turn = rotation[:, :CELL_COMPONENTS]

    def placed(batches):
        for pdf in batches:
            for start in range(0, len(pdf), 4000):
                matrix = np.stack([np.asarray(v, np.float32) for v in pdf.v.iloc[start : start + 4000]])
                matrix = matrix[usable_rows(matrix)]
                if len(matrix):
                    short = unit(matrix) @ turn
                    yield pd.DataFrame({"cell": (short @ cells.centre.T).argmax(axis=1).astype(np.int32), "v": [x.astype(np.float16).tobytes() for x in short]})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.stack([np.frombuffer(x, np.float16).astype(np.float32) for x in pdf.v])
        centre = centroids(own, max(1, min(parts, len(own) // 2)), rounds=4)
        counts = np.bincount((own @ centre.T).argmax(axis=1), minlength=len(centre))
        return pd.DataFrame({"cell": pdf.cell.iloc[0], "v": [x.astype(np.float16).tobytes() for x in centre], "n": counts})

    rows = usable.filter(share).mapInPandas(placed, "cell int, v binary").groupBy("cell").applyInPandas(fit, "cell int, v binary, n long").toPandas()
    found = {int(c): np.stack([np.frombuffer(x, np.float16).astype(np.float32) for x in some.v]) for c, some in rows.groupby("cell")}
    counts = {int(c): some.n.to_numpy() for c, some in rows.groupby("cell")}
    weights = np.concatenate([counts.get(c, np.zeros(1)) for c in range(len(cells.centre))]).astype(float)
    return Cells(cells.centre, found), weights * (total / max(1.0, weights.sum()))


def _sample(usable: DataFrame, total: int, width: int) -> np.ndarray:
    """About SAMPLE usable vectors, chosen by hash of their id."""
    share = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, SAMPLE / max(1, total))))

    def packed(batches):
        for pdf in batches:
            yield pd.DataFrame({"v": [pack(np.asarray(v, np.float32)) for v in pdf.v]})

    rows = usable.filter(share).mapInPandas(packed, "v binary").limit(2 * SAMPLE).toPandas()
    sample = unpack(list(rows.v), width) if len(rows) else np.empty((0, width), np.float32)
    return sample[usable_rows(sample)]


def _best(found: DataFrame, k: int) -> DataFrame:
    """Shard results merged: the k best per id."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    return found.distinct().withColumn("r", rank).filter(F.col("r") <= k).drop("r")


def similar_pairs(vectors: DataFrame, width: int, k: int = 10, least: float = 0.55) -> DataFrame:
    """id_a < id_b, one of which is among the other's k most similar, with cosine at least `least`."""
    found, same = _nearest(vectors, width, k, least)
    pair = [F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")]
    return found.select(*pair).distinct().unionByName(same.select(*pair))
