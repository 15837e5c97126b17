"""Near-duplicate embeddings: regions around drawn vectors, which overlap at their borders, compared
whole or, if large, searched by navigable small-world graphs, one hierarchy per shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .graph import components
from .hashing import mix
from .scratch import discard, settle

#: Vectors in a region, about; regions are never fewer than MIN_REGIONS (if there are so many vectors)
#: and about MAX_REGIONS at most.
REGION, MIN_REGIONS, MAX_REGIONS = 2_000, 24, 8_192
#: Vectors drawn for each region to lay it by, and the floats that all of them have at most.
DRAWS, DRAWN_FLOATS = 8, 16_000_000
#: Vectors of a region that one task compares; a larger region is dealt to several.
WHOLE = 20_000
#: Vectors in a shard, about. A region with more vectors than that outside its core has shards that are searched by their graphs.
SHARD = 100_000
#: Vectors in a block of queries, about; blocks are never fewer than MIN_BLOCKS.
BLOCK, MIN_BLOCKS = 50_000, 3
#: Links of a node and beam while building; in the lowest layer a node keeps twice as many.
LINKS, BUILD_BEAM = 12, 32
#: First beam of a search; it doubles until the audits pass.
BEAM = 24
#: Cells of a table of cosines that is compared at once.
CELLS = 4_000_000
#: Queries of a block that an audit compares with the whole shard at least, and the share of
#: a linked query's true links that a search must find on average.
AUDIT, RECALL = 256, 0.99
#: An audit goes on until it has so many linked queries, or has compared DRAWN queries.
ENOUGH, DRAWN = 64, 4096
#: First margin at the border of two regions, in standard deviations of what a link of the least cosine
#: spans across it if vectors lie evenly in SPANS dimensions; it grows by WIDER until the audit passes.
#: From the square root of SPANS on the margin holds any link.
SPREAD, SPANS, WIDER = 2.5, 64, 1.5
#: Cells of a table of cosines that is made at once to look for the few high ones.
TILE = 1_000_000
#: Links that wait until they are reduced to a forest.
WAITING = 1_000_000
#: Bytes in place of an embedding that links with nothing; no number of floats has so many.
BLANK = 9
#: What a pair (row, region) is packed with.
_PACK = np.int64(2**32)


class Layer:
    """A graph over some vectors: row i of ``links`` holds the neighbours of node i, -1: none."""

    def __init__(self, vectors: np.ndarray, degree: int):
        self.vectors, self.degree = vectors, degree
        self.links = np.full((len(vectors), degree), -1, np.int32)

    def search(self, queries: np.ndarray, entry: np.ndarray, beam: int, known: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of the ``beam`` best nodes met by each query, best first, -1: none.

        All queries walk in step: each expands its best node not yet expanded, until its
        beam holds no such node. ``known``: only so many first nodes exist.
        """
        n = len(self.vectors) if known is None else known
        q = np.arange(len(queries))
        nodes = np.full((len(queries), beam), -1, np.int32)
        near = np.full((len(queries), beam), -2.0, np.float32)
        open_ = np.zeros((len(queries), beam), bool)
        seen = np.zeros((len(queries), n), bool)
        nodes[:, 0], open_[:, 0] = entry, True
        near[:, 0] = np.einsum("qd,qd->q", queries, self.vectors[entry])
        seen[q, entry] = True
        live = q
        while len(live):
            at = np.where(open_[live], near[live], -3).argmax(1)
            open_[live, at] = False
            around = self.links[nodes[live, at]]
            fresh = (around >= 0) & (around < n)
            fresh &= ~seen[live[:, None], np.where(fresh, around, 0)]
            rows, cols = np.nonzero(fresh)
            got = around[rows, cols]
            seen[live[rows], got] = True
            cosine = np.full(around.shape, -2.0, np.float32)
            cosine[rows, cols] = np.einsum("kd,kd->k", queries[live[rows]], self.vectors[got])
            all_near = np.concatenate([near[live], cosine], 1)
            keep = np.argpartition(-all_near, beam - 1, 1)[:, :beam]
            near[live] = np.take_along_axis(all_near, keep, 1)
            nodes[live] = np.take_along_axis(np.concatenate([nodes[live], around], 1), keep, 1)
            still = np.take_along_axis(np.concatenate([open_[live], fresh], 1), keep, 1)
            open_[live] = still & (near[live] > -2)
            live = live[open_[live].any(1)]
        order = np.argsort(-near, 1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        return np.where(near > -2, np.take_along_axis(nodes, order, 1), -1), near

    def _diverse(self, base: np.ndarray, nodes: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates (best first) those that are nearer to the base than to any
        candidate taken before, ``most`` at most, filled up with the best others."""
        valid = nodes >= 0
        vectors = self.vectors[np.where(valid, nodes, 0)]
        mutual = vectors @ vectors.transpose(0, 2, 1)
        taken = np.zeros(nodes.shape, bool)
        for c in range(nodes.shape[1]):
            rival = np.where(taken, mutual[:, c, :], -2).max(1)
            taken[:, c] = valid[:, c] & (near[:, c] > rival) & (taken.sum(1) < most)
        order = np.argsort(~taken * 2 + ~valid, 1, kind="stable")[:, :most]
        chosen = np.take_along_axis(np.where(valid, nodes, -1), order, 1)
        return np.pad(chosen, ((0, 0), (0, most - chosen.shape[1])), constant_values=-1)

    def build(self, entries) -> None:
        """Insert the nodes in order, in runs that double up to 512: each is linked with the
        best nodes before its run that a search finds, and with those of its run."""
        n, at = len(self.vectors), 1
        while at < n:
            run = min(at, 512, n - at)
            new = np.arange(at, at + run)
            queries = self.vectors[new]
            nodes, near = self.search(queries, entries(queries, at), min(BUILD_BEAM, max(at, 1)), known=at)
            own = queries @ queries.T
            np.fill_diagonal(own, -2)
            some = min(run - 1, BUILD_BEAM)
            if some:
                best = np.argsort(-own, 1)[:, :some]
                nodes = np.concatenate([nodes, new[best].astype(np.int32)], 1)
                near = np.concatenate([near, np.take_along_axis(own, best, 1)], 1)
                order = np.argsort(-near, 1, kind="stable")
                nodes, near = np.take_along_axis(nodes, order, 1), np.take_along_axis(near, order, 1)
            chosen = self._diverse(queries, nodes, near, min(LINKS, self.degree))
            self.links[new, : chosen.shape[1]] = chosen
            self._link_back(new, chosen)
            at += run

    def _link_back(self, new: np.ndarray, chosen: np.ndarray) -> None:
        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.lexsort((source, target))
        source, target = source[order], target[order]
        hit, first, count = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(hit), 256):
            part = slice(lo, lo + 256)
            width = int(count[part].max())
            place = first[part, None] + np.arange(width)
            extra = np.where(np.arange(width) < count[part, None], source[np.minimum(place, len(source) - 1)], -1)
            nodes = np.concatenate([self.links[hit[part]], extra], 1)
            ordered = np.sort(nodes, 1)  # a link may be there already
            nodes = np.where(np.concatenate([np.zeros((len(nodes), 1), bool), ordered[:, 1:] == ordered[:, :-1]], 1), -1, ordered)
            near = np.einsum("bd,bcd->bc", self.vectors[hit[part]], self.vectors[np.maximum(nodes, 0)])
            near = np.where(nodes >= 0, near, -2)
            best = np.argsort(-near, 1, kind="stable")[:, : 2 * self.degree]
            nodes, near = np.take_along_axis(nodes, best, 1), np.take_along_axis(near, best, 1)
            self.links[hit[part]] = self._diverse(self.vectors[hit[part]], nodes, near, self.degree)


class Hierarchy:
    """Layers over unit vectors; each holds a drawn share 1 / LINKS of the one below, and its
    nodes come first there. Searches go down from the top, where one node is the start."""

    def __init__(self, vectors: np.ndarray, level: np.ndarray, links: list[bytes] | None = None):
        """A graph over ``vectors``, sorted by falling ``level``: built, or of stored links."""
        self.vectors, self.level = np.ascontiguousarray(vectors, np.float32), level
        self.layers: list[Layer] = []
        stored = None if links is None else [np.frombuffer(b, np.int32) for b in links]
        for k in range(int(level.max()), -1, -1):
            size = int((level >= k).sum())
            layer = Layer(self.vectors[:size], 2 * LINKS if k == 0 else LINKS)
            if stored is None:
                layer.build(lambda queries, known: np.minimum(self.entries(queries, self.layers), known - 1))
            else:
                lo = 0 if k == 0 else (k + 1) * LINKS
                layer.links = np.array([row[lo : lo + layer.degree] for row in stored[:size]])
            self.layers.append(layer)
        source, column = np.nonzero(self.layers[-1].links >= 0)
        target = self.layers[-1].links[source, column]
        order = np.argsort(target, kind="stable")
        self.back, self.back_from = source[order], np.searchsorted(target[order], np.arange(len(self.vectors) + 1))

    def _around(self, nodes: np.ndarray) -> np.ndarray:
        """Nodes of the lowest layer that have a link from or to one of ``nodes``."""
        out = self.layers[-1].links[nodes].ravel()
        first, count = self.back_from[nodes], self.back_from[nodes + 1] - self.back_from[nodes]
        place = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
        return np.unique(np.concatenate([out[out >= 0], self.back[place]]))

    def stored_links(self) -> list[bytes]:
        """The links of each node, those of the lowest layer first."""
        parts = self.layers[::-1]
        return [b"".join(layer.links[i].tobytes() for layer in parts[: self.level[i] + 1]) for i in range(len(self.vectors))]

    @staticmethod
    def entries(queries: np.ndarray, layers: list[Layer]) -> np.ndarray:
        """The node where each query enters below ``layers``."""
        at = np.zeros(len(queries), np.int64)
        for layer in layers:
            at = layer.search(queries, at, 1)[0][:, 0]
        return at

    def search(self, queries: np.ndarray, own: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """As Layer.search; a query that is node ``own`` itself (-1: none) starts there."""
        at, far = own.copy(), own < 0
        at[far] = self.entries(queries[far], self.layers[:-1])
        return self.layers[-1].search(queries, at, min(beam, len(self.vectors)))

    def flood(self, centre: np.ndarray, start: np.ndarray, floor: float) -> np.ndarray:
        """All nodes with a cosine of ``floor`` or more with ``centre`` that links of such
        nodes, followed both ways, reach from ``start``."""
        seen = np.zeros(len(self.vectors), bool)
        seen[start] = True
        inside, edge = [], start
        while len(edge):
            edge = edge[self.vectors[edge] @ centre >= floor]
            inside.append(edge)
            around = self._around(edge)
            edge = around[~seen[around]]
            seen[edge] = True
        return np.concatenate([np.zeros(0, np.int64), *inside])


def _levels(n: int) -> np.ndarray:
    draw = (mix(np.arange(n, dtype=np.uint64), 41) >> np.uint64(11)).astype(float) / 2.0**53
    return np.minimum(np.floor(-np.log(draw + 2.0**-54) / np.log(LINKS)), 12).astype(int)


def _unit(rows) -> np.ndarray:
    exact = rows.astype(np.float64) if isinstance(rows, np.ndarray) else np.stack([np.asarray(r, np.float64) for r in rows])
    exact = np.ldexp(exact, -np.frexp(np.abs(exact).max(1))[1][:, None])  # squares stay in range
    return exact / np.linalg.norm(exact, axis=1, keepdims=True)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) with the embeddings as bytes. Rows that link with nothing have BLANK bytes
    instead, a number of the row, so that joins do not send them all to one task."""
    for batch in batches:
        ids, column = batch["vec_id"], batch["embedding"]
        width = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False) + 0.0  # no negative zeros
        last = np.cumsum(width)

        def some(which: np.ndarray) -> np.ndarray:
            seen = np.concatenate([[0], np.cumsum(which)])
            return seen[last] > seen[last - width]

        sound = pc.is_valid(ids).to_numpy(zero_copy_only=False) & ~some(~np.isfinite(flat)) & some(flat != 0)
        size = np.where(sound, width * flat.itemsize, BLANK)
        data = np.zeros(size.sum(), np.uint8)
        kept = np.repeat(sound, size)
        data[kept] = flat[np.repeat(sound, width)].view(np.uint8)
        number = np.zeros((np.count_nonzero(~sound), BLANK), np.uint8)
        number[:, 1:] = np.flatnonzero(~sound).astype(np.int64)[:, None].view(np.uint8)
        data[~kept] = number.ravel()
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        made = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([ids, made], ["vec_id", "embedding"])


def _matrices(column, number: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of each length of the vectors in a column of packed ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(number)
    at = (at - at[0]) // flat.itemsize
    width = np.diff(at)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        yield rows, flat.reshape(-1, w) if len(rows) == len(width) else flat[at[rows][:, None] + np.arange(w)]


def _packed(row: np.ndarray, region: np.ndarray) -> np.ndarray:
    return row * _PACK + region


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is one of the ``ordered`` ones."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _single(vectors: np.ndarray) -> np.ndarray:
    """The vectors, none of them zero, as unit vectors in single precision."""
    most = np.maximum(vectors.max(1), -vectors.min(1))[:, None]
    single = (vectors / most).astype(np.float32)
    return single / np.linalg.norm(single, axis=1, keepdims=True)


class _Regions:
    """Regions of the unit vectors nearest to each of some drawn ones of the same length. Vectors of
    a length that none was drawn of are one region."""

    def __init__(self, drawn: pa.Table, number: type, threshold: float, many: int):
        self.threshold, self.reach = threshold, np.sqrt(max(0.0, 2 - 2 * threshold)) / 2
        #: Vectors as near as this to one vector are all linked with each other.
        self.core = np.sqrt((1 + threshold) / 2) + 1e-5 if threshold > 0 else 2.0
        self.first: dict[int, int] = {}
        self.centres: dict[int, np.ndarray] = {}
        n = 0
        for rows, vectors in _matrices(drawn["embedding"], number):
            self.centres[vectors.shape[1]] = self._centres(_single(vectors), max(1, round(many * len(rows) / len(drawn))))
            self.first[vectors.shape[1]], n = n, n + len(self.centres[vectors.shape[1]])

    @staticmethod
    def _nearest(single: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, best = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        across, size = np.ascontiguousarray(centres.T), max(1, TILE // len(centres))
        for i in range(0, len(single), size):
            near = single[i : i + size] @ across
            own.append(near.argmax(1))
            best.append(near.max(1))
        return np.concatenate(own), np.concatenate(best)

    def _centres(self, single: np.ndarray, many: int) -> np.ndarray:
        """About ``many`` of the vectors, no two of them linked, so that a crowd is one region, and
        more of them where more vectors are; each is moved to the mean of those nearest to it."""
        def apart(some: np.ndarray) -> np.ndarray:
            kept = [some[:0]]
            for i in range(0, len(some), 1024):
                part = some[i : i + 1024]
                near = np.where(np.tri(len(part), k=-1, dtype=bool), part @ part.T, -2).max(1, initial=-2)
                if i:
                    near = np.maximum(near, self._nearest(part, some[:i])[1])
                kept.append(part[near < self.threshold])
            return np.concatenate(kept)

        single = single[np.argsort(mix(np.arange(len(single), dtype=np.uint64), 43))]
        centres = apart(single[: max(1, many // 2)])
        most = 2 * len(single) / many
        for _ in range(8):
            own, best = self._nearest(single, centres)
            count = np.bincount(own, minlength=len(centres))
            order = np.argsort(own, kind="stable")
            place = np.arange(len(own)) - (np.cumsum(count) - count)[own[order]]
            more = order[(count[own[order]] > most) & (place % max(1, int(most) // 2) == 0) & (best[order] < self.threshold)]
            more = more[np.argsort(-count[own[more]], kind="stable")][: many - len(centres)]
            if not len(more):
                break
            centres = np.concatenate([centres, apart(single[more])])
        own = self._nearest(single, centres)[0]
        mean = np.zeros(centres.shape, np.float64)
        np.add.at(mean, own, single)
        size = np.linalg.norm(mean, axis=1, keepdims=True)
        return np.where(size > 1e-3, mean / np.maximum(size, 1e-3), centres).astype(np.float32)

    def of(self, single: np.ndarray, spread: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(region of each vector, whether it is of its core, rows, other regions that these visit).

        Of two vectors on either side of the plane between two drawn ones, at a distance d from
        each other, one lies within d / 2 of it. So of two linked vectors of different regions one
        lies within ``reach`` of their border, mostly far nearer, as links run across it at any
        angle. A vector visits the regions to whose borders it is nearer than the margin.
        """
        width = single.shape[1]
        if width not in self.centres:
            return np.full(len(single), -width), np.zeros(len(single), bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        centres, first = self.centres[width], self.first[width]
        across = np.ascontiguousarray(centres.T)
        margin = self.reach * min(1.0, spread / np.sqrt(min(width, SPANS)))
        home, core = np.zeros(len(single), np.int64), np.zeros(len(single), bool)
        row, cell, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], max(1, TILE // len(centres))
        for i in range(0, len(single), size):
            near = single[i : i + size] @ across
            own = near.argmax(1)
            home[i : i + size] = own
            best = near[np.arange(len(near)), own]
            core[i : i + size] = best >= self.core
            r, c = np.divmod(np.flatnonzero(near >= best[:, None] - np.float32(2 * margin + 1e-5)), len(centres))
            apart = np.linalg.norm(centres[own[r]] - centres[c], axis=1)
            visits = (c != own[r]) & (best[r] - near[r, c] <= margin * apart + 1e-5)
            row.append(r[visits] + i)
            cell.append(c[visits])
        return home + first, core, np.concatenate(row), np.concatenate(cell) + first


class _Found:
    """Links of a block of queries with a shard: for each query the rows it is linked with,
    and links that join the same vectors as all of them.

    ``weights``: the rows of each query that count for the vectors it is linked with (0 for a
    query that is met from the other side as well). ``origin``, ``twice``: the region of each query (-1:
    that of the shard), and the ordered pairs (vector, region) that are met elsewhere.
    """

    def __init__(self, ids: np.ndarray, heads: np.ndarray, sizes: np.ndarray, weights: np.ndarray | None = None,
                 origin: np.ndarray | None = None, twice: np.ndarray | None = None):
        self.ids, self.heads, self.sizes = ids, heads, sizes
        self.weights, self.origin, self.twice = weights, origin, twice
        self.count, self.back = np.zeros(len(ids), np.int64), np.zeros(len(heads), np.int64)
        self.a, self.b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.waiting = 0

    def blank(self) -> _Found:
        return _Found(self.ids, self.heads, self.sizes, self.weights, self.origin, self.twice)

    def add(self, made: _Found) -> None:
        self.count += made.count
        self.back += made.back
        self._join(made.a, made.b)

    def _join(self, a: list[np.ndarray], b: list[np.ndarray]) -> None:
        self.a += a
        self.b += b
        self.waiting += sum(map(len, a))
        if self.waiting > WAITING:
            a, b = _forest(np.concatenate(self.a), np.concatenate(self.b))
            self.a, self.b, self.waiting = [a], [b], 0

    def add_pairs(self, row: np.ndarray, node: np.ndarray) -> None:
        other = self.ids[row] != self.heads[node]
        if self.twice is not None:
            other &= ~_among(_packed(node, self.origin[row]), self.twice)
        row, node = row[other], node[other]
        self.count += np.bincount(row, self.sizes[node], len(self.ids)).astype(np.int64)
        if self.weights is not None:
            self.back += np.bincount(node, self.weights[row], len(self.heads)).astype(np.int64)
        self._join([self.ids[row]], [self.heads[node]])

    def add_table(self, rows: np.ndarray, nodes: np.ndarray, linked: np.ndarray) -> None:
        """``linked``[i, j]: query rows[i] and nodes[j] are linked, or the same vector."""
        if self.twice is not None:
            for region in np.unique(self.origin[rows]):
                met = np.flatnonzero(_among(_packed(nodes, region), self.twice))
                linked[np.ix_(self.origin[rows] == region, met)] = False
        mine = np.where(linked & (self.ids[rows][:, None] == self.heads[nodes]), self.sizes[nodes], 0).sum(1)
        self.count[rows] += linked @ self.sizes[nodes] - mine
        if self.weights is not None:
            self.back[nodes] += self.weights[rows] @ linked
        none = len(nodes)
        low = np.arange(none, dtype=np.int32)
        while True:
            of_row = np.where(linked, low, none).min(1, initial=none)
            new = np.minimum(low, np.where(linked, of_row[:, None], none).min(0, initial=none))
            if (new == low).all():
                break
            low = new
        some = np.flatnonzero(of_row < none)
        self._join([self.ids[rows[some]], self.heads[nodes]], [self.heads[nodes[of_row[some]]], self.heads[nodes[low]]])


def _linked(queries: np.ndarray, row: np.ndarray, shard: np.ndarray, node: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each pair has a cosine of ``threshold`` or more in double precision."""
    size = max(1, CELLS // queries.shape[1])
    parts = [slice(i, i + size) for i in range(0, len(row), size)]
    cosine = [np.einsum("kd,kd->k", queries[row[p]], shard[node[p]]) for p in parts]
    return np.concatenate([np.zeros(0), *cosine]) >= threshold


def _hits(single: np.ndarray, nodes: np.ndarray, own: np.ndarray, margin: np.float32) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, places in them, nodes) of the cosines of ``margin`` or more of all queries with all nodes but their ``own``."""
    across, size = np.ascontiguousarray(nodes.T), max(1, TILE // len(nodes))
    for i in range(0, len(single), size):
        near = single[i : i + size] @ across
        inside = np.flatnonzero(own[i : i + size] >= 0)
        near[inside, own[i + inside]] = -2
        some = np.flatnonzero(near.max(1) >= margin)
        if len(some):
            r, c = np.nonzero(near[some] >= margin)
            yield some + i, r, c


def _compare(shard: np.ndarray, queries: np.ndarray, own: np.ndarray, threshold: float, found: _Found) -> None:
    """Tell ``found`` all links between ``queries`` and the shard's vectors (of any length), all compared."""
    if not len(shard) or not len(queries):
        return
    exactly = None
    for rows, r, node in _hits(_single(queries), _single(shard), own, np.float32(threshold - 1e-4)):
        if 8 * len(r) >= len(rows) * len(shard):
            exactly = _unit(shard).T if exactly is None else exactly
            found.add_table(rows, np.arange(len(shard)), _unit(queries[rows]) @ exactly >= threshold)
        else:
            some, place = np.unique(node, return_inverse=True)
            exact = _linked(_unit(queries[rows]), r, _unit(shard[some]), place, threshold)
            found.add_pairs(rows[r[exact]], node[exact])


class _Audit:
    """Queries of ``some``, drawn by hash, that are linked with other vectors of the shard, and
    their true links. Crowded queries, with as many links as the first beam has places, and
    the others are drawn and judged apart, as neither tells how well the other is searched."""

    def __init__(self, shard: np.ndarray, queries: np.ndarray, own: np.ndarray, some: np.ndarray, threshold: float, first_beam: int):
        order = some[np.argsort(mix(some.astype(np.uint64), 42))]
        kept, truth, met, drawn = [[], []], [[], []], [0, 0], 0
        size = max(1, min(AUDIT, CELLS // len(shard)))
        while drawn < min(len(order), DRAWN):
            part = order[drawn : drawn + size]
            drawn += len(part)
            near = queries[part] @ shard.T >= threshold
            inside = np.flatnonzero(own[part] >= 0)
            near[inside, own[part[inside]]] = False
            links = near.sum(1)
            for k, kind in enumerate(((links > 0) & (links < first_beam), links >= first_beam)):
                new = np.flatnonzero(kind)
                met[k] += len(new)
                new = new[: AUDIT - sum(map(len, kept[k]))]
                kept[k].append(part[new])
                truth[k].append(near[new])
            if drawn >= AUDIT and met[0] >= ENOUGH and (met[1] >= ENOUGH or not met[1]):
                break
        #: Whether enough linked queries were met, or all queries were compared.
        self.enough = drawn == len(order) or met[0] >= ENOUGH and (met[1] >= ENOUGH or not met[1])
        self.kinds = [len(np.concatenate(k)) for k in kept]
        self.rows = np.concatenate([*kept[0], *kept[1]])
        self.truth = np.concatenate([*truth[0], *truth[1]])

    def recalls(self, got: np.ndarray) -> list[float]:
        """The mean share of true links in ``got`` of uncrowded and of crowded queries."""
        share = (got & self.truth).sum(1) / self.truth.sum(1)
        a = self.kinds[0]
        return [part.mean() if len(part) else 1.0 for part in (share[:a], share[a:])]


def _links_in(index: Hierarchy, shard: np.ndarray, queries: np.ndarray, own: np.ndarray, threshold: float, first_beam: int, recall: float,
              found: _Found) -> int:
    """Tell ``found`` all links found between ``queries`` and the shard's vectors, verified in
    double precision. Queries that are nodes of the shard (``own``, else -1) and others have
    audits and beams of their own. Where an audit met too few linked queries to judge by, the
    beam doubles until that changes no query's count either. Gives the widest beam used."""
    single = queries.astype(np.float32)
    margin = np.float32(threshold - 1e-4)
    # what is near a vector that is near the centre is within twice the angle of it
    floor = np.float32(2 * threshold**2 - 1 - 1e-4) if threshold > 0 else np.float32(-2)

    def look(some: np.ndarray, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(queries, nodes, None) of hits as pairs, or (queries, nodes, linked) as a table.

        Queries whose beam is full of hits widen together: those near one of them are
        compared with all that lies within twice the angle around that one.
        """
        size = max(1, min(2048, 60_000_000 // len(shard)))
        full, hits = [], []
        for i in range(0, len(some), size):
            part = some[i : i + size]
            nodes, near = index.search(single[part], own[part], beam)
            hit = (near >= margin) & (nodes >= 0)
            crowded = hit[:, -1] & (beam < len(shard))
            full.append(part[crowded])
            hits.append(nodes[crowded])
            r, c = np.nonzero(hit & ~crowded[:, None])
            row, node = part[r], nodes[r, c]
            exact = np.einsum("kd,kd->k", queries[row], shard[node]) >= threshold
            yield row[exact], node[exact], None
        left, hits = np.concatenate(full), np.concatenate(hits)
        while len(left):
            centre = single[left[0]]
            group = single[left] @ centre >= margin
            group[0] = True
            near, start = left[group], np.unique(hits[group])
            left, hits = left[~group], hits[~group]
            ball = np.sort(index.flood(centre, start, floor))
            size = max(1, CELLS // len(ball))
            for i in range(0, len(near), size):
                part = near[i : i + size]
                yield part, ball, queries[part] @ shard[ball].T >= threshold

    widest = 0
    for some in (np.flatnonzero(own >= 0), np.flatnonzero(own < 0)):
        if not len(some):
            continue
        audit = _Audit(shard, queries, own, some, threshold, first_beam)
        place = np.full(len(queries), -1)
        place[audit.rows] = np.arange(len(audit.rows))
        beam, past = first_beam, None
        while True:
            got = np.zeros(audit.truth.shape, bool)
            for rows, nodes, linked in look(audit.rows, beam) if len(audit.rows) else ():
                if linked is None:
                    got[place[rows], nodes] = True
                else:
                    got[np.ix_(place[rows], nodes)] |= linked
            if min(audit.recalls(got)) >= recall or beam >= len(shard):
                made = found.blank()
                for rows, nodes, linked in look(some, beam):
                    if linked is None:
                        made.add_pairs(rows, nodes)
                    else:
                        made.add_table(rows, nodes, linked)
                if audit.enough or beam >= len(shard) or past is not None and (made.count == past).all():
                    break
                past = made.count
            beam *= 2
        found.add(made)
        widest = max(widest, beam)
    return widest


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (vector, smallest vector reachable) that join the same vectors as all pairs."""
    ids, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some = np.flatnonzero(root != np.arange(len(ids)))
    return ids[some], ids[root[some]]


def _recalls(classes: DataFrame, drawn: pa.Table, number: type, regions: _Regions, spread: float, threshold: float) -> tuple[list[float], list[int]]:
    """The mean share of the true links of a drawn vector that meet in some region, of vectors with
    fewer links than BEAM and of the others, and how many drawn vectors of either kind have links."""
    keys, sample = drawn["key"].to_numpy(), {}
    for rows, vectors in _matrices(drawn["embedding"], number):
        exact = _unit(vectors)
        single = exact.astype(np.float32)
        home, _, row, cell = regions.of(single, spread)
        sample[vectors.shape[1]] = rows, exact, single, home, np.sort(np.concatenate([_packed(np.arange(len(rows)), home), _packed(row, cell)]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, met = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for batch in batches:
            key = batch["key"].to_numpy()
            for some, vectors in _matrices(batch["embedding"], number):
                if vectors.shape[1] not in sample:
                    continue
                rows, asked, nodes, home, visits = sample[vectors.shape[1]]
                single = _single(vectors)
                hits = [(part[r], q) for part, r, q in _hits(single, nodes, np.full(len(single), -1), np.float32(threshold - 1e-4))]
                if not hits:
                    continue
                r, q = map(np.concatenate, zip(*hits))
                who, place = np.unique(r, return_inverse=True)
                true = _linked(_unit(vectors[who]), place, asked, q, threshold) & (key[some[r]] != keys[rows[q]])
                place, q = place[true], q[true]
                of, _, row, cell = regions.of(single[who], spread)
                came = np.sort(_packed(row, cell))
                meet = _among(_packed(q, of[place]), visits) | _among(_packed(place, home[q]), came)
                links += np.bincount(rows[q], minlength=len(keys))
                met += np.bincount(rows[q], meet, len(keys)).astype(np.int64)
        q = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(links[q]), pa.array(met[q])], ["q", "links", "met"])

    if not len(keys):
        return [1.0, 1.0], [0, 0]
    told = classes.select("key", "embedding").mapInArrow(judge, "q bigint, links bigint, met bigint")
    told = told.groupBy("q").agg(F.sum("links").alias("links"), F.sum("met").alias("met")).toArrow()
    links, share = told["links"].to_numpy(), told["met"].to_numpy() / told["links"].to_numpy()
    kinds = [share[links < BEAM], share[links >= BEAM]]
    return [k.mean() if len(k) else 1.0 for k in kinds], [len(k) for k in kinds]


def near_vectors(vectors: DataFrame, threshold: float = 0.95, shard: int = SHARD, block: int = BLOCK,
                 beam: int = BEAM, recall: float = RECALL, region: int = REGION, whole: int = WHOLE) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors link when their cosine, in double precision, is ``threshold`` or more. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing; so do
    rows without a vec_id (component_id null, not kept). Vectors of different lengths do not
    link. n_links counts the other rows linked directly, component_id is the smallest vec_id
    that links reach, and the row with that id is kept. Rows that repeat a vec_id count as one
    vector per distinct embedding. An empty table gives an empty result.

    Equal embeddings are one class of rows, linked among themselves. A class belongs to the region
    of the drawn class nearest to it, and visits those to whose borders it is near; two classes
    that meet in two regions count in the first. The margin at the borders grows until drawn
    classes, compared with all, miss a tenth of the links that ``recall`` allows at most; where too
    few of them have links to judge by, until that changes no count. In a region of up to ``whole``
    classes all are compared with its visitors and each other. In a larger one those so near its
    centre that they must be linked make its core, and the others and the visitors are compared with all
    in parts. If there are more than ``shard`` others, the region is dealt to shards by hash
    instead; a task builds the graphs of a shard, which are stored as rows, and each block of the
    region's classes and visitors searches every shard of it. A task returns counts for each
    class and a spanning forest of what it linked, not the pairs.
    """
    single = isinstance(vectors.schema["embedding"].dataType.elementType, FloatType)
    number = np.float32 if single else np.float64
    rows = vectors.select("vec_id", F.col("embedding").cast(f"array<{'float' if single else 'double'}>").alias("embedding")).mapInArrow(
        _pack, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, embedding binary")
    good = rows.where(F.octet_length("embedding") % 4 == 0)
    # a vec_id with several embeddings heads several classes, so each class has a key of its own
    classes = settle(good.groupBy("embedding").agg(F.min("vec_id").alias("head"), F.count("*").alias("size")).withColumn(
        "key", F.monotonically_increasing_id()), "vector-classes")
    n, length = classes.agg(F.count("*"), F.coalesce(F.avg(F.octet_length("embedding")), F.lit(1.0))).first()
    many = min(MAX_REGIONS, max(MIN_REGIONS, -(-n // region)))

    def draw(most: float, salt: int):
        return F.pmod(F.xxhash64("embedding", F.lit(salt)), F.lit(2**40)) < int(2**40 * min(1, most / max(n, 1)))

    most = min(DRAWS * many, DRAWN_FLOATS * np.dtype(number).itemsize / length)
    picked = classes.select("key", "head", "embedding", draw(most, 1).alias("laid"), draw(DRAWN, 2).alias("audit")).where("laid or audit").toArrow()
    picked = picked.sort_by([("head", "ascending"), ("key", "ascending")])
    regions, drawn = _Regions(picked.filter(picked["laid"]), number, threshold, many), picked.filter(picked["audit"])

    spread, past = SPREAD, None
    while True:
        recalls, kinds = _recalls(classes, drawn, number, regions, spread, threshold)
        last = spread >= np.sqrt(SPANS)
        if min(recalls) >= 1 - (1 - recall) / 10 or last:
            routes = settle(_routed(classes, regions, spread, number), "vector-routes")
            pairs, graphs = _met(routes, number, threshold, shard, block, beam, recall, whole)
            met = settle(pairs, "met")
            discard(*graphs)
            links = met.agg(F.sum("n")).first()[0]
            if last or len(drawn) == n or kinds[0] >= ENOUGH and (kinds[1] >= ENOUGH or not kinds[1]) or links == past:
                break
            past = links
            discard(routes, met)
        spread *= WIDER

    counts = met.where("a = b").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    found = components(met.where("a <> b").select("a", "b"))
    group = routes.select("key", "head").join(found.withColumnRenamed("node", "key"), "key").select("key", "head", F.col("component").alias("group"))
    first = group.groupBy("group").agg(F.min("head").alias("component"))
    linked = counts.join(group.join(first, "group").select("key", "component"), "key", "left")
    home = routes.select("key", "embedding", "head", "size").join(linked, "key", "left").select(
        "embedding", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "head").alias("component"))
    home = settle(home.where("n_links > 0"), "vector-homes")
    out = rows.join(home, "embedding", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"))
    discard(met, routes, classes)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _routed(classes: DataFrame, regions: _Regions, spread: float, number: type) -> DataFrame:
    """``classes`` with their region and the regions they visit."""
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, core = np.zeros(len(batch), np.int32), np.zeros(len(batch), bool)
            rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for some, vectors in _matrices(batch["embedding"], number):
                home[some], core[some], row, cell = regions.of(_single(vectors), spread)
                rows.append(some[row])
                cells.append(cell)
            row, cell = np.concatenate(rows), np.concatenate(cells)
            order = np.argsort(row, kind="stable")
            offsets = np.searchsorted(row[order], np.arange(len(batch) + 1)).astype(np.int32)
            visits = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch[c] for c in ("key", "head", "size", "embedding")] + [pa.array(home), pa.array(core), visits],
                                             ["key", "head", "size", "embedding", "region", "core", "visits"])

    return classes.select("key", "head", "size", "embedding").mapInArrow(
        route, "key bigint, head bigint, size bigint, embedding binary, region int, core boolean, visits array<int>")


_MET = "a bigint, b bigint, n bigint"


def _found_in(left: pa.Table, right: pa.Table, alone: bool) -> _Found:
    """For queries ``right`` of the rows ``left`` of a region; ``alone``: those of the same region
    are counted as queries only, as the rows are queries as well."""
    here, origin = left["region"][0].as_py(), right["region"].to_numpy()
    visits = left["visits"].combine_chunks()
    at, cell = pc.list_parent_indices(visits).to_numpy().astype(np.int64), visits.flatten().to_numpy().astype(np.int64)
    own = origin == here
    # rows of a region before this one meet those that visit it there
    return _Found(right["key"].to_numpy(), left["key"].to_numpy(), left["size"].to_numpy(), np.where(own & alone, 0, right["size"].to_numpy()),
                  np.where(own, -1, origin), np.sort(_packed(at[cell < here], cell[cell < here])))


def _told(*made: _Found) -> pa.Table:
    parts = [pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})]
    for found in made:
        some, back = np.flatnonzero(found.count), np.flatnonzero(found.back)
        a, b = _forest(np.concatenate(found.a), np.concatenate(found.b))
        one = np.concatenate([found.ids[some], found.heads[back]])
        n = np.concatenate([found.count[some], found.back[back], np.zeros(len(a), np.int64)])
        parts.append(pa.table({"a": np.concatenate([one, a]), "b": np.concatenate([one, b]), "n": n}))
    return pa.concat_tables(parts)


def _met(routes: DataFrame, number: type, threshold: float, shard: int, block: int, beam: int, recall: float, whole: int) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b, n): n rows that a = b is linked with, or a link a, b of a forest; and the tables that it reads but ``routes``."""
    names = ["key", "size", "region", "embedding"]

    def vectors(side: pa.Table) -> np.ndarray:
        return next(_matrices(side["embedding"], number))[1]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _told()
        right = pa.concat_tables([left.select(names), right.select(names)])
        found = _found_in(left, right, True)
        _compare(vectors(left), vectors(right), np.where(np.arange(len(right)) < len(left), np.arange(len(right)), -1), threshold, found)
        return _told(found)

    def meet_part(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for core in (True, False):
            some = left.filter(pc.equal(left["core"], core))
            if len(some) and len(right):
                made.append(_found_in(some, right, not core))
                own = pd.Series(np.arange(len(some)), some["key"].to_numpy()).reindex(right["key"].to_numpy(), fill_value=-1).to_numpy()
                _compare(vectors(some), vectors(right), own, threshold, made[-1])
        return _told(*made)

    homes = routes.withColumn("place", F.col("region"))
    # columns of their own, as they meet those of the same table
    visitors = routes.select(F.explode("visits").alias("place"), *[F.col(c).alias(c) for c in names])
    sizes = routes.groupBy(F.col("region").alias("place")).agg(F.count("*").alias("n"), F.count(F.when(~F.col("core"), 1)).alias("others"))
    regions, large = sizes.count(), sizes.where(F.col("n") > whole).collect()
    small = [homes, visitors]
    if large:
        large = F.broadcast(routes.sparkSession.createDataFrame(large, sizes.schema))
        small = [side.join(large, "place", "left_anti") for side in small]
    parts = max(MIN_REGIONS, regions // 8)
    left, right = (side.repartition(parts, "place").groupBy("place") for side in small)
    met = left.cogroup(right).applyInArrow(meet, _MET)
    if not large:
        return met, []

    dealt = large.where(F.col("others") <= shard).select("place", F.ceil(F.col("n") / whole).cast("int").alias("parts"))
    members = homes.join(dealt, "place")
    core = members.where("core").select("place", "key", "size")
    core = core.join(core.groupBy("place").agg(F.sum("size").alias("total"), F.min("key").alias("least")), "place")
    met = met.unionByName(core.select(F.col("key").alias("a"), F.col("key").alias("b"), (F.col("total") - F.col("size")).alias("n")))
    met = met.unionByName(core.where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"), F.lit(0).cast("bigint").alias("n")))
    nodes = members.withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    asked = homes.where(~F.col("core")).select("place", *names).unionByName(visitors).join(dealt, "place").select(
        *[F.col(c).alias(c) for c in ["place", *names]], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = met.unionByName(nodes.groupBy("place", "part").cogroup(asked.groupBy("place", "part")).applyInArrow(meet_part, _MET))
    crowded = large.where(F.col("others") > shard)
    if crowded.isEmpty():
        return met, []
    found, graphs = _met_by_graphs(homes, visitors, crowded, vectors, threshold, shard, block, beam, recall)
    return met.unionByName(found), [graphs]


def _met_by_graphs(homes: DataFrame, visitors: DataFrame, large: DataFrame, vectors, threshold: float,
                   shard: int, block: int, beam: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """As _met, of the ``large`` regions, whose shards are searched by their graphs."""
    hashed = F.xxhash64("key")
    dealt = large.select("place", F.ceil(F.col("n") / shard).cast("int").alias("shards"),
                         F.greatest(F.lit(MIN_BLOCKS), F.ceil(F.col("n") / block).cast("int")).alias("blocks"))
    columns = "place int, shard int, blocks int, key bigint, size bigint, region int, visits array<int>, embedding binary"

    def grow(some: pa.Table) -> pa.Table:
        some = some.sort_by("key")
        level = _levels(len(some))
        order = np.argsort(-level, kind="stable")
        some = some.take(pa.array(order))
        index = Hierarchy(_unit(vectors(some)), level[order])
        return some.append_column("at", pa.array(np.arange(len(some), dtype=np.int32))).append_column(
            "level", pa.array(level[order].astype(np.int32))).append_column("links", pa.array(index.stored_links(), pa.binary()))

    members = homes.join(dealt, "place")
    graphs = settle(
        members.withColumn("shard", F.pmod(hashed, "shards").cast("int")).select(*[c.split()[0] for c in columns.split(", ")])
        .groupBy("place", "shard").applyInArrow(grow, f"{columns}, at int, level int, links binary"), "vector-graphs")
    mine = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    names = ["place", "key", "size", "region", "embedding"]
    asked = homes.select(*names).unionByName(visitors.select(*names)).join(dealt, "place").withColumns({
        "block": F.pmod(F.shiftright(hashed, 20), "blocks").cast("int"), "shard": F.explode(F.sequence(F.lit(0), F.col("shards") - 1))})

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _told()
        left = left.sort_by("at")
        exact, queries = _unit(vectors(left)), _unit(vectors(right))
        own = pd.Series(np.arange(len(left)), left["key"].to_numpy()).reindex(right["key"].to_numpy(), fill_value=-1).to_numpy()
        found = _found_in(left, right, True)
        index = Hierarchy(exact, left["level"].to_numpy(), left["links"].to_pylist())
        _links_in(index, exact, queries, own, threshold, beam, recall, found)
        return _told(found)

    keys = ["place", "shard", "block"]
    return mine.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, _MET), graphs
