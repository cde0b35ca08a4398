"""Exact top-k inner products by dual-tree search over cover trees.

The top of the tree is a farthest-first net of a bounded sample of the vectors.
Every vector belongs to the nearest net point; the points of a net point are a
cell with a covering radius, split into blocks of bounded size.  A query's k-th
score within the sample is the first value of its worst score, and the query
goes to the cells whose bound reaches it, so the exchange follows what can't be
pruned; a vector goes only where queries go.

In a block both sides are indexed as cover trees: a node's children are a
farthest-first net of its points, separated by at least the radius that covers
their level.  A pair of nodes is dropped when
``<a, b> + |a| r_b + |b| r_a + r_a r_b``, which no inner product of their points
exceeds, lies below the worst k-th score in the query node.  Equal scores are
never dropped, since ties go to the smaller id.  Bounds of many nodes are one
product, and leaves that remain meet in batches of growing size, so where nothing
can be pruned a block costs about one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitquarry.llm.tables import checked, cut

_RESULT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_NONE = np.iinfo(np.int64).max


def net(points: np.ndarray, most: int) -> np.ndarray:
    """Rows of a farthest-first net: each next one is the farthest from those before; fewer if all are covered."""
    if not len(points):
        return np.zeros(0, np.int64)
    rows, nearest = [0], ((points - points[0]) ** 2).sum(1)
    while len(rows) < most and nearest.max() > 0:
        rows.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[rows[-1]]) ** 2).sum(1))
    return np.array(rows)


def nearest_of(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, distance to it) of each point."""
    near = ((centres**2).sum(1)[None, :] - 2 * points @ centres.T).argmin(1)
    return near, np.sqrt(((points - centres[near]) ** 2).sum(1))


def upper_bounds(centre: np.ndarray, norm: float, radius: float, centres: np.ndarray, norms: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """No inner product of points of a node with those of each other node exceeds these.  The slack covers rounding."""
    b = centres @ centre + norm * radii + norms * radius + radius * radii
    return b + 1e-9 * (np.abs(b) + (norm + radius) * (norms + radii) + 1)


def upper_bounds_of(points: np.ndarray, centres: np.ndarray, norms: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The same for single points, a row each."""
    own = np.sqrt((points**2).sum(1))[:, None]
    b = points @ centres.T + own * radii
    return b + 1e-9 * (np.abs(b) + own * (norms + radii) + 1)


@dataclass
class Node:
    """The points start to stop of a tree's order, their centre, its norm, the covering radius."""

    start: int
    stop: int
    centre: np.ndarray
    norm: float
    radius: float
    children: list["Node"] = field(default_factory=list)
    worst: float = -np.inf


def cover_tree(points: np.ndarray, leaf: int = 256, fanout: int = 16) -> tuple[Node, np.ndarray]:
    """(root, order): the tree of points, whose rows in that order stand together node by node."""
    order = np.arange(len(points))

    def grow(start: int, stop: int) -> Node:
        own = points[order[start:stop]]
        distance = np.sqrt(((own - own[0]) ** 2).sum(1))
        node = Node(start, stop, own[0], float(np.sqrt((own[0] ** 2).sum())), float(distance.max()))
        if stop - start > leaf and node.radius:
            owner, nearest = nearest_of(own, own[net(own, fanout)])
            # Each part starts with its net point, which becomes its centre.
            at = np.lexsort((nearest, owner))
            order[start:stop] = order[start:stop][at]
            ends = [*(start + 1 + np.flatnonzero(np.diff(owner[at]))).tolist(), stop]
            node.children = [grow(a, b) for a, b in zip([start, *ends], ends)]
        return node

    return grow(0, len(points)), order


class Search:
    """The k best candidates of each query of two blocks of integer vectors; worst are scores that each k-th reaches at least."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int, worst: np.ndarray | None = None):
        self.query_ids, self.queries, self.ids, self.candidates, self.k = query_ids, queries, ids, candidates, k
        self.worst = np.full(len(queries), -np.inf) if worst is None else worst.astype(float)
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), _NONE)
        self.pairs = 0
        self.repeats = int(np.unique(ids, return_counts=True)[1].max(initial=0))

    def run(self) -> "Search":
        if len(self.queries) and len(self.candidates):
            (q, qo), (c, co) = cover_tree(self.queries, 128), cover_tree(self.candidates)
            self.query_ids, self.queries, self.worst = self.query_ids[qo], self.queries[qo], self.worst[qo]
            self.ids, self.candidates = self.ids[co], self.candidates[co]
            self.visit(q, [c])
            back = np.argsort(qo)
            self.query_ids, self.queries, self.worst, self.scores, self.found = (x[back] for x in (self.query_ids, self.queries, self.worst, self.scores, self.found))
        return self

    def bounds(self, q: Node, nodes: list[Node]) -> np.ndarray:
        return upper_bounds(q.centre, q.norm, q.radius, np.array([n.centre for n in nodes]), np.array([n.norm for n in nodes]), np.array([n.radius for n in nodes]))

    def visit(self, q: Node, nodes: list[Node]) -> None:
        """Search the points of q among those of the nodes."""
        q.worst = float(self.worst[q.start : q.stop].min())
        bounds = self.bounds(q, nodes)
        while True:
            nodes, bounds = [n for n, b in zip(nodes, bounds) if b >= q.worst], bounds[bounds >= q.worst]
            open_ = [bool(n.children) and (not q.children or n.radius > q.radius) for n in nodes]
            if not any(open_):
                break
            inner = [x for n, o in zip(nodes, open_) if o for x in n.children]
            bounds = np.concatenate([bounds[~np.array(open_)], self.bounds(q, inner)])
            nodes = [n for n, o in zip(nodes, open_) if not o] + inner
        if not nodes:
            return
        if q.children:
            for child in q.children:
                self.visit(child, nodes)
            return
        order, at, size = np.argsort(-bounds, kind="stable"), 0, 1
        while at < len(order) and bounds[order[at]] >= q.worst:
            batch = [nodes[k] for k in order[at : at + size] if bounds[k] >= q.worst]
            self.meet(q, np.concatenate([np.arange(n.start, n.stop) for n in batch]))
            q.worst = float(self.worst[q.start : q.stop].min())
            at, size = at + size, 4 * size

    def meet(self, q: Node, rows: np.ndarray, most_cells: int = 1 << 24) -> None:
        """Merge all scores of a leaf's queries with some candidates."""
        for a in range(0, len(rows), step := max(1, most_cells // (q.stop - q.start))):
            self._meet(slice(q.start, q.stop), rows[a : a + step])

    def _meet(self, own: slice, rows: np.ndarray) -> None:
        self.pairs += (own.stop - own.start) * len(rows)
        s = self.queries[own] @ (self.candidates if len(rows) == len(self.candidates) and rows[0] == 0 else self.candidates[rows]).T
        ids = self.ids[rows]
        for column in np.flatnonzero(np.isin(ids, self.query_ids[own])):
            s[self.query_ids[own] == ids[column], column] = -np.inf
        least, kth = self.worst[own], self.k * self.repeats
        if len(rows) > kth:
            least = np.maximum(least, np.partition(s, len(rows) - kth, axis=1)[:, len(rows) - kth])
        r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        if not len(r):
            return
        # The candidates that reach a query's worst score, beside those that it has; each id once.
        have = self.scores[own] > -np.inf
        r = np.concatenate([np.nonzero(have)[0], r])
        scores, ids = np.concatenate([self.scores[own][have], s[r[have.sum() :], c]]), np.concatenate([self.found[own][have], ids[c]])
        at = np.lexsort((ids, -scores, r))
        r, scores, ids = r[at], scores[at], ids[at]
        if self.repeats > 1:
            first = np.zeros(len(r), bool)
            by = np.lexsort((np.arange(len(r)), ids, r))
            first[by] = np.concatenate([[True], (np.diff(r[by]) != 0) | (np.diff(ids[by]) != 0)])
            r, scores, ids = r[first], scores[first], ids[first]
        starts = np.searchsorted(r, np.arange(own.stop - own.start))
        rank = np.arange(len(r)) - starts[r]
        keep = rank < self.k
        self.scores[own] = -np.inf
        self.found[own] = _NONE
        self.scores[own.start + r[keep], rank[keep]], self.found[own.start + r[keep], rank[keep]] = scores[keep], ids[keep]
        self.worst[own] = np.maximum(self.worst[own], self.scores[own, -1])


def distinct(ids: np.ndarray, points: np.ndarray, most: int) -> np.ndarray:
    """Rows without repeats, and of each vector with the smallest ``most`` ids only: others can't be among the best."""
    if not len(ids):
        return np.zeros(0, np.int64)
    text = np.ascontiguousarray(points + 0.0).view(np.dtype((np.void, points.shape[1] * 8))).ravel() if points.shape[1] else np.zeros(len(ids), np.int8)
    group = np.unique(text, return_inverse=True)[1]
    at = np.lexsort((ids, group))
    g, i = group[at], ids[at]
    fresh = np.concatenate([[True], (np.diff(g) != 0) | (np.diff(i) != 0)])
    at, g = at[fresh], g[fresh]
    starts = np.searchsorted(g, g)
    return np.sort(at[np.arange(len(g)) - starts < most])


def _vectors(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    """Lists of one length as an array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _lists(points: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1, dtype=np.int32) * points.shape[1], pa.int32()), pa.array(points.ravel(), pa.float64()))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch (its column v) by their vectors' length."""
    sizes = np.array([len(x) for x in batch.column("v")], np.int64)
    for dim in np.unique(sizes).tolist():
        yield dim, batch.filter(pa.array(sizes == dim))


def _group(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    if not queries.num_rows or not candidates.num_rows:
        return _RESULT.empty_table()
    (qi, q), (ci, c) = ((t.column("id").to_numpy(), _vectors(t.column("v"), t.num_rows)) for t in (queries, candidates))
    own, other = distinct(qi, q, len(qi)), distinct(ci, c, k + 1)
    qi = qi[own]
    s = Search(qi, q[own], ci[other], c[other], k, queries.column("worst").to_numpy()[own]).run()
    at = s.scores > -np.inf
    return pa.table([pa.array(np.repeat(qi, k)[at.ravel()]), pa.array(s.found[at]), pa.array(s.scores[at].astype(np.int64))], schema=_RESULT)


@dataclass
class Cells:
    """Net points of each length of vectors, and once known their cells' radii, blocks and query blocks."""

    centres: dict[int, np.ndarray]
    sample: dict[int, tuple[np.ndarray, np.ndarray]]
    facts: dict[tuple[int, int], tuple[float, int, int, int]] = field(default_factory=dict)

    def net_of(self, dim: int) -> np.ndarray:
        """Lengths that the sample lacks have one cell around the origin."""
        return self.centres.get(dim, np.zeros((1, dim)))


def _placed(v: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(id, v, dim, cell, distance): quantised vectors with their cells; a vector's many copies are thinned map by map."""
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("dim", pa.int32()), ("cell", pa.int32()), ("distance", pa.float64())])
    known = v.sparkSession.sparkContext.broadcast(cells.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Cells(known.value, {})
        for batch in batches:
            for dim, part in _by_length(batch):
                ids, points = part.column("id").to_numpy(), np.floor(256.0 * _vectors(part.column("v"), part.num_rows)) + 0.0
                near, distance = nearest_of(points, own.net_of(dim)) if dim else (np.zeros(len(ids), np.int64), np.zeros(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(points), pa.array(np.full(len(ids), dim, np.int32)), pa.array(near.astype(np.int32)), pa.array(distance)], schema=schema)

    return v.mapInArrow(run, "id long, v array<double>, dim int, cell int, distance double")


def _routed(queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(id, v, worst, dim, qb, cell, sub): each query once for each block of each cell whose bound reaches its worst score."""
    schema = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("worst", pa.float64()), ("dim", pa.int32()), ("qb", pa.int32()), ("cell", pa.int32()), ("sub", pa.int32())])
    known = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in _by_length(batch):
                ids, points, home = part.column("id").to_numpy(), _vectors(part.column("v"), part.num_rows), part.column("cell").to_numpy()
                facts = [(c, *known.value.facts[dim, c]) for c in range(len(known.value.net_of(dim))) if (dim, c) in known.value.facts]
                number, radii, blocks = (np.array([f[k] for f in facts]) for k in (0, 1, 2))
                centres = known.value.net_of(dim)[number]
                norms = np.sqrt((centres**2).sum(1))
                worst = np.full(len(ids), -np.inf)
                sample_ids, sample = known.value.sample.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
                if len(sample) > k:
                    s = points @ sample.T
                    s[ids[:, None] == sample_ids[None, :]] = -np.inf
                    worst = np.partition(s, len(sample) - k, axis=1)[:, len(sample) - k]
                first, several = (np.array([known.value.facts[dim, c][k] for c in home.tolist()], np.int64) for k in (2, 3))
                qb = first + ids % several
                step = max(1, 65536 // int(blocks.sum()))
                for a in range(0, len(ids), step):
                    own = slice(a, a + step)
                    r, c = np.nonzero(upper_bounds_of(points[own], centres, norms, radii) >= worst[own, None])
                    times = blocks[c]
                    r, c, sub = np.repeat(r, times) + a, np.repeat(c, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r]), _lists(points[r]), pa.array(worst[r]), *(pa.array(x.astype(np.int32)) for x in (np.full(len(r), dim), qb[r], number[c], sub))], schema=schema)

    return queries.mapInArrow(run, "id long, v array<double>, worst double, dim int, qb int, cell int, sub int")


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, sample: int = 4096, block: int = 32768, query_block: int = 32768, least_cells: int = 24, most_cells: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Queries are the rows whose id is divisible by ``every``; candidates all rows
    with another id.  Components are floor(256 x).  Vectors that are null or hold
    null or non-finite components, and rows without id, take no part; vectors
    meet only those of their own length.  Repeated rows count once.  Fewer than k
    candidates give fewer rows; an empty table gives none.  Scores are exact below
    2 ** 53.  Other columns play no part.

    The net and the first worst scores come from at most ``sample`` vectors (the
    first by a hash of their ids); all vectors are indexed and searched.  A task
    holds one block of each side.  Vectors that can't be pruned cost the product
    of queries and vectors, and an exchange of queries times blocks.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = v.where("id is not null and v is not null").where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    picked = v.select("id", "v").orderBy(F.xxhash64("id"), "id", "v").limit(sample).toArrow()
    cells = Cells({}, {})
    count = max(least_cells, min(most_cells, -(-vectors.count() // block)))
    for whole in picked.to_batches():
        for dim, part in _by_length(whole):
            ids, points = part.column("id").to_numpy(), np.floor(256.0 * _vectors(part.column("v"), part.num_rows)) + 0.0
            have = cells.sample.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
            ids, points = np.concatenate([have[0], ids]), np.concatenate([have[1], points])
            one = np.unique(ids, return_index=True)[1]
            cells.sample[dim] = ids[one], points[one]
    for dim, (_, points) in cells.sample.items():
        if dim:
            cells.centres[dim] = points[net(points, count)]
    placed = cut(_placed(v, cells, k))
    # A row for each cell: at most most_cells for each length of vectors.
    stats = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"), F.count_if(F.col("id") % every == 0).alias("queries")).orderBy("dim", "cell").collect()
    qb = room = 0
    for s in stats:
        several = max(1, -(-s["queries"] // query_block))
        if several > 1 or s["queries"] > room:
            qb, room = qb + 1, query_block
        cells.facts[s["dim"], s["cell"]] = s["radius"], -(-s["n"] // block), qb, several
        qb, room = qb + several - 1, room - s["queries"] if several == 1 else 0
    queries = cut(_routed(placed.where(F.col("id") % every == 0), cells, k))
    keys = ["dim", "qb", "cell", "sub"]
    blocks = placed.sparkSession.createDataFrame([(d, c, f[1]) for (d, c), f in cells.facts.items()], "dim int, cell int, blocks int")
    candidates = placed.join(F.broadcast(blocks), ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    candidates = candidates.join(checked(cut(queries.select(*keys).distinct())), ["dim", "cell", "sub"])
    right = candidates.select("id", "v", *keys)
    found = queries.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(lambda a, b: _group(a, b, k), "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
