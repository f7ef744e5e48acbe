"""Exact top-k search by inner product with paged M-trees.

Vectors become integers. One more component lifts every candidate to the same length, which
turns the largest inner product into the smallest Euclidean distance, a metric. Candidates are
dealt to the nearest of a bounded number of routing vectors and, where a route holds many,
hashed into pages of similar size, so copies of one vector do not meet in one task. Each page is
an M-tree: nodes with a routing vector, a covering radius and the distance to the parent's
routing vector.

A query first searches a page of the route that promises most, which gives it a k-th score to
beat; then every page whose covering radius leaves a chance. Inside a page nodes are taken
best first; stored distances and the triangle inequality dismiss subtrees and vectors before
a distance is computed. Bounds are floating point with a margin; scores are integers.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..operators.tables import written

SCALE = 256
LEAF, FANOUT = 256, 12
MAX_ROUTES = 1024
QUERY_BLOCK = 20_000


class Tree:
    """An M-tree over integer vectors; ``lift`` is the squared length all are lifted to."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, lift: float):
        order = np.argsort(ids, kind="stable")
        self.vectors, self.ids = vectors[order], ids[order]
        v = self.vectors.astype(np.float64)
        self.lifted = np.column_stack((v, np.sqrt(np.maximum(0.0, lift - (v * v).sum(axis=1)))))
        self.nodes: list[tuple] = []  # a leaf: (first row, behind the last, distances); an inner node: (numbers, routing vectors, radii, distances to this node's) of its children
        self.rows: list[np.ndarray] = []
        self.filled = 0
        everything = np.arange(len(ids))
        self.route = self.lifted[0].copy()
        self.root, self.radius = self._node(everything, 0)
        rows = np.concatenate(self.rows)  # a leaf's members stand together
        self.vectors, self.ids, self.lifted = self.vectors[rows], self.ids[rows], self.lifted[rows]
        del self.rows

    def _distances(self, members: np.ndarray, to: int) -> np.ndarray:
        return np.sqrt(((self.lifted[members] - self.lifted[to]) ** 2).sum(axis=1))

    def _node(self, members: np.ndarray, route: int) -> tuple[int, float]:
        """The number and covering radius of a new node."""
        own = self._distances(members, route)
        if len(members) <= LEAF:
            self.nodes.append((self.filled, self.filled + len(members), own))
            self.rows.append(members)
            self.filled += len(members)
        else:
            groups = []
            if own.max() > 0:
                routes = np.unique(members[np.linspace(0, len(members) - 1, FANOUT).astype(int)])
                near = self._nearest(members, routes)
                groups = [(members[near == i], int(r)) for i, r in enumerate(routes) if (near == i).any()]
            if len(groups) < 2 or max(len(g) for g, _ in groups) > 0.95 * len(members):
                groups = [(g, int(g[0])) for g in np.array_split(members, min(FANOUT, -(-len(members) // LEAF)))]
            made = [self._node(g, r) for g, r in groups]
            routes = np.array([r for _, r in groups])
            self.nodes.append(([n for n, _ in made], self.lifted[routes], np.array([r for _, r in made]), self._distances(routes, route)))
        return len(self.nodes) - 1, float(own.max())

    def _nearest(self, members: np.ndarray, routes: np.ndarray) -> np.ndarray:
        a, b = self.lifted[members], self.lifted[routes]
        return np.argmin((b * b).sum(axis=1)[None] - 2 * a @ b.T, axis=1)

    def search(self, query: np.ndarray, own_id: int, k: int, least: float, lift: float) -> list[tuple[int, int]]:
        """Up to k (score, id), best first, of scores not below ``least``; the query's own id is left out."""
        q = np.append(query.astype(np.float64), 0.0)
        length = float(q @ q)
        margin = 1e-7 * (length + lift + 1)
        best: list[tuple[int, int]] = []  # heap of (score, -id)
        threshold = least

        def reach(t: float) -> float:
            """The largest distance a score of t allows."""
            return np.sqrt(max(0.0, length + lift - 2 * t) + margin) if t > -np.inf else np.inf

        limit = reach(threshold)
        exact = length * lift < 2.0**104  # no sum of products leaves the whole numbers a float holds
        d = float(np.sqrt(((q - self.route) ** 2).sum()))
        heap = [(max(0.0, d - self.radius), self.root, d)]
        while heap:
            low, at, d = heapq.heappop(heap)
            if low > limit:
                break
            node = self.nodes[at]
            if len(node) == 4:
                numbers, routes, radii, ups = node
                may = np.flatnonzero(np.abs(d - ups) - radii <= limit)
                near = np.sqrt(((q - routes[may]) ** 2).sum(axis=1))
                for j, dc in zip(may.tolist(), near.tolist()):
                    if dc - radii[j] <= limit:
                        heapq.heappush(heap, (max(0.0, dc - float(radii[j])), numbers[j], dc))
                continue
            first, behind, stored = node
            may = first + np.flatnonzero(np.abs(d - stored) <= limit)
            rows = slice(first, behind) if len(may) == behind - first else may
            scores = self.lifted[rows] @ q if exact else self.vectors[rows] @ query  # the lifting component meets a 0
            fit = np.flatnonzero(scores >= threshold)
            fit = fit[self.ids[may[fit]] != own_id]
            if len(fit) > k:
                fit = fit[np.lexsort((self.ids[may[fit]], -scores[fit]))[:k]]
            for s, i in zip(scores[fit].tolist(), self.ids[may[fit]].tolist()):
                s = int(s)
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k and best[0][0] > threshold:
                threshold = best[0][0]
                limit = reach(threshold)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def quantized(vectors: DataFrame) -> DataFrame:
    """(vec_id, q): floor(256 x) of every component; vectors that are null or hold null or non-finite components are left out."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    fit = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(F.forall("embedding", lambda x: F.coalesce(finite(x), F.lit(False))))
    return fit.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("q"))


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.int64).reshape(len(flat), dim)


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates by integer inner product,
    ties to the smaller vec_id; every row but the query's own id is a candidate.

    Shorter vectors count as padded with zeros. Repeated ids are candidates each; a repeated query id is
    searched once, with its first vector in order. Fewer candidates than k give fewer rows; an empty table none. Other columns are ignored, whatever their names.
    Long vectors are searched whole; a page holds 16,384 vectors at most.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    raw = written(quantized(vectors), "vectors")
    size = raw.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dim"), F.max(F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x * x)).alias("lift")).first()
    n, dim = size["n"], size["dim"]
    if not n or not dim:
        return empty
    lift = float(size["lift"])
    padded = raw.select("vec_id", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("q"))).alias("q"))
    page_rows = min(16_384, max(256, n // 40))
    routes_wanted = min(MAX_ROUTES, max(1, n // page_rows))
    routes = np.array([r["q"] for r in padded.orderBy(F.xxhash64("vec_id"), "vec_id").limit(routes_wanted).collect()], np.float64)

    def lifted(v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return np.column_stack((v, np.sqrt(np.maximum(0.0, lift - (v * v).sum(axis=1)))))

    routing = lifted(routes)

    def deal(batches):
        for b in batches:
            a = lifted(_matrix(b.column(1), dim))
            d2 = (a * a).sum(axis=1)[:, None] + (routing * routing).sum(axis=1)[None] - 2 * a @ routing.T
            route = d2.argmin(axis=1)
            exact = np.sqrt(((a - routing[route]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(route.astype(np.int32)), pa.array(exact)], names=["vec_id", "q", "route", "distance"])

    dealt = written(padded.mapInArrow(deal, "vec_id long, q array<long>, route int, distance double"), "dealt-vectors")
    covers = dealt.groupBy("route").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()
    shares = {r["route"]: -(-r["n"] // page_rows) for r in covers}
    radius = {r["route"]: r["radius"] for r in covers}
    share_of = F.element_at(F.create_map(*[F.lit(x) for item in shares.items() for x in item]), F.col("route"))
    paged = dealt.withColumn("share", F.pmod(F.xxhash64("vec_id"), share_of).cast("int"))

    def grow(table: pa.Table) -> pa.Table:
        tree = Tree(_matrix(table.column("q"), dim), np.asarray(table.column("vec_id"), np.int64), lift)
        return pa.table({"route": table.column("route").slice(0, 1), "share": table.column("share").slice(0, 1), "tree": pa.array([pickle.dumps(tree, protocol=5)], pa.binary())})

    pages = written(paged.groupBy("route", "share").applyInArrow(grow, "route int, share int, tree binary"), "pages")
    queries = written(padded.filter(is_query).groupBy("vec_id").agg(F.min("q").alias("q")), "queries")
    blocks = -(-queries.count() // QUERY_BLOCK)

    def seeded(batches):
        names = ["query_id", "q", "least", "route", "share"]
        for b in batches:
            q = _matrix(b.column(1), dim)
            d = _to_routes(q, routing) - np.array([radius.get(i, np.inf) for i in range(len(routing))])[None]
            d[:, [i for i in range(len(routing)) if i not in shares]] = np.inf
            route = d.argmin(axis=1)
            share = [hash((int(i), 1)) % shares[int(r)] for i, r in zip(b.column(0).to_pylist(), route)]  # ids asked for may share factors with the number of shares
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(q), -np.inf)), pa.array(route.astype(np.int32)), pa.array(share, pa.int32())], names=names)

    def hopeful(batches):
        names = ["query_id", "q", "least", "route", "share"]
        live = sorted(shares)
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column(1), dim)
            low = np.maximum(0.0, _to_routes(q, routing)[:, live] - np.array([radius[i] for i in live])[None])
            length = (q.astype(np.float64) ** 2).sum(axis=1)
            least = np.array([-np.inf if x is None else x for x in b.column(2).to_pylist()], np.float64)
            allowed = length + lift - 2 * least + 1e-7 * (length + lift + 1)
            row, at = np.nonzero(low**2 <= allowed[:, None])
            seed_route, seed_share = b.column(3).to_pylist(), b.column(4).to_pylist()
            out = [(r, live[a], s) for r, a in zip(row.tolist(), at.tolist()) for s in range(shares[live[a]]) if (live[a], s) != (seed_route[r], seed_share[r])]
            take = pa.array([r for r, _, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(least).take(take), pa.array([x for _, x, _ in out], pa.int32()), pa.array([x for _, _, x in out], pa.int32())], names=names)

    asked = "query_id long, q array<long>, least double, route int, share int"

    def visited(asks: DataFrame) -> DataFrame:
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
        a = asks.withColumn("block", block("query_id"))
        p = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def look(left: pa.Table, right: pa.Table) -> pa.Table:
            found = []
            if left.num_rows and right.num_rows:
                tree = pickle.loads(right.column("tree")[0].as_py())
                ids, least = left.column("query_id").to_pylist(), left.column("least").to_pylist()
                for i, q, t in zip(ids, _matrix(left.column("q"), dim), least):
                    found += [(i, v, s) for s, v in tree.search(q, i, k, t, lift)]
            columns = list(zip(*found)) or [[], [], []]
            return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

        keys = ("route", "share", "block")
        return a.groupBy(*keys).cogroup(p.groupBy(*keys)).applyInArrow(look, "query_id long, vec_id long, score long")

    if not blocks:
        return empty
    seeds = written(queries.select(F.col("vec_id"), "q").mapInArrow(seeded, asked), "seed-asks")
    first = written(visited(seeds), "seed-results")
    to_beat = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"))
    rest = seeds.drop("least").join(to_beat, "query_id", "left").select("query_id", "q", "least", "route", "share").mapInArrow(hopeful, asked)
    both = first.unionByName(visited(rest))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _to_routes(q: np.ndarray, routing: np.ndarray) -> np.ndarray:
    a = np.column_stack((q.astype(np.float64), np.zeros(len(q))))
    d2 = (a * a).sum(axis=1)[:, None] + (routing * routing).sum(axis=1)[None] - 2 * a @ routing.T
    return np.sqrt(np.maximum(0.0, d2))
