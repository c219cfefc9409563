"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers, ``floor(1024 * x)``.  The first level of the trees is
a net of pivots from a bounded sample: every row belongs to its nearest pivot,
and each pivot's rows form one or more data blocks.  Queries, in the order of
their pivots, form chunks.  The sample gives every query a first kth score; a
query travels to a block only if the block's pivot and covering radius allow a
better one, so rows are copied once per chunk and not once per block.

Where a chunk meets a block a cover tree is built over either side, and both
are descended together: a pair of nodes is dropped when its greatest possible
inner product, from the centres and covering radii, is below the worst kth
score of the node's queries, and in a query leaf each query is held against
its own.  A node's children are a net of its points at a smaller scale, each
with the points near it; points that no scale gathers form one leaf, which is
searched as a block.  That leaf is the exact fallback: vectors that lie evenly
in many dimensions have no covering radius small enough to drop anything.

The search is exact: bounds only drop what cannot enter a result.  Ties go to
the smaller vec_id; repeated vectors are all candidates; repeated vec_ids are
separate candidates.  Null vectors, null keys, and vectors with null or
non-finite components take no part; vectors of different lengths have no inner
product.  Scores are exact as long as they fit a long.  An empty table gives
an empty result; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import Store
from .tables import read_table

SCALE = 1024
K = 10
QUERY_STEP = 100
SAMPLE = 2048
#: Pivots: as many as there are blocks of rows, within these limits.
PIVOTS, MOST_PIVOTS = 16, 1024
DATA_BLOCK = 16_384
QUERY_CHUNK = 16_384
#: Points of a leaf, of data and of queries.
DATA_LEAF, QUERY_LEAF = 128, 32
#: Each level's scale over that of the next.
RATIO = 1.3
#: Points that compete to be centres at once, and how many a centre must gather on average.
NET, GATHER = 512, 4
#: Points of a block and pairs scored at once, and what a bound allows for rounding.
BATCH, FLAT, ROUNDING = 1024, 1 << 16, 1e-12
#: One pair in so many must survive for a block to be cheaper than single pairs.
DENSE = 4
NONE = np.iinfo(np.int64).min


@dataclass
class Node:
    """Points within ``radius`` of ``centre``; leaves hold their places, inner nodes their children too."""

    centre: np.ndarray
    radius: float
    places: np.ndarray
    children: list[Node] = field(default_factory=list)

    def close(self) -> None:
        """Lay the children's centres, radii and norms side by side."""
        self.centres = np.stack([c.centre for c in self.children])
        self.radii = np.array([c.radius for c in self.children])
        self.norms = np.sqrt((self.centres * self.centres).sum(1))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of all rows to all centres; good enough to choose by, not to bound with."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0))


def _net(x: np.ndarray, places: np.ndarray, reach: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """((centre, places) of points within ``reach`` of centres that lie farther than that apart, places not gathered)."""
    groups: list[tuple[np.ndarray, np.ndarray]] = []
    alone: list[np.ndarray] = []
    centres, gathered, left = 0, 0, places
    while len(left):
        some = x[left[:NET]]
        apart = _distances(some, some) > reach
        free, chosen = np.ones(len(some), bool), []
        for i in range(len(some)):
            if free[i]:
                chosen.append(i)
                free &= apart[i]
        dist = _distances(x[left], some[chosen])
        near = dist.argmin(1)
        inside = dist[np.arange(len(left)), near] <= reach
        inside[chosen], near[chosen] = True, np.arange(len(chosen))
        order = np.argsort(near, kind="stable")
        order = order[inside[order]]
        for mine in np.split(order, np.nonzero(np.diff(near[order]))[0] + 1):
            if len(mine) > 1:
                groups.append((some[chosen[near[mine[0]]]], left[mine]))
            else:
                alone.append(left[mine])
        centres, gathered = centres + len(chosen), gathered + len(order)
        left = left[~inside]
        if gathered < GATHER * centres:
            break
    return groups, np.concatenate([left, *alone])


def _radius(x: np.ndarray, centre: np.ndarray) -> float:
    return float(np.sqrt(((x - centre) ** 2).sum(1).max())) * (1 + ROUNDING)


def build_tree(x: np.ndarray, leaf: int = DATA_LEAF) -> Node:
    """Cover tree over the rows of ``x`` (float64)."""
    root = Node(x[0], _radius(x, x[0]), np.arange(len(x)))
    work = [root]
    while work:
        node = work.pop()
        if len(node.places) <= leaf or node.radius == 0:
            continue
        groups, rest = _net(x, node.places, node.radius / RATIO)
        if len(groups) == 1 and not len(rest):  # a better centre of the same points: try from there
            node.centre = groups[0][0]
            node.radius = _radius(x[node.places], node.centre)
            work.append(node)
            continue
        if not groups:
            continue  # no scale gathers these points: a leaf
        node.children = [Node(c, _radius(x[p], c), p) for c, p in groups]
        work += node.children
        if len(rest):
            middle = x[rest].mean(0)
            node.children.append(Node(middle, _radius(x[rest], middle), rest))
            if 2 * len(rest) <= len(node.places):
                work.append(node.children[-1])
        node.close()
    return root


class TopK:
    """The best k (score, id) of each query, ties to the smaller id; ``scored`` and ``bounded`` count the work."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.scored, self.bounded = k, 0, 0
        self.score = np.full((queries, k), NONE)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.floor = floor.astype(np.int64)  # scores below it are known not to be among the best k

    def offer(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge scored pairs: the query's place, the score, the row's id."""
        self.scored += len(owner)
        good = (score >= self.floor[owner]) & (score != NONE)
        if not good.any():
            return
        owner, score, ids = owner[good], score[good], ids[good]
        mine = np.unique(owner)
        owner = np.concatenate([owner, np.repeat(mine, self.k)])
        score = np.concatenate([score, self.score[mine].ravel()])
        ids = np.concatenate([ids, self.id[mine].ravel()])
        order = np.lexsort((ids, ~score, owner))
        take = order[np.searchsorted(owner[order], mine)[:, None] + np.arange(self.k)]
        self.score[mine], self.id[mine] = score[take], ids[take]
        self.floor[mine] = np.maximum(self.floor[mine], self.score[mine, -1])


def dual_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, floor: np.ndarray, k: int = K) -> TopK:
    """Best k rows of ``data`` for each query; a row with the query's own id is no candidate."""
    top = TopK(len(queries), k, floor)
    if not len(queries) or not len(data):
        return top
    q, d = queries.astype(np.float64), data.astype(np.float64)
    size = np.sqrt((q * q).sum(1))
    exact = max(1.0, np.abs(q).max()) * max(1.0, np.abs(d).max()) * q.shape[1] < 2**52

    def block(asks: np.ndarray, places: np.ndarray, seen: np.ndarray | None = None) -> None:
        """Score all queries against all places but the pairs ``seen`` before."""
        for lo in range(0, len(places), BATCH):
            part = places[lo : lo + BATCH]
            scores = (q[asks] @ d[part].T).astype(np.int64) if exact else queries[asks] @ data[part].T
            scores[query_ids[asks][:, None] == data_ids[part]] = NONE
            if seen is not None:
                scores[seen[:, lo : lo + BATCH]] = NONE
            row, col = np.nonzero(scores >= top.floor[asks][:, None])
            top.scored += scores.size - len(row)
            top.offer(asks[row], scores[row, col], data_ids[part[col]])

    def leaves(asks: np.ndarray, found: list[Node], bound: np.ndarray) -> None:
        """Score each query against the leaves that its bounds allow, its most promising first, twice as many a time.

        Where the bounds hold back little, all that is left is one block.
        """
        rank, done, take = np.argsort(-bound, 1, kind="stable"), 0, 1
        while done < len(found):
            now = rank[:, done : done + take]
            ask, at = np.nonzero(np.take_along_axis(bound, now, 1) >= top.floor[asks][:, None])
            if not len(ask):
                return  # what is left has lower bounds still
            if done:
                rest = rank[:, done:]
                left = np.take_along_axis(bound, rest, 1) >= top.floor[asks][:, None]
                if DENSE * left.sum() >= left.size:
                    some, many = np.nonzero(left.any(1))[0], np.unique(rest[left])
                    seen = np.zeros(bound.shape, bool)
                    np.put_along_axis(seen, rank[:, :done], True, 1)
                    sizes = [len(found[j].places) for j in many]
                    block(asks[some], np.concatenate([found[j].places for j in many]), np.repeat(seen[np.ix_(some, many)], sizes, 1))
                    return
            done, take = done + now.shape[1], take * 2
            pick = now[ask, at]
            owner, place = asks[np.repeat(ask, [len(found[j].places) for j in pick])], np.concatenate([found[j].places for j in pick])
            for lo in range(0, len(owner), FLAT):
                o, i = owner[lo : lo + FLAT], place[lo : lo + FLAT]
                scores = np.einsum("ij,ij->i", q[o], d[i]).astype(np.int64) if exact else np.einsum("ij,ij->i", queries[o], data[i])
                top.offer(o, np.where(query_ids[o] == data_ids[i], NONE, scores), data_ids[i])

    def limits(centre: np.ndarray, norm: np.ndarray, radius: float, b: Node) -> np.ndarray:
        """Greatest inner product of points near each centre with points of each child of ``b``."""
        top.bounded += len(centre) * len(b.children)
        bound = centre @ b.centres.T + norm[:, None] * b.radii + radius * (b.norms + b.radii)
        return bound + ROUNDING * (norm[:, None] + radius) * (b.norms + b.radii) + 1e-6

    stack = [(a, a.places, b) for a, b in [(build_tree(q, QUERY_LEAF), build_tree(d))]]
    while stack:
        a, asks, b = stack.pop()
        if not b.children and not a.children:
            block(asks, b.places)
        elif a.children and (not b.children or a.radius >= b.radius):
            stack += [(c, c.places, b) for c in a.children]
        elif a.children:
            bound = limits(a.centre[None], np.sqrt(a.centre @ a.centre)[None], a.radius, b)[0]
            best = np.argsort(bound, kind="stable")  # the most promising is popped first
            stack += [(a, asks, b.children[j]) for j in best[bound[best] >= top.floor[asks].min()]]
        else:
            bound = limits(q[asks], size[asks], 0.0, b)
            flat = np.array([not c.children for c in b.children])
            if flat.any():
                leaves(asks, [c for c in b.children if not c.children], bound[:, flat])
            hit = bound >= top.floor[asks][:, None]
            for j in np.argsort(bound.max(0), kind="stable"):
                if not flat[j] and hit[:, j].any():
                    stack.append((a, asks[hit[:, j]], b.children[j]))
    return top


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): valid vectors as integers."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    v = F.transform(x, lambda c: F.floor(c * SCALE).cast("long"))
    return df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(~F.exists(x, bad)).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))


def _pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first pivots among the sample."""
    chosen, dist = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < most and dist.max() > 0:
        chosen.append(int(dist.argmax()))
        dist = np.minimum(dist, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _search_width(vectors: DataFrame, store: Store, width: int, k: int, step: int) -> DataFrame:
    """Search among the vectors of one length."""
    spark = vectors.sparkSession
    drawn = sorted((r.vec_id, r.v) for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect())
    sample_ids, sample = np.array([r[0] for r in drawn]), np.array([r[1] for r in drawn], np.int64)
    pivots = _pivots(sample.astype(np.float64), min(MOST_PIVOTS, max(PIVOTS, vectors.count() // DATA_BLOCK)))
    shared = spark.sparkContext.broadcast((pivots, sample, sample_ids))  # at most MOST_PIVOTS + SAMPLE vectors

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, sample, sample_ids = shared.value
        known = sample.astype(np.float64)
        slack = ROUNDING * np.sqrt((known * known).sum(1).max())
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                x, ids = _matrix(part.column("v"), width).astype(np.float64), part.column("vec_id").to_numpy()
                near = _distances(x, pivots).argmin(1)
                radius = np.sqrt(((x - pivots[near]) ** 2).sum(1))
                floor = np.full(len(x), NONE)
                asks = np.nonzero(ids % step == 0)[0]
                if len(asks) and len(known) >= k:
                    scores = x[asks] @ known.T
                    scores[ids[asks][:, None] == sample_ids] = -np.inf
                    kth = np.partition(scores, -k, axis=1)[:, -k]
                    some = np.isfinite(kth)
                    floor[asks[some]] = np.floor(kth[some] - slack * np.sqrt((x[asks[some]] ** 2).sum(1)))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(near.astype(np.int32)), pa.array(radius), pa.array(floor)], ["vec_id", "v", "pivot", "radius", "floor"])

    placed = vectors.mapInArrow(assign, "vec_id long, v array<long>, pivot int, radius double, floor long")
    placed = store.put(placed.withColumn("row", F.monotonically_increasing_id()), f"placed{width}")
    asks = F.col("vec_id") % step == 0
    # One row a pivot.
    stats = sorted(placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("r"), F.sum(asks.cast("long")).alias("nq"), F.max(F.when(asks, F.col("radius"))).alias("rq"), F.min(F.when(asks, F.col("floor"))).alias("floor")).collect())
    blocks = {s.pivot: -(-s.n // DATA_BLOCK) for s in stats}
    chunks, number, held = {}, 0, 0
    for s in stats:
        if s.nq and held and held + s.nq > QUERY_CHUNK:
            number, held = number + 1, 0
        if s.nq:
            parts = -(-s.nq // QUERY_CHUNK)
            chunks[s.pivot] = (number, parts)
            number, held = number + parts - 1, (s.nq if parts == 1 else QUERY_CHUNK)
    norm = np.sqrt((pivots * pivots).sum(1))
    reach = {s.pivot: s.r for s in stats}
    asked: dict[int, set[int]] = {}
    for a in stats:
        for b in stats if a.nq else ():
            size = (norm[a.pivot] + a.rq) * (norm[b.pivot] + b.r)
            if pivots[a.pivot] @ pivots[b.pivot] + norm[a.pivot] * b.r + norm[b.pivot] * a.rq + a.rq * b.r + ROUNDING * size + 1e-3 >= a.floor:
                first, parts = chunks[a.pivot]
                asked.setdefault(b.pivot, set()).update(range(first, first + parts))
    meets = spark.sparkContext.broadcast(reach)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pivots at which a query may do better than its floor."""
        far = np.array([meets.value.get(i, -np.inf) for i in range(len(pivots))])
        for b in batches:
            x = _matrix(b.column("v"), width).astype(np.float64)
            size = np.sqrt((x * x).sum(1))[:, None]
            bound = x @ pivots.T + size * far + ROUNDING * size * (norm + np.maximum(far, 0)) + 1e-3
            hit = (bound >= b.column("floor").to_numpy()[:, None]) & np.isfinite(far)
            ends = np.concatenate([[0], np.cumsum(hit.sum(1))])
            to = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(hit)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, to], [*b.schema.names, "to"])

    dealt = lambda parts: F.pmod(F.xxhash64("row"), parts).cast("int")
    own = spark.createDataFrame([(p, first, parts) for p, (first, parts) in chunks.items()] or [(-1, 0, 1)], "pivot int, first int, parts int")
    there = spark.createDataFrame([(p, blocks[p]) for p in blocks] or [(-1, 1)], "pivot int, parts int")
    home = spark.createDataFrame([(p, blocks[p], sorted(c)) for p, c in asked.items()] or [(-1, 1, [0])], "pivot int, parts int, chunks array<int>")
    routed = placed.filter(asks).mapInArrow(route, "vec_id long, v array<long>, pivot int, radius double, floor long, row long, to array<int>")
    # Each of these tables has one row a pivot.
    ask_rows = routed.join(F.broadcast(own), "pivot").withColumn("chunk", F.col("first") + dealt(F.col("parts"))).select("vec_id", "v", "floor", "chunk", F.explode("to").alias("pivot"))
    ask_rows = ask_rows.join(F.broadcast(there), "pivot").select("vec_id", "v", "floor", "chunk", "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    data_rows = store.get(f"placed{width}").join(F.broadcast(home), "pivot").select("vec_id", "v", F.explode("chunks").alias("chunk"), "pivot", dealt(F.col("parts")).alias("block"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        qi, di = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        order, order_d = np.argsort(qi, kind="stable"), np.argsort(di, kind="stable")
        top = dual_search(_matrix(left.column("v"), width)[order], qi[order], _matrix(right.column("v"), width)[order_d], di[order_d], left.column("floor").to_numpy()[order], k)
        row, col = np.nonzero(top.score != NONE)
        return pa.table({"query_id": qi[order][row], "vec_id": top.id[row, col], "score": top.score[row, col]})

    met = ["chunk", "pivot", "block"]
    found = ask_rows.groupBy(*met).cogroup(data_rows.groupBy(*met)).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(embeddings: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row whose vec_id is divisible by ``step``."""
    store = Store(embeddings.sparkSession, "covertree")
    vectors = store.put(integer_vectors(embeddings), "vectors")
    widths = [r.w for r in vectors.select(F.size("v").alias("w")).distinct().collect()]
    parts = [_search_width(vectors.filter(F.size("v") == w), store, w, k, step) for w in sorted(widths) if w > 0]
    if not parts:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products for every hundredth vector."""
    return top_k(read_table(spark, sf_dir, "embeddings"))


#: The same result by definition, for DuckDB.
ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""
