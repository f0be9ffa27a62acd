"""Nearest neighbours by learned partitions.

The neighbour graph of a bounded sample is cut into balanced parts with few edges
between them; a small classifier learns which parts hold a vector's neighbours.
It puts every row of the table into its most probable part and routes every
query to as many of its most probable parts as held-out queries of the sample need;
what is found there is ranked by exact distance. Where the table fills more parts
than one classifier tells apart, each part is cut again by a classifier of its own,
learned from a bounded sample of the part and of vectors that look into it. Equal
vectors are searched and found once, with their smallest ids.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: The most vectors that parts are learned from (of the table, and of each part that is cut again), the edges of each, the rows a part should have and the most parts of one classifier.
SAMPLE, DEGREE, ROWS_PER_PART, MAX_PARTS = 6_000, 10, 512, 512
#: Vectors of other parts, on average, that the cut of a part is learned from, and rows that one task puts into the parts of a part.
VISITORS, CHUNK = 1_000, 32_768
HIDDEN, EPOCHS = 64, 30
#: Recall that routing must reach on held-out queries of the sample, and how many there are.
TARGET, TRIALS = 0.96, 400
#: Rows of a part that one task ranks queries against, and queries that it ranks at once.
BLOCK, QUERIES = 4096, 256
NEAREST, EVERY = 10, 100
RANKED = pa.schema([("rep", pa.int64()), ("part", pa.int32()), ("found", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))])


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, up to rounding."""
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T)


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row."""
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 512):
        d = distances(x[lo : lo + 512], x)
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        out[lo : lo + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def nearest_rows(queries: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of x nearest to each query, which is none of them."""
    out = np.empty((len(queries), k), np.int64)
    for lo in range(0, len(queries), 512):
        out[lo : lo + 512] = np.argpartition(distances(queries[lo : lo + 512], x), k - 1, axis=1)[:, :k]
    return out


def halve(nodes: np.ndarray, edges: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """True for one half of ``nodes``: split at the median of the second eigenvector of the graph among them, then swapped while that cuts fewer edges."""
    n = len(nodes)
    place = np.full(max(nodes.max(), edges.max() if len(edges) else 0) + 1, -1)
    place[nodes] = np.arange(n)
    a, b = place[edges[:, 0]], place[edges[:, 1]]
    inside = (a >= 0) & (b >= 0)
    a, b = np.concatenate([a[inside], b[inside]]), np.concatenate([b[inside], a[inside]])
    degree = np.bincount(a, minlength=n) + 1.0
    v = rng.normal(size=n)
    for _ in range(60):
        v -= (v * degree).sum() / degree.sum()
        v = (np.bincount(a, weights=v[b], minlength=n) + v) / degree
        v /= np.abs(v).max() + 1e-12
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(20):
        # What a node's move would save; the best of either side change places.
        to_other = np.bincount(a, weights=side[a] != side[b], minlength=n)
        gain = 2 * to_other - np.bincount(a, minlength=n)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        swap = np.flatnonzero(gain[left[:m]] + gain[right[:m]] > 2)[: max(1, n // 50)]
        if not len(swap):
            break
        kept, before = side.copy(), (side[a] != side[b]).sum()
        side[left[swap]], side[right[swap]] = True, False
        if (side[a] != side[b]).sum() >= before:
            side = kept
            break
    return side


def partition(edges: np.ndarray, n: int, parts: int, seed: int = 5) -> np.ndarray:
    """Part of each of n nodes: halves of halves, so sizes differ by few nodes. ``parts`` is a power of two."""
    rng, out = np.random.default_rng(seed), np.zeros(n, np.int64)
    for _ in range(int(math.log2(parts))):
        doubled = np.empty(n, np.int64)
        for p in np.unique(out):
            nodes = np.flatnonzero(out == p)
            doubled[nodes] = 2 * p + (halve(nodes, edges, rng) if len(nodes) > 1 else 0)
        out = doubled
    return out


@dataclass
class Router:
    """A classifier with one hidden layer over scaled vectors, and how many parts a query looks into."""

    parts: int
    probes: int
    mean: np.ndarray
    scale: float
    layers: list[np.ndarray]

    def chances(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        h = np.maximum(0, z @ self.layers[0] + self.layers[1])
        e = h @ self.layers[2] + self.layers[3]
        e = np.exp(e - e.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.chances(x).argmax(1) if self.parts > 1 else np.zeros(len(x), np.int64)

    def routes(self, x: np.ndarray, probes: int | None = None) -> np.ndarray:
        return np.argsort(-self.chances(x), axis=1, kind="stable")[:, : probes or self.probes] if self.parts > 1 else np.zeros((len(x), 1), np.int64)


def learn(x: np.ndarray, rows: int, target: float = TARGET, seed: int = 5, rows_per_part: int = ROWS_PER_PART, max_parts: int = MAX_PARTS, visitors: np.ndarray | None = None) -> Router:
    """A router from the sample x of a table of ``rows`` different vectors; one part if they would fill less than two.

    ``visitors`` are vectors that ask but are not in the table: their neighbours in x are learned and tried like those of x.
    """
    parts = 1 << max(0, min(int(math.log2(max_parts)), int(math.log2(max(1, rows / rows_per_part)))))
    width = x.shape[1] if x.ndim == 2 else 0
    if parts == 1 or len(x) < 8 * parts:
        return Router(1, 1, np.zeros(width), 1.0, [])
    rng = np.random.default_rng(seed)
    near = neighbours(x, DEGREE)
    edges = np.unique(np.sort(np.stack([np.repeat(np.arange(len(x)), DEGREE), near.ravel()], 1), axis=1), axis=0)
    part = partition(edges, len(x), parts, seed)
    members, truth = x, neighbours(x, NEAREST)
    if visitors is not None and len(visitors):
        near, truth = np.concatenate([near, nearest_rows(visitors, x, DEGREE)]), np.concatenate([truth, nearest_rows(visitors, x, NEAREST)])
        x = np.concatenate([x, visitors])
    # To be learned: where a vector's neighbours are, itself counted as two of them.
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), DEGREE), part[near].ravel()), 1)
    goal[np.arange(len(members)), part] += 2
    goal /= goal.sum(1, keepdims=True)
    router = Router(parts, parts, x.mean(0), float(x.std() + 1e-12), [rng.normal(0, math.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, math.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)])
    trials = rng.permutation(len(x))[: min(TRIALS, len(x) // 5)]
    fit_on = np.setdiff1d(np.arange(len(x)), trials)
    z = (x - router.mean) / router.scale
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in router.layers]
    step = 0
    for _ in range(EPOCHS):
        for pick in np.array_split(rng.permutation(fit_on), max(1, len(fit_on) // 128)):
            pre = z[pick] @ router.layers[0] + router.layers[1]
            h = np.maximum(0, pre)
            e = h @ router.layers[2] + router.layers[3]
            e = np.exp(e - e.max(1, keepdims=True))
            d = (e / e.sum(1, keepdims=True) - goal[pick]) / len(pick)
            back = (d @ router.layers[2].T) * (pre > 0)
            step += 1
            for p, g, (m, v) in zip(router.layers, [z[pick].T @ back, back.sum(0), h.T @ d, d.sum(0)], moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 3e-3 * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) + 1e-4 * p)
    home, order = router.home(members), router.routes(x[trials], parts)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(len(trials), 0), 1)
    needed = np.take_along_axis(rank, home[truth[trials]], 1)  # how many parts come before the one that holds the neighbour
    found = [(needed < m).mean() for m in range(1, parts + 1)]
    router.probes = 1 + int(np.argmax(np.array(found) >= target))
    return router


def rank_block(queries: np.ndarray, rows: np.ndarray, k: int):
    """(query, row, distance) of the k nearest rows of each query and all that tie, by exact differences in double precision."""
    d = distances(queries, rows)
    k = min(k, len(rows))
    bound = np.partition(d, k - 1, axis=1)[:, k - 1]
    slack = 1e-9 * ((queries * queries).sum(1) + (rows * rows).sum(1).max())
    q, r = np.nonzero(d <= (bound + slack)[:, None])
    return q, r, np.sqrt(((queries[q] - rows[r]) ** 2).sum(1))


def search(vectors: DataFrame, is_query: Column, nearest: int = NEAREST, router: Router | None = None, rows_per_part: int = ROWS_PER_PART, max_parts: int = MAX_PARTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each row (vec_id, embedding) for which ``is_query`` holds, itself excepted.

    Null, zero or non-finite vectors and null ids take no part. Vectors of different
    lengths have no distance, so each length is searched by itself, with a router of
    its own (``router`` is for those of its width, whose parts are not cut again). Rows that repeat id and vector
    count once; an id with several vectors is found by each. Ties go to the smaller id.
    """
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    widths = sorted(r["width"] for r in good.select(F.size("embedding").alias("width")).distinct().collect())  # a row a length
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = empty
    for width in widths:
        own = router if router is not None and len(router.mean) == width else None
        of_width = search_width(good.filter(F.size("embedding") == width), is_query, width, nearest, own, rows_per_part, max_parts)
        found = of_width if found is empty else found.unionByName(of_width)
    return found


HOME = "rep long, part int"


def placed(rows: DataFrame, router: Router, width: int, spread: bool, besides: int = 0) -> DataFrame:
    """(rep, part) of rows (rep, embedding): the part that a row belongs to, or those that it looks into (``spread``), but for the first ``besides``."""

    def place(batches):
        for b in batches:
            x = _matrix(b.column(1), width)
            to = (router.routes(x) if spread else router.home(x)[:, None])[:, besides:]
            at = np.repeat(np.arange(len(x)), to.shape[1])
            rep = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(to.ravel().astype(np.int32))], names=["rep", "part"])

    return rows.select("rep", "embedding").mapInArrow(place, HOME)


def per_part(values: dict[int, float], parts: int) -> Column:
    """A part's value, 0 where it has none; ``parts`` of one classifier, so no more than its most."""
    return F.element_at(F.array(*[F.lit(float(values.get(p, 0))) for p in range(parts)]), F.col("part") + 1)


def learn_inner(classes: DataFrame, homes: DataFrame, router: Router, width: int, rows_per_part: int, max_parts: int, target: float) -> DataFrame:
    """(part, model): a router for each part, learned from a sample of the part and of vectors of other parts that look into it."""
    counts = {r["part"]: r["n"] for r in homes.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a part
    draw = lambda name: F.pmod(F.xxhash64(F.lit(name), "embedding"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(float(SAMPLE)) / F.greatest(per_part(counts, router.parts), F.lit(1.0))
    members = classes.select("rep", "embedding").join(homes, "rep").filter(draw("member") < share).select("part", "embedding", F.lit(True).alias("member"))
    asking = classes.filter(draw("visitor") < VISITORS * router.parts / max(1.0, sum(counts.values()) * max(1, router.probes - 1)))
    visits = placed(asking, router, width, True, besides=1).join(asking.select("rep", "embedding"), "rep").select("part", "embedding", F.lit(False).alias("member"))

    def fit(table: pa.Table) -> pa.Table:
        part, x, member = table.column("part")[0].as_py(), _matrix(table.column("embedding"), width), np.array(table.column("member").to_pylist(), bool)
        ordered = lambda v: v[np.lexsort(v.T)]
        own = learn(ordered(x[member]), counts.get(part, 0), target, rows_per_part=rows_per_part, max_parts=max_parts, visitors=ordered(x[~member]))
        return pa.table({"part": pa.array([part], pa.int32()), "model": pa.array([pickle.dumps(own)], pa.binary())})

    return cut(members.unionByName(visits).groupBy("part").applyInArrow(fit, "part int, model binary"), "ann-models")


def refined(rows: DataFrame, models: DataFrame, parts: int, width: int, max_parts: int, spread: bool) -> DataFrame:
    """(rep, part) of rows (rep, part, embedding) put into the parts of their part; a part's rows go to as many tasks as they fill."""
    rows = cut(rows, "ann-placed")
    counts = {r["part"]: math.ceil(r["n"] / CHUNK) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a part
    chunks = F.greatest(per_part(counts, parts), F.lit(1.0)).cast("int")

    def place(some: pa.Table, model: pa.Table) -> pa.Table:
        if not len(some):
            return pa.table({"rep": pa.array([], pa.int64()), "part": pa.array([], pa.int32())})
        part, x = some.column("part")[0].as_py(), _matrix(some.column("embedding"), width)
        own = pickle.loads(model.column("model")[0].as_py()) if len(model) else Router(1, 1, np.zeros(width), 1.0, [])
        to = own.routes(x) if spread else own.home(x)[:, None]
        rep = some.column("rep").to_numpy()[np.repeat(np.arange(len(x)), to.shape[1])]
        return pa.table({"rep": pa.array(rep), "part": pa.array((part * max_parts + to.ravel()).astype(np.int32))})

    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), chunks.cast("long")).cast("int")).groupBy("part", "chunk")
    copied = models.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).groupBy("part", "chunk")
    return dealt.cogroup(copied).applyInArrow(place, HOME)


def search_width(good: DataFrame, is_query: Column, width: int, nearest: int, router: Router | None, rows_per_part: int, max_parts: int = MAX_PARTS) -> DataFrame:
    """``search`` among usable vectors of one length."""
    # One row per different vector, with its smallest ids: no more can be among the nearest.
    same = W.partitionBy("embedding").orderBy("vec_id")
    smallest = good.distinct().withColumn("turn", F.row_number().over(same)).filter(F.col("turn") <= nearest + 1)
    classes = cut(smallest.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.xxhash64(F.get("ids", F.lit(0)), F.col("embedding"))), "ann-vectors")
    inner = False
    if router is None:
        n = classes.count()
        inner = n >= 2 * max_parts * rows_per_part
        target = math.sqrt(TARGET) if inner else TARGET  # of each of two cuts
        scale = 1 << 30
        drawn = classes.filter(F.pmod(F.xxhash64(F.lit("sample"), "embedding"), F.lit(scale)) < int(min(1.0, SAMPLE / max(1, n)) * scale)).select("embedding").toArrow()
        sample = _matrix(drawn.column(0), width)
        router = learn(sample[np.lexsort(sample.T)], n, target, rows_per_part=rows_per_part, max_parts=max_parts)
    homes = cut(placed(classes, router, width, False), "ann-homes")
    asking = good.filter(is_query).join(classes.select(F.col("embedding").alias("e"), "rep"), F.col("embedding") == F.col("e")).select("vec_id", "rep").distinct()
    asking = cut(asking, "ann-queries")
    asked = cut(classes.join(asking.select("rep").distinct(), "rep", "left_semi").select("rep", "embedding"), "ann-asked")
    routes = placed(asked, router, width, True)
    if inner:
        models = learn_inner(classes, homes, router, width, rows_per_part, max_parts, target)
        homes = cut(refined(classes.select("rep", "embedding").join(homes, "rep").select("rep", "part", "embedding"), models, router.parts, width, max_parts, False), "ann-inner-homes")
        routes = refined(routes.join(asked, "rep").select("rep", "part", "embedding"), models, router.parts, width, max_parts, True)
    # A row a part, so at most MAX_PARTS squared rows of two numbers are broadcast.
    sizes = F.broadcast(homes.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    stored = classes.join(homes, "rep").join(sizes, "part").select("part", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int").alias("block"), "embedding", "ids")
    routed = routes.join(asked, "rep").join(sizes, "part")
    routed = routed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("part", "block", "rep", "embedding")
    k = nearest + 1

    def rank(queries: pa.Table, rows: pa.Table) -> pa.Table:
        """A row a query with the list of its k nearest here."""
        if not len(queries) or not len(rows):
            return RANKED.empty_table()
        x, ids = _matrix(rows.column("embedding"), width), rows.column("ids").combine_chunks()
        offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        reps, part, y, out = queries.column("rep").to_numpy(), queries.column("part")[0], _matrix(queries.column("embedding"), width), []
        for lo in range(0, len(y), QUERIES):
            q, r, d = rank_block(y[lo : lo + QUERIES], x, k)
            many = offsets[r + 1] - offsets[r]
            at = np.repeat(np.arange(len(q)), many)
            vec = flat[np.repeat(offsets[r], many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]
            order = np.lexsort((vec, d[at], q[at]))
            first = np.searchsorted(q[at][order], q[at][order])
            kept = order[np.arange(len(order)) - first < k]
            n = len(y[lo : lo + QUERIES])
            ends = np.searchsorted(q[at][kept], np.arange(n + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(d[at][kept]), pa.array(vec[kept])], names=["score", "vec_id"])
            out.append(pa.record_batch([pa.array(reps[lo : lo + n]), pa.array([part.as_py()] * n, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pairs)], schema=RANKED))
        return pa.Table.from_batches(out)

    found = routed.groupBy("part", "block").cogroup(stored.groupBy("part", "block")).applyInArrow(rank, "rep long, part int, found array<struct<score:double,vec_id:long>>")
    # Lists of k meet by part, then by query: no list is longer than k times a part's blocks or a query's parts.
    nearest_of = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found")
    lists = found.groupBy("rep", "part").agg(nearest_of).groupBy("rep").agg(nearest_of)
    told = asking.join(lists, "rep").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("vec_id")), 1, nearest).alias("found"))
    return told.select("query_id", F.posexplode("found").alias("at", "f")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def _matrix(column, width: int) -> np.ndarray:
    """A list column as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunks
            return np.empty((0, width))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
