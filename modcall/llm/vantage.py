"""Nearest neighbours by inner product with vantage-point trees, one for each shard of rows.

With one more component, which brings all vectors of a shard to the shard's largest norm, the largest inner product is
the smallest Euclidean distance, so the triangle inequality holds. A shard's tree splits its points at the median
distance from a vantage point, again and again, down to leaves; a leaf's rings around all vantage points above it give
a lower bound of its distance from a query. A leaf is passed over if the bound times a factor is above the distance of
the query's k-th best so far: factor one searches exactly, a larger one passes over more.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .blocks import Best, group_numbers, matrix, meet, one_each, packed_groups, packed_rows, vectors
from .common import materialize

#: Most points of a leaf; queries that are looked at together.
LEAF, TOGETHER = 64, 512
NOT_ZERO = "exists(v, e -> e <> 0)"


def build(x):
    """The tree over the rows of a float64 matrix: an order of the rows, the splits and the largest norm.

    A split (begin, middle, end, four distances) is about the rows of that range in the new order: the vantage point,
    those inside up to `middle` and those outside, with the least and largest distance from the vantage point of each.
    """
    norm = np.sqrt(np.square(x).sum(1))
    top = norm.max()
    lift = np.sqrt(np.maximum(0, top * top - norm * norm))
    order, splits, todo = np.arange(len(x)), [], [(0, len(x))]

    def far(point, rows):
        return np.sqrt(np.square(x[rows] - x[point]).sum(1) + np.square(lift[rows] - lift[point]))

    while todo:
        a, b = todo.pop()
        if b - a <= LEAF:
            continue
        rows = order[a:b]
        pick = int(far(rows[0], rows).argmax())  # a point at the rim splits best
        rows[[0, pick]] = rows[[pick, 0]]
        d = far(rows[0], rows[1:])
        half = len(d) // 2
        by = np.argpartition(d, half)
        order[a + 1 : b] = rows[1:][by]
        d = d[by]
        middle = a + 1 + half
        splits.append((a, middle, b, d[:half].min(), d[:half].max(), d[half:].min(), d[half:].max()))
        todo += [(a + 1, middle), (middle, b)]
    return order, np.array(splits, np.float64).reshape(-1, 7), top


def _pack_shard(d, table):
    x = matrix(table.column("v")).reshape(-1, d)
    with np.errstate(over="ignore", invalid="ignore"):
        order, splits, top = build(x)
    kept = np.float32 if table.schema.field("v").type.value_type == pa.float32() else np.float64
    head = np.array([len(x), len(splits), kept == np.float32], np.int64)
    ids = np.asarray(table.column("id"))[order]
    return b"".join(part.tobytes() for part in (head, ids, splits, np.float64([top]), x[order].astype(kept)))


class Shard:
    def __init__(self, d: int, data):
        n, s, single = np.frombuffer(data, np.int64, 3).tolist()
        self.ids = np.frombuffer(data, np.int64, n, 24)
        at = 24 + 8 * n
        self.splits = np.frombuffer(data, np.float64, 7 * s, at).reshape(s, 7)
        at += 56 * s
        self.top = np.frombuffer(data, np.float64, 1, at)[0]
        self.x = np.frombuffer(data, np.float32 if single else np.float64, n * d, at + 8).reshape(n, d).astype(np.float64)

    def leaves(self, distance):
        """The leaves (begin, end) and, by leaf and query, the lower bounds of their distances.

        distance: from each query (row) to each split's vantage point (column)."""
        done, found, todo = {int(p[0]): i for i, p in enumerate(self.splits)}, [], [(0, len(self.ids), np.zeros(len(distance)))]
        bounds = []
        while todo:
            a, b, bound = todo.pop()
            if b - a <= LEAF:
                if a < b:
                    found.append((a, b))
                    bounds.append(bound)
                continue
            i = done[a]
            _, middle, _, in_least, in_most, out_least, out_most = self.splits[i]
            own = distance[:, i]
            for begin, stop, least, most in ((a + 1, int(middle), in_least, in_most), (int(middle), b, out_least, out_most)):
                todo.append((begin, stop, np.maximum(bound, np.maximum(own - most, least - own))))
        return found, np.array(bounds).reshape(len(found), len(distance))


def exact(q, x):
    """Inner products of the rows of two matrices, summed component by component in double precision, so that equal
    vectors have equal scores wherever they stand."""
    out = np.zeros(len(q))
    for a, b in zip(q.T, x.T, strict=True):
        out += a * b
    return out


class Search:
    """The k best rows of every query of a group, over any number of shards."""

    def __init__(self, d: int, ids, q, k: int, factor: float):
        self.d, self.ids, self.q, self.factor = d, ids, q, factor
        self.size = np.sqrt(np.square(q).sum(1))
        self.best = [Best(len(range(a, min(a + TOGETHER, len(q)))), k, np.float64) for a in range(0, len(q), TOGETHER)]
        self.looked = self.met = 0

    def _look(self, shard, best, base, rows, points, scores):
        """Offer the points (columns of scores) to the queries `rows` (from base), if they can be among their best."""
        slack = 1e-12 * (1 + self.size[base + rows] * shard.top)
        i, j = np.nonzero(~(scores < (best.low[rows] - slack)[:, None]))
        i, j = rows[i], points[j]
        other = self.ids[base + i] != shard.ids[j]
        i, j = i[other], j[other]
        best.add(i, exact(self.q[base + i], shard.x[j]), shard.ids[j])
        self.looked += scores.size

    def _near(self, shard, best, base):
        n = best.slots
        q, size = self.q[base : base + n], self.size[base : base + n]
        everyone = np.arange(n)
        spots = shard.splits[:, 0].astype(np.int64)
        scores = q @ shard.x[spots].T
        self._look(shard, best, base, everyone, spots, scores)
        reach = np.square(size) + shard.top * shard.top
        distance = np.sqrt(np.maximum(0, reach[:, None] - 2 * scores))
        found, bounds = shard.leaves(distance)
        if not found:
            return
        slack = 1e-7 * (size + shard.top)
        home = bounds.argmin(0)
        turn = [*((leaf, everyone[home == leaf]) for leaf in range(len(found))), *((leaf, everyone[home != leaf]) for leaf in np.argsort(bounds.mean(1)))]
        for at, (leaf, rows) in enumerate(turn):
            if at == len(found):
                best.settle()  # every query has seen its home by now
            reached = np.sqrt(np.maximum(0, reach - 2 * best.low))
            rows = rows[~(self.factor * (bounds[leaf, rows] - slack[rows]) > reached[rows])]
            if len(rows):
                a, b = found[leaf]
                self._look(shard, best, base, rows, np.arange(a, b), q[rows] @ shard.x[a:b].T)

    def step(self, data):
        shard = Shard(self.d, data)
        with np.errstate(over="ignore", invalid="ignore"):
            for i, best in enumerate(self.best):
                self._near(shard, best, i * TOGETHER)
        self.met += len(shard.ids) * len(self.ids)

    def end(self):
        for i, best in enumerate(self.best):
            best.settle()
            yield pa.record_batch([pa.array(self.ids[i * TOGETHER + best.slot]), pa.array(best.id), pa.array(best.score)], names=["query_id", "vec_id", "score"])


def _pack_queries(d, table):
    ids = np.asarray(table.column("id").combine_chunks())
    return np.int64([len(ids)]).tobytes() + ids.tobytes() + matrix(table.column("v")).tobytes()


def _begin(k, factor):
    def begin(d, data):
        n = int(np.frombuffer(data, np.int64, 1)[0])
        return Search(d, np.frombuffer(data, np.int64, n, 8), np.frombuffer(data, np.float64, n * d, 8 + 8 * n).reshape(n, d), k, factor)

    return begin


def shards(rows):
    """The index: packed vantage-point trees (d, data) over all usable rows of a table (vec_id, embedding). It can be
    written and searched again."""
    return packed_rows(vectors(rows).where(NOT_ZERO), _pack_shard)


def nearest(index, queries, k: int = 20, factor: float = 1.0):
    """Rows (query_id, rank, vec_id, score): the k rows of the index with the largest inner products with each query.

    Ties go to the smaller vec_id; a query's own vec_id is no candidate. Scores are sums of products in double
    precision over the original vectors. queries: a table (vec_id, embedding). Vectors that are null, empty, zero or
    hold null or non-finite components, and rows without a vec_id, take no part; vectors of different lengths do not
    meet. Rows that share a vec_id count once as candidates, by the best score, and as queries by their smallest
    vector. factor: one is exact, a larger one passes over leaves whose bound is above the k-th distance divided by it.
    """
    asked = materialize(one_each(vectors(queries).where(NOT_ZERO)))
    groups = group_numbers(asked)
    if not groups:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    made = meet(packed_groups(asked, _pack_queries, groups), index, groups, _begin(k, factor), Search.step, Search.end, "query_id long, vec_id long, score double")
    once = made.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_nearest_neighbours(spark, sf_dir):
    """The 20 nearest by inner product of every vector whose id 20 divides, exactly."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(materialize(shards(rows)), rows.where("vec_id % 20 = 0"))


#: DuckDB SQL for op13.
OP13_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
