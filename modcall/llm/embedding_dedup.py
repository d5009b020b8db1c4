"""Embedding near-dedup on an inverted multi-index.

Vectors of equal components are one class. Two codebooks, one on each half of the normalised vector, form
a product grid of cells; every class is stored in its cell and visits the nearest cells of the grid in
multi-sequence order, as many as a calibration at the threshold says are needed for the target recall.
Visitors are compared with a cell's members by exact cosine in double precision.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import guarded, lean, materialize, scratch, without
from .components import components

#: Vectors of the bounded sample that fits the codebooks and the number of cells to visit.
SAMPLE = 8192
#: Members of a cell that meet in one piece; larger cells are dealt to several pieces.
PIECE = 2048
#: Most cells of a half: the sample holds eight vectors for each.
CELLS = SAMPLE // 8


def unit(x):
    """Rows of a float64 matrix divided by their norms; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x, k: int, rng, rounds: int = 12):
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (np.square(centre).sum(1) - 2 * x @ centre.T).argmin(1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        size = np.bincount(own, minlength=k)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.choice(len(x), k)])
    return centre


class Grid:
    """Codebooks of both halves and the number of cells that a vector visits."""

    def __init__(self, x, k: int, threshold: float, recall: float):
        rng = np.random.default_rng(7)
        self.half = max(1, x.shape[1] // 2)
        self.books = [_kmeans(h, min(k, len(x)), rng) for h in (x[:, : self.half], x[:, self.half :])]
        self.k = len(self.books[0])
        other = rng.standard_normal(x.shape)
        other -= (other * x).sum(1, keepdims=True) * x
        norm = np.linalg.norm(other, axis=1, keepdims=True)
        other = np.divide(other, norm, out=np.zeros_like(other), where=norm > 0)
        partner = threshold * x + math.sqrt(1 - threshold**2) * other
        home, order = self.nearest(partner, 1)[:, 0], np.ones(len(x), np.int64)
        for i, (one, two) in enumerate(zip(*self.distances(x), strict=True)):
            # how many cells are nearer to a vector than its partner's
            order[i] += np.searchsorted(np.sort(two), one[home[i] // self.k] + two[home[i] % self.k] - one).sum()
        self.visits = min(self.k**2, int(np.quantile(order, recall, method="higher")))

    def distances(self, x):
        return [np.square(b).sum(1) - 2 * h @ b.T for b, h in zip(self.books, (x[:, : self.half], x[:, self.half :]), strict=True)]

    def nearest(self, x, n: int):
        """The n nearest cells of each row by multi-sequence order: a pair of ranks (r, s), from 1, can only
        be among the n nearest if r * s <= n, so only those pairs of the two sorted lists are looked at."""
        n = min(n, self.k**2)
        d1, d2 = self.distances(x)
        o1, o2 = np.argsort(d1, 1), np.argsort(d2, 1)
        r, s = (np.array(v) for v in zip(*[(r, s) for r in range(self.k) for s in range(self.k) if (r + 1) * (s + 1) <= n], strict=True))
        d1, d2 = np.take_along_axis(d1, o1, 1)[:, r], np.take_along_axis(d2, o2, 1)[:, s]
        best = np.argpartition(d1 + d2, n - 1, axis=1)[:, :n] if n < len(r) else np.tile(np.arange(len(r)), (len(x), 1))
        return np.take_along_axis(o1, r[best], 1) * self.k + np.take_along_axis(o2, s[best], 1)


def _matrix(column):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _homes(grid):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                home = grid.value.nearest(unit(_matrix(batch.column(2))), 1)[:, 0].astype(np.int32)
                yield pa.record_batch([pa.array(home), batch.column(0)], names=["cell", "rep"])

    return run


def _deal(grid):
    """Rows for the cells: kind 0 stored at home in one piece, kind 1 visitors to all pieces of a cell."""

    def run(batches):
        own_grid, (large, pieces) = grid.value
        many = np.ones(own_grid.k**2, np.int64)
        many[large] = pieces
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                batch = big.slice(at, 2048)
                x = unit(_matrix(batch.column(2)))
                cells = own_grid.nearest(x, own_grid.visits)
                home = own_grid.nearest(x, 1)[:, 0]
                rep = np.asarray(batch.column(0))
                own = (rep.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % many[home]
                # a tie may leave a vector's home out of the cells that it visits
                out = np.flatnonzero((cells != home[:, None]).all(1))
                at_row = np.concatenate([np.repeat(np.arange(len(x)), cells.shape[1]), out])
                at_cell = np.concatenate([cells.ravel(), home[out]])
                times = many[at_cell]
                row, cell = np.repeat(at_row, times), np.repeat(at_cell, times)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                packed = [m.tobytes() for m in np.column_stack([home, cells]).astype(np.int32)]
                cols = [
                    np.concatenate([home, cell]).astype(np.int32),
                    np.concatenate([own, piece]).astype(np.int32),
                    np.concatenate([np.zeros(len(x), np.int32), np.ones(len(row), np.int32)]),
                    np.concatenate([home, home[row]]).astype(np.int32),
                ]
                take = pa.array(np.concatenate([np.arange(len(x)), row]))
                visits = pa.array(packed + [None] * len(row), pa.binary())
                rest = batch.take(take)
                yield pa.record_batch([*map(pa.array, cols), visits, *rest.columns], names=["cell", "piece", "kind", "home", "visits", *rest.schema.names])

    return run


def _meet(threshold: float):
    """Rows sorted by cell, piece, kind: visitors against members. Out: kind 0 (a, n) links, kind 1 (a, b) edges."""

    def run(batches):
        now, parts, members = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([np.asarray(batch.column(i)) for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1).tolist(), len(where)]
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                spot, kind = tuple(where[a, :2].tolist()), where[a, 2]
                if spot != now:
                    now, parts, members = spot, [], None
                part = batch.slice(a, b - a)
                home, rep, size, x = np.asarray(part.column(3)), np.asarray(part.column(5)), np.asarray(part.column(6)), unit(_matrix(part.column(7)))
                if kind == 0:
                    parts.append((rep, size, x, np.frombuffer(b"".join(part.column(4).to_pylist()), np.int32).reshape(len(rep), -1)))
                    continue
                if parts:
                    members, parts = [np.concatenate(c) for c in zip(*parts, strict=True)], []
                    seen = members.pop()
                    members.append(np.sort((seen.astype(np.int64) + (np.arange(len(seen)) << 32)[:, None]).ravel()))
                if members is None:
                    continue
                for c in range(0, len(rep), 1024):
                    yield from _links(threshold, members, home[c : c + 1024], rep[c : c + 1024], size[c : c + 1024], x[c : c + 1024])

    return run


def _links(threshold, members, home, rep, size, x):
    """members: ids, sizes, vectors and the sorted (place, cell) of all that each member visits, as one number."""
    ids, sizes, y, seen = members
    i, j = np.nonzero(x @ y.T >= threshold)
    other = rep[i] != ids[j]
    i, j = i[other], j[other]
    if not len(i):
        return
    count = np.bincount(i, sizes[j], len(rep)).astype(np.int64)
    # a member that does not itself visit the visitor's home learns of the link here
    asked = (j.astype(np.int64) << 32) + home[i]
    back = seen[np.minimum(np.searchsorted(seen, asked), len(seen) - 1)] != asked
    more = np.bincount(j[back], size[i[back]], len(ids)).astype(np.int64)
    node, total = np.concatenate([rep, ids]), np.concatenate([count, more])
    # a spanning star for each group of links: everyone to the smallest id of its group
    low, low_j = rep.copy(), ids.copy()
    while True:
        before = low.copy(), low_j.copy()
        np.minimum.at(low_j, j, low[i])
        np.minimum.at(low, i, low_j[j])
        if (before[0] == low).all() and (before[1] == low_j).all():
            break
    least = np.concatenate([low, low_j])
    some, edge = total > 0, least != node
    kind = np.concatenate([np.zeros(some.sum(), np.int32), np.ones(edge.sum(), np.int32)])
    yield pa.record_batch([pa.array(kind), pa.array(np.concatenate([node[some], node[edge]])), pa.array(np.concatenate([total[some], least[edge]]))], names=["kind", "a", "b"])


@guarded("__h1", "__h2", "rep", "id", "n", "x", "a", "b", "node", "component", "links", "least")
def embedding_links(rows, threshold: float = 0.95, recall: float = 0.999, k: int | None = None):
    """Rows with n_links, component_id and kept, by cosine >= threshold between embeddings.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths link with each other. Equal vectors (repeated rows too) are one class
    and link with each other. n_links counts other rows linked directly; component_id is the smallest
    vec_id reachable; kept where it is the row's own. Rows that share a vec_id but not the vector are rows of their
    own, each with its links and component. A null vec_id never becomes a component_id; a
    class without any id links inside itself only. k (cells of each half) defaults to about 256 classes
    a cell, at most CELLS of a half. Two vectors meet if either visits the other's cell. Input columns named like a result are
    replaced.
    """
    spark = rows.sparkSession
    rows = without(rows, "n_links", "component_id", "kept")
    v = F.col("embedding").cast("array<double>")
    fine = F.coalesce((F.size("embedding") > 0) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0), F.lit(False))
    keyed = rows.select("*", F.when(fine, F.xxhash64("embedding")).alias("__h1"), F.when(fine, F.xxhash64(F.lit(1), "embedding")).alias("__h2"))
    classes = materialize(
        keyed.where("__h1 is not null").groupBy("__h1", "__h2").agg(F.min(F.col("vec_id").cast("long")).alias("id"), F.count("*").alias("n"), F.first(F.col("embedding").cast("array<float>") if rows.schema["embedding"].dataType.elementType == T.FloatType() else v).alias("x"))
        .withColumn("rep", F.monotonically_increasing_id())  # a number of the class, fixed by writing it; one vec_id may have several classes
    )
    usable = classes.where("id is not null").select("rep", "n", "x", "__h1", "__h2")
    path, shape = scratch(spark), "kind int, a long, b long"
    spark.createDataFrame([], shape).write.parquet(path)
    for d, n in sorted(usable.groupBy(F.size("x").alias("d")).count().collect()):  # a grid for each length
        own = usable.where(F.size("x") == d)
        some = own.orderBy("__h1", "__h2").limit(SAMPLE).select("x").toPandas().x
        own = own.drop("__h1", "__h2")
        size = k or min(CELLS, max(2, math.isqrt(n // 256)))
        grid = Grid(unit(np.stack(some.to_numpy()).astype(np.float64)), size, threshold, recall)
        book = spark.sparkContext.broadcast(grid)
        homes = own.mapInArrow(lean(_homes(book)), "cell int, rep long").groupBy("cell").count().where(F.col("count") > PIECE)
        large = homes.collect()  # at most one row a cell of the grid
        plan = spark.sparkContext.broadcast((grid, (np.array([r["cell"] for r in large], np.int64), np.array([-(-r["count"] // PIECE) for r in large], np.int64))))
        kind = own.schema["x"].dataType.simpleString()
        dealt = own.mapInArrow(lean(_deal(plan)), f"cell int, piece int, kind int, home int, visits binary, rep long, n long, x {kind}")
        met = dealt.repartition("cell", "piece").sortWithinPartitions("cell", "piece", "kind").mapInArrow(lean(_meet(threshold)), shape)
        met.write.mode("append").parquet(path)
    found = spark.read.schema(shape).parquet(path)
    links = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links"))
    group = components(found.where("kind = 1").select("a", "b"))
    joined = classes.select("rep", "id").join(group, F.col("rep") == F.col("node"))
    least = joined.groupBy("component").agg(F.min("id").alias("least"))
    group = group.join(least, "component").select("node", "least")
    known = classes.select("__h1", "__h2", "rep", "id", "n").join(links, F.col("rep") == F.col("a"), "left").join(group, F.col("rep") == F.col("node"), "left")
    known = known.select("__h1", "__h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    out = keyed.join(known, ["__h1", "__h2"], "left").drop("__h1", "__h2")
    out = out.withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("long"), "component_id": F.coalesce("component_id", F.col("vec_id").cast("long"))})
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_embedding_near_dedup(spark, sf_dir):
    """Per vector: links at cosine >= 0.95, the component and whether the vector is its smallest."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return embedding_links(rows).select("vec_id", "n_links", "component_id", "kept")
