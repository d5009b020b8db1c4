"""A stated set of queries against all rows, in blocks.

Queries are dealt into groups of about GROUP by a hash of their id and packed, a row for each group. Rows are packed
by the thousand where they are read. Every pack of rows goes to every group of queries, as a row of bytes, so that the
number of rows that Spark moves stays small. Where there are fewer groups than partitions, packs of rows are dealt to
several replicas of a group. A task holds one group of queries at a time and lets its packs of rows go by.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

#: Queries of a group, on average, and rows of a pack.
GROUP, PACK = 1024, 4096


def vectors(rows, *more):
    """Rows (id, d, v, *more) of a table (vec_id, embedding) whose vectors have components, all of them finite.

    more: names of long columns, null ones leave a row out, as a null vec_id does."""
    kind = rows.schema["embedding"].dataType.elementType
    v = F.col("embedding") if kind in (T.FloatType(), T.DoubleType()) else F.col("embedding").cast("array<double>")
    some = rows.select(F.col("vec_id").cast("long").alias("id"), v.alias("v"), *[F.col(m).cast("long").alias(m) for m in more])
    for name in ("id", *more):
        some = some.where(F.col(name).isNotNull())
    some = some.where((F.size("v") > 0) & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    return some.select("id", F.size("v").alias("d"), "v", *more)


def one_each(queries, *more):
    """One row for each id: the smallest by `more` and vector."""
    best = queries.groupBy("id").agg(F.min(F.struct(*more, "v")).alias("q"))
    return best.select("id", F.size("q.v").alias("d"), F.col("q.v").alias("v"), *[F.col(f"q.{m}").alias(m) for m in more])


def matrix(column, dtype=np.float64):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype)


def packed_rows(rows, pack, size: int = PACK):
    """Packs (d, data) of rows (d, ...): pack(d, table) gives the bytes of at most `size` rows of one length."""

    def run(batches):
        held: dict[int, list] = {}

        def flush(d):
            return pa.record_batch([pa.array([d], pa.int32()), pa.array([pack(d, pa.Table.from_batches(held.pop(d)))], pa.binary())], names=["d", "data"])

        for batch in batches:
            lengths = np.asarray(batch.column("d"))
            for d in np.unique(lengths).tolist():
                own = batch.take(pa.array(np.flatnonzero(lengths == d)))
                while own.num_rows:
                    have = sum(b.num_rows for b in held.setdefault(d, []))
                    held[d].append(own.slice(0, size - have))
                    own = own.slice(size - have)
                    if have + held[d][-1].num_rows == size:
                        yield flush(d)
        for d in list(held):
            yield flush(d)

    return rows.mapInArrow(lean(run), "d int, data binary")


def packed_groups(queries, pack, groups):
    """Packs (d, g, data) of queries (id, d, ...), one for each length and group; groups: the number by length."""

    def run(batches):
        now, held = None, []

        def flush():
            return pa.record_batch([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([pack(now[0], pa.Table.from_batches(held))], pa.binary())], names=["d", "g", "data"])

        for batch in batches:
            d, g = np.asarray(batch.column("d")), np.asarray(batch.column("g"))
            cuts = [0, *(np.flatnonzero((d[1:] != d[:-1]) | (g[1:] != g[:-1])) + 1).tolist(), len(d)]
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                if a < b and (int(d[a]), int(g[a])) != now:
                    if held:
                        yield flush()
                    now, held = (int(d[a]), int(g[a])), []
                held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    number = F.pmod(F.xxhash64("id"), F.lit(_by_length(groups))).cast("int")
    dealt = queries.withColumn("g", number).repartition("d", "g").sortWithinPartitions("d", "g")
    return dealt.mapInArrow(lean(run), "d int, g int, data binary")


def _by_length(groups: dict):
    """The number of groups as a column, by the column d."""
    out = F.lit(1)
    for d, n in groups.items():
        out = F.when(F.col("d") == d, n).otherwise(out)
    return out


def group_numbers(queries, size: int = GROUP) -> dict:
    """The number of groups for each length of the queries' vectors: one row a length comes to the driver."""
    return {r["d"]: math.ceil(r["n"] / size) for r in queries.groupBy("d").agg(F.count("*").alias("n")).collect()}


def meet(queries, rows, groups: dict, begin, step, end, shape: str):
    """What tasks make of every group of queries (d, g, data) and all packs of rows (d, data) of its length.

    begin(d, data) gives a state, step(state, data) looks at a pack, end(state) gives record batches of `shape`.
    """
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = max(1, sum(groups.values()))
    copies = max(1, 2 * parts // total)
    asked = queries.select("d", "g", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("r"), F.lit(0).alias("kind"), "data")
    number = _by_length(groups)
    all_groups = F.explode(F.sequence(F.lit(0), number - 1)).alias("g")
    at = F.pmod(F.xxhash64("data"), F.lit(copies)).cast("int")
    known = rows.where(F.col("d").isin(list(groups)))  # rows of other lengths have no query
    given = known.select("d", all_groups, at.alias("r"), F.lit(1).alias("kind"), "data")
    cells = asked.unionByName(given).repartition("d", "g", "r").sortWithinPartitions("d", "g", "r", "kind")

    def run(batches):
        now, state = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                d, g, r, kind = (batch.column(c)[i].as_py() for c in range(4))
                data = batch.column(4)[i].as_buffer()
                if (d, g, r) != now:
                    if state is not None:
                        yield from end(state)
                    now, state = (d, g, r), None
                if kind == 0:
                    state = begin(d, data)
                elif state is not None:
                    step(state, data)
        if state is not None:
            yield from end(state)

    return cells.mapInArrow(lean(run), shape)


class Best:
    """The k best of each slot by score, then smaller id; an id counts once in a slot, by its best score."""

    def __init__(self, slots: int, k: int, dtype):
        self.k, self.slots = k, slots
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, dtype), np.zeros(0, np.int64)
        self.least = -np.inf if np.dtype(dtype).kind == "f" else np.iinfo(dtype).min
        #: Scores under these cannot be among the best of their slot any more.
        self.low = np.full(slots, self.least, dtype)
        self.waiting, self.size = [], 0

    def add(self, slot, score, ident):
        if len(slot):
            self.waiting.append((slot, score.astype(self.score.dtype), ident))
            self.size += len(slot)
            if self.size > max(4096, len(self.slot) // 2):
                self.settle()

    def settle(self):
        if not self.waiting:
            return
        slot, score, ident = (np.concatenate(c) for c in zip((self.slot, self.score, self.id), *self.waiting, strict=True))
        self.waiting, self.size = [], 0
        order = np.lexsort((-score, ident, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        first = np.ones(len(slot), bool)
        first[1:] = (slot[1:] != slot[:-1]) | (ident[1:] != ident[:-1])
        slot, score, ident = slot[first], score[first], ident[first]
        order = np.lexsort((ident, -score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        begins = np.searchsorted(slot, np.arange(self.slots))
        kept = np.arange(len(slot)) - begins[slot] < self.k
        self.slot, self.score, self.id = slot[kept], score[kept], ident[kept]
        full = np.flatnonzero(np.bincount(self.slot, minlength=self.slots) == self.k)
        last = np.searchsorted(self.slot, full, "right") - 1
        self.low[full] = self.score[last]
