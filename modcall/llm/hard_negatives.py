"""Hard negatives by exact integer scores of all rows, computed the way of the Four Russians.

Components become integers. The components of an anchor are taken eight at a time: a table holds the sum of every
subset of the eight, 256 entries. A candidate's integers are cut into bit planes, two's complement, and the bits of
eight components in a plane are packed into one byte. That byte, looked up in the anchors' tables, is the plane's part
of eight products; planes are added up from the sign down, with a shift in between, to the full inner product. Tables
hold all anchors of a block side by side, so that one lookup serves all of them.

Anchors meet all rows twice, in blocks: for their positives, and, with those scores known, for the negatives.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .blocks import Best, group_numbers, matrix, meet, one_each, packed_groups, packed_rows, vectors
from .common import materialize

#: Anchors whose tables stand side by side and candidates that are looked up at once.
ANCHORS, CANDIDATES = 256, 1024
#: Components are multiplied by this and rounded down.
SCALE = 256
#: Shares of a positive's score, in hundredths, between which a negative's lies.
LEAST, MOST = 80, 100
#: The largest integer and score that are computed.
_WHOLE, _SCORE = float(1 << 53), 1 << 62


def whole(x):
    """floor(256 x) as integers."""
    scaled = np.floor(SCALE * x)
    if scaled.size and np.abs(scaled).max() >= _WHOLE:
        raise ValueError("a component is too large for integer scores")
    return scaled.astype(np.int64)


def planes(v):
    """Bytes (candidate, plane, group) of integers (candidate, component), planes from the sign down."""
    top = int(max(v.max(initial=0), -1 - v.min(initial=0)))
    many = top.bit_length() + 1
    bits = np.stack([(v >> p) & 1 for p in range(many - 1, -1, -1)], 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little")


def tables(v, dtype):
    """Subset sums (group, byte, anchor) of integers (anchor, component)."""
    n, d = v.shape
    padded = np.zeros((n, -(-d // 8) * 8), dtype)
    padded[:, :d] = v
    parts = padded.reshape(n, -1, 8).transpose(1, 2, 0)
    out = np.zeros((parts.shape[0], 256, n), dtype)
    for i in range(8):
        out[:, 1 << i : 2 << i] = out[:, : 1 << i] + parts[:, i, None]
    return out


def scores(table, packed):
    """Inner products (candidate, anchor) from subset sums and packed planes."""
    total = None
    for p in range(packed.shape[1]):
        part = table[0][packed[:, p, 0]]
        for g in range(1, len(table)):
            part += table[g][packed[:, p, g]]
        if total is None:
            total = -part  # the sign's plane
        else:
            total += total
            total += part
    return total


def _pack_rows(d, table):
    v = whole(matrix(table.column("v")).reshape(-1, d))
    packed = planes(v)
    ids, labels = (np.asarray(table.column(c).combine_chunks(), np.int64) for c in ("id", "label"))
    head = np.array([len(v), *packed.shape[1:], np.abs(v).max()], np.int64)
    return b"".join(x.tobytes() for x in (head, ids, labels, packed))


def _unpack_rows(data):
    n, p, g, largest = np.frombuffer(data, np.int64, 4).tolist()
    ids, labels = np.frombuffer(data, np.int64, n, 32), np.frombuffer(data, np.int64, n, 32 + 8 * n)
    return ids, labels, np.frombuffer(data, np.uint8, n * p * g, 32 + 16 * n).reshape(n, p, g), largest


def _pack_anchors(positives: int):
    """Bytes of anchors: ids, labels, integers, and (positives > 0) the ids and scores of their positives in order."""

    def pack(d, table):
        ids, labels = (np.asarray(table.column(c).combine_chunks(), np.int64) for c in ("id", "label"))
        parts = [np.int64([len(ids)]), ids, labels, whole(matrix(table.column("v")).reshape(-1, d))]
        if positives:
            lists = table.column("found").combine_chunks()
            size = np.asarray(pa.compute.list_value_length(lists), np.int64)
            at = np.repeat(np.arange(len(ids)), size), np.concatenate([np.arange(s) for s in size])
            flat = lists.flatten()
            for name in ("id", "score"):
                square = np.zeros((len(ids), positives), np.int64)
                square[at] = np.asarray(flat.field(name), np.int64)
                parts.append(square)
            parts.append(size)
        return b"".join(x.tobytes() for x in parts)

    return pack


class Block:
    """Anchors of a group with their tables, and what is best among the candidates that went by."""

    def __init__(self, d: int, data, positives: int, k: int):
        n = int(np.frombuffer(data, np.int64, 1)[0])

        def take(at, *shape):
            return np.frombuffer(data, np.int64, int(np.prod(shape)), 8 * at).reshape(shape)

        self.ids, self.labels, self.v = take(1, n), take(1 + n, n), take(1 + 2 * n, n, d)
        self.positives, at = positives, 1 + 2 * n + n * d
        if positives:
            self.positive, self.positive_score, self.size = take(at, n, positives), take(at + n * positives, n, positives), take(at + 2 * n * positives, n)
            # the smallest whole score of which a hundred are LEAST scores of the positive
            self.floor = -((-LEAST * self.positive_score) // 100)
            self.ceiling = (MOST * self.positive_score) // 100
        each = max(1, positives)
        self.starts = range(0, n, ANCHORS)
        self.best = [Best(len(self.ids[a : a + ANCHORS]) * each, k, np.int64) for a in self.starts]
        self.d, self.tables, self.kind = d, None, None

    def step(self, data):
        ids, labels, packed, largest = _unpack_rows(data)
        bound = self.d * largest * int(np.abs(self.v).max())
        if bound >= _SCORE:
            raise ValueError("scores may not fit 64 bits")
        kind = np.int32 if max(bound, self.d * int(np.abs(self.v).max())) < 1 << 30 else np.int64
        if kind != self.kind:
            self.tables, self.kind = [tables(self.v[a : a + ANCHORS], kind) for a in self.starts], kind
        for c in range(0, len(ids), CANDIDATES):
            part = slice(c, c + CANDIDATES)
            for a, table, best in zip(self.starts, self.tables, self.best, strict=True):
                self._judge(a, scores(table, packed[part]), ids[part], labels[part], best)

    def _judge(self, a, score, ids, labels, best):
        own, label = self.ids[a : a + ANCHORS], self.labels[a : a + ANCHORS]
        same, other = labels[:, None] == label, ids[:, None] != own
        if not self.positives:
            i, j = np.nonzero(same & other & (score >= best.low))
            best.add(j, score[i, j], ids[i])
            return
        fine = ~same & other
        for p in range(self.positives):
            has, slot = self.size[a : a + ANCHORS] > p, np.arange(len(own)) * self.positives + p
            least = np.maximum(self.floor[a : a + ANCHORS, p], best.low[slot])
            i, j = np.nonzero(fine & has & (score >= least) & (score <= self.ceiling[a : a + ANCHORS, p]))
            best.add(slot[j], score[i, j], ids[i])

    def end(self):
        for a, best in zip(self.starts, self.best, strict=True):
            best.settle()
            if not self.positives:
                yield pa.record_batch([pa.array(self.ids[a + best.slot]), pa.array(best.id), pa.array(best.score)], names=["anchor_id", "vec_id", "score"])
                continue
            anchor, p = a + best.slot // self.positives, best.slot % self.positives
            cols = self.ids[anchor], self.positive[anchor, p], self.positive_score[anchor, p], best.id, best.score
            yield pa.record_batch([pa.array(c) for c in cols], names=["anchor_id", "positive_id", "positive_score", "vec_id", "score"])


def _search(anchors, rows, positives: int, k: int, keys: list[str], shape: str):
    """The k best rows (vec_id, score) of each key, with their rank: of one task first, then of all."""
    groups = group_numbers(anchors)
    made = meet(packed_groups(anchors, _pack_anchors(positives), groups), rows, groups, lambda d, data: Block(d, data, positives, k), Block.step, Block.end, shape)
    once = made.repartition(*keys).groupBy(*keys, "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(rows, anchors, positives: int = 5, negatives: int = 5):
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of tables (vec_id, embedding,
    label long).

    Scores are inner products of floor(256 x). An anchor's positives are the first rows of its label, its negatives for
    a positive the first ones of other labels with a score of 80 to 100 hundredths of the positive's; higher scores
    come first, ties by smaller vec_id; a pair without a negative gives no row. Rows with a null vec_id, label or
    vector, an empty vector or a null or non-finite component take no part; vectors of different lengths do not meet.
    Rows that share a vec_id count once as candidates, by the best score, never for an anchor of their own vec_id, and
    as anchors by the smallest label and vector. Scores that could exceed 62 bits are an error.
    """
    packed = materialize(packed_rows(vectors(rows, "label"), _pack_rows))
    asked = materialize(one_each(vectors(anchors, "label"), "label"))
    shape = "anchor_id long, vec_id long, score long"
    found = _search(asked, packed, 0, positives, ["anchor_id"], shape).groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), "score"))).alias("found"))
    known = materialize(asked.join(found, F.col("id") == F.col("anchor_id")).drop("anchor_id"))
    shape = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"
    out = _search(known, packed, positives, negatives, ["anchor_id", "positive_id", "positive_score"], shape)
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir):
    """Five hard negatives for each of the five positives of every vector whose id 100 divides."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


#: DuckDB SQL for op12; products of integers this small are exact in doubles.
OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
