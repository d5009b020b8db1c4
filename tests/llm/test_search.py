"""Hard negatives and nearest neighbours against brute force, and their edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modcall.llm import blocks, hard_negatives, vantage
from modcall.llm.hard_negatives import op12_hard_negatives, planes, scores, tables
from modcall.llm.vantage import build, nearest, op13_nearest_neighbours, shards

SHAPE = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def double(v):
    return [float(np.float32(x)) for x in v]


def dot(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total


def best_by_id(found, k):
    """The k best ids of (id, score) pairs; an id counts once."""
    top = {}
    for i, s in found:
        top[i] = max(top.get(i, s), s)
    return sorted(top.items(), key=lambda x: (-x[1], x[0]))[:k]


def plain_nearest(rows, every=20, k=20):
    fine = [(i, double(v)) for i, v, _ in rows if i is not None and usable(v) and any(v)]
    asked = {}
    for i, v in fine:
        if i % every == 0 and (i not in asked or v < asked[i]):
            asked[i] = v
    out = []
    for q, v in asked.items():
        found = best_by_id([(i, dot(v, w)) for i, w in fine if i != q and len(w) == len(v)], k)
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(found)]
    return sorted(out)


def plain_negatives(rows):
    fine = [(i, [math.floor(256 * x) for x in double(v)], (n + 1) % 10 if i % 7 == 0 else n) for i, v, n in rows if i is not None and n is not None and usable(v)]
    anchors = {}
    for i, v, n in fine:
        if i % 100 == 0 and (i not in anchors or (n, v) < anchors[i]):
            anchors[i] = (n, v)
    out = []
    for a, (n, v) in anchors.items():
        scored = [(i, sum(x * y for x, y in zip(v, w, strict=True)), m) for i, w, m in fine if i != a and len(w) == len(v)]
        for p, ps in best_by_id([(i, s) for i, s, m in scored if m == n], 5):
            near = best_by_id([(i, s) for i, s, m in scored if m != n and 80 * ps <= 100 * s <= 100 * ps], 5)
            out += [(a, p, r + 1, i, ps, s) for r, (i, s) in enumerate(near)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(13)
    centres = rng.standard_normal((6, 12))
    out = []
    for i in range(1200):
        v = centres[i % 6] + 0.4 * rng.standard_normal(12) if i % 3 else rng.standard_normal(12)
        out.append((i, (v / np.linalg.norm(v) * rng.choice([1, 1, 0.5, 3])).tolist(), int(rng.integers(0, 4))))
    out += [(i, out[300][1], i % 4) for i in range(1200, 1300)]  # a group of copies: ties
    out += [(1300, None, 1), (1301, [], 1), (1320, [0.0] * 12, 1), (1340, [1.0] * 11 + [None], 1), (1360, [1.0] * 11 + [float("nan")], 1), (1380, [float("inf")] * 12, 1)]
    out += [(None, [1.0] * 12, 1), (1400, [0.5] * 12, None), (1420, [0.1, 0.2, 0.3], 2), (1500, [0.3, 0.2, 0.1], 2), (1501, [0.3, 0.2, 0.2], 2), (1502, [0.3, 0.15, 0.2], 1)]
    out += [(1600, [2.0] + [0.0] * 11, 3), (1600, [-2.0] + [0.0] * 11, 1), (1600, [2.0] + [0.0] * 11, 3), (7, out[8][1], 2)]  # ids with several rows
    return out


def table(spark, rows, parts=6):
    return spark.createDataFrame(rows, SHAPE).repartition(parts)


def test_nearest_are_those_of_brute_force(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(vantage, "LEAF", 16)
    clash = {c: F.lit("x") for c in ("id", "v", "d", "g", "r", "kind", "data", "score", "rank", "query_id", "found", "anchor_id")}
    table(spark, rows).withColumns(clash).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, op13_nearest_neighbours(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()))
    want = plain_nearest(rows)
    assert got == want and len({q for q, *_ in want}) > 60
    got = sorted(map(tuple, op12_hard_negatives(spark, str(tmp_path)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    want = plain_negatives(rows)
    assert got == want and len(want) > 50 and any(a == 1500 for a, *_ in want)


def test_several_groups_of_queries_and_packs_of_rows(spark, rows, monkeypatch):
    for name, value in (("GROUP", 20), ("PACK", 300)):
        monkeypatch.setattr(blocks, name, value)
    some = table(spark, rows, 3)
    groups = blocks.group_numbers(blocks.one_each(blocks.vectors(some.where("vec_id % 20 = 0"))), 20)
    assert groups[12] > 3
    monkeypatch.setattr(vantage, "group_numbers", lambda q: blocks.group_numbers(q, 20))
    got = sorted(map(tuple, nearest(shards(some), some.where("vec_id % 20 = 0"), 20).collect()))
    assert got == plain_nearest(rows)
    monkeypatch.setattr(hard_negatives, "group_numbers", lambda q: blocks.group_numbers(q, 4))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    some = some.select("vec_id", "embedding", label)
    got = hard_negatives.hard_negatives(some, some.where("vec_id % 100 = 0")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def searched(x, q, factor):
    """Queries in numpy alone: what is found and the share of scores that were computed."""
    import pyarrow as pa

    shard = pa.table({"id": pa.array(range(len(x))), "v": pa.array(list(x), pa.list_(pa.float64()))})
    state = vantage.Search(x.shape[1], -1 - np.arange(len(q)), q, 10, factor)
    state.step(vantage._pack_shard(x.shape[1], shard))
    found = [set() for _ in q]
    for batch in state.end():
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found[-1 - i].add(v)
    return found, state.looked / state.met


def test_factor_one_is_exact_and_larger_factors_trade_recall_for_work():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.15 * rng.standard_normal((4000, 16))
    q = centres[rng.integers(0, 40, 200)] + 0.15 * rng.standard_normal((200, 16))
    x, q = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (x, q))
    truth = [set(np.lexsort((np.arange(4000), -s))[:10].tolist()) for s in q @ x.T]
    shares = []
    for factor in (1.0, 1.5, 3.0):
        found, share = searched(x, q, factor)
        recall = np.mean([len(f & t) / 10 for f, t in zip(found, truth, strict=True)])
        shares.append(share)
        assert recall == 1 if factor == 1 else recall >= 0.9 if factor == 1.5 else recall > 0.3
    assert shares[0] < 0.7 and shares[0] > shares[1] > shares[2]


def test_trees_hold_every_point_once():
    x = np.repeat(np.random.default_rng(1).standard_normal((50, 3)), 20, axis=0)  # many copies
    order, splits, top = build(x)
    assert sorted(order.tolist()) == list(range(1000)) and np.isfinite(splits).all() and math.isclose(top, np.linalg.norm(x, axis=1).max())


@pytest.mark.parametrize("d", [1, 7, 8, 9, 64])
def test_plane_lookups_give_inner_products(d):
    rng = np.random.default_rng(d)
    for high in (1, 3, 300, 1 << 20):
        a, c = rng.integers(-high, high, (5, d)), rng.integers(-high, high, (40, d))
        assert (scores(tables(a, np.int64), planes(c)) == c @ a.T).all()
    assert (scores(tables(np.ones((2, d), np.int64), np.int64), planes(np.full((3, d), -1))) == -d).all()


def test_scores_beyond_a_long_are_an_error(spark):
    big = spark.createDataFrame([(100, [1e12], 1), (101, [1e12], 1), (102, [1e12], 2)], SHAPE)
    with pytest.raises(Exception, match="64 bits|too large"):
        hard_negatives.hard_negatives(big, big).collect()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SHAPE)
    some = spark.createDataFrame([(100, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], SHAPE)
    for rows, queries in ((none, none), (some, none), (none, some)):
        assert nearest(shards(rows), queries).count() == 0
        assert hard_negatives.hard_negatives(rows, queries).count() == 0
    assert [tuple(r) for r in nearest(shards(some), some.where("vec_id = 100")).collect()] == [(100, 1, 1, 5.0)]
