"""Streams over chunk files: restarts, replays, limits and idle stops."""

import time

import pytest
from pyspark.sql import functions as F

from modcall.operators.modtags import read_tags
from modcall.scratch import children, written
from modcall.streaming import assembly, chunks

CALLS = "read_id string, read_pos int, prob double, written timestamp"


def put_chunk(spark, folder, n, rows, second):
    df = spark.createDataFrame([(*r,) for r in rows], "read_id string, read_pos int, prob double").withColumn("written", F.timestamp_seconds(F.lit(second)))
    df.coalesce(1).write.parquet(f"{folder}/chunks/chunk={n}")
    time.sleep(0.05)  # files are taken in the order of their times


def test_reads_are_put_together_over_chunks_and_a_restart(spark, tmp_path):
    rows = [[("a", 5, 0.1), ("b", 1, 0.2), ("c", 0, 1.0)], [("a", 1, 0.5), ("b", 9, None), ("c", 7, 0.25)], [("a", 3, 0.9), ("b", 2, float("nan")), ("d", 4, None)]]
    folder = f"file://{tmp_path}"
    stream = lambda: assembly.stream_tags(chunks.chunk_stream(spark, f"{folder}/chunks/chunk=*", CALLS, 1))
    for n in range(2):
        put_chunk(spark, folder, n, rows[n], 1000 + n)
    assert chunks.drain(stream(), f"{folder}/run", "append").count() == 0  # all reads may still grow
    put_chunk(spark, folder, 2, rows[2], 1002)
    chunks.close_stream(spark, f"{folder}/chunks/chunk=3", CALLS, "written", 86400)
    got = chunks.drain(stream(), f"{folder}/run", "append")
    whole = spark.createDataFrame([r for part in rows for r in part], "read_id string, read_pos int, prob double")
    want = sorted(map(tuple, read_tags(whole).collect()))
    assert sorted(map(tuple, got.collect())) == want and [w[0] for w in want] == ["a", "b", "c"]


def test_reads_are_gathered_by_spark_itself(spark, tmp_path):
    """No read goes through Python on its own, and batches keep to the number of chunks however many files these have."""
    folder = f"file://{tmp_path}"
    calls = spark.range(3000).selectExpr("cast(id % 1000 as string) AS read_id", "cast(id div 1000 as int) AS read_pos", "0.5d AS prob")
    for n in range(3):
        calls.where(f"read_pos = {n}").withColumn("written", F.timestamp_seconds(F.lit(1000 + n))).repartition(5).write.parquet(f"{folder}/chunks/chunk={n}")
    chunks.close_stream(spark, f"{folder}/chunks/chunk=3", CALLS, "written", 86400)
    stream = assembly.gather_reads(chunks.chunk_stream(spark, f"{folder}/chunks/chunk=*", CALLS, 5))
    assert "TransformWithState" not in stream._jdf.queryExecution().toString()
    got = chunks.drain(stream, f"{folder}/run", "append")
    assert got.count() == 1000 and got.where("size(calls) <> 3 or read_id is null").count() == 0
    assert len(written(spark, f"{folder}/run/out", "batch")) <= 5  # three chunks, the closing one, what it sets free


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    calls = [spark.createDataFrame([(p, x) for p in range(4) for x in part], "pos int, prob double") for part in ([0.2, 0.9], [0.7], [None, float("nan")], [0.1, 0.5], [1.0])]
    table = chunks.SiteTable(spark, f"file://{tmp_path}/t", ["pos"], 3)
    assert table.table() is None
    union = calls[0]
    for n, part in enumerate(calls):
        union = union if n == 0 else union.union(part)
        want = sorted(map(tuple, chunks.site_counts(union, ["pos"]).collect()))
        for again in (n, n, max(0, n - 1)):
            table.put(calls[again], again)
            assert sorted(map(tuple, table.table().collect())) == want
    assert written(spark, f"file://{tmp_path}/t/merged", "upto") == [2]
    assert written(spark, f"file://{tmp_path}/t/partial", "batch") == [3, 4]  # merged partials are gone


def test_limits_hold_over_restarts(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for n in range(6):
        put_chunk(spark, folder, n, [(f"r{n}", i, 0.5) for i in range(10)], 1000)
    stream = lambda: chunks.chunk_stream(spark, f"{folder}/chunks/chunk=*", CALLS, 1)
    assert chunks.drain_limited(stream(), f"{folder}/run", 25).count() == 30
    assert chunks.drain_limited(stream(), f"{folder}/run", 25).count() == 30
    got = chunks.drain_limited(stream(), f"{folder}/run", 45)
    assert got.count() >= 45 and got.groupBy("read_id").count().where("count <> 10").count() == 0
    assert chunks.drain_limited(stream(), f"{folder}/run", 10**6).count() == 60
    began = time.time()
    assert chunks.drain_limited(stream(), f"{folder}/idle", 10**6, idle=2.0).count() == 60
    assert time.time() - began < 60


def test_consumed_chunks_are_deleted(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for n in range(3):
        put_chunk(spark, folder, n, [(f"r{n}", 1, 0.5)], 1000)
    for _ in range(2):  # a chunk goes once a later batch has run
        chunks.drain(chunks.chunk_stream(spark, f"{folder}/chunks/chunk=*", CALLS, 1, delete=True), f"{folder}/run", "append")
        put_chunk(spark, folder, 7 + _, [(f"s{_}", 1, 0.5)], 1000)
    deadline = time.time() + 20
    gone = lambda: sum(not any(x.endswith(".parquet") for x in children(spark, f"{folder}/chunks/chunk={n}")) for n in range(3))
    while gone() < 2 and time.time() < deadline:
        time.sleep(0.5)
    assert gone() >= 2
    assert spark.read.parquet(*[f"{folder}/run/out/batch={n}" for n in written(spark, f"{folder}/run/out", "batch")]).count() == 4


@pytest.mark.parametrize("mode", ["complete", "append"])
def test_empty_streams(spark, tmp_path, mode):
    spark.createDataFrame([], CALLS).write.parquet(f"{tmp_path}/chunks")
    stream = chunks.chunk_stream(spark, f"{tmp_path}/chunks", CALLS, 1)
    if mode == "complete":
        stream = chunks.site_counts(stream.withColumnRenamed("read_pos", "pos"), ["pos"])
    assert chunks.drain(stream, f"file://{tmp_path}/run", mode).count() == 0
