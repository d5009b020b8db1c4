"""Queries that run as streams over chunk files of the driver's tables, with the SQL of the whole tables."""

from pyspark.sql import functions as F

from ..scratch import children, materialize, shared_folder
from ..streaming import assembly, chunks
from .adapters import RC, read_calls, unique_calls
from .catalogue import ORACLE_SQL, query


@query(ORACLE_SQL["mm_tag"])
def stream_read_tags(spark, sf_dir):
    """mm_tag of calls whose reads are split over three chunks, which come in three batches."""
    folder = shared_folder(spark)
    calls = unique_calls(spark, sf_dir).select("read_id", F.col("read_pos").cast("int").alias("read_pos"), "prob")
    dealt = materialize(calls.withColumn("chunk", F.pmod(F.hash("read_id", "read_pos"), F.lit(3))))
    schema = "read_id long, read_pos int, prob double, written timestamp"
    files = 1
    for n in range(3):
        path = f"{folder}/chunks/chunk={n}"
        part = dealt.where(F.col("chunk") == n).drop("chunk").withColumn("written", F.timestamp_seconds(F.lit(1000 + n)))
        part.write.parquet(path)
        files = max(files, sum(x.endswith(".parquet") for x in children(spark, path)))
    chunks.close_stream(spark, f"{folder}/chunks/chunk=3", schema, "written", 86400)
    # a chunk a batch, however many files it has: batches do not grow in number with the calls
    stream = assembly.stream_tags(chunks.chunk_stream(spark, f"{folder}/chunks/chunk=*", schema, files))
    got = chunks.drain(stream, f"{folder}/run", "append")
    return got.select("read_id", "mm", F.array_join(F.col("ml").cast("array<string>"), ",").alias("ml"))


@query(f"WITH {RC} SELECT count(*) // 3 AS row_limit, true AS reached, true AS within_a_batch FROM rc")
def stream_limit(spark, sf_dir):
    """Scored calls of a stream that stops at a third of all: enough rows, and fewer without the last batch."""
    folder = shared_folder(spark)
    calls = read_calls(spark, sf_dir).select("read_id", "read_pos", "prob")
    calls.repartition(6).write.parquet(f"{folder}/chunks")
    limit = calls.count() // 3
    stream = chunks.chunk_stream(spark, f"{folder}/chunks", calls.schema, 1).withColumn("score", 1 - F.col("prob"))
    got = chunks.drain_limited(stream, f"{folder}/run", limit)
    by = got.groupBy("batch").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max_by("n", "batch").alias("last"))
    return by.select(F.lit(limit).cast("long").alias("row_limit"), (F.col("n") >= limit).alias("reached"), (F.col("n") - F.col("last") < limit).alias("within_a_batch"))
