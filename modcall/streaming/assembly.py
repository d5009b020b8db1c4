"""Reads whose calls are spread over chunk files: state kept from batch to batch until no more can come."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.modtags import tags_of

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows are not counted, which takes a look-up for each write, and a batch saves what it changed, not its files.
LEAN = {"spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def gather_reads(chunks: DataFrame, time: str = "written", late: str = "1 minute", wait: str = "1 minute") -> DataFrame:
    """A row (read_id, calls) for each read of a stream of calls (read_id, read_pos, prob, `time`), once.

    Calls of one read may come in any chunks and batches: they are one session, in which no chunk is `wait` or more
    behind the one before it. It is complete when the stream's time is `wait` and `late` beyond its last chunk; chunks
    may come `late` behind the newest one. Later ones are left out, as Spark does with all late rows, when they are
    `wait` more behind; those between join their read if it is still held, else they come as a row of their own. Rows
    without a read_id carry no call and only move the time on: one far ahead closes the stream. State holds the calls
    of unfinished reads only, in RocksDB on the executors.
    """
    spark = chunks.sparkSession
    if "RocksDB" not in (spark.conf.get(PROVIDER, None) or ""):
        spark.conf.set(PROVIDER, ROCKS)
    for name, value in LEAN.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    call = F.struct(F.col("read_pos").cast("long").alias("read_pos"), F.col("prob").cast("double").alias("prob"))
    rows = chunks.withWatermark(time, late).select("read_id", call.alias("call"), time)
    reads = rows.groupBy("read_id", F.session_window(time, wait)).agg(F.collect_list("call").alias("calls"), F.count("read_id").alias("__n"))
    # a filter on read_id itself would go below the watermark, and rows without one not move the time
    return reads.where(F.col("__n") > 0).select("read_id", "calls")


def stream_tags(chunks: DataFrame, **times: str) -> DataFrame:
    """MM text and ML values of the complete reads of a stream of calls: read_id, positions, mm, ml."""
    return tags_of(gather_reads(chunks, **times))
