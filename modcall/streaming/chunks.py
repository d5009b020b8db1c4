"""Chunk files as a stream: scoring and site counts in micro-batches."""

import time

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sites import bin100, clean
from ..scratch import remove, written


def chunk_stream(spark: SparkSession, path: str, schema, files: int = 4, delete: bool = False) -> DataFrame:
    """Parquet chunks of a folder (globs reach several writers) as a stream of at most `files` files a batch.
    delete: remove chunks whose batch is committed."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return (reader.option("cleanSource", "delete") if delete else reader).parquet(path)


def close_stream(spark: SparkSession, path: str, schema: str, column: str, seconds: int) -> None:
    """A last chunk without a value but the time in `column`, `seconds` from the epoch: the stream's time moves on to it."""
    row = spark.range(1).select(F.timestamp_seconds(F.lit(seconds)).alias(column))
    empty = spark.createDataFrame([], schema)
    empty.unionByName(row, allowMissingColumns=True).write.parquet(path)


def site_counts(calls: DataFrame, keys: list[str], high: float = 0.5, low: float = 0.5) -> DataFrame:
    """Mergeable statistics of sites, for a stream or a table: coverage, decided reads, and bin sums."""
    p = clean(F.col("prob"))
    return calls.groupBy(*keys).agg(F.count("*").alias("coverage"), F.count_if(p > high).alias("n_mod"), F.count_if(p < low).alias("n_unmod"), F.sum(bin100(p)).cast("long").alias("bin_sum"))


ENOUGH = "the stream has given as many rows as were asked for"
COUNTS = ["coverage", "n_mod", "n_unmod", "bin_sum"]


def drain(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and return the result table; folder: shared, for state and output.

    Every batch writes a folder of its own number, so a batch that runs again replaces its own rows only. An
    aggregate's whole result is the newest such folder (complete), and older ones go once it is committed; otherwise
    the result is all of them (append).
    """
    spark, out = stream.sparkSession, f"{folder}/out"

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        for old in written(spark, out, "batch") if mode == "complete" else []:
            if old < n:
                remove(spark, f"{out}/batch={old}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    found = [f"{out}/batch={n}" for n in written(spark, out, "batch")]
    return spark.read.parquet(*(found[-1:] if mode == "complete" else found)) if found else spark.createDataFrame([], stream.schema)


class SiteTable:
    """Statistics of sites that grow with a stream, without state: a partial table for each batch, merged now and then.

    A partial is named after its batch. Merging writes one table of all up to a batch, then removes what it replaces; a
    reader takes the newest committed merge and the partials behind it. A batch that runs again replaces its own
    partial, or nothing once it is merged. A batch costs its own sites, and every `every` batches all sites once.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], every: int = 8):
        self.spark, self.folder, self.keys, self.every = spark, folder, keys, every

    def _parts(self) -> list[str]:
        merged = written(self.spark, f"{self.folder}/merged", "upto")[-1:]
        last = merged[0] if merged else -1
        later = [n for n in written(self.spark, f"{self.folder}/partial", "batch") if n > last]
        return [*(f"{self.folder}/merged/upto={n}" for n in merged), *(f"{self.folder}/partial/batch={n}" for n in later)]

    def put(self, batch: DataFrame, n: int) -> None:
        """What foreachBatch calls."""
        if any(m >= n for m in written(self.spark, f"{self.folder}/merged", "upto")):
            return
        site_counts(batch, self.keys).write.mode("overwrite").parquet(f"{self.folder}/partial/batch={n}")
        if (n + 1) % self.every == 0:
            self.merge(n)

    def merge(self, n: int) -> None:
        parts = self._parts()
        self.table().write.mode("overwrite").parquet(f"{self.folder}/merged/upto={n}")
        for path in parts:
            remove(self.spark, path)

    def table(self) -> DataFrame | None:
        """The statistics so far, None before the first batch."""
        parts = self._parts()
        return self.spark.read.parquet(*parts).groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in COUNTS]) if parts else None


def drain_sites(calls: DataFrame, folder: str, keys: list[str], every: int = 8) -> DataFrame | None:
    """Site statistics of a stream of calls (keys, prob) over all that is there now."""
    table = SiteTable(calls.sparkSession, f"{folder}/sites", keys, every)
    query = calls.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(table.put).start()
    query.awaitTermination()
    return table.table()


def stop_when(query, enough, idle: float | None = None, poll: float = 0.2) -> None:
    """Wait for a stream: until it ends, enough() holds, or no batch has run for `idle` seconds; stop it then."""
    seen, since = None, time.monotonic()
    while not query.awaitTermination(poll):
        now = query.lastProgress
        if now is not None and now.batchId != seen and now.numInputRows:
            seen, since = now.batchId, time.monotonic()
        if enough() or idle is not None and time.monotonic() - since > idle and not query.status["isTriggerActive"]:
            query.stop()


def drain_limited(stream: DataFrame, folder: str, limit: int, idle: float | None = None) -> DataFrame:
    """Rows of a stream until there are `limit` of them, at most the rest of one batch more; the rows by batch.

    Batches are counted by their number in the result itself, so one that runs again counts once and a restart goes on
    from what is there, or writes nothing where that is enough. The stream is stopped as soon as it is. idle: run on
    as files come in and end after so many seconds without any; by default only what is there now is read.
    """
    spark, out = stream.sparkSession, f"{folder}/out"
    rows: dict[int, int] = {n: spark.read.parquet(f"{out}/batch={n}").count() for n in written(spark, out, "batch")}

    def enough() -> bool:
        return sum(rows.values()) >= limit

    def put(batch: DataFrame, n: int) -> None:
        if sum(v for k, v in rows.items() if k < n) >= limit:
            raise RuntimeError(ENOUGH)  # so that this batch is not committed and a later run with a higher limit has it
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        rows[n] = spark.read.parquet(f"{out}/batch={n}").count()  # from the files' footers

    if not enough():
        writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(put)
        query = (writer.trigger(availableNow=True) if idle is None else writer.trigger(processingTime="200 milliseconds")).start()
        try:
            stop_when(query, enough, idle)
        except StreamingQueryException as error:
            if ENOUGH not in str(error):
                raise
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(out) if rows else spark.createDataFrame([], stream.schema.add("batch", "long"))
