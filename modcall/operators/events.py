"""Ordered operators on event rows: islands, sliding 9-mers, merging, trimming, quotas, shards."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

#: The most rows of a group that Spark limits before a shuffle.
EARLY = "spark.sql.optimizer.windowGroupLimitThreshold"
#: Signals kept per 9-mer at read level; skipped and kept at site level.
READ_LIMIT, SITE_SKIP, SITE_LIMIT = 500, 500, 1500


def islands(events: DataFrame, read: list[str], pos: str = "pos") -> DataFrame:
    """events with island: equal within a run of consecutive positions of one read; rows of one position share it."""
    return events.withColumn("island", F.col(pos) - F.dense_rank().over(Window.partitionBy(*read).orderBy(pos)))


def ninemers(events: DataFrame, read: list[str], centre: str | None = None) -> DataFrame:
    """A row per five consecutive 5-mers: start, the 9-mer and the five events, by a window of five rows.

    A gap or another read starts anew; a run of n k-mers gives max(0, n - 4) rows. centre: only 9-mers with
    this base in the middle. Merge rows of one position first: windows that hold a position twice are left out.
    """
    trail = Window.partitionBy(*read, "island").orderBy("pos").rowsBetween(-4, 0)
    found = islands(events, read).withColumn("five", F.collect_list(F.struct("pos", "kmer", "samples")).over(trail)).where((F.size("five") == 5) & (F.col("five")[4]["pos"] - F.col("five")[0]["pos"] == 4))
    ends = F.transform(F.slice("five", 2, 4), lambda e: F.right(e["kmer"], F.lit(1)))
    out = found.select(*read, F.col("five")[0]["pos"].alias("start"), F.concat(F.col("five")[0]["kmer"], F.array_join(ends, "")).alias("ninemer"), "five")
    return out.where(F.substring("ninemer", 5, 1) == centre) if centre else out


def merge_events(events: DataFrame, read: list[str], line: str = "line_no") -> DataFrame:
    """Rows of one position of a read as one, each row's samples reversed, joined in line order."""
    rows = F.array_sort(F.collect_list(F.struct(line, "samples")))
    joined = F.flatten(F.transform(rows, lambda r: F.reverse(r["samples"])))
    return events.groupBy(*read, "pos").agg(F.min(line).alias(line), joined.alias("samples"))


def take(rows: DataFrame, per: list[str], order: list, limit: int, skip: int = 0) -> DataFrame:
    """Rows skip + 1 to limit of each group in order; Spark limits the groups before the shuffle, in each task, which it
    by itself does up to a thousand rows only."""
    if limit > int(rows.sparkSession.conf.get(EARLY, "1000")):
        rows.sparkSession.conf.set(EARLY, str(limit))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order)))
    return ranked.where((F.col("rank") > skip) & (F.col("rank") <= limit))


def within_quota(rows: DataFrame, quotas: DataFrame, order: list, key: str = "ninemer") -> DataFrame:
    """The first rows of each listed 9-mer, as many as its quota says; the last quota listed counts.

    A task passes on at most as many rows of a 9-mer as the largest quota, so a frequent 9-mer does not meet whole in
    one task."""
    last = materialize(quotas.groupBy(key).agg(F.max_by("max_n", "line_no").alias("max_n")))
    largest = last.agg(F.max("max_n")).first()[0] or 0  # one number
    ranked = take(rows.join(last, key), [key], order, largest)
    return ranked.where(F.col("rank") <= F.col("max_n"))


def shard(rank: Column, total: Column, shards: int) -> Column:
    """The contiguous shard of the row of this rank (from 1); the last shard takes the rest."""
    return F.least(F.floor((rank - 1) / F.greatest(F.floor(total / shards), F.lit(1))), F.lit(shards - 1)).cast("int")


def trimmed(events: DataFrame, read: list[str], order: list, limit: int = READ_LIMIT, skip: int = 0, same: tuple[str, str] | None = None) -> DataFrame:
    """Windows of five events of each 9-mer, from skip + 1 to limit. same: columns of the model's and the
    reference's k-mer, of which only events that agree count."""
    some = events.where(F.col(same[0]) == F.col(same[1])) if same else events
    return take(ninemers(some, read), ["ninemer"], order, limit, skip)


def event_lines(windows: DataFrame, read: list[str]) -> DataFrame:
    """The events of kept windows, one row each; overlapping windows repeat them."""
    return windows.select("ninemer", *read, "start", "rank", F.explode("five").alias("e")).select("ninemer", *read, "start", "rank", "e.*")
