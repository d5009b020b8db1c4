"""Global running sums and ranks without a single-task window: range partitions, their totals, inner windows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize


def running(df: DataFrame, by: str, sums: dict, ties: list | None = None) -> DataFrame:
    """df with running sums (name -> column) in ascending order of `by`, then of `ties`; rows with a null
    `by` are left out. Without ties, equal values are peers and get the same sums: group by them first.

    Rows are dealt by ranges of (by, ties), so many equal values spread over partitions where there are ties, and
    written with their range, as several steps read them. Ranges are as many as Spark's shuffle partitions.
    """
    order = [by, *(ties or [])]
    dealt = df.where(F.col(by).isNotNull()).withColumns({f"__v_{k}": v for k, v in sums.items()})
    dealt = materialize(dealt.repartitionByRange(*order).withColumn("__bucket", F.spark_partition_id()))
    totals = dealt.groupBy("__bucket").agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select("__bucket", *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in sums])
    inner = Window.partitionBy("__bucket").orderBy(*order)
    inner = inner.rowsBetween(Window.unboundedPreceding, 0) if ties else inner.rangeBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(totals), "__bucket").withColumns({k: F.sum(f"__v_{k}").over(inner) + F.col(f"__o_{k}") for k in sums})
    return out.drop(*[f"__{x}_{k}" for x in "vo" for k in sums])


def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """df with place: the number of each row, from 1, in the order of columns that together are unique."""
    return running(df, order[0], {"place": F.lit(1)}, order[1:]).drop("__bucket")


def step_up(df: DataFrame, p: str, out: str, ties: list) -> DataFrame:
    """Benjamini-Hochberg step-up of column p over all rows where it is not null."""
    ranked = running(df, p, {"__rank": F.lit(1)}, ties)
    total = ranked.agg(F.count("*").alias("__m"))
    ranked = ranked.crossJoin(F.broadcast(total)).withColumn("__raw", F.col(p) * F.col("__m") / F.col("__rank"))
    least = ranked.groupBy("__bucket").agg(F.min("__raw").alias("__least"))
    after = Window.orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    least = least.select("__bucket", F.min("__least").over(after).alias("__later"))
    inner = Window.partitionBy("__bucket").orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.join(F.broadcast(least), "__bucket").withColumn(out, F.least(F.lit(1.0), F.min("__raw").over(inner), "__later"))
    return ranked.drop("__bucket", "__rank", "__m", "__raw", "__later")


def first_by_hash(rows: DataFrame, groups: DataFrame, keys: list[str], prefix: Column, parts: list[Column], ties: list, need: str, total: str) -> DataFrame:
    """The rows of each group that come first by the md5 of `prefix` and `parts` joined by colons, then `ties`: as many
    as column `need` says.

    groups: the keys with `need` and the group's number of rows, `total`. Keys that rows lack number the draws of one
    row: prefix may use them, parts are the row's own and are joined once a row. A row meets the draws of its group as
    one list, and only hashes under a share of six standard deviations above need / total go on to be sorted, so that
    of a group of any size about `need` rows a draw move; draws where that share holds fewer rows than it should are
    sorted whole.
    """
    on = [c for c in keys if c in rows.columns]
    draws = [c for c in groups.columns if c not in on]
    share = (F.col(need) + 6 * F.sqrt(need) + 12) / F.col(total)
    bound = F.when(share >= 1, "g").otherwise(F.lpad(F.lower(F.hex(F.floor(share * 4294967296).cast("long"))), 8, "0"))
    own = F.when(F.coalesce(*[p.cast("string") for p in parts]).isNotNull(), F.concat_ws(":", *parts))

    def hashed(some, wanted):
        lists = wanted.groupBy(*on).agg(F.collect_list(F.struct(*draws, bound.alias("__bound"))).alias("__draws"))
        # merged, so that rows spread over tasks by their group, and Spark splits a large one
        met = some.withColumn("__own", own).hint("merge").join(lists, on).withColumn("__draw", F.explode("__draws"))
        met = met.select(*rows.columns, "__own", *[F.col(f"__draw.{c}").alias(c) for c in (*draws, "__bound")])
        return met.withColumn("__md5", F.md5(F.concat_ws(":", prefix, "__own"))).drop("__own")

    def ranked(some):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__md5", *ties))
        return some.withColumn("__rank", rank).where(F.col("__rank") <= F.col(need)).drop("__rank", "__md5")

    near = materialize(hashed(rows, groups).where(F.col("__md5") < F.col("__bound")).drop("__bound"))
    held = near.groupBy(*keys).agg(F.count("*").alias("__held"))
    short = groups.join(held, keys, "left").where(F.coalesce("__held", F.lit(0)) < F.least(need, total)).drop("__held")
    short = materialize(short)
    if short.first() is None:
        return ranked(near)
    fine = near.join(short.select(*keys), keys, "left_anti")
    return ranked(fine.unionByName(hashed(rows, short).select(*fine.columns)))
