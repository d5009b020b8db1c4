"""Evaluation metrics of paired site scores (columns wt and ivt)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import running


def ks_distance(pairs: DataFrame) -> DataFrame:
    """The largest gap between both samples' distribution functions, to four places (ks_d)."""
    values = pairs.select(F.explode(F.array(F.struct(F.col("wt").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col("ivt").alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("s")).select("s.*")
    values = values.where("x is not null").groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    steps = running(values, "x", {"ra": F.col("a"), "rb": F.col("b")})
    total = F.broadcast(values.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")))
    return steps.crossJoin(total).agg(F.round(F.max(F.abs(F.col("ra") / F.col("na") - F.col("rb") / F.col("nb"))), 4).alias("ks_d"))


def top_odds(pairs: DataFrame, percents: list[int]) -> DataFrame:
    """For each k: the share of wt over the share of ivt at or above the (100 - k)th percentile of both."""
    both = pairs.select(F.explode(F.array("wt", "ivt")).alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    upto, total = running(both, "x", {"upto": F.col("n")}), both.agg(F.sum("n").alias("all"))
    edges = []
    for k in percents:  # between the values of the two whole ranks around the percentile
        place = (F.col("all") - 1) * F.lit(1 - k / 100)
        low, high = (F.min(F.when(F.col("upto") > f(place), F.col("x"))) for f in (F.floor, F.ceil))
        edges.append((low + (high - low) * F.max(place - F.floor(place))).alias(f"e{k}"))
    edge = F.broadcast(upto.crossJoin(F.broadcast(total)).agg(*edges))
    shares = pairs.crossJoin(edge).agg(*[x for k in percents for x in (F.count_if(F.col("wt") >= F.col(f"e{k}")).alias(f"w{k}"), F.count_if(F.col("ivt") >= F.col(f"e{k}")).alias(f"i{k}"))], F.count("wt").alias("nw"), F.count("ivt").alias("ni"))
    ratio = [F.try_divide(F.col(f"w{k}") / F.col("nw"), F.col(f"i{k}") / F.col("ni")).alias(f"odds{k}") for k in percents]
    return shares.select(*ratio)


def mean_delta(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.round(F.avg(F.col("wt") - F.col("ivt")), 3).alias("avg_delta_stoich"))


def pearson(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.round(F.coalesce(F.corr("wt", "ivt"), F.lit(0.0)), 3).alias("pearsonr"))


def average_ranks(pairs: DataFrame, column: str, out: str) -> DataFrame:
    """pairs with the rank of a column, ties sharing their mean rank."""
    sizes = pairs.groupBy(column).agg(F.count("*").alias("__n"))
    upto = running(sizes, column, {"__upto": F.col("__n")}).select(column, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(out))
    return pairs.join(upto, column)


def spearman(pairs: DataFrame) -> DataFrame:
    whole = pairs.where("wt is not null and ivt is not null")
    ranked = average_ranks(average_ranks(whole, "wt", "rw"), "ivt", "ri")
    return ranked.agg(F.round(F.coalesce(F.corr("rw", "ri"), F.lit(0.0)), 3).alias("spearmanr"))


def metric_row(pairs: DataFrame, epoch: int, percents: list[int]) -> DataFrame:
    """All metrics of an epoch as one row, in the order of a metrics table."""
    out = ks_distance(pairs).withColumn("epoch", F.lit(epoch))
    for one in (top_odds(pairs, percents), mean_delta(pairs), pearson(pairs), spearman(pairs)):
        out = out.crossJoin(F.broadcast(one))
    return out.select("epoch", "ks_d", *[f"odds{k}" for k in percents], "avg_delta_stoich", "pearsonr", "spearmanr")
