"""Differential modification between conditions: filters, closed-form tests and step-up correction.

Input is tall: a row per (contig, position, site, condition, rep) with coverage, stoichiometry, probability,
so any number of replicates and any condition name work.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import chi2_tail, chi2_tail_one, chi2_tail_two, f_tail, f_tail_one, f_tail_two, log_likelihood
from ..scratch import materialize
from .ranking import step_up

KEYS = ["contig", "position", "site"]


def pivot_replicates(preds: DataFrame) -> DataFrame:
    """A row per site and condition with the replicates' values as arrays in the replicates' order."""
    rows = F.array_sort(F.collect_list(F.struct("rep", "coverage", "stoichiometry", "probability")))
    got = preds.groupBy(*KEYS, "condition").agg(rows.alias("r"))
    return got.select(*KEYS, "condition", *[F.col(f"r.{c}").alias(c) for c in ("rep", "coverage", "stoichiometry", "probability")])


def condition_totals(preds: DataFrame, min_prob: float = 0.0, min_stoich: float = 0.0) -> DataFrame:
    """Sufficient statistics of every site and condition, without gathering replicates."""
    c, s = F.coalesce("coverage", F.lit(0)), F.coalesce(F.nanvl(F.col("stoichiometry"), F.lit(None).cast("double")), F.lit(0.0))
    hit = F.bround(c * s)
    return preds.groupBy(*KEYS, "condition").agg(
        F.sum(c * s).alias("weighted"), F.sum(c).cast("double").alias("reads"), F.sum(hit).alias("hits"), F.count_if(c > 0).alias("rows"),
        (F.coalesce(F.max("probability") > min_prob, F.lit(False)) & F.coalesce(F.max("stoichiometry") > min_stoich, F.lit(False)) & (F.count("coverage") > 0)).alias("passes"),
    )


def site_tests(preds: DataFrame, conditions: list[str], min_prob: float = 0.0, min_stoich: float = 0.0, require: str = "all", contrast: str = "range") -> DataFrame:
    """A row per site with averages, delta, deviance, the test that applies and its degrees.

    require: all conditions pass the filters, or any. contrast: range is the largest minus the smallest
    average; last_two compares the last two conditions given. Degrees follow the conditions that a site has.
    """
    totals = condition_totals(preds.where(F.col("condition").isin(conditions)), min_prob, min_stoich).withColumn("average", F.try_divide("weighted", "reads"))
    own = [F.max(F.when(F.col("condition") == c, F.col("average"))).alias(f"__a{i}") for i, c in enumerate(conditions)]
    sites = totals.groupBy(*KEYS).agg(
        F.count_if("passes").alias("n_pass"), F.bool_and(F.col("rows") == 1).alias("single"), F.count("*").alias("__k"), F.sum("rows").alias("n_rows"),
        F.sum(log_likelihood(F.col("weighted"), F.col("reads"))).alias("__w"), F.sum("weighted").alias("__ws"), F.sum("reads").alias("__n"),
        F.sum(log_likelihood(F.col("hits"), F.col("reads"))).alias("__h"), F.sum("hits").alias("__hs"), *own,
    )
    k = len(conditions)
    sites = sites.where(F.col("n_pass") >= (k if require == "all" else 1))
    single = F.col("single") & (F.col("__k") == k)
    chi = 2 * (F.col("__w") - log_likelihood(F.col("__ws"), F.col("__n")))
    rounded = 2 * (F.col("__h") - log_likelihood(F.col("__hs"), F.col("__n")))
    averages = [F.col(f"__a{i}") for i in range(k)]
    delta = F.abs(averages[-1] - averages[-2]) if contrast == "last_two" else F.greatest(*averages) - F.least(*averages)
    named = [a.alias(f"avg_stoichi_{c}") for a, c in zip(averages, conditions, strict=True)]
    return sites.select(
        *KEYS, *named, delta.alias("delta"), F.when(single, "chi2").otherwise("F").alias("test"),
        F.greatest(F.lit(0.0), F.when(single, chi).otherwise(rounded)).alias("deviance"), (F.col("__k") - 1).cast("int").alias("df1"), (F.col("n_rows") - (F.col("__k") - 1)).cast("int").alias("df2"),
    )


def p_value(k: int, require: str = "all") -> Column:
    """The tail of the test of each row; native but for chi square of one degree and more than three conditions.
    With require any, sites may have fewer conditions than k, down to one, which gives null."""
    g, df1, df2 = F.col("deviance"), F.col("df1").cast("double"), F.col("df2")
    if require != "all":
        return F.when(F.col("test") == "chi2", chi2_tail(g, df1)).when((df2 > 0) & (df1 > 0), f_tail(g / df1, df1, df2.cast("double")))
    chi = chi2_tail_one(g) if k == 2 else chi2_tail_two(g) if k == 3 else chi2_tail(g, F.lit(float(k - 1)))
    f = f_tail_one(g, df2) if k == 2 else f_tail_two(g / 2, df2) if k == 3 else f_tail(g / (k - 1), F.lit(float(k - 1)), df2.cast("double"))
    return F.when(F.col("test") == "chi2", chi).when(df2 > 0, f)


def differential(preds: DataFrame, conditions: list[str], min_delta: float = 0.0, **how) -> DataFrame:
    """Sites with pval and adj_pval. Sites under min_delta get adj_pval 1 and do not count as tests."""
    tested = site_tests(preds, conditions, **how).withColumn("pval", p_value(len(conditions), how.get("require", "all")))
    fit = (F.col("delta") >= min_delta) & F.col("pval").isNotNull()
    tested = materialize(tested)
    adjusted = step_up(tested.where(fit), "pval", "adj_pval", KEYS)
    return adjusted.unionByName(tested.where(~F.coalesce(fit, F.lit(False))).withColumn("adj_pval", F.lit(1.0)))


def report(tested: DataFrame, dropped: list[str]) -> DataFrame:
    """The result table in the order of its keys, without columns whose names start with any of `dropped`."""
    return tested.select(*[c for c in tested.columns if not c.startswith(tuple(dropped))]).orderBy(*KEYS)
