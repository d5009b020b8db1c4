"""Read calls to sites: coverage, stoichiometry, histograms, scores and bootstrap."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize, setting
from .ranking import first_by_hash

SITE = ["contig", "pos", "ninemer"]
#: Defaults of a run: cutoffs of called and uncalled, least coverage, and when a site is bootstrapped.
HIGH, LOW, MIN_READS, DEEP, DEEP_STOICHIOMETRY, DRAWS, DRAW = 0.5, 0.5, 20, 150, 0.1, 21, 100
#: Scorers look at so many sites at once.
BATCH = 4096
#: Reads of a site above which they do not meet in one task.
HOT = 1 << 20


def clean(prob: Column) -> Column:
    """NaN as null: such a read counts for coverage and for nothing else."""
    return F.when(~F.isnan(prob), prob)


def coverage_stoichiometry(calls: DataFrame, keys: list[str] = SITE, high: float = HIGH, low: float = LOW, min_reads: int = MIN_READS) -> DataFrame:
    """Coverage and stoichiometry of sites with at least min_reads reads; reads between the cutoffs (and NaN)
    count for coverage only. Sites without a decided read are dropped."""
    p = clean(F.col("prob"))
    sites = calls.groupBy(*keys).agg(F.count("*").alias("coverage"), F.count_if(p > high).alias("n_mod"), F.count_if(p < low).alias("n_unmod"))
    sites = sites.where(F.col("coverage") >= min_reads).withColumn("stoichiometry", F.try_divide("n_mod", F.col("n_mod") + F.col("n_unmod")))
    return sites.where(F.col("stoichiometry").isNotNull())


def bin100(p: Column) -> Column:
    """floor(100 p) with 1 in the last bin."""
    return F.least(F.floor(p * 100).cast("int"), F.lit(99))


def bin99(p: Column) -> Column:
    """The older binning: values under 0.01 fall away and the rest moves down by one."""
    return F.when(p >= 0.01, F.least(F.floor(p * 100).cast("int"), F.lit(99)) - 1)


def bin_edges(p: Column, edges: list[float]) -> Column:
    """Half-open bins between ascending edges, the last one closed; outside: null."""
    inside = (p >= edges[0]) & (p <= edges[-1])
    return F.when(inside, F.least(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= p)) - 1, F.lit(len(edges) - 2)))


def histogram(calls: DataFrame, keys: list[str], bin_: Column, **more: Column) -> DataFrame:
    """Counts per site and bin; more: further conditions that are counted beside."""
    extra = [F.count_if(c).alias(k) for k, c in more.items()]
    return calls.withColumn("bin", bin_).where(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(F.count("*").alias("n"), *extra)


def dense(tall: DataFrame, keys: list[str], bins: int = 100, value: str = "n") -> DataFrame:
    """One row per site with the counts of all bins as an array (at most `bins` entries are gathered)."""
    found = F.map_from_entries(F.collect_list(F.struct("bin", value)))
    full = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at(F.col("__m"), i), F.lit(0)).cast("long"))
    return tall.groupBy(*keys).agg(found.alias("__m")).withColumn("histogram", full).drop("__m")


def base_composition(calls: DataFrame, keys: list[str] = SITE) -> DataFrame:
    """Called bases per site: A, C, G, T and others."""
    one = [F.count_if(F.col("base") == b).alias(f"n_{b.lower()}") for b in "ACGT"]
    return calls.groupBy(*keys).agg(*one, F.count_if(~F.coalesce(F.col("base"), F.lit("")).isin(*"ACGT")).alias("n_other"))


def draws(calls: DataFrame, deep: DataFrame, keys: list[str], order: list[Column], n_draws: int = DRAWS, size: int = DRAW) -> DataFrame:
    """n_draws samples of `size` reads of each listed site without replacement, by the order of a hash of draw
    and read. deep: the sites with their coverage. Rows: the reads, with their draw."""
    groups = deep.withColumns({"draw": F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))), "__need": F.lit(size)})
    return first_by_hash(calls, groups, [*keys, "draw"], F.col("draw").cast("string"), order, order, "__need", "coverage").drop("__need", "coverage")


def linear_scorer(features: np.ndarray) -> np.ndarray:
    """The stand-in for trained weights: one minus the mean bin of a histogram, over the last bin. Like a
    site model, it gives the probability of an unmodified site. Counts are summed whole and divided once, so that a
    site whose mean lies on a cutoff is not above it."""
    total = features.sum(axis=1) * (features.shape[1] - 1)
    return 1 - np.divide(features @ np.arange(features.shape[1]), total, out=np.full(len(features), np.nan), where=total > 0)


def score(df: DataFrame, features: str, out: str, scorer: Callable[[np.ndarray], np.ndarray], batch: int = BATCH) -> DataFrame:
    """df with the scorer's value for the array column `features`, in batches inside Arrow tasks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [scorer(np.stack(part[features].iloc[i : i + batch].to_numpy()).astype(np.float64)) for i in range(0, len(part), batch)]
            yield part.assign(**{out: np.concatenate(got) if got else np.zeros(0)})

    return df.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` double")


def drawn_lists(calls: DataFrame, deep: DataFrame, keys: list[str], order: list[str], bin_: str, n_draws: int = DRAWS, size: int = DRAW, bins: int = 100) -> DataFrame:
    """A row for each listed site: keys, coverage, and drawn, the ascending list of its candidates of all draws.

    A site's reads are shuffled once, and each tells by its hashes of which draws it may be among the first: those under
    a share of six standard deviations above size / coverage, so that a site of any depth has about n_draws * size
    candidates. They are sorted by draw, hash and order, and given as draw * (bins + 1) + bin + 1, 0 for a null bin.
    """
    share = (F.lit(size) + 6 * F.sqrt(F.lit(size)) + 12) / F.col("coverage")
    bound = F.when(share >= 1, "g").otherwise(F.lpad(F.lower(F.hex(F.floor(share * 4294967296).cast("long"))), 8, "0"))
    own = F.when(F.coalesce(*order).isNotNull(), F.concat_ws(":", *order))
    met = calls.select(*keys, bin_, *order).hint("merge").join(deep.select(*keys, "coverage", bound.alias("__bound")), keys)
    hashes = {f"__h{d}": F.md5(F.concat_ws(":", F.lit(str(d)), "__own")) for d in range(n_draws)}
    met = met.withColumn("__own", own).withColumns(hashes)
    under = [F.when(F.col(f"__h{d}") < F.col("__bound"), F.struct(F.lit(d).alias("draw"), F.col(f"__h{d}").alias("hash"))) for d in range(n_draws)]
    met = met.select(*keys, "coverage", F.struct(*[F.col(c) for c in order], F.col(bin_).alias("bin")).alias("read"), F.filter(F.array(*under), lambda x: x.isNotNull()).alias("under"))
    lists = met.where(F.size("under") > 0).groupBy(*keys, "coverage").agg(F.collect_list(F.struct("read", "under")).alias("found"))
    single = F.flatten(F.transform("found", lambda r: F.transform(r["under"], lambda u: F.struct(u["draw"].alias("draw"), u["hash"].alias("hash"), r["read"].alias("read")))))
    code = F.transform(F.sort_array(single), lambda x: x["draw"] * (bins + 1) + F.coalesce(x["read"]["bin"] + 1, F.lit(0)))
    return lists.select(*keys, "coverage", code.alias("drawn"))


def score_drawn(lists: DataFrame, keys: list[str], scorer: Callable[[np.ndarray], np.ndarray], n_draws: int = DRAWS, size: int = DRAW, bins: int = 100, batch: int = BATCH) -> DataFrame:
    """The scorer's value x for the histogram of the first `size` candidates of each draw of drawn_lists: keys, draw, x.
    Sites that have a draw with fewer candidates than it needs come with a null draw."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, batch // n_draws)
        for whole in parts:
            for at in range(0, len(whole), step):
                part = whole.iloc[at : at + step]
                n, lists = len(part), part["drawn"]
                codes = np.concatenate(lists.to_list())
                group = np.repeat(np.arange(n), lists.map(len)) * n_draws + codes // (bins + 1)
                held = np.bincount(group, minlength=n * n_draws)
                rank = np.arange(len(codes)) - (np.cumsum(held) - held)[group]
                bin_ = codes % (bins + 1) - 1
                keep = (rank < size) & (bin_ >= 0)
                counts = np.bincount(group[keep] * bins + bin_[keep], minlength=n * n_draws * bins).reshape(-1, bins)
                short = (held.reshape(n, n_draws) < np.minimum(size, part["coverage"].to_numpy())[:, None]).any(axis=1)
                fine = np.flatnonzero((counts.sum(axis=1) > 0) & ~np.repeat(short, n_draws))
                if len(fine):
                    yield part[keys].iloc[fine // n_draws].assign(draw=(fine % n_draws).astype(np.int32), x=scorer(counts[fine].astype(np.float64)))
                if short.any():
                    yield part[keys][short].assign(draw=pd.array([None] * int(short.sum()), "Int32"), x=np.nan)

    return lists.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lists.select(*keys).schema) + ", draw int, x double")


def site_probabilities(calls: DataFrame, keys: list[str], order: list[Column], scorer=linear_scorer, cutoff: float = -1.0, min_reads: int = MIN_READS, bootstrap: bool = True) -> DataFrame:
    """Sites with the probability of modification: the scorer's complement, averaged over bootstrap draws for
    deep sites with enough stoichiometry; order: what tells a site's reads apart, as text. bootstrap: False scores all
    reads of every site at once.

    Reads move once, with their bin and order: draws are made where a site's reads meet. Only sites of over HOT reads,
    or with a draw that has too few candidates, are drawn read by read.
    """
    deep = (F.col("coverage") > DEEP) & (F.col("stoichiometry") > DEEP_STOICHIOMETRY)
    sites = coverage_stoichiometry(calls, keys, min_reads=min_reads).withColumn("__deep", deep if bootstrap else F.lit(False))
    sites = materialize(sites)
    names = [f"__o{i}" for i in range(len(order))]
    calls = calls.select(*keys, bin100(clean(F.col("prob"))).alias("bin"), *[o.alias(n) for o, n in zip(order, names, strict=True)])

    def scored(reads):
        tall = reads.where(F.col("bin").isNotNull()).groupBy(*keys, "draw", "bin").agg(F.count("*").alias("n"))
        return score(dense(tall, [*keys, "draw"]), "histogram", "x", scorer).select(*keys, "draw", "x")

    shallow = sites.where(~F.col("__deep")).select(*keys)
    found = [scored(calls.select(*keys, "bin").join(shallow, keys, "left_semi").withColumn("draw", F.lit(0)))]
    deep = sites.where("__deep").select(*keys, "coverage")
    if deep.first() is not None:
        hot = deep.where(F.col("coverage") > HOT)  # a million reads each: few beside the input
        few = calls.join(F.broadcast(hot.select(*keys)), keys, "left_anti") if hot.first() is not None else calls
        lists = drawn_lists(few, deep.where(F.col("coverage") <= HOT), keys, names, "bin")
        with setting(calls.sparkSession, "spark.sql.execution.useObjectHashAggregateExec", "false"):  # lists of one site after another, as they are sorted
            drawn = materialize(score_drawn(lists, keys, scorer))
        found.append(drawn.where(F.col("draw").isNotNull()))
        rest = materialize(hot.unionByName(deep.join(drawn.where(F.col("draw").isNull()).select(*keys), keys, "left_semi")))
        if rest.first() is not None:
            found.append(scored(draws(calls, rest, keys, [F.col(n) for n in names])))
    x = found[0]
    for more in found[1:]:
        x = x.unionByName(more)
    return sites.drop("__deep").join(x.groupBy(*keys).agg(F.avg(1 - F.col("x")).alias("probability")), keys).where(F.col("probability") > cutoff)


def features_of(calls: DataFrame, keys: list[str], kind: str, edges: list[float] | None = None) -> DataFrame:
    """Counts per site and bin by the chosen features: bins100, bins99 or percentile (with edges)."""
    p = clean(F.col("prob"))
    made = {"bins100": bin100, "bins99": bin99, "percentile": lambda x: bin_edges(x, edges or [0.0, 1.0])}
    if kind not in made:
        raise ValueError(f"features must be one of {sorted(made)}")
    return histogram(calls, keys, made[kind](p))
