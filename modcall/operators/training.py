"""Training-data operators: splits, assembly and simulated mixtures; all draws come from hashes."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize
from .events import take
from .ranking import first_by_hash, running


def stratified_split(rows: DataFrame, per: list[str], order: list, limit: int, train: float = 0.6, validate: float = 0.2) -> DataFrame:
    """rows with split, by the running number in each group: train, validation, test, none beyond the limit."""
    sizes = rows.groupBy(*per).agg(F.least(F.count("*"), F.lit(limit)).alias("__m"))
    ranked = take(rows, per, order, limit).join(sizes, per)
    name = F.when(F.col("rank") <= train * F.col("__m"), "train").when(F.col("rank") <= (train + validate) * F.col("__m"), "validation").otherwise("test")
    return ranked.withColumn("split", name).drop("rank", "__m")


def hashed(n: int, *parts: Column) -> Column:
    """A whole number from 0 to n - 1 from the md5 of the parts, the same in any engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long") % n).cast("int")


def random_split(rows: DataFrame, key: Column, seed: int = 1) -> DataFrame:
    """rows with split: 60, 20 and 20 per cent by a hash of the key."""
    u = hashed(100, F.lit(seed), key)
    return rows.withColumn("split", F.when(u < 60, "train").when(u < 80, "validation").otherwise("test"))


def assemble(positive: DataFrame, negative: DataFrame) -> DataFrame:
    return positive.withColumn("label", F.lit(1)).unionByName(negative.withColumn("label", F.lit(0)))


def vectors(rows: DataFrame, size: int, features: str = "features") -> DataFrame:
    """rows with one vector of `size` numbers each, and its number (vector) in the row: an array of any depth is laid out
    flat and cut. An array that does not divide is an error; null gives no vector."""
    flat, kind = F.col(features), rows.schema[features].dataType
    while kind.elementType.typeName() == "array":
        flat, kind = F.flatten(flat), kind.elementType
    whole = F.when(F.size(flat) % size == 0, flat).otherwise(F.raise_error(F.concat(F.lit(f"not a whole number of vectors of {size}: "), F.size(flat).cast("string"))))
    count = F.floor(F.size(flat) / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(whole, i * size + 1, size))
    some = rows.where(F.size(features) > 0)
    others = [F.col(c) for c in rows.columns if c != features]
    return some.select(*others, F.posexplode(parts).alias("vector", features))


def test_table(rows: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """The rows of the test split in the order of a hash of a unique key, with their place in it."""
    return shuffled(rows.where(F.col("split") == "test").drop("split"), key, seed)


#: Plans that are tried for a set of reads before drawing gives up.
TRIALS = 50


def _plans(kmers: DataFrame, rounds: int, kind: str) -> DataFrame:
    """A row per k-mer and round with the first plan of TRIALS that its reads (have_mod, have_unmod) suffice for, null
    if none does: how many reads to draw, modified and in between."""
    plan = kmers.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))

    def drawn(trial):
        again = F.when(trial > 0, trial)  # the first trial has no number in its hashes
        n, s, v = (hashed(most, F.lit(kind + what), F.col("kmer"), F.col("round"), again) + least for what, most, least in (("n", 990, 10), ("s", 90, 10), ("v", 8, 0)))
        mod = s * n / 100 if kind == "ko" else v * n / (200 if kind == "wt_added" else 100)
        mod = F.floor(mod).cast("int")
        return F.struct(n.alias("n"), mod.alias("n_mod"), (mod if kind == "wt_added" else F.lit(0)).alias("n_mid"))

    def enough(d):
        return (d["n_mod"] <= F.col("have_mod")) & (d["n"] - d["n_mod"] - d["n_mid"] <= F.col("have_unmod"))

    plan = plan.withColumn("first", drawn(F.lit(0)))
    others = F.filter(F.transform(F.sequence(F.lit(1), F.lit(TRIALS - 1)), drawn), enough)
    return plan.withColumn("plan", F.when(enough(F.col("first")), F.col("first")).otherwise(F.get(others, F.lit(0)))).select("kmer", "round", "have_mod", "have_unmod", "plan.*")


def mixtures(modified: DataFrame, unmodified: DataFrame, kind: str, rounds: int, centre: str = "A") -> DataFrame:
    """Simulated read sets (kmer, round, prob, base, origin) of k-mers that both sides (kmer, id, prob, base) hold.

    kind ko: a share s of 10 to 99 per cent of n reads, 10 to 999, is modified; wt_simple: a noise of 0 to 7 per cent;
    wt_added: half of the noise modified and half uniform between 0.2 and 0.8 with any base. Reads are drawn without
    replacement by the order of a hash. Where a k-mer has too few reads on a side, n and the shares are drawn anew, and
    after TRIALS in vain a synthetic set stands in, with `centre` as base.
    """
    both = modified.groupBy("kmer").agg(F.count("*").alias("have_mod")).join(unmodified.groupBy("kmer").agg(F.count("*").alias("have_unmod")), "kmer")
    plan = materialize(_plans(both, rounds, kind))
    parts = []
    for origin, rows, need in (("mod", modified, F.col("n_mod")), ("unmod", unmodified, F.col("n") - F.col("n_mod") - F.col("n_mid"))):
        groups = plan.where("n is not null").select("kmer", "round", need.cast("int").alias("__need"), F.col(f"have_{origin}").alias("__all"))
        prefix = F.concat_ws(":", F.lit(kind + origin), F.col("round").cast("string"))
        drawn = first_by_hash(rows, groups, ["kmer", "round"], prefix, [F.col("id")], ["id"], "__need", "__all")
        parts.append(drawn.select("kmer", "round", "prob", "base", F.lit(origin).alias("origin")))
    mid = plan.where("n_mid > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n_mid"))))
    value = 0.2 + 0.6 * hashed(1000000, F.lit("mid"), F.col("kmer"), F.col("round"), F.col("i")) / 1000000
    base = F.substr(F.lit("ACGT"), hashed(4, F.lit("base"), F.col("kmer"), F.col("round"), F.col("i")) + 1, F.lit(1))
    parts.append(mid.select("kmer", "round", value.cast("double").alias("prob"), base.alias("base"), F.lit("mid").alias("origin")))
    given_up = fallback(plan.where("n is null"), kind, ["kmer", "round"])
    parts.append(given_up.select("kmer", "round", "prob", F.lit(centre).alias("base"), F.lit("fallback").alias("origin")))
    return reduce(DataFrame.unionByName, parts)


#: A set that stands in where drawing gives up: how many values are low and how many others, and from where to where
#: each lie.
FALLBACK = {"ko": (50, 50, (0.0, 0.1), (0.5, 1.0)), "wt_added": (92, 8, (0.0, 0.1), (0.2, 0.8)), "wt_simple": (92, 8, (0.0, 0.1), (0.2, 0.8))}


def fallback(kmers: DataFrame, kind: str, keys: list[str] | None = None) -> DataFrame:
    """A synthetic set of 100 values for each k-mer (and other keys) that cannot be drawn, by hashes of keys and
    place."""
    keys = keys or ["kmer"]
    low, others, *spans = FALLBACK[kind]
    rows = kmers.select(*keys).distinct().withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(low + others))))
    u = hashed(1000000, F.lit("fallback"), *[F.col(k) for k in keys], F.col("i")) / 1000000
    first, second = (a + (b - a) * u for a, b in spans)
    return rows.withColumns({"prob": F.when(F.col("i") <= low, first).otherwise(second), "origin": F.when(F.col("i") <= low, "low").otherwise("mid")})


def shuffled(rows: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """rows with place: their rank in the order of a hash of a key that is unique."""
    return running(rows.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))), "__h", {"place": F.lit(1)}, [key]).drop("__h", "__bucket")


def remaining(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that an earlier run has not written yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")
