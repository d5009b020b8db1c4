"""9-mer features: expected currents, quality channel and the 180 x 7 tensor."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import BASES
from ..functions.signal import POINTS, let, resample


def expected(windows: DataFrame, model: DataFrame) -> DataFrame:
    """windows with expected: five arrays of the model's means for A, C, G, T in the centre; null if unknown.

    The model has one row per 5-mer, 4**5 at most of the four bases (others are left out, of repeated ones the
    smallest mean counts), and is broadcast as a map.
    """
    own = model.where(F.col("kmer").rlike("^[ACGT]{5}$")).groupBy("kmer").agg(F.min("mean").alias("mean"))
    table = F.broadcast(own.agg(F.map_from_entries(F.collect_list(F.struct("kmer", "mean"))).alias("__model")))
    rows = []
    for i in range(1, 6):
        means = [F.try_element_at("__model", F.substring(F.overlay("ninemer", F.lit(b), F.lit(5), F.lit(1)), i, 5)) for b in BASES]
        rows.append(F.array(*means))
    return windows.crossJoin(table).withColumn("expected", F.array(*rows)).drop("__model")


def tensor(windows: DataFrame) -> DataFrame:
    """windows (five, expected, quality) with features: 180 rows of current, four distances, dwell, quality.

    Filter by 9-mer before this: a row of 1260 floats is made here and should go straight to a scorer.
    """
    n, none = 5 * POINTS, F.lit(None).cast("double")
    quality = F.flatten(F.transform("quality", lambda q: F.array_repeat(q, 20)))

    def event(i):
        e, mu = F.get("five", F.lit(i))["samples"], F.get("expected", F.lit(i))
        made = F.struct(F.coalesce(resample(e), F.array_repeat(none, POINTS)).alias("current"), *[F.get(mu, F.lit(b)).alias(f"m{b}") for b in range(4)], F.size(e).cast("double").alias("dwell"), F.slice("__quality", i * POINTS + 1, POINTS).alias("quality"))

        def rows(x):
            return F.zip_with(x["current"], x["quality"], lambda now, q: F.array(now, *[x[f"m{b}"] - now for b in range(4)], x["dwell"], q))

        return let(made, rows)

    made = windows.withColumn("__quality", F.coalesce(quality, F.array_repeat(none, n)))
    return made.withColumn("features", F.concat(*[event(i) for i in range(5)])).drop("__quality")


def flat_tensor(features) -> "F.Column":
    """180 x 7 features as 1260 numbers, row by row, unknown ones NaN; any other shape fails the job."""
    right = (F.size(features) == 5 * POINTS) & F.forall(features, lambda r: F.size(r) == 7)
    flat = F.transform(F.flatten(features), lambda x: F.coalesce(x, F.lit(float("nan"))))
    return F.when(right, flat).otherwise(F.raise_error(F.lit("features are not 180 x 7")).cast("array<double>"))
