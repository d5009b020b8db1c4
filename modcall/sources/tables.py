"""Delimited sources and sinks with explicit schemas."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import parse_key

#: Model codes of read-level predictions, and the base that each modification sits on.
MODEL_CODES = {"m6A": ("A", {"RNA002": 3, "RNA004": 4}), "pU": ("T", {"RNA002": 1, "RNA004": 2}), "m5C": ("C", {"RNA002": 5, "RNA004": 6})}


def read_calls(spark: SparkSession, paths) -> DataFrame:
    """Read-level predictions (key, probability, code; no header), keys parsed once; a bad key fails nothing
    and gives null parts."""
    rows = spark.read.csv(paths, sep="\t", schema="key string, prob double, model_code string", mode="FAILFAST")
    return rows.select(parse_key(F.col("key")).alias("k"), "prob", "model_code").select("k.*", "prob", "model_code")


def one_model(calls: DataFrame) -> str:
    """The model code of all calls; an error if there are several."""
    codes = [r[0] for r in calls.select("model_code").distinct().limit(2).collect()]
    if len(codes) != 1:
        raise ValueError(f"expected one model code, found {codes}")
    return codes[0]


def site_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema="contig string, position int, site string, coverage long, stoichiometry double, probability double", mode="FAILFAST")


def from_manifest(spark: SparkSession, path: str) -> DataFrame:
    """All site tables that a manifest (path, replicate, condition; header) names, as one tall table."""
    listed = spark.read.csv(path, sep="\t", header=True, schema="path string, rep string, condition string").collect()
    tables = [site_predictions(spark, r.path).withColumns({"rep": F.lit(r.rep), "condition": F.lit(r.condition)}) for r in listed]
    empty = spark.createDataFrame([], "contig string, position int, site string, coverage long, stoichiometry double, probability double, rep string, condition string")
    return reduce(DataFrame.unionByName, tables, empty)


def event_align(spark: SparkSession, path: str) -> DataFrame:
    """Event rows: contig, position, k-mers, read and samples; rows without a whole position are left out."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 11)
    rows = lines.select(
        F.get("c", F.lit(0)).alias("contig"), F.expr("try_cast(c[1] as int)").alias("pos"), F.get("c", F.lit(2)).alias("reference_kmer"), F.get("c", F.lit(3)).alias("read_id"),
        F.get("c", F.lit(9)).alias("kmer"), F.expr("transform(split(element_at(c, -1), ','), x -> try_cast(x as double))").alias("samples"),
    )
    return rows.where("pos is not null")


def kmer_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="kmer string, mean double, stdv double")


def targets(spark: SparkSession, path: str) -> DataFrame:
    """Positions (contig, pos) of a BED-like file; lines without a whole position, as headers, are left out."""
    words = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w")).where(F.size("w") >= 2)
    return words.select(F.get("w", F.lit(0)).alias("contig"), F.expr("try_cast(w[1] as int)").alias("pos")).where("pos is not null")


def quotas(spark: SparkSession, path: str) -> DataFrame:
    """9-mer quotas with the line's place, of which the last listed counts."""
    words = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("w"), F.monotonically_increasing_id().alias("line_no"))
    return words.select(F.get("w", F.lit(0)).alias("ninemer"), F.expr("try_cast(w[1] as int)").alias("max_n"), "line_no").where("max_n is not null")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """9-mer counts (9-mer, number; no header)."""
    return spark.read.csv(path, sep="\t", schema="ninemer string, n long", mode="FAILFAST")


def percentile_edges(spark: SparkSession, path: str) -> list[float]:
    """Bin edges of a file with one number a line, with 0 and 1 at the ends; a short list by its nature."""
    listed = [r[0] for r in spark.read.csv(path, schema="edge double", mode="FAILFAST").collect()]
    return [0.0, *sorted(listed), 1.0]


def features(spark: SparkSession, path: str, size: int = 1260) -> DataFrame:
    """Feature records of Parquet chunks; a record of another size fails the job."""
    rows = spark.read.parquet(path)
    return rows.where(F.when(F.size("features") == size, True).otherwise(F.raise_error(F.lit(f"features are not {size} numbers")).cast("boolean")))


def models(spark: SparkSession) -> DataFrame:
    """The model codes as a table: code, modification, base, kit."""
    rows = [(str(code), name, base, kit) for name, (base, kits) in MODEL_CODES.items() for kit, code in kits.items()]
    return spark.createDataFrame(rows, "model_code string, modification string, base string, kit string")


def write_tsv(df: DataFrame, path: str, header: bool = True, mode: str = "errorifexists") -> None:
    """A delimited table; arrays are joined by commas, as the sink takes no arrays."""
    flat = [F.array_join(F.col(f.name).cast("array<string>"), ",", "").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema]
    df.select(*flat).write.csv(path, sep="\t", header=header, mode=mode)


def write_features(df: DataFrame, path: str, by: str | None = None, rows: int = 32768) -> None:
    """Feature records as Parquet files of at most `rows` rows, one folder per value of `by`."""
    out = df.write.option("maxRecordsPerFile", rows)
    (out.partitionBy(by) if by else out).parquet(path)
