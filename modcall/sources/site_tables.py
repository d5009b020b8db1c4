"""Site tables in buckets: replicates and conditions that are merged again and again without moving their rows."""

from pyspark.sql import DataFrame, SparkSession

KEYS = ["contig", "position", "site"]
VALUES = ["coverage", "stoichiometry", "probability"]


def add_bucketed(sites: DataFrame, name: str, buckets: int, path: str | None = None) -> None:
    """Add sites (KEYS, VALUES, condition, rep) to a table of the catalog: a folder for each condition and replicate, in
    `buckets` buckets by site, sorted in each.

    One shuffle here replaces one in every later merge. All that is added to a table needs the same number of buckets;
    of 10**9 sites, a thousand buckets hold about 50 MB of each replicate. path: the table's folder, where it is not in
    the warehouse."""
    spread = sites.select(*KEYS, *VALUES, "condition", "rep").repartition(buckets, *KEYS)  # a file for each bucket and folder
    writer = spread.write.partitionBy("condition", "rep").bucketBy(buckets, *KEYS).sortBy(*KEYS).mode("append")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def merged(spark: SparkSession, name: str, conditions: list[str] | None = None) -> DataFrame:
    """The rows of a bucketed table, of all or some conditions, whose folders alone are read.

    What groups them by site next, such as diff.pivot_replicates or diff.condition_totals, reads the same bucket of all
    replicates in one task and moves no row."""
    rows = spark.table(name)
    return rows.where(rows["condition"].isin(conditions)) if conditions else rows
