"""The driver's tables as domain tables, in Spark and as DuckDB common table expressions."""

from pyspark.sql import functions as F

_LETTERS = "translate(lpad(conv(l_partkey % 262144, 10, 4), 9, '0'), '0123', 'ACGT')"


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_calls(spark, sf_dir):
    """lineitem as read-level calls."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('P', l_partkey % 50) AS contig", "l_partkey AS pos", f"{_LETTERS} AS ninemer", "l_orderkey AS read_id", "l_linenumber AS read_pos", "l_partkey", "l_suppkey",
        "l_returnflag AS condition", "l_linestatus AS rep", "substr('ACGT', cast(l_suppkey % 4 AS int) + 1, 1) AS base",
        "cast((l_orderkey * 7919 + l_linenumber * 104729) % 1001 AS double) / 1000 AS prob",
    )


RC = """rc AS (SELECT concat('P', l_partkey % 50) AS contig, l_partkey AS pos,
  translate(to_base(l_partkey % 262144, 4, 9), '0123', 'ACGT') AS ninemer, l_orderkey AS read_id, l_linenumber AS read_pos, l_partkey, l_suppkey,
  l_returnflag AS condition, l_linestatus AS rep, substr('ACGT', CAST(l_suppkey % 4 AS INT) + 1, 1) AS base,
  CAST((l_orderkey * 7919 + l_linenumber * 104729) % 1001 AS DOUBLE) / CAST(1000 AS DOUBLE) AS prob FROM lineitem)"""


def unique_calls(spark, sf_dir):
    """One call per read and position: the likeliest."""
    return read_calls(spark, sf_dir).groupBy("read_id", "read_pos").agg(F.max("prob").alias("prob"), F.min("contig").alias("contig"), F.min("pos").alias("pos"), F.min("ninemer").alias("ninemer"), F.min("base").alias("base"))


UC = f"{RC}, uc AS (SELECT read_id, read_pos, max(prob) AS prob, min(contig) AS contig, min(pos) AS pos, min(ninemer) AS ninemer, min(base) AS base FROM rc GROUP BY ALL)"


def site_preds(spark, sf_dir, by_line: bool = False):
    """Calls as site tables: condition from the return flag, replicate from the line status."""
    calls = read_calls(spark, sf_dir)
    position = F.col("pos") * 8 + F.col("read_pos") if by_line else F.col("pos")
    calls = calls.withColumns({"position": position, "site": F.col("ninemer")})
    return calls.groupBy("contig", "position", "site", "condition", "rep").agg(F.count("*").alias("coverage"), F.try_divide(F.count_if(F.col("prob") > 0.5), F.count_if(F.col("prob") != 0.5)).alias("stoichiometry"), F.round(F.avg("prob"), 6).alias("probability"))


def sp_sql(by_line: bool = False) -> str:
    position = "pos * 8 + read_pos" if by_line else "pos"
    return f"""{RC}, sp AS (SELECT contig, {position} AS position, ninemer AS site, condition, rep, count(*) AS coverage,
  count(*) FILTER (WHERE prob > 0.5) / nullif(count(*) FILTER (WHERE prob <> 0.5), 0) AS stoichiometry, round(avg(prob), 6) AS probability
  FROM rc GROUP BY ALL)"""


_KMER = "concat({})".format(", ".join(f"substr('ACGT', cast((user_id * 31 + (pos + {j}) * (pos + {j}) * 7 + (pos + {j}) div 3) % 4 AS int) + 1, 1)" for j in range(5)))


def events(spark, sf_dir):
    """events as event rows of reads: position by time, errors leave gaps, overlapping pseudo 5-mers."""
    rows = table(spark, sf_dir, "events").selectExpr("user_id", "event_id", "event_type", "value", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos")
    rows = rows.where("event_type <> 'error'").selectExpr("*", f"{_KMER} AS kmer", "array(value, value + 1, value + 2) AS samples")
    return rows.selectExpr("user_id AS read_id", "event_id AS line_no", "pos", "kmer", "samples", "value")


EV = """ev AS (SELECT user_id AS read_id, event_id AS line_no, pos, {kmer} AS kmer, [value, value + 1, value + 2] AS samples, value
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events) WHERE event_type <> 'error')""".format(kmer=_KMER.replace(" div ", " // "))


def kmer_model(spark, sf_dir):
    """A pseudo model of the 1024 5-mers: means of part prices by the part's key."""
    part = table(spark, sf_dir, "part")
    return part.selectExpr("translate(lpad(conv(p_partkey % 1024, 10, 4), 5, '0'), '0123', 'ACGT') AS kmer", "p_retailprice").groupBy("kmer").agg(F.round(F.avg("p_retailprice"), 3).alias("mean"))


KM = "km AS (SELECT translate(to_base(p_partkey % 1024, 4, 5), '0123', 'ACGT') AS kmer, round(avg(p_retailprice), 3) AS mean FROM part GROUP BY 1)"


def pairs(spark, sf_dir):
    """Stoichiometry of sites in two conditions: wt (A) and ivt (R)."""
    sites = read_calls(spark, sf_dir).groupBy("pos").pivot("condition", ["A", "R"]).agg(F.round(F.try_divide(F.count_if(F.col("prob") > 0.5), F.count_if(F.col("prob") != 0.5)), 6))
    return sites.where("A is not null and R is not null").selectExpr("pos", "A AS wt", "R AS ivt")


PAIRS = f"""{RC}, one AS (SELECT pos, condition, round(count(*) FILTER (WHERE prob > 0.5) / nullif(count(*) FILTER (WHERE prob <> 0.5), 0), 6) AS s FROM rc GROUP BY ALL),
pairs AS (SELECT pos, max(s) FILTER (WHERE condition = 'A') AS wt, max(s) FILTER (WHERE condition = 'R') AS ivt FROM one GROUP BY pos
  HAVING wt IS NOT NULL AND ivt IS NOT NULL)"""
