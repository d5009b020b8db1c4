"""Queries that write the driver's tables in the formats of the domain and read them back, with the tables' own SQL."""

import uuid

from pyspark.sql import functions as F

from ..operators import diff, modtags, readlevel, sites, training
from ..operators.ranking import placed
from ..scratch import shared_folder
from ..sources import arrays, bam, fasta, sequences, site_tables
from .adapters import RC, read_calls, site_preds, table, unique_calls
from .catalogue import ORACLE_SQL, pivot_columns, query
from .coverage import _CONTIGS, _TAGS, _reference

_SEQ = "translate(lpad(conv(o_orderkey * 7919 % 262144, 10, 4), 9, '0'), '0123', 'ACGT')"
_HEADER = "@HD\tVN:1.6\tSO:unsorted\n" + "".join(f"@SQ\tSN:P{i}\tLN:100000\n" for i in range(50)) + "@CO\tmade of orders\n"


def _alignments(spark, sf_dir):
    """orders as alignments: the fields of SAM."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('read', o_orderkey) AS read_id", "cast(CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 16 ELSE 2048 END AS int) AS flag", "concat('P', o_custkey % 50) AS contig",
        "cast(o_custkey AS int) AS pos", "cast(o_orderkey % 61 AS int) AS mapq", "concat(2 + o_orderkey % 3, 'M2I', 5 - o_orderkey % 3, 'M') AS cigar", "'*' AS next_contig", "-1 AS next_pos", "0 AS template",
        f"{_SEQ} AS seq", "CASE WHEN o_orderkey % 11 = 0 THEN '*' ELSE repeat(chr(cast(33 + o_orderkey % 60 AS int)), 9) END AS qual",
        "array(concat('NM:i:', o_orderkey % 5 - 2), concat('si:Z:0,', o_custkey, ',9,0'), 'sc:f:1.25', 'XX:A:k', concat('XB:B:s,-1,', o_orderkey % 300)) AS tags",
    )


@query("""SELECT concat('read', o_orderkey) AS read_id, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 16 ELSE 2048 END AS flag, concat('P', o_custkey % 50) AS contig, o_custkey AS pos,
  o_orderkey % 61 AS mapq, concat(2 + o_orderkey % 3, 'M2I', 5 - o_orderkey % 3, 'M') AS cigar, translate(to_base(o_orderkey * 7919 % 262144, 4, 9), '0123', 'ACGT') AS seq,
  CASE WHEN o_orderkey % 11 = 0 THEN '*' ELSE repeat(chr(CAST(33 + o_orderkey % 60 AS INT)), 9) END AS qual,
  concat_ws(' ', 'NM:i:' || (o_orderkey % 5 - 2), 'si:Z:0,' || o_custkey || ',9,0', 'sc:f:1.25', 'XX:A:k', 'XB:B:s,-1,' || o_orderkey % 300) AS tags FROM orders""")
def bam_alignments(spark, sf_dir):
    """orders written as BAM files and read by ranges of blocks."""
    folder = shared_folder(spark)
    bam.write_bam(_alignments(spark, sf_dir), f"{folder}/bam", _HEADER)
    got = bam.read_bam(spark, f"{folder}/bam", 50_000)
    return got.select("read_id", "flag", "contig", "pos", "mapq", "cigar", "seq", "qual", F.array_join("tags", " ").alias("tags"))


@query(f"""WITH {_TAGS}, made AS (SELECT o_orderkey, concat_ws(chr(9), o_orderkey, 0, 'P' || o_custkey % 50, o_custkey, 60, '9M', '*', 0, 0, 'ACGTACGTA', 'MM:Z:x!!!', 'XA:i:' || o_custkey, 'MM:Z:' || mm, 'ML:B:C,' || ml) AS line
  FROM orders JOIN tags ON read_id = o_orderkey),
lines AS (SELECT row_number() OVER (ORDER BY o_orderkey) + 2 AS place, line FROM made UNION ALL SELECT 1, concat('@HD', chr(9), 'VN:1.6') UNION ALL SELECT 2, concat('@CO', chr(9), 'made of orders'))
SELECT place, line FROM lines""")
def sam_rewrite(spark, sf_dir):
    """SAM text of orders with its tags set anew, as it stands in the files that are written: lines by their place."""
    folder = shared_folder(spark)
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS place", "concat_ws('\\t', o_orderkey, 0, concat('P', o_custkey % 50), o_custkey, 60, '9M', '*', 0, 0, 'ACGTACGTA', 'MM:Z:x!!!', 'MM:Z:N+N,0;', concat('XA:i:', o_custkey), 'ML:B:C,7') AS value")
    head = spark.createDataFrame([(-2, "@HD\tVN:1.6"), (-1, "@CO\tmade of orders")], "place long, value string")
    rows.unionByName(head).repartitionByRange("place").sortWithinPartitions("place").select("value").write.text(f"{folder}/source")
    tags = modtags.read_tags(unique_calls(spark, sf_dir))
    modtags.write_in_order(modtags.rewrite_sam(sequences.ordered_lines(spark, f"{folder}/source"), tags), f"{folder}/made")
    return placed(sequences.ordered_lines(spark, f"{folder}/made"), ["file", "block", "row"]).select("place", F.col("value").alias("line"))


@query(f"""WITH {RC}, {_CONTIGS}, s AS (SELECT DISTINCT contig, l_suppkey % 400 * 7 AS start FROM rc WHERE contig IN ('P3', 'P17', 'P44'))
SELECT contig, start, substr(seq, start + 1, 9) AS reference_ninemer FROM s JOIN rf USING (contig) WHERE start + 9 <= length(seq)""")
def reference_ninemer_indexed(spark, sf_dir):
    """9-mers of three contigs from an indexed FASTA file of all: only these contigs' bytes are read."""
    folder = shared_folder(spark)
    lines = _reference(spark, sf_dir).select("contig", F.posexplode(F.expr("regexp_extract_all(seq, '(.{1,60})', 1)")).alias("n", "line"))
    head = lines.where("n = 0").select("contig", F.lit(-1).alias("n"), F.concat(F.lit(">"), "contig", F.lit(" made of parts")).alias("line"))
    lines.unionByName(head).repartition(5, "contig").sortWithinPartitions("contig", "n").select("line").write.text(f"{folder}/text")
    wanted = ["P3", "P17", "P44"]
    fasta.write_index(spark, f"{folder}/text", f"{folder}/index", ending=".txt")
    tiles = fasta.read_tiles(spark, f"{folder}/text", f"{folder}/index").where(F.col("contig").isin(wanted))
    starts = read_calls(spark, sf_dir).selectExpr("contig", "l_suppkey % 400 * 7 AS start").where(F.col("contig").isin(wanted)).distinct()
    return readlevel.reference_ninemers(starts, tiles)


_SPLIT = "CAST('0x' || substr(md5(concat_ws(':', 1, vec_id)), 1, 8) AS BIGINT) % 100"


@query(f"""SELECT CASE WHEN {_SPLIT} < 60 THEN 'train' WHEN {_SPLIT} < 80 THEN 'validation' ELSE 'test' END AS split, CASE WHEN label < 5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS label, CAST(1 + vec_id % 3 AS DOUBLE) AS weight,
  64 AS n_values, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value, round(CAST(embedding[64] AS DOUBLE), 6) AS last_value FROM embeddings""")
def training_arrays(spark, sf_dir):
    """Labelled vectors, split at random, written as numpy arrays by split and read back."""
    folder = shared_folder(spark)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("features"), F.col("label").alias("class"), (1 + F.col("vec_id") % 3).alias("weight"))
    labelled = training.assemble(rows.where("class < 5"), rows.where("class >= 5"))
    arrays.write_arrays(training.random_split(labelled, F.col("vec_id")), f"{folder}/arrays", limit=500)
    got = arrays.read_arrays(spark, f"{folder}/arrays")
    return got.select("split", "label", "weight", F.size("features").alias("n_values"), F.round(F.col("features")[0], 6).alias("first_value"), F.round(F.col("features")[63], 6).alias("last_value"))


@query(ORACLE_SQL["diff_pivot"])
def diff_pivot_bucketed(spark, sf_dir):
    """diff_pivot of site tables that are kept in buckets by site, one replicate and condition after another."""
    sites, name, path = site_preds(spark, sf_dir), f"sites_{uuid.uuid4().hex}", f"{shared_folder(spark)}/sites"
    for rep in "FO":
        site_tables.add_bucketed(sites.where(F.col("rep") == rep), name, int(spark.conf.get("spark.sql.shuffle.partitions")), path)
    return pivot_columns(diff.pivot_replicates(site_tables.merged(spark, name)))


_VECTORS = f"""{RC}, c AS (SELECT DISTINCT pos, condition FROM rc WHERE condition IN ('A', 'R')), h AS (SELECT pos, condition, least(CAST(floor(prob * 100) AS INT), 99) AS bin, count(*) AS n FROM rc WHERE condition IN ('A', 'R') GROUP BY ALL),
v AS (SELECT pos, CASE WHEN condition = 'A' THEN 1 ELSE 0 END AS label, sum(n) AS reads, sum(n * bin * bin) AS moment FROM h GROUP BY pos, condition),
s AS (SELECT *, concat(pos, ':', label) AS id, CAST('0x' || substr(md5(concat_ws(':', 1, pos, label)), 1, 8) AS BIGINT) % 100 AS u FROM v)"""


def _site_vectors(spark, sf_dir):
    """Dense histograms of sites in two conditions, two sites' in one row as files of batches hold them, labelled."""
    def side(condition):
        calls = read_calls(spark, sf_dir).where(F.col("condition") == condition)
        full = sites.dense(sites.histogram(calls, ["pos"], sites.bin100(F.col("prob"))), ["pos"])
        batch = F.array_sort(F.collect_list(F.struct("pos", "histogram")))
        return full.groupBy(F.floor(F.col("pos") / 2).alias("batch")).agg(batch.alias("b")).select(F.col("b.pos").alias("sites"), F.col("b.histogram").alias("features"))

    rows = training.vectors(training.assemble(side("A"), side("R")), 100)
    rows = rows.select(F.get("sites", F.col("vector")).alias("pos"), "label", "features")
    return rows.withColumn("id", F.concat_ws(":", "pos", "label"))


@query(f"WITH {_VECTORS} SELECT pos, label, CASE WHEN u < 60 THEN 'train' WHEN u < 80 THEN 'validation' ELSE 'test' END AS split, reads, moment FROM s")
def assemble_site_vectors(spark, sf_dir):
    rows = training.random_split(_site_vectors(spark, sf_dir), F.col("id"))
    reads = F.aggregate("features", F.lit(0).cast("long"), lambda a, v: a + v)
    moment = F.aggregate(F.transform("features", lambda v, i: v * i * i), F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.select("pos", "label", "split", reads.alias("reads"), moment.alias("moment"))


@query(f"WITH {_VECTORS} SELECT row_number() OVER (ORDER BY md5(concat_ws(':', 1, id)), id) AS place, pos, label FROM s WHERE u >= 80")
def site_test_table(spark, sf_dir):
    rows = training.random_split(_site_vectors(spark, sf_dir).select("pos", "label", "id"), F.col("id"))
    return training.test_table(rows, "id").select("place", "pos", "label")
