"""Sequence sources in text form: SAM, SLOW5 and FASTA as DataFrames, without collecting files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import cigar_ops

#: Flags of alignments that are left out: unmapped, reverse strand, secondary, supplementary.
DROPPED_FLAGS = 4 | 16 | 256 | 2048


def sam_fields(lines: DataFrame) -> DataFrame:
    """The fields of SAM text lines (value): those of modcall.sources.bam.SCHEMA; positions count from 0."""
    c = lines.where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 11)
    at = [F.col("c")[i] for i in range(11)]
    return c.select(
        at[0].alias("read_id"), at[1].cast("int").alias("flag"), at[2].alias("contig"), (at[3].cast("int") - 1).alias("pos"), at[4].cast("int").alias("mapq"), at[5].alias("cigar"),
        at[6].alias("next_contig"), (at[7].cast("int") - 1).alias("next_pos"), at[8].cast("int").alias("template"), at[9].alias("seq"), at[10].alias("qual"),
        F.expr("slice(c, 12, greatest(size(c) - 11, 0))").alias("tags"),
    )


def alignments(fields: DataFrame) -> DataFrame:
    """Alignments with quality numbers (null where there are none), CIGAR runs and the tags si, ss, sc, sh (null if
    absent), from the fields of text or compressed files."""

    def tag(name):
        found = F.filter("tags", lambda t: t.startswith(f"{name}:"))
        return F.regexp_extract(F.get(found, F.lit(0)), r"^..:.:(.*)$", 1)

    qual = F.when(F.col("qual") != "*", F.transform(F.split("qual", ""), lambda q: F.ascii(q) - 33))
    rows = fields.select("read_id", "flag", "contig", "pos", cigar_ops(F.col("cigar")).alias("cigar"), "seq", qual.alias("qual"), *[tag(n).alias(n) for n in ("si", "ss", "sc", "sh")])
    return rows.withColumns({"sc": F.col("sc").cast("float"), "sh": F.col("sh").cast("float")})


def sam(spark: SparkSession, path) -> DataFrame:
    """Alignments of SAM text: see alignments()."""
    return alignments(sam_fields(spark.read.text(path)))


def bam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of compressed files: see alignments()."""
    from .bam import read_bam

    return alignments(read_bam(spark, path))


def ordered_lines(spark: SparkSession, path) -> DataFrame:
    """Lines of text (value) with columns whose order is that of the files: file, block and row."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def usable(alignments: DataFrame) -> DataFrame:
    """Forward primary alignments with all four signal tags."""
    return alignments.where((F.col("flag").bitwiseAND(DROPPED_FLAGS) == 0) & F.col("si").isNotNull() & F.col("ss").isNotNull() & F.col("sc").isNotNull() & F.col("sh").isNotNull())


def slow5(spark: SparkSession, path) -> DataFrame:
    """Raw signals of SLOW5 text: read_id, raw, digitisation, offset, range."""
    cols = spark.read.text(path).where(~F.substring("value", 1, 1).isin("#", "@")).select(F.split("value", "\t").alias("c")).where(F.size("c") >= 8)
    return cols.select(F.col("c")[0].alias("read_id"), F.split(F.col("c")[7], ",").cast("array<smallint>").alias("raw"), F.col("c")[2].cast("double").alias("digitisation"), F.col("c")[3].cast("double").alias("offset"), F.col("c")[4].cast("double").alias("range"))


def sequencing_kit(spark: SparkSession, path) -> str:
    """RNA004 if the header's sequencing kit says so, else RNA002."""
    row = spark.read.text(path).where(F.col("value").startswith("@sequencing_kit")).select(F.lower("value")).first()
    return "RNA004" if row and "rna004" in row[0] else "RNA002"


def fasta(spark: SparkSession, path) -> DataFrame:
    """Contigs (contig, seq): records are cut at line starts with '>' by the text reader, so files of many contigs
    spread; '>' inside a header is text."""
    records = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>", "").alias("value")).where(F.length(F.trim("value")) > 0)
    head = F.regexp_extract("value", r"^(\S+)", 1)
    return records.select(head.alias("contig"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")).alias("seq"))


def aligned_bases(alignments: DataFrame) -> DataFrame:
    """A row per reference position of every alignment: read_id, contig, ref_pos, read_pos, base, q; deleted
    and skipped positions have no base and quality 0."""
    from ..functions.sequence import cigar_starts

    runs = alignments.select("read_id", "contig", "pos", "seq", "qual", F.explode(cigar_starts(F.col("cigar"))).alias("r")).where(F.col("r.op").isin("M", "=", "X", "D", "N") & (F.col("r.len") > 0))
    at = runs.select("*", F.explode(F.sequence(F.lit(0), F.col("r.len") - 1)).alias("i"))
    read_pos = F.when(F.col("r.op").isin("M", "=", "X"), F.col("r.read_start") + F.col("i"))
    at = at.select("read_id", "contig", (F.col("pos") + F.col("r.ref_start") + F.col("i")).alias("ref_pos"), read_pos.alias("read_pos"), "seq", "qual")
    return at.select("read_id", "contig", "ref_pos", "read_pos", F.substr("seq", F.col("read_pos") + 1, F.lit(1)).alias("base"), F.coalesce(F.get("qual", F.col("read_pos")), F.lit(0)).alias("q"))
