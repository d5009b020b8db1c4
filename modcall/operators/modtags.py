"""Modification tags of reads: building, filtering and restricting to positions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import mm_text


def read_tags(calls: DataFrame, read: str = "read_id") -> DataFrame:
    """A row per read with a call: ascending positions, MM text and ML values floor(255 p).

    Null and NaN calls are left out. One call per position is expected.
    """
    ok = calls.where(F.col("prob").isNotNull() & ~F.isnan("prob"))
    return tags_of(ok.groupBy(read).agg(F.collect_list(F.struct("read_pos", "prob")).alias("calls")), read)


def tags_of(reads: DataFrame, read: str = "read_id") -> DataFrame:
    """The tags of reads whose calls are gathered in an array of (read_pos, prob), in any order; null and NaN calls
    are left out, and reads without another one."""
    fine = F.filter("calls", lambda c: c["prob"].isNotNull() & ~F.isnan(c["prob"]))
    tags = reads.select(read, F.array_sort(fine).alias("calls")).where(F.size("calls") > 0)
    return tags.select(read, F.col("calls.read_pos").alias("positions"), mm_text(F.col("calls.read_pos")).alias("mm"), F.transform("calls", lambda c: F.floor(c["prob"] * 255).cast("int")).alias("ml"))


def drop_unlikely(calls: DataFrame, least: float) -> DataFrame:
    return calls.where(F.col("prob") >= least)


def at_positions(calls: DataFrame, positions: DataFrame, small: bool = False) -> DataFrame:
    """Calls at listed (contig, pos) only; small: the list is known to fit a broadcast."""
    listed = positions.select("contig", "pos").distinct()
    return calls.join(F.broadcast(listed) if small else listed, ["contig", "pos"], "left_semi")


def sam_line(columns: list[Column], mm: Column, ml: Column) -> Column:
    """A SAM text line with MM and ML tags behind its other fields."""
    return F.concat_ws("\t", *columns, F.concat(F.lit("MM:Z:"), mm), F.concat(F.lit("ML:B:C,"), F.array_join(ml.cast("array<string>"), ",")))


def skip_origin(calls: DataFrame, line: str, read: str = "read_id") -> DataFrame:
    """Calls without NaN ones, and without those at position 0 that are not their read's first line."""
    ok = calls.where(F.col("prob").isNotNull() & ~F.isnan("prob"))
    first = ok.groupBy(read).agg(F.min(line).alias("__first"))
    return ok.join(first, read).where((F.col("read_pos") != 0) | (F.col(line) == F.col("__first"))).drop("__first")


def merge_tags(calls: DataFrame, code: str = "code", read: str = "read_id") -> DataFrame:
    """One MM text and ML list per read from the calls of several modifications: a part for each code, in order."""
    ok = calls.where(F.col("prob").isNotNull() & ~F.isnan("prob"))
    parts = ok.groupBy(read, code).agg(F.array_sort(F.collect_list(F.struct("read_pos", "prob"))).alias("calls"))
    mm = mm_text(F.col("calls.read_pos"), F.concat(F.lit("N+"), code))
    parts = parts.select(read, code, mm.alias("mm"), F.transform("calls", lambda c: F.floor(c["prob"] * 255).cast("int")).alias("ml"))
    whole = parts.groupBy(read).agg(F.array_sort(F.collect_list(F.struct(code, "mm", "ml"))).alias("p"))
    return whole.select(read, F.array_join(F.transform("p", lambda x: x["mm"]), "").alias("mm"), F.flatten(F.transform("p", lambda x: x["ml"])).alias("ml"))


def tagged_lines(alignments: DataFrame, tags: DataFrame, fields: list[str], read: str = "read_id") -> DataFrame:
    """SAM lines of the reads that have tags, whatever order or batch their calls came in."""
    return alignments.join(tags, read).select(read, sam_line([F.col(c).cast("string") for c in fields], F.col("mm"), F.col("ml")).alias("line"))


def rewrite_sam(lines: DataFrame, tags: DataFrame, read: str = "read_id") -> DataFrame:
    """SAM lines (value, file, block, row) of the reads that have tags, with these instead of MM and ML tags that were
    there, and all other fields as they were; before them the header of the first file."""
    place = ["file", "block", "row"]
    body = lines.where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("c"), *place)
    known = body.join(tags.select(F.col(read).cast("string").alias("__read"), "mm", "ml"), F.col("c")[0] == F.col("__read"))
    others = F.filter(F.expr("slice(c, 12, greatest(size(c) - 11, 0))"), lambda t: ~F.substring(t, 1, 3).isin("MM:", "ML:"))
    made = known.select(F.concat_ws("\t", F.slice("c", 1, 11), others, F.concat(F.lit("MM:Z:"), "mm"), F.concat(F.lit("ML:B:C,"), F.array_join(F.col("ml").cast("array<string>"), ","))).alias("value"), *place)
    head = lines.where(F.col("value").startswith("@"))
    first = head.agg(F.min("file").alias("file"))
    return head.join(F.broadcast(first), "file", "left_semi").select("value", *place).unionByName(made)


def write_in_order(lines: DataFrame, path: str) -> None:
    """Lines as text files whose names, one after another, keep the lines' order: one file for a range of places."""
    place = ["file", "block", "row"]
    lines.repartitionByRange(*place).sortWithinPartitions(*place).select("value").write.text(path)
