"""Read level from end to end: alignments, raw signals and the reference to 180 x 7 features."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import signal_ranges
from ..functions.signal import event_samples, fill_zeros, phred_adjust, rescale, to_picoampere
from . import events, features

#: Bases of a reference tile, besides the 8 that a 9-mer may need of the next.
TILE = 1024


def reference_tiles(reference: DataFrame) -> DataFrame:
    """Contigs cut into overlapping tiles (contig, tile, part), so that no row of a join carries a whole contig."""
    pieces = reference.select("contig", F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{TILE}}}"), F.lit(0)).alias("p"))  # in one pass
    tiles = pieces.select("contig", F.posexplode(F.transform("p", lambda x, i: F.struct(x.alias("own"), F.coalesce(F.get("p", i + 1), F.lit("")).alias("next")))).alias("tile", "piece"))
    return tiles.select("contig", "tile", F.concat("piece.own", F.left("piece.next", F.lit(8))).alias("part"))


def reference_ninemers(rows: DataFrame, reference: DataFrame, start: str = "start") -> DataFrame:
    """rows with reference_ninemer: the reference's nine bases from `start` of their contig; rows that reach over an
    end are left out. reference: contigs (contig, seq), or tiles of an indexed file (contig, tile, part)."""
    tiles = reference if "part" in reference.columns else reference_tiles(reference)
    at = rows.withColumn("tile", F.floor(F.col(start) / TILE).cast("int")).where(F.col(start) >= 0)
    found = at.join(tiles, ["contig", "tile"])
    found = found.withColumn("reference_ninemer", F.substr("part", (F.col(start) % TILE + 1).cast("int"), F.lit(9)))
    return found.where(F.length("reference_ninemer") == 9).drop("tile", "part")


def signal_events(alignments: DataFrame, signals: DataFrame) -> DataFrame:
    """A row per event of every aligned read with a signal: read_id, contig, pos, samples.

    si holds raw start, raw end, start and end k-mer; moves run from the last k-mer down, so the k-mer number k sits at
    end - 1 - k on the reference. Samples are picoampere, scaled by sc and shifted by sh, last first.
    """
    reads = alignments.select("read_id", "contig", F.split("si", ",").cast("array<int>").alias("si"), "ss", "sc", "sh").join(signals, "read_id")
    current = rescale(to_picoampere(F.col("raw"), F.col("offset"), F.col("range"), F.col("digitisation")), F.col("sh"), F.col("sc"))
    reads = reads.select("read_id", "contig", "si", current.alias("current"), F.explode(signal_ranges(F.col("ss"))).alias("e"))
    first = F.col("si")[0]
    return reads.select("read_id", "contig", (F.greatest(F.col("si")[2], F.col("si")[3]) - 1 - F.col("e.kmer")).alias("pos"), event_samples(F.col("current"), first + F.col("e.raw_start"), first + F.col("e.raw_end")).alias("samples"))


def base_tag(q: Column, base: Column) -> Column:
    """Quality and called base as 'q_base'; '0_D' where the read has no base."""
    return F.coalesce(F.concat(q.cast("string"), F.lit("_"), base), F.lit("0_D"))


def event_qualities(places: DataFrame, bases: DataFrame, keys: list[str]) -> DataFrame:
    """places with the quality (0 where the read has no base) and the tag of the base that stands there; keys: read and
    position, of which bases hold one row each. Other columns of the bases do not pass."""
    found = places.join(bases.select(*keys, "q", "base"), keys, "left")
    return found.withColumns({"q": F.coalesce("q", F.lit(0)), "tag": base_tag(F.col("q"), F.col("base"))}).drop("base")


def quality_windows(bases: DataFrame, read: list[str], pos: str = "ref_pos") -> DataFrame:
    """A row per reference position with all nine around it: start and the struct array nine (pos, base, q).
    Windows without any quality are left out."""
    around = Window.partitionBy(*read).orderBy(pos).rowsBetween(-8, 0)
    nine = bases.withColumn("nine", F.collect_list(F.struct(F.col(pos).alias("pos"), "base", "q")).over(around))
    nine = nine.where((F.size("nine") == 9) & (F.col("nine")[8]["pos"] - F.col("nine")[0]["pos"] == 8) & F.exists("nine", lambda x: x["q"] != 0))
    return nine.select(*read, F.col("nine")[0]["pos"].alias("start"), "nine")


def aligned_features(alignments: DataFrame, signals: DataFrame, bases: DataFrame, reference: DataFrame, model: DataFrame, centre: str) -> DataFrame:
    """Features of all 9-mers with a base in the centre: read_id, contig, start, ninemer, read_pos tag and the tensor.

    Events are named by the reference's 9-mer; qualities are those that the reference base is right, zeros filled
    with the mean of the others.
    """
    read = ["read_id", "contig"]
    rows = events.merge_events(signal_events(alignments, signals).withColumn("line_no", F.col("pos")), read)
    rows = rows.withColumn("samples", F.reverse("samples")).withColumn("kmer", F.lit("NNNNN"))  # merging reverses
    windows = events.ninemers(rows, read).drop("ninemer")
    named = reference_ninemers(windows, reference).withColumnRenamed("reference_ninemer", "ninemer").where(F.substring("ninemer", 5, 1) == centre)
    q = F.transform("nine", lambda x, i: phred_adjust(x["q"], x["base"], F.substring("ninemer", i + 1, F.lit(1))))
    wide = named.join(quality_windows(bases, read), [*read, "start"])
    wide = wide.withColumns({"tag": base_tag(F.col("nine")[4]["q"], F.col("nine")[4]["base"]), "quality": fill_zeros(q)})
    return features.tensor(features.expected(wide, model)).select(*read, "start", "ninemer", "tag", "features")
