"""Column functions on keys, k-mers and alignment strings; all native expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: contig_position_9mer_read, then optionally the read position and the quality with the called base.
KEY = r"^(.+)_([0-9]+)_([ACGTUN]{9})_([^_]+)(?:_([0-9]+))?(?:_([0-9]+)_([A-Z]))?$"
BASES = ("A", "C", "G", "T")


def parse_key(key: Column) -> Column:
    """The parts of a composite read key as a struct; missing parts are null. The contig may hold '_'."""

    def part(i):
        return F.nullif(F.regexp_extract(key, KEY, i), F.lit(""))

    return F.struct(
        part(1).alias("contig"), part(2).cast("int").alias("pos"), part(3).alias("ninemer"), part(4).alias("read_id"),
        part(5).cast("int").alias("read_pos"), part(6).cast("int").alias("qscore"), part(7).alias("base"),
    )


def build_key(*parts: Column) -> Column:
    """Parts joined by '_'; null parts are left out."""
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def substitutions(ninemer: Column) -> Column:
    """The four 9-mers with A, C, G and T in the centre."""
    return F.array(*[F.overlay(ninemer, F.lit(b), F.lit(5), F.lit(1)) for b in BASES])


def base_index(base: Column) -> Column:
    """0 to 3 for A, C, G, T and 4 for anything else."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, BASES)), base), F.lit(0)) - 1, F.lit(4)).cast("int")


def cigar_ops(cigar: Column) -> Column:
    """A CIGAR string as an array of (op, len)."""
    runs = F.regexp_extract_all(cigar, F.lit(r"([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(runs, lambda r: F.struct(F.right(r, F.lit(1)).alias("op"), F.regexp_extract(r, "^([0-9]+)", 1).cast("int").alias("len")))


def cigar_starts(ops: Column) -> Column:
    """Each op with the reference and read offsets where it starts. M, = and X advance both; I and S the
    read; D and N the reference; H and P neither."""
    zero = F.struct(F.lit(0).alias("ref"), F.lit(0).alias("read"), F.array().cast("array<struct<op:string,len:int,ref_start:int,read_start:int>>").alias("out"))

    def step(acc, op):
        both = op["op"].isin("M", "=", "X")
        return F.struct(
            (acc["ref"] + F.when(both | op["op"].isin("D", "N"), op["len"]).otherwise(0)).alias("ref"),
            (acc["read"] + F.when(both | op["op"].isin("I", "S"), op["len"]).otherwise(0)).alias("read"),
            F.concat(acc["out"], F.array(F.struct(op["op"].alias("op"), op["len"].alias("len"), acc["ref"].alias("ref_start"), acc["read"].alias("read_start")))).alias("out"),
        )

    return F.aggregate(ops, zero, step, lambda acc: acc["out"])


def signal_ranges(ss: Column) -> Column:
    """Raw-signal ranges of k-mers from a move string: 'n,' is an event of n samples, 'nI' skips n samples,
    'nD' skips n k-mers. Array of (kmer, raw_start, raw_end), from 0."""
    moves = F.regexp_extract_all(ss, F.lit(r"([0-9]+[,ID])"), F.lit(1))
    zero = F.struct(F.lit(0).alias("raw"), F.lit(0).alias("kmer"), F.array().cast("array<struct<kmer:int,raw_start:int,raw_end:int>>").alias("out"))

    def step(acc, move):
        n, kind = F.regexp_extract(move, "^([0-9]+)", 1).cast("int"), F.right(move, F.lit(1))
        event = F.array(F.struct(acc["kmer"].alias("kmer"), acc["raw"].alias("raw_start"), (acc["raw"] + n).alias("raw_end")))
        return F.struct(
            (acc["raw"] + F.when(kind == "D", 0).otherwise(n)).alias("raw"),
            (acc["kmer"] + F.when(kind == ",", 1).when(kind == "D", n).otherwise(0)).alias("kmer"),
            F.when(kind == ",", F.concat(acc["out"], event)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(moves, zero, step, lambda acc: acc["out"])


def mm_text(positions: Column, kind: Column | None = None) -> Column:
    """The modification tag of ascending positions: each as the gap behind the one before, 'N+N,3,0,4;'. kind: what
    stands in front, 'N+N' by default."""
    gaps = F.transform(positions, lambda p, i: F.when(i == 0, p).otherwise(p - F.try_element_at(positions, i) - 1))
    return F.concat(F.lit("N+N") if kind is None else kind, F.lit(","), F.array_join(gaps.cast("array<string>"), ","), F.lit(";"))
