"""Indexed reference sequences as a Spark data source that reads the byte ranges of the wanted contigs only.

The index is a line per contig: name, length, offset of its first base, bases and bytes of a line, and the file where
there are several. Filters on the contig are pushed to the source, which plans ranges of the contigs that pass. Rows
are tiles of TILE bases with those behind them that a window may need, so no row or task holds a whole contig.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .bam import _open, files_of

#: Bases of a tile and those of the next that stand behind it; bytes that one task scans or reads.
TILE, BEHIND, RANGE = 1024, 8, 32 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_ARROW = pa.schema([("contig", pa.string()), ("tile", pa.int32()), ("part", pa.string())])
_HEADS = "file string, size long, head long, contig string, offset long, bases long, width long"


def _heads(paths: dict[str, int], step: int):
    """Headers that begin in each range of `step` bytes, with the shape of the line behind them."""

    def run(batches):
        for batch in batches:
            for path, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = _open(path)
                with fs.open_input_file(name) as file:
                    yield from _scan(file, path, paths[path], begin, step)

    return run


def _scan(file, path, size, begin, step):
    file.seek(max(0, begin - 1))
    data = (b"\n" if begin == 0 else b"") + file.read(step + (begin > 0))
    rows, at = [], data.find(b"\n>")
    while at >= 0:
        head = begin + at
        file.seek(head)
        text = file.read(1 << 12)
        while text.count(b"\n") < 2 and head + len(text) < size:
            text += file.read(max(1 << 12, len(text)))
        first, _, rest = text.partition(b"\n")
        line = rest.partition(b"\n")[0]
        words = first[1:].split()
        own = b"" if line.startswith(b">") else line.rstrip(b"\r")
        rows.append((path, size, head, words[0].decode() if words else "", head + len(first) + 1, len(own), len(line) + 1))
        at = data.find(b"\n>", at + 1)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=[c.split()[0] for c in _HEADS.split(", ")])


def write_index(spark: SparkSession, path: str, index: str, step: int = RANGE, ending: str = ".fa") -> None:
    """Index a FASTA file, or all files of a folder with this ending; tasks scan ranges of bytes. Lines of a contig must be equally
    long but for the last, as in all indexed files."""
    files = dict(files_of(path, ending))
    ranges = [(f, b) for f, size in files.items() for b in range(0, size, step)]
    given = spark.createDataFrame(ranges, "file string, begin long").repartition(max(1, len(ranges)), "file", "begin")
    heads = given.mapInArrow(_heads(files, step), _HEADS)
    end = F.coalesce(F.lead("head").over(Window.partitionBy("file").orderBy("head")), F.col("size"))
    held = end - F.col("offset")
    lines = F.when(F.col("bases") > 0, F.floor(held / F.col("width"))).otherwise(0)
    # a last line has its bases and a line end, or none at the end of the file
    rest = F.greatest(F.lit(0), held - lines * F.col("width") - F.when(end < F.col("size"), F.col("width") - F.col("bases")).otherwise(F.lit(0)))
    heads.select("contig", (lines * F.col("bases") + F.least(rest, F.col("bases"))).cast("long").alias("length"), "offset", "bases", "width", "file").write.mode("overwrite").csv(index, sep="\t")


@dataclass
class _Part(InputPartition):
    #: (file, contig, length, offset, bases, width, first tile, tiles) of what one task reads.
    pieces: list


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("rangebytes", RANGE))
        self.index = options.get("index", self.path + ".fai")
        self.wanted: set | None = None

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and tuple(f.attribute) == ("contig",):
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f

    def partitions(self):
        parts, held, room = [], [], 0
        for path, _ in files_of(self.index, ".csv"):
            fs, name = _open(path)
            with fs.open_input_stream(name) as stream:
                lines = stream.read().decode().split("\n")
            for fields in (x.split("\t") for x in lines if x):
                if self.wanted is not None and fields[0] not in self.wanted:
                    continue
                length, offset, bases, width = map(int, fields[1:5])
                tiles, most = -(-length // TILE), max(1, self.range // TILE)
                for first in range(0, tiles, most):
                    n = min(most, tiles - first)
                    held.append((fields[5] if len(fields) > 5 else self.path, fields[0], length, offset, bases, width, first, n))
                    room += n * TILE
                    if room >= self.range:
                        parts.append(_Part(held))
                        held, room = [], 0
        return [*parts, _Part(held)] if held or not parts else parts

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for path, contig, length, offset, bases, width, first, tiles in part.pieces:
            fs, name = _open(path)
            with fs.open_input_file(name) as file:
                for at in range(first, first + tiles, 1024):  # a million bases at a time
                    many = min(1024, first + tiles - at)
                    begin, end = at * TILE, min(length, (at + many) * TILE + BEHIND)
                    file.seek(offset + begin // bases * width + begin % bases)
                    raw = file.read(offset + (end - 1) // bases * width + (end - 1) % bases + 1 - file.tell())
                    seq = raw.translate(None, b"\r\n").decode().upper()
                    if len(seq) != end - begin:
                        raise ValueError(f"{path}: {contig} does not have the lines that its index tells of")
                    rows += [(contig, at + i, seq[i * TILE : (i + 1) * TILE + BEHIND]) for i in range(many)]
                    if len(rows) >= 1024:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class FastaSource(DataSource):
    """Format "modcall_fasta". Options: path, index (path.fai by default, or a folder that write_index wrote), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "modcall_fasta"

    def schema(self) -> str:
        return "contig string, tile int, part string"

    def reader(self, schema):
        return _Reader(self.options)


def read_tiles(spark: SparkSession, path: str, index: str | None = None, range_bytes: int = RANGE) -> DataFrame:
    """Tiles (contig, tile, part) of an indexed reference, as readlevel.reference_ninemers takes them. A filter on the
    contig reaches the source."""
    spark.dataSource.register(FastaSource)
    spark.conf.set(PUSHDOWN, "true")
    reader = spark.read.format("modcall_fasta").option("rangeBytes", range_bytes)
    return (reader.option("index", index) if index else reader).load(path)
