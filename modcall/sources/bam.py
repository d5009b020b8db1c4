"""Compressed alignments as a Spark data source: tasks read ranges of compressed blocks.

A file is a chain of gzip members of at most 64 KiB, each with its own size in its header, and records run on across
them. The driver reads the header's blocks only. A task is given a range of the file's bytes: it looks for the first
block in it, inflates, and finds the first place where several records follow one another; it reads on until the first
record that begins in a block behind its range, which the next task finds. No task and no index reads a whole file.
"""

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "read_id string, flag int, contig string, pos int, mapq int, cigar string, next_contig string, next_pos int, template int, seq string, qual string, tags array<string>"
_ARROW = pa.schema([("read_id", pa.string()), ("flag", pa.int32()), ("contig", pa.string()), ("pos", pa.int32()), ("mapq", pa.int32()), ("cigar", pa.string()), ("next_contig", pa.string()), ("next_pos", pa.int32()), ("template", pa.int32()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.list_(pa.string()))])
#: Fixed values of the format: letters of alignment runs and bases, numbers of tag types, first bytes, the last block.
RUNS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
BLOCK_MAGIC, FILE_MAGIC = b"\x1f\x8b\x08\x04", b"BAM\x01"
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes of a block before compression, bytes of a task's range, records that must follow a guessed one, tasks above
#: which shorter ranges grow up to RANGE.
BLOCK, RANGE, SURE, TASKS = 0xFF00, 32 << 20, 4, 64


def _open(path: str):
    if "://" not in path:
        path = "file://" + path
    fs, name = pa.fs.FileSystem.from_uri(path)
    return fs, name


def files_of(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files of a folder with this ending, by name."""
    fs, name = _open(path)
    scheme = path[: path.index("://") + 3] if "://" in path else "file://"
    info = fs.get_file_info(name)
    if info.type == pa.fs.FileType.Directory:
        found = fs.get_file_info(pa.fs.FileSelector(name))
        return sorted((scheme + f.path, f.size) for f in found if f.type == pa.fs.FileType.File and f.path.endswith(ending))
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [(scheme + name, info.size)]


def block_size(head: bytes) -> int | None:
    """The size of the block whose header these bytes begin with, None if they are none or too few."""
    if len(head) < 18 or head[:4] != BLOCK_MAGIC:
        return None
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 6 <= min(len(head), 12 + extra):
        name, size = head[at : at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if name == b"BC" and size == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


class Blocks:
    """The inflated bytes of a file from one of its blocks on, with the place of the block that each came from."""

    def __init__(self, file, path: str, at: int, size: int):
        self.file, self.path, self.next, self.size = file, path, at, size
        self.data, self.at = b"", 0
        self.starts: list[tuple[int, int]] = []  # (offset in data, place of the block)
        self.raw, self.raw_at = b"", at

    def _raw(self, at: int, n: int) -> bytes:
        if at < self.raw_at or at + n > self.raw_at + len(self.raw):
            self.file.seek(at)
            self.raw, self.raw_at = self.file.read(max(n, 1 << 20)), at
        return self.raw[at - self.raw_at : at - self.raw_at + n]

    def more(self) -> bool:
        """One block more; False at the end of the file."""
        if self.next >= self.size:
            return False
        n = block_size(self._raw(self.next, 1024))
        if n is None:
            raise ValueError(f"{self.path}: no block at byte {self.next}")
        packed = self._raw(self.next, n)
        try:
            # a gzip member checks its own sum and length
            fresh, unzip = (x := zlib.decompressobj(31)).decompress(packed), x
            if not unzip.eof or len(packed) < n:
                raise zlib.error("cut off")
        except zlib.error as error:
            raise ValueError(f"{self.path}: the block at byte {self.next} is damaged: {error}") from error
        if self.at:
            keep = max((i for i, (o, _) in enumerate(self.starts) if o <= self.at), default=0)
            self.starts = [(max(0, o - self.at), place) for o, place in self.starts[keep:]]
            self.data, self.at = self.data[self.at :], 0
        self.starts.append((len(self.data), self.next))
        self.data += fresh
        self.next += n
        return True

    def need(self, n: int) -> bool:
        """Whether n bytes can be had from the present place."""
        while len(self.data) - self.at < n:
            if not self.more():
                return False
        return True

    def place(self) -> int:
        """The place of the block that holds the present byte."""
        return next((place for o, place in reversed(self.starts) if o <= self.at), self.next)


def read_header(blocks: Blocks) -> tuple[str, list[str]]:
    """The text and the contigs' names; what is next are the records."""

    def take(n):
        if not blocks.need(n):
            raise ValueError(f"{blocks.path}: the header is cut off")
        part = blocks.data[blocks.at : blocks.at + n]
        blocks.at += n
        return part

    if take(4) != FILE_MAGIC:
        raise ValueError(f"{blocks.path}: not a BAM file")
    text = take(struct.unpack("<i", take(4))[0]).rstrip(b"\0").decode()
    names = []
    for _ in range(struct.unpack("<i", take(4))[0]):
        names.append(take(struct.unpack("<i", take(4))[0]).rstrip(b"\0").decode())
        take(4)
    return text, names


def looks_like_record(data: bytes, at: int, contigs: int) -> int | None:
    """The length of what may be a record at this place, None if it cannot be one or its fixed part is not there."""
    if len(data) < at + 36:
        return None
    size, ref, pos, name, _, _, runs, _, seq, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    least = 32 + name + 4 * runs + (seq + 1) // 2 + seq
    if not (name and -1 <= ref < contigs and -1 <= mate < contigs and pos >= -1 and mate_pos >= -1 and seq >= 0 and least <= size < 1 << 28):
        return None
    end = at + 36 + name
    if end <= len(data) and (data[end - 1] or not all(33 <= c <= 126 for c in data[at + 36 : end - 1])):
        return None
    return 4 + size


def find_record(blocks: Blocks, contigs: int) -> bool:
    """Move to the first place from which SURE records follow one another, or fewer up to the end of the file."""
    start = 0
    while True:
        at, seen = start, 0
        while seen < SURE:
            while len(blocks.data) < at + 36 and blocks.more():
                pass
            if at == len(blocks.data):
                break  # the file ends with a whole record
            n = looks_like_record(blocks.data, at, contigs)
            if n is None:
                seen = -1
                break
            at, seen = at + n, seen + 1
            while len(blocks.data) < at and blocks.more():
                pass
            if len(blocks.data) < at:
                seen = -1
                break
        if seen > 0 or seen == 0 and start == len(blocks.data):
            blocks.at = start
            return seen > 0
        start += 1
        while len(blocks.data) <= start:
            if not blocks.more():
                return False


def _number(kind: str, value) -> str:
    return str(np.float32(value)) if kind == "f" else str(value)


def tag_texts(data: bytes) -> list[str]:
    """The tags of a record as SAM has them."""
    out, at = [], 0
    while at < len(data):
        name, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind == "A":
            text, at = f"A:{chr(data[at])}", at + 1
        elif kind in "ZH":
            end = data.index(0, at)
            text, at = f"{kind}:{data[at:end].decode()}", end + 1
        elif kind == "B":
            inner, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{NUMBERS[inner]}", data, at + 5)
            text, at = "B:" + ",".join([inner, *(_number(inner, v) for v in values)]), at + 5 + n * struct.calcsize(NUMBERS[inner])
        else:
            value = struct.unpack_from("<" + NUMBERS[kind], data, at)[0]
            text, at = f"{'f' if kind == 'f' else 'i'}:{_number(kind, value)}", at + struct.calcsize(NUMBERS[kind])
        out.append(f"{name}:{text}")
    return out


_PAIRS = [a + b for a in BASES for b in BASES]


def decode(data: bytes, names: list[str]) -> tuple:
    """A record without its length as a row of SCHEMA; positions count from 0, as in the file."""
    ref, pos, name, mapq, _, runs, flag, n, mate, mate_pos, template = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32 + name
    cigar = "".join(f"{c >> 4}{RUNS[c & 15]}" for c in struct.unpack_from(f"<{runs}I", data, at)) or "*"
    at += 4 * runs
    seq = "".join([_PAIRS[b] for b in data[at : at + (n + 1) // 2]])[:n] or "*"
    at += (n + 1) // 2
    qual = data[at : at + n]
    text = "*" if not n or qual[0] == 0xFF else (np.frombuffer(qual, np.uint8) + 33).tobytes().decode("latin-1")
    contig = names[ref] if ref >= 0 else "*"
    other = "*" if mate < 0 else "=" if mate == ref else names[mate]
    return data[32 : 31 + name].decode(), flag, contig, pos, mapq, cigar, other, mate_pos, template, seq, text, tag_texts(data[at + n :])


def _tag_bytes(tag: str) -> bytes:
    name, kind, text = tag.split(":", 2)
    if kind == "A":
        return f"{name}A{text}".encode()
    if kind in "ZH":
        return f"{name}{kind}{text}".encode() + b"\0"
    if kind == "B":
        inner, *values = text.split(",")
        made = [float(v) if inner == "f" else int(v) for v in values]
        return f"{name}B{inner}".encode() + struct.pack(f"<i{len(made)}{NUMBERS[inner]}", len(made), *made)
    if kind == "f":
        return f"{name}f".encode() + struct.pack("<f", float(text))
    value = int(text)
    wide = "i" if value < 1 << 31 else "I"
    return f"{name}{wide}".encode() + struct.pack("<" + NUMBERS[wide], value)


def encode(row, places: dict[str, int]) -> bytes:
    """A row of SCHEMA as a record with its length; places: the contigs' numbers."""
    read_id, flag, contig, pos, mapq, cigar, other, mate_pos, template, seq, qual, tags = row
    runs = [int(n) << 4 | RUNS.index(op) for n, op in re.findall(r"(\d+)(\D)", cigar)] if cigar != "*" else []
    seq = "" if seq == "*" else seq
    codes = [BASES.find(c.upper()) % 16 for c in seq] + [0] * (len(seq) % 2)
    name = read_id.encode() + b"\0"
    ref = places.get(contig, -1)
    mate = ref if other == "=" else places.get(other, -1)
    length = sum(r >> 4 for r in runs if RUNS[r & 15] in "MDN=X") or 1
    head = struct.pack("<iiBBHHHiiii", ref, pos, len(name), mapq, _bin(pos, pos + length), len(runs), flag, len(seq), mate, mate_pos, template)
    quals = b"\xff" * len(seq) if qual == "*" else bytes(ord(c) - 33 for c in qual)
    body = head + name + struct.pack(f"<{len(runs)}I", *runs) + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)) + quals + b"".join(map(_tag_bytes, tags or []))
    return struct.pack("<i", len(body)) + body


def _bin(begin: int, end: int) -> int:
    """The number of the smallest interval of the format's five levels, each eight times finer, that holds a range."""
    for level in range(5, 0, -1):
        shift = 29 - 3 * level
        if begin >= 0 and begin >> shift == (end - 1) >> shift:
            return ((1 << 3 * level) - 1) // 7 + (begin >> shift)
    return 4680 if begin < 0 else 0


def header_bytes(text: str, contigs: list[tuple[str, int]]) -> bytes:
    out = FILE_MAGIC + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(contigs))
    for name, length in contigs:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    return out


def compress(data: bytes) -> bytes:
    """One block."""
    zipped = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = zipped.compress(data) + zipped.flush()
    return BLOCK_MAGIC + struct.pack("<IBBHBBHH", 0, 0, 0xFF, 6, 0x42, 0x43, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def write_records(out, header: bytes, records) -> int:
    """A whole file: the header in blocks of its own, records across blocks, the last block. The number of records."""
    for at in range(0, len(header), BLOCK):
        out.write(compress(header[at : at + BLOCK]))
    held, n = bytearray(), 0
    for record in records:
        held += record
        n += 1
        while len(held) >= BLOCK:
            out.write(compress(bytes(held[:BLOCK])))
            del held[:BLOCK]
    if held:
        out.write(compress(bytes(held)))
    out.write(LAST_BLOCK)
    return n


@dataclass
class _Range(InputPartition):
    path: str
    size: int
    begin: int
    end: int
    #: Where the first record begins inside its block, None to find it.
    inside: int | None
    contigs: list


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("rangebytes", RANGE))

    def partitions(self):
        out, files = [], files_of(self.path, ".bam")
        step = max(self.range, min(RANGE, -(-sum(size for _, size in files) // TASKS)))
        for path, size in files:
            fs, name = _open(path)
            with fs.open_input_file(name) as file:
                blocks = Blocks(file, path, 0, size)
                _, contigs = read_header(blocks)
                if blocks.need(1):
                    first, inside = blocks.place(), blocks.at - next(o for o, p in reversed(blocks.starts) if o <= blocks.at)
                else:
                    first, inside = size, 0
            begins = [first, *range((first // step + 1) * step, size, step)]
            out += [_Range(path, size, b, e, inside if b == first else None, contigs) for b, e in zip(begins, [*begins[1:], size], strict=True) if b < e]
        return out or [_Range("", 0, 0, 0, 0, [])]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, name = _open(part.path)
        with fs.open_input_file(name) as file:
            at = part.begin if part.inside is not None else _first_block(file, part.begin, part.end, part.size)
            if at is None:
                return
            blocks = Blocks(file, part.path, at, part.size)
            if part.inside is not None:
                blocks.more()
                blocks.at = part.inside
            elif not find_record(blocks, len(part.contigs)):
                return
            rows = []
            while blocks.need(1) and blocks.place() < part.end:
                if not blocks.need(4) or not blocks.need(4 + (n := struct.unpack_from("<i", blocks.data, blocks.at)[0])):
                    raise ValueError(f"{part.path}: the last record is cut off")
                rows.append(decode(blocks.data[blocks.at + 4 : blocks.at + 4 + n], part.contigs))
                blocks.at += 4 + n
                if len(rows) == 1024:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _first_block(file, begin: int, end: int, size: int) -> int | None:
    """The first block that begins in a range, told by two headers in a row; None if there is none."""
    file.seek(begin)
    data = file.read(min(size, end + (1 << 18)) - begin if end - begin < 1 << 20 else 1 << 20)
    at = data.find(BLOCK_MAGIC)
    while at >= 0 and begin + at < end:
        n = block_size(data[at : at + 1024])
        if n is not None and (begin + at + n == size or block_size(data[at + n : at + n + 1024]) is not None):
            return begin + at
        at = data.find(BLOCK_MAGIC, at + 1)
    return None


@dataclass
class _Written(WriterCommitMessage):
    temporary: str
    final: str


class _Writer(DataSourceWriter):
    """A file for each task under a name of its own, moved to its place when all are there."""

    def __init__(self, options: dict):
        self.path, self.text = options["path"], options.get("header", "")
        named = re.findall(r"^@SQ\t(?:.*\t)?SN:(\S+)(?:.*\t)?.*?LN:(\d+)", self.text, re.M)
        self.contigs = [(n, int(length)) for n, length in named]

    def write(self, iterator) -> WriterCommitMessage:
        import uuid

        from pyspark import TaskContext

        places = {n: i for i, (n, _) in enumerate(self.contigs)}
        fs, root = _open(self.path)
        fs.create_dir(root)
        number = TaskContext.get().partitionId()
        temporary = f"{root}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary, compression=None) as out:
            write_records(out, header_bytes(self.text, self.contigs), (encode(tuple(row), places) for row in iterator))
        return _Written(temporary, f"{root}/part-{number:05d}.bam")

    def commit(self, messages) -> None:
        fs, root = _open(self.path)
        for m in messages:
            if m is not None:
                fs.move(m.temporary, m.final)
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.temporary)


class BamSource(DataSource):
    """Format "modcall_bam". Options: path (a file, or a folder of .bam files), rangeBytes of a task at least; for writing, header:
    the SAM header's text, whose @SQ lines name the contigs."""

    @classmethod
    def name(cls) -> str:
        return "modcall_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def read_bam(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The alignments of a BAM file or of a folder's .bam files, all fields: SCHEMA. Damaged blocks are an error."""
    spark.dataSource.register(BamSource)
    return spark.read.format("modcall_bam").option("rangeBytes", range_bytes).load(path)


def write_bam(rows: DataFrame, path: str, header: str) -> None:
    """rows of SCHEMA as BAM files, one for each task; a folder that a failed job leaves has no file but hidden ones."""
    rows.sparkSession.dataSource.register(BamSource)
    rows.write.format("modcall_bam").mode("append").option("header", header).save(path)
