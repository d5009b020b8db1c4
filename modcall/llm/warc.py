"""WARC archives written and read by Spark tasks as streams of payload chunks.

Pages become a chunked record table: (record, chunk number, bytes), with the digest carried along from chunk
to chunk, so neither side holds a whole payload. Records of equal payloads are settled by a small aggregate of
digests. Writers stream sorted chunk rows into compressed archives below the shared folder, each under a
temporary name until it is whole; readers stream every archive and carry the digest again.
"""

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import functions as F

from .common import buckets, lean, materialize, scratch

#: Bytes of a payload in one row of the chunk table.
CHUNK = 1 << 20
_STAMP = "1970-01-01T00:00:00Z"


def bare_digest(sha1) -> str:
    return base64.b32encode(sha1.digest()).decode()


def _payloads(batch):
    """(row number, payload) of a batch's html, without a copy."""
    for at, html in enumerate(batch.column("html")):
        yield at, memoryview(html.as_buffer() or b"") if html.is_valid else memoryview(b"")


def _facts(size: int):
    """A row per record with its length and the digest carried over its chunks."""

    def run(batches):
        for batch in batches:
            lengths, digests = [], []
            for _, payload in _payloads(batch):
                carried = hashlib.sha1()
                for i in range(0, len(payload), size):
                    carried.update(payload[i : i + size])
                lengths.append(len(payload))
                digests.append(bare_digest(carried))
            yield pa.record_batch([batch.column("page_id"), batch.column("row"), batch.column("url"), pa.array(lengths, pa.int64()), pa.array(digests, pa.string())], names=["page_id", "row", "url", "payload_bytes", "payload_digest"])

    return run


def _chunks(size: int):
    """Rows of the chunk table, about eight full chunks at a time."""

    def run(batches):
        for batch in batches:
            pages, hashes = batch.column("page_id").to_pylist(), batch.column("row").to_pylist()
            rows, held = [], 0
            for at, payload in _payloads(batch):
                carried = hashlib.sha1()
                for i in range(max(1, -(-len(payload) // size))):
                    part = payload[i * size : (i + 1) * size]
                    carried.update(part)
                    rows.append((pages[at], hashes[at], i, bytes(part), bare_digest(carried)))
                    held += len(part)
                    if held >= 8 * size or len(rows) >= 4096:
                        yield _table(rows)
                        rows, held = [], 0
            if rows:
                yield _table(rows)

    return run


def _table(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CHUNK_FIELDS, strict=True)], schema=_CHUNK_FIELDS)


_CHUNK_FIELDS = pa.schema([("page_id", pa.int64()), ("row", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary()), ("carried", pa.string())])
_CHUNK_SHAPE = "page_id long, row long, chunk int, data binary, carried string"
_FACT_SHAPE = "page_id long, row long, url string, payload_bytes long, payload_digest string"
#: Payload bytes of an archive, on average, once the input has more than one for each shuffle partition.
ARCHIVE = 128 << 20


def payload_chunks(pages, chunk: int = CHUNK):
    """The chunked record table of pages (page_id, row, html): page_id, row, chunk, data, carried digest."""
    return pages.mapInArrow(lean(_chunks(chunk)), _CHUNK_SHAPE)


def payload_facts(pages, chunk: int = CHUNK):
    """Length and bare base32 SHA-1 of every page's payload, by digests carried over chunks; pages: page_id, row, url,
    html."""
    return pages.mapInArrow(lean(_facts(chunk)), _FACT_SHAPE)


class _Archive:
    """A WARC file under a temporary name, one gzip member per record, renamed when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, root = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root)
        self.final, self.temporary = f"{root}/{name}", f"{root}/.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.zip = None

    def begin(self, head: list[str]):
        self.zip = zlib.compressobj(4, zlib.DEFLATED, 31)
        self.write(("WARC/1.0\r\n" + "".join(f"{x}\r\n" for x in head) + "\r\n").encode())

    def write(self, data):
        self.out.write(self.zip.compress(data))

    def end(self):
        self.write(b"\r\n\r\n")
        self.out.write(self.zip.flush())

    def close(self):
        self.out.close()
        self.fs.move(self.temporary, self.final)


def record_id(page_id, row) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{row}')}>"


def _head(r) -> list[str]:
    kind = r["record_type"]
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(r['page_id'], r['row'])}", f"WARC-Date: {_STAMP}"]
    lines += [f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"X-Page-ID: {'' if r['page_id'] is None else r['page_id']}"]
    if r["url"]:
        lines.append(f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', r['url'])}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(r['refers_to'], r['refers_row'])}", f"X-Refers-To-Page-ID: {'' if r['refers_to'] is None else r['refers_to']}", f"X-Payload-Length: {r['payload_bytes']}"]
    return [*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {r['payload_bytes'] if kind == 'response' else 0}"]


def _write(folder: str):
    """Rows sorted by bucket, record, chunk: the head row (chunk -1) opens a record, chunk rows stream into it."""

    def run(batches):
        archive, bucket, state, written, copies, carried = None, None, None, 0, 0, None

        def finish():
            nonlocal state, written
            if state is None:
                return
            if state["record_type"] == "response" and (written, carried) != (state["payload_bytes"], state["payload_digest"]):
                raise ValueError(f"page {state['page_id']}: {written} of {state['payload_bytes']} payload bytes, or others")
            archive.end()
            state, written = None, 0

        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != bucket:
                    finish()
                    if archive:
                        archive.close()
                        yield pa.record_batch([pa.array([archive.final])], names=["file"])
                    bucket, archive = r["bucket"], _Archive(folder, f"part-{r['bucket']:06d}.warc.gz")
                if r["chunk"] < 0:
                    finish()
                    state, copies = r, -1
                    archive.begin(_head(r))
                elif state is not None and state["record_type"] == "response" and r["chunk"] == copies + 1:
                    # a repeated row's chunks come in copies of which one is written
                    archive.write(r["data"])
                    written, copies, carried = written + len(r["data"]), r["chunk"], r["carried"]
        finish()
        if archive:
            archive.close()
            yield pa.record_batch([pa.array([archive.final])], names=["file"])

    return run


def write_warc(pages, folder: str, least: int = 0, chunk: int = CHUNK):
    """Write one WARC record per row of pages (page_id, url, html) into archives below folder; file names.

    Payload: html in UTF-8 (null: empty). Of records with equal payloads of at least `least` bytes, the
    one with the largest page_id (null is least) is a response and the others are revisits of it; of rows
    that repeat both page_id and payload one counts as the largest. Smaller payloads are all responses.
    An empty table writes no archive.
    """
    spark = pages.sparkSession
    page, html = F.col("page_id").cast("long"), F.col("html").cast("string")
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    base = pages.select(page.alias("page_id"), F.xxhash64("html").alias("row"), html.cast("binary").alias("html"), url.alias("url"))
    once = F.count("*").alias("copies"), F.max("url").alias("url")
    facts = materialize(payload_facts(base, chunk).groupBy("page_id", "row", "payload_bytes", "payload_digest").agg(*once))
    rank = F.struct(F.col("page_id").isNotNull().alias("some"), "page_id", "row")
    heads = facts.groupBy("payload_digest", "payload_bytes").agg(F.max(rank).alias("best"), F.sum("copies").alias("n")).where((F.col("n") > 1) & (F.col("payload_bytes") >= least))
    heads = heads.select("payload_digest", "payload_bytes", F.col("best.page_id").alias("best_page"), F.col("best.row").alias("best_row"))
    judged = facts.join(heads, ["payload_digest", "payload_bytes"], "left")
    judged = judged.withColumn("top", F.col("best_row").isNull() | (F.col("page_id").eqNullSafe(F.col("best_page")) & (F.col("row") == F.col("best_row"))))
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    judged = judged.select("*", copy.alias("copy")).withColumn("response", F.col("top") & ((F.col("copy") == 1) | F.col("best_row").isNull()))
    total = facts.agg(F.sum(F.col("payload_bytes") * F.col("copies"))).first()[0] or 0
    n = max(buckets(spark, 1), -(-total // ARCHIVE))
    spread = F.pmod(F.xxhash64("page_id", "row"), F.lit(n)).cast("int")
    refers = F.when(F.col("response"), None)
    head_rows = judged.select(
        "page_id", "row", F.lit(-1).alias("chunk"), "copy", "payload_bytes", "payload_digest", "url",
        F.when(F.col("response"), "response").otherwise("revisit").alias("record_type"), refers.otherwise(F.col("best_page")).alias("refers_to"), refers.otherwise(F.col("best_row")).alias("refers_row"),
    )
    # chunk rows go to responses only; a response is the first copy, so its chunks follow its head
    body = payload_chunks(base.select("page_id", "row", "html"), chunk).select("page_id", "row", "chunk", F.lit(1).alias("copy"), "data", "carried")
    rows = head_rows.unionByName(body, allowMissingColumns=True).withColumn("bucket", spread)
    dealt = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "page_id", "row", "copy", "chunk")
    return dealt.mapInArrow(lean(_write(folder)), "file string")


def _inflate(stream, step: int = 1 << 18):
    """The inflated bytes of a gzip stream of several members, in pieces of at most `step` bytes."""
    unzip, begun = zlib.decompressobj(31), False
    while data := stream.read(step):
        while data:
            begun = True
            yield unzip.decompress(data, step)
            if unzip.eof:
                data, unzip, begun = unzip.unused_data, zlib.decompressobj(31), False
            else:
                data = unzip.unconsumed_tail
    while begun and not unzip.eof:  # what was read but not given out yet
        if not (piece := unzip.decompress(b"", step)) and not unzip.eof:
            raise ValueError("an archive ends inside a record")
        yield piece


class _Stream:
    """Reads lines and counted bytes from pieces, holding no more than a piece and a line."""

    def __init__(self, pieces):
        self.pieces, self.held, self.at = pieces, b"", 0

    def more(self) -> bool:
        for piece in self.pieces:
            if piece:
                self.held, self.at = (self.held[self.at :] + piece if self.at < len(self.held) else piece), 0
                return True
        return False

    def head(self) -> list[str] | None:
        """The lines of the next record's head, or None at the end."""
        while (end := self.held.find(b"\r\n\r\n", self.at)) < 0:
            if not self.more():
                if self.held[self.at :].strip():
                    raise ValueError("an archive ends inside a record")
                return None
        lines, self.at = self.held[self.at : end].decode().split("\r\n"), end + 4
        return lines

    def take(self, n: int, step: int):
        """Pieces of at most `step` bytes of the next n."""
        while n:
            if self.at == len(self.held) and not self.more():
                raise ValueError("an archive ends inside a record")
            part = self.held[self.at : self.at + min(n, step)]
            self.at += len(part)
            n -= len(part)
            yield part


def warc_records(stream, chunk: int = CHUNK):
    """(fields, chunks) of each record of an open compressed archive; chunks must be used up in turn."""
    source = _Stream(_inflate(stream))
    while (lines := source.head()) is not None:
        if lines[0] != "WARC/1.0":
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        yield fields, source.take(int(fields["Content-Length"]), chunk)
        if b"".join(source.take(4, 4)) != b"\r\n\r\n":
            raise ValueError("a record does not end with an empty line")


def _read(chunk: int, with_data: bool):
    def rows(path):
        fs, name = pa.fs.FileSystem.from_uri(path) if "://" in path else (pa.fs.LocalFileSystem(), path)
        with fs.open_input_stream(name, compression=None) as stream:
            for fields, pieces in warc_records(stream, chunk):
                page = int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None
                revisit, carried, size = fields["WARC-Type"] == "revisit", hashlib.sha1(), 0
                for i, part in enumerate(pieces):
                    carried.update(part)
                    size += len(part)
                    if with_data:
                        yield fields["WARC-Record-ID"], page, i, part, bare_digest(carried)
                told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if not revisit and bare_digest(carried) != told:
                    raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
                if not with_data:
                    yield page, int(fields["X-Payload-Length"]) if revisit else size, told, fields["WARC-Type"], int(fields["X-Refers-To-Page-ID"]) if fields.get("X-Refers-To-Page-ID") else None, fields.get("WARC-Target-URI")

    shape = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("chunk", pa.int32()), ("data", pa.binary()), ("carried", pa.string())]) if with_data else pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held = []
                for row in rows(path):
                    held.append(row)
                    if len(held) >= (8 if with_data else 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), shape, strict=True)], schema=shape)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), shape, strict=True)], schema=shape)

    return run


def read_warc(files):
    """Records of the archives named by files (file string): page_id, payload_bytes, payload_digest,
    record_type, refers_to, url. A response's digest is carried over its chunks and checked."""
    return files.select("file").mapInArrow(lean(_read(CHUNK, False)), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def read_warc_chunks(files, chunk: int = CHUNK):
    """The archives' payloads as a chunked record table: record_id, page_id, chunk, data, carried digest."""
    return files.select("file").mapInArrow(lean(_read(chunk, True)), "record_id string, page_id long, chunk int, data binary, carried string")


def op4_warc(spark, sf_dir):
    """Per page: what its record in the archives says after they were written and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = scratch(spark)
    files = write_warc(pages, f"{folder}/warc", 0)
    files.write.parquet(f"{folder}/files")
    files = spark.read.schema("file string").parquet(f"{folder}/files")
    files = files.repartition(max(1, files.count()), "file")
    return read_warc(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL for op4_warc: SHA-1 in base 32, twenty bits at a time.
OP4_SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
digests AS (
  SELECT page_id, payload_bytes,
    translate(list_aggregate(list_transform(range(8), lambda i:
      to_base(CAST('0x' || substr(hex, CAST(5 * i + 1 AS INT), 5) AS BIGINT), 32, 4)), 'string_agg', ''),
      '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest
  FROM hashed),
best AS (SELECT payload_digest, payload_bytes, max(page_id) AS top FROM digests GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM digests JOIN best USING (payload_digest, payload_bytes)
"""
