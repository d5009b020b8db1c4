"""Substring dedup: drop words covered by an n-word window that occurred earlier in the corpus.

1. Sketch. Each partition counts the *anchors* of its windows: the word gram of smallest hash in the
   window. Equal windows have equal anchors at different places, so the count of its anchor never falls
   below the count of a window. The partitions' counts are merged cell by cell into a count-min sketch
   of fixed size, of which one bit a cell is broadcast: estimated twice or more.
2. Exact pass. Only windows whose anchor is estimated repeated are grouped by a 96-bit fingerprint. A
   partition settles what it holds itself and ships one row per distinct window, so a passage shared
   by a third of all documents costs each partition one row. The rest meets by hash bucket.
3. The windows that are not first come back to their documents, where covered words are dropped.

Larger inputs fill the sketch and let more windows through to the exact pass; none is ever lost.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buckets, guarded, lean, mix, raw, slices, windows, without, word_hashes

#: The sketch: rows, cells in a row (2 to the power), segments in a row. One bit a cell is broadcast: 32 MB.
ROWS, CELLS, SEGMENTS = 2, 27, 64
_SEED = (0xD1B54A32D192ED03, 0xABC98388FB8FAC03)
_KEY, _KIND, _BODY, _ROW = "__bucket", "__kind", "__body", "__row"


def _cells(anchor, row: int):
    return ((anchor * np.uint64(_SEED[row])) >> np.uint64(64 - CELLS)).astype(np.uint32)


def _slide(x, n: int, best):
    """best (np.minimum or np.maximum) over x[i : i + n] for each i."""
    step = 1
    while step * 2 <= n:
        x = best(x[:-step], x[step:])
        step *= 2
    return x if step == n else best(x[: len(x) - (n - step)], x[n - step :])


def _anchors(h, sizes, n: int):
    """Of every window: valid (within one text), the anchor's hash; of every gram whether it is an anchor."""
    k = max(1, n // 2)
    gram = windows(h, k, 0x2545F4914F6CDD1D) | np.uint64(1)
    low = _slide(gram, n - k + 1, np.minimum)
    first = np.cumsum(sizes) - sizes
    left = np.repeat(first + sizes, sizes)[: len(low)] - np.arange(len(low))
    valid = left >= n
    high = np.concatenate([np.zeros(n - k, np.uint64), np.where(valid, low, np.uint64(0)), np.zeros(n - k, np.uint64)])
    chosen = _slide(high, n - k + 1, np.maximum) == gram
    return valid, low, gram[chosen]


def _sketch(n: int):
    def run(batches):
        held: list[list] = [[] for _ in range(ROWS)]
        once = [np.zeros(0, np.uint32)] * ROWS
        twice = [np.zeros(0, np.uint32)] * ROWS

        def fold():
            for r in range(ROWS):
                cell, count = np.unique(np.concatenate([once[r], twice[r], twice[r], *held[r]]), return_counts=True)
                once[r], twice[r] = cell[count == 1], cell[count > 1]
                held[r] = []

        size = 0
        for batch in batches:
            texts = raw(batch.column(0))
            for a, b in slices(texts):
                h, sizes = word_hashes(texts[a:b])
                if len(h) < n:
                    continue
                found = _anchors(h, sizes, n)[2]
                for r in range(ROWS):
                    held[r].append(_cells(found, r))
                size += len(found)
            if size > 1 << 19:
                fold()
                size = 0
        fold()
        press = zstandard.ZstdCompressor(1)
        seg, body = [], []
        for r in range(ROWS):
            cuts = np.arange(SEGMENTS + 1) << (CELLS - SEGMENTS.bit_length() + 1)
            parts = [(x, np.searchsorted(x, cuts)) for x in (once[r], twice[r])]
            for s in range(SEGMENTS):
                got = [x[at[s] : at[s + 1]] for x, at in parts]
                if sum(map(len, got)):
                    gaps = [np.diff(x, prepend=np.uint32(cuts[s])).astype(np.uint32) for x in got]
                    flat = np.concatenate(gaps).view(np.uint8).reshape(-1, 4).T.tobytes()
                    seg.append(r * SEGMENTS + s)
                    body.append(np.uint32(len(got[0])).tobytes() + press.compress(flat))
        yield pa.record_batch([pa.array(seg, pa.int32()), pa.array(body, pa.binary())], names=["seg", "body"])

    return run


def _merge(batches):
    """Partial sketches of a segment, sorted by segment, into one bit a cell: counted at least twice."""
    width = 1 << (CELLS - SEGMENTS.bit_length() + 1)
    open_, now, count = zstandard.ZstdDecompressor(), None, None

    def out():
        return pa.record_batch([pa.array([now], pa.int32()), pa.array([np.packbits(count > 1).tobytes()], pa.binary())], names=["seg", "bits"])

    for batch in batches:
        for seg, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if seg != now:
                if now is not None:
                    yield out()
                now, count = seg, np.zeros(width, np.uint8)
            ones = int(np.frombuffer(body[:4], np.uint32)[0])
            gap = np.frombuffer(open_.decompress(body[4:]), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
            one, two = np.cumsum(gap[:ones]), np.cumsum(gap[ones:])
            count[one] = np.minimum(count[one] + 1, 2)
            count[two] = 2
    if now is not None:
        yield out()


def repeated_cells(docs, n: int):
    """The merged sketch as a bit a cell (bytes of fixed size): cells counted at least twice."""
    part = docs.select("text").mapInArrow(lean(_sketch(n)), "seg int, body binary")
    rows = part.repartition("seg").sortWithinPartitions("seg").mapInArrow(lean(_merge), "seg int, bits binary").collect()
    width = 1 << (CELLS - SEGMENTS.bit_length() - 2)
    bits = np.zeros((ROWS * SEGMENTS, width), np.uint8)
    for r in rows:
        bits[r.seg] = np.frombuffer(r.bits, np.uint8)
    return bits.reshape(ROWS, -1)


def _narrow(x):
    return x.astype(np.uint16) if not len(x) or int(x.max()) < 1 << 16 else x.astype(np.uint32)


def _pack(*arrays) -> bytes:
    """Arrays as one binary: for each its type and byte length, then its bytes."""
    return b"".join(x for a in arrays for x in (a.dtype.str.encode().ljust(4), np.uint32(a.nbytes).tobytes(), a.tobytes()))


def _unpack(body: bytes) -> list:
    out, at = [], 0
    while at < len(body):
        kind, size = body[at : at + 4].decode().strip(), int(np.frombuffer(body, np.uint32, 1, at + 4)[0])
        out.append(np.frombuffer(body[at + 8 : at + 8 + size], kind))
        at += 8 + size
    return out


def _marks(key, start, n_buckets: int, kind: int, shift: int):
    """Rows (bucket, kind, body) of windows to drop: packed by document bucket as keys, counts and starts."""
    order = np.lexsort((start, key))
    key, start = key[order], start[order]
    at = np.searchsorted(key, (np.arange(n_buckets + 1, dtype=np.uint64) << np.uint64(shift))[:-1] if shift < 64 else np.zeros(1, np.uint64))
    at = np.append(at, len(key))
    rows = []
    for b in np.flatnonzero(np.diff(at)):
        k, s = key[at[b] : at[b + 1]], start[at[b] : at[b + 1]]
        head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        rows.append((int(b), kind, _pack(k[head], _narrow(np.diff(np.append(head, len(k)))), _narrow(s))))
    return rows


def _batch(rows):
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=[_KEY, _KIND, _BODY])


def _later(h1, h2, doc, key, start):
    """Indexes grouped by window, and for each whether an earlier place holds the window, and whether it is alone."""
    order = np.lexsort((start, doc, h2, h1))
    a, b, d, s = h1[order], h2[order], doc[order], start[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    return order, (d != d[head][group]) | (s != s[head][group])


def _candidates(n: int, sketch, n_buckets: int, flush: int = 1 << 19):
    """Windows estimated repeated: settled ones in one row of any bucket (kind 1), the rest by hash bucket (kind 0)."""
    shift = 64 - (n_buckets.bit_length() - 1)

    def run(batches):
        bits = sketch.value
        held: list = []

        def out():
            if not held:
                return
            h1, h2, doc, key, start = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, later = _later(h1, h2, doc, key, start)
            drop, rest = order[later], order[~later]
            rows = []
            if len(drop):
                rows.append((int(key[drop[0]] >> np.uint64(shift)) if shift < 64 else 0, 1, _pack(key[drop], _narrow(start[drop]))))
            # of the first places, sorted by hash, each bucket is a slice
            h1, h2, doc, key, start = (x[rest] for x in (h1, h2, doc, key, start))
            at = np.append(np.searchsorted(h1, (np.arange(n_buckets, dtype=np.uint64) << np.uint64(shift)) if shift < 64 else np.zeros(1, np.uint64)), len(h1))
            for b in np.flatnonzero(np.diff(at)):
                cut = slice(at[b], at[b + 1])
                _, own, ref = np.unique(key[cut], return_index=True, return_inverse=True)
                rows.append((int(b), 0, _pack(h1[cut], h2[cut], _narrow(ref), _narrow(start[cut]), doc[cut][own], key[cut][own])))
            yield _batch(rows)

        size = 0
        for batch in batches:
            ids, keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), raw(batch.column(2))
            for a, b in slices(texts):
                h, sizes = word_hashes(texts[a:b])
                if len(h) < n:
                    continue
                valid, low, _ = _anchors(h, sizes, n)
                for r in range(ROWS):
                    cell = _cells(low, r)
                    valid &= (bits[r][cell >> np.uint32(3)] << (cell & np.uint32(7)).astype(np.uint8)) & 128 > 0
                at = np.flatnonzero(valid)
                if not len(at):
                    continue
                text = np.repeat(np.arange(a, b), sizes)[at]
                first = np.repeat(np.cumsum(sizes) - sizes, sizes)[at]
                h1, h2 = windows(h, n, 0x9E3779B97F4A7C15)[at], (windows(h, n, 0xC2B2AE3D27D4EB4F)[at] >> np.uint64(32)).astype(np.uint32)
                held.append((h1, h2, ids[text], keys[text], (at - first).astype(np.int64)))
                size += len(at)
                if size >= flush:
                    yield from out()
                    size = 0
        yield from out()

    return run


def _decide(n_buckets: int):
    """Rows sorted by bucket: windows of a bucket meet; those that are not first leave, with the settled ones,
    as marks by the bucket of their document."""
    shift = 64 - (n_buckets.bit_length() - 1)

    def run(batches):
        now, held, settled = None, [], []

        def out():
            gone = [(p[0], p[1].astype(np.int64)) for p in map(_unpack, settled)]
            parts = [_unpack(x) for x in held]
            held.clear()
            settled.clear()
            if parts:
                h1, h2 = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
                start = np.concatenate([p[3].astype(np.int64) for p in parts])
                doc, key = (np.concatenate([p[i][p[2]] for p in parts]) for i in (4, 5))
                order, later = _later(h1, h2, doc, key, start)
                gone.append((key[order[later]], start[order[later]]))
            if gone and (rows := _marks(*map(np.concatenate, zip(*gone, strict=True)), n_buckets, 1, shift)):
                yield _batch(rows)

        for batch in batches:
            for b, k, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if b != now:
                    yield from out()
                    now = b
                (settled if k else held).append(x)
        yield from out()

    return run


def _strip(n: int, columns: list[str], rejoin: bool):
    """Marks and documents of a bucket, marks first: documents leave without the covered words."""

    def run(batches):
        now, held = None, []
        keys = counts = starts = np.zeros(0, np.uint64)

        def index():
            nonlocal keys, counts, starts
            parts = [_unpack(x) for x in held]
            held.clear()
            k = np.repeat(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)) if parts else np.zeros(0, np.uint64)
            s = np.concatenate([p[2].astype(np.int64) for p in parts]) if parts else np.zeros(0, np.int64)
            order = np.argsort(k, kind="stable")
            keys, starts = k[order], s[order]

        for batch in batches:
            table = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            own, text, total, gone = [], [], [], []
            for i, (b, kind, key, body) in enumerate(zip(table[_KEY].to_pylist(), table[_KIND].to_pylist(), table[_ROW].to_pylist(), table[_BODY].to_pylist(), strict=True)):
                if b != now:
                    now, keys, starts = b, np.zeros(0, np.uint64), np.zeros(0, np.int64)
                    held.clear()
                if kind == 1:
                    held.append(body)
                    continue
                if held:
                    index()
                own.append(i)
                words = (body or b"").split()
                k = np.uint64(key & 0xFFFFFFFFFFFFFFFF)
                at = starts[np.searchsorted(keys, k) : np.searchsorted(keys, k, "right")]
                if len(at):
                    cover = np.bincount(at, minlength=len(words) + 1)[: len(words) + 1] > 0
                    edge = np.zeros(len(words) + n + 1, np.int32)
                    np.add.at(edge, np.flatnonzero(cover), 1)
                    np.add.at(edge, np.flatnonzero(cover) + n, -1)
                    gone_here = np.cumsum(edge)[: len(words)] > 0
                    kept = [w for w, g in zip(words, gone_here.tolist(), strict=True) if not g]
                else:
                    kept = words
                text.append(b" ".join(kept) if rejoin or len(kept) < len(words) else body or b"")
                total.append(len(words))
                gone.append(len(words) - len(kept))
            if own:
                rest = batch.take(pa.array(own))
                cols = [rest.column(rest.schema.get_field_index(c)) for c in columns]
                yield pa.record_batch([*cols, pa.array(text, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*columns, "kept_text", "n_words", "n_removed"])

    return run


@guarded(_KEY, _KIND, _BODY, _ROW)
def dedup_substrings(docs, n: int = 20, rejoin: bool = True):
    """Documents with kept_text, n_words and n_removed: words covered by an n-word window seen earlier are gone.

    Words are runs without ASCII white space; kept words are joined by one space. Earlier: smaller
    doc_id (null is least), or the same row and an earlier start. Windows are judged on the input.
    Null or empty text: no words, kept_text ''. Texts under n words lose nothing. Rows that share a
    doc_id are told apart by their text and have no order between them: none takes a word from another;
    equal rows give equal results. With rejoin off, texts that lose nothing keep their white space. Every other column is passed on; input columns named like a result
    are replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, "kept_text", "n_words", "n_removed")
    sketch = spark.sparkContext.broadcast(repeated_cells(docs, n))
    n_buckets = buckets(spark, 1)
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    key = F.xxhash64("doc_id", "text")
    shape = f"{_KEY} int, {_KIND} int, {_BODY} binary"
    found = docs.select(rank.alias("doc_id"), key.alias("k"), "text").mapInArrow(lean(_candidates(n, sketch, n_buckets)), shape)
    marks = found.repartition(_KEY).sortWithinPartitions(_KEY).mapInArrow(lean(_decide(n_buckets)), shape)
    bits = n_buckets.bit_length() - 1
    place = F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)
    rest = [c for c in docs.columns if c.lower() != "text"]
    rows = docs.select(place.alias(_KEY), F.lit(2).alias(_KIND), key.alias(_ROW), F.col("text").cast("binary").alias(_BODY), *[f"`{c}`" for c in rest])
    both = marks.withColumn(_ROW, F.lit(0).cast("long")).unionByName(rows, allowMissingColumns=True)
    types = T.StructType([docs.schema[c] for c in rest]).add("kept_text", "string").add("n_words", "long").add("n_removed", "long")
    return both.repartition(_KEY).sortWithinPartitions(_KEY, _KIND).mapInArrow(lean(_strip(n, rest, rejoin)), _nullable(types))


def _nullable(schema):
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def op1_substring_dedup(spark, sf_dir):
    """Per document: n_words, n_removed and the digest of what substring dedup keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs, 20).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
