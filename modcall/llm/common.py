"""What the operators of this subpackage share: scratch tables, text access, word hashes."""

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa

#: The ASCII white space that separates words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


_own: dict = {}


def scratch(spark) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent a folder of this machine is made, which only a local master can do with.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        # the setting cannot be changed once a session runs, so the folder is kept here
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="modcall-")
        root = _own[app]
    return f"{root.rstrip('/')}/modcall/{uuid.uuid4().hex}"


def materialize(df):
    """Write df as Parquet below the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean(run):
    """A batch function whose task ends by handing freed memory back to the system: workers are reused."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
            if trim:
                trim(0)

    return task


def buckets(spark, per_partition: int = 4) -> int:
    """A power of two of hash buckets, a few for each shuffle partition."""
    n = per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(0, (n - 1).bit_length())


def without(df, *names):
    """df without columns of these names, whatever their case."""
    low = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in low])


def guarded(*names):
    """For an operator on a DataFrame that makes columns of these names inside: input columns of such names (any
    case) are called otherwise meanwhile and get their names back."""

    def wrap(f):
        @functools.wraps(f)
        def run(df, *args, **more):
            low = [c.lower() for c in df.columns]
            taken, away = set(low), {}
            for c, k in zip(df.columns, low, strict=True):
                if k in names:
                    away[c] = f"kept{len(away)}_{uuid.uuid4().hex}"
            if not away or len(taken) < len(low):
                return f(df, *args, **more)
            return f(df.withColumnsRenamed(away), *args, **more).withColumnsRenamed({new: old for old, new in away.items()})

        return run

    return wrap


def place_of(df, name: str) -> int:
    """The place of a column, whatever its case."""
    return [c.lower() for c in df.columns].index(name.lower())


def raw(column) -> list:
    """Arrow strings as a list of bytes or None."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.binary()).to_pylist()


def mix(x):
    """A bijective 64-bit finaliser (splitmix64) on a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 3)
_powers = np.ones(1, np.uint64)


def powers(n: int):
    global _powers
    if len(_powers) < n:
        _powers = np.full(max(n, 256), _BASE, np.uint64)
        _powers[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
    return _powers[:n]


def word_hashes(texts: list):
    """64-bit hashes of all words of a list of byte strings (None: no words), and the number of words of each.

    Computed on one flat byte array: every word's hash is a polynomial in an odd base over random
    byte codes, summed by reduceat and finalised.
    """
    flat = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    lengths = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    ends_of = np.cumsum(lengths + 1)  # each text and its separator
    inside = ~SPACE[flat]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    if not len(edge):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    starts, ends = edge[::2], edge[1::2]
    size = ends - starts
    chars = flat[inside]
    first = np.cumsum(size) - size
    place = np.arange(len(chars)) - np.repeat(first, size)
    value = _BYTE[chars] * powers(int(size.max()))[place]
    h = mix(np.add.reduceat(value, first) + size.astype(np.uint64))
    upto = np.searchsorted(starts, ends_of)
    return h, np.diff(upto, prepend=0)


def slices(texts: list, most: int = 1 << 21):
    """Index ranges of texts of about `most` bytes together; a longer text stands alone."""
    at = held = 0
    for i, t in enumerate(texts):
        n = len(t or b"") + 1
        if held and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(texts):
        yield at, len(texts)


def windows(h, n: int, salt: int):
    """Hash of every run of n consecutive entries of h, by doubling; entry i covers h[i : i + n]."""
    done, acc, power = 0, None, h
    step, factor = 1, np.uint64(salt | 1)
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    while True:
        if n & step:
            part = power[done : done + size]
            if acc is None:
                acc = part.copy()
            else:
                acc = acc * factor + part
            done += step
        step *= 2
        if step > n:
            return mix(acc)
        power = power[: len(power) - step // 2] * factor + power[step // 2 :]
        factor = np.uint64(int(factor) ** 2 & 0xFFFFFFFFFFFFFFFF)
