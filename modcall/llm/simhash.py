"""SimHash near-dedup: fingerprints meet in the middle, at variants within half the radius of each."""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import guarded, lean, materialize, mix, raw, without
from .components import components


def _totals(h):
    """How many rows of big-endian 64-bit words have each bit set; bytes add up in runs that cannot overflow."""
    bits = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1)
    whole = len(bits) // 255 * 255
    runs = bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8)
    return runs.sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)


def hashes(text: bytes | None, shingle: int):
    """XXH64 (seed 42) of the word shingles of a text, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hashed(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1]).tolist()
    return np.array([hashed(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64)  # noqa: B905


def _names(words64: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, words64))]


def simhash_of(got, words64: int = 1) -> list[int]:
    """SimHash of shingle hashes: a bit is set if it is set in over half of them; none: 0."""
    if not len(got):
        return [0] * words64
    total = 0
    for at in range(0, len(got), 1 << 14):
        part = got[at : at + (1 << 14)]
        more = [mix(part + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for k in range(1, words64)]
        total = total + _totals(np.stack([part, *more], axis=1).astype(">u8"))
    return np.packbits(2 * total > len(got)).view(">u8").tolist()


def odd_sketch(got) -> bytes:
    """The number of distinct hashes (4 bytes) and the parity of their number in each of ODD places, a bit each.

    Two sets differ in at least as many elements as their parities differ in places."""
    return np.uint32(len(got)).tobytes() + np.packbits(np.bincount((got % np.uint64(ODD)).astype(np.int64), minlength=ODD) & 1).tobytes()


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            got = np.array([simhash_of(hashes(t, shingle))[0] for t in raw(batch.column(batch.num_columns - 1))], np.uint64)
            yield pa.record_batch([*batch.columns[:-1], pa.array(got.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    return run


def _long_fingerprints(shingle: int):
    """SimHashes of WORDS words and odd sketches of the sets of shingles."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(hashes(t, shingle)) for t in raw(batch.column(batch.num_columns - 1))]
            got = np.array([simhash_of(x, WORDS) for x in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            yield pa.record_batch([*batch.columns[:-1], *[pa.array(got[:, k]) for k in range(WORDS)], pa.array([odd_sketch(x) for x in sets], pa.binary())], names=[*batch.schema.names[:-1], *_names(WORDS), "odd"])

    return run


def _meet(radius: int):
    """Rows (v, fp, id) sorted by variant: links of each member of a variant with the variant's smallest id."""

    def links(v, fp, node):
        new = np.append(True, v[1:] != v[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(v)))
        if (size < 2).all():
            return None
        many = np.repeat(size > 1, size)
        v, fp, node = v[many], fp[many], node[many]
        order = np.lexsort((node, v))
        v, fp, node = v[order], fp[order], node[order]
        new = np.append(True, v[1:] != v[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        away = np.unpackbits((fp ^ fp[first]).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)
        good = ~new & (away <= radius)
        pairs = np.unique(np.stack([node[first][good], node[good]], axis=1), axis=0)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches):
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            got = [np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False)]) for i, r in enumerate(rest)]
            cut = int(np.searchsorted(got[0], got[0][-1])) if len(got[0]) else 0
            rest = [x[cut:] for x in got]
            if cut and (out := links(*[x[:cut] for x in got])) is not None:
                yield out
        if len(rest[0]) and (out := links(*rest)) is not None:
            yield out

    return run


def ball(fp, radius: int):
    """All values within `radius` (0, 1 or 2) bits of a fingerprint column, as an array."""
    bit = [F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)]
    masks = [F.lit(0).cast("long")]
    if radius:
        masks += bit
    if radius > 1:
        masks += [bit[i].bitwiseXOR(bit[j]) for i in range(64) for j in range(i)]
    return F.transform(F.array(*masks), lambda m: fp.bitwiseXOR(m))


@guarded("__k", "__id", "v", "rep", "node", "component", "a", "b")
def simhash_components(docs, shingle: int = 5, radius: int = 2, short: bool = False):
    """Documents with fp (long) and component_id: the smallest doc_id reachable by links of <= radius bits.

    Words are runs without ASCII white space, A-Z lower-cased; shingles keep repeats. Under `shingle`
    words: the whole sequence; none or null text: fingerprint 0, which links like any other. Equal
    fingerprints are one class, of which only the smallest doc_id takes part in the search. Rows that
    share a doc_id keep their own fingerprints; a null doc_id links through its fingerprint and gets
    its class's component (null if the class has no id). Two fingerprints within the radius share a
    variant within half of it, and members of a variant are within the radius of each other, so a star
    per variant keeps every connection. radius is 0, 2 or 4. Input columns named fp or component_id
    are replaced. short: doc_id, fp and component_id only, so that no text is moved.
    """
    if radius not in (0, 2, 4):
        raise ValueError("radius must be 0, 2 or 4")
    docs = without(docs, "fp", "component_id")
    shape = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("__k", T.LongType()), T.StructField("fp", T.LongType())])
    key = F.xxhash64("text")
    marked = materialize(docs.select(F.col("doc_id").cast("long"), key.alias("__k"), "text").mapInArrow(lean(_fingerprints(shingle)), shape))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    variants = classes.where("rep is not null").select(F.explode(ball(F.col("fp"), radius // 2)).alias("v"), "fp", "rep")
    edges = variants.repartition("v").sortWithinPartitions("v").mapInArrow(lean(_meet(radius)), "a long, b long")
    joined = classes.join(components(edges), F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    marked = marked.join(joined, "fp")
    if short:
        return marked.drop("__k")
    marked = marked.dropDuplicates(["doc_id", "__k"]).withColumnRenamed("doc_id", "__id")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__k"))
    return docs.join(marked, same).drop("__id", "__k")


#: Words of the long fingerprint; bands of bits that are searched each for a radius of two bits; words that
#: go along with a variant, and standard deviations that a pair may lie beyond the expected number of bits.
WORDS, BANDS, BITS = 6, 16, 24
#: Places of an odd sketch; it tells sets of up to about as many elements apart.
ODD = 2048
ALONG, SPREAD = 3, 4
#: Members of a variant, or of a block of one, that a task compares at a time; pairs for each member that a
#: variant gives at once: larger and denser variants wait until the first links are known.
LARGEST, DENSE, THIN = 2048, 3.5, 32


def _bands(bands: int, bits: int):
    """Every band's variants within one bit, as (v, rep, last words): the band's number above the variant's bits."""

    def run(batches):
        flips = np.append(0, 1 << np.arange(bits)).astype(np.int64)
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                batch = big.slice(at, 2048)
                rep = np.asarray(batch.column(0))
                words = np.stack([np.asarray(batch.column(k)) for k in range(1, batch.num_columns)], axis=1).astype(">i8")
                wide = np.unpackbits(words.view(np.uint8).reshape(len(rep), -1), axis=1)[:, : bands * bits].reshape(len(rep), bands, bits)
                value = (wide.astype(np.int64) << np.arange(bits)).sum(axis=2) | np.arange(bands)[None, :] << 40
                v = value[:, :, None] ^ flips
                along = [words[:, k - ALONG].astype(np.int64) for k in range(ALONG)]
                yield pa.record_batch([pa.array(v.ravel()), *(pa.array(np.repeat(x, bands * len(flips))) for x in (rep, *along))], names=["v", "rep", *_along()])

    return run


def _along() -> list[str]:
    return [f"w{k}" for k in range(ALONG)]


def _away(words, i, j):
    """Bits in which members i and j differ; words: one array of each 64-bit word."""
    return sum(np.bitwise_count((w[i] ^ w[j]).view(np.uint64)).astype(np.int64) for w in words)


def _loose(bits: int, share: float) -> int:
    """Bits of `bits` that a pair may differ in, SPREAD standard deviations above the expected share."""
    return math.ceil(bits * share + SPREAD * math.sqrt(bits * share * (1 - share)))


def _lags(size):
    """For groups of these sizes side by side: in turn all places i whose place i + lag is in their group, with the lag."""
    after = np.repeat(np.cumsum(size), size) - 1 - np.arange(size.sum())
    at, lag = np.flatnonzero(after > 0), 1
    while len(at):
        yield at, lag
        lag += 1
        at = at[after[at] >= lag]


def _ordered(a, b):
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0).reshape(-1, 2).T


def _members(most: int, largest: int):
    """Of rows (v, rep, words) sorted by v and rep: (-1, a, b) for pairs of a variant whose words differ in at most
    `most` bits. Variants of more than `largest` members or DENSE such pairs a member give (v, rep, rep) for
    each member instead, and one of THIN of them, by hash, the pairs of each member with the next one: enough to
    link most of a group before all pairs that are not linked yet are looked at."""

    def found(v, rep, words, done):
        """done: members of the first variant that are given already."""
        head = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        size = np.diff(np.append(head, len(v)))
        wait = size > largest
        wait[0] |= done > 0
        near = lambda i, j: (rep[i] != rep[j]) & (_away(words, i, j) <= most)
        some = (size > 1) & ~wait
        place, own = np.flatnonzero(np.repeat(some, size)), np.repeat(np.arange(len(size)), size)
        count, pairs = np.zeros(len(size), np.int64), []
        for at, lag in _lags(size[some]):
            i = place[at]
            i = i[count[own[i]] <= DENSE * size[own[i]]]
            if not len(i):
                break
            i = i[near(i, i + lag)]
            if len(i):
                pairs.append((i, i + lag))
                np.add.at(count, own[i], 1)
        wait |= count > DENSE * size
        i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*pairs, strict=True)) if pairs else np.zeros((2, 0), np.int64)
        keep = ~wait[own[i]]
        some = wait & (v[head].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) % np.uint64(THIN) == 0)
        new = np.flatnonzero(np.repeat(some, size) & (np.arange(len(v)) != head[own]))
        p, q = np.concatenate([i[keep], new - 1]), np.concatenate([j[keep], new])
        ok = near(p, q)
        a, b = _ordered(rep[p[ok]], rep[q[ok]])
        given = np.flatnonzero(np.repeat(wait, size))
        given = given[given >= done]
        out = [np.concatenate([np.full(len(a), -1), v[given]]), np.concatenate([a, rep[given]]), np.concatenate([b, rep[given]])]
        return pa.record_batch([pa.array(x) for x in out], names=["v", "a", "b"])

    def run(batches):
        rest, done = [np.zeros(0, np.int64)] * (2 + ALONG), 0
        for batch in batches:
            got = [np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False)]) for i, r in enumerate(rest)]
            if not len(got[0]):
                continue
            open_ = int(np.searchsorted(got[0], got[0][-1]))
            if open_:
                v, rep, *words = (x[:open_] for x in got)
                yield found(v, rep, words, done)
                done = 0
            rest = [x[open_:] for x in got]
            if done or len(rest[0]) > largest:  # a large variant that is still open keeps its first and last member
                v, rep, *words = rest
                yield found(v, rep, words, done)
                rest, done = [x[[0, -1]] for x in rest], 2
        if len(rest[0]) > done:
            v, rep, *words = rest
            yield found(v, rep, words, done)

    return run


def _differ(odd):
    """Rows of odd sketches as set sizes and parities."""
    flat = np.frombuffer(b"".join(odd.tolist()), np.uint8).reshape(len(odd), -1)
    return flat[:, :4].copy().view(np.uint32)[:, 0].astype(np.int64), flat[:, 4:].copy().view(np.uint64)


def _across(most: int, similarity: float):
    """Of rows (v, rep, c, words, odd) sorted by v: all pairs of a group with different c whose words differ in at most
    `most` bits and whose odd sketches do not rule the similarity out."""
    part = (1 - similarity) / (1 + similarity)

    def pairs(v, rep, c, *words):
        *words, odd = words
        many, parity = _differ(odd)
        size = np.diff(np.append(np.flatnonzero(np.append(True, v[1:] != v[:-1])), len(v)))
        held, n = [], 0
        for i, lag in _lags(size):
            i = i[c[i] != c[i + lag]]
            i = i[_away(words, i, i + lag) <= most]
            for a in range(0, len(i), 1 << 16):
                k = i[a : a + (1 << 16)]
                k = k[np.bitwise_count(parity[k] ^ parity[k + lag]).sum(axis=1, dtype=np.int64) <= part * (many[k] + many[k + lag]) + 1e-6]
                held.append((rep[k], rep[k + lag]))
            n = sum(len(x) for x, _ in held)
            if n > 1 << 18:
                yield held
                held, n = [], 0
        if n:
            yield held

    def run(batches):
        rest = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            got = [np.concatenate(x) for x in zip(rest, new, strict=True)] if rest else new
            cut = int(np.searchsorted(got[0], got[0][-1])) if len(got[0]) else 0
            yield from given([x[:cut] for x in got])
            rest = [x[cut:] for x in got]
        if rest:
            yield from given(rest)

    def given(rows):
        for held in pairs(*rows) if len(rows[0]) else ():
            a, b = _ordered(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _sets(shingle: int):
    """(rep, text) to (rep, s): the distinct hashes of the text's shingles."""

    def run(batches):
        for batch in batches:
            sets = [np.unique(hashes(t, shingle)).view(np.int64) for t in raw(batch.column(1))]
            upto = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate([*sets, np.zeros(0, np.int64)])))], names=["rep", "s"])

    return run


def _possible(similarity: float):
    """Of pairs (a, b, oa, ob): those that the odd sketches of their sets do not rule out."""
    part = (1 - similarity) / (1 + similarity)

    def run(batches):
        for batch in batches:
            (many, one), (more, two) = (_differ(batch.column(i).to_numpy(zero_copy_only=False)) for i in (2, 3)) if batch.num_rows else ((0, 0), (0, 0))
            keep = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) <= part * (many + more) + 1e-6 if batch.num_rows else []
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(docs, classes, pairs, shingle: int, similarity: float, most: int):
    """Of candidate pairs (a, b) of class representatives: those whose shingle sets are similar, exactly.

    Pairs whose whole fingerprints differ in more than `most` bits met by chance, and odd sketches rule others out
    without loss. The sets are made for the texts of the rest only.
    """
    names = _names(WORDS)
    left, right = (classes.select(F.col("rep").alias(x), F.col("odd").alias("o" + x), *[F.col(c).alias(x + c) for c in names]) for x in "ab")
    away = sum((F.bit_count(F.col("a" + c).bitwiseXOR(F.col("b" + c))) for c in names[1:]), F.bit_count(F.col("afp").bitwiseXOR(F.col("bfp"))))
    near = pairs.join(left, "a").join(right, "b").where(away <= most).select("a", "b", "oa", "ob")
    pairs = materialize(near.mapInArrow(lean(_possible(similarity)), "a long, b long").distinct())
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct().join(classes.select("rep", "rep_k"), "rep")
    wanted = materialize(wanted)
    few = F.broadcast(wanted) if wanted.count() <= 1 << 20 else wanted
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("rep_k"), "text").join(few, ["rep", "rep_k"]).dropDuplicates(["rep", "rep_k"])
    sets = materialize(texts.select("rep", "text").mapInArrow(lean(_sets(shingle)), "rep long, s array<long>"))
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared / F.greatest(F.lit(1), F.size("sa") + F.size("sb") - shared) >= similarity).select("a", "b").distinct()


def _search(docs, shingle: int, similarity: float, bands: int, bits: int, largest: int):
    """Rows of docs as (doc_id, __k, __r, g, component_id): keys of text and whole row, group, its smallest doc_id.

    A class without any doc_id takes part under a hash of its fingerprint.
    """
    names, key = _names(WORDS), F.xxhash64("text")
    shape = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "__k", "__r", *names)]).add("odd", "binary")
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    marked = materialize(docs.select(F.col("doc_id").cast("long"), key.alias("__k"), row.alias("__r"), "text").mapInArrow(lean(_long_fingerprints(shingle)), shape))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__k", "odd")).alias("least")
    classes = marked.groupBy(*names).agg(least).select(*names, F.col("least.doc_id").alias("id"), F.col("least.__k").alias("rep_k"), F.col("least.odd").alias("odd"))
    classes = materialize(classes.withColumn("rep", F.coalesce("id", F.xxhash64(*names))))
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    variants = f"v long, rep long, {', '.join(c + ' long' for c in _along())}"
    found = classes.select("rep", *names).mapInArrow(lean(_bands(bands, bits)), variants)
    few, whole = _loose(64 * ALONG, share), _loose(64 * WORDS, share)
    met = materialize(found.repartition("v").sortWithinPartitions("v", "rep").mapInArrow(lean(_members(few, largest)), "v long, a long, b long"))
    group = components(_verified(docs, classes, met.where("v < 0").select("a", "b").distinct(), shingle, similarity, whole))
    waiting = met.where("v >= 0").select("v", F.col("a").alias("rep"))
    members = materialize(waiting.join(group, F.col("rep") == F.col("node"), "left").select("v", "rep", F.coalesce("component", "rep").alias("c")))
    sets = members.groupBy("v").agg(F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"), F.count("*").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    # variants with the same members hold the same pairs: one of them is enough; one component has no pair left
    split = sets.where("lo < hi").groupBy("x", "y", "m").agg(F.min("v").alias("v")).select("v", F.ceil(F.col("m") / largest).alias("n"))
    members = materialize(members.join(split, "v"))
    if members.first() is not None:
        # each block of a variant meets each other block, and itself, in a group of its own
        block = F.pmod(F.xxhash64("rep"), "n")
        cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda j: F.xxhash64("v", F.least(block, j), F.greatest(block, j)))
        full = members.join(classes.select("rep", *names, "odd"), "rep")
        many = full.where("n > 1").select(F.explode(cells).alias("v"), "rep", "c", *names, "odd")
        full = full.where("n = 1").select("v", "rep", "c", *names, "odd").union(many)
        pairs = full.repartition("v").sortWithinPartitions("v").mapInArrow(lean(_across(whole, similarity)), "a long, b long").distinct()
        more = _verified(docs, classes, pairs, shingle, similarity, whole)
        group = components(group.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    joined = classes.join(group, F.col("rep") == F.col("node"), "left").select(*names, "id", F.coalesce("component", "rep").alias("g"))
    joined = joined.join(joined.groupBy("g").agg(F.min("id").alias("component_id")), "g").drop("id")
    return marked.join(joined, names).select("doc_id", "__k", "__r", "g", "component_id")


@guarded("__k", "__r", "__id", "g", "id", "rep", "odd", "v", "c", "n")
def similar_components(docs, shingle: int = 5, similarity: float = 0.8, bands: int = BANDS, bits: int = BITS, largest: int = LARGEST):
    """Documents with component_id, linked where the Jaccard similarity of their sets of word shingles is enough.

    Long SimHashes of the sets find candidates: a fingerprint of WORDS * 64 bits is cut into bands, each
    hashed with all its variants within one bit, so pairs that differ in at most two bits of some band meet.
    At a similarity of 0.8, where 15 % of the bits differ, 16 bands of 24 bits find 99.5 % of the pairs. All
    pairs of a variant are tested: those of large or dense variants in a second step, in blocks of about
    `largest` members, without the pairs that the links of the first step connect. A pair whose
    fingerprints differ by four standard deviations more than the similarity lets expect met by chance; in the
    second step odd sketches of the sets, which never differ in more places than the sets do, rule out more.
    Of all others the sets of hashed shingles are compared. Equal fingerprints are one class. Texts are treated
    as by simhash_components, and so are null and repeated ids. For much more than 10**8 documents take more
    bits and words.
    """
    docs = without(docs, "component_id")
    ids = _search(docs, shingle, similarity, bands, bits, largest).select(F.col("doc_id").alias("__id"), "__k", "component_id").dropDuplicates(["__id", "__k"])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__k"))
    return docs.join(ids, same).drop("__id", "__k")


@guarded("__k", "__r", "__id", "g", "id", "rep", "odd", "v", "c", "n")
def drop_similar(docs, shingle: int = 5, similarity: float = 0.8):
    """One row of docs for each group of similar_components: the smallest by doc_id (null last), text key and row key.

    Rows that are equal in all columns count as one; so do rows with one doc_id, whatever their texts.
    """
    found = _search(docs, shingle, similarity, BANDS, BITS, LARGEST)
    first = found.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__k", "__r")).alias("first")).select("first.__r")
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.withColumn("__r", row).join(first, "__r").dropDuplicates(["__r"]).select(*[f"`{c}`" for c in docs.columns])


def op6_simhash_near_dedup(spark, sf_dir):
    """Per document: its 3-word SimHash in hex and the component of fingerprints within two bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = simhash_components(docs, 3, 2, short=True)
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
