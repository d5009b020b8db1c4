"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

1. Documents are tokenized, cut into pieces and written once: a piece is its place, length and checksum.
2. The histogram of lengths, at most `capacity` numbers whatever the input, goes to the driver. There the
   packing program over configurations (multisets of lengths that fit) is solved by multiplicative weights:
   phases cover the demand by configurations that a knapsack dynamic program prices, uses are rounded to
   whole sequences, and prices rise where room is wasted. No other packing takes part.
3. Pieces are numbered within their length by bucket counts and running sums, never in one task, and each
   number looks up its sequence and offset in the table of configurations.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .bpe import WordEncoder, load, parts
from .common import buckets, lean, materialize

#: Phases of multiplicative weights at most, the rate at which wasted room raises a price, the part of its
#: demand that a length gives to one configuration, and the gap to the dual bound that counts as solved.
PHASES, RATE, WIDTH, GAP = 4, 4.0, 0.5, 0.001
#: The room's values are priced anew when this part of the tokens before is left.
ANEW = 0.7


def knapsack(value, capacity: int, lengths):
    """Best total value of pieces for each room up to the capacity."""
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(1, capacity + 1):
        n = upto[room]
        best[room] = max(best[room - 1], (value[:n] + best[room - lengths[:n]]).max()) if n else best[room - 1]
    return best


def fill(count: dict, room: int, value, best, lengths, most) -> None:
    """Add pieces to a configuration (length index -> copies), each the best by its value and that of the room
    behind it, which may count on pieces that are gone; then pieces grow into the room that stays. most:
    copies of each length that there are."""
    some = np.flatnonzero(most > 0)
    size, own = lengths[some], value[some]
    while n := int(np.searchsorted(size, room, "right")):
        i = int((own[:n] + best[room - size[:n]]).argmax())
        j = int(some[i])
        if count.get(j, 0) >= most[j]:
            some, size, own = (np.delete(x, i) for x in (some, size, own))
            continue
        count[j] = count.get(j, 0) + 1
        room -= int(size[i])
    while room:
        held = np.array(list(count))
        to = np.searchsorted(size, lengths[held] + room, "right") - 1
        gain = np.where(to >= 0, size[np.maximum(to, 0)] - lengths[held], 0) if len(size) else np.zeros(1)
        k = int(gain.argmax())
        if gain[k] <= 0:
            break
        i, j = int(to[k]), int(some[to[k]])
        if count.get(j, 0) >= most[j]:
            some, size = np.delete(some, i), np.delete(size, i)
            continue
        old = int(held[k])
        count[old] -= 1
        if not count[old]:
            del count[old]
        count[j] = count.get(j, 0) + 1
        room -= int(gain[k])


def phase(lengths, demand, capacity: int, price):
    """Cover the demand once at these prices: pairs of configuration and whole uses, and a bound from below.

    The longest length that is asked for gets the best configuration that holds it, for as many sequences as
    WIDTH of the narrowest demand in it, rounded down. The dynamic program prices rooms by the lengths that
    are still asked for. A full sequence is worth at most its first value, so the demand's worth over that
    bounds all packings from below.
    """
    left, out, tokens, bound = demand.copy(), [], int(lengths @ demand), 0.0
    due = tokens
    while tokens:
        if tokens <= due:
            some = np.flatnonzero(left > 0)
            best = knapsack(price[some], capacity, lengths[some])
            bound, due = bound or price @ demand / best[capacity], int(tokens * ANEW)
        i = int(np.flatnonzero(left > 0)[-1])
        count = {i: 1}
        fill(count, capacity - int(lengths[i]), price, best, lengths, left)
        n = max(1, min(int(WIDTH * left[j]) // c for j, c in count.items()))
        for j, c in count.items():
            left[j] -= n * c
            tokens -= n * c * int(lengths[j])
        out.append((tuple(count.items()), n))
    return out, bound


def configuration_program(lengths, demand, capacity: int):
    """Configurations (tuples of length index and copies) and how many sequences look so; lengths ascend.

    Multiplicative weights on the covering constraints: each phase covers the whole demand, and the price of
    a length then grows exponentially with the room that its sequences wasted. Ends where a phase comes
    within GAP of the greatest bound; the cheapest phase counts.
    """
    price = lengths / capacity * (1 + 0.01 * lengths / capacity)  # of equal fillings the one of longer pieces
    least, bound, found = math.inf, 0.0, []
    for _ in range(PHASES if len(lengths) else 0):
        got, below = phase(lengths, demand, capacity, price)
        total, bound = sum(n for _, n in got), max(bound, below)
        if total < least:
            least, found = total, got
        if least <= max(math.ceil(bound), math.ceil(int(lengths @ demand) / capacity)) * (1 + GAP):
            break
        waste = np.zeros(len(lengths))
        for row, n in got:
            room = 1 - sum(c * int(lengths[j]) for j, c in row) / capacity
            for j, c in row:
                waste[j] += n * c * room
        price = price * np.exp(RATE * waste / demand)
    return found


def plan(lengths, demand, capacity: int):
    """Slots of all sequences: arrays (length, first number, first sequence, copies in a sequence, offset)."""
    number, sequence, slots = np.zeros(len(lengths), np.int64), 0, []
    for row, n in configuration_program(lengths, demand, capacity):
        offset = 0
        for j, c in row:
            slots.append((lengths[j], number[j], sequence, c, offset))
            number[j] += n * c
            offset += int(c * lengths[j])
        sequence += n
    return np.array(slots, np.int64).reshape(-1, 5).T


def _pieces(path: str, capacity: int, end: int):
    def run(batches):
        encoder = load(path, WordEncoder)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in parts(texts):
                ids, size = encoder.encode(texts[a:b])
                ids = np.insert(ids, np.cumsum(size), end).astype("<u4")
                size = size + 1
                many = -(-size // capacity)
                doc = np.repeat(np.arange(a, b), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * capacity
                length = np.minimum(np.repeat(size, many) - start, capacity)
                at = np.repeat(np.cumsum(size) - size, many) + start
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * x : 4 * (x + n)]) for x, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.record_batch([batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(np.array(crc, np.int64))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _place(slots):
    def run(batches):
        length, first, sequence, copies, offset = slots.value
        order = np.lexsort((first, length))
        # one ascending key for both: lengths are under 2 ** 20 and ranked first
        kinds = np.unique(length)
        base = {int(k): i for i, k in enumerate(kinds)}
        length, first, sequence, copies, offset = (x[order] for x in (length, first, sequence, copies, offset))
        begin = np.searchsorted(length, kinds)
        end = np.searchsorted(length, kinds, "right")
        for batch in batches:
            size, number = np.asarray(batch.column(3)), np.asarray(batch.column(batch.num_columns - 1))
            slot = np.zeros(len(size), np.int64)
            for k in np.unique(size):
                mine = np.flatnonzero(size == k)
                i = base[int(k)]
                slot[mine] = begin[i] + np.searchsorted(first[begin[i] : end[i]], number[mine], "right") - 1
            within = number - first[slot]
            seq = sequence[slot] + within // copies[slot]
            off = offset[slot] + within % copies[slot] * size
            yield pa.record_batch([*batch.columns[:5], pa.array(seq), pa.array(off)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs, path: str, capacity: int = 4096, end: int = 1):
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's tokens and the id `end`; null or empty text is that one token. Only
    documents of more than `capacity` tokens are cut. Repeated rows are packed each. sequence_id runs from
    0 without gaps; offsets in a sequence are gapless from 0. An empty table gives no rows. Other columns
    do not pass.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    pieces = materialize(docs.select("doc_id", "text").mapInArrow(lean(_pieces(path, capacity, end)), shape))
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets(spark, 1)))
    pieces = pieces.withColumn("__b", spread)
    counts = materialize(pieces.groupBy("length", "__b").count())
    histogram = counts.groupBy("length").agg(F.sum("count").alias("n")).orderBy("length").collect()  # at most `capacity` rows
    lengths, demand = (np.array([r[i] for r in histogram], np.int64) for i in (0, 1))
    slots = spark.sparkContext.broadcast(plan(lengths, demand, capacity))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "__b", F.coalesce(before, F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("length", "__b").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = pieces.withColumn("__n", inner).join(counts, ["length", "__b"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("__before") + F.col("__n") - 1).cast("long").alias("__number"))
    return numbered.mapInArrow(lean(_place(slots)), shape + ", sequence_id long, offset long")


def op8_best_fit_packing(spark, sf_dir):
    """All documents packed into sequences of at most 4096 tokens, a row per piece."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1)
