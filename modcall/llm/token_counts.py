"""Token counts by rank-synchronous array merging.

The distinct pre-tokens that a batch adds lie in ragged arrays. In every round each sequence applies its
pair of lowest rank, all sequences at once; sequences without a mergeable pair leave with their count.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import OTHER, SPACES, Merges, Pretokenizer, classes, contractions, every_other, load, parts
from .common import lean, place_of, without

#: Symbols that are merged together; more pre-tokens are taken in turn.
SYMBOLS = 1 << 21


def count_words(merges: Merges, flat, size):
    """The number of tokens of each word, given as bytes and lengths (at least 1 each)."""
    left = np.zeros(len(size), np.int64)
    if not len(size):
        return left
    sym = merges.symbols(flat, size)
    own = np.repeat(np.arange(len(size), dtype=np.int32), size)  # the word of each symbol
    rank = np.full(len(sym), merges.none, np.int32)  # of the pair that starts at each symbol
    inner = np.flatnonzero(own[:-1] == own[1:])
    rank[inner] = merges.ranks(sym[inner], sym[inner + 1])
    while len(sym):
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        size = np.diff(np.append(head, len(sym)))
        low = np.minimum.reduceat(rank, head)
        done = low == merges.none
        if done.any():
            left[own[head[done]]] = size[done]
            stay = np.repeat(~done, size)
            sym, own, rank, low = sym[stay], own[stay], rank[stay], np.repeat(low[~done], size[~done])
        else:
            low = np.repeat(low, size)
        if not len(sym):
            break
        at = np.flatnonzero(rank == low)
        twins = merges.left[rank[at]] == merges.right[rank[at]]
        if twins.any():  # of overlapping pairs of one symbol, the leftmost merge
            follows = (at[1:] == at[:-1] + 1) & twins[1:] & twins[:-1]
            at = at[every_other(at, follows)]
        sym[at] = merges.made[rank[at]]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        at = at - np.arange(len(at))  # one symbol goes for each merge before
        sym, own, rank = sym[keep], own[keep], rank[keep]
        fresh = np.unique(np.concatenate([at, at[at > 0] - 1]))
        rank[fresh] = merges.none
        fresh = fresh[fresh + 1 < len(sym)]
        fresh = fresh[own[fresh] == own[fresh + 1]]
        rank[fresh] = merges.ranks(sym[fresh], sym[fresh + 1])
    return left


class TokenCounter(Pretokenizer):
    """Counts of whole texts for a byte-level vocabulary: runs of letters, numbers or others with a space before
    them, contractions, and white space but for its last character where text follows."""

    cut = regex.compile(r"(?<=\p{L}) (?=\p{L})")

    @staticmethod
    def normal(text: str) -> str:
        return text

    @staticmethod
    def spans(cp, stops):
        """Places where pre-tokens begin and end; stops: those of the line feeds behind the segments."""
        stop = OTHER + 1
        kind = classes(cp)
        kind[stops] = stop
        before, after = np.append(np.uint8(stop), kind[:-1]), np.append(kind[1:], np.uint8(stop))
        begin = (kind != before) & (kind != stop)
        last = np.flatnonzero((kind == SPACES) & (after < stop) & (after != SPACES))
        begin[last] = True
        begin[last + 1] = cp[last] != ord(" ")
        contractions(cp, begin, np.flatnonzero((cp == ord("'")) & (before != OTHER) & begin))
        edge = np.flatnonzero(begin | (kind == stop))
        real = np.flatnonzero(begin[edge])
        return edge[real], edge[real + 1]

    def encode_new(self, flat, size):
        upto, counts, at = np.append(0, np.cumsum(size)), [], 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + SYMBOLS, "right")) - 1)
            counts.append(count_words(self, flat[upto[at] : upto[to]], size[at:to]))
            at = to
        return np.zeros(0, np.int32), np.concatenate(counts) if counts else np.zeros(0, np.int64)

    def counts(self, texts: list):
        slot, many = self.slots(texts)
        upto = np.append(0, np.cumsum(self.sizes(slot)))
        return np.diff(upto[np.append(0, np.cumsum(many))])


def _count(path: str, place: int):
    def run(batches):
        counter = load(path, TokenCounter)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            out = np.concatenate([np.zeros(0, np.int64), *(counter.counts(texts[a:b]) for a, b in parts(texts))])
            size = batch.column(place).cast(pa.binary())
            rest = [i for i in range(batch.num_columns) if i != place]
            yield pa.record_batch([*[batch.column(i) for i in rest], pa.compute.fill_null(pa.compute.binary_length(size), 0).cast(pa.int64()), pa.array(out)], names=[*[batch.schema.names[i] for i in rest], "n_bytes", "n_tokens"])

    return run


def token_counts(docs, path: str, limit: int = 1024, text: str = "text"):
    """docs without their text, with n_bytes, n_tokens and over_limit (n_tokens > limit) of the whole text.

    Null or empty text: 0. A special string inside a text is one token, as in the tokenizers library's
    default. Repeated rows repeat; other columns pass, those named like a result are replaced. The text
    column is found whatever its case.
    """
    docs = without(docs, "n_bytes", "n_tokens", "over_limit")
    place = place_of(docs, text)
    rest = [T.StructField(f.name, f.dataType) for i, f in enumerate(docs.schema) if i != place]
    shape = T.StructType([*rest, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.mapInArrow(lean(_count(path, place)), shape).withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark, sf_dir):
    """Per document: bytes and tokens of its text, and whether it has more than 1024 tokens."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024)
