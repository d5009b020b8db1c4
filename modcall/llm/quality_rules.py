"""Quality rules on repetition inside a text, found in a suffix array over its words.

The suffix arrays of many texts are built together by prefix doubling on numpy arrays. Neighbouring suffixes
share a prefix. A longest-common-prefix interval is a run of suffixes that share more words with each other
than with those around it; it is a maximal repeated substring if the words before its places differ too. The
spans of all of them are united. A text passes if little of it is covered and no repeat is too long.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, lean, raw, slices, without, word_hashes

#: Words of the shortest repeat that counts; most of a text that such repeats may cover, first places
#: included; most words of a single repeat. Whole phrases that return weigh more than the base rule's short
#: windows: half of its share is enough, and a passage of some sentences should not stand twice at all.
SHORTEST, COVER, LONGEST = 10, 0.1, 30
#: Base rule: fewest words, and most percent of words in repeated five-word windows.
FEWEST, PERCENT, WINDOW = 10, 20, 5
#: The characters that the base rules call symbols.
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def suffix_array(x, own):
    """Order of all suffixes of the texts in x (own: the text of each place), which end with their text,
    by text and content, and the ranks at every doubling, from which shared lengths are read."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1]
    levels, order, step = [], None, 1
    end = np.searchsorted(own, own, "right")  # where each place's text ends
    rank = np.unique(own * np.int64(rank.max() + 1) + rank, return_inverse=True)[1].astype(np.int64)
    while True:
        levels.append(rank)
        ahead = np.arange(n) + step
        second = np.where(ahead < end, rank[np.minimum(ahead, n - 1)] + 1, 0)
        # only groups that are still tied are ordered anew
        count = np.bincount(rank, minlength=int(rank.max()) + 1)
        tied = np.flatnonzero(count[rank] > 1)
        if not len(tied) or not second[tied].any():
            break
        sub = np.lexsort((second[tied], rank[tied]))
        t = tied[sub]
        first = np.append(True, rank[t][1:] != rank[t][:-1])
        change = first | np.append(True, second[t][1:] != second[t][:-1])
        # ranks count the suffixes before a group: a tied group's members move up inside its span
        base = np.cumsum(count) - count
        head = np.flatnonzero(first)
        inside = np.arange(len(t)) - np.repeat(head, np.diff(np.append(head, len(t))))
        new = base[rank]
        starts = np.flatnonzero(change)
        new[t] = base[rank[t]] + np.repeat(inside[starts], np.diff(np.append(starts, len(t))))
        rank = new
        step *= 2
    order = np.argsort(rank, kind="stable")
    return order, levels


def shared_lengths(order, levels, own, end):
    """For neighbours in the order: the words they share from their starts, within one text (lcp[0] = 0)."""
    a, b = order[:-1].copy(), order[1:].copy()
    same = own[a] == own[b]
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        i, j = a + length, b + length
        fits = same & (i + step <= end[a]) & (j + step <= end[b])
        at = np.flatnonzero(fits)
        equal = levels[k][i[at]] == levels[k][j[at]]
        length[at[equal]] += step
    return np.append(0, length)


def intervals(lcp, least: int):
    """LCP intervals of at least `least` shared words as arrays (words, first, last place in the order), by a
    stack over the shared lengths, of which only runs that are long enough are looked at."""
    at = np.flatnonzero(lcp >= least)
    found: list[tuple] = []
    stack: list[tuple] = []
    before = -1
    for k, size in zip(at.tolist(), lcp[at].tolist(), strict=True):
        if k != before + 1:
            found += [(words, first, before) for words, first in stack]
            stack = []
        first = k - 1
        while stack and stack[-1][0] > size:
            words, first = stack.pop()
            found.append((words, first, k - 1))
        if not stack or stack[-1][0] < size:
            stack.append((size, first))
        before = k
    found += [(words, first, before) for words, first in stack]
    return np.array(found, np.int64).reshape(-1, 3).T


def repeats(h, sizes, shortest: int = SHORTEST):
    """Per text: words in repeated five-word windows; of maximal repeats of at least `shortest` words the number,
    the words that they cover and the longest."""
    out = np.zeros((4, len(sizes)), np.int64)
    n = len(h)
    if not n:
        return out
    own = np.repeat(np.arange(len(sizes)), sizes)
    end = np.cumsum(sizes)[own]
    order, levels = suffix_array(h, own)
    lcp = shared_lengths(order, levels, own, end)
    words, first, last = intervals(lcp, shortest)
    before = np.where(order > 0, h[np.maximum(order - 1, 0)], 0)
    before[(order == 0) | (own[np.maximum(order - 1, 0)] != own[order])] = 0
    changes = np.cumsum(np.append(False, before[1:] != before[:-1]))
    maximal = changes[last] > changes[first]
    text = own[order[first[maximal]]]
    out[1] = np.bincount(text, minlength=len(sizes))
    np.maximum.at(out[3], text, words[maximal])
    # the deepest interval of a suffix covers what its other intervals cover from there, and one that is not
    # maximal lies within one that is
    reach = np.maximum(lcp, np.append(lcp[1:], 0))
    longest = np.zeros(n, np.int64)
    longest[order] = reach
    for row, least, span in ((0, WINDOW, np.minimum(longest, WINDOW)), (2, shortest, longest)):
        at = np.flatnonzero(longest >= least)
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + span[at], -1)
        out[row] = np.bincount(own[np.cumsum(edge)[:n] > 0], minlength=len(sizes))
    return out


def _dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(lines) == 1:
        return 0
    some = [line for line in lines if line.strip()]
    return len(some) - len(set(some))


def _rules(place: int, shortest: int):
    def run(batches):
        for batch in batches:
            texts = raw(batch.column(place))
            parts = []
            for a, b in slices(texts):
                some = [t or b"" for t in texts[a:b]]
                h, sizes = word_hashes(some)
                flat = np.frombuffer(b"".join(some), np.uint8)
                bytes_ = np.fromiter(map(len, some), np.int64, len(some))
                cut = np.append(0, np.cumsum(bytes_))
                sums = [np.append(0, np.cumsum(x))[cut] for x in (~SPACE[flat] & ((flat & 0xC0) != 0x80), _SYMBOL[flat])]
                found = repeats(h, sizes, shortest)
                parts.append([sizes, *[np.diff(s) for s in sums], np.array([_dup_lines(t) for t in some], np.int64), *found])
            cols = [np.concatenate(p).astype(np.int64) for p in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 8
            yield pa.record_batch([*batch.columns, *map(pa.array, cols)], names=[*batch.schema.names, *_RESULTS])

    return run


_RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "n_covered", "longest_repeat"]


def quality_rules(docs, shortest: int = SHORTEST, cover: float = COVER, longest: int = LONGEST):
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_repeats, n_covered,
    longest_repeat, base_failed and kept.

    Words are runs without ASCII white space; null or empty text has none and fails. base_failed: fewer
    than 10 words, or over 20 % of them in five-word windows found twice. kept: not base_failed, maximal
    repeated substrings of `shortest` words or more (n_repeats of them) cover at most `cover` of the words,
    first places included, and none is longer than `longest` words. A repeat may overlap itself. Repeated rows repeat; other columns pass, those named
    like a result are replaced. Words are compared by a 64-bit hash within a text.
    """
    docs = without(docs, *_RESULTS, "base_failed", "kept")
    place = [c.lower() for c in docs.columns].index("text")
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema] + [T.StructField(c, T.LongType()) for c in _RESULTS])
    got = docs.mapInArrow(lean(_rules(place, shortest)), shape)
    got = got.withColumn("base_failed", (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > PERCENT * F.col("n_words")))
    return got.withColumn("kept", ~F.col("base_failed") & (F.col("n_covered") <= cover * F.col("n_words")) & (F.col("longest_repeat") <= longest))


def op9_quality_rules(spark, sf_dir):
    """Per document: word, symbol, line and repetition counts and the verdicts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).drop("text").select("doc_id", *_RESULTS[:5], "base_failed", "kept", *_RESULTS[5:])
