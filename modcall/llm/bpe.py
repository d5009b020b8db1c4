"""Byte-pair encoding and decoding with a public tokenizer's file, by a pair occurrence index.

Texts fall apart into pre-tokens on arrays of code points. The distinct ones that a batch adds are laid out in
one symbol array. An index maps every mergeable pair to all its positions; active ranks are applied in
ascending order, each to all of its positions at once, and the lists of the pairs that a merge creates are
extended. Pre-tokens seen before come from a bounded cache.
"""

import functools
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, mix, place_of, without

#: White space as the tokenizers' patterns mean it; Python's own also holds 0x1C to 0x1F.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Distinct pre-tokens and symbols that a worker keeps between batches.
CACHE_WORDS, CACHE_SYMBOLS = 1 << 18, 1 << 22
#: Characters that are split together; a longer text is cut at white space, where no pre-token reaches across.
BLOCK = 1 << 20
#: Classes of code points.
SPACES, LETTER, NUMBER, OTHER = range(4)


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies show for each byte: printable Latin-1 as it is, others from 0x100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or (b >= 0xA1 and b != 0xAD)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class Index:
    """Numbers of distinct 64-bit keys in arrays with open addressing; 0 is no key."""

    def __init__(self, bits: int):
        self.bits, self.key, self.number = bits, np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _start(self, keys):
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys):
        """The number of each key, -1 for unknown ones."""
        at = self._start(keys)
        got = self.key[at]
        out = np.where(got == keys, self.number[at], -1)
        left = np.flatnonzero((got != keys) & (got != 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            got = self.key[at[left]]
            hit = got == keys[left]
            out[left[hit]] = self.number[at[left[hit]]]
            left = left[~hit & (got != 0)]
        return out

    def add(self, keys, numbers):
        """Keys that are distinct and unknown; at most half of the places are used."""
        used = np.flatnonzero(self.key)
        if 2 * (len(used) + len(keys)) > len(self.key):
            old = self.key[used], self.number[used]
            self.__init__((2 * (len(used) + len(keys))).bit_length())
            self.add(*old)
        at = self._start(keys)
        while len(keys):
            free = self.key[at] == 0
            self.key[at[free]] = keys[free]
            won = self.key[at] == keys  # of several for one place the last was written
            self.number[at[won]] = numbers[won]
            keys, numbers, at = keys[~won], numbers[~won], (at[~won] + 1) & ((1 << self.bits) - 1)


class Merges:
    """Vocabulary and merge ranks of a byte-level BPE file of the tokenizers library, as arrays."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.left, self.right = (np.array([vocab[p[i]] for p in pairs], np.int32) for i in (0, 1))
        self.made = np.array([vocab["".join(p)] for p in pairs], np.int32)
        self.none = len(pairs)
        self.index = Index(max(4, len(pairs).bit_length() + 2))
        keys, first = np.unique(self._keys(self.left, self.right), return_index=True)
        self.index.add(keys, first.astype(np.int32))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]

    @staticmethod
    def _keys(a, b):
        """Pairs of symbols as keys: an odd factor keeps them distinct and spreads them."""
        return ((a.astype(np.uint64) + np.uint64(1)) << np.uint64(32) | b.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)

    def ranks(self, a, b):
        """Rank of each pair of symbols; `none` where they do not merge."""
        got = self.index.find(self._keys(a, b))
        return np.where(got < 0, self.none, got)

    def symbols(self, flat, size):
        """Bytes of words of these lengths (at least 1 each) as symbols in one array."""
        sym, end = self.inner[flat], np.cumsum(size) - 1
        sym[end] = self.last[flat[end]]
        return sym


_loaded: dict = {}


def load(path: str, kind=Merges):
    if (path, kind) not in _loaded:
        _loaded[path, kind] = kind(path)
    return _loaded[path, kind]


def every_other(p, follows):
    """Of sorted places, those kept if a kept one uses up its successor; follows: p[i + 1] is next to p[i]."""
    start = np.flatnonzero(np.append(True, ~follows))  # of runs
    return (np.arange(len(p)) - np.repeat(start, np.diff(np.append(start, len(p))))) % 2 == 0


def encode_words(merges: Merges, flat, size):
    """Token ids of words, given as bytes and lengths: flat, and their number for each word."""
    if not len(size):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    sym, n = merges.symbols(flat, size), len(flat)
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    end = np.cumsum(size) - 1
    nxt[end], prv[end - size + 1] = -1, -1
    index: dict[int, list] = {}
    active: list[int] = []

    def add(places):
        rank = merges.ranks(sym[places], sym[nxt[places]])
        some = np.flatnonzero(rank < merges.none)
        if not len(some):
            return
        places, rank = places[some], rank[some]
        order = np.argsort(rank, kind="stable")
        places, rank = places[order], rank[order]
        head = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
        for i, r in enumerate(rank[head[:-1]].tolist()):
            part = places[head[i] : head[i + 1]]
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                heapq.heappush(active, r)

    add(np.flatnonzero(nxt >= 0))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        p = np.sort(lists[0] if len(lists) == 1 else np.concatenate(lists))
        p = p[np.append(True, p[1:] != p[:-1])] if len(lists) > 1 else p
        p = p[(sym[p] == merges.left[r]) & (nxt[p] >= 0)]
        p = p[sym[nxt[p]] == merges.right[r]]
        if not len(p):
            continue
        if merges.left[r] == merges.right[r]:
            p = p[every_other(p, nxt[p[:-1]] == p[1:])]
        gone = nxt[p]
        after = nxt[gone]
        sym[p], sym[gone], nxt[p] = merges.made[r], -1, after
        right = after >= 0
        prv[after[right]] = p[right]
        left = prv[p]
        some = left >= 0
        some[1:] &= left[1:] != p[:-1]  # those are among p
        add(np.concatenate([left[some], p[right]]))
    alive = sym >= 0
    return sym[alive], np.add.reduceat(alive, end - size + 1, dtype=np.int64)


_class: list = []


def classes(points):
    """Class of each code point: white space, letter, number or other."""
    if not _class:
        table = np.full(0x110000, OTHER, np.uint8)
        for first, last in ((0, 0xD800), (0xE000, 0x110000)):
            every = "".join(map(chr, range(first, last)))
            for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACES, f"[{WHITE}]+")):
                for m in regex.finditer(pattern, every):
                    table[first + m.start() : first + m.end()] = kind
        _class.append(table)
    return _class[0][points]


_word_class: list = []


def word_classes(points):
    """The same for a pattern that the tokenizers library splits by. Its tables are of another Unicode version, so code
    points that Python does not know, but classes() takes for letters or numbers, are put to it."""
    if not _word_class:
        from tokenizers import Regex, pre_tokenizers

        table = classes(np.arange(0x110000)).copy()
        asked = [c for c in np.flatnonzero((table == LETTER) | (table == NUMBER)).tolist() if unicodedata.category(chr(c)) == "Cn"]
        split = pre_tokenizers.Split(Regex(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), "removed", invert=True)
        begins = {begin for _, (begin, _) in split.pre_tokenize_str(" ".join(f"a{chr(c)}{chr(c)}a" for c in asked))}
        for i, c in enumerate(asked):
            table[c] = LETTER if 5 * i + 1 not in begins else NUMBER if 5 * i + 2 in begins else OTHER
        _word_class.append(table)
    return _word_class[0][points]


@functools.cache
def newer_lower():
    """A pattern of the capitals that the tokenizers library knows and Python does not, and what becomes of them."""
    from tokenizers import normalizers

    small = normalizers.Lowercase()
    letters = [chr(c) for c in np.flatnonzero(classes(np.arange(0x110000)) == LETTER).tolist() if unicodedata.category(chr(c)) == "Cn"]
    found = {c: low for c in letters if (low := small.normalize_str(c)) != c}
    return regex.compile(f"[{''.join(found)}]" if found else r"(?!)"), str.maketrans(found)


_CODE = np.random.default_rng(21).integers(0, 1 << 64, 256, np.uint64)
_STEP = 0x9E3779B97F4A7C15 | 3
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int):
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    if len(_tables[0]) < n:
        for i, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            _tables[i] = np.full(max(n, BLOCK), base, np.uint64)
            _tables[i][0] = 1
            np.multiply.accumulate(_tables[i], out=_tables[i])
    return _tables[0][:n], _tables[1][:n]


def span_hashes(flat, start, end):
    """64-bit hashes (never 0) of the byte spans [start, end) of one array, from running sums of a polynomial."""
    up, down = _powers(len(flat) + 1)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_CODE[flat] * up[:-1], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return np.maximum(h, np.uint64(1))


def contractions(cp, begin, at, classes=classes):
    """Where at (places of apostrophes that start a pre-token) one of 's 't 'm 'd 're 've 'll stands, the
    pre-token ends behind it: begin is set so in place."""
    one, two = cp[at + 1], cp[np.minimum(at + 2, len(cp) - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for found, size in ((at[short], 2), (at[long], 3)):
        begin[found + 1] = False
        begin[found[classes(cp[found + size]) == LETTER] + size] = True


class Pretokenizer(Merges):
    """Whole texts by cached pre-tokens. Subclasses say what is normalised and where pre-tokens begin and end."""

    def __init__(self, path: str):
        super().__init__(path)
        self.reset()

    def reset(self):
        self.known, self.n = Index(20), 0
        self.ids, self.first, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_new(self, flat, size):
        return encode_words(self, flat, size)

    def segments(self, texts: list):
        """Texts in parts that encode independently, as (text's number, part, id of a special token or -1)."""
        for i, text in enumerate(texts):
            if not text:
                continue
            special = self.special_pattern and "<|" in text and self.special_pattern.search(text)
            for part in self.special_pattern.split(text) if special else [text]:
                if special and part in self.special:
                    yield i, "", self.special[part]
                elif part:
                    for cut in self.cuts(self.normal(part)):
                        yield i, cut, -1

    def cuts(self, text: str):
        at = 0
        while len(text) - at > BLOCK:
            to = next((m.start() for m in self.cut.finditer(text, at + BLOCK)), len(text))
            yield text[at:to]
            at = to
        yield text[at:] if at else text

    def blocks(self, texts: list):
        held, size = [], 0
        for s in self.segments(texts):
            if held and size + len(s[1]) > BLOCK:
                yield held
                held, size = [], 0
            held.append(s)
            size += len(s[1]) + 1
        if held:
            yield held

    def _look(self, block):
        """Hashes of a block's pre-tokens, their number in each segment, and new ones: hash, bytes, length."""
        joined = "\n".join(s[1] for s in block) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        flat = np.frombuffer(joined.encode(), np.uint8)
        ends_of = np.cumsum(np.fromiter((len(s[1]) + 1 for s in block), np.int64, len(block)))
        start, end = self.spans(cp, ends_of - 1)
        many = np.diff(np.searchsorted(start, ends_of), prepend=0)
        if len(flat) > len(cp):
            wide = np.append(0, np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)))
            start, end = wide[start], wide[end]
        h = span_hashes(flat, start, end)
        new = np.flatnonzero(self.known.find(h) < 0)
        h_new, one = np.unique(h[new], return_index=True)
        start, size = start[new[one]], (end - start)[new[one]]
        first = np.cumsum(size) - size
        return h, many, (h_new, flat[np.arange(size.sum()) + np.repeat(start - first, size)], size)

    def learn(self, found):
        """Encode the new pre-tokens of several blocks."""
        h, one = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
        size = np.concatenate([f[2] for f in found])
        flat, upto = np.concatenate([f[1] for f in found]), np.append(0, np.cumsum(size))
        size, start = size[one], upto[one]
        first = np.cumsum(size) - size
        ids, count = self.encode_new(flat[np.arange(size.sum()) + np.repeat(start - first, size)], size)
        self.known.add(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)
        self.first = np.append(self.first, len(self.ids) + np.cumsum(count) - count)
        self.ids, self.count = np.append(self.ids, ids.astype(np.int32)), np.append(self.count, count)

    def slots(self, texts: list):
        """Numbers of all pre-tokens in the cache, in order (special tokens: -1 - id), and how many each text has."""
        many, out = np.zeros(len(texts), np.int64), []
        blocks = list(self.blocks(texts))
        if self.n > CACHE_WORDS or len(self.ids) > CACHE_SYMBOLS:
            self.reset()
        for i in range(0, len(blocks), 8):
            held = [self._look(b) for b in blocks[i : i + 8]]
            self.learn([f[2] for f in held])
            for b, (h, size, _) in zip(blocks[i : i + 8], held, strict=True):
                slot = self.known.find(h).astype(np.int64)
                special = np.array([s[2] for s in b])
                if (special >= 0).any():
                    at = np.flatnonzero(special >= 0)
                    slot = np.insert(slot, np.cumsum(size)[at], -1 - special[at])
                    size = size.copy()
                    size[at] += 1
                np.add.at(many, [s[0] for s in b], size)
                out.append(slot)
        return np.concatenate([np.zeros(0, np.int64), *out]), many

    def sizes(self, slot):
        """Tokens of each pre-token."""
        return np.where(slot < 0, 1, self.count[np.maximum(slot, 0)]) if len(slot) else np.zeros(0, np.int64)

    def encode(self, texts: list):
        """Token ids of all texts, flat, and the number for each text."""
        slot, many = self.slots(texts)
        size = self.sizes(slot)
        upto = np.append(0, np.cumsum(size))
        lone = np.flatnonzero(slot < 0)
        first = self.first[np.maximum(slot, 0)] if len(slot) else slot
        at = np.arange(upto[-1]) + np.repeat(first - upto[:-1], size)
        if len(lone):
            at[upto[lone]] = 0
        ids = self.ids[at] if len(self.ids) else np.zeros(len(at), np.int32)
        ids[upto[lone]] = -1 - slot[lone]
        return ids, np.diff(upto[np.append(0, np.cumsum(many))])


class WordEncoder(Pretokenizer):
    """Whole texts for a lower-casing vocabulary with word ends (NFC, lower case, white space dropped): runs of
    letters, single numbers, runs of others, and contractions."""

    cut = regex.compile(f"[{WHITE}]")

    @staticmethod
    def normal(text: str) -> str:
        text = text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        if not text.isascii() and (newer := newer_lower())[0].search(text):
            text = text.translate(newer[1])
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    @staticmethod
    def spans(cp, stops):
        """Places where pre-tokens begin and end; stops: those of the line feeds behind the segments."""
        kind = word_classes(cp)
        before = np.append(np.uint8(SPACES), kind[:-1])
        begin = (kind != SPACES) & ((kind != before) | (kind == NUMBER))
        contractions(cp, begin, np.flatnonzero((cp == ord("'")) & (before != OTHER)), word_classes)
        edge = np.flatnonzero(begin | (kind == SPACES) & (before != SPACES))
        real = np.flatnonzero(begin[edge])
        return edge[real], edge[real + 1]


def parts(texts: list, most: int = 1 << 23):
    """Index ranges of about `most` characters, so that memory does not depend on the batch."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t or "") + 1
        if held >= most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _encode(path: str, place: int):
    def run(batches):
        encoder = load(path, WordEncoder)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for a, b in parts(texts):
                ids, size = encoder.encode(texts[a:b])
                cut = batch.slice(a, b - a)
                yield pa.record_batch([*cut.columns, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(ids))], names=[*cut.schema.names, "ids"])

    return run


def _decode(path: str, place: int):
    def run(batches):
        names = np.array(load(path, WordEncoder).names, object)
        for batch in batches:
            ids = batch.column(place)
            flat, upto = np.asarray(ids.flatten()), np.append(0, np.cumsum(np.asarray(ids.value_lengths().fill_null(0))))
            at = 0
            while at < batch.num_rows:  # rows of about 2 ** 20 tokens together
                to = max(at + 1, int(np.searchsorted(upto, upto[at] + (1 << 20), "right")) - 1)
                text = [" ".join(names[flat[a:b]].tolist()) for a, b in zip(upto[at:to].tolist(), upto[at + 1 : to + 1].tolist(), strict=True)]
                yield pa.record_batch([*batch.slice(at, to - at).columns, pa.array(text, pa.string())], names=[*batch.schema.names, "decoded"])
                at = to

    return run


def _plus(df, name, kind):
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema] + [T.StructField(name, kind)])


def bpe_encode(docs, path: str, text: str = "text"):
    """docs with ids (array<int>): the whole text's tokens without added special tokens; null or empty: [].

    Special strings inside a text become their own ids, as the tokenizers library does by default.
    Repeated rows repeat; other columns pass, one named ids is replaced.
    """
    docs = without(docs, "ids")
    return docs.mapInArrow(lean(_encode(path, place_of(docs, text))), _plus(docs, "ids", T.ArrayType(T.IntegerType())))


def bpe_decode(rows, path: str, ids: str = "ids"):
    """rows with decoded (string): the tokens joined by spaces, special ones kept; null or no ids: ''."""
    rows = without(rows, "decoded")
    return rows.mapInArrow(lean(_decode(path, place_of(rows, ids))), _plus(rows, "decoded", T.StringType()))


def op2_bpe_encode_decode(spark, sf_dir):
    """Per document: number and digest of its tokens, and the digest of the text decoded from them."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = bpe_decode(bpe_encode(docs, path).drop("text"), path)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
