"""Spelling variants against a plain version, and their edge cases."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from modcall.llm.spelling import near_words, op11_spelling_variants, spelling_variants, word_counts


def plain_counts(docs, least=6, seldom=5, noise=199):
    seen = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if noise and h % noise == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            if len(word) >= least:
                seen[word] += 1
    return {w: n for w, n in seen.items() if n >= seldom}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(rows, key=lambda r: r[0])


def rows_of(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeéÀßxyz") for _ in range(rng.randint(6, 11))) for _ in range(60)]

    def typed(word):
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            i, c = rng.randrange(len(word)), rng.choice("abcé")
            word = rng.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]])
        return word.upper() if rng.random() < 0.1 and word.isascii() else word

    few = [typed(rng.choice(base)) for _ in range(250)]
    docs = [(i, " ".join(rng.choices(few + base * 2, k=200)) + rng.choice([".", "1x", "\n"])) for i in range(60)]
    return [*docs, (None, " ".join(base * 3)), (77, None), (78, ""), (5, docs[5][1]), (79, "tiny words only " * 5), (80, "longestword" * 20_000), (81, ("abcdef " * 40_000))]


def test_variants_are_those_of_a_plain_version(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    counts = plain_counts(corpus)
    got = word_counts(docs).collect()
    assert {r.word: r.n for r in got} == counts and len(got) == len(counts) > 100
    want = plain_variants(counts)
    assert rows_of(spelling_variants(word_counts(docs))) == want
    assert any(r[1] for r in want) and any(r[2] not in (r[0], r[1]) for r in want if r[1]) or any(r[4] > 1 for r in want)


def test_the_registered_query_and_clashing_columns(spark, corpus, tmp_path):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "id", "run", "h", "sig", "form", "near")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(op11_spelling_variants(spark, str(tmp_path))) == plain_variants(plain_counts(corpus))


def test_chains_ties_and_words_at_the_edges(spark):
    counts = {"abcdef": 1000, "abcdeg": 1000, "abcdex": 100, "abcdexy": 20, "abcdexyz": 4, "bcdef": 9, "zzzzzzzz": 3, "zzzzzzzzz": 15, "aabbcc": 5, "ccbbaa": 5}
    got = rows_of(spelling_variants(spark.createDataFrame([*counts.items(), (None, 3), ("nothing", None)], "word string, n long")))
    assert got == plain_variants(counts)
    by = {r[0]: r for r in got}
    assert by["abcdex"][1] == "abcdef"  # the smaller of two with equal n
    assert by["abcdexyz"][2] == "abcdef" and by["abcdexyz"][1] == "abcdexy"
    assert by["abcdef"][1] is None and by["aabbcc"][4] == 0


def test_hubs_of_many_near_words_lose_none(spark):
    word = "transcription"
    counts = {word[:i] + c + word[i + 1 :]: 1 for i in range(len(word)) for c in "abcdefghijklmnopqrstuvwxyzéü"} | {word: 10}
    got = rows_of(spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == plain_variants(counts) and max(r[4] for r in got) == len(counts) - 1


def test_empty_tables(spark):
    assert word_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    empty = spark.createDataFrame([], "word string, n long")
    assert near_words(empty).count() == 0 and spelling_variants(empty).count() == 0
