"""Spelling variants of a vocabulary: words one inserted, deleted or replaced letter apart, and what they are forms of.

A word is a multiset of letters and so a binary vector, a bit for each letter and occurrence. One edit changes at
most two bits. PartEnum finds all pairs within that distance by equality alone: letters are dealt into FIRST parts
of SECOND pieces each; some part has at most CHANGED // FIRST of the changed bits, so all its pieces but as many are
equal. A word's signatures are those pieces, for each part and each choice of pieces left out (of the settings that
were tried, one part of five pieces gave the fewest rows and pairs together). One edit also leaves one half of the
word as it is and changes the length by at most one, which signatures hold too, so that groups stay small. Words that
share a signature are joined and verified by edit distance. All of it is column expressions; no Python runs in the
tasks.
"""

from itertools import combinations

from pyspark.sql import functions as F

from .common import materialize

#: Bits that one edit changes at most, parts of the letters and pieces of a part.
CHANGED, FIRST, SECOND = 2, 1, 5
_LETTERS = r"[A-Za-zÀ-ÿ]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_counts(docs, least: int = 6, seldom: int = 5, noise: int | None = 199):
    """Rows (word, n): words of at least `least` letters that all texts of docs (doc_id, text) hold `seldom` times.

    Words are whole runs of letters, lower-cased from A to Z only. noise: a run whose crc32 of `<doc_id>:<run>` it
    divides loses the letter at that number modulo the run's length; a null doc_id is written as no text. A null text
    has no words; repeated rows count each time.
    """
    runs = docs.select(F.col("doc_id").cast("string").alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"{_LETTERS}{{{least},}}"), 0)).alias("run"))
    runs = runs.select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("word"))
    if noise:
        h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        runs = runs.select("word", h.alias("h"))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("word")).alias("word"))
    # one condition with n in it, which is not pushed below the counts, where it would make every word twice
    return runs.groupBy("word").agg(F.count("*").alias("n")).where(F.when(F.length("word") >= least, F.col("n")) >= seldom)


def pieces(letters):
    """The sorted letters of a word, an array, dealt into FIRST * SECOND texts, as their hashes."""

    def piece(p):
        return F.xxhash64(F.array_join(F.filter(letters, lambda c: F.ascii(c) % (FIRST * SECOND) == p), ""))

    return F.array(*map(piece, range(FIRST * SECOND)))


def halves(word):
    """Hashes of what two near words share besides letters: the longer one's length, which is a word's own or one
    more, and of so many letters, m, the first m // 2 or the last m - m // 2, one of which one edit leaves alone."""
    made = []
    for more in (0, 1):
        longer = F.length(word) + more
        half = F.shiftright(longer, 1)
        made += [F.xxhash64(F.lit("^"), longer, F.substring(word, F.lit(1), half)), F.xxhash64(F.lit("$"), longer, F.right(word, longer - half))]
    return F.array(*made)


def signatures(dealt, shared):
    """The PartEnum signatures of a word from the hashes of its pieces and of its halves, as an array."""
    made = []
    for part in range(FIRST):
        for kept in combinations(range(part * SECOND, (part + 1) * SECOND), SECOND - CHANGED // FIRST):
            number = sum(1 << p for p in kept)
            made += [F.xxhash64(F.lit(number), shared[k], *[dealt[p] for p in kept]) for k in range(4)]
    return F.array(*made)


def near_words(words):
    """Pairs (a, b), a before b, of the words of a table (word) that one edit turns into each other."""
    spread = words.select("word").repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    # in steps, so that letters are sorted and dealt once a word and not once a signature
    dealt = spread.select("word", F.array_sort(F.split("word", "")).alias("letters")).select("word", pieces(F.col("letters")).alias("pieces"), halves(F.col("word")).alias("halves"))
    signed = dealt.select("word", F.explode(signatures(F.col("pieces"), F.col("halves"))).alias("sig"))
    # merged, as a broadcast would be judged by the size of the words, not of their signatures
    a, b = signed.withColumnRenamed("word", "a").hint("merge"), signed.withColumnRenamed("word", "b")
    met = a.join(b, "sig").where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "b").distinct()


def roots(forms):
    """Rows (word, root) of a table (word, form): the end of the chain of forms, by doubling its steps.

    A form is at least `ratio` times as frequent as its word, so a chain is short and has no circle."""
    links = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = materialize(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if links.where("moved").first() is None:
            return links.select("word", "root")
        links = links.select("word", "root")


def spelling_variants(words, ratio: int = 5):
    """Per word of a table (word string, n long): word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point; n_near counts them. The form is the
    near word of the largest n (ties: smallest in code-point order) if that is at least ratio * n, else null; root
    follows forms to the last one and is the word itself without a form. Words must be distinct; rows with a null word or n are left out, and an empty table gives an empty one.
    """
    words = materialize(words.where("word is not null and n is not null").select("word", F.col("n").cast("long").alias("n")))
    pairs = materialize(near_words(words))
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    near = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    judged = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    judged = materialize(judged)
    known = roots(judged.where("form is not null"))
    return judged.join(known, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir):
    """Per word of six letters or more found five times in the documents: near words, form and root."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(word_counts(docs))


#: DuckDB SQL for op11: crc32 as a fold over bytes and bit steps (-1), near words by equal deletions.
OP11_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
several AS (SELECT doc_id, run, count(*) AS times, hex(encode(concat(doc_id, ':', run))) AS hex FROM runs GROUP BY doc_id, run),
steps AS (SELECT run, times, flatten(list_transform(range(length(hex) // 2), lambda i:
  [CAST('0x' || substr(hex, CAST(2 * i + 1 AS INT), 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS steps FROM several),
hashed AS (SELECT run, times, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), steps), lambda c, e:
  CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS h FROM steps),
counted AS (SELECT CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, times FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM counted WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
holes AS (SELECT word, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word AS word, b.word AS near FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT h.word, w.word FROM holes h JOIN words w ON h.rest = w.word UNION SELECT w.word, h.word FROM holes h JOIN words w ON h.rest = w.word),
best AS (SELECT p.word, count(*) AS n_near, min(ROW(-w.n, p.near)) AS best FROM pairs p JOIN words w ON p.near = w.word GROUP BY p.word),
judged AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 5 * w.n THEN best[2] END AS form,
  CASE WHEN -best[1] >= 5 * w.n THEN -best[1] END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, form, word AS at, form AS next FROM judged
  UNION ALL SELECT c.word, c.form, j.word, j.form FROM chain c JOIN judged j ON j.word = c.next)
SELECT j.word, j.form, c.at AS root, j.n, j.n_near, CAST(j.form_n AS BIGINT) AS form_n FROM judged j JOIN chain c ON c.word = j.word AND c.next IS NULL
"""
