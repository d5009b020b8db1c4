"""Line dedup: lines whose normalised form stands in several documents stay in the first of them only."""

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import guarded, lean, materialize, raw, without

#: Keys in more documents than this are dealt to several partitions when lines meet their verdict; of
#: these only the HOT_KEYS commonest are broadcast, which bounds the rest to 1/HOT_KEYS of all lines each.
SALT_ROWS, HOT_KEYS = 4096, 4096
_STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The normalised line: ASCII white space stripped at both ends, A-Z lower-cased."""
    return line.strip(_STRIP).lower()


def _lines(least: int):
    """Exploded lines of documents: key hash, document, row and position; keys under `least` code points stay out."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), strict=True):
                for at, line in enumerate((text or b"").split(b"\n")):
                    key = line_key(line)
                    if len(key) >= least and (len(key) >= 4 * least or len(key.decode(errors="replace")) >= least):
                        for column, value in zip(out, (xxhash.xxh3_128_digest(key), doc, row, at), strict=True):
                            column.append(value)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["h", "doc_id", "row", "at"])

    return run


def _join(place: int, drop: int):
    def run(batches):
        for batch in batches:
            text, total, gone = [], [], []
            for t, d in zip(raw(batch.column(place)), batch.column(drop).to_pylist(), strict=True):
                lines = (t or b"").split(b"\n")
                dropped = set(d or ())
                text.append(b"\n".join(line for i, line in enumerate(lines) if i not in dropped) if dropped else t or b"")
                total.append(len(lines))
                gone.append(len(dropped))
            rest = [i for i in range(batch.num_columns) if i not in (place, drop)]
            yield pa.record_batch([*[batch.column(i) for i in rest], pa.array(text, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*[batch.schema.names[i] for i in rest], "kept_text", "n_lines", "n_dropped"])

    return run


@guarded("__row", "__drop", "__id", "row", "h", "at", "salt", "salts", "first")
def dedup_lines(docs, least: int = 10, documents: int = 2):
    """Documents with kept_text, n_lines and n_dropped (their own text column is left out).

    Text is split at line feeds; null or empty text is one empty line. Keys of at least `least` code
    points in at least `documents` documents lose all lines outside the smallest doc_id that holds them,
    and keep all inside it. Keys are told apart by a 128-bit hash, rows by doc_id and a 64-bit hash. Rows that share a doc_id count as one
    document, each with its own lines; null doc_ids form one document, the smallest. Equal rows give
    equal results. Other columns pass; those named like a result are replaced.
    """
    docs = without(docs, "kept_text", "n_lines", "n_dropped")
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    row = F.xxhash64("doc_id", "text")
    lines = docs.select(rank.alias("doc_id"), row.alias("row"), "text").mapInArrow(lean(_lines(least)), "h binary, doc_id long, row long, at int")
    if documents == 2:  # two documents or more: smallest and largest differ
        counts = lines.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last")
    else:
        held = lines.groupBy("h", "doc_id").agg(F.count("*").alias("n"))
        counts = held.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= documents)
    common = materialize(counts.select("h", "first", "n"))
    hot = common.where(F.col("n") > SALT_ROWS).orderBy(F.desc("n"), "h").limit(HOT_KEYS).select("h", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))
    salted = common.join(F.broadcast(hot), "h", "left").select("h", "first", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    dealt = lines.join(F.broadcast(hot), "h", "left").select("h", "doc_id", "row", "at", F.pmod("row", F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    drop = dealt.join(salted, ["h", "salt"]).where("doc_id > first").groupBy(F.col("doc_id").alias("__id"), "row").agg(F.collect_set("at").alias("__drop"))
    docs = docs.withColumn("__row", row)
    both = docs.join(drop, (F.col("__row") == F.col("row")) & (rank == F.col("__id")), "left").drop("__row", "row", "__id")
    place = both.columns.index(next(c for c in both.columns if c.lower() == "text"))
    shape = T.StructType([T.StructField(f.name, f.dataType) for i, f in enumerate(both.schema) if i != place and f.name != "__drop"])
    shape = shape.add("kept_text", "string").add("n_lines", "long").add("n_dropped", "long")
    return both.mapInArrow(lean(_join(place, both.columns.index("__drop"))), shape)


def op10_line_dedup(spark, sf_dir):
    """Per document: its lines, how many go, and the digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, 10, 2).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


#: DuckDB SQL for op10_line_dedup.
OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT k.doc_id, k.place, k.line, c.key IS NOT NULL AND k.doc_id > c.first AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
