"""A corpus pipeline of five stages, each an operator of modcall.llm over all that its predecessor kept."""

import public_tokenizers
from pyspark.sql import functions as F

from modcall.llm.common import materialize
from modcall.llm.language_id import identify_language
from modcall.llm.line_dedup import dedup_lines
from modcall.llm.packing import pack
from modcall.llm.simhash import drop_similar
from modcall.llm.substring_dedup import dedup_substrings
from modcall.session import ship


def _documents(rows, docs):
    """The columns of documents, in their order, with the text that a stage kept."""
    text = F.col("kept_text").alias("text")
    return rows.select(*[text if c == "text" else F.length("kept_text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def language(spark, docs, sf_dir):
    """Documents whose language can be told stay: those that are null or have no letter go."""
    ship(spark)
    return identify_language(docs).where("lang_pred <> 'und'").select(*[f"`{c}`" for c in docs.columns])


def lines(spark, docs, sf_dir):
    """Lines that stand in several documents stay in the first only."""
    ship(spark)
    return _documents(dedup_lines(docs), docs)


def near_copies(spark, docs, sf_dir):
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, one row stays: the smallest by
    id (null last), text key and row key. Rows with one id are linked, and all texts without words are one group."""
    ship(spark)
    return drop_similar(docs, 5, 0.8)


def passages(spark, docs, sf_dir):
    """Words in 20-word windows that started earlier in the corpus go."""
    ship(spark)
    return _documents(dedup_substrings(docs, 20, rejoin=False), docs)


def packing(spark, docs, sf_dir):
    """The tokens that are left, packed into sequences of 4096: a row per piece."""
    ship(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("substring_dedup", passages), ("best_fit_packing", packing)]

#: Language identification, SimHash and packing have no SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages in order over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
