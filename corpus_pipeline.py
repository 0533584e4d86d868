"""Corpus pipeline: documents pass two filters, near-duplicates and repeats go, the rest is packed into sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return rows with the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.functions.storage import materialise
from pluvia.llm import langid, packing, repeats, simhash, toxicity
from pluvia.llm.common import held_out, small_batches, table
from pluvia.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.3 or more go."""
    small_batches(spark)
    model = toxicity.train(docs.filter(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs.select(COLUMNS), model, limit=0.3)


def drop_without_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose main language has less than half of the text."""
    small_batches(spark)
    model = langid.train(docs.filter(~held_out(F.col("doc_id"))))
    return langid.with_language(docs.select(COLUMNS), model, least=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    small_batches(spark)
    return simhash.one_of_each(docs.select(COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 that occur twice go; a character that is cut becomes the replacement character."""
    small_batches(spark)
    cut = repeats.remove_repeats(docs, length=200, others=("lang", "source"))
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return cut.select("doc_id", text.alias("text"), "row.lang", "row.source", F.length(text).cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in sequences."""
    small_batches(spark)
    pieces = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "n_loss")


STAGES = [
    ("toxicity", drop_toxic), ("language", drop_without_language), ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats), ("packing", pack),
]

#: Models, suffix sorting and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again as the next one's input."""
    rows = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        rows = materialise(stage(spark, rows, sf_dir))
    return rows
