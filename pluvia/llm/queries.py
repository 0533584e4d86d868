"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.llm.common import held_out, small_batches, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pluvia.llm.token_files import read_token_files, write_token_files

    files = write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pluvia.llm.packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "n_loss")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pluvia.llm.token_counts import count_tokens

    counts = count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op6_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pluvia.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op2_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pluvia.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.filter(~held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_mixture_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pluvia.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_langs")


@query
def op9_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pluvia.llm.quality_rules import judge

    rows = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "kept", "badness", "cutoff")


@query
def op7_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pluvia.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_pruned_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pluvia.llm.vector_graph import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op10_suffix_array_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pluvia.llm.repeats import remove_repeats

    rows = remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pluvia.llm.alignment import align_tokenizers

    docs = table(spark, sf_dir, "documents")
    rows, _ = align_tokenizers(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pluvia.llm.conversations import damaged, digests, repair

    return digests(repair(damaged(table(spark, sf_dir, "conversations"))))


@query
def op13_diagonal_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pluvia.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents")).drop("spans")


def quality_sql() -> str:
    """The quality rules in SQL: counts, certified cutoffs by language, verdicts."""
    from pluvia.llm.quality_rules import GRID, LIMITS

    blank = r"[\x09-\x0D\x20]"
    grid = ", ".join(f"({c})" for c in GRID)
    shares = {"symbols": "n_symbols / GREATEST(word_chars, 1)", "capitals": "n_capitals / GREATEST(word_chars, 1)",
              "lines": "n_dup_lines / GREATEST(n_lines, 1)", "repeats": "n_repeat_words / GREATEST(n_words, 1)"}
    badness = "GREATEST(" + ", ".join(f"{shares[k]} / CAST({v} AS DOUBLE)" for k, v in LIMITS.items()) + ")"
    return rf"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text, lang FROM documents),
w AS (SELECT doc_id, lang, text, LIST_FILTER(REGEXP_SPLIT_TO_ARRAY(text, '{blank}+'), LAMBDA x: x <> '') AS ws,
  LIST_FILTER(STRING_SPLIT(text, CHR(10)), LAMBDA x: REGEXP_MATCHES(x, '[^\x09-\x0D\x20]')) AS ls FROM d),
win AS (SELECT doc_id, i, ARRAY_TO_STRING(LIST_SLICE(ws, i, i + 7), ' ') AS g
  FROM (SELECT doc_id, ws, UNNEST(GENERATE_SERIES(1, LEN(ws) - 7)) AS i FROM w WHERE LEN(ws) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, COUNT(DISTINCT k) AS n FROM (SELECT doc_id, UNNEST(GENERATE_SERIES(i, i + 7)) AS k FROM rep) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, CAST(LEN(ws) AS BIGINT) AS n_words, CAST(LENGTH(ARRAY_TO_STRING(ws, '')) AS BIGINT) AS word_chars,
  CAST(LENGTH(text) - LENGTH(REGEXP_REPLACE(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(LENGTH(text) - LENGTH(REGEXP_REPLACE(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals, LEN(ls) AS n_lines,
  CAST(LEN(ls) - LEN(LIST_DISTINCT(ls)) AS BIGINT) AS n_dup_lines, COALESCE(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
f AS (SELECT *, {badness} AS badness, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
h AS (SELECT lang, badness FROM f JOIN labels ON labels.doc_id = f.doc_id WHERE quality = 1 AND NOT base_failed),
g AS (SELECT CAST(cutoff AS DOUBLE) AS cutoff FROM (VALUES {grid}) v(cutoff)),
t AS (SELECT lang, cutoff, COUNT(*) AS n, COUNT(*) FILTER (badness > cutoff) AS k FROM h CROSS JOIN g GROUP BY lang, cutoff),
p AS (SELECT lang, cutoff, n, k, (SELECT COUNT(*) FROM (SELECT DISTINCT lang FROM h)) AS strata,
  CASE WHEN k < n * 0.01 THEN LEAST(1.0, LIST_SUM(LIST_TRANSFORM(GENERATE_SERIES(0, k), LAMBDA j: EXP(
    LGAMMA(n + 1) - LGAMMA(j + 1) - LGAMMA(n - j + 1) + j * LN(0.01) + (n - j) * LN(0.99))))) ELSE 1.0 END AS p FROM t),
b AS (SELECT lang, MIN(cutoff) AS cutoff FROM p WHERE p * {len(GRID)} * strata <= 0.05 GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT COALESCE(badness > cutoff, FALSE) AS kept, badness, cutoff
FROM f LEFT JOIN b ON b.lang IS NOT DISTINCT FROM f.lang"""


ORACLES["op9_risk_controlled_quality"] = quality_sql()


def license_sql() -> str:
    from pluvia.llm.licenses import scan_sql

    return scan_sql()


ORACLES["op13_diagonal_license_scan"] = license_sql()
