"""A corpus pipeline of five stages over documents: each takes what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import byte_bpe, language_id, mixing, ngram_join, secrets
from barloom.llm.queries import MAX_REPETITION
from barloom.llm.shared import free_names, quoted, saved

#: Bytes that a worker of the last stage remembers, beside what the executor holds from the stages before.
REMEMBERED = 48 << 20
#: No SQL expresses the language classifier, the random field or the merges.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: null texts and those without a letter. Rows decide for themselves."""
    return language_id.keep_identified(docs, language_id.train(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies (five-word shingles, Jaccard similarity of 0.8 or more) make groups; the smallest doc_id of each stays.

    A row without a doc_id goes by a large number from its text, so it yields to any that has one. Of rows with equal
    doc_id and text one stays, if the text has a word. Rows with one doc_id and several texts are decided each by its own text; if
    they are near copies of each other, the one whose text has the smallest hash goes first. Rows are told apart by numbers given once and
    written down with them."""
    own_id, text_hash, row_key = free_names(docs, "_own_id", "_text_hash", "_row_key")
    unnamed = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.lit(5), "text"), 2)
    keyed = docs.withColumn(own_id, F.coalesce(F.col("doc_id").cast("long"), unnamed)).withColumn(text_hash, F.xxhash64("text")).withColumn(row_key, F.monotonically_increasing_id())
    keyed = saved(keyed, "keyed")
    found = ngram_join.similar_documents(keyed.select(F.col(row_key).alias("doc_id"), "text"), words=5, num=80, den=100)
    named = keyed.select(F.col(row_key).alias("key"), F.col(own_id).alias("own"), F.col(text_hash).alias("hash")).join(found.select(F.col("doc_id").alias("key"), "component_id"), "key")
    first = named.groupBy("component_id").agg(F.min(F.struct("own", "hash", "key")).alias("first"))
    stays = saved(first.select(F.col("first.key").alias(row_key)), "stays")
    # both grow with the input, so neither is ever broadcast
    return keyed.join(stays.hint("merge"), row_key, "left_semi").select(*quoted(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found by a mask; all documents stay."""
    return secrets.redact(docs, secrets.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, up to a limit; every document appears at least once."""
    return mixing.mix(docs, max_repetition=MAX_REPETITION).select(*quoted(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids), one row for each time a document is seen."""
    return byte_bpe.encode_documents(docs, remembered=REMEMBERED)


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
