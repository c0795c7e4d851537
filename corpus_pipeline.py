"""From raw documents to token ids: language, exact copies, near copies, source mix, BPE.

Every stage takes the documents that its predecessor kept and returns the columns of documents; the last one returns
a row of token ids for each copy in the mix. Stages are written as Parquet and read again by the next.
Null and empty texts pass through the operators' defined results; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import discard, materialise
from marginalia.llm.exact_dedup import deduplicated
from marginalia.llm.language_id import UNKNOWN, annotate, train
from marginalia.llm.mixing import mix_sources
from marginalia.llm.ngram_join import BROADCAST_IDS, similar_documents
from marginalia.llm.queries import digests, tokenizer_path
from marginalia.llm.bpe_lexicon import encode_texts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents are rejected without a letter, and when they score below this share of what even votes of the learned families
#: and languages give to a text in their letters: no text in known letters goes, a text in a foreign script does.
LEAST_CHANCE = 0.8
#: Near copies: words of a shingle, and percent of shingles in common.
NEAR_WORDS, NEAR_PERCENT = 5, 80
TOKENIZER = "word_bpe_49k.json"


#: Rows of an Arrow batch: executors hold a few batches of whole texts beside their heap, so they are kept small.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(stage):
    """A stage whose Arrow batches are small, whatever the session had; its result is lazy, so run() puts the setting back."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; a null lang is filled with the prediction."""
    model = train(docs)
    least = LEAST_CHANCE * (model.chance if model else 0.0)
    found = annotate(docs.select(*COLUMNS), model)
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return deduplicated(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the least id."""
    docs = docs.select(*COLUMNS)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"))
    if ids.groupBy("i").count().filter("count > 1").isEmpty():
        key = "doc_id"
    else:  # ids repeat: rows get numbers of their own
        key, docs = "__key", materialise(docs.withColumn("__key", F.monotonically_increasing_id()), "numbered")
    found = similar_documents(docs, id_col=key, words=NEAR_WORDS, percent=NEAR_PERCENT)
    gone = materialise(found.filter(~F.col(key).eqNullSafe(F.col("component_id"))).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__gone")), "near-copies")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, F.coalesce(docs[key].cast("string"), F.lit("")) == F.col("__gone"), "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources replicated to equal shares of the characters, shuffled."""
    return mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their count and digests of ids and decoded text."""
    encoded = encode_texts(docs, tokenizer_path(TOKENIZER))
    return digests(encoded, "doc_id", "token_ids")


STAGES = [(name, bounded(f)) for name, f in (("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix), ("bpe_codec", tokenise))]

#: SQL cannot express the trained language model, so the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    had = spark.conf.get(BATCH_SETTING)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for name, stage in STAGES:
            kept = materialise(stage(spark, docs, sf_dir), name)
            discard(docs)
            docs = kept
    finally:
        spark.conf.set(BATCH_SETTING, had)
    return docs
