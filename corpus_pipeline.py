"""Corpus pipeline: language ID, line dedup, near-duplicate removal, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written as Parquet and read again before the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.byte_bpe import decoded, encode, load_ranks
from tallyframe.llm.common import written
from tallyframe.llm.decontamination import find_leaks
from tallyframe.llm.language import fit_on_corpus, identify
from tallyframe.llm.line_dedup import dedup_lines
from tallyframe.llm.prefix_join import MOST_SENT, near_groups

#: A document goes when no language makes up this share of it.
LEAST_SHARE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (or null), and those in which no language has LEAST_SHARE."""
    found = identify(docs, fit_on_corpus(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten or more documents stay in the first of them alone; a document that loses all its lines goes. n_chars is renewed."""
    found = dedup_lines(docs, keep_first="doc_id")
    kept = found.where((F.col("n_dropped") == 0) | (F.trim("kept") != ""))
    renewed = {"text": F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept")), "n_chars": F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.char_length("kept").cast(docs.schema["n_chars"].dataType))}
    return kept.withColumns(renewed).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that similar pairs connect (five-word shingles, similarity 0.8 or more) the smallest id stays."""
    gone = written(near_groups(docs, width=5, percent=80).where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    few = gone.limit(MOST_SENT + 1).count() <= MOST_SENT
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():  # repeated rows
        again = kept.where("doc_id is not null").dropDuplicates(["doc_id"])
        kept = again.unionByName(kept.where("doc_id is null"))
    return kept


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("leaks") == 0).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = encode(docs, ranks, public_tokenizers.PATTERN)
    same = decoded(F.col("ids"), ranks) == F.coalesce("text", F.lit("")).cast("binary")
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("decodes"))


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("near_duplicates", near_stage), ("decontamination", leak_stage), ("byte_bpe", token_stage)]
#: SQL cannot express the mixture model, the BM25 search or the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
