"""The corpus pipeline: language ID, line dedup, near-dedup, mixing and packing of ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read back as the next one's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatio.llm import langid, line_dedup, mixing, order_minhash, packing
from curatio.llm.common import read_table, written
from curatio.llm.queries import DOMAIN, MIX_WEIGHTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SCORE = 0.5         # a language of lower probability is rejected


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language of which the model is reasonably sure; ``lang`` stays as given."""
    found = langid.predict(docs.select(*COLUMNS), langid.train(docs), lang_out="_lang", score_out="_score")
    return found.where((F.col("_lang") != langid.UND) & (F.col("_score") >= MIN_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated line chunks and passages; documents that lose every line go."""
    out = line_dedup.remove_repeated_chunks(docs.select(*COLUMNS), removed_col="_removed", drop_emptied=True,
                                            min_words=line_dedup.MIN_WORDS)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return order_minhash.keep_one(docs, order_minhash.near_duplicates(docs)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mix of the labelled domains takes them."""
    return mixing.apply_mix(docs.select(*COLUMNS), mixing.mix(docs, read_table(spark, sf_dir, "labels"), F.expr(DOMAIN), MIX_WEIGHTS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, end_id=2).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language), ("line_dedup", lines), ("minhash_near_dedup", near_duplicates),
    ("mixing", mix), ("packing", pack)]

#: The stages hold models and iterations, which SQL cannot express; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
