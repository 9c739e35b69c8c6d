"""A training-data pipeline over ``documents``, one operator per stage.

All stages but the last return the columns of ``documents``. Rows without an id and
rows repeated with one id are fine at every stage; deduplication keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import seamline as sl
from seamline.llm import quality
from seamline.llm.minhash import without_near_duplicates
from seamline.llm.mixing import mix
from seamline.llm.packing import pack, pieces, unsqueezed
from seamline.llm.pii import replace_entities
from seamline.llm.queries import SURROGATE_KEY, tokenizer_path
from seamline.storage import store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(_whole(docs, "doc_id", "text", "lang"), labels, keep=["row"]).where("kept").select("row.*")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, null ids last.

    Groups are made by texts alone, so rows that share or lack an id are told apart.
    """
    return without_near_duplicates(docs)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data, and their new lengths."""
    replaced = replace_entities(docs, SURROGATE_KEY)
    return replaced.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mix(_whole(docs, "doc_id", "text", "source"), keep=["row"])
    times = F.when(F.col("_mix.size") > 0, F.expr("_mix.taken div _mix.size")).otherwise(0).cast("int")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of the mixed documents in pieces, and their places in the sequences."""
    return unsqueezed(pack(pieces(docs, tokenizer_path(), squeeze=True)))


def _whole(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows as one column ``row`` beside the named ones, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def _shipped(stage):
    """The stage, with the package known to the workers."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sl.ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    (stage.__name__, _shipped(stage))
    for stage in (quality_rules, minhash_near_dedup, pii_surrogates, source_mix, best_fit_packing)
]

#: Surrogates, packing and thresholds are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
