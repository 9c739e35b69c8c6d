"""Checks of turn tables and label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions.encoders import Encoder
from seamline.functions.vectors import problem, problem_by_batch
from seamline.storage import store


def invalid_embeddings(
    turns: DataFrame, dim: int | None = None, *, encoder: Encoder | None = None, engine: str = "arrow"
) -> DataFrame:
    """The rows that cannot be scored, with the ``reason``. With an encoder the
    vectors are those of ``text``."""
    vector = F.col("embedding") if encoder is None else encoder(F.col("text"))
    find = problem_by_batch if engine == "arrow" else problem
    return turns.withColumn("reason", find(vector, dim)).where("reason IS NOT NULL")


def set_aside(
    turns: DataFrame, dim: int | None = None, *, encoder: Encoder | None = None, engine: str = "arrow"
) -> tuple[DataFrame, DataFrame]:
    """The turns that can be scored, and ``(conv_id, turn, reason)`` of the others.

    The keys of the unfit rows are written once; what follows then tells the fit
    rows by key, without reading or making a vector. Leaving rows out makes gaps
    in ``turn``, which ``segment`` closes.
    """
    found = invalid_embeddings(turns, dim, encoder=encoder, engine=engine)
    invalid = store(found.select("conv_id", "turn", "reason"), "invalid")
    return turns.join(invalid.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti"), invalid


def mixed_dimensions(turns: DataFrame) -> DataFrame:
    """Dialogues whose vectors have no columns or differ in length."""
    return (
        turns.groupBy("conv_id")
        .agg(F.min(F.size("embedding")).alias("shortest"), F.max(F.size("embedding")).alias("longest"))
        .where("shortest < 1 OR shortest <> longest")
    )


def paired_labels(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold and predicted labels side by side; a side without a partner is null.

    The join key is the single turn, so a long dialogue spreads over all tasks.
    """
    return gold.select("conv_id", "turn", F.col("label").alias("gold")).join(
        pred.select("conv_id", "turn", F.col("label").alias("pred")), ["conv_id", "turn"], "full"
    )


def unpaired(preds: list[str]) -> Column:
    """True where one side has a turn the other lacks."""
    return F.expr(" OR ".join(f"{c} IS NULL" for c in ["gold", *preds]))


def not_binary(preds: list[str]) -> Column:
    """True where a label is there and neither 0 nor 1."""
    return F.expr(" OR ".join(f"coalesce({c} NOT IN (0, 1), false)" for c in ["gold", *preds]))


def label_violations(pairs: DataFrame) -> DataFrame:
    """Dialogues that cannot be evaluated, with what is wrong with them.

    ``bad_labels`` counts turns labelled other than 0 or 1 and ``unpaired``
    turns only one side has; a dialogue of fewer than two turns is reported too.
    """
    return (
        pairs.groupBy("conv_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(not_binary(["pred"])).alias("bad_labels"),
            F.count_if(unpaired(["pred"])).alias("unpaired"),
        )
        .where("n < 2 OR bad_labels > 0 OR unpaired > 0")
    )
