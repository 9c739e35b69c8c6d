"""Sessions, each a list of exchange strings."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def turns_from_arrays(sessions: DataFrame, key: str = "session_id", exchanges: str = "exchanges") -> DataFrame:
    """Turns of a table with one array of texts per row. Empty sessions have no
    turns and so take no part."""
    return sessions.select(
        F.col(key).alias("conv_id"), F.posexplode(exchanges).alias("turn", "text")
    ).withColumn("turn", F.col("turn").cast("bigint"))


def turns_from_sessions(spark: SparkSession, sessions: Iterable[Sequence[str]]) -> DataFrame:
    """Turns of sessions held by the caller; ``conv_id`` is their position."""
    rows = [(i, list(s)) for i, s in enumerate(sessions)]
    return turns_from_arrays(spark.createDataFrame(rows, "session_id bigint, exchanges array<string>"))
