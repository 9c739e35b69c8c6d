"""Small things that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.storage import store

#: A word: a run of characters other than space and U+0009 to U+000D (fixed value).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` written once, with a broadcast hint only if it has at most ``rows`` rows."""
    written = store(df, "small")
    return F.broadcast(written) if written.count() <= rows else written


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches cut where any of ``keys`` changes, one table per run of equal keys.

    Null keys are equal to each other. What is held is one run and one batch.
    """
    open_: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows - 1, bool)
        for key in keys:
            coded = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
            changed |= coded[1:] != coded[:-1]
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
        if open_ and any(open_[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(open_)
            open_ = []
        for start, stop in zip(cuts, cuts[1:]):
            if start:
                yield pa.Table.from_batches(open_)
                open_ = []
            open_.append(batch.slice(start, stop - start))
    if open_:
        yield pa.Table.from_batches(open_)
