"""Exact percentiles of a column too large to be gathered anywhere.

Spark's exact ``percentile`` keeps every distinct value in one task. Here the
wanted ranks are narrowed down digit by digit: count the values per leading
digit, find the digits that hold the ranks, and go on inside those only, until
so few values are left that single ones can be looked at. Each pass aggregates
before it shuffles; the driver sees two rows per percentile and pass.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

#: Binary digits told apart by each pass.
DIGIT_BITS = (20, 20)

#: With at most this many values left single ones are looked at.
FEW_VALUES = 1_000_000


def exact_percentiles(
    pool: DataFrame,
    column: str,
    percentiles: Sequence[float],
    digit_bits: Sequence[int] = DIGIT_BITS,
    few_values: int = FEW_VALUES,
) -> list[Row]:
    """Rows ``(percentile, value)``, linearly interpolated between ranks.

    Values should lie within a few units of zero, as distances do. ``pool`` is
    read once per pass; give a table, not a long computation. Percentiles of
    nothing are no rows.
    """
    values = pool.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    digits, rest = [], "x"
    for bits in digit_bits:
        # Scaling by a power of two and dropping the integer part are exact.
        digits.append(f"floor({rest} * {1 << bits}D)")
        rest = f"({rest} * {1 << bits}D - {digits[-1]})"

    keys: list[str] = []
    wanted: DataFrame | None = None
    for level, digit in enumerate([*digits, "x"]):
        name = "value" if digit == "x" else f"digit_{level}"
        found = _locate(values.withColumn(name, F.expr(digit)), keys, name, wanted, percentiles)
        if not found or name == "value":
            return _interpolated(found, percentiles)
        keys = [*keys, name]
        left = sum({tuple(r[k] for k in keys): r["rows"] for r in found}.values())
        columns = [*keys, "ordinal", "side", "rank", "share"]
        targets = pa.table({c: [r[c] for r in found] for c in columns})
        wanted = values.sparkSession.createDataFrame(targets)
        values = values.withColumn(name, F.expr(digit))
        # Two rows per percentile at most, so this side is small by construction.
        values = values.join(F.broadcast(wanted.select(*keys).distinct()), keys)
        if left <= few_values:
            found = _locate(values.withColumn("value", F.col("x")), keys, "value", wanted, percentiles)
            return _interpolated(found, percentiles)
    raise AssertionError("the last pass returns")


def _locate(
    values: DataFrame, keys: list[str], name: str, wanted: DataFrame | None, percentiles: Sequence[float]
) -> list[Row]:
    """The groups ``keys + name`` that hold the wanted ranks, with the rank of
    each inside its group."""
    counts = values.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("rows"))
    upto = Window.partitionBy(*keys).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("past", F.sum("rows").over(upto) - F.col("rows"))
    if wanted is None:
        # Percentile positions follow from the total, known here first.
        total = F.sum("rows").over(Window.partitionBy())
        counts = counts.withColumn("total", total).withColumn("t", F.expr(_targets(percentiles)))
        counts = counts.select("*", F.explode(F.expr(_INSIDE)).alias("at")).select(*keys, name, "rows", "past", "at.*")
    else:
        counts = counts.join(F.broadcast(wanted), keys).where("rank >= past AND rank < past + rows")
    return counts.select(
        *keys, name, "rows", "ordinal", "side", (F.col("rank") - F.col("past")).alias("rank"), "share"
    ).collect()


_INSIDE = "filter(t, x -> x.rank >= past AND x.rank < past + rows)"


def _targets(percentiles: Sequence[float]) -> str:
    """The two ranks each percentile lies between, and how far from the lower."""
    points = ", ".join(f"{p / 100.0!r}D" for p in percentiles)
    position = "(total - 1) * p"
    upper = f"least(floor({position}) + 1, total - 1)"
    item = "named_struct('ordinal', i, 'side', '{}', 'rank', cast({} AS bigint), 'share', {} - floor({}))"
    low = item.format("low", f"floor({position})", position, position)
    high = item.format("high", upper, position, position)
    return f"flatten(transform(array({points}), (p, i) -> array({low}, {high})))"


def _interpolated(found: list[Row], percentiles: Sequence[float]) -> list[Row]:
    ends = {(r["ordinal"], r["side"]): r for r in found}
    rows = []
    for ordinal, p in enumerate(percentiles):
        if (ordinal, "low") not in ends:
            continue
        low, high = ends[ordinal, "low"]["value"], ends[ordinal, "high"]["value"]
        share = ends[ordinal, "low"]["share"]
        step = (high - low) * share if share < 0.5 else (high - low) * (1 - share)
        rows.append(Row(percentile=float(p), value=low + step if share < 0.5 else high - step))
    return rows
