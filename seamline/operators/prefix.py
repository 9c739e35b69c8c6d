"""Running totals and positions over dialogues of any length.

A plain window partitioned by dialogue puts the whole dialogue in one task.
Here a dialogue is cut into chunks by its order column; a window runs inside
each chunk, and what the earlier chunks add up to is carried in by a join on
``(conv_id, chunk)``. The carries are themselves summed level by level, so no
window group below the last holds more than ``2**21`` rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.config import DEFAULT_CHUNK_TURNS
from seamline.storage import store

#: Bits of the block number folded by each carry level. With a level of 21 above blocks
#: of 14 bits the last window holds at most 2**28 rows of a dialogue of any 63-bit order.
LEVEL_BITS = (21,)

#: Bits of the raw order value that share a block while turns are numbered.
BLOCK_BITS = 14

NULL_KEY = "conv_id and turn must not be null"

_FOLD = {"sum": F.sum, "max": F.max}


def _merged(fold: str, carried_in: str, own: str) -> str:
    """SQL that puts what is carried in (null: nothing) and the own value together."""
    return f"coalesce({carried_in}, 0) + {own}" if fold == "sum" else f"greatest({carried_in}, {own})"


@dataclass(frozen=True)
class TurnProfile:
    """What the key columns of a turn table say about it."""

    dense: bool
    longest: int


def chunk_of(turn: Column, chunk_turns: int) -> Column:
    return F.call_function("div", turn, F.lit(chunk_turns))


def profile_turns(df: DataFrame) -> TurnProfile:
    """Read ``conv_id`` and ``turn`` only and report whether every dialogue is
    numbered 0..n-1, and how long the longest one is. Null keys are refused."""
    per_dialogue = df.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("turn").alias("lo"),
        F.max("turn").alias("hi"),
        F.count_if(F.col("conv_id").isNull() | F.col("turn").isNull()).alias("nulls"),
    )
    row = per_dialogue.agg(
        F.bool_and((F.col("lo") == 0) & (F.col("hi") + 1 == F.col("n"))).alias("dense"),
        F.max("n").alias("longest"),
        F.sum("nulls").alias("nulls"),
    ).first()
    if row["nulls"]:
        raise ValueError(NULL_KEY)
    return TurnProfile(dense=row["dense"] is not False, longest=row["longest"] or 0)


def dense_turns(df: DataFrame) -> tuple[DataFrame, int]:
    """Return the table with ``turn`` as the 0-based position in its dialogue,
    and the length of the longest dialogue.

    Tables that are numbered that way already, as those of ``sources`` are,
    come back unchanged.
    """
    profile = profile_turns(df)
    return (df if profile.dense else number_turns(df)), profile.longest


def number_turns(
    df: DataFrame, block_bits: int = BLOCK_BITS, level_bits: tuple[int, ...] = LEVEL_BITS
) -> DataFrame:
    """Replace ``turn`` by the row's position in its dialogue, gaps closed.

    The counts per block come from the key columns alone and are written once: they
    are few, and every level of carries is folded from them. Two rows of a dialogue
    with the same ``turn`` have no order, so they are an error, and so is a null key.
    """
    block = F.shiftright(F.col("turn"), block_bits)
    counts = store(
        df.select("conv_id", block.alias("block"))
        .groupBy("conv_id", "block")
        .agg(F.count(F.lit(1)).alias("_before")),
        "counts",
    )
    before = carried(counts, {"_before": "sum"}, level_bits).where("_before > 0")
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    position = (
        F.when(
            F.col("conv_id").isNull() | F.col("turn").isNull(), F.raise_error(F.lit(NULL_KEY)).cast("bigint")
        )
        .when(
            F.lag("turn").over(inside) == F.col("turn"),
            F.raise_error(F.lit("a dialogue has two rows with the same turn")).cast("bigint"),
        )
        .otherwise(F.row_number().over(inside) - 1)
    )
    ranked = df.withColumn("block", block).withColumn("_inside", position)
    return ranked.join(before, ["conv_id", "block"], "left").select(
        *[
            (F.col("_inside") + F.coalesce("_before", F.lit(0))).cast("bigint").alias("turn")
            if name == "turn"
            else F.col(name)
            for name in df.columns
        ]
    )


def carried(blocks: DataFrame, folds: dict[str, str], level_bits: tuple[int, ...]) -> DataFrame:
    """For rows ``(conv_id, block, values)`` fold each value over all earlier
    blocks of the dialogue. The first block of a dialogue gets null."""
    if not level_bits:
        earlier = _earlier("conv_id")
        return blocks.select(
            "conv_id", "block", *[_FOLD[f](n).over(earlier).alias(n) for n, f in folds.items()]
        )
    parent = F.shiftright(F.col("block"), level_bits[0]).alias("parent")
    above = carried(
        blocks.groupBy("conv_id", parent)
        .agg(*[_FOLD[f](n).alias(n) for n, f in folds.items()])
        .withColumnRenamed("parent", "block"),
        folds,
        level_bits[1:],
    ).select("conv_id", F.col("block").alias("parent"), *[F.col(n).alias(f"up_{n}") for n in folds])
    earlier = _earlier("conv_id", "parent")
    here = blocks.select("*", parent).select(
        "conv_id", "block", "parent", *[_FOLD[f](n).over(earlier).alias(n) for n, f in folds.items()]
    )
    return here.join(above, ["conv_id", "parent"], "left").selectExpr(
        "conv_id", "block", *[f"coalesce({_merged(f, f'up_{n}', n)}, up_{n}) AS {n}" for n, f in folds.items()]
    )


def _earlier(*keys: str):
    return Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def running(
    df: DataFrame,
    values: dict[str, tuple[str, str]],
    longest: int,
    chunk_turns: int = DEFAULT_CHUNK_TURNS,
    level_bits: tuple[int, ...] = LEVEL_BITS[:1],
    folded: bool = False,
    stored: bool = False,
) -> DataFrame:
    """Add, per dialogue in turn order, the running fold of each value.

    ``values`` maps a new column to ``("sum" | "max", SQL expression)``. ``turn``
    must be dense; the window that is there anyway also checks it. ``folded``
    says that the expressions are running folds of each chunk already, of values
    that are not negative, and that the order is checked; no window is needed.

    A table that is split is read twice, so it is written first; ``stored`` says
    that reading ``df`` twice is cheap as it is.
    """
    split = longest > chunk_turns
    folds = {n: f for n, (f, _) in values.items()}
    source = df.selectExpr("*", *[f"{sql} AS _own_{n}" for n, (_, sql) in values.items()])
    source = (store(source, "running") if split and not stored else source).selectExpr(
        "*", f"turn div {chunk_turns} AS block" if split else "0L AS block"
    )
    window = f"(PARTITION BY conv_id{', block' if split else ''} ORDER BY turn)"
    upto = window[:-1] + " ROWS UNBOUNDED PRECEDING)"
    before = f"lag(turn) OVER {window}"
    ordered = source.selectExpr(
        "*",
        "true AS _in_order"
        if folded
        else f"coalesce({before}, block * {chunk_turns} - 1) = turn - 1 AS _in_order",
        *[f"_own_{n} AS {n}" if folded else f"{f}(_own_{n}) OVER {upto} AS {n}" for n, f in folds.items()],
    )
    complaint = "bigint(raise_error('turn must number each dialogue 0..n-1; see dense_turns'))"

    def checked(value: str, name: str) -> str:
        return f"if(_in_order, {value}, {complaint}) AS {name}"

    if not split:
        return ordered.selectExpr(*df.columns, *[checked(n, n) for n in folds])
    totals = (
        source.groupBy("conv_id", "block")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            *[_FOLD["max" if folded else f](f"_own_{n}").alias(n) for n, f in folds.items()],
        )
        .where(F.col("rows") == chunk_turns)  # only a full chunk has a successor
    )
    shifted = totals.select("conv_id", (F.col("block") + 1).alias("block"), *folds)
    # A row of ``shifted`` carries the total of the chunk before it, so the fold
    # over the earlier rows and the row itself is what enters the chunk.
    past = carried(shifted, folds, level_bits).select(
        "conv_id", "block", *[F.col(n).alias(f"past_{n}") for n in folds]
    )
    entering = shifted.join(past, ["conv_id", "block"]).selectExpr(
        "conv_id", "block", *[f"{_merged(f, f'past_{n}', n)} AS in_{n}" for n, f in folds.items()]
    )
    return ordered.join(entering, ["conv_id", "block"], "left").selectExpr(
        *df.columns, *[checked(_merged(f, f"in_{n}", n), n) for n, f in folds.items()]
    )
