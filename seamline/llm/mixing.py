"""Mixing sources to target weights by weighted fair queueing.

Every source shuffles its documents and, if its target needs it, goes through them a
second time. A document's virtual finish time is its source's running total of words
divided by the source's target, so all sources reach their targets at time 1. The
documents of all sources are then put in the order of their finish times, by ranges
of virtual time, and the order is cut where it reaches the total budget.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm.common import WORD, if_small, text_of
from seamline.storage import store

#: Leading hex digits of the shuffle key that divide a source into parts.
_PART_DIGITS = 3
#: Tasks that rows of one source, id and text are dealt to.
_SALTS = 256
#: Ranges that a unit of virtual time is divided into.
_SLOTS = 4096


@dataclass(frozen=True)
class Mix:
    """Parameters.

    ``weights``  weights of the sources by code point, null last, repeating
    ``share``    words of the mix as a multiple of all words
    ``repeats``  how often a document may be taken: a source's target never exceeds
                 this multiple of its size
    ``seed``     of the shuffle
    """

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    repeats: int = 2
    seed: str = "mix"


def targets(sizes: DataFrame, config: Mix = Mix()) -> DataFrame:
    """``sizes`` (``source``, ``source_size``) with ``place`` and ``target`` of each source.

    Targets share ``share`` times all words by weight; what a source cannot use at its
    limit goes to the others by weight. Sorted by limit per weight, the sources at
    their limit come first, and the common level of the others is the largest of the
    levels that the budget would give if just the sources before were at theirs. The
    windows run over one row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*map(F.lit, config.weights))
    limited = sizes.withColumn("place", place).select(
        "source",
        "source_size",
        "place",
        weights[(F.col("place") - 1) % len(config.weights)].alias("weight"),
        (F.col("source_size") * F.lit(float(config.repeats))).alias("limit"),
    )
    everything = Window.partitionBy()
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(config.share)
    level = (budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = limited.withColumn("level", level)
    target = F.least("limit", F.col("weight") * F.max("level").over(everything))
    return levelled.select("source", "source_size", "place", target.alias("target"))


def mix(
    docs: DataFrame,
    config: Mix = Mix(),
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` and a struct ``_mix`` (``size``, ``source_size``, ``target``, ``taken``).

    ``size`` counts the words of the whole text, 0 for null. ``taken`` is ``size`` times
    the number of times the mix takes the document, from 0 to ``repeats``; documents
    are taken whole, so a source misses its target by less than a few documents. The
    order within a source is that of md5 of seed, id and text; rows with one id and text
    follow one another, and the mix may end between them, so a source whose rows share an
    id or have none is mixed like any other. A null id counts as one id, a null source as
    a source. Up to the choice among rows of one source, id and text, the result depends
    on the rows alone, not on their order or partitions. An empty table gives an empty
    result; sources without a word have target 0.
    """
    keep = [id_column] if keep is None else keep
    id_ = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("null"))
    text = text_of(F.col(f"`{text_column}`").cast("string"))
    name = F.concat(F.lit(f"{config.seed}:"), id_, F.lit(":"), F.md5(text.cast("binary")))
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.col(f"`{source_column}`").alias("source"),
        F.md5(name.cast("binary")).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
    ).withColumn("part", F.substring("key", 1, _PART_DIGITS))
    # Written with a number per row: whatever is read again later has the same numbers.
    numbered = sized.withColumn("spot", F.monotonically_increasing_id())
    rows = store(numbered.withColumn("salt", F.pmod(F.xxhash64("spot"), F.lit(_SALTS))), "sized")
    cell = ["source", "part", "key", "salt"]
    cells = rows.groupBy(cell).agg(F.sum("size").alias("cell_size"))
    parts = store(cells.groupBy("source", "part").agg(F.sum("cell_size").alias("part_size")), "parts")
    sizes = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    sources = if_small(targets(sizes, config).withColumnRenamed("source", "of"), 10_000)
    # Running totals in three levels: parts of a source, cells of a part, rows of a cell.
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)))
    starts = parts.join(sources, parts["source"].eqNullSafe(sources["of"])).select(
        "of", F.col("part").alias("p"), "ahead", "source_size", "target", "place"
    )
    starts = if_small(starts, 200_000)
    before = Window.partitionBy("source", "part").orderBy("key", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("cell_size").over(before), F.lit(0)))
    cells = cells.join(starts, cells["source"].eqNullSafe(starts["of"]) & (cells["part"] == starts["p"])).select(
        "of", F.col("key").alias("k"), F.col("salt").alias("s"), "source_size", "target", "place",
        (F.col("ahead") + F.col("before")).alias("ahead"),
    )
    same = rows["source"].eqNullSafe(cells["of"]) & (rows["key"] == cells["k"]) & (rows["salt"] == cells["s"])
    within = Window.partitionBy("source", "key", "salt").orderBy("spot")
    # Without the rows themselves: only numbers and keys are dealt out and put in order.
    timed = store(
        rows.drop("row")
        .join(cells, same)
        .withColumn("total", F.col("ahead") + F.sum("size").over(within))
        .select("size", "source_size", "target", "place", "key", "salt", "spot", "total"),
        "timed",
    )
    last = _last_taken(timed, config)
    # Through a source the queue goes as its rows lie, so each round ends at one of its rows.
    at = F.struct("key", "salt", "spot")
    ends = [F.max(F.when(_taken(r, last), at)).alias(f"end_{r}") for r in range(config.repeats)]
    ended = if_small(sources.join(timed.groupBy("place").agg(*ends), "place"), 200_000)
    takes = sum((F.when(at <= F.col(f"end_{r}"), 1).otherwise(0) for r in range(config.repeats)), F.lit(0))
    outcome = F.struct("size", "source_size", "target", (F.col("size") * takes).alias("taken"))
    return rows.join(ended, rows["source"].eqNullSafe(ended["of"])).select("row.*", outcome.alias("_mix"))


def _finish(round_: int) -> Column:
    """Virtual finish time of a document in the given round through its source."""
    total = F.col("source_size") * round_ + F.col("total")
    return F.when(F.col("target") > 0, total / F.col("target")).otherwise(0.0)


def _order(round_: int) -> Column:
    """Place in the queue: rows of one key follow one another by their running totals."""
    return F.struct(
        _finish(round_).alias("finish"), F.col("place").alias("place"), F.lit(round_).alias("round"), "key", "total"
    )


def _last_taken(timed: DataFrame, config: Mix) -> tuple | None:
    """Place in the order of the last document within the budget.

    Totals per range of virtual time say which range the cut falls into; only that
    range, one in thousands, is put in order. All targets together are the budget and
    every source reaches its own at time 1, so the cut lies there, but for the share of
    a document per source by which sources overshoot; what comes after time 2 is one slot.
    """
    turns = timed.select("size", F.explode(F.array(*[_order(r) for r in range(config.repeats)])).alias("turn"))
    turns = turns.withColumn("slot", F.floor(F.least(F.col("turn.finish"), F.lit(2.0)) * _SLOTS))
    slots = store(turns.groupBy("slot").agg(F.sum("size").alias("slot_size")), "slots")
    # Each document is in as many rounds as may be taken.
    everything = slots.agg(F.sum("slot_size")).first()[0]
    if everything is None:
        return None
    budget = everything / config.repeats * config.share
    so_far = F.sum("slot_size").over(Window.orderBy("slot"))
    cut = slots.withColumn("so_far", so_far).where(F.col("so_far") > F.lit(budget)).orderBy("slot").first()
    if cut is None:
        return (float("inf"), 0, 0, "", 0)
    room = budget - (cut["so_far"] - cut["slot_size"])
    ordered = turns.where(F.col("slot") == cut["slot"]).withColumn(
        "sum", F.sum("size").over(Window.partitionBy("slot").orderBy("turn"))
    )
    last = ordered.where(F.col("sum") <= F.lit(room)).agg(F.max("turn")).first()[0]
    return tuple(last) if last else (cut["slot"] / _SLOTS, 0, 0, "", 0)


def _taken(round_: int, last: tuple | None) -> Column:
    if last is None:
        return F.lit(False)
    names, kinds = ("finish", "place", "round", "key", "total"), ("double", "int", "int", "string", "bigint")
    limit = F.struct(*[F.lit(value).cast(kind).alias(name) for value, kind, name in zip(last, kinds, names)])
    return _order(round_) <= limit
