"""Boundaries, topics and what is reported about them.

A boundary is the first turn of a new topic: any turn but the first whose
``delta_eff`` reaches the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.config import DEFAULT_CHUNK_TURNS, SegmenterConfig
from seamline.operators.prefix import chunk_of, running
from seamline.operators.scoring import MARKS, TOO_LONG, own_turns
from seamline.storage import store

#: Upper ends of the strength bands of a graded score (fixed values).
BANDS = {"very_weak": 0.7, "weak": 1.0, "normal": 1.3, "strong": float("inf")}

#: Turns per row of the reports with arrays. Part of their result, unlike the size of a chunk.
PART_TURNS = 16_384

HISTORY = ("turn", "topic_id", "is_boundary", "delta_eff", "graded_score")


def is_boundary(delta_star: float) -> Column:
    return (F.col("turn") > 0) & (F.col("delta_eff") >= delta_star)


def graded_score(delta_star: float) -> Column:
    return F.col("delta_eff") / F.lit(float(delta_star))


def strength_band(graded: Column) -> Column:
    band = F.when(F.lit(False), F.lit(""))
    for name, upper in BANDS.items():
        band = band.when(graded < upper, name)
    return band.otherwise("strong")


def assign_topics(
    scored: DataFrame,
    config: SegmenterConfig = SegmenterConfig(),
    *,
    longest: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Add ``is_boundary``, ``graded_score``, ``topic_id`` and ``topic_start``,
    the turn the topic began at.

    Dialogues longer than ``config.chunk_turns`` are summed chunk by chunk, for
    which the scores are written once, unless they are ``stored`` already. Without
    ``longest`` that is assumed.
    Scores that were marked at the same threshold are not shuffled again.
    """
    marked = set(MARKS) <= set(scored.columns)
    flagged = scored.select(
        "*",
        is_boundary(config.delta_star).alias("is_boundary"),
        graded_score(config.delta_star).alias("graded_score"),
    )
    if marked:
        topic, start = MARKS
    else:
        topic, start = "bigint(is_boundary)", "if(is_boundary OR turn = 0, turn, NULL)"
    return running(
        flagged,
        {"topic_id": ("sum", topic), "topic_start": ("max", start)},
        longest=config.chunk_turns + 1 if longest is None else longest,
        chunk_turns=config.chunk_turns,
        folded=marked,
        stored=stored,
    ).drop(*MARKS)


def history(topics: DataFrame) -> DataFrame:
    """One record per turn."""
    return topics.select("conv_id", *HISTORY)


def segments(topics: DataFrame) -> DataFrame:
    """The intervals ``[start, end_exclusive)`` that cover each dialogue."""
    return topics.groupBy("conv_id", "topic_id").agg(
        F.min("turn").alias("start"), (F.max("turn") + 1).alias("end_exclusive")
    )


def segment_text(topics: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """The texts of every segment, in order.

    A segment of more than ``part_turns`` turns continues in further rows, told
    apart by ``part``; no row and no task has to hold an unbounded segment.
    """
    part = F.call_function("div", F.col("turn") - F.col("topic_start"), F.lit(part_turns))
    return topics.groupBy("conv_id", "topic_id", part.alias("part")).agg(
        F.min("turn").alias("start"),
        (F.max("turn") + 1).alias("end_exclusive"),
        in_turn_order("text").alias("texts"),
    )


def in_turn_order(column: str, only: Column | None = None) -> Column:
    """Aggregate: the values of a column as an array ordered by turn."""
    item = F.struct("turn", column)
    items = F.sort_array(F.collect_list(item if only is None else F.when(only, item)))
    return F.transform(items, lambda x: x[column])


def dialogue_summary(
    topics: DataFrame, *, longest: int | None = None, part_turns: int = PART_TURNS
) -> DataFrame:
    """Boundaries, segments and scores of each dialogue as arrays.

    One row covers up to ``part_turns`` turns; a longer dialogue has several,
    numbered by ``part``. A segment is listed in the part it starts in. The rows
    depend on ``part_turns`` alone; ``longest`` only spares a dialogue that fits
    one part the join of its segments.
    """
    split = longest is None or longest > part_turns
    if split:
        topics = store(topics, "topics")
    part = chunk_of(F.col("turn"), part_turns) if split else F.lit(0).cast("bigint")
    parts = topics.groupBy("conv_id", part.alias("part")).agg(
        F.sort_array(F.collect_list(F.when(F.col("is_boundary"), F.col("turn")))).alias("boundaries"),
        in_turn_order("delta_eff").alias("scores"),
        in_turn_order("graded_score").alias("graded_scores"),
        (F.max("turn") + 1).alias("n"),
    )
    if split:
        ends = (
            topics.groupBy("conv_id", "topic_id", "topic_start")
            .agg((F.max("turn") + 1).alias("end_exclusive"))
            .groupBy("conv_id", chunk_of(F.col("topic_start"), part_turns).alias("part"))
            .agg(
                F.sort_array(
                    F.collect_list(F.struct(F.col("topic_start").alias("start"), "end_exclusive"))
                ).alias("intervals")
            )
        )
        none = F.from_json(F.lit("[]"), "array<struct<start:bigint,end_exclusive:bigint>>")
        parts = parts.join(ends, ["conv_id", "part"], "left")
        intervals = F.coalesce("intervals", none)
    else:
        fits = F.when(F.col("n") <= part_turns, F.col("n")).otherwise(F.raise_error(F.lit(TOO_LONG)).cast("bigint"))
        parts = parts.withColumn("n", fits)
        starts = F.concat(F.array(F.lit(0).cast("bigint")), F.col("boundaries"))
        stops = F.concat(F.col("boundaries"), F.array("n"))
        intervals = F.zip_with(
            starts, stops, lambda x, y: F.struct(x.alias("start"), y.alias("end_exclusive"))
        )
    return parts.select(
        "conv_id", "part", "boundaries", intervals.alias("segments"), "scores", "graded_scores"
    )


def strength_histogram(topics: DataFrame) -> DataFrame:
    """Turns per strength band and dialogue; the first turn is counted too."""
    band = strength_band(F.col("graded_score"))
    return topics.groupBy("conv_id").agg(*[F.count_if(band == name).alias(name) for name in BANDS])


def strength_rollup(topics: DataFrame) -> DataFrame:
    """The histogram of each dialogue and, with a null ``conv_id``, of all.

    Rolled up from the finished histograms, so turns are read only once.
    """
    totals = [F.sum(name).alias(name) for name in BANDS]
    return strength_histogram(topics).rollup("conv_id").agg(*totals)


def corpus_counts(turns: DataFrame) -> DataFrame:
    """Number of dialogues with at least one turn, and of turns."""
    return (
        turns.groupBy("conv_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count(F.lit(1)).alias("n_sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_exchanges"))
    )


def next_scores(
    scored: DataFrame, *, longest: int | None = None, chunk_turns: int = DEFAULT_CHUNK_TURNS
) -> DataFrame:
    """Each turn with the score of the turn after it, null on the last one.

    A chunk of a long dialogue gets the first turn of the following chunk once
    more. This serves labels only; no score ever depends on a later turn.
    """
    rows = scored.select("conv_id", "turn", "delta_eff")
    own = chunk_of(F.col("turn"), chunk_turns)
    if longest is not None and longest <= chunk_turns:
        rows = rows.withColumn("chunk", F.lit(0).cast("bigint"))
        keys, copied = ["conv_id"], F.lit(False)
    else:
        edge = (F.col("turn") % chunk_turns == 0) & (F.col("turn") > 0)
        both = F.when(edge, F.array(own - 1, own)).otherwise(F.array(own))
        rows = rows.withColumn("chunk", F.explode(both))
        keys, copied = ["conv_id", "chunk"], F.col("turn") == (F.col("chunk") + 1) * chunk_turns
    following = F.lead("delta_eff").over(Window.partitionBy(*keys).orderBy("turn"))
    kept = rows.withColumn("ahead", following).where(own_turns(own == F.col("chunk"), copied))
    return kept.select("conv_id", "turn", "ahead")


def label_at(delta_star: float) -> Column:
    """1 where the next turn starts a topic at this threshold, else 0."""
    return F.coalesce((F.col("ahead") >= delta_star).cast("int"), F.lit(0))


def end_turn_labels(
    scored: DataFrame,
    delta_star: float,
    *,
    longest: int | None = None,
    chunk_turns: int = DEFAULT_CHUNK_TURNS,
) -> DataFrame:
    """0/1 labels that mark the last turn of each closing segment."""
    ahead = next_scores(scored, longest=longest, chunk_turns=chunk_turns)
    return ahead.select("conv_id", "turn", label_at(delta_star).alias("label"))
