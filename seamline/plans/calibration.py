"""Choosing the boundary threshold on labelled dialogues."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.config import DEFAULT_CHUNK_TURNS, SegmenterConfig
from seamline.functions.encoders import Encoder
from seamline.operators.evaluation import METRICS, corpus_metrics, dialogue_metrics
from seamline.operators.prefix import dense_turns
from seamline.operators.scoring import score_turns
from seamline.operators.topics import next_scores
from seamline.plans.quantiles import exact_percentiles
from seamline.storage import store

DEFAULT_PERCENTILES = tuple(range(5, 100, 5))
SELECTION_METRICS = ("score", "f1")


@dataclass(frozen=True)
class Calibration:
    """``candidates`` has one row per threshold tried, ``selected`` the best;
    ``config`` is what the scores were made with, if known."""

    candidates: DataFrame
    selected: DataFrame
    selection_metric: str
    config: SegmenterConfig | None = None
    label_source: str = "labels given by the caller, who answers for where they come from"


def check_percentiles(percentiles: Sequence[float]) -> None:
    if not all(0 < p < 100 for p in percentiles):
        raise ValueError("each percentile must lie strictly between 0 and 100")


def threshold_candidates(
    scored: DataFrame, percentiles: Sequence[float] = DEFAULT_PERCENTILES
) -> DataFrame:
    """``(percentile, delta_star)``: percentiles of all scores but each
    dialogue's first, positive ones only."""
    check_percentiles(percentiles)
    scores = store(scored.select("conv_id", "turn", "delta_eff"), "scores")
    return scored.sparkSession.createDataFrame(
        _thresholds(scores, percentiles), "percentile double, delta_star double"
    )


def _thresholds(scores: DataFrame, percentiles: Sequence[float]) -> list[tuple[float, float]]:
    found = exact_percentiles(scores.where("turn > 0"), "delta_eff", percentiles)
    return [(row.percentile, row.value) for row in found if row.value > 0]


def calibrate_turns(
    turns: DataFrame,
    labels: DataFrame,
    config: SegmenterConfig = SegmenterConfig(),
    percentiles: Sequence[float] = DEFAULT_PERCENTILES,
    metric: str = "score",
    *,
    encoder: Encoder | None = None,
) -> Calibration:
    """Score a turn table and calibrate on it. Turns and labels are matched by
    their position in the dialogue."""
    turns, longest = dense_turns(turns)
    labels, _ = dense_turns(labels)
    scored = score_turns(turns, config, longest=longest, encoder=encoder)
    found = calibrate(
        scored, labels, percentiles, metric, longest=longest, chunk_turns=config.chunk_turns
    )
    return replace(found, config=config)


def calibrate(
    scored: DataFrame,
    labels: DataFrame,
    percentiles: Sequence[float] = DEFAULT_PERCENTILES,
    metric: str = "score",
    *,
    longest: int | None = None,
    chunk_turns: int = DEFAULT_CHUNK_TURNS,
) -> Calibration:
    """Evaluate a grid of thresholds against pseudo labels (end-turn convention).

    The scores are computed and written once; the thresholds, one number per
    percentile, come to the driver; then all of them are evaluated in one pass,
    each as one more column of the same rows.
    """
    if metric not in SELECTION_METRICS:
        raise ValueError(f"metric must be one of {SELECTION_METRICS}")
    check_percentiles(percentiles)
    scores = store(scored.select("conv_id", "turn", "delta_eff"), "scores")
    grid = _thresholds(scores, percentiles)
    if not grid:
        raise ValueError("no percentile of the calibration scores is positive")

    # A turn ends a segment at every threshold its next score reaches. Thresholds are
    # nested, so one number says at how many: it goes through the joins, and is
    # spread to one label per threshold where labels are summed.
    ladder = sorted(delta for _, delta in grid)
    rungs = " + ".join(f"int(coalesce(ahead >= {delta!r}D, false))" for delta in ladder)
    preds = {f"p{i}": f"int(reached > {ladder.index(delta)})" for i, (_, delta) in enumerate(grid)}
    ahead = next_scores(scores, longest=longest, chunk_turns=chunk_turns)
    ahead = ahead.selectExpr("conv_id", "turn", f"{rungs} AS reached")
    gold = labels.select("conv_id", "turn", F.col("label").alias("gold"))
    predicted = gold.join(ahead, ["conv_id", "turn"], "full")
    per_dialogue = dialogue_metrics(predicted, preds, longest=longest, chunk_turns=chunk_turns)
    at = ", ".join(f"named_struct('percentile', {p!r}D, 'delta_star', {delta!r}D)" for p, delta in grid)
    candidates = corpus_metrics(per_dialogue, list(preds)).select(
        "ordinal", F.expr(f"element_at(array({at}), ordinal + 1)").alias("at"), *METRICS, "n"
    )
    # A row per percentile; written so that it is not computed for each reader.
    candidates = store(candidates.select("ordinal", "at.*", *METRICS, "n"), "candidates")
    # Sums of floats may differ in the last digit from run to run; without the
    # rounding such noise, not the order of the percentiles, would break ties.
    best = candidates.orderBy(F.round(metric, 12).desc(), "ordinal").limit(1)
    return Calibration(candidates.drop("ordinal"), best.drop("ordinal"), metric)
