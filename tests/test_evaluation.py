import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import models
from seamline import (
    SegmenterConfig,
    calibrate,
    calibrate_turns,
    evaluate,
    label_violations,
    score_turns,
    threshold_candidates,
)
from seamline.operators.evaluation import dialogue_metrics
from seamline.operators.validation import paired_labels
from seamline.plans.quantiles import exact_percentiles


#: Two steps east, two north, one east: neighbours score 0, 1, 0, 1, whose 20th
#: percentile is 0 and whose 60th is 0.8.
STEPS = [[2, 0], [1, 0], [0, 3], [0, 1], [5, 0]]
TURNS_END = [0, 1, 0, 1, 0]


def labels(rng, sizes, share):
    return [[int(x) for x in rng.random(n) < share] for n in sizes]


@pytest.mark.parametrize("chunk", (16384, 8))
def test_metrics_match_the_loops(spark, chunk):
    rng = np.random.default_rng(3)
    sizes = [2, 3, 4, 5, 7, *rng.integers(2, 60, 40)]
    golds, preds = labels(rng, sizes, 0.25), labels(rng, sizes, 0.3)
    gold, pred = models.label_table(spark, golds), models.label_table(spark, preds)
    pairs = paired_labels(gold, pred)
    rows = dialogue_metrics(pairs, ["pred"], chunk_turns=chunk).collect()
    assert len(rows) == len(sizes)
    for r in rows:
        want = models.metrics(golds[r.conv_id], preds[r.conv_id])
        assert (r.pk_pred, r.wd_pred, r.f1_pred) == pytest.approx(want, abs=1e-12)
    got = evaluate(gold, pred, longest=60, chunk_turns=chunk).first()
    want = models.corpus(golds, preds)
    assert got.n == len(sizes)
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=1e-12)


def test_hand_examples(spark):
    table = models.label_table(spark, [[0, 0, 1, 0, 1]])
    assert tuple(evaluate(table, table).first()) == (0.0, 0.0, 1.0, 1.0, 1)
    table = models.label_table(spark, [[0, 0, 0, 0, 0, 1]])
    assert tuple(evaluate(table, table).first()) == (0.0, 0.0, 0.0, 0.5, 1)


def test_f1_alone_is_the_same_without_windows(spark):
    rng = np.random.default_rng(8)
    golds, preds = labels(rng, [2, 9, 30], 0.3), labels(rng, [2, 9, 30], 0.3)
    pairs = paired_labels(models.label_table(spark, golds), models.label_table(spark, preds))
    alone = dialogue_metrics(pairs, ["pred"], metrics=["f1"])
    assert alone.columns == ["conv_id", "n", "k", "f1_pred"]
    for r in alone.collect():
        assert r.f1_pred == pytest.approx(models.metrics(golds[r.conv_id], preds[r.conv_id])[2], abs=1e-12)
    with pytest.raises(ValueError):
        dialogue_metrics(pairs, ["pred"], metrics=["score"])


def test_window_size_rounds_halves_to_even(spark):
    # 5 turns, no boundary: 2.5 -> 2; 7 turns: 3.5 -> 4.
    table = models.label_table(spark, [[0] * 5, [0] * 7])
    rows = dialogue_metrics(paired_labels(table, table), ["pred"]).orderBy("conv_id").collect()
    assert [r.k for r in rows] == [2, 4]


# Several stages of one job may fail at once, which arrives as a Java error.
FAILED = (PySparkException, Py4JJavaError)


@pytest.mark.parametrize(
    "gold,pred,message",
    [
        ([[0, 1]], [[0, 2]], "labels must be 0 or 1"),
        ([[0, 0, 1]], [[0, 0]], "cover the same turns"),
        ([[0]], [[0]], "at least two turns"),
        ([[0, 1], [0, 0]], [[0, 1]], "cover the same turns"),
        ([[0, 1]], [[0, None]], "cover the same turns"),
    ],
)
@pytest.mark.parametrize("longest", (3, None))
def test_unusable_labels_are_refused(spark, gold, pred, message, longest):
    a, b = models.label_table(spark, gold), models.label_table(spark, pred)
    with pytest.raises(FAILED, match=message):
        evaluate(a, b, longest=longest).collect()
    assert label_violations(paired_labels(a, b)).count() == 1


@pytest.mark.parametrize("turns", ([0, 2], [0, 1, 1], [1, 2], [0, 0, 2]))
def test_labels_must_be_numbered(spark, turns):
    table = spark.createDataFrame([(0, t, 0) for t in turns], "conv_id bigint, turn bigint, gold int")
    table = table.withColumn("pred", F.col("gold"))
    for longest in (3, None):
        with pytest.raises(FAILED, match="turn must number"):
            dialogue_metrics(table, ["pred"], longest=longest).collect()


def test_nothing_to_evaluate(spark):
    none = models.label_table(spark, [[0, 1]]).where("turn < 0")
    with pytest.raises(FAILED, match="no dialogues"):
        evaluate(none, none).collect()


@pytest.mark.parametrize("digits,few_values", (((20, 20), 1_000_000), ((2, 3), 0), ((1, 2, 3), 300)))
def test_percentiles_are_those_of_numpy(spark, digits, few_values):
    rng = np.random.default_rng(11)
    pools = [
        rng.random(997) * 2,
        np.repeat([0.0, 0.25, 1.0, -1e-16], [400, 3, 90, 8]),
        1 + rng.random(50) * 1e-9,
        np.array([0.4]),
    ]
    points = [0.5, 5, 25, 50, 55, 75, 95, 99.9]
    for pool in pools:
        frame = spark.createDataFrame([(float(x),) for x in pool], "x double").repartition(3)
        rows = exact_percentiles(frame, "x", points, digits, few_values)
        assert [r.percentile for r in rows] == points
        assert [r.value for r in rows] == pytest.approx(np.percentile(pool, points), abs=1e-15)
    assert exact_percentiles(frame.where("x > 9"), "x", points, digits) == []


def test_calibration_by_hand(spark):
    table = models.turn_table(spark, [STEPS])
    scored = score_turns(table, SegmenterConfig(ctx_window=1))
    gold = models.label_table(spark, [TURNS_END])
    result = calibrate(scored, gold, percentiles=[20, 60])
    best = result.selected.first()
    assert (best.percentile, best.delta_star, best.score) == (60, pytest.approx(0.8), 1.0)
    assert result.candidates.count() == 1


@pytest.mark.parametrize("metric,longest,chunk", (("score", 40, 16384), ("f1", None, 16)))
def test_calibration_grid_matches_the_loops(spark, metric, longest, chunk):
    rng = np.random.default_rng(5)
    dialogues = [rng.normal(size=(n, 5)) for n in rng.integers(2, 40, 15)]
    golds = labels(rng, [len(d) for d in dialogues], 0.3)
    signals = [models.score(d) for d in dialogues]
    pool = np.concatenate([s[1:] for s in signals])
    scored = score_turns(models.turn_table(spark, dialogues), longest=longest)
    result = calibrate(
        scored, models.label_table(spark, golds), metric=metric, longest=longest, chunk_turns=chunk
    )
    want = []
    for p in range(5, 100, 5):
        delta = float(np.percentile(pool, p))
        want.append((p, delta, models.corpus(golds, [models.end_labels(s, delta) for s in signals])))
    rows = result.candidates.orderBy("percentile").collect()
    assert len(rows) == 19
    for row, (p, delta, figures) in zip(rows, want):
        assert (row.percentile, row.delta_star) == pytest.approx((p, delta))
        assert {k: row[k] for k in figures} == pytest.approx(figures, abs=1e-9)
    best = max(want, key=lambda w: round(w[2][metric], 12))
    assert result.selected.first().percentile == best[0]
    assert result.selection_metric == metric


def test_turns_and_labels_are_matched_by_position(spark):
    table = models.turn_table(spark, [STEPS]).withColumn("turn", F.col("turn") * 3 + 1)
    gold = models.label_table(spark, [TURNS_END])
    config = SegmenterConfig(ctx_window=1)
    result = calibrate_turns(table, gold, config, percentiles=[20, 60])
    assert result.selected.first().score == 1.0 and result.config == config


def test_first_percentile_wins_a_tie(spark):
    table = models.turn_table(spark, [STEPS])
    scored = score_turns(table, SegmenterConfig(ctx_window=1))
    gold = models.label_table(spark, [TURNS_END])
    assert calibrate(scored, gold, percentiles=[70, 60, 65]).selected.first().percentile == 70


def test_calibration_refuses(spark):
    table = models.turn_table(spark, [[[1, 0], [0, 1]]])
    scored, gold = score_turns(table), models.label_table(spark, [[0, 0]])
    for wrong in ({"metric": "pk"}, {"percentiles": [0]}, {"percentiles": [100]}):
        with pytest.raises(ValueError):
            calibrate(scored, gold, **wrong)
    same = score_turns(models.turn_table(spark, [[[1, 0], [1, 0]]]))
    with pytest.raises(ValueError):
        calibrate(same, gold)
    with pytest.raises(FAILED, match="cover the same turns"):
        calibrate(scored, models.label_table(spark, [[0, 0, 0]])).candidates.collect()
    assert threshold_candidates(scored, [50]).first().delta_star == pytest.approx(1.0)
