import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import models
from seamline import (
    SegmenterConfig,
    assign_topics,
    corpus_counts,
    end_turn_labels,
    number_turns,
    score_turns,
    segment,
    segment_text,
    strength_rollup,
    set_aside,
)
from seamline.operators.validation import mixed_dimensions

#: Two steps along one axis, three along a second, one back at 120 degrees.
TURN = [[3, 0, 0], [5, 0, 0], [0, 0, 2], [0, 0, 1], [0, 0, 4], [-1, 0, -(3**0.5)]]
ENGINES = ("arrow", "jvm")


@pytest.fixture(scope="module")
def dialogues():
    rng = np.random.default_rng(7)
    return [rng.normal(size=(n, 6)) for n in (1, 2, 3, 5, 31, 64)]


@pytest.fixture(scope="module")
def turns(spark, dialogues):
    return models.turn_table(spark, dialogues).repartition(5).cache()


@pytest.mark.parametrize("engine", ENGINES)
def test_hand_example(spark, engine):
    """With one turn of context the score is one minus the cosine of neighbours:
    0 along an axis, 1 at a right angle, and 1 + sqrt(3)/2 at 150 degrees."""
    config = SegmenterConfig(ctx_window=1, delta_star=0.8, engine=engine)
    done = segment(models.turn_table(spark, [TURN]), config)
    row = done.summary().first()
    assert row["boundaries"] == [2, 5]
    assert [tuple(s) for s in row["segments"]] == [(0, 2), (2, 5), (5, 6)]
    turn = 1 + 3**0.5 / 2
    assert row["scores"] == pytest.approx([0, 0, 1, 0, 0, turn], abs=1e-12)
    assert row["graded_scores"] == pytest.approx([0, 0, 1.25, 0, 0, turn / 0.8], abs=1e-12)
    histogram = done.strength_histogram().first()
    assert (histogram.very_weak, histogram.weak, histogram.normal, histogram.strong) == (4, 0, 1, 1)
    assert [r.label for r in done.end_turn_labels().orderBy("turn").collect()] == [0, 1, 0, 0, 1, 0]


def test_defaults_by_hand(spark):
    """Weights 1 and 0.7 on the last two turns: at the third the context lies along the
    first axis, at the fourth at the angle whose cosine is 1 / sqrt(1 + 0.7^2)."""
    scores = models.gather(score_turns(models.turn_table(spark, [TURN[:4]])), "delta_eff")[0]
    assert scores == pytest.approx([0, 0, 1, 0.5 * (1 - 1 / np.sqrt(1 + 0.7**2))], abs=1e-12)


@pytest.mark.parametrize("engine", ENGINES)
def test_cancelled_context_falls_back(spark, engine):
    vectors = [[1, 0], [-1, 0], [0, 1]]
    config = SegmenterConfig(ctx_window=2, ctx_decay=1.0, engine=engine)
    rows = score_turns(models.turn_table(spark, [vectors]), config).orderBy("turn").collect()
    assert rows[2].d_ctx is None and rows[2].delta_eff == 1.0
    assert rows[0].d_prev is None and rows[0].d_ctx is None and rows[0].delta_eff == 0.0


@pytest.mark.parametrize("engine", ENGINES)
@pytest.mark.parametrize("warmup", ("paper", "legacy"))
@pytest.mark.parametrize("m,chunk,known", [(1, 16384, True), (2, 4, False), (3, 5, True), (4, 4, True), (5, 7, False)])
def test_scores_match_the_sequential_model(turns, dialogues, engine, warmup, m, chunk, known):
    config = SegmenterConfig(ctx_window=m, ctx_blend_a=0.3, warmup=warmup, chunk_turns=chunk, engine=engine)
    got = models.gather(score_turns(turns, config, longest=64 if known else None), "delta_eff")
    for c, vectors in enumerate(dialogues):
        want = models.score(vectors, m=m, a=0.3, legacy=warmup == "legacy")
        assert got[c] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("engine", ENGINES)
@pytest.mark.parametrize("warmup", ("paper", "legacy"))
def test_later_turns_never_change_a_score(spark, engine, warmup):
    """Every prefix of several dialogues, cut anywhere, scores as the whole does."""
    rng = np.random.default_rng(2024)
    whole = [rng.uniform(-1, 1, (n, 5)) for n in (1, 4, 7, 9)]
    cut = [(d, n) for d, vectors in enumerate(whole) for n in range(1, len(vectors) + 1)]
    config = SegmenterConfig(ctx_window=3, warmup=warmup, chunk_turns=4, engine=engine)
    got = models.gather(score_turns(models.turn_table(spark, [whole[d][:n] for d, n in cut]), config), "delta_eff")
    full = {d: got[i] for i, (d, n) in enumerate(cut) if n == len(whole[d])}
    assert all(got[i] == pytest.approx(full[d][:n], abs=1e-13) for i, (d, n) in enumerate(cut))


@pytest.mark.parametrize("engine", ENGINES)
@pytest.mark.parametrize("longest", (3, 4, 9))
def test_an_understated_length_is_no_silent_loss(spark, engine, longest):
    table = models.turn_table(spark, [np.eye(10)])
    config = SegmenterConfig(chunk_turns=4, engine=engine)
    if longest > 4:  # split anyway: nothing depends on how long it is
        assert score_turns(table, config, longest=longest).count() == 10
        return
    with pytest.raises(PySparkException, match="longer than"):
        score_turns(table, config, longest=longest).collect()
    scored = score_turns(table, config)
    with pytest.raises(PySparkException, match="longer than"):
        end_turn_labels(scored, 0.5, longest=longest, chunk_turns=4).collect()


@pytest.mark.parametrize("partitions", ("1", "7"))
@pytest.mark.parametrize("engine,chunk", (("arrow", 16384), ("arrow", 4), ("jvm", 16384), ("jvm", 3)))
def test_results_do_not_depend_on_execution(spark, engine, chunk, partitions):
    """Dialogues of several vector lengths; engines, chunks and partitions all agree."""
    rng = np.random.default_rng(5)
    whole = [rng.normal(size=(n, d)) for n, d in ((9, 2), (1, 3), (6, 3), (8, 5), (5, 2))]
    config = SegmenterConfig(delta_star=0.9, chunk_turns=chunk, engine=engine)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        done = segment(models.turn_table(spark, whole), config)
        scores = models.gather(done.topics, "delta_eff")
        parts = sorted((r.conv_id, r.part, tuple(r.boundaries), len(r.scores)) for r in done.summary(5).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(scores[c] == pytest.approx(models.score(v), abs=1e-12) for c, v in enumerate(whole))
    labels = {c: models.topics(models.score(v), 0.9) for c, v in enumerate(whole)}
    assert parts == sorted(
        (c, p, tuple(t for t in range(p * 5, min(p * 5 + 5, len(x))) if t and x[t] != x[t - 1]), len(x[p * 5 : p * 5 + 5]))
        for c, x in labels.items()
        for p in range(-(-len(x) // 5))
    )


@pytest.mark.parametrize("engine", ENGINES)
@pytest.mark.parametrize("at", (1, 4, 5))
def test_a_dialogue_has_one_vector_length(spark, engine, at):
    vectors = [[1.0, 0.0]] * at + [[1.0, 0.0, 0.0]] * (8 - at)
    for chunk in (16384, 4):
        with pytest.raises(PySparkException):
            score_turns(models.turn_table(spark, [vectors]), SegmenterConfig(chunk_turns=chunk, engine=engine)).collect()


@pytest.mark.parametrize("key", ((None, 3), (1, None)))
def test_null_keys_are_refused(spark, key):
    table = spark.createDataFrame([(1, 0, [1.0]), (*key, [1.0])], "conv_id bigint, turn bigint, embedding array<double>")
    with pytest.raises(ValueError, match="must not be null"):
        segment(table)
    with pytest.raises(PySparkException, match="must not be null"):
        number_turns(table).collect()


def test_batches_smaller_than_a_dialogue(spark, turns, dialogues):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = models.gather(score_turns(turns, SegmenterConfig(ctx_window=5, chunk_turns=9)), "delta_eff")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c, vectors in enumerate(dialogues):
        assert got[c] == pytest.approx(models.score(vectors, m=5), abs=1e-12)


def test_scale_of_a_vector_is_irrelevant(spark, turns):
    scaled = turns.withColumn("embedding", F.transform("embedding", lambda x: x * (F.col("turn") + 3)))
    one = models.gather(score_turns(turns), "delta_eff")
    two = models.gather(score_turns(scaled), "delta_eff")
    assert all(one[c] == pytest.approx(two[c], abs=1e-12) for c in one)


@pytest.mark.parametrize("engine,chunk", (("arrow", 16384), ("arrow", 4), ("jvm", 5)))
def test_topics_and_reports(spark, turns, dialogues, engine, chunk):
    delta = 0.95
    config = SegmenterConfig(delta_star=delta, chunk_turns=chunk, engine=engine)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        done = segment(turns, config)
        marked = done.topics.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = assign_topics(score_turns(turns, config), config)
    assert sorted(marked) == sorted(plain.collect())
    topic_ids = models.gather(done.topics, "topic_id")
    starts = models.gather(done.topics, "topic_start")
    labels = models.gather(done.end_turn_labels(), "label")
    segments = {}
    for s in done.segments().orderBy("conv_id", "start").collect():
        segments.setdefault(s.conv_id, []).append((s.start, s.end_exclusive))
    parts = {}
    for row in done.summary().orderBy("conv_id", "part").collect():
        have = parts.setdefault(row.conv_id, ([], [], [], []))
        for into, name in zip(have, ("boundaries", "segments", "scores", "graded_scores")):
            into.extend(row[name])
    bands = {r.conv_id: r for r in done.strength_rollup().collect()}
    for c, vectors in enumerate(dialogues):
        scores = models.score(vectors)
        want = models.topics(scores, delta)
        boundaries = [t for t in range(1, len(want)) if want[t] != want[t - 1]]
        cuts = [0, *boundaries, len(want)]
        assert topic_ids[c] == want
        assert starts[c] == [max(b for b in [0, *boundaries] if b <= t) for t in range(len(want))]
        assert labels[c] == models.end_labels(scores, delta)
        assert segments[c] == list(zip(cuts, cuts[1:]))
        assert parts[c][0] == boundaries
        assert [tuple(s) for s in parts[c][1]] == segments[c]
        assert parts[c][2] == pytest.approx(scores, abs=1e-12)
        assert parts[c][3] == pytest.approx([s / delta for s in scores], abs=1e-12)
        assert sum(bands[c][b] for b in ("very_weak", "weak", "normal", "strong")) == len(want)
        assert bands[c].normal + bands[c].strong == len(boundaries)
    assert bands[None].strong == sum(bands[c].strong for c in range(len(dialogues)))


@pytest.mark.parametrize("chunk,part", ((16384, 3), (3, 16384), (3, 4)))
def test_segment_text_keeps_every_exchange(spark, chunk, part):
    vectors = [[1, 0]] * 7 + [[0, 1]] * 2
    table = models.turn_table(spark, [vectors, [[1, 1]]]).withColumn(
        "text", F.concat_ws("-", "conv_id", "turn")
    )
    config = SegmenterConfig(ctx_window=1, delta_star=0.5, chunk_turns=chunk)
    rows = segment(table, config, keep=["text"]).segment_text(part).orderBy("conv_id", "start").collect()
    joined = {}
    for r in rows:
        assert len(r.texts) == r.end_exclusive - r.start <= part
        joined.setdefault((r.conv_id, r.topic_id), []).extend(r.texts)
    assert joined == {
        (0, 0): [f"0-{t}" for t in range(7)],
        (0, 1): ["0-7", "0-8"],
        (1, 0): ["1-0"],
    }


def test_every_dialogue_starts_at_topic_zero(spark):
    # The second dialogue starts where the first ended.
    table = models.turn_table(spark, [TURN[:5], [[0, 0, 7], [2, 0, 0], [1, 0, 0]]])
    done = segment(table, SegmenterConfig(ctx_window=1, delta_star=0.5))
    assert models.gather(done.topics, "topic_id") == {0: [0, 0, 1, 1, 1], 1: [0, 1, 1]}
    counts = corpus_counts(table).first()
    assert (counts.n_sessions, counts.n_exchanges) == (2, 8)


def test_threshold_is_inclusive(spark):
    table = models.turn_table(spark, [[[1, 0], [0, 1], [0, 1]]])
    done = segment(table, SegmenterConfig(ctx_window=1, delta_star=1.0))
    assert models.gather(done.topics, "is_boundary")[0] == [False, True, False]


def test_gaps_in_turn_are_closed(spark, turns, dialogues):
    gapped = turns.withColumn("turn", F.col("turn") * F.col("turn") * 977 - 4000)
    got = models.gather(segment(gapped, SegmenterConfig(chunk_turns=8)).topics, "delta_eff")
    for c, vectors in enumerate(dialogues):
        assert got[c] == pytest.approx(models.score(vectors), abs=1e-12)


def test_string_keys_and_interleaved_rows(spark, turns, dialogues):
    named = turns.withColumn("conv_id", F.concat(F.lit("d"), "conv_id")).orderBy("turn", "conv_id")
    got = models.gather(score_turns(named, SegmenterConfig(chunk_turns=10)), "delta_eff")
    for c, vectors in enumerate(dialogues):
        assert got[f"d{c}"] == pytest.approx(models.score(vectors), abs=1e-12)


def test_empty_table(spark):
    done = segment(models.turn_table(spark, [TURN]).where("turn < 0"))
    assert done.history().count() == done.segments().count() == done.summary().count() == 0
    assert strength_rollup(done.topics).count() == 0
    assert tuple(corpus_counts(done.topics).first()) == (0, 0)


@pytest.mark.parametrize(
    "bad",
    [
        {"delta_star": 0},
        {"delta_star": 2.1},
        {"delta_star": float("nan")},
        {"ctx_window": 0},
        {"ctx_decay": 0},
        {"ctx_decay": 1.1},
        {"ctx_decay": float("nan")},
        {"ctx_blend_a": -0.1},
        {"ctx_blend_a": float("nan")},
        {"warmup": "none"},
        {"dim": 0},
        {"engine": "other"},
        {"ctx_window": 9, "chunk_turns": 8},
    ],
)
def test_parameters_out_of_range(bad):
    with pytest.raises(ValueError):
        SegmenterConfig(**bad)


def test_session_defaults():
    config = SegmenterConfig.for_sessions(ctx_window=3)
    assert (config.dim, config.delta_star, config.ctx_window) == (768, 0.30, 3)
    assert SegmenterConfig.for_sessions(dim=2, delta_star=0.4).dim == 2


BAD = {
    "zero": [0.0, 0.0],
    "not_finite": [float("nan"), 1.0],
    "dimension": [1.0, 2.0, 3.0],
    "missing": None,
}


@pytest.mark.parametrize("engine", ENGINES)
@pytest.mark.parametrize("reason", BAD)
def test_bad_vectors_stop_the_job(spark, engine, reason):
    rows = [(0, 0, [1.0, 0.0]), (0, 1, BAD[reason]), (0, 2, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, embedding array<double>")
    with pytest.raises(PySparkException):
        score_turns(table, SegmenterConfig(dim=2, engine=engine)).collect()


@pytest.mark.parametrize("engine", ENGINES)
def test_bad_vectors_can_be_set_aside(spark, engine):
    vectors = [[1.0, 0.0], *BAD.values(), [float("inf"), 0.0], [1e200, 1e200], [None, 1.0], [], [1.0, 0.0]]
    rows = [(0, t, v) for t, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, embedding array<double>")
    valid, invalid = set_aside(table, dim=2, engine=engine)
    unfit = ["zero", "not_finite", "dimension", "missing", *["not_finite"] * 3, "dimension"]
    assert {r.turn: r.reason for r in invalid.collect()} == dict(enumerate(unfit, 1))
    done = segment(valid, SegmenterConfig(ctx_window=1))
    assert models.gather(done.topics, "delta_eff") == {0: [0.0, 0.0]}
    assert [r.conv_id for r in mixed_dimensions(table.where("embedding IS NOT NULL")).collect()] == [0]
    other = {r.turn: r.reason for r in set_aside(table, engine=engine)[1].collect()}
    assert 3 not in other and other[8] == "dimension"


@pytest.mark.parametrize("engine", ENGINES)
def test_repeated_or_missing_turns_are_refused(spark, engine):
    for order in ([0, 1, 1, 2], [0, 2, 3, 4], [1, 2, 3, 4]):
        table = spark.createDataFrame(
            [(0, t, [1.0, 0.0]) for t in order], "conv_id bigint, turn bigint, embedding array<double>"
        )
        with pytest.raises(PySparkException):
            score_turns(table, SegmenterConfig(engine=engine)).collect()


def test_labels_look_one_turn_ahead(spark, turns, dialogues):
    scored = score_turns(turns)
    for longest, chunk in ((64, 16384), (None, 4)):
        got = models.gather(end_turn_labels(scored, 1.0, longest=longest, chunk_turns=chunk), "label")
        for c, vectors in enumerate(dialogues):
            assert got[c] == models.end_labels(models.score(vectors), 1.0)
