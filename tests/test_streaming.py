import time

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

import models
from seamline import SegmenterConfig, segment, segment_stream

CONFIG = SegmenterConfig(delta_star=0.95, ctx_window=3, warmup="legacy")
SCHEMA = "conv_id bigint, turn bigint, embedding array<double>"


def run(spark, source, out, state, config=CONFIG):
    feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    decided = segment_stream(feed, config)
    query = (
        decided.writeStream.format("parquet")
        .option("checkpointLocation", str(state))
        .trigger(availableNow=True)
        .start(str(out))
    )
    assert query.awaitTermination(240)
    return spark.read.schema(decided.schema).parquet(str(out))


def feed_in(spark, source, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))


@pytest.mark.parametrize("seed", (0, 1))
def test_stream_equals_batch_for_any_split_and_a_restart(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    rows = [
        (c, t, rng.normal(size=4).tolist()) for c, n in enumerate((1, 2, 9, 14)) for t in range(n)
    ]
    # Each micro-batch holds the next few turns of some dialogues, in any order.
    cuts = sorted(rng.choice(np.arange(1, 14), 4, replace=False))
    parts = [[r for r in rows if lo <= r[1] < hi] for lo, hi in zip([0, *cuts], [*cuts, 14])]
    source, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    for part in parts[:3]:
        feed_in(spark, source, [part[i] for i in rng.permutation(len(part))])
    run(spark, source, out, state)
    for part in parts[3:]:
        feed_in(spark, source, [part[i] for i in rng.permutation(len(part))])
    got = run(spark, source, out, state)
    assert got.count() == len(rows) and got.where("late").count() == 0

    want = segment(spark.createDataFrame(rows, SCHEMA), CONFIG).history()
    for name in ("topic_id", "is_boundary"):
        assert models.gather(got, name) == models.gather(want, name)
    for name in ("delta_eff", "graded_score"):
        one, two = models.gather(got, name), models.gather(want, name)
        assert all(one[c] == pytest.approx(two[c], abs=1e-12) for c in two)


def test_late_turns_change_nothing(spark, tmp_path):
    config = SegmenterConfig(delta_star=0.5, ctx_window=1)
    source = tmp_path / "in"
    feed_in(spark, source, [(7, 3, [1.0, 0.0]), (7, 5, [1.0, 0.0])])
    feed_in(spark, source, [(7, 4, [0.0, 1.0]), (7, 5, [0.0, 1.0]), (7, 9, [0.0, 1.0])])
    got = run(spark, source, tmp_path / "out", tmp_path / "state", config)
    rows = sorted((r.input_turn, r.late, r.turn, r.topic_id, r.is_boundary) for r in got.where("not late").collect())
    assert rows == [(3, False, 0, 0, False), (5, False, 1, 0, False), (9, False, 2, 1, True)]
    late = got.where("late").orderBy("input_turn").collect()
    assert [(r.input_turn, r.topic_id, r.delta_eff) for r in late] == [(4, None, None), (5, None, None)]


def test_bad_vector_stops_the_stream(spark, tmp_path):
    feed_in(spark, tmp_path / "in", [(1, 0, [0.0, 0.0])])
    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "state")


def test_unfit_vectors_can_be_set_aside(spark, tmp_path):
    config = SegmenterConfig(delta_star=0.5, ctx_window=1)
    source, out, state = (tmp_path / n for n in ("in", "out", "state"))

    def decide():
        feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        decided = segment_stream(feed, config, unfit="aside")
        query = (
            decided.writeStream.format("parquet")
            .option("checkpointLocation", str(state))
            .trigger(availableNow=True)
            .start(str(out))
        )
        assert query.awaitTermination(240)
        rows = spark.read.schema(decided.schema).parquet(str(out)).collect()
        found = [(r.conv_id, r.input_turn, r.late, r.turn, r.topic_id, r.reason) for r in rows]
        return sorted(found, key=lambda r: (*r[:3], r[5] or ""))

    feed_in(spark, source, [(1, 0, [0.0, 0.0]), (1, 1, [1.0, 0.0]), (1, 2, [1.0]), (2, 0, None)])
    assert decide() == [
        (1, 0, False, None, None, "zero"),
        (1, 1, False, 0, 0, None),
        (1, 2, False, None, None, "dimension"),
        (2, 0, False, None, None, "missing"),
    ]
    # After a restart the dialogue goes on from its last fit turn, and keeps its vectors' length.
    feed_in(spark, source, [(1, 2, [0.0, 1.0]), (1, 3, [float("nan"), 1.0]), (1, 4, [1.0, 2.0, 3.0]), (2, 0, [1.0])])
    assert [r for r in decide() if r[1:3] != (0, False) or r[5] is None] == [
        (1, 1, False, 0, 0, None),
        (1, 2, False, 1, 1, None),
        (1, 2, False, None, None, "dimension"),
        (1, 3, False, None, None, "not_finite"),
        (1, 4, False, None, None, "dimension"),
        (2, 0, False, 0, 0, None),
    ]


def test_idle_dialogues_can_be_forgotten(spark, tmp_path):
    config = SegmenterConfig(delta_star=0.5, ctx_window=1)
    source = tmp_path / "in"
    feed_in(spark, source, [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])])
    turns = spark.readStream.schema(SCHEMA).parquet(str(source))
    decided = segment_stream(turns, config, idle_timeout_ms=200)
    query = (
        decided.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(processingTime="300 milliseconds")
        .start(str(tmp_path / "out"))
    )
    def wait(done):
        # Timeouts make batches of their own, so that the query is never at rest.
        until = time.monotonic() + 60
        while not done() and time.monotonic() < until:
            time.sleep(0.2)

    def written():
        return spark.read.schema(decided.schema).parquet(str(tmp_path / "out")).count()

    def states():
        progress = query.lastProgress
        return progress["stateOperators"][0]["numRowsTotal"] if progress and progress["stateOperators"] else None

    try:
        wait(lambda: (tmp_path / "out").exists() and written() == 2)
        wait(lambda: states() == 0)
        feed_in(spark, source, [(1, 0, [0.0, 1.0])])
        wait(lambda: written() == 3)
    finally:
        query.stop()
    rows = spark.read.schema(decided.schema).parquet(str(tmp_path / "out")).collect()
    assert sorted((r.input_turn, r.turn, r.topic_id, r.late) for r in rows) == [
        (0, 0, 0, False),
        (0, 0, 0, False),
        (1, 1, 1, False),
    ]
    named = turns.withColumn("conv_id", F.col("conv_id").cast("string"))
    assert dict(segment_stream(named).dtypes)["conv_id"] == "string"
