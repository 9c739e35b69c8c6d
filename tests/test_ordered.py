"""Streams whose turns come out of order, and segments handed out as they close."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import models
from seamline import SegmenterConfig, segment, segment_stream_in_order, segments_from_stream
from seamline.streaming.ordered import STORE, STORE_SETTING

CONFIG = SegmenterConfig(delta_star=0.95, ctx_window=3, warmup="legacy")
SCHEMA = "conv_id bigint, turn bigint, second bigint, embedding array<double>, text string, ends boolean"


@pytest.fixture(autouse=True)
def rocks(spark):
    before = spark.conf.get(STORE_SETTING)
    spark.conf.set(STORE_SETTING, STORE)
    yield
    spark.conf.set(STORE_SETTING, before)


class Feed:
    """A folder of files, each a micro-batch, and a stream over it."""

    def __init__(self, spark, folder, segmenter, delay="10 seconds"):
        self.spark, self.folder, self.delay = spark, folder, delay
        self.segmenter = segmenter

    def add(self, rows):
        df = self.spark.createDataFrame(rows, SCHEMA).withColumn("time", F.timestamp_seconds(F.col("second") + 1_000_000)).drop("second")
        df.coalesce(1).write.mode("append").parquet(str(self.folder / "in"))
        self.schema = df.schema

    def run(self):
        feed = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.folder / "in"))
        done = self.segmenter(feed.withWatermark("time", self.delay))
        query = (
            done.writeStream.format("parquet")
            .option("checkpointLocation", str(self.folder / "state"))
            .trigger(availableNow=True)
            .start(str(self.folder / "out"))
        )
        assert query.awaitTermination(240)
        self.progress = query.recentProgress
        return self.spark.read.schema(done.schema).parquet(str(self.folder / "out"))


def one(conv, turn, vector, second=None, text="", ends=False):
    return (conv, turn, turn if second is None else second, vector, text, ends)


def late(rng, rows, most):
    """The rows in files of four turns, each row up to ``most`` turns late."""
    files = {}
    for row in rows:
        files.setdefault((row[1] + int(rng.integers(0, most + 1))) // 4, []).append(row)
    return [files[k] for k in sorted(files)]


def test_late_turns_over_many_batches_and_a_restart(spark, tmp_path):
    rng = np.random.default_rng(1)
    lengths = (1, 2, 9, 40, 33)
    rows = [one(c, t, rng.normal(size=4).tolist()) for c, n in enumerate(lengths) for t in range(n)]
    feed = Feed(spark, tmp_path, lambda turns: segment_stream_in_order(turns, CONFIG))
    files = late(rng, rows, 5)
    for file in files[:5]:
        feed.add(file)
    first = feed.run()
    # What waits is bounded by the delay, and a dialogue's other state is two rows.
    some = max(s["numRowsTotal"] for p in feed.progress for s in p["stateOperators"])
    assert 0 < some <= 2 * len(lengths) + len(lengths) * (10 + 6 + 4) + 4 * len(lengths)
    early = first.count()
    assert early < sum(map(len, files[:5]))
    for file in files[5:]:
        feed.add(file)
    feed.add([one(99, 0, [1.0] * 4, 10**6)])
    got = feed.run().where("conv_id < 99")
    want = segment(spark.createDataFrame(rows, SCHEMA), CONFIG).history()
    assert got.count() == len(rows) and got.where("late").count() == 0
    for name in ("topic_id", "is_boundary"):
        assert models.gather(got, name) == models.gather(want, name)
    scores, expected = models.gather(got, "delta_eff"), models.gather(want, "delta_eff")
    assert all(scores[c] == pytest.approx(expected[c], abs=1e-12) for c in expected)


def test_dense_turns_do_not_wait_and_gaps_do(spark, tmp_path):
    config = SegmenterConfig(delta_star=0.5, ctx_window=1)
    feed = Feed(spark, tmp_path, lambda turns: segment_stream_in_order(turns, config, dense=True, unfit="aside"))

    def found():
        rows = feed.run().where("conv_id = 1").orderBy("input_turn").collect()
        return [(r.input_turn, r.turn, r.topic_id, r.late, r.reason) for r in rows]

    feed.add([one(1, 1, [1.0, 0.0]), one(1, 0, [1.0, 0.0]), one(1, 3, [0.0, 1.0])])
    assert found() == [(0, 0, 0, False, None), (1, 1, 0, False, None)]
    # Turn 2 comes in time, turn 4 never does: 5 waits until the watermark has passed it.
    feed.add([one(1, 2, [0.0, 0.0]), one(1, 5, [0.0, 1.0])])
    assert found()[2:] == [(2, None, None, False, "zero"), (3, 2, 1, False, None)]
    feed.add([one(2, 0, [1.0, 0.0], 16)])
    assert found()[4:] == [(5, 3, 1, False, None)]
    # Spark drops what comes behind the watermark.
    feed.add([one(1, 4, [0.0, 1.0], 4)])
    assert len(found()) == 5
    assert sum(s["numRowsDroppedByWatermark"] for p in feed.progress for s in p["stateOperators"]) == 1


@pytest.mark.parametrize("part_turns", (2, 100))
def test_segments_close_by_turn_by_mark_and_by_silence(spark, tmp_path, part_turns):
    rng = np.random.default_rng(4)
    lengths = (1, 3, 17, 26)
    rows = [
        one(c, t, rng.normal(size=3).tolist(), text=f"{c}:{t}", ends=c % 2 == 1 and t == n - 1)
        for c, n in enumerate(lengths)
        for t in range(n)
    ]
    feed = Feed(
        spark,
        tmp_path,
        lambda turns: segments_from_stream(turns, CONFIG, idle_ms=30_000, end="ends", text="text", part_turns=part_turns),
    )
    for file in late(rng, rows, 5):
        feed.add(file)
    done = feed.run()
    # Dialogue 1 has ended long ago, dialogue 3 not yet by the watermark.
    assert done.where("conv_id = 1").agg(F.max("end_exclusive")).first()[0] == 3
    want = segment(spark.createDataFrame(rows, SCHEMA), CONFIG, keep=["text"]).segment_text(part_turns)
    names = ["conv_id", "topic_id", "part", "start", "end_exclusive", "texts"]
    expected = sorted(tuple(r[c] for c in names) for r in want.collect())
    before = sorted(tuple(r[c] for c in names) for r in done.collect())
    assert set(map(repr, before)) < set(map(repr, expected))
    feed.add([one(99, 0, [1.0] * 3, 1000)])
    got = sorted(tuple(r[c] for c in names) for r in feed.run().where("conv_id < 99").collect())
    assert got == expected
    # All state is given up but that of the last dialogue, and a dialogue that returns begins anew.
    assert feed.progress[-1]["stateOperators"][0]["numRowsTotal"] <= 6
    feed.add([one(3, 40, [1.0] * 3, 1001, "again", True), one(99, 1, [1.0] * 3, 3000)])
    again = [tuple(r[c] for c in names) for r in feed.run().where("conv_id = 3").collect()]
    assert (3, 0, 0, 0, 1, ["again"]) in again


def test_only_streams_are_taken(spark):
    table = spark.createDataFrame([one(1, 0, [1.0])], SCHEMA).withColumn("time", F.timestamp_seconds("second"))
    with pytest.raises(ValueError, match="must be a stream"):
        segments_from_stream(table)
    with pytest.raises(ValueError, match="unfit must be"):
        segment_stream_in_order(table, unfit="drop")
