"""Strength totals over calls that are made again, cut off and put together."""

import numpy as np
from pyspark.sql import functions as F

import models
from seamline import SegmenterConfig, StrengthTotals, segment, segment_stream

CONFIG = SegmenterConfig(delta_star=0.9)
BANDS = ("very_weak", "weak", "normal", "strong")


def counts(df):
    return tuple(df.first()[b] for b in BANDS)


def band_counts(dialogues):
    """The counts that the scores of a sequential model give."""
    graded = [s / CONFIG.delta_star for d in dialogues for s in models.score(d)]
    ends = (0.7, 1.0, 1.3)
    return tuple(np.bincount(np.searchsorted(ends, graded, side="right"), minlength=4).tolist())


def test_replays_and_compaction_change_nothing(spark, tmp_path):
    rng = np.random.default_rng(0)
    calls = [[rng.normal(size=(n, 3)) for n in sizes] for sizes in ((4, 9), (1,), (7, 7, 2))]
    topics = [segment(models.turn_table(spark, c), CONFIG).topics for c in calls]
    totals = StrengthTotals(spark, f"{tmp_path}/totals")
    assert counts(totals.total()) == (0, 0, 0, 0)
    assert [totals.add(t, i) for i, t in enumerate(topics)] == [True] * 3
    expected = band_counts([d for c in calls for d in c])
    assert counts(totals.total()) == expected
    # The same batch is not run again, even if it would count otherwise.
    assert not totals.add(topics[0], 2)
    kept = (tmp_path / "totals" / "batch=1").rename(tmp_path / "aside")
    before = counts(totals.total())
    assert before == tuple(a - b for a, b in zip(expected, band_counts(calls[1])))
    kept.rename(tmp_path / "totals" / "batch=1")
    totals.compact()
    assert [p.name for p in (tmp_path / "totals").iterdir()] == ["merged=1"]
    assert counts(totals.total()) == expected and not totals.add(topics[1], 1)
    # Cut off before the old folders are gone: their rows are there twice and count once.
    totals.add(topics[0], 7)
    spark.read.parquet(f"{tmp_path}/totals/batch=7").write.parquet(f"{tmp_path}/totals/batch=8")
    both = counts(totals.total())
    assert both == tuple(a + b for a, b in zip(expected, band_counts(calls[0])))
    totals.compact()
    assert counts(totals.total()) == both
    # A folder that was not finished does not count, and is replaced.
    totals.add(topics[1], 9)
    (tmp_path / "totals" / "batch=9" / "_SUCCESS").rename(tmp_path / "gone")
    assert counts(totals.total()) == both
    assert totals.add(topics[1], 9)
    assert counts(totals.total()) == tuple(a + b for a, b in zip(both, band_counts(calls[1])))


def test_totals_of_a_stream_that_is_replayed(spark, tmp_path):
    rng = np.random.default_rng(1)
    dialogues = [rng.normal(size=(n, 3)) for n in (5, 8)]
    turns = models.turn_table(spark, dialogues)
    for first in (0, 4):
        turns.where(F.col("turn").between(first, first + 3)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    totals = StrengthTotals(spark, f"{tmp_path}/totals")
    added = []
    for state in ("one", "two"):  # the second run begins from nothing and sees the same batches
        feed = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = (
            segment_stream(feed, CONFIG)
            .writeStream.foreachBatch(lambda df, batch: added.append(totals.add_micro_batch(df, batch)))
            .option("checkpointLocation", f"{tmp_path}/{state}")
            .trigger(availableNow=True)
            .start()
        )
        assert query.awaitTermination(240)
    assert added == [True, True, False, False]
    assert counts(totals.total()) == band_counts(dialogues)
