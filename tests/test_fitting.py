"""Turns that cannot be scored, set aside while the others are scored."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import models
from seamline import SegmenterConfig, segment, set_aside
from seamline.operators.fitting import EDGE, _OnePass, score_fit_turns

SCHEMA = "conv_id bigint, turn bigint, embedding array<double>, note string"


def table(rng, lengths, unfit=0.3):
    """Dialogues with unfit turns among the others, whole stretches of them too."""
    bad = [[0.0, 0.0, 0.0], [1.0, 2.0], [float("nan"), 1.0, 1.0], None]
    rows = []
    for conv, n in enumerate(lengths):
        share = rng.choice([0.0, unfit, 0.9, 1.0], p=[0.2, 0.5, 0.2, 0.1])
        for turn in range(n):
            vector = bad[rng.integers(4)] if rng.random() < share else rng.normal(size=3).tolist()
            rows.append((conv, turn * 3 + 1, vector, f"{conv}-{turn}"))
    return rows


def expected(rows, config):
    """Scores of each dialogue's fit turns, as if the others had not come."""
    found, aside = {}, []
    for conv, turn, vector, note in rows:
        if vector is None or len(vector) != 3 or not np.isfinite(vector).all() or not np.any(vector):
            aside.append((conv, turn))
        else:
            found.setdefault(conv, []).append((vector, note))
    scores = {
        c: models.score([v for v, _ in f], config.ctx_window, config.ctx_decay, config.ctx_blend_a, config.warmup == "legacy")
        for c, f in found.items()
    }
    return scores, {c: [n for _, n in f] for c, f in found.items()}, sorted(aside)


@pytest.mark.parametrize(
    "seed, window, chunk, engine",
    [(0, 2, 16_384, "arrow"), (1, 2, 3, "arrow"), (2, 3, 3, "arrow"), (3, 1, 1, "arrow"), (4, 4, 7, "arrow"), (5, 2, 4, "jvm")],
)
def test_equals_the_model_for_any_chunks(spark, seed, window, chunk, engine):
    rng = np.random.default_rng(seed)
    rows = table(rng, [1, 2, 7, 12, 29, 40, 6, 6, 21, 3])
    config = SegmenterConfig(
        delta_star=0.9, ctx_window=window, dim=3, chunk_turns=chunk, engine=engine, warmup=("paper", "legacy")[seed % 2]
    )
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    done = segment(turns, config, keep=["note"], unfit="aside")
    scores, notes, aside = expected(rows, config)
    got = done.topics.orderBy("conv_id", "turn").collect()
    found = {}
    for row in got:
        found.setdefault(row.conv_id, []).append(row)
    assert {c: [r.turn for r in rs] for c, rs in found.items()} == {c: list(range(len(s))) for c, s in scores.items()}
    assert {c: [r.note for r in rs] for c, rs in found.items()} == notes
    for conv, rs in found.items():
        assert [r.delta_eff for r in rs] == pytest.approx(scores[conv], abs=1e-9)
        assert [r.topic_id for r in rs] == models.topics([r.delta_eff for r in rs], config.delta_star)
    assert sorted((r.conv_id, r.turn) for r in done.unfit.collect()) == aside
    # The reports rest on the same turns.
    ends = {(r.conv_id, r.topic_id): r.end_exclusive for r in done.segments().collect()}
    assert sum(r.is_boundary for r in got) + len(found) == len(ends)


def test_same_as_setting_aside_first(spark):
    rng = np.random.default_rng(9)
    config = SegmenterConfig(delta_star=0.9, dim=3, chunk_turns=5)
    turns = spark.createDataFrame(table(rng, [4, 11, 33, 18]), SCHEMA)
    fit, invalid = set_aside(turns, 3)
    first, once = segment(fit, config), segment(turns, config, unfit="aside")

    def rows(df):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())

    assert rows(once.history()) == rows(first.history())
    assert rows(once.unfit) == rows(invalid.select("conv_id", "turn", "reason"))
    assert rows(once.strength_rollup().na.fill(-1)) == rows(first.strength_rollup().na.fill(-1))
    assert rows(once.end_turn_labels()) == rows(first.end_turn_labels())


@pytest.mark.parametrize("chunk", (16_384, 4))
def test_each_text_is_encoded_once(spark, chunk):
    calls = spark.sparkContext.accumulator(0)

    def encoder(column):
        @F.udf("array<double>")
        def encode(text):
            calls.add(1)
            return [float(len(text)), 1.0] if text else [0.0, 0.0]

        return encode(column)

    rows = [(c, t, "x" * (t % 5)) for c, n in enumerate((3, 30, 9)) for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    config = SegmenterConfig(delta_star=0.2, chunk_turns=chunk)
    done = segment(turns, config, encoder=encoder, keep=["text"], unfit="aside")
    assert done.unfit.count() == sum(not text for *_, text in rows)
    assert done.segments().count() and done.segment_text().count() and done.summary().count()
    assert calls.value == len(rows)


def test_order_and_length_are_still_checked(spark):
    turns = spark.createDataFrame([(0, t, [1.0, 0.0, 0.0], "") for t in (0, 1, 3)], SCHEMA)
    with pytest.raises(PySparkException, match="must number each dialogue"):
        score_fit_turns(turns, SegmenterConfig(), longest=4)
    dense = turns.withColumn("turn", F.least("turn", F.lit(2)))
    with pytest.raises(PySparkException, match="longer than"):
        score_fit_turns(dense, SegmenterConfig(chunk_turns=2), longest=2)
    with pytest.raises(ValueError, match="unfit must be"):
        segment(dense, unfit="drop")
    none = segment(turns.limit(0), unfit="aside")
    assert none.segments().count() == none.unfit.count() == 0
    lost = segment(turns.withColumn("embedding", F.array(F.lit(0.0))), unfit="aside")
    assert lost.history().count() == 0 and lost.unfit.count() == 3


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_edges_of_many_chunks_leave_the_pass_together(size):
    """The first and last two fit turns of every chunk that has a neighbour, in a few batches."""
    rng = np.random.default_rng(4)
    turns = [(conv, turn) for conv in range(300) for turn in range(rng.integers(1, 22))]
    fit = rng.random(len(turns)) < 0.8
    rows = [(c, t // 5, t, [1.0, 2.0] if f else [0.0, 0.0]) for (c, t), f in zip(turns, fit)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())]
    columns = [pa.array(list(v), k) for v, k in zip(zip(*rows), kinds)]
    whole = pa.RecordBatch.from_arrays(columns, ["conv_id", "chunk", "turn", "embedding"])
    batches = [whole.slice(at, size) for at in range(0, len(rows), size)]
    out = list(_OnePass(SegmenterConfig(chunk_turns=5), False, True)(iter(batches)))
    found = [(r["conv_id"], r["chunk"], r["input_turn"]) for b in out for r in b.to_pylist() if r["kind"] == EDGE]
    chunks: dict = {}
    for (conv, chunk, turn, _), good in zip(rows, fit):
        chunks.setdefault((conv, chunk), []).append((turn, good))
    wanted = []
    for (conv, chunk), own in chunks.items():
        good = [t for t, g in own if g]
        if chunk or len(own) == 5:
            wanted += [(conv, chunk, t) for i, t in enumerate(good) if i < 2 or i >= len(good) - 2]
    assert sorted(found) == sorted(wanted)
    assert size < 10_000 or len(out) <= 10
