"""Distance of every turn from what came before it.

Input is a turn table ``(conv_id, turn, embedding)`` (or ``text`` with an
encoder) whose ``turn`` numbers each dialogue 0..n-1. Output has one row per
turn:

``d_prev``     cosine distance to the previous turn, null on turn 0
``d_ctx``      cosine distance to the decayed sum of the last m unit vectors,
               null where there is none
``delta_eff``  the blend of both, 0 on turn 0

A turn needs only its m predecessors. A long dialogue is therefore cut into
chunks, each chunk gets the last m turns before it once more, and the chunks
are spread over the cluster: one shuffle, whatever the length of a dialogue.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.config import SegmenterConfig
from seamline.functions.encoders import Encoder
from seamline.functions.vectors import MIN_NORM, dot, doubles, norm, problem, scaled
from seamline.operators.prefix import chunk_of

DISTANCES = ("d_prev", "d_ctx", "delta_eff")
MARKS = ("chunk_topic", "chunk_start")
NOT_DENSE = "turn must number each dialogue 0..n-1; see dense_turns"
BAD_VECTOR = "embeddings must be finite, nonzero and of one dimension in a dialogue"

TOO_LONG = "a dialogue is longer than `longest` says"

#: Values of a matrix worked on at a time, so that it stays in the CPU cache.
BLOCK_VALUES = 1 << 18


def score_turns(
    turns: DataFrame,
    config: SegmenterConfig = SegmenterConfig(),
    *,
    longest: int | None = None,
    encoder: Encoder | None = None,
    keep: Sequence[str] = (),
    mark: bool = False,
) -> DataFrame:
    """Score a turn table. ``longest`` is the length of the longest dialogue if
    it is known (``dense_turns`` reports it); a longer dialogue than it says stops
    the job. ``keep`` names columns to pass on. Vectors must have one length in a
    dialogue, not in the table.

    With an ``encoder`` the texts are shuffled and encoded afterwards, because
    they are smaller than their vectors.

    ``mark`` adds, for ``config.delta_star`` and while a chunk is at hand in
    order, ``chunk_topic``, the boundaries so far in the chunk, and
    ``chunk_start``, the turn of the last one. ``assign_topics`` builds on them.
    """
    payload = [c for c in keep if c not in ("conv_id", "turn")]
    vector = "embedding" if encoder is None else "text"
    columns = dict.fromkeys(["conv_id", "turn", vector, *payload])
    chunks = _with_chunks(turns.select(*columns), config, longest)
    score = _score_arrow if config.engine == "arrow" else _score_jvm
    return score(chunks, config, encoder, payload, mark)


def _with_chunks(turns: DataFrame, config: SegmenterConfig, longest: int | None) -> DataFrame:
    size, reach = config.chunk_turns, config.ctx_window
    if longest is not None and longest <= size:
        return turns.withColumn("chunk", F.lit(0).cast("bigint"))
    own = chunk_of(F.col("turn"), size)
    near_end = F.col("turn") % size >= size - reach
    chunks = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return turns.select("*", F.explode(chunks).alias("chunk"))


def own_turns(own: Column, copied: Column) -> Column:
    """Filter for the turns of a chunk itself. What is neither its own nor there as
    a copy would vanish, which happens if a chunk is longer than was said."""
    lost = F.raise_error(F.lit(TOO_LONG)).cast("boolean")
    return F.when(own, True).when(copied, False).otherwise(lost)


# --------------------------------------------------------------------- arrow


def _score_arrow(
    chunks: DataFrame, config: SegmenterConfig, encoder: Encoder | None, payload: list[str], mark: bool
) -> DataFrame:
    placed = chunks.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn")
    if encoder is not None:
        placed = placed.withColumn("embedding", encoder(F.col("text")))
    placed = placed.select("conv_id", "chunk", "turn", "embedding", *payload)
    fields = [placed.schema["conv_id"], placed.schema["turn"], *[placed.schema[c] for c in payload]]
    fields += [T.StructField(d, T.DoubleType()) for d in DISTANCES]
    fields += [T.StructField(name, T.LongType()) for name in MARKS if mark]
    return placed.mapInArrow(Scorer(config, mark), T.StructType(fields))


class Scorer:
    """Scores the sorted rows of one task, batch by batch.

    Its columns are conv_id, chunk, turn, embedding and others to pass on. With ``local``
    turns count from 0 in every chunk and no chunk gets turns of another. What it holds
    between two blocks is the last m vectors of the open chunk.
    """

    def __init__(self, config: SegmenterConfig, mark: bool = False, local: bool = False) -> None:
        self.config = config
        self.mark = mark
        self.local = local
        self.tail: dict | None = None

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from self.blocks(batch)

    def blocks(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, stop, width in _runs(batch.column(3)):
            step = max(64, BLOCK_VALUES // max(width, 1))
            for begin in range(start, stop, step):
                scored, self.tail = self._block(batch.slice(begin, min(step, stop - begin)), self.tail)
                yield scored

    def _block(self, block: pa.RecordBatch, tail: dict | None) -> tuple[pa.RecordBatch, dict]:
        cfg, n = self.config, block.num_rows
        m, size = cfg.ctx_window, cfg.chunk_turns
        conv, chunk = block.column(0), block.column(1).to_numpy()
        turn = block.column(2).to_numpy()
        units = unit_rows(block.column(3), cfg.dim)

        opens = np.ones(n, dtype=bool)
        opens[1:] = pc.not_equal(conv.slice(1), conv.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        opens[1:] |= chunk[1:] != chunk[:-1]
        if tail is None or tail["key"] != (conv[0].as_py(), chunk[0]):
            tail = {"units": units[:0], "turn": -1, "topic": 0, "start": -1}
        else:
            opens[0] = False
        past, last_turn = tail["units"], tail["turn"]
        if past.size and past.shape[1] != units.shape[1]:
            raise ValueError(BAD_VECTOR)

        follows = np.concatenate(([last_turn], turn[:-1])) + 1
        expected = np.where(opens, 0 if self.local else np.maximum(chunk * size - m, 0), follows)
        if not np.array_equal(turn, expected):
            raise ValueError(NOT_DENSE)

        # Row i of ``window`` lies m - i rows before the block.
        window = np.concatenate([np.zeros((m - len(past), units.shape[1])), past, units])
        row = np.arange(n) + m
        group = np.maximum.accumulate(np.where(opens, row, m - len(past) if not opens[0] else m))
        depth = np.minimum(row - group, m)

        d_prev, d_ctx, delta = distances(window, units, depth, cfg)
        own = np.ones(n, dtype=bool) if self.local else turn // size == chunk
        # Only the last m turns before a chunk come with it; anything else would be lost.
        if not (own | ((turn < chunk * size) & (turn >= chunk * size - m))).all():
            raise ValueError(TOO_LONG)
        kept = block.select([0, 2, *range(4, block.num_columns)])
        columns = [
            *kept.columns,
            pa.array(d_prev, mask=np.isnan(d_prev)),
            pa.array(d_ctx, mask=np.isnan(d_ctx)),
            pa.array(delta),
        ]
        names = [*kept.schema.names, *DISTANCES]
        state = {"topic": 0, "start": -1}
        if self.mark:
            topic, began = _marks(opens, own, turn, delta >= cfg.delta_star, tail)
            columns += [pa.array(topic), pa.array(began, mask=began < 0)]
            names += MARKS
            state = {"topic": int(topic[-1]), "start": int(began[-1])}
        scored = pa.RecordBatch.from_arrays(columns, names=names)
        if not own.all():
            scored = scored.filter(pa.array(own))
        reach = min(m, int(row[-1] - group[-1]) + 1)
        state |= {
            "key": (conv[n - 1].as_py(), chunk[-1]),
            "turn": int(turn[-1]),
            "units": window[len(window) - reach :].copy(),
        }
        return scored, state


def _runs(vectors: pa.Array) -> Iterator[tuple[int, int, int]]:
    """Stretches of vectors of one length: dialogues may differ in it."""
    widths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(widths)) + 1
    for start, stop in zip([0, *cuts], [*cuts, len(widths)]):
        if stop > start:
            yield int(start), int(stop), int(widths[start])


def distances(
    window: np.ndarray, units: np.ndarray, depth: np.ndarray, config: SegmenterConfig
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``d_prev``, ``d_ctx`` (NaN: there is none) and ``delta_eff`` of unit vectors.

    ``window`` is the m vectors before the first one, then the vectors
    themselves; ``depth`` says how many of the m before each one belong to its
    dialogue.
    """
    m, n = config.ctx_window, len(units)
    d_prev = np.where(depth >= 1, 1.0 - _row_dots(window[m - 1 : m - 1 + n], units), np.nan)
    context = np.zeros_like(units)
    for i in range(1, m + 1):
        weight = np.where(depth >= i, config.ctx_decay ** (i - 1), 0.0)
        context += weight[:, None] * window[m - i : m - i + n]
    length = np.sqrt(_row_dots(context, context))
    there = length > MIN_NORM
    d_ctx = np.where(there, 1.0 - _row_dots(context, units) / np.where(there, length, 1.0), np.nan)
    if config.warmup == "paper":
        d_ctx = np.where(depth < m, d_prev, d_ctx)
    blend = config.ctx_blend_a * d_prev + (1.0 - config.ctx_blend_a) * d_ctx
    delta = np.where(depth >= 1, np.where(np.isnan(d_ctx), d_prev, blend), 0.0)
    return d_prev, d_ctx, delta


def _marks(
    opens: np.ndarray, own: np.ndarray, turn: np.ndarray, reached: np.ndarray, tail: dict
) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries so far in the chunk of each row and the turn of the last one,
    -1 where the chunk has had none yet."""
    at = np.arange(len(turn))
    boundary = own & (turn > 0) & reached
    so_far = np.cumsum(boundary)
    opened = np.maximum.accumulate(np.where(opens, at, -1))
    continues = opened < 0
    before = np.where(continues, -tail["topic"], (so_far - boundary)[opened])
    last = np.maximum.accumulate(np.where(boundary | (own & (turn == 0)), at, -1))
    began = np.where(last >= np.maximum(opened, 0), turn[last], np.where(continues, tail["start"], -1))
    return so_far - before, began


def unit_rows(vectors: pa.Array, dim: int | None) -> np.ndarray:
    """The vectors of an Arrow list column as rows of unit length."""
    widths = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if vectors.null_count or len(widths) != 1 or widths[0] < 1 or (dim is not None and widths[0] != dim):
        raise ValueError(BAD_VECTOR)
    values = vectors.flatten()
    if values.null_count:
        raise ValueError(BAD_VECTOR)
    rows = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), widths[0])
    lengths = np.sqrt(_row_dots(rows, rows))
    if not (np.isfinite(rows).all() and np.isfinite(lengths).all() and (lengths > MIN_NORM).all()):
        raise ValueError(BAD_VECTOR)
    return rows / lengths[:, None]


def _row_dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", left, right)


# ----------------------------------------------------------------------- jvm


def _score_jvm(
    chunks: DataFrame, config: SegmenterConfig, encoder: Encoder | None, payload: list[str], mark: bool
) -> DataFrame:
    """The same scores from built-in functions only, for clusters without
    Python workers."""
    m, size = config.ctx_window, config.chunk_turns
    if encoder is not None:
        chunks = chunks.withColumn("embedding", encoder(F.col("text")))
    vector = doubles(F.col("embedding"))
    bad = F.raise_error(F.lit(BAD_VECTOR)).cast("double")
    rows = chunks.withColumn(
        "length", F.when(problem(F.col("embedding"), config.dim).isNull(), norm(vector)).otherwise(bad)
    )
    order = Window.partitionBy("conv_id", "chunk").orderBy("turn")
    lags = range(1, m + 1)
    rows = rows.select(
        "*",
        F.lag("turn").over(order).alias("turn_1"),
        *[F.lag("embedding", i).over(order).alias(f"vector_{i}") for i in lags],
        *[F.lag("length", i).over(order).alias(f"length_{i}") for i in lags],
    )
    opens = F.col("turn") == F.greatest(F.col("chunk") * size - m, F.lit(0))
    dense = F.when(F.col("turn_1").isNull(), opens).otherwise(F.col("turn_1") == F.col("turn") - 1)
    same_size = F.coalesce(F.size("vector_1") == F.size("embedding"), F.lit(True))

    # A missing past turn takes part as a zero vector.
    none = F.array_repeat(F.lit(0.0), F.size("embedding"))
    context: Column | None = None
    for i in lags:
        weight = F.coalesce(config.ctx_decay ** (i - 1) / F.col(f"length_{i}"), F.lit(0.0))
        term = scaled(F.coalesce(doubles(F.col(f"vector_{i}")), none), weight)
        context = term if context is None else F.zip_with(context, term, lambda x, y: x + y)
    rows = (
        rows.withColumn(
            "prev",
            F.when(
                dense & same_size,
                1 - dot(vector, F.col("vector_1")) / (F.col("length") * F.col("length_1")),
            ).otherwise(F.raise_error(F.lit(f"{NOT_DENSE}, and {BAD_VECTOR}")).cast("double")),
        )
        .where(own_turns(chunk_of(F.col("turn"), size) == F.col("chunk"), F.col("turn") < F.col("chunk") * size))
        .withColumn("context", context)
        .withColumn("along", dot(F.col("context"), vector) / F.col("length"))
        .withColumn("reach", norm(F.col("context")))
    )
    d_prev = F.col("prev")
    d_ctx = F.when((F.col("turn") > 0) & (F.col("reach") > MIN_NORM), 1 - F.col("along") / F.col("reach"))
    if config.warmup == "paper":
        d_ctx = F.when(F.col("turn") < m, d_prev).otherwise(d_ctx)
    a = config.ctx_blend_a
    blend = a * F.col("d_prev") + (1 - a) * F.col("d_ctx")
    scored = (
        rows.withColumn("d_prev", d_prev)
        .withColumn("d_ctx", d_ctx)
        .withColumn("delta_eff", F.coalesce(blend, F.col("d_prev"), F.lit(0.0)))
    )
    wanted = ["conv_id", "turn", *payload, *DISTANCES]
    if not mark:
        return scored.select(wanted)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    boundary = (F.col("turn") > 0) & (F.col("delta_eff") >= config.delta_star)
    start = F.when(boundary | (F.col("turn") == 0), F.col("turn"))
    return scored.select(
        *wanted,
        F.sum(boundary.cast("bigint")).over(upto).alias("chunk_topic"),
        F.max(start).over(upto).alias("chunk_start"),
    )
