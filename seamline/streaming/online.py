"""Scoring turns as they arrive.

Each dialogue is a key of a stateful operator whose state is the last m unit
vectors, a topic counter and a turn counter; it does not grow with the
dialogue. The numbers are those of the batch job. Input order is the only
clock: within a micro-batch turns are taken by ``turn``, and a turn that is not
later than the last one seen is passed through with ``late = true`` and no
score, so that nothing already decided changes. With ``unfit="aside"`` a vector
that cannot be scored is passed through the same way with its ``reason``, and the
dialogue goes on as if the turn had not come; otherwise it stops the query.

A dialogue's state lives in one task, so the share of one dialogue in a
micro-batch is what that task holds. Bound the batch at the source
(``maxFilesPerTrigger``, ``maxBytesPerTrigger``, ``maxOffsetsPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from seamline.config import SegmenterConfig
from seamline.functions.vectors import problems
from seamline.operators.scoring import distances, unit_rows

STATE = "seen bigint, topic_id bigint, last_turn bigint, dim int, recent array<double>"
READOUT = "topic_id bigint, is_boundary boolean, delta_eff double, graded_score double, late boolean, reason string"
COLUMNS = ["conv_id", "input_turn", "turn", "topic_id", "is_boundary", "delta_eff", "graded_score", "late", "reason"]
NULLABLE = {
    "turn": "Int64",
    "topic_id": "Int64",
    "is_boundary": "boolean",
    "delta_eff": "float64",
    "graded_score": "float64",
    "reason": "object",
}
UNFIT = ("stop", "aside")


def segment_stream(
    turns: DataFrame,
    config: SegmenterConfig = SegmenterConfig(),
    *,
    unfit: str = "stop",
    idle_timeout_ms: int | None = None,
) -> DataFrame:
    """Decide on every turn of a streaming ``(conv_id, turn, embedding)``.

    The output repeats the incoming turn value as ``input_turn``; ``turn`` is
    the position in the dialogue. With ``idle_timeout_ms`` a dialogue that has
    been silent that long is forgotten and starts anew when it returns.
    """
    if unfit not in UNFIT:
        raise ValueError(f"unfit must be one of {UNFIT}")
    key_type = turns.schema["conv_id"].dataType.simpleString()
    timeout = (
        GroupStateTimeout.NoTimeout if idle_timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )
    return (
        turns.select("conv_id", "turn", "embedding")
        .groupBy("conv_id")
        .applyInPandasWithState(
            _stepper(config, unfit, idle_timeout_ms),
            f"conv_id {key_type}, input_turn bigint, turn bigint, {READOUT}",
            STATE,
            "append",
            timeout,
        )
    )


def _reasons(vectors: list, dim: int | None) -> np.ndarray:
    """Why each vector cannot be scored; with no length given the first fit one sets it."""
    found = problems(pa.array(vectors, pa.list_(pa.float64())), dim)
    if dim is None:
        sizes = np.array([0 if v is None else len(v) for v in vectors])
        fit = np.flatnonzero(found == None)  # noqa: E711  elementwise
        found[fit[sizes[fit] != sizes[fit[0]]] if len(fit) else fit] = "dimension"
    return found


#: What a dialogue that has not begun remembers: turns seen, topic, last turn, vector length, recent vectors.
START = (0, 0, None, 0, [])


def decide(memory: tuple, rows: pd.DataFrame, config: SegmenterConfig, unfit: str) -> tuple[tuple, pd.DataFrame]:
    """Decide on turns in the order given, after what ``memory`` holds; the new memory and a row per turn."""
    seen, topic, last_turn, dim, flat = memory
    turn = rows["turn"].to_numpy()
    sound = np.ones(len(turn), dtype=bool)
    reasons = np.full(len(turn), None, dtype=object)
    if unfit == "aside":
        reasons = _reasons(rows["embedding"].tolist(), config.dim or dim or None)
        sound = reasons == None  # noqa: E711  elementwise
    # A turn set aside leaves no trace: the next one may even repeat its number.
    fresh = sound.copy()
    before = np.maximum.accumulate(np.where(sound, turn, np.iinfo(np.int64).min))
    fresh[1:] &= turn[1:] > before[:-1]
    if last_turn is not None:
        fresh &= turn > last_turn
    out = pd.DataFrame({"conv_id": rows["conv_id"].to_numpy(), "input_turn": turn})
    out = out.reindex(columns=COLUMNS).astype(NULLABLE)
    out["late"] = sound & ~fresh
    out["reason"] = reasons
    count = int(fresh.sum())
    if count:
        m = config.ctx_window
        units = unit_rows(pa.array(rows["embedding"][fresh].tolist()), config.dim or dim or None)
        past = np.reshape(flat, (-1, units.shape[1]))
        window = np.concatenate([np.zeros((m - len(past), units.shape[1])), past, units])
        place = seen + np.arange(count)
        _, _, delta = distances(window, units, np.minimum(place, m), config)
        boundary = (place > 0) & (delta >= config.delta_star)
        topics = topic + np.cumsum(boundary)
        out.loc[fresh, "turn"] = place
        out.loc[fresh, "topic_id"] = topics
        out.loc[fresh, "is_boundary"] = boundary
        out.loc[fresh, "delta_eff"] = delta
        out.loc[fresh, "graded_score"] = delta / config.delta_star
        recent = window[len(window) - min(m, seen + count) :]
        memory = (seen + count, int(topics[-1]), int(turn[fresh][-1]), units.shape[1], recent.ravel().tolist())
    return memory, out


def _stepper(
    config: SegmenterConfig, unfit: str, idle_timeout_ms: int | None
) -> Callable[..., Iterator[pd.DataFrame]]:
    def step(key: tuple[Any], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        memory = state.get if state.exists else START
        rows = pd.concat(batches).sort_values("turn", kind="stable")
        after, out = decide(memory, rows, config, unfit)
        if after is not memory:
            state.update(after)
        if idle_timeout_ms is not None:
            state.setTimeoutDuration(idle_timeout_ms)
        yield out

    return step
