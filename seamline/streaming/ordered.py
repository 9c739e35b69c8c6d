"""Turns that arrive out of order, put in order before they are scored.

A dialogue's turns wait in a list state until the watermark says that no earlier one can
come: a turn is decided on once the watermark has passed its event time, and all turns
waiting up to there are taken by ``turn``. So turns may be late by as much as the
watermark's delay, over any number of micro-batches, and the decisions are those of the
batch job. Where turns are known to number a dialogue 0, 1, 2, .. (``dense``), a turn
whose predecessor has been decided on need not wait, and only gaps do.

What waits is what lies within the delay; a turn that comes later still is dropped by
Spark, which counts it (``numRowsDroppedByWatermark``). Event time must not decrease with
``turn``; a turn that lies behind one decided on is passed through as ``late``.

``segments_from_stream`` hands out a segment as soon as the turn that closes it has been
decided on. A dialogue's last segment is closed by the turn that is marked as its end, or
by an event-time timer once the dialogue has been silent for ``idle_ms``; its state is
then given up, and a later turn begins the dialogue anew. Texts of an open segment wait
in a list state of their own, at most ``part_turns`` of them: a longer segment is handed
out in parts.

The state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from seamline.config import SegmenterConfig
from seamline.operators.topics import PART_TURNS
from seamline.streaming.online import READOUT, START, STATE, UNFIT, decide

#: The setting that names the state store, and the store the operators here need (fixed values of Spark).
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Event time of the last turn of a dialogue, its end if that has come, and the timers that are set.
CLOCK = "last_ms bigint, end_turn bigint, release_ms bigint, idle_ms bigint"
WAITING = "turn bigint, ms bigint, embedding array<double>, text string"
#: Digits that a time in this unit has below the millisecond.
_DIGITS = {"ns": 6, "us": 3, "ms": 0}
OPEN = "topic_id bigint, part bigint, start bigint, stop bigint"


def segment_stream_in_order(
    turns: DataFrame,
    config: SegmenterConfig = SegmenterConfig(),
    *,
    time: str = "time",
    dense: bool = False,
    unfit: str = "stop",
    idle_ms: int | None = None,
    end: str | None = None,
) -> DataFrame:
    """Decisions of ``segment_stream`` for a streaming ``(conv_id, turn, embedding, time)``.

    ``turns`` must have a watermark on ``time``. ``end`` names a boolean column that is
    true on a dialogue's last turn.
    """
    processor = _InOrder(config, dense, unfit, idle_ms)
    return _applied(turns, time, end, None, processor, f"input_turn bigint, turn bigint, {READOUT}")


def segments_from_stream(
    turns: DataFrame,
    config: SegmenterConfig = SegmenterConfig(),
    *,
    time: str = "time",
    dense: bool = False,
    unfit: str = "stop",
    idle_ms: int | None = None,
    end: str | None = None,
    text: str | None = None,
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """Segments of a streaming turn table as they close: ``(conv_id, topic_id, start, end_exclusive)``.

    With ``text``, the name of a column, also ``part`` and ``texts``, as ``segment_text`` gives them.
    """
    processor = _Segments(config, dense, unfit, idle_ms, text is not None, part_turns)
    more = "" if text is None else ", part bigint, texts array<string>"
    return _applied(turns, time, end, text, processor, f"topic_id bigint, start bigint, end_exclusive bigint{more}")


def _applied(turns: DataFrame, time: str, end: str | None, text: str | None, processor: "_InOrder", schema: str) -> DataFrame:
    if processor.unfit not in UNFIT:
        raise ValueError(f"unfit must be one of {UNFIT}")
    if not turns.isStreaming:
        raise ValueError("turns must be a stream; segment takes a table")
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col(time).alias("time"),
        F.coalesce(F.col(end), F.lit(False)).alias("ends") if end else F.lit(False).alias("ends"),
        (F.col(text) if text else F.lit(None).cast("string")).alias("text"),
    )
    return rows.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=f"conv_id {kind}, {schema}",
        outputMode="Append",
        timeMode="EventTime",
    )


def _plain(value: Any) -> Any:
    return None if value is None or value is pd.NaT or (isinstance(value, float) and value != value) else value


class _InOrder(StatefulProcessor):
    """Puts a dialogue's turns in order and decides on them."""

    def __init__(self, config: SegmenterConfig, dense: bool, unfit: str, idle_ms: int | None) -> None:
        self.config, self.dense, self.unfit, self.silence = config, dense, unfit, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", STATE)
        self.clock = handle.getValueState("clock", CLOCK)
        self.waiting = handle.getListState("waiting", WAITING)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last_ms, end_turn, release, idle = self._clock()
        for part in rows:
            ms = part["time"].astype("int64") // 10 ** _DIGITS[part["time"].dt.unit]
            items = [
                (int(t), int(at), None if v is None else [float(x) for x in v], _plain(text))
                for t, at, v, text in zip(part["turn"], ms, part["embedding"], part["text"])
            ]
            self.waiting.appendList(items)
            last_ms = max(filter(lambda x: x is not None, (last_ms, int(ms.max()))))
            if part["ends"].any():
                end_turn = int(part["turn"][part["ends"]].max())
        yield from self._settled(key, timerValues, (last_ms, end_turn, release, idle))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        last_ms, end_turn, release, idle = self._clock()
        # A timer that has fired is gone.
        fired = expiredTimerInfo.getExpiryTimeInMs()
        release, idle = (None if t == fired else t for t in (release, idle))
        yield from self._settled(key, timerValues, (last_ms, end_turn, release, idle))

    def _clock(self) -> tuple:
        return self.clock.get() if self.clock.exists() else (None, None, None, None)

    def _settled(self, key: Any, timers: Any, clock: tuple) -> Iterator[pd.DataFrame]:
        """Decide on what need not wait any longer, and set the timers for the rest."""
        last_ms, end_turn, release, idle = clock
        now = timers.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get(), key=lambda r: r[0]) if self.waiting.exists() else []
        memory = self.memory.get() if self.memory.exists() else START
        ready = sum(1 for r in waiting if r[1] <= now)
        if ready:
            # All up to the last turn whose time has passed, so that their order is kept.
            ready = max(i for i, r in enumerate(waiting) if r[1] <= now) + 1
        if self.dense:
            upto = memory[2] if ready == 0 else waiting[ready - 1][0]
            following = 0 if upto is None else upto + 1
            while ready < len(waiting) and waiting[ready][0] <= following:
                following = max(following, waiting[ready][0] + 1)
                ready += 1
        closed = False
        if ready:
            rows = pd.DataFrame(waiting[:ready], columns=["turn", "ms", "embedding", "text"])
            rows.insert(0, "conv_id", key[0])
            after, out = decide(memory, rows, self.config, self.unfit)
            waiting = waiting[ready:]
            if waiting:
                self.waiting.put(waiting)
            else:
                self.waiting.clear()
            if after is not memory:
                self.memory.update(after)
            closed = end_turn is not None and not waiting and rows["turn"].iloc[-1] >= end_turn
            yield from self._handed_out(key, rows, out)
        if not waiting and self.silence is not None and last_ms is not None:
            closed |= last_ms + self.silence <= now
        due = None if closed or not waiting else min(r[1] for r in waiting)
        silent = None if closed or self.silence is None or last_ms is None else last_ms + self.silence
        held = {t for t in (release, idle) if t is not None}
        wanted = {t for t in (due, silent) if t is not None}
        for at in held - wanted:
            self.handle.deleteTimer(at)
        for at in wanted - held:
            self.handle.registerTimer(at)
        if closed:
            yield from self._closed(key)
            for state in (self.memory, self.clock, self.waiting):
                state.clear()
        else:
            self.clock.update((last_ms, end_turn, due, silent))

    def _handed_out(self, key: Any, rows: pd.DataFrame, out: pd.DataFrame) -> Iterator[pd.DataFrame]:
        yield out

    def _closed(self, key: Any) -> Iterator[pd.DataFrame]:
        return iter(())


class _Segments(_InOrder):
    """Hands out segments instead of decisions."""

    def __init__(self, config, dense, unfit, idle_ms, with_text: bool, part_turns: int) -> None:
        super().__init__(config, dense, unfit, idle_ms)
        self.with_text, self.part_turns = with_text, part_turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", OPEN)
        if self.with_text:
            self.texts = handle.getListState("texts", "text string")

    def _handed_out(self, key: Any, rows: pd.DataFrame, out: pd.DataFrame) -> Iterator[pd.DataFrame]:
        fit = out["turn"].notna().to_numpy()
        if not fit.any():
            return
        open_ = self.open.get() if self.open.exists() else None
        texts = [t for (t,) in self.texts.get()] if self.with_text and open_ and self.texts.exists() else []
        done = []
        for place, topic, text in zip(out["turn"][fit], out["topic_id"][fit], rows["text"].to_numpy()[fit]):
            full = self.with_text and open_ is not None and open_[3] - open_[2] >= self.part_turns
            if open_ is not None and (topic != open_[0] or full):
                done.append(self._segment(key, open_, texts))
                texts = []
                open_ = (int(topic), open_[1] + 1 if topic == open_[0] else 0, int(place), int(place))
            elif open_ is None:
                open_ = (int(topic), 0, int(place), int(place))
            open_ = (*open_[:3], int(place) + 1)
            texts.append(_plain(text))
        self.open.update(open_)
        if self.with_text:
            self.texts.put([(t,) for t in texts])
        if done:
            yield self._frame(done)

    def _closed(self, key: Any) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            texts = [t for (t,) in self.texts.get()] if self.with_text and self.texts.exists() else []
            yield self._frame([self._segment(key, self.open.get(), texts)])
            self.open.clear()
            if self.with_text:
                self.texts.clear()

    def _segment(self, key: Any, open_: tuple, texts: list) -> tuple:
        topic, part, start, stop = open_
        return (key[0], topic, start, stop, part, texts) if self.with_text else (key[0], topic, start, stop)

    def _frame(self, done: list[tuple]) -> pd.DataFrame:
        names = ["conv_id", "topic_id", "start", "end_exclusive", "part", "texts"]
        return pd.DataFrame(done, columns=names[: len(done[0])])
