"""Segmentation as a table function of SQL."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from seamline.config import SegmenterConfig
from seamline.streaming.online import START, decide

#: Turns decided on at a time; what is held of a dialogue besides is its last m vectors.
BATCH_TURNS = 1024
READOUT = ("turn", "topic_id", "is_boundary", "delta_eff", "graded_score")


@dataclass
class Segmenting(AnalyzeResult):
    """The result's schema with the parameters of the call."""

    config: SegmenterConfig | None = None


class SegmentTurns:
    """Decides on the turns of one dialogue, in order, batch by batch.

    The table needs ``conv_id``, ``turn`` and ``embedding``, may have further columns,
    and is partitioned by ``conv_id`` and ordered by ``turn``; the other arguments are
    those of ``SegmenterConfig``, by name. ``turn`` of the result is the position in the
    dialogue, so gaps are closed; a repeated or null turn stops the query, and so does a
    vector that cannot be scored.
    """

    @staticmethod
    def analyze(turns: AnalyzeArgument, **settings: AnalyzeArgument) -> Segmenting:
        missing = {"conv_id", "turn", "embedding"} - set(turns.dataType.names if turns.isTable else ())
        if missing:
            raise ValueError(f"segment_turns needs a table with {', '.join(sorted(missing))}")
        for name, setting in settings.items():
            if not setting.isConstantExpression:
                raise ValueError(f"{name} must be a constant")
        given = {name: setting.value for name, setting in settings.items()}
        config = SegmenterConfig(**{k: v if isinstance(v, (str, int)) else float(v) for k, v in given.items()})
        schema = T.StructType().add("conv_id", turns.dataType["conv_id"].dataType)
        for name, kind in zip(READOUT, (T.LongType(), T.LongType(), T.BooleanType(), T.DoubleType(), T.DoubleType())):
            schema.add(name, kind)
        return Segmenting(schema, config=config)

    def __init__(self, plan: Segmenting) -> None:
        self.config = plan.config
        self.memory = START
        self.held: list[tuple] = []

    def eval(self, turns: Row, **settings: Any) -> Iterator[tuple]:
        row = turns.asDict()
        if row["turn"] is None:
            raise ValueError("a turn without a number")
        self.held.append((row["conv_id"], row["turn"], row["embedding"]))
        if len(self.held) == BATCH_TURNS:
            yield from self._decided()

    def terminate(self) -> Iterator[tuple]:
        yield from self._decided()

    def _decided(self) -> Iterator[tuple]:
        if not self.held:
            return
        rows = pd.DataFrame(self.held, columns=["conv_id", "turn", "embedding"])
        self.held = []
        self.memory, out = decide(self.memory, rows, self.config, "stop")
        if out["late"].any():
            raise ValueError("a dialogue repeats a turn or its turns are not in order")
        yield from zip(rows["conv_id"].tolist(), *[out[c].tolist() for c in READOUT])


def register_tables(spark: SparkSession, name: str = "segment_turns") -> None:
    """Make the table function known to SQL in this session::

        SELECT * FROM segment_turns(TABLE(t) PARTITION BY conv_id ORDER BY turn, delta_star => 0.5)

    A dialogue is one task's; ``segment`` also splits those too long for one.
    """
    spark.udtf.register(name, F.udtf(SegmentTurns))
