"""From turns to topics in one call."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.config import SegmenterConfig
from seamline.functions.encoders import Encoder
from seamline.operators import topics as reports
from seamline.operators.fitting import score_fit_turns
from seamline.operators.prefix import dense_turns
from seamline.operators.scoring import score_turns

#: What becomes of turns that cannot be scored.
UNFIT = ("stop", "aside")
#: The turn as given, while ``turn`` numbers the turns without gaps.
_GIVEN = "_given_turn"


@dataclass(frozen=True)
class Segmentation:
    """Turns with their topics, and the tables made of them."""

    topics: DataFrame
    longest: int
    config: SegmenterConfig
    #: ``conv_id``, ``turn`` and ``reason`` of the turns set aside, if they were to be.
    unfit: DataFrame | None = None

    def history(self) -> DataFrame:
        return reports.history(self.topics)

    def segments(self) -> DataFrame:
        return reports.segments(self.topics)

    def segment_text(self, part_turns: int = reports.PART_TURNS) -> DataFrame:
        return reports.segment_text(self.topics, part_turns)

    def summary(self, part_turns: int = reports.PART_TURNS) -> DataFrame:
        return reports.dialogue_summary(self.topics, longest=self.longest, part_turns=part_turns)

    def strength_histogram(self) -> DataFrame:
        return reports.strength_histogram(self.topics)

    def strength_rollup(self) -> DataFrame:
        return reports.strength_rollup(self.topics)

    def end_turn_labels(self) -> DataFrame:
        return reports.end_turn_labels(
            self.topics,
            self.config.delta_star,
            longest=self.longest,
            chunk_turns=self.config.chunk_turns,
        )


def segment(
    turns: DataFrame,
    config: SegmenterConfig = SegmenterConfig(),
    *,
    encoder: Encoder | None = None,
    keep: Sequence[str] = (),
    unfit: str = "stop",
) -> Segmentation:
    """Segment ``(conv_id, turn, embedding)``, or ``text`` with an encoder.

    The key columns are looked at once to see whether turns need numbering and
    whether any dialogue is long enough to be split.

    A turn that cannot be scored stops the job. With ``unfit="aside"`` it is reported in
    ``unfit`` instead and its dialogue goes on as if it had not come, all in the one pass
    that scores; the pass is written once, so no report makes a vector anew.
    """
    if unfit not in UNFIT:
        raise ValueError(f"unfit must be one of {UNFIT}")
    if unfit == "stop":
        turns, longest = dense_turns(turns)
        scored = score_turns(turns, config, longest=longest, encoder=encoder, keep=keep, mark=True)
        return Segmentation(reports.assign_topics(scored, config, longest=longest), longest, config)
    kept = [c for c in keep if c not in ("conv_id", "turn")]
    turns, longest = dense_turns(turns.withColumn(_GIVEN, F.col("turn")))
    scored, aside = score_fit_turns(
        turns, config, longest=longest, encoder=encoder, keep=[*kept, _GIVEN], mark=True
    )
    aside = aside.select("conv_id", F.col(_GIVEN).alias("turn"), "reason")
    topics = reports.assign_topics(scored.drop(_GIVEN), config, longest=longest, stored=True)
    return Segmentation(topics, longest, config, aside)
