"""Parameters of the segmenter, checked when they are created."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

WARMUPS = ("paper", "legacy")
ENGINES = ("arrow", "jvm")

#: Turns per chunk. A dialogue longer than this is spread over several tasks.
DEFAULT_CHUNK_TURNS = 16_384


@dataclass(frozen=True)
class SegmenterConfig:
    """One set of scoring and thresholding parameters.

    ``delta_star``   boundary threshold, in (0, 2]
    ``ctx_window``   number of past turns in the context, >= 1
    ``ctx_decay``    geometric weight of older context turns, in (0, 1]
    ``ctx_blend_a``  share of the adjacent distance in the score, in [0, 1]
    ``warmup``       ``paper``: adjacent distance until the context is full;
                     ``legacy``: context over the turns there are
    ``dim``          expected vector length, ``None`` accepts any one length

    ``chunk_turns`` and ``engine`` choose how Spark runs the job; they never
    change a result.
    """

    # The defaults.
    delta_star: float = 0.5594
    ctx_window: int = 2
    ctx_decay: float = 0.7
    ctx_blend_a: float = 0.5
    warmup: str = "paper"
    dim: int | None = None
    chunk_turns: int = DEFAULT_CHUNK_TURNS
    engine: str = "arrow"

    def __post_init__(self) -> None:
        checks = (
            (self.warmup in WARMUPS, f"warmup must be one of {WARMUPS}"),
            (self.dim is None or self.dim >= 1, "dim must be at least 1"),
            (0.0 < self.delta_star <= 2.0, "delta_star must lie in (0, 2]"),
            (self.ctx_window >= 1, "ctx_window must be at least 1"),
            (0.0 < self.ctx_decay <= 1.0, "ctx_decay must lie in (0, 1]"),
            (0.0 <= self.ctx_blend_a <= 1.0, "ctx_blend_a must lie in [0, 1]"),
            (self.chunk_turns >= self.ctx_window, "chunk_turns must not be below ctx_window"),
            (self.engine in ENGINES, f"engine must be one of {ENGINES}"),
        )
        for ok, message in checks:
            if not ok:
                raise ValueError(message)

    @classmethod
    def for_sessions(cls, **overrides: Any) -> "SegmenterConfig":
        """Defaults of the session job: 768-wide vectors and a threshold of 0.30."""
        # Fixed values.
        return cls(**{"dim": 768, "delta_star": 0.30, **overrides})
