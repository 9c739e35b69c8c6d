"""Topic segmentation of dialogues on Spark."""

from seamline.config import SegmenterConfig
from seamline.deploy import ship
from seamline.functions.encoders import hash_encoder, model_encoder, sentence_encoder
from seamline.functions.tables import register_tables
from seamline.operators.encoding import encode_distinct
from seamline.operators.evaluation import evaluate
from seamline.operators.prefix import dense_turns, number_turns
from seamline.operators.scoring import score_turns
from seamline.operators.topics import (
    assign_topics,
    corpus_counts,
    dialogue_summary,
    end_turn_labels,
    history,
    segment_text,
    segments,
    strength_histogram,
    strength_rollup,
)
from seamline.operators.validation import invalid_embeddings, label_violations, mixed_dimensions, set_aside
from seamline.plans.calibration import calibrate, calibrate_turns, threshold_candidates
from seamline.plans.segmentation import Segmentation, segment
from seamline.plans.totals import StrengthTotals
from seamline.sources.json_files import as_json, calibration_set, evaluation_set, write_json
from seamline.sources.matrix import turns_from_matrices, write_matrices
from seamline.sources.sessions import turns_from_arrays, turns_from_sessions
from seamline.sources.text import turns_from_documents, turns_from_text
from seamline.storage import drop_stored
from seamline.streaming.online import segment_stream
from seamline.streaming.ordered import segment_stream_in_order, segments_from_stream

__all__ = [
    "SegmenterConfig",
    "Segmentation",
    "StrengthTotals",
    "as_json",
    "assign_topics",
    "calibrate",
    "calibrate_turns",
    "calibration_set",
    "corpus_counts",
    "dense_turns",
    "dialogue_summary",
    "drop_stored",
    "encode_distinct",
    "end_turn_labels",
    "evaluate",
    "evaluation_set",
    "hash_encoder",
    "history",
    "invalid_embeddings",
    "label_violations",
    "mixed_dimensions",
    "model_encoder",
    "number_turns",
    "register_tables",
    "score_turns",
    "segment",
    "segment_stream",
    "segment_stream_in_order",
    "segment_text",
    "segments",
    "segments_from_stream",
    "sentence_encoder",
    "set_aside",
    "ship",
    "strength_histogram",
    "strength_rollup",
    "threshold_candidates",
    "turns_from_arrays",
    "turns_from_documents",
    "turns_from_matrices",
    "turns_from_sessions",
    "turns_from_text",
    "write_json",
    "write_matrices",
]
