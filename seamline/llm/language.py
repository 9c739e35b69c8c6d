"""Language identification with a string kernel.

Two texts are as similar as the character n-grams of length 1 to ``longest`` that
both contain: the presence kernel, normalised by the numbers of distinct n-grams.
Landmark texts approximate it (Nyström), ridge regression in the landmark features
separates each language from the rest, and batches of documents are scored by two
matrix products: with the landmarks, then with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm.common import if_small

#: The answer for texts without a letter.
UNDETERMINED = "und"
#: Code points of one text that are hashed at a time.
_STRETCH = 1 << 20


@dataclass(frozen=True)
class StringKernel:
    """Parameters.

    ``longest``    length of the longest n-grams
    ``buckets``    numbers n-grams are hashed to, a power of two
    ``landmarks``  landmark texts, shared equally among the languages
    ``sample``     labelled rows that a fit uses at most, shared equally among the
                   languages (at least eight each): the bound on what is collected,
                   ``buckets / 8`` bytes a row
    ``ridge``      penalty of the regression
    ``batch``      documents per matrix product
    """

    longest: int = 3
    buckets: int = 1 << 15
    landmarks: int = 256
    sample: int = 4096
    ridge: float = 0.01
    batch: int = 128


@dataclass(frozen=True)
class Model:
    """``landmarks`` are packed presence bits, ``weights`` map kernel values to languages."""

    config: StringKernel
    languages: tuple[str, ...]
    landmarks: np.ndarray
    weights: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def present(text: str | None, config: StringKernel, out: np.ndarray) -> bool:
    """Mark the n-grams of a whole text in ``out``; whether it has a letter.

    Letters are lower-cased, every other character counts as a space.
    """
    found = False
    lowered = (text or "").lower()
    for start in range(0, len(lowered), _STRETCH):
        # Stretches overlap, so that no n-gram is lost between two of them.
        part = lowered[start : start + _STRETCH + config.longest - 1]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        found = found or bool(letter.any())
        points = np.where(letter, points, np.uint32(32))
        code = np.zeros(len(points), np.uint32)
        shift = np.uint32(33 - config.buckets.bit_length())
        for n in range(1, config.longest + 1):
            code = (code[: len(points) - n + 1] + points[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
            code ^= code >> np.uint32(15)
            out[(code * np.uint32(0x85EBCA6B)) >> shift] = 1
    return found


def fit(
    docs: DataFrame,
    config: StringKernel = StringKernel(),
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "lang",
) -> Model:
    """A model of the labelled rows of ``docs``; rows without a label are left out.

    Per language the rows with the smallest hash of id and text are used, up to the
    language's share of ``sample``, so a fit does not depend on partitions. Tasks turn
    them into presence bits; only those reach the driver.
    """
    rows = docs.select(
        F.col(f"`{label_column}`").cast("string").alias("lang"),
        F.col(f"`{text_column}`").cast("string").alias("text"),
        F.xxhash64(F.col(f"`{id_column}`"), F.col(f"`{text_column}`")).alias("hash"),
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = (
        docs.where(F.col(f"`{label_column}`").isNotNull())
        .groupBy(F.col(f"`{label_column}`").cast("string").alias("of"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    total = counts.count()
    if not total:
        return Model(config, (), np.empty((0, config.buckets // 8), np.uint8), np.empty((0, 0)))
    share = max(8, config.sample // total)
    # Twice the share and a few more by hash, then exactly the share by rank.
    chance = (F.lit(2.0 * share) + 64) / F.col("rows")
    # One row per language: handed out, so that only what is drawn is shuffled.
    drawn = rows.join(if_small(counts, 10_000), F.col("lang") == F.col("of")).where(
        F.pmod("hash", F.lit(1 << 30)) < chance * float(1 << 30)
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "text"))
    chosen = drawn.select("lang", "text", "hash", rank.alias("rank")).where(F.col("rank") <= share)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for text in batch.column(1).to_pylist():
                row = np.zeros(config.buckets, np.uint8)
                present(text, config, row)
                bits.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(bits, pa.binary())], ["lang", "hash", "bits"]
            )

    sample = chosen.select("lang", "text", "hash").mapInArrow(pack, "lang string, hash bigint, bits binary")
    collected = sorted((r["lang"], r["hash"], bytes(r["bits"])) for r in sample.collect())
    return regression([lang for lang, _, _ in collected], [bits for _, _, bits in collected], config)


def regression(labels: list[str], bits: list[bytes], config: StringKernel) -> Model:
    """Nyström features on landmarks, then one ridge regression per language."""
    languages = tuple(sorted(set(labels)))
    packed = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1)
    truth = np.array([languages.index(label) for label in labels])
    each = max(1, config.landmarks // len(languages))
    chosen = np.concatenate([np.flatnonzero(truth == k)[:each] for k in range(len(languages))])
    landmarks = packed[chosen]
    kernel = similarities(packed, landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[chosen])
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    mapped = np.column_stack((kernel @ root, np.ones(len(kernel))))
    target = np.where(truth[:, None] == np.arange(len(languages)), 1.0, -1.0)
    penalty = config.ridge * np.eye(mapped.shape[1])
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(mapped.T @ mapped + penalty, mapped.T @ target)
    return Model(config, languages, landmarks, np.vstack((root @ solved[:-1], solved[-1:])))


def normalised(packed: np.ndarray) -> np.ndarray:
    """Rows of packed presence bits as vectors of length 1 (or 0)."""
    rows = np.unpackbits(packed, axis=1).astype(np.float32)
    return rows / np.sqrt(np.maximum(rows.sum(axis=1), 1))[:, None]


def similarities(packed: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of presence bits with landmarks, some rows at a time."""
    marks = normalised(landmarks).T.copy()
    return np.concatenate([normalised(packed[i : i + 256]) @ marks for i in range(0, len(packed), 256)])


def identify(
    docs: DataFrame, model: Model, text_column: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (all but the text by default), ``lang_pred`` and ``score``.

    Only the text is read for a prediction, the whole of it. ``score`` is the softmax
    of the regressions at the language chosen; ties go to the first name. A null text
    and one without a letter are ``und`` with score 0, and so is every text if the model
    has no language. Repeated rows are answered alike, nulls in kept columns stay, kept
    columns named as the new ones are dropped, an empty table gives an empty result.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text_column, "lang_pred", "score")]
    config, languages = model.config, model.languages

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = normalised(model.landmarks).T.copy()
        weights = model.weights.astype(np.float32)
        features = np.zeros((config.batch, config.buckets), np.float32)
        flags = np.zeros(config.buckets, np.uint8)
        for batch in batches:
            for start in range(0, batch.num_rows, config.batch):
                part = batch.slice(start, config.batch)
                known = np.zeros(part.num_rows, bool)
                for i, text in enumerate(part.column(0)):
                    flags[:] = 0
                    known[i] = bool(languages) and present(text.as_py(), config, flags)
                    features[i] = flags
                some = features[: part.num_rows]
                if languages:
                    kernel = some @ marks / np.sqrt(np.maximum(some.sum(axis=1), 1))[:, None]
                    power = np.exp(4 * (kernel @ weights[:-1] + weights[-1]).clip(-3, 3))
                    best = power.argmax(axis=1)
                    value = (power.max(axis=1) / power.sum(axis=1)).astype(np.float64)
                else:
                    best, value = np.zeros(part.num_rows, int), np.zeros(part.num_rows)
                names = [languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(names, pa.string()), pa.array(np.where(known, value, 0.0))],
                    [*keep, "lang_pred", "score"],
                )

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double"])
    rows = docs.select(F.col(f"`{text_column}`").cast("string"), *[F.col(f"`{c}`") for c in keep])
    return rows.mapInArrow(score, schema)
