"""Text encoders: functions from a text column to an ``array<float>`` column."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

Encoder = Callable[[Column], Column]

#: Encoder named by default and the revision it is pinned to (fixed values).
DEFAULT_MODEL = "sentence-transformers/multi-qa-mpnet-base-dot-v1"
DEFAULT_MODEL_REVISION = "17997f24dca0df1a4fed68894fb0e1e133e60482"

HASH_BUCKETS = 256


def hash_encoder(buckets: int = HASH_BUCKETS) -> Encoder:
    """Counts of hashed tokens, an encoder that needs no model.

    A token is a run of the letters a-z in the lower-cased text; its bucket is
    the first 32 bits of its MD5 modulo the number of buckets. Tokens are split
    and counted for a whole Arrow batch at a time, and each distinct token of a
    batch is hashed once.
    """

    @F.arrow_udf("array<float>")
    def count(texts: pa.Array) -> pa.Array:
        tokens = pc.split_pattern_regex(pc.utf8_lower(texts.fill_null("")), "[^a-z]+")
        row = np.repeat(np.arange(len(texts)), tokens.value_lengths().to_numpy(zero_copy_only=False))
        coded = tokens.flatten().dictionary_encode()
        # A text that begins or ends between tokens yields empty ones.
        bucket = np.array([_bucket(t) % buckets if t else -1 for t in coded.dictionary.to_pylist()], np.int64)
        bucket = bucket[coded.indices.to_numpy(zero_copy_only=False)]
        cell = (row * buckets + bucket)[bucket >= 0]
        counts = np.bincount(cell, minlength=len(texts) * buckets).astype(np.float32)
        ends = np.arange(len(texts) + 1, dtype=np.int32) * buckets
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(counts))

    return count


def _bucket(token: str) -> int:
    return int.from_bytes(hashlib.md5(token.encode(), usedforsecurity=False).digest()[:4], "big")


def model_encoder(load: Callable[[], Any], batch_size: int = 32) -> Encoder:
    """Wrap any model with ``encode(list[str]) -> matrix``.

    ``load`` runs once per Python worker, so a model is read once and not per
    batch. Spark hands over Arrow batches; the model sees ``batch_size`` texts
    at a time.
    """
    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            vectors: list[Any] = []
            for start in range(0, len(texts), batch_size):
                part = texts.iloc[start : start + batch_size].tolist()
                matrix = np.asarray(model.encode(part), dtype=np.float32)
                if matrix.ndim != 2 or len(matrix) != len(part):
                    raise ValueError("an encoder must return one vector per text")
                vectors.extend(matrix)
            yield pd.Series(vectors, index=texts.index)

    return encode


def sentence_encoder(name: str = DEFAULT_MODEL, device: str = "cpu", batch_size: int = 32) -> Encoder:
    """A sentence-transformers model by name; the package must be on the workers."""
    revision = DEFAULT_MODEL_REVISION if name == DEFAULT_MODEL else None

    def load() -> Any:
        from sentence_transformers import SentenceTransformer

        return SentenceTransformer(name, device=device, revision=revision)

    return model_encoder(load, batch_size)
