"""Vectors for texts that occur again and again: each distinct text is encoded once.

Worth its second pass over the texts where the encoder is dear: greetings, templates and
system prompts make a large share of dialogue turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions.encoders import Encoder
from seamline.storage import store

#: At most this many texts can be hot, for a hot one fills more than this part of the rows.
HOT_TEXTS = 4096
_NAME, _HOT_NAME, _VECTOR, _HOT_VECTOR = "_text_name", "_hot_name", "_text_vector", "_hot_vector"


def encode_distinct(
    turns: DataFrame, encoder: Encoder, text: str = "text", vector: str = "embedding", hot_texts: int = HOT_TEXTS
) -> DataFrame:
    """``turns`` with the column ``vector``, for which ``encoder`` meets every distinct text once.

    Texts are told apart by their SHA-256, counted before they are shuffled, encoded one
    row per text and written once. A text that fills more than one in ``hot_texts`` rows
    is handed to every task: there are fewer of them than that, whatever the table, and no
    other text can fill a task of the join that brings the vectors back. A null text is one
    text, about which the encoder decides. A column of the name ``vector`` is replaced; an
    empty table gives an empty result. ``turns`` is read twice, so it must not change in between.
    """
    named = turns.drop(vector).withColumn(_NAME, F.coalesce(F.sha2(F.col(text), 256), F.lit("")))
    counted = store(
        named.groupBy(_NAME).agg(F.first(text).alias(text), F.count(F.lit(1)).alias("uses")), "distinct-texts"
    )
    total = counted.agg(F.sum("uses")).first()[0] or 0
    coded = store(counted.select(_NAME, "uses", encoder(F.col(text)).alias(_VECTOR)), "text-vectors")
    is_hot: Column = F.col("uses") * hot_texts > total
    hot = coded.where(is_hot).select(F.col(_NAME).alias(_HOT_NAME), F.col(_VECTOR).alias(_HOT_VECTOR))
    rest = coded.where(~is_hot).select(_NAME, _VECTOR)
    met = named.join(F.broadcast(hot), F.col(_NAME) == F.col(_HOT_NAME), "left")
    done = met.where(F.col(_HOT_NAME).isNotNull()).withColumn(vector, F.col(_HOT_VECTOR))
    left = met.where(F.col(_HOT_NAME).isNull()).join(rest, _NAME).withColumn(vector, F.col(_VECTOR))
    names = [c for c in named.columns if c != _NAME] + [vector]
    return done.select(names).union(left.select(names))
