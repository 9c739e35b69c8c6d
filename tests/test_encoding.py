import pytest
from pyspark.sql import functions as F

from seamline import SegmenterConfig, encode_distinct, hash_encoder, segment


def counting(spark):
    calls = spark.sparkContext.accumulator(0)

    def encoder(column):
        @F.udf("array<double>")
        def encode(text):
            calls.add(1)
            return [float(len(text)), 1.0] if text is not None else None

        return encode(column)

    return encoder, calls


@pytest.mark.parametrize("hot_texts", (1, 8, 4096))
def test_each_distinct_text_is_encoded_once(spark, hot_texts):
    """A text of half the rows, some of a few, many of one; null and empty ones too."""
    texts = ["hot"] * 200 + ["warm", "", None] * 20 + [f"own {i}" for i in range(140)]
    rows = [(i % 7, i // 7, t, i) for i, t in enumerate(texts)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string, uses int").repartition(5)
    encoder, calls = counting(spark)
    done = encode_distinct(turns.withColumn("embedding", F.lit(1)), encoder, hot_texts=hot_texts)
    assert done.columns == ["conv_id", "turn", "text", "uses", "embedding"]
    got = sorted(((r.conv_id, r.turn, r.text, r.uses, r.embedding) for r in done.collect()), key=repr)
    assert got == sorted(((*r, None if r[2] is None else [float(len(r[2])), 1.0]) for r in rows), key=repr)
    assert done.count() == len(rows) and calls.value == len(set(texts))


def test_segments_are_those_of_single_encoding(spark):
    rows = [(c, t, "tea and cake" if t % 4 < 2 else "rain and wind") for c in range(3) for t in range(20)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string")
    config = SegmenterConfig(delta_star=0.2)
    each = segment(turns, config, encoder=hash_encoder()).history()
    once = segment(encode_distinct(turns, hash_encoder()), config).history()
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, each.collect()))
    assert each.where("is_boundary").count() > 0


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, text string")
    assert encode_distinct(turns, hash_encoder()).collect() == []
