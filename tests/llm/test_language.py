import random

import numpy as np
import pytest

from seamline.llm.language import StringKernel, fit, identify, present, regression

SCHEMA = "doc_id bigint, text string, lang string, lang_pred string, score int"
SYLLABLES = {"aa": "ba ke lo mi su ta".split(), "bb": "the ing ou er st".split(), "cc": "ñe ció ú lla".split()}


def prose(rng, lang, words):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(words))


def rows_of(seed, count):
    rng = random.Random(seed)
    return [(i, prose(rng, lang := rng.choice(list(SYLLABLES)), rng.choice([4, 30, 300])), lang) for i in range(count)]


def test_held_out_accuracy_and_edges(spark):
    config = StringKernel(buckets=1 << 12, landmarks=24, sample=90)
    train = [(*r, "p", 1) for r in rows_of(1, 300)] + [(900, "ba", None, "p", 1), (901, None, "aa", "p", 1)]
    model = fit(spark.createDataFrame(train, SCHEMA), config)
    assert model.languages == ("aa", "bb", "cc")
    again = fit(spark.createDataFrame(train, SCHEMA).repartition(5), config)
    assert np.array_equal(model.landmarks, again.landmarks)
    held = rows_of(2, 200)
    odd = [(1000, None), (1001, ""), (1002, "12 . %$"), (None, "the ing"), (None, "the ing"), (1003, "the " * 400_000)]
    table = [(*r, "p", 1) for r in held] + [(i, t, None, "p", 1) for i, t in odd]
    docs = spark.createDataFrame(table, SCHEMA)
    found = identify(docs, model)
    assert found.columns == ["doc_id", "lang", "lang_pred", "score"]
    rows = found.collect()
    right = [r["lang"] == r["lang_pred"] for r in rows if r["lang"]]
    assert len(rows) == len(table) and np.mean(right) > 0.98
    byid = {r["doc_id"]: r for r in rows}
    for name in (1000, 1001, 1002):
        assert (byid[name]["lang_pred"], byid[name]["score"]) == ("und", 0.0)
    assert byid[1003]["lang_pred"] == byid[None]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_kernel_counts_shared_ngrams():
    config = StringKernel(longest=2, buckets=1 << 14)

    def grams(text):
        row = np.zeros(config.buckets, np.uint8)
        return present(text, config, row), row

    (_, one), (_, two) = grams("Abcab"), grams("xbc")
    # a b c ab bc ca, and x b c xb bc: no buckets meet among so few.
    assert one.sum() == 6 and two.sum() == 5 and (one & two).sum() == 3
    assert grams("a1-b")[1].tolist() == grams("A  B")[1].tolist()
    assert grams("12")[0] is False


def test_stretches_lose_no_ngram(monkeypatch):
    config = StringKernel()
    text = "".join(random.Random(1).choices("abcdefgh ", k=500))
    whole, parts = np.zeros((2, config.buckets), np.uint8)
    present(text, config, whole)
    monkeypatch.setattr("seamline.llm.language._STRETCH", 7)
    present(text, config, parts)
    assert (whole == parts).all()


def test_without_labels_nothing_is_determined(spark):
    docs = spark.createDataFrame([(1, "text", None, "p", 1)], SCHEMA)
    model = fit(docs)
    assert [tuple(r) for r in identify(docs, model, keep=["doc_id"]).collect()] == [(1, "und", 0.0)]
    assert identify(docs.limit(0), model).collect() == []


@pytest.mark.parametrize("labels", [["aa"] * 3, ["aa", "bb", "aa"]])
def test_tiny_samples(labels):
    config = StringKernel(buckets=1 << 10)
    bits = []
    for text in ("ba ke", "the ing", "lo mi"):
        row = np.zeros(config.buckets, np.uint8)
        present(text, config, row)
        bits.append(np.packbits(row).tobytes())
    assert regression(labels, bits, config).languages == tuple(sorted(set(labels)))
