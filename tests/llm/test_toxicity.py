import random

import numpy as np
import pytest

from seamline.llm.toxicity import (
    Inputs,
    Network,
    Scorer,
    Toxicity,
    backward,
    embedded,
    fit,
    forward,
    initial,
    projections,
    score,
    trained,
    trigrams,
    windows,
)

SCHEMA = "doc_id bigint, text string, score string, predicted string, toxic int"
SMALL = Toxicity(window=8, stride=5, sample=200, vocabulary=50, grams=256, width=3, hidden=3, steps=120, batch=16)


def plain_logit(network, text):
    """One window at a time, one word at a time, from the definitions."""
    weights, config = network.weights, network.config
    words = text.lower().split()
    h, best = config.hidden, -np.inf

    def sigmoid(x):
        return 1 / (1 + np.exp(-x))

    def vector(word):
        bare = word.encode().strip(b".,;:!?\"'()[]{}*_-<>") or word.encode()
        _, grams = trigrams([bare], config.grams)
        return np.concatenate((weights["word"][network.vocabulary.get(bare, 0)], weights["gram"][grams].mean(axis=0)))

    start = 0
    while True:
        part = words[start : start + config.window]
        states = [[], []]
        for direction, order in ((0, part), (1, part[::-1])):
            state = np.zeros(h)
            for word in order:
                x = vector(word) @ weights["input"][direction] + weights["bias"][direction][0]
                u = state @ weights["state"][direction]
                update, reset = sigmoid(x[:h] + u[:h]), sigmoid(x[h : 2 * h] + u[h : 2 * h])
                state = update * state + (1 - update) * np.tanh(x[2 * h :] + reset * u[2 * h :])
                states[direction].append(state)
        pooled = np.zeros(2 * h)
        if part:
            both = np.hstack((states[0], states[1][::-1]))
            energy = np.tanh(both @ weights["attend"] + weights["attend_bias"]) @ weights["query"]
            share = np.exp(energy - energy.max())
            pooled = (share / share.sum()) @ both
        best = max(best, float(pooled @ weights["out"] + weights["out_bias"][0]))
        if start + config.window >= len(words):
            return best
        start += config.stride


def random_network(seed=1, config=SMALL):
    rng = np.random.default_rng(seed)
    weights = {k: (w + rng.normal(size=w.shape) * 0.5).astype(np.float32) for k, w in initial(config, 6).items()}
    weights["word"][0] = 0
    return Network(config, {b"alpha": 1, b"beta": 2, "ñu".encode(): 3, b"x": 4, b"zz": 5}, weights)


def test_scores_are_those_of_all_windows(monkeypatch):
    network, rng = random_network(), random.Random(2)
    texts = ["", " ", "alpha", "Alpha, beta!", "..."] + [
        " ".join(rng.choice(["alpha", "BETA.", "ñu", "x", "zz", "other", "ünÏ"]) for _ in range(n)) for n in range(1, 40)
    ]
    expected = 1 / (1 + np.exp(-np.array([plain_logit(network, t) for t in texts])))
    monkeypatch.setattr("seamline.llm.toxicity._SIDE_BY_SIDE", 4)
    monkeypatch.setattr("seamline.llm.toxicity._REMEMBERED", 3)
    scorer = Scorer(network)
    found = np.concatenate([scorer.scores([t.encode() for t in texts[i : i + 7]]) for i in range(0, len(texts), 7)])
    assert found == pytest.approx(expected, abs=1e-4)


def test_windows_overlap_and_cover():
    for count in range(60):
        places = windows(count, SMALL)
        assert set(places[places >= 0].tolist()) == set(range(count))
        assert (np.diff(places[:, 0]) == SMALL.stride).all()


def test_gradients_equal_differences():
    network = random_network(3)
    weights = {k: w.astype(np.float64) for k, w in network.weights.items()}
    inputs = Inputs(network)
    own = np.append(inputs.of(b"alpha beta x other zz alpha n".split()), 0)
    rows = own[windows(7, Toxicity(window=5, stride=3))]
    vectors = embedded(network.weights, inputs.flat()).astype(np.float64)
    slope = np.array([0.7, -0.4], np.float32)[: len(rows)]

    def loss():
        return float(forward(weights, projections(weights, vectors).astype(np.float32), rows) @ slope)

    _, kept = forward(network.weights, projections(network.weights, vectors.astype(np.float32)), rows, keep=True)
    grads, _ = backward(network.weights, rows, kept, slope)
    for name in ("state", "attend", "attend_bias", "query", "out"):
        at = tuple(s // 2 for s in weights[name].shape)
        value, step = weights[name][at], 1e-2
        weights[name][at] = value + step
        up = loss()
        weights[name][at] = value - step
        down = loss()
        weights[name][at] = value
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-3), name


def toxic_rows(seed, count):
    rng, rows = random.Random(seed), []
    for i in range(count):
        words = ["".join(rng.choices("bcdfgaeiou", k=rng.randrange(2, 7))) for _ in range(rng.choice([5, 20, 60]))]
        label = int(rng.random() < 0.4)
        if label:
            words.insert(rng.randrange(len(words)), rng.choice(["wretch", "Wretched,", "vilest", "vile"]))
        rows.append((i, " ".join(words), label))
    return rows


def test_learns_and_holds_out(spark):
    train = toxic_rows(1, 400)
    docs = spark.createDataFrame([(i, t, "s", "p", 1 - y) for i, t, y in train] + [(9000, None, "s", "p", 0)], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in train] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    network = fit(docs, labels, SMALL)
    held = toxic_rows(2, 200)
    odd = [(5000, None), (5001, ""), (None, "vile"), (None, "vile"), (5002, "good " * 30_000)]
    rows = [(i, t, "s", "p", y) for i, t, y in held] + [(i, t, "s", "p", None) for i, t in odd]
    found = score(spark.createDataFrame(rows, SCHEMA), network)
    assert found.columns == ["doc_id", "toxic", "score", "predicted"]
    got = found.collect()
    assert len(got) == len(rows)
    assert np.mean([r["predicted"] == r["toxic"] for r in got if r["toxic"] is not None]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    byid = {r["doc_id"]: r["score"] for r in got}
    assert byid[5000] == byid[5001]
    assert score(docs.limit(0), network).collect() == []


@pytest.mark.parametrize("labels", [[], [0, 0], [1]])
def test_one_label_or_none(labels):
    network = trained([b"some words"] * len(labels), labels, SMALL)
    (value,) = Scorer(network).scores([b"any text"])
    assert (value > 0.5) == (1 in labels)
