"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as an embedding of itself, if it was frequent enough in training, beside
the mean embedding of its character n-grams, so inflected and unseen forms still count.
A document is cut into overlapping windows, all of which are scored; both directions
run over a window, attention pools the states, and a document is as toxic as its worst
window. Labels are known per document only: in training the windows of a document
share its loss by a smooth maximum. Everything is numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm.common import if_small

_EDGES = b".,;:!?\"'()[]{}*_-<>"
#: Words whose inputs a worker remembers before it starts afresh.
_REMEMBERED = 200_000
#: Windows that run through the network side by side.
_SIDE_BY_SIDE = 1024


@dataclass(frozen=True)
class Toxicity:
    """Parameters.

    ``window, stride``   words per window, and from one to the next
    ``sample``           labelled rows a fit uses at most, half of them toxic if there
                         are as many
    ``longest``          words of the longest text used in fitting, so that the driver
                         holds at most ``sample * longest`` words
    ``vocabulary``       words with an embedding of their own, at most
    ``grams``            numbers that character trigrams are hashed to
    ``width, hidden``    size of either embedding, and of a direction's state
    ``steps, batch``     gradient steps, and documents in each
    ``rate``             step size of Adam
    """

    window: int = 48
    stride: int = 32
    sample: int = 3000
    longest: int = 1000
    vocabulary: int = 8192
    grams: int = 1 << 14
    width: int = 8
    hidden: int = 8
    steps: int = 400
    batch: int = 32
    rate: float = 0.02
    seed: int = 7


@dataclass
class Network:
    config: Toxicity
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    weights: dict[str, np.ndarray] = field(default_factory=dict)


# --------------------------------------------------------------------- inputs


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words between ASCII white space, of the whole text."""
    return text.decode("utf-8", "replace").lower().encode().split()


def trigrams(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the UTF-8 bytes of words between two marks, and whose they are."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 3
    marked = b"^" + b"$\n^".join(words) + b"$\n"
    letters = np.frombuffer(marked, np.uint8).astype(np.uint32)
    code = (letters[:-2] << np.uint32(16)) | (letters[1:-1] << np.uint32(8)) | letters[2:]
    # No word holds a line end, so a trigram without one lies within a word.
    inside = (letters[:-2] != 10) & (letters[1:-1] != 10) & (letters[2:] != 10)
    hashed = (code * np.uint32(0x9E3779B1)) >> np.uint32(33 - buckets.bit_length())
    return np.repeat(np.arange(len(words)), sizes)[:-2][inside], hashed[inside].astype(np.int64)


class Inputs:
    """Rows for words, numbered as they come; row 0 is padding."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self.rows: dict[bytes, int] = {}
        self.bare: list[bytes] = [b" "]

    def of(self, words: list[bytes]) -> np.ndarray:
        for word in set(words).difference(self.rows):
            self.rows[word] = len(self.bare)
            self.bare.append(word.strip(_EDGES) or word)
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def flat(self, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary numbers, owners of the trigrams, and the trigrams, of rows from ``start``."""
        words = self.bare[start:]
        known = self.network.vocabulary
        numbers = np.fromiter((known.get(w, 0) for w in words), np.int64, len(words))
        return numbers, *trigrams(words, self.network.config.grams)


def windows(count: int, config: Toxicity) -> np.ndarray:
    """Positions of the words of every window, -1 beyond the end; at least one window."""
    starts = np.arange(max(1, -(-max(0, count - config.window) // config.stride) + 1)) * config.stride
    places = starts[:, None] + np.arange(config.window)
    return np.where(places < count, places, -1)


# -------------------------------------------------------------------- network


def initial(config: Toxicity, words: int) -> dict[str, np.ndarray]:
    rng, d, h = np.random.default_rng(config.seed), 2 * config.width, config.hidden

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.normal(size=shape) * scale).astype(np.float32)

    weights = {
        "word": normal(words, config.width, scale=0.3),
        "gram": normal(config.grams, config.width, scale=0.3),
        "input": normal(2, d, 3 * h, scale=d**-0.5),
        "bias": np.zeros((2, 1, 3 * h), np.float32),
        "state": normal(2, h, 3 * h, scale=h**-0.5),
        "attend": normal(2 * h, 2 * h, scale=(2 * h) ** -0.5),
        "attend_bias": np.zeros(2 * h, np.float32),
        "query": normal(2 * h, scale=(2 * h) ** -0.5),
        "out": normal(2 * h, scale=(2 * h) ** -0.5),
        "out_bias": np.zeros(1, np.float32),
    }
    weights["word"][0] = 0
    return weights


def embedded(weights: dict, flat: tuple) -> np.ndarray:
    """Input vectors of rows: word embedding beside the mean of the trigrams'."""
    words, owner, grams = flat
    # Owners come in order and each has a trigram, if only of its marks.
    starts = np.searchsorted(owner, np.arange(len(words)))
    total = np.add.reduceat(weights["gram"][grams], starts, axis=0)
    size = np.diff(np.append(starts, len(owner))).astype(np.float32)
    return np.hstack((weights["word"][words], total / size[:, None]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    half = np.tanh(x * np.float32(0.5))
    half *= np.float32(0.5)
    half += np.float32(0.5)
    return half


def forward(weights: dict, projected: np.ndarray, rows: np.ndarray, keep: bool = False):
    """Logits of windows of input rows (0 is padding); with ``keep`` also what ``backward`` needs.

    ``projected`` has the gate inputs of every row for both directions. The second
    direction is the same recurrence over the reversed window.
    """
    count, length = rows.shape
    h = weights["state"].shape[1]
    state = np.zeros((2, count, h), np.float32)
    states = np.empty((length, 2, count, h), np.float32)
    steps = []
    real = (rows > 0).astype(np.float32)[:, :, None]
    for t in range(length):
        back = length - 1 - t
        x = np.empty((2, count, 3 * h), np.float32)
        np.take(projected[0], rows[:, t], axis=0, out=x[0])
        np.take(projected[1], rows[:, back], axis=0, out=x[1])
        mask = np.stack((real[:, t], real[:, back]))
        u = state @ weights["state"]
        gates = _sigmoid(x[:, :, : 2 * h] + u[:, :, : 2 * h])
        update, reset = gates[:, :, :h], gates[:, :, h:]
        new = np.tanh(x[:, :, 2 * h :] + reset * u[:, :, 2 * h :])
        before = state
        # Padding leaves the state as it is.
        state = state + mask * ((1 - update) * (new - state))
        states[t, 0, :, :] = state[0]
        states[back, 1, :, :] = state[1]
        if keep:
            steps.append((before, update, reset, new, u[:, :, 2 * h :], mask))
    both = np.concatenate((states[:, 0], states[:, 1]), axis=2).transpose(1, 0, 2)
    hidden = np.tanh(both @ weights["attend"] + weights["attend_bias"])
    scores = np.where(real[:, :, 0] > 0, hidden @ weights["query"], np.float32(-1e9))
    share = np.exp(scores - scores.max(axis=1, keepdims=True)) * real[:, :, 0]
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-9)
    pooled = (share[:, :, None] * both).sum(axis=1)
    logits = pooled @ weights["out"] + weights["out_bias"]
    return (logits, (steps, both, hidden, share, pooled)) if keep else logits


def backward(weights: dict, rows: np.ndarray, kept: tuple, slope: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weights above the inputs, and of ``projected`` by direction and place."""
    steps, both, hidden, share, pooled = kept
    count, length = rows.shape
    h = weights["state"].shape[1]
    grads = {"out": pooled.T @ slope, "out_bias": slope.sum(keepdims=True)}
    d_pooled = slope[:, None] * weights["out"]
    d_both = share[:, :, None] * d_pooled[:, None, :]
    d_share = (both * d_pooled[:, None, :]).sum(axis=2)
    d_scores = share * (d_share - (share * d_share).sum(axis=1, keepdims=True))
    grads["query"] = np.einsum("wt,wtk->k", d_scores, hidden)
    d_hidden = d_scores[:, :, None] * weights["query"] * (1 - hidden**2)
    grads["attend"] = np.einsum("wtj,wtk->jk", both, d_hidden)
    grads["attend_bias"] = d_hidden.sum(axis=(0, 1))
    d_both = d_both + d_hidden @ weights["attend"].T
    d_projected = np.zeros((2, count, length, 3 * h), np.float32)
    grads["state"] = np.zeros_like(weights["state"])
    d_state = np.zeros((2, count, h), np.float32)
    for t in reversed(range(length)):
        back = length - 1 - t
        before, update, reset, new, candidate, mask = steps[t]
        d_state = d_state + np.stack((d_both[:, t, :h], d_both[:, back, h:]))
        d_new = d_state * mask * (1 - update) * (1 - new**2)
        d_update = -d_state * mask * (new - before) * update * (1 - update)
        d_reset = d_new * candidate * reset * (1 - reset)
        d_x = np.concatenate((d_update, d_reset, d_new), axis=2)
        d_u = np.concatenate((d_update, d_reset, d_new * reset), axis=2)
        d_projected[0, :, t], d_projected[1, :, back] = d_x[0], d_x[1]
        grads["state"] += before.transpose(0, 2, 1) @ d_u
        d_state = d_state * (1 - mask * (1 - update)) + d_u @ weights["state"].transpose(0, 2, 1)
    return grads, d_projected


def projections(weights: dict, vectors: np.ndarray) -> np.ndarray:
    return vectors @ weights["input"] + weights["bias"]


def trained(texts: list[bytes], labels: list[int], config: Toxicity) -> Network:
    """A network fitted to whole texts by Adam on batches of documents, half of them toxic."""
    split = [words_of(t) for t in texts]
    seen = Counter(w for words in split for w in {x.strip(_EDGES) or x for x in words})
    common = sorted((w for w, n in seen.items() if n > 1), key=lambda w: (-seen[w], w))[: config.vocabulary - 1]
    network = Network(config, {w: i for i, w in enumerate(common, 1)})
    weights = network.weights = initial(config, len(common) + 1)
    truth = np.array(labels)
    groups = [g for g in (np.flatnonzero(truth == 1), np.flatnonzero(truth == 0)) if len(g)]
    if len(groups) < 2:
        # Nothing to tell apart: every text gets the only label there is, or 0.
        weights["out"] *= 0
        weights["out_bias"] += 4.0 if len(truth) and truth[0] else -4.0
        return network
    rng = np.random.default_rng(config.seed)
    first = {k: np.zeros_like(w) for k, w in weights.items()}
    second = {k: np.zeros_like(w) for k, w in weights.items()}
    for step in range(1, config.steps + 1):
        chosen = np.concatenate([rng.choice(g, config.batch // 2) for g in groups])
        inputs = Inputs(network)
        rows, owner = [], []
        for number, i in enumerate(chosen):
            own = np.append(inputs.of(split[i]), 0)
            places = windows(len(split[i]), config)
            rows.append(own[places])
            owner += [number] * len(places)
        rows, owner, flat = np.concatenate(rows), np.array(owner), inputs.flat()
        vectors = embedded(weights, flat)
        logits, kept = forward(weights, projections(weights, vectors), rows, keep=True)
        # Smooth maximum over a document's windows, log-sum-exp less the logarithm of nothing:
        # a document is toxic by its worst windows, and many clean ones do not add up.
        top = np.full(len(chosen), -np.inf, np.float32)
        np.maximum.at(top, owner, logits)
        part = np.exp(2 * (logits - top[owner]))
        part /= np.bincount(owner, part)[owner]
        pooled = np.bincount(owner, part * logits)
        error = (_sigmoid(pooled) - truth[chosen]) / len(chosen)
        slope = (error[owner] * part).astype(np.float32)
        grads, d_projected = backward(weights, rows, kept, slope)
        d_rows = np.zeros((2, len(vectors), weights["input"].shape[2]), np.float32)
        for direction in range(2):
            np.add.at(d_rows[direction], rows, d_projected[direction])
        d_rows[:, 0] = 0
        grads["input"] = vectors.T @ d_rows
        grads["bias"] = d_rows.sum(axis=1, keepdims=True)
        d_vectors = (d_rows @ weights["input"].transpose(0, 2, 1)).sum(axis=0)
        words, of, grams = flat
        grads["word"], grads["gram"] = np.zeros_like(weights["word"]), np.zeros_like(weights["gram"])
        np.add.at(grads["word"], words, d_vectors[:, : config.width])
        grads["word"][0] = 0
        size = np.maximum(np.bincount(of, minlength=len(words)), 1).astype(np.float32)
        np.add.at(grads["gram"], grams, (d_vectors[:, config.width :] / size[:, None])[of])
        rate = config.rate * min(1.0, 2 * (1 - step / (config.steps + 1)))
        for name, grad in grads.items():
            first[name] += 0.1 * (grad - first[name])
            second[name] += 0.001 * (grad**2 - second[name])
            even = np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8
            weights[name] -= (rate * first[name] / (1 - 0.9**step) / even).astype(np.float32)
    return network


# ---------------------------------------------------------------------- scoring


class Scorer:
    """Scores of whole texts; gate inputs of words are remembered while they fit."""

    def __init__(self, network: Network) -> None:
        self.network = network
        self._forget()

    def _forget(self) -> None:
        self.inputs = Inputs(self.network)
        self.projected = np.zeros((2, 1, 3 * self.network.config.hidden), np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The largest score of each text's windows."""
        config, weights = self.network.config, self.network.weights
        if len(self.inputs.bare) > _REMEMBERED:
            self._forget()
        best = np.full(len(texts), -np.inf)
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        waiting = 0
        for number, text in enumerate(texts):
            words = words_of(text)
            own = np.append(self.inputs.of(words), 0)
            places = windows(len(words), config)
            for start in range(0, len(places), _SIDE_BY_SIDE):
                held.append(own[places[start : start + _SIDE_BY_SIDE]])
                owner.append(np.full(len(held[-1]), number))
                waiting += len(held[-1])
                if waiting >= _SIDE_BY_SIDE:
                    self._run(weights, held, owner, best)
                    held, owner, waiting = [], [], 0
        if held:
            self._run(weights, held, owner, best)
        return 1 / (1 + np.exp(-best.clip(-30, 30)))

    def _run(self, weights: dict, held: list, owner: list, best: np.ndarray) -> None:
        known = self.projected.shape[1]
        if known < len(self.inputs.bare):
            new = projections(weights, embedded(weights, self.inputs.flat(known)))
            self.projected = np.concatenate((self.projected, new), axis=1)
        np.maximum.at(best, np.concatenate(owner), forward(weights, self.projected, np.concatenate(held)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    config: Toxicity = Toxicity(),
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> Network:
    """A network of the labelled rows of ``docs``.

    Of several labels of a document the largest counts; null labels and ids are
    ignored, a null text counts as empty. Rows of at most ``longest`` words are drawn
    by hash of id and text, up to ``sample``, half of each label where there are
    enough; without any, every score is that of a clean text.
    """
    truth = (
        labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label"))
        .where("id IS NOT NULL AND label IS NOT NULL")
        .groupBy("id")
        .agg((F.max("label") > 0).cast("int").alias("label"))
    )
    half = config.sample // 2
    # The labels are narrow: draw among them first, twice as many as needed and a few more.
    counts = {r["label"]: r["count"] for r in truth.groupBy("label").count().collect()}
    keep = F.lit(False)
    for label, count in counts.items():
        chance = min(1.0, (4.0 * half + 64) / count)
        hashed = F.pmod(F.xxhash64("id", F.lit(config.seed)), F.lit(1 << 30))
        keep = keep | ((F.col("label") == label) & (hashed < int(chance * (1 << 30))))
    rows = docs.select(
        F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text")
    ).where(F.size(F.split("text", r"[\x20\x09-\x0D]+")) <= config.longest)
    # A few times the sample at most, so texts are not shuffled to meet their labels.
    drawn_ids = if_small(truth.where(keep), 8 * config.sample + 1000)
    known = rows.join(drawn_ids, "id").withColumn("hash", F.xxhash64("id", "text"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("hash", "text"))
    drawn = known.select("label", "hash", "text", rank.alias("rank")).where(F.col("rank") <= half)
    sample = sorted((r["hash"], r["label"], r["text"].encode("utf-8", "replace")) for r in drawn.collect())
    return trained([text for _, _, text in sample], [label for _, label, _ in sample], config)


def score(
    docs: DataFrame, network: Network, text_column: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (all but the text by default), ``score`` and ``predicted``.

    Only the text is read for a score, in all its windows. Null and empty texts have one
    window of padding and get the score of that. ``predicted`` is 1 from 0.5 on. Repeated
    rows score alike, nulls in kept columns stay, kept columns named as the new ones are
    dropped, an empty table gives an empty result.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text_column, "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(network)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                values = scorer.scores([t or b"" for t in part.column(0).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(values, pa.float64()), pa.array(values >= 0.5).cast(pa.int32())],
                    [*keep, "score", "predicted"],
                )

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double", "predicted int"])
    rows = docs.select(F.col(f"`{text_column}`").cast("string"), *[F.col(f"`{c}`") for c in keep])
    return rows.mapInArrow(run, schema)
