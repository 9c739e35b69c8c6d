"""Small sequential models the Spark results are compared with."""

from fractions import Fraction

import numpy as np


def score(vectors, m=2, rho=0.7, a=0.5, legacy=False):
    units = [np.asarray(v, float) / np.linalg.norm(v) for v in vectors]
    out = []
    for t, unit in enumerate(units):
        if t == 0:
            out.append(0.0)
            continue
        near = 1 - units[t - 1] @ unit
        far = near
        if legacy or t >= m:
            past = [rho ** (i - 1) * units[t - i] for i in range(1, min(m, t) + 1)]
            total = np.sum(past, axis=0)
            length = np.linalg.norm(total)
            far = near if length <= 1e-12 else 1 - total @ unit / length
        out.append(a * near + (1 - a) * far)
    return out


def topics(scores, delta):
    """Each turn's topic: how many boundaries lie at or before it."""
    boundaries = {t for t, s in enumerate(scores) if t and s >= delta}
    return [sum(b <= t for b in boundaries) for t in range(len(scores))]


def end_labels(scores, delta):
    """1 on the turns that close a segment: those a boundary comes right after."""
    closing = {t - 1 for t in range(1, len(scores)) if scores[t] >= delta}
    return [int(t in closing) for t in range(len(scores))]


#: Weights of the composite, and whether a measure counts as it is or by what it lacks to 1.
COMPOSITE = {"f1": (Fraction(1, 2), False), "pk": (Fraction(1, 4), True), "wd": (Fraction(1, 4), True)}


def cuts(labels):
    """Turns that end a segment, but for the last one, which every dialogue ends with."""
    return {t for t, label in enumerate(labels[:-1]) if label}


def metrics(gold, pred):
    """Pk, WindowDiff and F1 from the sets of cuts, in exact fractions."""
    g, p, n = cuts(gold), cuts(pred), len(gold)
    half_mean = Fraction(n, 2 * (len(g) + 1))
    low = half_mean.numerator // half_mean.denominator
    beyond = half_mean - low
    up = beyond > Fraction(1, 2) or (beyond == Fraction(1, 2) and low % 2)
    k = max(2, low + int(up))
    windows = [set(range(i, i + k)) for i in range(n - k + 1)]
    pk = Fraction(sum(bool(g & w) != bool(p & w) for w in windows), len(windows))
    wd = Fraction(sum(len(g & w) != len(p & w) for w in windows), len(windows))
    f1 = Fraction(2 * len(g & p), len(g) + len(p)) if g or p else Fraction(0)
    return float(pk), float(wd), float(f1)


def corpus(golds, preds):
    rows = [dict(zip(("pk", "wd", "f1"), metrics(g, p))) for g, p in zip(golds, preds)]
    means = {name: sum(row[name] for row in rows) / len(rows) for name in COMPOSITE}
    total = sum(weight * (1 - means[m] if lacking else means[m]) for m, (weight, lacking) in COMPOSITE.items())
    return means | {"score": float(total)}


def turn_table(spark, dialogues):
    rows = [
        (c, t, [float(x) for x in v]) for c, vectors in enumerate(dialogues) for t, v in enumerate(vectors)
    ]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, embedding array<double>")


def label_table(spark, labels):
    rows = [(c, t, v) for c, row in enumerate(labels) for t, v in enumerate(row)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, label int")


def gather(df, column):
    """Values per dialogue, in turn order."""
    out = {}
    for row in df.orderBy("conv_id", "turn").collect():
        out.setdefault(row["conv_id"], []).append(row[column])
    return out
