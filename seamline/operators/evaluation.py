"""P_k, WindowDiff, F1 and the composite score of label sequences.

Labels follow the end-turn convention. All metrics of a dialogue look at
windows of ``k`` labels, and ``k`` differs between dialogues. A count over a
window is the difference of two running totals, so every turn hands its totals
to the window that ends there and to the window that starts after it; grouping
by ``(conv_id, window)`` pairs them. Nothing is grouped by dialogue before it
is summed, and any number of predictions is evaluated in the same pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.config import DEFAULT_CHUNK_TURNS
from seamline.operators.prefix import chunk_of, running
from seamline.operators.validation import not_binary, paired_labels, unpaired
from seamline.storage import store

METRICS = ("pk", "wd", "f1", "score")
#: Metrics of one dialogue.
PER_DIALOGUE = ("pk", "wd", "f1")


def window_size(n: Column, boundaries: Column) -> Column:
    """Half the mean segment length, halves rounded to even, at least 2."""
    half = n.cast("double") / (boundaries + 1) / 2
    return F.greatest(F.lit(2), F.bround(half).cast("int"))


def _expressions(preds: Sequence[str] | Mapping[str, str]) -> dict[str, str]:
    """SQL for every prediction: a column, or made of one when it is needed."""
    return dict(preds) if isinstance(preds, Mapping) else {p: p for p in preds}


def dialogue_stats(labels: DataFrame, preds: Sequence[str] | Mapping[str, str] = ()) -> DataFrame:
    """Per dialogue ``n``, gold boundaries ``b`` and window size ``k``, and per
    prediction its boundaries and hits, the last turn's labels taken as 0.

    Labels the metrics are not defined for are an error.
    """
    of = _expressions(preds)
    names = list(of)

    def without_last(flag: str, name: str) -> Column:
        # The parity of the largest 2*turn+flag is the flag of the last turn.
        return F.expr(f"sum({flag}) - max(turn * 2 + {flag}) % 2 AS {name}")

    checked = [f"({x})" for x in of.values()]
    stats = labels.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("rows"),
        (F.max("turn") + 1).alias("n"),
        without_last("gold", "b"),
        F.count_if(not_binary(checked)).alias("bad"),
        F.count_if(unpaired(checked)).alias("unpaired"),
        *[without_last(x, f"b_{p}") for p, x in zip(names, checked)],
        *[without_last(f"gold * {x}", f"hit_{p}") for p, x in zip(names, checked)],
    )
    checks = (
        ("unpaired > 0", "gold and predicted labels must cover the same turns"),
        ("bad > 0", "labels must be 0 or 1"),
        ("rows <> n", "turn must number each dialogue 0..n-1; see dense_turns"),
        ("n < 2", "each dialogue needs at least two turns"),
    )
    cases = " ".join(f"WHEN {wrong} THEN bigint(raise_error('{message}'))" for wrong, message in checks)
    return (
        stats.withColumn("n", F.expr(f"CASE {cases} ELSE n END"))
        .withColumn("k", window_size(F.col("n"), F.col("b")))
        .selectExpr(
            "conv_id", "n", "bigint(b) AS b", "k", *[f"{what}_{p}" for p in names for what in ("b", "hit")]
        )
    )


def dialogue_metrics(
    labels: DataFrame,
    preds: Sequence[str] | Mapping[str, str],
    *,
    metrics: Sequence[str] = PER_DIALOGUE,
    longest: int | None = None,
    chunk_turns: int = DEFAULT_CHUNK_TURNS,
) -> DataFrame:
    """``metrics`` (``pk``, ``wd``, ``f1``) per dialogue for every prediction.

    ``labels`` has ``conv_id, turn, gold`` and the columns named in ``preds``, or
    those that its SQL expressions are made of: many predictions may come from one
    column, and are made where they are summed. The result has ``n``, ``k`` and
    ``pk_<pred>, wd_<pred>, f1_<pred>``. The labels are written once, as they may
    come from scores and are read for the sizes and for the windows; ``f1`` alone
    needs no windows and reads them once.
    """
    if unknown := set(metrics) - set(PER_DIALOGUE):
        raise ValueError(f"unknown metrics: {sorted(unknown)}")
    of = _expressions(preds)
    names = list(of)
    f1 = [f"coalesce(try_divide(2D * hit_{p}, b + b_{p}), 0D) AS f1_{p}" for p in names if "f1" in metrics]
    windowed = [m for m in ("pk", "wd") if m in metrics]
    if not windowed:
        return dialogue_stats(labels, of).selectExpr("conv_id", "n", "k", *f1)
    longest = chunk_turns + 1 if longest is None else longest
    labels = store(labels, "labels")
    stats = dialogue_stats(labels, of)

    # One row of figures per chunk, not per dialogue: a long dialogue must not
    # meet its figures in a single join partition.
    chunks = F.expr(f"explode(sequence(0L, (n - 1) div {chunk_turns}))").alias("chunk")
    sized = labels.withColumn("chunk", chunk_of(F.col("turn"), chunk_turns)).join(
        stats.select("conv_id", "n", "k", chunks), ["conv_id", "chunk"]
    )
    flags = {"gold": "gold", **of}
    totals = running(
        sized,
        {f"upto_{c}": ("sum", f"if(turn < n - 1, {x}, 0)") for c, x in flags.items()},
        longest,
        chunk_turns,
        stored=True,
    )

    sides = [f"upto_{c}" for c in flags]
    # The totals of a turn count for the window it ends, and against the window
    # that starts after it.
    roles = F.expr(
        "explode(array(named_struct('window', turn - k + 1, 'sign', 1L),"
        " named_struct('window', turn + 1, 'sign', -1L))) AS role"
    )
    windows = (
        totals.select("conv_id", "n", "k", *sides, roles)
        .where("role.window BETWEEN 0 AND n - k")
        .groupBy("conv_id", F.col("role.window").alias("window"))
        .agg(*[F.expr(f"sum(role.sign * {s}) AS {s}") for s in sides])
    )
    misses = windows.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("windows"),
        *[F.expr(f"count_if((upto_gold > 0) <> (upto_{p} > 0)) AS pk_{p}") for p in names],
        *[F.expr(f"count_if(upto_gold <> upto_{p}) AS wd_{p}") for p in names],
    )
    return stats.join(misses, "conv_id").selectExpr(
        "conv_id",
        "n",
        "k",
        *[f"{m}_{p} / windows AS {m}_{p}" for m in windowed for p in names],
        *f1,
    )


def corpus_metrics(per_dialogue: DataFrame, preds: Sequence[str]) -> DataFrame:
    """Unweighted means over dialogues, one row per prediction; ``ordinal`` is
    the place of the prediction in ``preds``."""
    none = F.raise_error(F.lit("there are no dialogues to evaluate")).cast("bigint")
    count = F.count(F.lit(1))
    means = per_dialogue.agg(
        F.when(count > 0, count).otherwise(none).alias("n"),
        *[F.expr(f"avg({m}_{p}) AS {m}_{p}") for p in preds for m in ("pk", "wd", "f1")],
    )
    rows = ", ".join(f"struct(pk_{p} AS pk, wd_{p} AS wd, f1_{p} AS f1)" for p in preds)
    score = 0.5 * F.col("f1") + 0.25 * (1 - F.col("pk")) + 0.25 * (1 - F.col("wd"))
    return (
        means.select("n", F.expr(f"posexplode(array({rows})) AS (ordinal, x)"))
        .select("ordinal", "x.*", "n")
        .select("ordinal", "pk", "wd", "f1", score.alias("score"), "n")
    )


def evaluate(
    gold: DataFrame,
    pred: DataFrame,
    *,
    longest: int | None = None,
    chunk_turns: int = DEFAULT_CHUNK_TURNS,
) -> DataFrame:
    """Mean ``pk, wd, f1``, the composite ``score`` and ``n`` of two label tables
    ``(conv_id, turn, label)``."""
    pairs = paired_labels(gold, pred)
    per_dialogue = dialogue_metrics(pairs, ["pred"], longest=longest, chunk_turns=chunk_turns)
    return corpus_metrics(per_dialogue, ["pred"]).select(*METRICS, "n")
