"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Five counts are measured per document. A document that breaks a base rule goes.
For the others, labelled documents choose cutoffs: for each stratum, feature and
candidate cutoff, the good labelled documents that the cutoff would reject are
counted, and the exact binomial tail says how likely so few rejections are if the
true rate of false rejection were above its bound. Only candidates that pass after
Bonferroni correction over all strata, features and candidates may be used, so with
probability ``1 - delta`` no stratum loses more than the share ``alpha`` of its good
documents to the cutoffs. Where too few labels exist nothing can be shown and
nothing is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import WORD, if_small, text_of
from seamline.storage import store

#: Counts in the order of the result.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"


def _grid() -> dict[str, tuple[float, ...]]:
    return {
        "symbols_per_word": (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.5, 1.0),
        "dup_lines_per_word": (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3),
        "repeat_share": (0.06, 0.08, 0.1, 0.12, 0.14, 0.16, 0.18, 0.19),
        "word_length": (6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0),
        "shortness": (-4.5, -4.25, -4.0, -3.75, -3.5, -3.0, -2.5, -2.0),
    }


@dataclass(frozen=True)
class Quality:
    """Parameters.

    ``alpha``   share of a stratum's good documents that all cutoffs together may
                reject; it is divided equally among the features
    ``delta``   probability with which a bound may fail, over all tests together
    ``price``   bad labelled documents that one rejected good one must outweigh
    ``grid``    candidate cutoffs per feature, fixed before any label is seen; a
                document goes when a feature is above the cutoff
    """

    alpha: float = 0.05
    delta: float = 0.05
    price: float = 20.0
    grid: dict[str, tuple[float, ...]] = field(default_factory=_grid)

    @property
    def risk(self) -> float:
        """Bound on the false rejections of one feature."""
        return self.alpha / len(self.grid)


def measured(docs: DataFrame, text_column: str = "text", name: str = "_measured") -> DataFrame:
    """``docs`` with a struct of the five counts of the whole text.

    ``n_words``         words, runs of characters but space and U+0009 to U+000D
    ``word_chars``      code points in words
    ``n_symbols``       characters of ``#*$%&|<>``
    ``n_dup_lines``     lines between ``\\n`` that hold a word and equal an earlier one
    ``n_repeat_words``  words in windows of five that occur twice or more

    A null text counts as empty: all zero. The columns of ``docs`` stay as they are.
    """
    rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = text_of(F.col(f"`{text_column}`"))
    bare = F.length(F.translate(text, _SYMBOLS + _SPACE, "")).cast("bigint")
    chars = F.length(F.translate(text, _SPACE, "")).cast("bigint")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, _SPACE, "")) > 0)
    first = docs.select(
        rows,
        chars.alias("word_chars"),
        (chars - bare).alias("n_symbols"),
        lines.alias("lines"),
        F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("words"),
    )
    # Hashes of the windows say whether any occurs twice; only then are they compared.
    hashes = F.expr("transform(sequence(1, greatest(size(words) - 4, 1)), i -> xxhash64(slice(words, i, 5)))")
    second = first.select(
        "row",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("words") > 4, hashes).alias("hashes"),
        "words",
    )
    windows = F.expr(
        "sort_array(transform(sequence(1, size(words) - 4), "
        "i -> named_struct('window', array_join(slice(words, i, 5), ' '), 'at', i)))"
    )
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    third = second.withColumn("windows", F.when(repeats, windows)).drop("hashes")
    twice = F.expr(
        "sort_array(transform(filter(windows, (x, i) -> coalesce(x.window = get(windows, i - 1).window, false) "
        "OR coalesce(x.window = get(windows, i + 1).window, false)), x -> x.at))"
    )
    fourth = third.withColumn("at", F.coalesce(twice, F.array().cast("array<int>")))
    covered = F.expr(
        "aggregate(at, named_struct('n', 0L, 'last', -5), "
        "(s, p) -> named_struct('n', s.n + least(5, p - s.last), 'last', p), s -> s.n)"
    )
    counts = F.struct(
        F.size("words").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        covered.alias("n_repeat_words"),
    )
    return fourth.select("row.*", counts.alias(name))


def base_failed(counts: str = "_measured") -> Column:
    """Fewer than ten words, or more than a fifth of them repeated."""
    n, repeated = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < 10) | (100 * repeated > 20 * n)


def _features(counts: str) -> dict[str, Column]:
    def per_word(name: str) -> Column:
        return F.col(f"{counts}.{name}") / F.greatest(F.col(f"{counts}.n_words"), F.lit(1))

    return {
        "symbols_per_word": per_word("n_symbols"),
        "dup_lines_per_word": per_word("n_dup_lines"),
        "repeat_share": per_word("n_repeat_words"),
        "word_length": per_word("word_chars"),
        "shortness": -per_word("word_chars"),
    }


def judge(
    docs: DataFrame,
    labels: DataFrame,
    config: Quality = Quality(),
    id_column: str = "doc_id",
    text_column: str = "text",
    stratum_column: str = "lang",
    keep: list[str] | None = None,
) -> DataFrame:
    """Verdicts on whole texts: the columns ``keep``, ``_measured``, ``base_failed``, ``kept``.

    ``labels`` has the id and ``quality`` (1 good, 0 bad; of several labels of a
    document the lowest counts; null labels and ids are ignored). ``keep`` defaults to
    the id; all columns of ``docs`` may be kept, as nothing is joined to them but the
    cutoffs. A null stratum is a stratum of its own. A null or empty text has no word
    and fails the base rules. Repeated rows are judged one by one alike. An empty
    table gives an empty result; without labels only the base rules decide.
    """
    keep = [id_column] if keep is None else keep
    columns = {c: F.col(f"`{c}`") for c in dict.fromkeys([*keep, id_column, stratum_column])}
    rows = measured(docs, text_column).select(
        F.struct(*[columns[c] for c in keep]).alias("row"),
        columns[id_column].alias("id"),
        columns[stratum_column].alias("stratum"),
        "_measured",
    )
    rows = store(rows.withColumn("failed", base_failed()), "measured")
    chosen = cutoffs(rows.where("NOT failed"), labels, config, id_column)
    wide = chosen.groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "cutoff"))).alias("cutoffs")
    )
    wide = if_small(wide.withColumnRenamed("stratum", "of"), 10_000)
    judged = rows.join(wide, rows["stratum"].eqNullSafe(wide["of"]), "left")
    rejected = F.lit(False)
    for name, value in _features("_measured").items():
        if name in config.grid:
            rejected = rejected | F.coalesce(value > F.col("cutoffs")[name], F.lit(False))
    return judged.select(
        "row.*", "_measured", F.col("failed").alias("base_failed"), (~F.col("failed") & ~rejected).alias("kept")
    )


def cutoffs(rows: DataFrame, labels: DataFrame, config: Quality, id_column: str = "doc_id") -> DataFrame:
    """``(stratum, feature, cutoff)`` where some cutoff may be used, the best one each.

    ``rows`` has ``id``, ``stratum`` and ``_measured``. Labelled rows shrink to counts
    per stratum, feature and step of the grid before anything is compared.
    """
    truth = (
        labels.select(F.col(id_column).alias("id"), F.col("quality").cast("int").alias("quality"))
        .where("id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("id")
        .agg(F.min("quality").alias("quality"))
    )
    known = rows.select("id", "stratum", "_measured").join(truth, "id")
    features = _features("_measured")
    steps = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                sum(((features[name] > c).cast("int") for c in grid), F.lit(0)).alias("step"),
            )
            for name, grid in config.grid.items()
        ]
    )
    counted = store(
        known.select("stratum", "quality", F.explode(steps).alias("s"))
        .groupBy("stratum", "s.feature", "s.step")
        .agg(F.count_if(F.col("quality") > 0).alias("good"), F.count_if(F.col("quality") <= 0).alias("bad")),
        "counted",
    )
    grid = F.create_map(
        *[x for name, cuts in config.grid.items() for x in (F.lit(name), F.array(*map(F.lit, cuts)))]
    )
    # A document on step s is above the first s candidates; candidate 0 is above none and carries the totals.
    candidates = (
        counted.select("stratum", "feature", "good", "bad", F.explode(F.expr("sequence(0, step)")).alias("candidate"))
        .groupBy("stratum", "feature", "candidate")
        .agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    )
    totals = candidates.where("candidate = 0").select(
        F.col("stratum").alias("of"), F.col("feature").alias("f"), F.col("good").alias("n")
    )
    same = candidates["stratum"].eqNullSafe(totals["of"]) & (candidates["feature"] == totals["f"])
    tested = candidates.where("candidate > 0 AND bad > 0").join(totals, same)
    tests = sum(len(cuts) for cuts in config.grid.values()) * max(1, counted.select("stratum").distinct().count())
    proven = tested.where(binomial_tail("good", "n", config.risk) <= config.delta / tests)
    worth = F.col("bad") - config.price * F.col("good")
    best = proven.where(worth > 0).groupBy("stratum", "feature").agg(
        F.max_by("candidate", F.struct(worth, "candidate")).alias("candidate")
    )
    return best.select("stratum", "feature", grid[F.col("feature")][F.col("candidate") - 1].alias("cutoff"))


def binomial_tail(k: str, n: str, p: float) -> Column:
    """P(X <= k) for X of n draws with probability p, summed from k down.

    Exact up to rounding where k is below the mean, whose terms shrink downwards;
    from the mean on it is more than a quarter, and 1 is returned.
    """
    log_choose = f"aggregate(sequence(1L, {k}), 0D, (s, i) -> s + ln(({n} - {k} + i) / i))"
    ratio = f"(i * {1 - p!r}) / (({n} - i + 1) * {p!r})"
    series = (
        f"aggregate(sequence({k}, 1L, -1L), named_struct('sum', 1D, 'term', 1D), "
        f"(s, i) -> named_struct('sum', s.sum + s.term * {ratio}, 'term', s.term * {ratio}), s -> s.sum)"
    )
    none = F.expr(f"{n} * ln({1 - p!r})")
    some = F.expr(f"{log_choose} + {k} * ln({p!r}) + ({n} - {k}) * ln({1 - p!r}) + ln({series})")
    log_tail = F.when(F.col(k) == 0, none).otherwise(some)
    return F.when(F.col(k) < F.col(n) * p, F.exp(log_tail)).otherwise(1.0)
