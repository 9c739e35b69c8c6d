import math
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from seamline.llm.quality import COUNTS, Quality, binomial_tail, cutoffs, judge, measured

SCHEMA = "doc_id bigint, text string, lang string, kept string, size int"


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts_of_whole_texts(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t\n", "one", "a b c d", "a b c d e", "a b c d e a b c d e", "x " * 50, "é# Ñ|\n\né# Ñ|\r\né# Ñ|"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(400))) for _ in range(40)]
    texts += ["\n".join(rng.choice(["a b", "c", "", " ", "%"]) for _ in range(30)) for _ in range(20)]
    texts += [" ".join(f"w{i % 9000}" for i in range(20_000)), "y" * 50_000, "a\x0bb\x0cc d\x85e f"]
    docs = spark.createDataFrame(list(enumerate(texts)), "_measured bigint, text string")
    rows = measured(docs, name="found").collect()
    assert {r["_measured"]: tuple(r["found"][c] for c in COUNTS) for r in rows} == dict(enumerate(map(counted, texts)))


def test_binomial_tail(spark):
    cases = [(k, n) for n in (1, 7, 60, 500) for k in range(0, 40, 3) if k <= n]
    found = spark.createDataFrame(cases, "k bigint, n bigint").withColumn("p", binomial_tail("k", "n", 0.05)).collect()
    p = Fraction(1, 20)
    for k, n, tail in found:
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert tail == (pytest.approx(float(exact), rel=1e-9) if k < n * 0.05 else 1.0)


def calibration_rows(seed):
    """Two languages whose bad documents have symbols; a third with too few labels."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(2600):
        lang = "aa" if i % 2 else None
        lang = "cc" if i % 100 == 3 else lang
        good = rng.random() < 0.75
        words = [f"w{rng.randrange(999)}" for _ in range(rng.randrange(12, 25))]
        if not good:
            words = [w + "#" * rng.choice([1, 1, 2]) for w in words]
        elif rng.random() < 0.002:
            words[0] += "#" * 20
        rows.append((i, " ".join(words), lang, "k", 1))
        labels.append((i, int(good)))
    return rows, labels


def brute_force_cutoffs(rows, labels, config):
    quality = {}
    for name, value in labels:
        if name is not None and value is not None:
            quality[name] = min(value, quality.get(name, 1))
    data = []
    for name, text, lang, *_ in rows:
        n, chars, symbols, lines, repeated = counted(text)
        if name in quality and not (n < 10 or 100 * repeated > 20 * n):
            value = {
                "symbols_per_word": symbols / n,
                "dup_lines_per_word": lines / n,
                "repeat_share": repeated / n,
                "word_length": chars / n,
                "shortness": -chars / n,
            }
            data.append((lang, value, quality[name]))
    strata = {lang for lang, _, _ in data}
    tests = len(strata) * sum(map(len, config.grid.values()))
    out = set()
    for stratum in strata:
        for feature, grid in config.grid.items():
            own = [(v[feature], q) for lang, v, q in data if lang == stratum]
            n, best = sum(q for _, q in own), None
            for cut in grid:
                good = sum(q for v, q in own if v > cut)
                bad = sum(1 - q for v, q in own if v > cut)
                p = config.risk
                tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(good + 1)) if good < n * p else 1
                worth = bad - config.price * good
                if tail <= config.delta / tests and worth > 0 and (best is None or worth >= best[0]):
                    best = (worth, cut)
            if best:
                out.add((stratum, feature, best[1]))
    return out


def test_cutoffs_equal_brute_force_and_verdicts_follow(spark):
    config = Quality(alpha=0.2)
    rows, labels = calibration_rows(4)
    rows += [(9000, None, "aa", "k", 1), (9001, "", None, "k", 1), (None, " ".join("abcdefghijkl"), "aa", "k", 1)]
    rows += [(9002, " ".join(f"{w}###" for w in "abcdefghijkl"), "cc", "k", 1)] * 2
    labels += [(0, None), (None, 0), (1, 0), (1, 1), (77777, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    truth = spark.createDataFrame(labels, "doc_id bigint, quality int")
    expected = brute_force_cutoffs(rows, labels, config)
    measured_docs = measured(docs).select(F.col("doc_id").alias("id"), F.col("lang").alias("stratum"), "_measured")
    passing = measured_docs.where("_measured.n_words >= 10 AND 100 * _measured.n_repeat_words <= 20 * _measured.n_words")
    assert {tuple(r) for r in cutoffs(passing, truth, config).collect()} == expected
    assert {s for s, f, _ in expected if f == "symbols_per_word"} == {"aa", None}
    cuts = {(s, f): c for s, f, c in expected}
    found = sorted(judge(docs, truth, config, keep=["doc_id", "lang", "text"]).collect(), key=repr)
    assert len(found) == len(rows)
    for row in found:
        n, chars, symbols, lines, repeated = counted(row["text"])
        failed = n < 10 or 100 * repeated > 20 * n
        assert row["base_failed"] == failed
        above = not failed and any(
            value > cuts.get((row["lang"], name), math.inf)
            for name, value in (
                ("symbols_per_word", symbols / n),
                ("dup_lines_per_word", lines / n),
                ("repeat_share", repeated / n),
                ("word_length", chars / n),
                ("shortness", -chars / n),
            )
        )
        assert row["kept"] == (not failed and not above)


def test_nothing_is_rejected_without_evidence(spark):
    docs = spark.createDataFrame([(1, " ".join(f"{w}###" for w in "abcdefghijkl"), "aa", "k", 1)], SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [tuple(r) for r in judge(docs, none).select("doc_id", "base_failed", "kept").collect()] == [(1, False, True)]
    assert judge(docs.limit(0), none).collect() == []
