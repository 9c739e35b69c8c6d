import hashlib
import random
import re
import time

import numpy as np
import pytest

from seamline.llm import minhash
from seamline.llm.graph import components
from seamline.llm.minhash import (
    NearDuplicates,
    WordHashes,
    _chance,
    _forest,
    near_duplicates,
    shingle_set,
    sketches,
    without_near_duplicates,
)

DOCS = "doc_id bigint, text string, n_shingles int, component_id string, node int"


def brute_force(rows, config=NearDuplicates()):
    """Sets of word tuples, all pairs, components by repeated merging."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        size = config.shingle
        windows = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}
        sets.append(windows if words else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= config.percent * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (name, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        root = min(ids) if name is not None else None
        out.append((name, len(sets[i]), root, name == root))
    return sorted(out, key=repr)


def answer(spark, rows, config=NearDuplicates()):
    docs = spark.createDataFrame([(i, t, 7, "x", 1) for i, t in rows], DOCS)
    return sorted((tuple(r) for r in near_duplicates(docs, config=config).collect()), key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, number = [], 0
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 120, 400]))]
        for copy in range(rng.choice([1, 2, 6])):
            text = list(base)
            for _ in range(copy * len(base) // 60):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((number * 3 % 97, " ".join(text)))
            number += 1
    return rows


def test_equals_brute_force(spark):
    passage = " ".join(f"common{i}" for i in range(60))
    rows = corpus() + [(200 + i, f"{passage} own{i} " + " ".join(f"t{i}x{j}" for j in range(15))) for i in range(12)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "One two"), (304, "one\x0btwo"), (305, "one two three")]
    rows += [(306, "É é"), (307, "é é"), (None, "One two"), (None, None), (303, "One two"), (400, passage)]
    rows += [(500 + i, passage) for i in range(9)]
    assert answer(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("block", [2, 256])
def test_crowded_buckets_lose_no_link(spark, block):
    """Chains in one crowd: ends are unlike, neighbours alike, whichever leads a bucket."""
    rng = random.Random(5)
    core = [f"c{i}" for i in range(80)]
    rows = []
    for chain in range(6):
        text = core + [f"k{chain}x{i}" for i in range(30)]
        for step in range(6):
            rows.append((rng.randrange(10**6), " ".join(text)))
            text = text[:80] + text[85:] + [f"k{chain}n{step}x{i}" for i in range(5)]
    config = NearDuplicates(block=block)
    assert answer(spark, rows, config) == brute_force(rows, config)


def groups_of(texts, config=NearDuplicates()):
    """Lists of places, one per component of texts with words."""
    numbered = brute_force(list(enumerate(texts)), config)
    groups = {}
    for place, size, root, _ in numbered:
        if size:
            groups.setdefault(root, []).append(place)
    return list(groups.values())


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    rng = random.Random(2)
    texts = [t for _, t in corpus(4)]
    rows = [(rng.choice([None, 1, 1, 2, i + 10]), t, i % 3) for i, t in enumerate(texts)]
    rows += [rows[0], (None, rows[1][1], 7), (1, None, 1), (1, None, 1), (None, " \n", 2)]
    schema = "doc_id bigint, text string, row int"
    found = without_near_duplicates(spark.createDataFrame(rows, schema))
    assert found.columns == ["doc_id", "text", "row"]
    rank = lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest())
    kept = [min((rows[i] for i in group), key=rank) for group in groups_of([r[1] for r in rows])]
    kept += [r for r in rows if not (r[1] or "").split()]
    assert len(kept) < len(rows)
    got = sorted(((r[0], r[1]) for r in found.collect()), key=repr)
    assert got == sorted((r[:2] for r in kept), key=repr)
    assert {tuple(r) for r in found.collect()} <= set(rows)


@pytest.mark.parametrize("name", [None, 7])
def test_rows_without_an_id_of_their_own_take_linear_time(spark, name):
    """Pairs of copies and near-copies, 5,000 rows, with one id or none."""
    rows = []
    for i in range(1250):
        words = [f"w{i}x{j}" for j in range(30)]
        rows += [(name, " ".join(words))] * 2 + [(name, " ".join(words + [end])) for end in ("one", "two")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    began = time.monotonic()
    found = near_duplicates(docs).groupBy("component_id", "n_shingles").count().collect()
    assert sorted(map(tuple, found)) == [(name, 26, 2500), (name, 27, 2500)]
    assert without_near_duplicates(docs).count() == 1250
    assert time.monotonic() - began < 120


def forest(sets, roots):
    shorts = [(s & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for s in sets]
    found = _forest(np.arange(len(sets)), np.array(roots), shorts, np.ones(len(sets), bool), True, NearDuplicates())
    return set(zip(*(c.to_pylist() for c in found.columns)))


def test_halves_repeated_within_sets_lose_no_link():
    one = np.concatenate((np.arange(80), np.arange(20) + 2**32)).astype(np.uint64)
    two = np.where((one >= 60) & (one < 74), one + np.uint64(1000), one)
    assert len(np.intersect1d(one, two)) == 86
    assert forest([one, two], [0, 1]) == {(0, 1)}


def test_halves_shared_by_chance_hide_no_link():
    """The second set is just unlike the first, the third of its component just like it."""
    n = 200_000
    least = -(-150 * n // 175)
    drawn = np.random.default_rng(1).integers(0, 2**64, 3 * n, dtype=np.uint64)
    one = drawn[:n]
    two, three = (np.concatenate((one[:c], drawn[at : at + n - c])) for c, at in ((least - 1, n), (least, 2 * n)))
    assert (0, 2) in forest([one, two, three], [0, 1, 1])


def test_bound_on_chance_grows_with_the_sets():
    bound = _chance(np.array([1, 300, 100_000, 1_000_000]))
    assert (bound == bound.T).all() and (np.diff(bound.diagonal()) > 0).all()
    assert bound[0, 0] == 1 and bound[1, 1] == 2 and 10 < bound[2, 2] < 30 and 232 < bound[3, 3] < 1000


def test_empty_table(spark):
    assert answer(spark, []) == []


def test_sketches_estimate_similarity():
    words = WordHashes()
    text = " ".join(f"w{i}" for i in range(600))
    other = " ".join(f"w{i}" for i in range(60, 660))
    sets = [shingle_set(t, 5, words) for t in (text, other, "one two")]
    found = sketches(sets, 400)
    assert (found != np.iinfo(np.uint64).max).all()
    true = len(np.intersect1d(sets[0], sets[1])) / len(np.union1d(sets[0], sets[1]))
    assert abs((found[0] == found[1]).mean() - true) < 0.1
    # In a batch or alone, a set has one sketch.
    assert (sketches(sets[2:], 400)[0] == found[2]).all()


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 140)] + [(50, 139)]
    links = spark.createDataFrame(path + star + [(7, 7), (9, 8), (9, 8), (None, 3)], "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 50 for i in [50, *range(100, 140)]}}


def test_long_texts_go_to_workers_in_small_batches(spark, monkeypatch):
    """400 texts of 50 kB fit one batch of the session's size."""
    real = minhash._signer

    def watched(config):
        sign = real(config)

        def look(batches):
            for batch in batches:
                assert batch.nbytes < 8_000_000, batch.nbytes
                yield batch

        return lambda batches: sign(look(batches))

    monkeypatch.setattr(minhash, "_signer", watched)
    docs = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 10000) AS text")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert near_duplicates(docs).where("kept").count() == 400
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
