import hashlib
import random
import re
from fractions import Fraction

import pytest

from seamline.llm.mixing import Mix, mix, targets

SCHEMA = "doc_id bigint, text string, source string, size int, target string, _mix int"


def fair_targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), repeats=2):
    """Water filling by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    budget, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if budget * weight[s] / total > repeats * sizes[s]}
        if not over:
            return out | {s: budget * weight[s] / total for s in open_}
        for s in over:
            out[s] = Fraction(repeats * sizes[s])
            budget -= out[s]
        open_ -= over
    return out


def brute_force(rows, repeats=2):
    sized = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows]
    sizes = {}
    for _, n, s in sized:
        sizes[s] = sizes.get(s, 0) + n
    goal = fair_targets(sizes, repeats=repeats)
    places = {s: k for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}

    def key(number):
        i, text, _ = rows[number]
        digest = hashlib.md5((text or "").encode()).hexdigest()
        return hashlib.md5(f"mix:{'null' if i is None else i}:{digest}".encode()).hexdigest(), number

    queue = []
    for number, (i, _, s) in enumerate(sized):
        upto = sum(m for j, (_, m, t) in enumerate(sized) if t == s and key(j) <= key(number))
        for round_ in range(repeats):
            finish = float((sizes[s] * round_ + upto) / goal[s]) if goal[s] else 0.0
            queue.append(((finish, places[s], round_, key(number)), number))
    taken = [0] * len(rows)
    budget = Fraction(3, 2) * sum(sizes.values())
    for place, number in queue:
        if sum(sized[n][1] for p, n in queue if p <= place) <= budget:
            taken[number] += sized[number][1]
    return sorted([(i, n, sizes[s], float(goal[s]), t) for (i, n, s), t in zip(sized, taken)], key=repr)


def rows_of(seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randrange(60), rng.choice(["a"] * 6 + ["b", "c", "d", None])) for i in range(120)]
    return rows + [(500, None, "a"), (501, "", "empty"), (None, "x y", "b"), (None, "x y z", "b"), (3, "again", "zz")] + [
        (502, "w " * 900, "c"),
        (502, "w " * 900, "c"),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_whatever_the_partitions(spark, seed):
    rows = rows_of(seed)
    docs = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], SCHEMA)
    expected = brute_force(rows)
    for shuffled in (docs, docs.repartition(7).orderBy("text")):
        found = mix(shuffled).select("doc_id", "_mix.*").collect()
        found = sorted(map(tuple, found), key=repr)
        assert [(*r[:3], r[4]) for r in found] == [(*r[:3], r[4]) for r in expected]
        assert [r[3] for r in found] == pytest.approx([r[3] for r in expected])
    words = sum(r[1] for r in expected)
    assert sum(r[4] for r in expected) <= 1.5 * words
    assert all(r[4] in (0, r[1], 2 * r[1]) for r in expected)


@pytest.mark.parametrize("name", [None, 4])
def test_rows_without_an_id_of_their_own_reach_their_targets(spark, name):
    """Nine in ten rows of a source share an id or have none, many of them a text too."""
    rng = random.Random(6)
    rows = [(name if i % 10 else i, "w " * rng.choice([5, 90, 100]) + rng.choice(["", f"own{i}"]), "a") for i in range(300)]
    rows += [(1000 + i, "w " * rng.randrange(100), "b") for i in range(300)]
    expected = brute_force(rows)
    docs = spark.createDataFrame([(*r, 1, "t", 2) for r in rows], SCHEMA).repartition(5)
    found = sorted((tuple(r) for r in mix(docs).select("doc_id", "_mix.*").collect()), key=repr)
    assert [(*r[:3], r[4]) for r in found] == [(*r[:3], r[4]) for r in expected]
    for size in {r[2] for r in found}:
        own = [r for r in found if r[2] == size]
        assert abs(sum(r[4] for r in own) - own[0][3]) <= 200


def test_targets_share_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 20, "d": 400, None: 0}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    found = {r["source"]: r["target"] for r in targets(rows).collect()}
    assert found == {s: pytest.approx(float(t)) for s, t in fair_targets(sizes).items()}


def test_empty_and_wordless_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mix(docs).collect() == []
    docs = spark.createDataFrame([(1, " ", "a", 1, "t", 2)], SCHEMA)
    row = mix(docs, Mix()).first()
    assert (row["doc_id"], tuple(row["_mix"])) == (1, (0, 0, 0.0, 0))


def test_texts_are_not_dealt_out(spark):
    """The rows are written once with their keys; which of them are taken is told by a key per source."""
    docs = spark.createDataFrame([(*r, 1, "t", 2) for r in rows_of(3)], SCHEMA)
    plan = mix(docs, keep=["doc_id", "text"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
