import math

import numpy as np
import pytest

from seamline.llm.vectors import Pigeonhole, similar_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, n_links int"


def brute_force(rows, limit=0.98):
    def fit(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, group, links = len(rows), list(range(len(rows))), [0] * len(rows)
    for i in range(n):
        for j in range(i):
            (_, a, x), (_, b, y) = rows[i], rows[j]
            if x == y and fit(a, x) and fit(b, y) and len(a) == len(b):
                a, b = (np.asarray(x, np.float32).astype(np.float64) for x in (a, b))
                a, b = a / abs(a).max(), b / abs(b).max()
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= limit:
                    links[i] += 1
                    links[j] += 1
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
    out = []
    for i, (name, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if group[j] == group[i] and rows[j][0] is not None]
        root = min(ids) if name is not None else None
        out.append((name, links[i], root, name == root))
    return sorted(out, key=repr)


def answer(spark, rows, **config):
    table = spark.createDataFrame([(i, v, x, "n", 1) for i, v, x in rows], SCHEMA)
    return sorted((tuple(r) for r in similar_vectors(table, Pigeonhole(**config)).collect()), key=repr)


@pytest.mark.parametrize("chunk", [3, 1024])
@pytest.mark.parametrize("size", [1, 2, 12, 64])
def test_equals_brute_force(spark, size, chunk):
    rng = np.random.default_rng(size)
    rows = []
    for i in range(150):
        if i % 3 and rows:
            old = np.array(rows[rng.integers(len(rows))][1])
            v = old + rng.normal(size=size) * np.linalg.norm(old) / math.sqrt(size) * rng.choice([0, 0.1, 0.17, 0.2])
            v *= rng.choice([1, 1, 1e-3, 1e3])
        else:
            v = rng.normal(size=size)
        rows.append((int(i * 37 % 1000), [float(np.float32(x)) for x in v], int(rng.integers(2))))
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * size, 0), (2003, [float("nan")] * size, 0)]
    rows += [(2004, [1.0] * size, None), (2005, [None] + [1.0] * (size - 1), 0), (2006, [float("inf")] * size, 0)]
    rows += [(2007, [1.0] * (size + 1), 0), (None, [1.0] * size, 0), (2008, [1.0] * size, 0), (2008, [1.0] * size, 0)]
    rows += [(2009, [-0.0] + [3.0] * size, 1), (2010, [0.0] + [3.0] * size, 1), (2011, [1e-20] * size, 0)]
    assert answer(spark, rows, chunk=chunk) == brute_force(rows)


def test_empty_table(spark):
    assert answer(spark, []) == []
