import itertools
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seamline.llm import merkle, queries, sql

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, hash int"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def fold(nodes, place=None):
    """The root of a row of nodes, and the siblings on the way of one of them."""
    way = []
    while len(nodes) > 1:
        if place is not None:
            way += [nodes[place ^ 1]] if place ^ 1 < len(nodes) else []
            place //= 2
        nodes = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], way


def brute_force(rows):
    """Root, and (id, leaf, group, place, proof) of every row."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row[0]))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    leaves = {n: [x[2] for x in sorted(groups[n], key=lambda x: x[:3])] for n in names}
    ids = {n: [x[3] for x in sorted(groups[n], key=lambda x: x[:3])] for n in names}
    subroots = [fold(leaves[n])[0] for n in names]
    found = []
    for rank, n in enumerate(names):
        for place, one in enumerate(leaves[n]):
            proof = fold(leaves[n], place)[1] + fold(subroots, rank)[1]
            found.append((ids[n][place], one, n, place, subroots[rank], "".join(proof)))
    return (fold(subroots)[0] if names else None), found


def rows_of(count, seed=0):
    rng = np.random.default_rng(seed)
    langs = [None, "", "de", "en", "en", "en", "é", "z", "日本"]
    rows = []
    for i in range(count):
        lang = langs[rng.integers(len(langs))]
        text = [None, "", "text", "é" * int(rng.integers(1, 9)), "x" * 70_000][rng.integers(5)]
        rows.append((int(i) if i % 9 else None, [None, "s"][i % 2], lang, [None, i][i % 3 > 0], text, "clash", 1))
    return rows + rows[:7] * 3


def proofs(df):
    return sorted(((r.id, r.leaf, r.name, r.idx, r.subroot, r.proof) for r in df.collect()), key=repr)


@pytest.mark.parametrize("bits", (1, 2, 12))
def test_equals_brute_force(spark, bits):
    rows = rows_of(60)
    docs = spark.createDataFrame(rows, SCHEMA)
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tree = merkle.manifest(docs, FIELDS, "doc_id", "lang", changed, bits=bits)
    root, expected = brute_force(rows)
    assert tree.root == root
    found = merkle.prove(tree)
    assert proofs(found) == sorted(expected, key=repr)
    changeable = {leaf(r) for r in rows if r[3] is not None}
    for r in found.collect():
        assert r.root == root and (r.folded_root != root) == (r.leaf in changeable)
    # A few leaves only: what they lack is fetched from all levels.
    few = merkle.prove(tree, F.col("idx") % 3 == 1)
    assert proofs(few) == sorted((e for e in expected if e[3] % 3 == 1), key=repr)


def test_missing_is_sound_and_minimal():
    for total in range(1, 10):
        for size in range(1, total + 1):
            for known in itertools.combinations(range(total), size):
                asked = merkle.missing(np.array(known), total)
                heights = (total - 1).bit_length()

                def derives(extra):
                    level, count = set(known), total
                    for at in range(heights):
                        level |= {i for a, i in extra if a == at}
                        if any(i ^ 1 < count and i ^ 1 not in level for i in level):
                            return False
                        level, count = {i >> 1 for i in level}, (count + 1) // 2
                    return True

                assert derives(asked)
                assert all(not derives([a for a in asked if a != one]) for one in asked)


def test_one_row_no_rows_and_one_group(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, "", 0)], SCHEMA)
    tree = merkle.manifest(docs, FIELDS, "doc_id", "lang")
    row = merkle.prove(tree).first()
    assert row.proof == "" and row.leaf == row.subroot == row.root == row.folded_root == h("1:1----")
    none = merkle.manifest(docs.limit(0), FIELDS, "doc_id", "lang")
    assert none.root is None and merkle.prove(none).count() == 0
    same = spark.createDataFrame([(5, "s", "en", 1, "t", "", 0)] * 33, SCHEMA)
    tree = merkle.manifest(same, FIELDS, "doc_id", "lang", bits=3)
    found = merkle.prove(tree).collect()
    assert sorted(r.idx for r in found) == list(range(33)) and {r.folded_root for r in found} == {tree.root}


def test_wrong_nodes_are_noticed(spark):
    docs = spark.createDataFrame(rows_of(40, 1), SCHEMA)
    tree = merkle.manifest(docs, FIELDS, "doc_id", "lang", bits=2)
    wrong = merkle.Manifest(tree.leaves, tree.nodes.withColumn("hash", F.sha2("hash", 256)), tree.groups, tree.top, tree.root, 2)
    with pytest.raises(PySparkException, match="do not fit"):
        merkle.prove(wrong).collect()


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(sql.OP13)
    names = [c[0] for c in want.description]
    got = [tuple(r[c] for c in names) for r in queries.queries()["op13_merkle"](spark, folder).collect()]
    assert sorted(got) == sorted(want.fetchall())
