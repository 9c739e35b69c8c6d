import itertools
import re
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from seamline.llm import dialogues, queries, sql
from seamline.llm.dialogues import Repair, repair_conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost string, chunk int, id string"
SOUND = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, found = set(), []
    for role, text in rows:
        solid = text.rstrip(dialogues.SPACES)
        if not solid:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("sound" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def cheapest(rows, kinds, inserts=3):
    """Cost, audit and lines of the best of all edits, tried one by one."""
    best = None
    options = []
    for (role, text), kind in zip(rows, kinds):
        more = 3 if kind == "truncated" else 0
        stays = [("K", role, text, more)] + [("R", r, text, 3 + more) for r in ("user", "assistant")]
        options.append([("D", None, None, 4)] + (stays if kind in ("sound", "truncated") else []))
    new = [("I", r, "", 3) for r in ("user", "assistant")]
    gaps = [g for n in range(inserts) for g in itertools.product(new, repeat=n)]
    for middle in itertools.product(gaps, repeat=len(rows) + 1):
        if sum(map(len, middle)) > 3:
            continue
        for chosen in itertools.product(*options):
            edits = [*middle[0], *itertools.chain.from_iterable((e, *g) for e, g in zip(chosen, middle[1:]))]
            lines = [(r, t) for _, r, t, _ in edits if r is not None]
            if SOUND.fullmatch("".join(r[:1] or "?" for r, _ in lines)):
                audit = "".join(e for e, *_ in edits)
                best = min(filter(None, (best, (sum(c for *_, c in edits), audit, lines))), key=lambda x: x[:2])
    return best


def brute_force(rows):
    """The report of each conversation and its repaired lines."""
    found = {}
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, items in by.items():
        items.sort(key=lambda x: (x[0] is not None, x[0] or 0, sha256(f"{len(x[1].encode())}:{x[1]}{x[2]}".encode()).hexdigest()))
        pairs = [x[1:] for x in items]
        kinds = faults(pairs)
        turns = {t for t, *_ in items if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        letters = [r[:1] for r, _ in pairs]
        wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        cost, audit, lines = cheapest(pairs, kinds)
        counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        found[conv] = ((gaps, *counts, wrong, cost, audit), lines)
    return found


def compare(spark, rows, repair=Repair()):
    done = repair_conversations(spark.createDataFrame(rows, SCHEMA), repair)
    report = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in done.report.collect()}
    lines = {}
    for r in done.lines.orderBy("conv_id", "chunk", "place").collect():
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    expected = brute_force(rows)
    assert report == {c: e[0] for c, e in expected.items()}
    assert lines == {c: e[1] for c, e in expected.items() if e[1]}
    digests = {r.conv_id: r.sha256 for r in dialogues.line_digests(done.lines).collect()}
    assert digests == {
        c: sha256("\n".join(f"{r}:{t}" for r, t in e[1]).encode()).hexdigest() for c, e in expected.items() if e[1]
    }


@pytest.mark.parametrize("seed, bits", [(0, 12), (1, 0), (2, 1)])
def test_equals_brute_force(spark, seed, bits):
    rng = np.random.default_rng(seed)
    roles, texts = ["system", "user", "user", "assistant", "assistant", "tool", None, ""], ["A.", "B!", "C", " ", None, "D?\n", ""]
    rows = []
    for conv in [None, *range(45)]:
        for turn in range(rng.integers(1, 5)):
            turn = None if rng.random() < 0.1 else int(turn * rng.integers(1, 3))
            rows.append((conv, turn, roles[rng.integers(8)], texts[rng.integers(7)], "x", 1, "y"))
    rows += rows[:3]
    compare(spark, rows, Repair(bits=bits))


def test_long_conversation_does_not_depend_on_chunks(spark):
    rng = np.random.default_rng(5)
    rows = []
    for turn in range(700):
        role = ("user", "assistant", "system")[rng.choice(3, p=(0.49, 0.49, 0.02))]
        rows.append((int(turn > 650), turn, role, f"{turn if rng.random() < 0.9 else 0}{'.' if rng.random() < 0.9 else ''}", "", 0, ""))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = []
    for bits in (12, 4, 0):
        done = repair_conversations(docs, Repair(bits=bits))
        lines = dialogues.line_digests(done.lines)
        found.append((sorted(map(tuple, done.report.collect())), sorted(map(tuple, lines.collect()))))
    assert found[0] == found[1] == found[2]
    assert all(SOUND.fullmatch("".join(r.role[0] for r in c)) for c in [done.lines.where(f"conv_id = {i}").orderBy("chunk", "place").collect() for i in (0, 1)])


def test_no_rows_and_long_texts(spark):
    rows = [(1, 0, "user", "x" * 500_000 + ".", "", 0, ""), (1, 1, "assistant", " " * 200_000 + "y.", "", 0, "")]
    compare(spark, rows)
    none = repair_conversations(spark.createDataFrame(rows, SCHEMA).limit(0))
    assert none.report.count() == none.lines.count() == dialogues.line_digests(none.lines).count() == 0
    assert none.report.columns[0] == "conv_id"


def test_automaton():
    found = Repair().automaton
    assert all(len({s for (s, _), t in found.goto.items() if t == state}) == 1 for state in found.below)
    for word in map("".join, itertools.chain.from_iterable(itertools.product("sua", repeat=n) for n in range(6))):
        top = 0
        for letter in word:
            top = found.moves[top].get(letter) if top is not None else None
        assert (top in found.ends) == bool(SOUND.fullmatch(word))
    with pytest.raises(ValueError, match="entered from two"):
        dialogues.Automaton((("d", ("x", "t")), ("d", ("t",)), ("t", ("u", "a"))))


def test_query_equals_its_sql(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    extra = [(900, None, "user", "A."), (900, 1, None, None), (None, None, "tool", "B"), (None, 3, "assistant", "C.")]
    extra += [(901, t, ("user", "assistant")[t % 2], f"{t % 40}.") for t in range(90)]
    rows = source.union(spark.createDataFrame(extra, source.schema))
    rows.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(sql.OP11)
    names = [c[0] for c in want.description]
    got = queries.queries()["op11_repair"](spark, str(tmp_path))
    found = [tuple(r[c] for c in names) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(want.fetchall(), key=repr)
    assert len(found) == rows.select("conv_id").distinct().count()
