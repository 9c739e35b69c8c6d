import itertools
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from seamline.llm import slack
from seamline.llm.queries import queries, tokenizer_path
from seamline.llm.slack import closest, pack_tightly, planned

SCHEMA = "doc_id bigint, text string, start string, length string, item string, sequence_id string"


def padding(sizes, capacity):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in sizes)


def sequences(places):
    """Lengths of the sequences, whose pieces must lie gapless from 0."""
    by = {}
    for window, offset, length in places:
        by.setdefault(window, []).append((offset, length))
    for seats in by.values():
        at = 0
        for offset, length in sorted(seats):
            assert offset == at
            at += length
    return [sum(length for _, length in seats) for seats in by.values()]


def laid_out(counts, capacity):
    """Every rest put in its place by the plan, and checked."""
    plan = np.array(sorted(planned(dict(counts), capacity).rows), np.int64).reshape(-1, 7)
    length = np.repeat(list(counts), list(counts.values())).astype(np.int64)
    number = np.concatenate([np.arange(c) for c in counts.values()]).astype(np.int64)
    row, start, size, window, offset = slack.seats(plan, length, number)
    for one in range(len(length)):
        parts = sorted(zip(start[row == one].tolist(), size[row == one].tolist()))
        assert [s for s, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist()
        assert sum(n for _, n in parts) == length[one]
    sizes = sequences(zip(window.tolist(), offset.tolist(), size.tolist()))
    assert max(sizes, default=0) <= capacity and padding(sizes, capacity) == 0
    assert sum(n < capacity for n in sizes) <= capacity.bit_length()
    return len(row) - len(length)


@pytest.mark.parametrize("seed", range(12))
def test_closest_is_the_best_subset(seed):
    rng = np.random.default_rng(seed)
    left = {int(n): int(rng.integers(1, 4)) for n in rng.integers(2, 40, size=5)}
    used = closest(dict(left), 64)
    assert all(0 < k <= left[n] for n, k in used.items()) and max(left) in used
    rest = {n: c - (n == max(left)) for n, c in left.items()}
    sums = [
        max(left) + sum(n * k for n, k in zip(rest, some))
        for some in itertools.product(*[range(c + 1) for c in rest.values()])
    ]
    assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= 64)


@pytest.mark.parametrize("seed", range(8))
def test_nothing_is_padded_and_all_is_placed(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 64, size=int(rng.integers(1, 400)))
    laid_out({int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}, 64)


@pytest.mark.parametrize("length, count", [(1, 200), (3, 500), (33, 100), (47, 64), (63, 65), (63, 1), (5, 7)])
def test_rests_of_one_length(length, count):
    laid_out({length: count}, 64)


def test_cuts_are_few_and_choices_do_not_grow():
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.geometric(1 / 400, size=20_000), 2047)
    counts = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True))}
    assert laid_out(counts, 2048) <= len(lengths) / 200
    some = planned(dict(counts), 2048)
    many = planned({n: c * 1_000_003 for n, c in counts.items()}, 2048)
    tokens = sum(n * c for n, c in counts.items())
    assert many.windows >= tokens * 1_000_003 // 2048 and len(many.rows) < 20 * len(some.rows)
    assert planned({}, 2048).rows == []


def test_pieces_hold_the_ids_of_the_tokenizer(spark):
    texts = [None, "", "Hello, World! it's  <|endoftext|>\n\t3.14", "é É ÀÇ x 你好 ÷ a÷b <|ENDOFTEXT|>x ß&&É÷É1 it's, don'T", "word " * 900, "Word, " * 500]
    texts += [f"a b{i} c" * (i % 17) for i in range(150)]
    rows = [(i if i < 5 else None, t, "s", "l", "i", "q") for i, t in enumerate([*texts, *texts[:9]])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    whole = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t, *_ in rows]
    for capacity in (64, 2048):
        found = pack_tightly(docs, tokenizer_path(), capacity).collect()
        sizes = sequences((r.sequence_id, r.offset, r.length) for r in found)
        assert padding(sizes, capacity) == 0 and max(sizes) <= capacity
        assert sum(sizes) == sum(map(len, whole)) == sum(len(r.ids) // 4 for r in found)
        # Pieces with an id give their documents back; of the others the tokens agree in all.
        for doc in range(5):
            parts = sorted((r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in found if r.doc_id == doc)
            assert sum((p for _, p in parts), []) == whole[doc]
            assert [s for s, _ in parts] == np.cumsum([0, *[len(p) for _, p in parts[:-1]]]).tolist()
            assert {r.doc_tokens for r in found if r.doc_id == doc} == {len(whole[doc])}
        rest = np.sort(np.concatenate([np.frombuffer(r.ids, "<u4") for r in found if r.doc_id is None]))
        assert rest.tolist() == sorted(sum(whole[5:], []))
    none = pack_tightly(docs.limit(0), tokenizer_path())
    assert none.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"] and none.count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    found = queries()["op12_slack"](spark, folder).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r.doc_id for r in found} == set(docs)
    for row in found:
        ids = tokenizer.encode(docs[row.doc_id] or "", add_special_tokens=False).ids + [1]
        part = np.array(ids[row.start : row.start + row.length], "<u4").tobytes()
        assert (row.doc_tokens, row.ids_crc32) == (len(ids), zlib.crc32(part))
    sizes = sequences((r.sequence_id, r.offset, r.length) for r in found)
    assert padding(sizes, 2048) == 0
