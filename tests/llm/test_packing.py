import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from tokenizers import Tokenizer

import corpus_pipeline
from seamline.llm.packing import Encoder, Packing, _squeezed, encoded, evolved, pack, pieces, unsqueezed
from seamline.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, piece string, length string, sequence_id string"


def check_packing(rows, capacity):
    by = {}
    for row in rows:
        by.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for seats in by.values():
        at = 0
        for offset, length in sorted(seats):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_are_those_of_the_tokenizer(spark):
    texts = [None, "", "Hello, World! it's  <|endoftext|>\n\t3.14", "é é ÀÇ x 你好", "word " * 500, "word " * 500]
    rows = [(i if i < 5 else None, t, "p", "l", "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    expected, digests = [], []
    for i, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for number, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            expected.append((i, number, start, len(part), part))
            digests.append((i, number, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    found = pieces(docs, tokenizer_path(), 64).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    found = pieces(docs, tokenizer_path(), 64, digest=True).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(digests, key=repr)
    packed = pack(pieces(docs, tokenizer_path(), 64), Packing(capacity=64))
    assert packed.count() == len(expected)
    check_packing(packed.collect(), 64)
    none = pack(pieces(docs.limit(0), tokenizer_path()))
    assert none.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    assert none.count() == 0


def test_encoder_forgets_without_harm(monkeypatch):
    monkeypatch.setattr("seamline.llm.packing._REMEMBERED", 8)
    encoder = Encoder(tokenizer_path())
    texts = [f"alpha beta{i} gamma delta{i % 3} {'long' * (i + 4)}, a\0 a {chr(937) * i}." for i in range(12)]
    whole = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(encoder.encode([t.encode()])[0], "<u4").tolist() for t in texts] == whole


def test_encoder_keeps_what_it_meets_again(monkeypatch):
    monkeypatch.setattr("seamline.llm.packing._REMEMBERED", 40)
    encoder = Encoder(tokenizer_path())
    learnt = []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda words: learnt.extend(words) or learn(words))
    for i in range(30):
        text = f"often again {' '.join(f'w{i}x{j}' for j in range(12))}"
        whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == whole
        assert encoder.used <= 40
    assert learnt.count(b"often") == learnt.count(b"again") == 1


def test_a_worker_holds_little_beside_its_texts(monkeypatch):
    asked, ids = [], Encoder._ids
    encoder = Encoder(tokenizer_path())

    class Asked:
        def encode(self, texts, **how):
            asked.append(len(texts))
            return tokenizer.encode(texts, **how)

    tokenizer, encoder.bare = encoder.bare, Asked()
    letters = ["".join(chr(97 + (i // 26**k) % 26) for k in range(4)) for i in range(300_000)]
    for at in range(0, len(letters), 50_000):
        some = letters[at : at + 50_000]
        encoder.encode([" ".join(some).encode()])
    assert max(asked) <= 5_000
    assert encoder.used <= 250_000
    tables = (encoder.words, encoder.hashes, encoder.size, encoder.at, encoder.count, encoder.met, encoder.pool, encoder.slots)
    assert sum(t.nbytes for t in tables) < 40e6
    assert b"".join(ids(tokenizer, some[:6000])) == b"".join(encoder.encode([" ".join(some[:6000]).encode()]))


def test_batches_of_texts_are_bounded(spark, monkeypatch):
    from seamline.llm import slack

    sizes = spark.sparkContext.accumulator(0)
    whole = spark.createDataFrame([(i, f"w{i} " * 60_000) for i in range(60)], "doc_id bigint, text string").coalesce(1)

    def counted(batches, *rest):
        for batch in batches:
            sizes.add(batch.num_rows > 40)
            yield from encoded([batch], *rest)

    for module in ("packing", "slack"):
        monkeypatch.setattr(f"seamline.llm.{module}.encoded", counted)
    assert pack(pieces(whole, tokenizer_path(), digest=True)).count() > 60
    assert slack.pack_tightly(whole, tokenizer_path()).count() > 60
    assert sizes.value == 0


def test_many_items_need_few_sequences(spark):
    rng = np.random.default_rng(1)
    lengths = np.minimum(2048, np.exp(rng.normal(6, 1.2, 3000)).astype(int) + 1)
    items = spark.createDataFrame([(int(n), 1) for n in lengths], "length bigint, offset int")
    rows = pack(items, Packing(shard=200)).collect()
    assert sorted(r["length"] for r in rows) == sorted(lengths.tolist())
    bound = -(-int(lengths.sum()) // 2048)
    assert check_packing(rows, 2048) <= bound + 2


def test_a_length_that_fits_no_sequence_stops_the_job(spark):
    for length in (0, 2049, None):
        with pytest.raises(PySparkException):
            pack(spark.createDataFrame([(length,)], "length bigint")).collect()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 63), min_size=1, max_size=60), st.integers(0, 5))
def test_every_packing_of_a_population_is_whole(lengths, seed):
    config = Packing(capacity=64)
    lengths = np.array(lengths)
    people = evolved(lengths, [], config, np.random.default_rng(seed))
    again = evolved(lengths, people, config, np.random.default_rng(seed + 1))
    for bins in people + again:
        filled = np.bincount(bins, lengths)
        assert (bins >= 0).all() and filled.max() <= 64 and filled.min() > 0
    assert again[0].max() <= people[0].max()


def test_best_of_hard_cases():
    # Pairs that fill a bin exactly: first fit decreasing finds them, and so must a population.
    rng = np.random.default_rng(2)
    one = rng.integers(1, 64, 40)
    lengths = rng.permutation(np.concatenate((one, 64 - one)))
    assert evolved(lengths, [], Packing(capacity=64), rng)[0].max() + 1 == 40


def test_squeezed_ids_are_the_same_and_smaller(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("alpha beta gamma delta word 12 x9".split()) for _ in range(n)) for n in (0, 1, 90, 700)]
    docs = spark.createDataFrame([*enumerate(texts), (None, None), (4, "x" * 50)], "doc_id bigint, text string")
    plain = pieces(docs, tokenizer_path(), 64)
    small = pieces(docs, tokenizer_path(), 64, squeeze=True)
    again = unsqueezed(small)
    assert again.dtypes == plain.dtypes
    assert sorted(map(repr, again.collect())) == sorted(map(repr, plain.collect()))
    full = [r for r in small.collect() if r["length"] == 64]
    assert full and max(len(r["ids"]) for r in full) <= 2 * 64


def test_the_pipeline_packs_squeezed_ids(spark):
    docs = spark.createDataFrame([(1, "a few words"), (2, "more words")], "doc_id bigint, text string")
    plan = corpus_pipeline.best_fit_packing(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow decode(" in plan


def test_ids_beyond_16_bits():
    for ids in ([0, 1, 65535], [65536, 3], [2**31 - 1], [7]):
        value = _squeezed(np.array(ids, np.uint32))
        planes = pa.decompress(value[1:], value[0] * len(ids), codec="zstd", asbytes=True)
        whole = np.frombuffer(planes, np.uint8).reshape(value[0], len(ids)).T.tobytes()
        assert np.frombuffer(whole, f"<u{value[0]}").tolist() == ids
