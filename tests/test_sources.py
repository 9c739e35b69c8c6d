import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import models
from seamline import (
    SegmenterConfig,
    as_json,
    calibrate,
    calibration_set,
    dense_turns,
    evaluate,
    evaluation_set,
    hash_encoder,
    model_encoder,
    score_turns,
    segment,
    sentence_encoder,
    turns_from_documents,
    turns_from_matrices,
    turns_from_sessions,
    turns_from_text,
    write_json,
    write_matrices,
)

TEXTS = {
    "plain": "one\ntwo\nthree\n",
    "no_final_newline": "one\ntwo",
    "blanks": "\none\n\n\ntwo\n\n",
    "windows": "one\r\ntwo\r\n\r\n",
    "old_mac": "one\rtwo\r",
    "korean": "안녕하세요\n도서관에 갔다\n",
    "empty": "",
    "newline": "\n",
}


def by_file(df):
    named = df.withColumn("conv_id", F.regexp_extract("conv_id", r"([^/]+)\.txt$", 1))
    return models.gather(named, "text")


@pytest.fixture()
def folder(tmp_path):
    for name, text in TEXTS.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    return tmp_path


def test_lines_of_whole_files(spark, folder):
    turns = turns_from_text(spark, str(folder / "*.txt"))
    assert by_file(turns) == {name: text.splitlines() for name, text in TEXTS.items() if text}
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn") + 1 - F.count("*"))
    assert all(r[1] == 0 and r[2] == 0 for r in first.collect())


def test_lines_of_split_files(spark, folder):
    long = [f"line {i} {'x' * (i % 50)}" for i in range(3000)]
    (folder / "long.txt").write_text("\n".join(long) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        turns = turns_from_text(spark, str(folder / "*.txt"))
        assert spark.read.text(str(folder / "*.txt")).select(F.spark_partition_id()).distinct().count() > 1
        same, longest = dense_turns(turns)
        assert same is turns
        got = by_file(turns)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert longest == 3000
    assert got == {name: text.splitlines() for name, text in {**TEXTS, "long": "\n".join(long)}.items() if text}


@pytest.mark.parametrize("size", (1, 7, 100))
def test_blank_lines_of_splits_are_numbered_once(spark, tmp_path, size):
    (tmp_path / "a b+c%.txt").write_text("\n" * 500 + "end")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = turns_from_text(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r.turn for r in rows) == list(range(501))
    assert {r.conv_id.rpartition("/")[2] for r in rows} == {"a b+c%.txt"}
    assert [r.turn for r in rows if r.text] == [500]


def test_documents_as_dialogues(spark):
    table = spark.createDataFrame(list(TEXTS.items()), "name string, text string")
    got = models.gather(turns_from_documents(table, "name"), "text")
    assert got == {name: text.splitlines() for name, text in TEXTS.items() if text}


@pytest.mark.parametrize("dtype", ("float64", "float32", "int32", ">f8"))
@pytest.mark.parametrize("order", ("C", "F"))
def test_matrices(spark, tmp_path, dtype, order):
    rng = np.random.default_rng(2)
    matrices = {f"m{i}": np.asarray(rng.normal(size=(n, 5)) * 9 + 1, dtype=dtype, order=order) for i, n in enumerate((1, 4, 33))}
    for name, matrix in matrices.items():
        np.save(tmp_path / f"{name}.npy", matrix)
    np.save(tmp_path / "none.npy", np.empty((0, 5)))
    turns = turns_from_matrices(spark, str(tmp_path / "*.npy"), range_bytes=200)
    named = turns.withColumn("conv_id", F.regexp_extract("conv_id", r"([^/]+)\.npy$", 1))
    got = models.gather(named, "embedding")
    assert {name: np.array(v).tolist() for name, v in got.items()} == {
        name: m.astype(float).tolist() for name, m in matrices.items()
    }
    scores = models.gather(segment(named).topics, "delta_eff")
    assert scores["m2"] == pytest.approx(models.score(matrices["m2"].astype(float)), abs=1e-12)


@pytest.mark.parametrize("array", (np.array([{}], object), np.zeros(3), np.zeros((2, 0))))
def test_unusable_matrices(spark, tmp_path, array):
    np.save(tmp_path / "bad.npy", array, allow_pickle=True)
    with pytest.raises(PySparkException):
        turns_from_matrices(spark, str(tmp_path / "bad.npy")).collect()


@pytest.mark.parametrize("part_turns, dtype", [(16_384, "float64"), (5, "float32"), (1, "float64")])
def test_matrices_are_written_and_read_again(spark, tmp_path, part_turns, dtype):
    rng = np.random.default_rng(8)
    dialogues = [rng.normal(size=(n, 3)).astype(dtype) for n in (1, 5, 11, 30)]
    turns = models.turn_table(spark, dialogues).withColumn("conv_id", F.concat(F.lit("a/b "), "conv_id")).repartition(6)
    path = f"{tmp_path}/out"
    write_matrices(turns, path, part_turns=part_turns, dtype=dtype)
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert len(files) == sum(-(-len(d) // part_turns) for d in dialogues) and "a%2Fb%203.npy" in files
    first = np.load(tmp_path / "out" / "a%2Fb%203.npy")
    assert first.dtype == dtype and first.tolist() == dialogues[3][:part_turns].tolist()
    got = turns_from_matrices(spark, path, range_bytes=100)
    assert got.count() == sum(map(len, dialogues))
    named = got.withColumn("conv_id", F.regexp_extract("conv_id", r"(\d)\.npy$", 1).cast("int"))
    assert {c: np.array(v).tolist() for c, v in models.gather(named, "embedding").items()} == {
        c: d.astype(float).tolist() for c, d in enumerate(dialogues)
    }
    # Written over, only the new files are there; added to, files of the same name are replaced.
    one = models.turn_table(spark, dialogues[:1])
    write_matrices(one, path, mode="overwrite")
    write_matrices(one, path)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["0.npy"]


def test_failed_writes_leave_nothing(spark, tmp_path):
    rows = [(c, t, [1.0, float(t)]) for c in range(8) for t in range(9)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, embedding array<double>")
    gap = turns.where("NOT (conv_id = 5 AND turn = 6)")
    for bad in (gap.where("turn <> 0"), turns.withColumn("embedding", F.when(F.col("conv_id") != 3, F.col("embedding")))):
        with pytest.raises(PySparkException):
            write_matrices(bad, f"{tmp_path}/out", part_turns=4)
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
    with pytest.raises(PySparkException):
        turns_from_matrices(spark, f"{tmp_path}/nowhere").collect()


def test_calibration_file(spark, tmp_path):
    path = tmp_path / "calibration.json"
    dialogue = {"embeddings": [[2, 0], [1, 0], [0, 3], [0, 1], [5, 0]], "pseudo_labels": [0, 1, 0, 1, 0]}
    path.write_text(json.dumps([dialogue, dialogue], indent=1))
    turns, labels = calibration_set(spark, str(path))
    assert turns.count() == labels.count() == 10
    best = calibrate(score_turns(turns, SegmenterConfig(ctx_window=1)), labels, [20, 60]).selected.first()
    assert (best.percentile, best.score, best.n) == (60, 1.0, 2)
    path.write_text(json.dumps([{**dialogue, "pseudo_labels": [0, 1]}]))
    with pytest.raises(PySparkException, match="one label"):
        calibration_set(spark, str(path))
    path.write_text("\n".join(["", json.dumps(dialogue), " ", json.dumps(dialogue), ""]))
    turns, labels = calibration_set(spark, str(path), lines=True)
    assert turns.count() == labels.count() == 10
    assert turns.select("conv_id").distinct().count() == 2


@pytest.fixture(params=(61, 150, 1 << 27))
def split_bytes(spark, request):
    """Sizes of the parts that Spark reads text in."""
    settings = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": 1}
    before = {k: spark.conf.get(k) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, str(value))
    yield request.param
    for key, value in before.items():
        spark.conf.set(key, value)


ODD_KEYS = {"note]s": ["a]b", "[{", 'q"\\'], "more": {"embeddings": [[7]], "x": ["]", "\\\\"]}, "text": 'e " ]} é'}


@pytest.mark.parametrize("indent", (None,))
def test_documents_are_the_same_for_every_split(spark, tmp_path, split_bytes, indent):
    rng = np.random.default_rng(4)
    dialogues = []
    for n in (3, 0, 4):
        vectors, labels = rng.normal(size=(n, 2)).round(3).tolist(), rng.integers(0, 2, n).tolist()
        parts = [("embeddings", vectors), ("pseudo_labels", labels), *ODD_KEYS.items()]
        dialogues.append(dict(parts[i] for i in rng.permutation(len(parts))))
    path = tmp_path / "calibration.json"
    path.write_text(json.dumps(dialogues, indent=indent, ensure_ascii=False))
    (tmp_path / "other.json").write_text(json.dumps(dialogues[:1]) + "\n")
    turns, labels = calibration_set(spark, [str(path), str(tmp_path / "other.json")])
    got = models.gather(turns.where("conv_id LIKE '%/calibration.json#%'"), "embedding")
    assert {int(c.rpartition("#")[2]): v for c, v in got.items()} == {
        i: d["embeddings"] for i, d in enumerate(dialogues) if d["embeddings"]
    }
    got = models.gather(labels.where("conv_id LIKE '%/calibration.json#%'"), "label")
    assert {int(c.rpartition("#")[2]): v for c, v in got.items()} == {
        i: d["pseudo_labels"] for i, d in enumerate(dialogues) if d["pseudo_labels"]
    }
    assert labels.count() == turns.count() == 10
    path.write_text(json.dumps({**ODD_KEYS, "golds": [[0, 1], [0], []], "preds": [[1, 0], [1], []]}, indent=indent))
    gold, pred = evaluation_set(spark, str(path))
    assert [v for _, v in sorted(models.gather(gold, "label").items())] == [[0, 1], [0]]
    assert [v for _, v in sorted(models.gather(pred, "label").items())] == [[1, 0], [1]]


@pytest.mark.parametrize("text", ['[{"embeddings": [[1, 2]], "pseudo_labels": [0', '[{"embeddings": [[1, "a"]], "pseudo_labels": [0]}]'])
def test_broken_documents(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(PySparkException):
        turns, labels = calibration_set(spark, str(tmp_path / "bad.json"))
        turns.collect()


def test_evaluation_file(spark, tmp_path):
    path = tmp_path / "evaluation.json"
    golds, preds = [[0, 0, 1, 0, 1, 0], [1, 0, 0, 0]], [[0, 1, 0, 0, 1, 0], [1, 0, 1, 0]]
    path.write_text(json.dumps({"golds": golds, "preds": preds}))
    row = evaluate(*evaluation_set(spark, str(path))).first()
    assert {k: row[k] for k in ("pk", "wd", "f1", "score")} == pytest.approx(models.corpus(golds, preds))
    path.write_text(json.dumps({"golds": golds, "preds": preds[:1]}))
    with pytest.raises(PySparkException, match="must match"):
        evaluation_set(spark, str(path))
    path.write_text("\n".join(json.dumps({"gold": g, "pred": p}) for g, p in zip(golds, preds)))
    row = evaluate(*evaluation_set(spark, str(path), lines=True)).first()
    assert {k: row[k] for k in ("pk", "wd", "f1", "score")} == pytest.approx(models.corpus(golds, preds))
    path.write_text(json.dumps({"gold": [0, 1]}))
    with pytest.raises(PySparkException, match="must match"):
        evaluation_set(spark, str(path), lines=True)


def test_matrices_of_unknown_stores_are_refused(spark):
    from seamline.sources import matrix

    assert matrix._SCHEMES["s3a"] in matrix._READABLE and "ftp" not in matrix._READABLE


def test_stored_tables_can_be_dropped(spark, tmp_path):
    from seamline import drop_stored
    from seamline.storage import store

    kept = store(spark.range(3), "kept")
    assert kept.count() == 3
    assert drop_stored(spark) > 0 and drop_stored(spark) == 0
    spark.catalog.clearCache()
    with pytest.raises(Exception):
        kept.count()


def test_sessions_and_json_results(spark, tmp_path):
    sessions = [["책을 찾다", "책을 읽다"], [], ["plane"]]
    turns = turns_from_sessions(spark, sessions)
    assert models.gather(turns, "text") == {0: sessions[0], 2: sessions[2]}
    write_json(turns, str(tmp_path / "out"))
    written = "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))
    assert "책을 찾다" in written
    lines = [json.loads(r.json) for r in as_json(turns).collect()]
    assert {"conv_id": 2, "turn": 0, "text": "plane"} in lines


def test_hash_encoder(spark):
    import hashlib

    rows = [(0, "The cat, the CAT and 1 dog"), (1, "..."), (2, None), (3, "")]
    table = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.v for r in table.select("id", hash_encoder(16)(F.col("text")).alias("v")).collect()}
    want = [0.0] * 16
    for token in ["the", "cat", "the", "cat", "and", "dog"]:
        want[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 16] += 1
    assert got == {0: want, 1: [0.0] * 16, 2: [0.0] * 16, 3: [0.0] * 16}


class Lengths:
    """A stand-in for a neural encoder."""

    def __init__(self, short=False):
        self.short = short

    def encode(self, texts):
        assert len(texts) <= 2
        return np.array([[len(t), 1.0] for t in texts])[: 1 if self.short else None]


def test_model_encoder_and_late_encoding(spark):
    sessions = [["a" * n for n in (1, 2, 40, 41, 3)], ["b"]]
    turns = turns_from_sessions(spark, sessions)
    encoder = model_encoder(Lengths, batch_size=2)
    vectors = [[[len(t), 1.0] for t in s] for s in sessions]
    for engine in ("arrow", "jvm"):
        done = segment(turns, SegmenterConfig(delta_star=0.05, engine=engine), encoder=encoder, keep=["text"])
        got = models.gather(done.topics, "delta_eff")
        assert got[0] == pytest.approx(models.score(vectors[0]), abs=1e-6)
        texts = [r.texts for r in done.segment_text().orderBy("conv_id", "start").collect()]
        assert [t for part in texts for t in part] == sessions[0] + sessions[1]
    wrong = model_encoder(lambda: Lengths(short=True), batch_size=2)
    with pytest.raises(PySparkException):
        turns.select(wrong(F.col("text"))).collect()


def test_named_encoder_is_only_loaded_by_tasks(spark):
    column = sentence_encoder()(F.col("text"))
    assert "encode" in str(column)
