"""
each of them is checked against."""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle  # noqa: E402
import seamline as sl  # noqa: E402
from seamline.functions.vectors import norm, problem_by_batch, scaled  # noqa: E402
from seamline.operators import topics as reports  # noqa: E402
from seamline.operators.evaluation import dialogue_metrics, dialogue_stats  # noqa: E402
from seamline.operators.validation import paired_labels  # noqa: E402
from seamline.storage import CHECKPOINT_DIR, new_path, store  # noqa: E402
from seamline.streaming.ordered import STORE, STORE_SETTING  # noqa: E402

try:
    import corpus_pipeline  # noqa: E402
    from seamline.llm import queries as llm_queries  # noqa: E402
    from seamline.llm import sql as llm_sql  # noqa: E402
except ImportError as missing:
    # The subpackage and its pipeline are optional; a fault within them is not to be passed over.
    if (missing.name or "").split(".")[:2] not in (["corpus_pipeline"], ["seamline", "llm"]):
        raise
    corpus_pipeline = None

#: Parameters of the queries on the ``embeddings`` table, whose vectors are far apart.
EMB = sl.SegmenterConfig(delta_star=0.95)
#: Parameters of the queries on hashed texts.
TEXT = sl.SegmenterConfig(delta_star=0.55, dim=256)


def entry(spark: SparkSession) -> DataFrame:
    """Topic segments of the conversations, from their texts."""
    return _prepared(_conversation_segments)(spark, "/root/testdata/sf0.001")


def oracle_sql() -> dict[str, str]:
    statements = oracle.statements()
    if corpus_pipeline:
        statements |= llm_sql.statements()
        if corpus_pipeline.ORACLE_SQL:
            statements["pipeline"] = corpus_pipeline.ORACLE_SQL
    return statements


# -------------------------------------------------------------------- inputs


def _prepared(query):
    """The query, with the package on the workers and a folder for stored tables.

    On a cluster the session names the folder; a local session gets one here.
    """

    def run(spark: SparkSession, folder: str) -> DataFrame:
        context = spark.sparkContext
        unset = not (spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir())
        if unset and context.master.startswith("local"):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="seamline-"))
        sl.ship(spark)
        return query(spark, folder)

    return run


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _as_dialogues(vectors: DataFrame) -> DataFrame:
    """Twenty consecutive vectors make a dialogue."""
    return vectors.select(
        F.expr("vec_id div 20").alias("conv_id"), (F.col("vec_id") % 20).alias("turn"), "embedding", "label"
    )


def _embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return _as_dialogues(_table(spark, folder, "embeddings"))


def _conversations(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "conversations").select("conv_id", "turn", "text")


def _document_lines(spark: SparkSession, folder: str) -> DataFrame:
    return sl.turns_from_documents(_table(spark, folder, "documents"), "doc_id")


def _scored(spark: SparkSession, folder: str, config: sl.SegmenterConfig = EMB) -> tuple[DataFrame, int]:
    turns, longest = sl.dense_turns(_embeddings(spark, folder))
    return sl.score_turns(turns, config, longest=longest), longest


def _segmented(spark: SparkSession, folder: str, config: sl.SegmenterConfig = EMB) -> sl.Segmentation:
    return sl.segment(_embeddings(spark, folder), config)


def _gold(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """1 on the last turn before the label of the vectors changes."""
    turns, longest = sl.dense_turns(_embeddings(spark, folder).select("conv_id", "turn", "label"))
    following = F.lead("label").over(Window.partitionBy("conv_id").orderBy("turn"))
    changes = F.coalesce((following != F.col("label")).cast("int"), F.lit(0))
    return turns.select("conv_id", "turn", changes.alias("label")), longest


def _pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    gold, longest = _gold(spark, folder)
    return paired_labels(gold, _segmented(spark, folder).end_turn_labels()), longest


def _r(column: str | Column) -> Column:
    return F.round(column, 6)


def _rounded(df: DataFrame) -> DataFrame:
    """Every double to six decimals, as both engines are compared on."""
    doubles = {name for name, kind in df.dtypes if kind == "double"}
    return df.select(*[_r(c).alias(c) if c in doubles else F.col(c) for c in df.columns])


# ------------------------------------------------------------------- queries


def _turns_from_text(spark, folder):
    return _document_lines(spark, folder)


def _text_file_turns(spark, folder):
    """Write the conversations as text files, a range of them in each, and read those."""
    path = new_path(spark, "text")
    lines = _conversations(spark, folder).select(
        F.expr("conv_id div 64").alias("bucket"),
        "conv_id",
        "turn",
        F.regexp_replace("text", r"[\r\n]+", " ").alias("value"),
    )
    placed = lines.repartition("bucket").sortWithinPartitions("bucket", "conv_id", "turn")
    placed.select("bucket", "value").write.partitionBy("bucket").text(path)
    turns = sl.turns_from_text(spark, f"{path}/bucket=*/*.txt")
    bucket = F.regexp_extract("conv_id", r"bucket=(\d+)", 1).cast("bigint")
    return turns.select(bucket.alias("bucket"), "turn", "text")


def _session_turns(spark, folder):
    """Turns of sessions held as arrays; those nobody asked anything in are empty."""
    asked = F.when(F.col("role") == "user", F.struct("turn", "text"))
    sessions = (
        _table(spark, folder, "conversations")
        .groupBy(F.col("conv_id").alias("session_id"))
        .agg(F.sort_array(F.collect_list(asked)).alias("items"))
    )
    return sl.turns_from_arrays(sessions.select("session_id", F.col("items.text").alias("exchanges")))


def _matrix_turns(spark, folder, part_turns=reports.PART_TURNS):
    """Write each dialogue's vectors as matrix files and read those."""
    path = new_path(spark, "matrices")
    sl.write_matrices(_embeddings(spark, folder), path, part_turns=part_turns, dtype="float32")
    turns = sl.turns_from_matrices(spark, path)
    conv = F.regexp_extract("conv_id", r"(\d+)\.npy$", 1).cast("bigint")
    return turns.select(conv.alias("conv_id"), "turn", F.size("embedding").alias("dim"), _r(F.col("embedding")[0]).alias("first"))


def _calibration_json(spark, folder):
    """Write dialogues as JSON lines of vectors and labels and read those."""
    path = new_path(spark, "calibration")
    gold, _ = _gold(spark, folder)
    turns, _ = sl.dense_turns(_embeddings(spark, folder).select("conv_id", "turn", "embedding"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "embedding", "label")))
    dialogues = turns.join(gold, ["conv_id", "turn"]).groupBy("conv_id").agg(ordered.alias("x"))
    both = F.struct(F.col("x.embedding").alias("embeddings"), F.col("x.label").alias("pseudo_labels"))
    dialogues.select(F.to_json(both)).write.text(path)
    vectors, labels = sl.calibration_set(spark, path, lines=True)
    rows = vectors.join(labels, ["conv_id", "turn"])
    return rows.select("turn", F.col("label").cast("bigint").alias("label"), _r(F.col("embedding")[0]).alias("first"))


def _evaluation_json(spark, folder):
    """Write label sequences as JSON lines, read those and evaluate them."""
    path = new_path(spark, "evaluation")
    pairs, longest = _pairs(spark, folder)
    ordered = F.sort_array(F.collect_list(F.struct("turn", "gold", "pred")))
    dialogues = pairs.groupBy("conv_id").agg(ordered.alias("x"))
    both = F.struct(F.col("x.gold").alias("gold"), F.col("x.pred").alias("pred"))
    dialogues.select(F.to_json(both)).write.text(path)
    gold, pred = sl.evaluation_set(spark, path, lines=True)
    return _rounded(sl.evaluate(gold, pred, longest=longest))


def _lines_of_document(rows, path):
    """Write lines (dialogue, section, turn, value) as one document, a single file."""
    ordered = rows.repartition(1).sortWithinPartitions("conv_id", "section", "turn")
    ordered.select("value").write.text(path)


@contextmanager
def _small_splits(spark):
    """Text read in parts of 64 KB, so that a document of a test table has several."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "64k")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _listed(rows, value, opening, closing, first=0):
    """Lines of the values of each dialogue, one after another with commas between, and what stands around."""
    comma = F.when(F.col("turn") > 0, ",").otherwise("")
    lines = rows.select("conv_id", F.lit(first + 1).alias("section"), "turn", F.concat(comma, value).alias("value"))
    around = rows.select("conv_id").distinct()
    for section, text in ((first, opening), (first + 2, closing)):
        lines = lines.union(around.select("conv_id", F.lit(section), F.lit(0).cast("bigint"), F.lit(text)))
    return lines


def _line(spark, conv, text):
    return spark.range(1).select(F.lit(conv).cast("bigint"), F.lit(0), F.lit(0).cast("bigint"), F.lit(text))


def _calibration_document(spark, folder):
    """Write dialogues as one JSON list of vectors and labels and read that, many tasks at a time."""
    path = new_path(spark, "calibration")
    gold, _ = _gold(spark, folder)
    turns, _ = sl.dense_turns(_embeddings(spark, folder).select("conv_id", "turn", "embedding"))
    rows = _listed(turns, F.to_json("embedding"), '{"embeddings": [', '], "pseudo_labels": [')
    rows = rows.union(_listed(gold, F.col("label").cast("string"), "", "]},", 3))
    empty = '{"embeddings": [], "pseudo_labels": []}]'
    _lines_of_document(rows.union(_line(spark, -1, "[")).union(_line(spark, 2**62, empty)), path)
    with _small_splits(spark):
        vectors, labels = sl.calibration_set(spark, path)
    rows = vectors.join(labels, ["conv_id", "turn"])
    return rows.select("turn", F.col("label").cast("bigint").alias("label"), _r(F.col("embedding")[0]).alias("first"))


def _evaluation_document(spark, folder):
    """Write label sequences as one JSON object, read that and evaluate them."""
    path = new_path(spark, "evaluation")
    pairs, longest = _pairs(spark, folder)
    rows = None
    for key, base in (("gold", 0), ("pred", 2**60)):
        some = pairs.select((F.col("conv_id") + base).alias("conv_id"), "turn", F.col(key).alias("label"))
        some = _listed(some, F.col("label").cast("string"), "[", "],")
        rows = some if rows is None else rows.union(some)
    for at, text in ((-1, '{"golds": ['), (2**60 - 1, '[]], "preds": ['), (2**62, "[]]}")):
        rows = rows.union(_line(spark, at, text))
    _lines_of_document(rows, path)
    with _small_splits(spark):
        gold, pred = sl.evaluation_set(spark, path)
    return _rounded(sl.evaluate(gold, pred, longest=longest))


def _numbered_turns(spark, folder):
    """Positions of a customer's orders, whose keys have gaps."""
    orders = _table(spark, folder, "orders").select(
        F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").alias("turn"), "o_orderkey"
    )
    return sl.number_turns(orders)


def _hash_encode(spark, folder):
    return _token_counts(_conversations(spark, folder).withColumn("embedding", sl.hash_encoder()(F.col("text"))))


def _encode_distinct(spark, folder):
    """The same vectors, each distinct text encoded once."""
    return _token_counts(sl.encode_distinct(_conversations(spark, folder), sl.hash_encoder()))


def _token_counts(encoded):
    cells = encoded.select("conv_id", "turn", F.posexplode("embedding").alias("bucket", "count"))
    return cells.where("count > 0").select(
        "conv_id", "turn", F.col("bucket").cast("bigint").alias("bucket"), F.col("count").cast("bigint").alias("count")
    )


def _invalid_embeddings(spark, folder):
    """Vectors of three labels are spoilt to show the three ways to be unfit."""
    spoilt = (
        F.when(F.col("label") == 0, scaled(F.col("embedding"), F.lit(0.0)))
        .when(F.col("label") == 1, F.slice("embedding", 1, 63).cast("array<double>"))
        .when(F.col("label") == 2, scaled(F.col("embedding"), F.lit(float("inf"))))
        .otherwise(F.col("embedding").cast("array<double>"))
    )
    turns = _embeddings(spark, folder).withColumn("embedding", spoilt)
    return sl.invalid_embeddings(turns, dim=64).select("conv_id", "turn", "reason")


def _invalid_text_turns(spark, folder):
    """Lines of each document, and those of them without a token, in one pass."""
    turns = _document_lines(spark, folder)
    marked = turns.withColumn("reason", problem_by_batch(sl.hash_encoder()(F.col("text")), 256))
    return marked.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("reason").alias("n_invalid")
    )


def _mixed_dimensions(spark, folder):
    """Dialogues of which some vectors have been cut short."""
    short = F.when(F.col("label") == 1, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return sl.mixed_dimensions(_embeddings(spark, folder).withColumn("embedding", short))


def _label_violations(spark, folder):
    """Gold labels against a copy with wrong values and missing turns."""
    turns = _embeddings(spark, folder)
    gold, _ = _gold(spark, folder)
    spoilt = turns.where("label <> 1").select(
        "conv_id", "turn", F.when(F.col("label") == 0, 2).otherwise(0).alias("label")
    )
    return sl.label_violations(paired_labels(gold, spoilt))


def _unit_vectors(spark, folder):
    vectors = _table(spark, folder, "embeddings").withColumn("length", norm(F.col("embedding")))
    units = vectors.select("vec_id", scaled(F.col("embedding"), 1 / F.col("length")).alias("unit"))
    return units.select("vec_id", F.posexplode("unit").alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("bigint").alias("pos"), _r("value").alias("value")
    )


def _adjacent_distance(spark, folder):
    return _rounded(_scored(spark, folder)[0].select("conv_id", "turn", "d_prev"))


def _context_distance(spark, folder):
    two, longest = _scored(spark, folder)
    three = sl.score_turns(
        sl.dense_turns(_embeddings(spark, folder))[0],
        sl.SegmenterConfig(delta_star=0.95, ctx_window=3),
        longest=longest,
    )
    both = two.select(F.lit(2).alias("m"), "conv_id", "turn", "d_ctx").union(
        three.select(F.lit(3).alias("m"), "conv_id", "turn", "d_ctx")
    )
    return _rounded(both)


def _context_distance_legacy(spark, folder):
    config = sl.SegmenterConfig(delta_star=0.95, ctx_window=4, warmup="legacy")
    return _rounded(_scored(spark, folder, config)[0].select("conv_id", "turn", "d_ctx"))


def _blended_score(spark, folder):
    return _rounded(_scored(spark, folder)[0].select("conv_id", "turn", "delta_eff"))


def _graded_score(spark, folder):
    graded = reports.graded_score(EMB.delta_star).alias("graded_score")
    return _rounded(_scored(spark, folder)[0].select("conv_id", "turn", graded))


def _boundary_flags(spark, folder):
    flag = reports.is_boundary(EMB.delta_star).alias("is_boundary")
    return _scored(spark, folder)[0].select("conv_id", "turn", flag)


def _topic_ids(spark, folder):
    return _segmented(spark, folder).topics.select("conv_id", "turn", "topic_id")


def _history(spark, folder):
    return _rounded(_segmented(spark, folder).history())


def _history_sql(spark, folder):
    """The history by the table function of SQL."""
    sl.register_tables(spark)
    call = "segment_turns(TABLE({turns}) PARTITION BY conv_id ORDER BY turn, delta_star => 0.95D)"
    return _rounded(spark.sql(f"SELECT * FROM {call}", turns=_embeddings(spark, folder)))


def _history_jvm(spark, folder):
    config = sl.SegmenterConfig(delta_star=0.95, engine="jvm")
    return _rounded(_segmented(spark, folder, config).history())


def _history_split(spark, folder):
    """The history with every dialogue spread over chunks of seven turns."""
    config = sl.SegmenterConfig(delta_star=0.95, chunk_turns=7)
    return _rounded(_segmented(spark, folder, config).history())


def _strength_bands(spark, folder):
    band = reports.strength_band(reports.graded_score(EMB.delta_star)).alias("band")
    return _scored(spark, folder)[0].select("conv_id", "turn", band)


def _strength_histogram(spark, folder):
    return _segmented(spark, folder).strength_histogram()


def _strength_rollup(spark, folder):
    return _segmented(spark, folder).strength_rollup()


def _strength_totals(spark, folder):
    """Strength counts of four calls, two of them made again, one after the rows have been put together."""
    totals = sl.StrengthTotals(spark, new_path(spark, "totals"))
    vectors = _embeddings(spark, folder)
    for call in (0, 1, 0, 2, 3, 2):
        totals.add(sl.segment(vectors.where(F.col("conv_id") % 4 == call), EMB).topics, call)
        if call == 2:
            totals.compact()
    return totals.total()


def _segments(spark, folder):
    return _segmented(spark, folder).segments()


def _segments_json(spark, folder):
    """Segments written as JSON and read back."""
    path = new_path(spark, "segments")
    done = _segmented(spark, folder).segments()
    sl.write_json(done, path)
    return spark.read.schema(done.schema).json(path)


def _dialogue_summary(spark, folder, part_turns=reports.PART_TURNS):
    """The arrays as text; scores in millionths."""

    def joined(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda x: x.cast("string")), ",")

    def millionths(items: str) -> Column:
        return joined(F.transform(items, lambda x: F.round(x * 1e6).cast("bigint")))

    spans = F.transform("segments", lambda s: F.concat_ws("-", s["start"], s["end_exclusive"]))
    return _segmented(spark, folder).summary(part_turns).select(
        "conv_id",
        "part",
        joined(F.col("boundaries")).alias("boundaries"),
        F.array_join(spans, ",").alias("segments"),
        millionths("scores").alias("scores"),
        millionths("graded_scores").alias("graded_scores"),
    )


def _conversation_segmentation(spark, folder, keep=()):
    return sl.segment(_conversations(spark, folder), TEXT, encoder=sl.hash_encoder(), keep=keep)


def _conversation_segments(spark, folder):
    return _conversation_segmentation(spark, folder).segments()


def _segment_text(spark, folder, part_turns=reports.PART_TURNS):
    rows = _conversation_segmentation(spark, folder, keep=["text"]).segment_text(part_turns)
    return rows.select(
        "conv_id",
        "topic_id",
        "part",
        "start",
        "end_exclusive",
        F.array_join("texts", "\n").alias("text"),
    )


def _document_segments(spark, folder, chunk_turns=sl.SegmenterConfig().chunk_turns):
    """Segments of the documents' lines, lines without a token set aside on the way."""
    config = replace(TEXT, chunk_turns=chunk_turns)
    lines = _document_lines(spark, folder)
    return sl.segment(lines, config, encoder=sl.hash_encoder(), unfit="aside").segments()


def _with_zeros(spark, folder):
    """The dialogues with some vectors replaced by zeros."""
    spoilt = F.when((F.col("conv_id") * 20 + F.col("turn")) % 13 == 5, scaled(F.col("embedding"), F.lit(0.0)))
    vectors = _embeddings(spark, folder)
    return vectors.withColumn("embedding", F.coalesce(spoilt, F.col("embedding").cast("array<double>")))


def _turns_set_aside(spark, folder):
    """The zero vectors that the pass meets."""
    return sl.segment(_with_zeros(spark, folder), EMB, unfit="aside").unfit


def _history_set_aside(spark, folder):
    """The history without zero vectors, every dialogue spread over chunks of seven turns."""
    config = sl.SegmenterConfig(delta_star=0.95, chunk_turns=7)
    return _rounded(sl.segment(_with_zeros(spark, folder), config, unfit="aside").history())


def _corpus_counts(spark, folder):
    return sl.corpus_counts(_conversations(spark, folder))


def _end_turn_labels(spark, folder):
    return _segmented(spark, folder).end_turn_labels()


def _metric_window_size(spark, folder):
    gold, _ = _gold(spark, folder)
    return dialogue_stats(gold.withColumnRenamed("label", "gold"))


def _per_dialogue(spark, folder, metric):
    pairs, longest = _pairs(spark, folder)
    rows = dialogue_metrics(pairs, ["pred"], metrics=[metric], longest=longest)
    return _rounded(rows.select("conv_id", F.col(f"{metric}_pred").alias(metric)))


def _evaluate_corpus(spark, folder):
    gold, longest = _gold(spark, folder)
    return _rounded(sl.evaluate(gold, _segmented(spark, folder).end_turn_labels(), longest=longest))


def _threshold_candidates(spark, folder):
    scored, _ = _scored(spark, folder)
    return _rounded(sl.threshold_candidates(scored).select("percentile", "delta_star"))


def _calibration(spark, folder, metric="score"):
    scored, longest = _scored(spark, folder)
    return sl.calibrate(scored, _gold(spark, folder)[0], metric=metric, longest=longest)


def _streamed(spark, folder, vectors):
    """Feed vectors to the online operator file by file, five turns of a dialogue at a time."""
    source = new_path(spark, "feed")
    for first in range(0, 20, 5):
        some = vectors.where(F.col("turn").between(first, first + 4)).select("conv_id", "turn", "embedding")
        some.repartition("conv_id").write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(source)
    return _rounded(_finished(sl.segment_stream(feed, EMB, unfit="aside")))


def _finished(decided):
    """All that a stream over a finished source writes."""
    spark = decided.sparkSession
    out, state = (new_path(spark, name) for name in ("stream", "stream-state"))
    query = (
        decided.writeStream.format("parquet")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start(out)
    )
    if not query.awaitTermination(1800):
        query.stop()
        raise TimeoutError("the stream did not finish")
    return spark.read.schema(decided.schema).parquet(out)


def _stream_segment(spark, folder):
    """Several micro-batches, so that decisions rest on carried state; late rows would show."""
    return _streamed(spark, folder, _embeddings(spark, folder)).drop("input_turn", "reason")


def _stream_set_aside(spark, folder):
    """The stream with zero vectors in it: reported, and nothing else changed by them."""
    vectors = _with_zeros(spark, folder)
    return _streamed(spark, folder, vectors).select("conv_id", "input_turn", "turn", "topic_id", "delta_eff", "reason")


def _out_of_order(spark, turns, segmenter):
    """Feed turns file by file, each up to six places later than its turn, and run the segmenter over them.

    A second a turn; a last row, far later than all others, lets their timers run out.
    """
    source = new_path(spark, "feed")
    second = F.timestamp_seconds(F.col("turn") + 1_000_000)
    rows = turns.select("*", second.alias("time"), F.expr("(turn + pmod(hash(conv_id, turn), 7)) div 5").alias("file"))
    rows = store(rows, "late")
    for file in range(rows.agg(F.max("file")).first()[0] + 1):
        rows.where(F.col("file") == file).drop("file").repartition(1).write.mode("append").parquet(source)
    last = rows.limit(1).select(
        *[F.lit(-1).cast("bigint").alias(c) if c == "conv_id" else F.col(c) for c in turns.columns],
        F.timestamp_seconds(F.lit(10**9)).alias("time"),
    )
    last.write.mode("append").parquet(source)
    feed = spark.readStream.schema(last.schema).option("maxFilesPerTrigger", 1).parquet(source)
    before = spark.conf.get(STORE_SETTING)
    spark.conf.set(STORE_SETTING, STORE)
    try:
        return _finished(segmenter(feed.withWatermark("time", "10 seconds"))).where("conv_id >= 0")
    finally:
        spark.conf.set(STORE_SETTING, before)


def _stream_in_order(spark, folder):
    """Turns that come in other micro-batches than their neighbours, decided on in order."""
    vectors = _embeddings(spark, folder).select("conv_id", "turn", "embedding")
    done = _out_of_order(spark, vectors, lambda feed: sl.segment_stream_in_order(feed, EMB, idle_ms=60_000))
    return _rounded(done.drop("input_turn", "reason"))


def _stream_segments(spark, folder):
    """Segments as they close: of every other dialogue the last turn is marked, the others fall silent."""
    ends = (F.col("turn") == 19) & (F.col("conv_id") % 2 == 0)
    vectors = _embeddings(spark, folder).select("conv_id", "turn", "embedding", ends.alias("ends"))
    return _out_of_order(spark, vectors, lambda feed: sl.segments_from_stream(feed, EMB, idle_ms=60_000, end="ends"))


def _stream_segment_text(spark, folder):
    """The same with texts, encoded as they come, three turns a part."""
    encoder = sl.hash_encoder()

    def segmenter(feed):
        coded = feed.withColumn("embedding", encoder(F.col("text")))
        return sl.segments_from_stream(coded, TEXT, idle_ms=60_000, text="text", part_turns=3, unfit="aside")

    rows = _out_of_order(spark, _conversations(spark, folder), segmenter)
    return rows.select("conv_id", "topic_id", "part", "start", "end_exclusive", F.array_join("texts", "\n").alias("text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = _own_queries()
    if corpus_pipeline:
        found |= {"pipeline": corpus_pipeline.run} | llm_queries.queries()
    return {name: _prepared(query) for name, query in found.items()}


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "turns_from_text": _turns_from_text,
        "text_file_turns": _text_file_turns,
        "session_turns": _session_turns,
        "matrix_turns": _matrix_turns,
        "matrix_turns_parts": lambda spark, folder: _matrix_turns(spark, folder, 7),
        "calibration_json": _calibration_json,
        "evaluation_json": _evaluation_json,
        "calibration_document": _calibration_document,
        "evaluation_document": _evaluation_document,
        "numbered_turns": _numbered_turns,
        "hash_encode": _hash_encode,
        "encode_distinct": _encode_distinct,
        "invalid_embeddings": _invalid_embeddings,
        "invalid_text_turns": _invalid_text_turns,
        "label_violations": _label_violations,
        "mixed_dimensions": _mixed_dimensions,
        "unit_vectors": _unit_vectors,
        "adjacent_distance": _adjacent_distance,
        "context_distance": _context_distance,
        "context_distance_legacy": _context_distance_legacy,
        "blended_score": _blended_score,
        "graded_score": _graded_score,
        "boundary_flags": _boundary_flags,
        "topic_ids": _topic_ids,
        "history": _history,
        "history_sql": _history_sql,
        "history_jvm": _history_jvm,
        "history_split": _history_split,
        "strength_bands": _strength_bands,
        "strength_histogram": _strength_histogram,
        "strength_rollup": _strength_rollup,
        "strength_totals": _strength_totals,
        "segments": _segments,
        "segments_json": _segments_json,
        "dialogue_summary": _dialogue_summary,
        "dialogue_summary_parts": lambda spark, folder: _dialogue_summary(spark, folder, 6),
        "conversation_segments": _conversation_segments,
        "segment_text": _segment_text,
        "segment_text_parts": lambda spark, folder: _segment_text(spark, folder, 3),
        "document_segments": _document_segments,
        "document_segments_split": lambda spark, folder: _document_segments(spark, folder, 4),
        "turns_set_aside": _turns_set_aside,
        "history_set_aside": _history_set_aside,
        "corpus_counts": _corpus_counts,
        "end_turn_labels": _end_turn_labels,
        "metric_window_size": _metric_window_size,
        "pk": lambda spark, folder: _per_dialogue(spark, folder, "pk"),
        "windowdiff": lambda spark, folder: _per_dialogue(spark, folder, "wd"),
        "boundary_f1": lambda spark, folder: _per_dialogue(spark, folder, "f1"),
        "evaluate_corpus": _evaluate_corpus,
        "threshold_candidates": _threshold_candidates,
        "calibration_grid": lambda spark, folder: _rounded(_calibration(spark, folder).candidates),
        "calibrate_score": lambda spark, folder: _rounded(_calibration(spark, folder).selected),
        "calibrate_f1": lambda spark, folder: _rounded(_calibration(spark, folder, "f1").selected),
        "stream_segment": _stream_segment,
        "stream_set_aside": _stream_set_aside,
        "stream_in_order": _stream_in_order,
        "stream_segments": _stream_segments,
        "stream_segment_text": _stream_segment_text,
    }
