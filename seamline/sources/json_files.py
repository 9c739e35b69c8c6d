"""JSON files of calibration and evaluation sets, and results as JSON.

A calibration file is a list of ``{"embeddings": [[..]], "pseudo_labels": [..]}``
and an evaluation file one ``{"golds": [[..]], "preds": [[..]]}``. Many tasks read one
such file (see ``json_scan``); a vector, or the labels of a dialogue, is the most that a
task holds of it. With ``lines`` a file has one dialogue per line instead -
``{"embeddings": .., "pseudo_labels": ..}`` or ``{"gold": [..], "pred": [..]}`` - and
is split like any text. Files are parsed once; what they hold is stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.sources.json_scan import number_arrays
from seamline.sources.text import turns_from_text
from seamline.storage import store


def calibration_set(
    spark: SparkSession, paths: str | list[str], *, lines: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The turn table and the label table of calibration files."""
    if not lines:
        return _calibration_document(spark, paths)
    dialogues = _json_lines(spark, paths, _DIALOGUE)
    turns = F.size("x.embeddings") == F.size("x.pseudo_labels")
    dialogues = _stored(dialogues, turns, UNEQUAL)
    return _turns(dialogues, "embeddings", "embedding"), _turns(dialogues, "pseudo_labels", "label")


def _calibration_document(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    arrays = number_arrays(spark, paths, ["embeddings", "pseudo_labels"], level=2)
    vector = F.col("nth").isNotNull() & (F.col("key") == "embeddings")
    labels = F.col("nth").isNull() & (F.col("key") == "pseudo_labels")
    sizes = arrays.groupBy("path", "object").agg(
        F.count_if(vector).alias("turns"),
        F.sum(F.when(labels, F.size("numbers"))).alias("labels"),
        F.count_if(F.col("key") == "embeddings").alias("found"),
    )
    _check(sizes, (F.col("turns") == F.col("labels")) & (F.col("found") > 0), UNEQUAL)
    name = F.concat_ws("#", "path", F.col("object").cast("string")).alias("conv_id")
    vectors = arrays.where(vector).select(name, F.col("nth").alias("turn"), F.col("numbers").alias("embedding"))
    return vectors, _labels(arrays.where(labels).select(name, "numbers"))


def evaluation_set(
    spark: SparkSession, paths: str | list[str], *, lines: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Gold and predicted label tables of evaluation files."""
    if not lines:
        return _evaluation_document(spark, paths)
    dialogues = _json_lines(spark, paths, "struct<gold:array<int>,pred:array<int>>")
    dialogues = _stored(dialogues, F.col("x.gold").isNotNull() & F.col("x.pred").isNotNull(), UNPAIRED)
    return _turns(dialogues, "gold", "label"), _turns(dialogues, "pred", "label")


def _evaluation_document(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    arrays = number_arrays(spark, paths, ["golds", "preds"], level=1)
    listed = arrays.where(F.col("nth").isNotNull())
    counts = arrays.groupBy("path").agg(
        *[F.count_if((F.col("key") == k) & F.col("nth").isNotNull()).alias(k) for k in ("golds", "preds")],
        F.count_distinct("key").alias("keys"),
    )
    _check(counts, (F.col("golds") == F.col("preds")) & (F.col("keys") == 2), UNPAIRED)
    name = F.concat_ws("#", "path", F.col("nth").cast("string")).alias("conv_id")
    gold, pred = (_labels(listed.where(F.col("key") == k).select(name, "numbers")) for k in ("golds", "preds"))
    return gold, pred


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; text outside ASCII is written as it is."""
    df.write.json(path)


def as_json(df: DataFrame) -> DataFrame:
    """The rows as JSON strings."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


_DIALOGUE = "struct<embeddings:array<array<double>>,pseudo_labels:array<int>>"


UNEQUAL = "each turn needs one label"
UNPAIRED = "gold and predicted dialogues must match"


def _check(rows: DataFrame, sound: Column, complaint: str) -> None:
    """Stop if a row is not sound."""
    bad = F.when(F.coalesce(sound, F.lit(False)), 0).otherwise(F.raise_error(F.lit(complaint)).cast("int"))
    rows.agg(F.sum(bad)).collect()


def _labels(lists: DataFrame) -> DataFrame:
    """Label turns of lists of numbers, which must be whole."""
    turns = lists.select("conv_id", F.posexplode("numbers").alias("turn", "number"))
    whole = F.col("number") == F.floor("number")
    label = F.when(whole, F.col("number").cast("int")).otherwise(F.raise_error(F.lit("labels are integers")).cast("int"))
    return turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), label.alias("label"))


def _json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """One row per line that is not blank."""
    lines = turns_from_text(spark, paths).where("trim(text) <> ''")
    parsed = F.from_json("text", schema, {"mode": "FAILFAST"})
    return lines.select(F.col("conv_id").alias("path"), F.col("turn").alias("at"), parsed.alias("x"))


def _stored(dialogues: DataFrame, sound: Column, complaint: str) -> DataFrame:
    """The dialogues, checked while they are written."""
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("x")).otherwise(
        F.raise_error(F.lit(complaint)).cast(dialogues.schema["x"].dataType)
    )
    key = F.concat_ws("#", "path", F.col("at").cast("string")).alias("conv_id")
    return store(dialogues.select(key, checked.alias("x")).select("conv_id", "x.*"), "dialogues")


def _turns(dialogues: DataFrame, column: str, name: str) -> DataFrame:
    return dialogues.select("conv_id", F.posexplode(column).alias("turn", name)).withColumn(
        "turn", F.col("turn").cast("bigint")
    )
