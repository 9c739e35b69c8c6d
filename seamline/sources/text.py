"""Text files, one dialogue per file and one utterance per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines_of(text: Column) -> Column:
    """The lines of a text. Blank lines count, and the end of the last line
    starts no further one; an empty text has no lines."""
    plain = F.when(
        F.contains(text, F.lit("\r")),
        F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")),
    ).otherwise(text)
    # Splitting at one plain character takes no regular expression. The piece
    # after the last line end is empty, and so is the only one of an empty text.
    pieces = F.split(plain, "\n")
    empty_last = F.endswith(plain, F.lit("\n")) | (plain == "")
    return F.when(empty_last, F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def turns_from_documents(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Turns of a table that holds one whole dialogue per row."""
    return df.select(
        F.col(key).alias("conv_id"), F.posexplode(lines_of(F.col(text))).alias("turn", "text")
    ).withColumn("turn", F.col("turn").cast("bigint"))


def turns_from_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(conv_id, turn, text)`` of UTF-8 text files; ``conv_id`` is the path.

    ``turn`` numbers the lines of a file from 0 without gaps. Files of any size are
    read alike: Spark splits them as it does any text, lines are numbered within
    their split, and the splits before it, counted first, say where it starts. A
    file's splits are few, and a split is bounded.
    """
    lines = spark.read.text(paths).select(
        file_path().alias("conv_id"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("read"),
        F.col("value").alias("text"),
    )
    counts = lines.groupBy("conv_id", "split").agg(F.count(F.lit(1)).alias("lines"))
    earlier = Window.partitionBy("conv_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv_id", "split", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("start"))
    in_split = Window.partitionBy("conv_id", "split").orderBy("read")
    numbered = lines.withColumn("at", F.row_number().over(in_split) - 1)
    return numbered.join(starts, ["conv_id", "split"]).select(
        "conv_id", (F.col("start") + F.col("at")).cast("bigint").alias("turn"), "text"
    )


def file_path() -> Column:
    """The plain path of the file a row comes from, without the escapes of a URL."""
    # A plus sign is one in a path, unlike in a form.
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
