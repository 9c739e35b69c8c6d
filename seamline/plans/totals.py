"""Strength totals over any number of calls.

Each call adds one row of counts under a batch id, in a folder of its own. A batch that
is there already is not run again, so a replayed batch - a micro-batch after a restart, a
job that is tried twice - changes nothing, and calls may run side by side as long as
their ids differ. ``compact`` puts all rows into one file; whatever moment it is cut off
at, rows are told apart by their ids and none counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.operators.topics import BANDS, strength_band

ROWS = "batch_id bigint, " + ", ".join(f"{name} bigint" for name in BANDS)

#: Written by Spark into a folder whose rows are all there (fixed value of Spark).
_DONE = "_SUCCESS"


class StrengthTotals:
    """A folder that all executors share, with the counts of every batch added so far."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, topics: DataFrame, batch_id: int) -> bool:
        """Count the turns of ``topics`` by the band of their ``graded_score``; False if the batch is known.

        Turns without a score, as the online operators pass them on, are not counted.
        """
        if self._rows().where(F.col("batch_id") == batch_id).head(1):
            return False
        band = strength_band(F.col("graded_score"))
        counts = topics.where("graded_score IS NOT NULL").agg(*[F.count_if(band == name).alias(name) for name in BANDS])
        row = counts.select(F.lit(batch_id).cast("bigint").alias("batch_id"), *BANDS)
        # What an attempt that was cut off has left is replaced.
        row.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        return True

    def add_micro_batch(self, topics: DataFrame, batch_id: int) -> bool:
        """``add`` for ``foreachBatch``: a known micro-batch is run, as its stream's state needs, but not counted."""
        new = self.add(topics, batch_id)
        if not new:
            topics.write.format("noop").mode("overwrite").save()
        return new

    def total(self) -> DataFrame:
        """One row: the turns of all batches per band."""
        return self._rows().agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in BANDS])

    def compact(self) -> None:
        """Put the rows of all batches into one file and drop the folders it takes the place of."""
        folders = self._folders()
        if len(folders) < 2:
            return
        newest = max((int(f.partition("=")[2]) for f in folders if f.startswith("merged=")), default=0)
        rows = self._rows().repartition(1)
        rows.write.mode("overwrite").parquet(f"{self.path}/merged={newest + 1}")
        system, place = self._system(), self.spark._jvm.org.apache.hadoop.fs.Path
        for folder in folders:
            system.delete(place(f"{self.path}/{folder}"), True)

    def _rows(self) -> DataFrame:
        """One row per batch, though an interrupted ``compact`` may have left some twice."""
        folders = self._folders()
        if not folders:
            return self.spark.createDataFrame([], ROWS)
        rows = self.spark.read.schema(ROWS).parquet(*[f"{self.path}/{f}" for f in folders])
        return rows.dropDuplicates(["batch_id"])

    def _folders(self) -> list[str]:
        """The folders whose rows are all there; one per batch since the last ``compact``."""
        system, place = self._system(), self.spark._jvm.org.apache.hadoop.fs.Path
        if not system.exists(place(self.path)):
            return []
        names = [status.getPath().getName() for status in system.listStatus(place(self.path))]
        return sorted(n for n in names if system.exists(place(f"{self.path}/{n}/{_DONE}")))

    def _system(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration())
