import numpy as np
import pytest
from pyspark.errors import PySparkException

from seamline import SegmenterConfig, register_tables, segment
from seamline.functions import tables

CALL = "SELECT * FROM segment_turns(TABLE({turns}) PARTITION BY conv_id ORDER BY turn, delta_star => 0.6, ctx_window => 3)"


def table(spark, lengths):
    rng = np.random.default_rng(4)
    rows = [(f"c{c}", t, "x", rng.normal(size=6).tolist()) for c, n in enumerate(lengths) for t in range(n)]
    return spark.createDataFrame(rows, "conv_id string, turn bigint, note string, embedding array<double>").repartition(4)


def test_equals_the_history(spark):
    """Dialogues shorter and longer than what is decided on at a time."""
    register_tables(spark)
    turns = table(spark, (1, 2, 40, tables.BATCH_TURNS, 2 * tables.BATCH_TURNS + 7))
    want = segment(turns, SegmenterConfig(delta_star=0.6, ctx_window=3)).history()
    got = spark.sql(CALL, turns=turns).select(want.columns)
    assert got.dtypes == want.dtypes
    one, two = (sorted(map(tuple, df.collect())) for df in (got, want))
    assert [r[:4] for r in one] == [r[:4] for r in two]
    assert np.allclose([r[4:] for r in one], [r[4:] for r in two], atol=1e-12)
    # Gaps are closed, and the call is a table like any other.
    spread = turns.withColumn("turn", turns["turn"] * 3)
    count = spark.sql(f"SELECT count(*), sum(int(is_boundary)) FROM ({CALL})", turns=spread).first()
    assert tuple(count) == (len(one), sum(r[3] for r in one))


def test_empty_table_and_faults(spark):
    register_tables(spark)
    turns = table(spark, (3,))
    assert spark.sql(CALL, turns=turns.limit(0)).collect() == []
    with pytest.raises(PySparkException, match="repeats a turn"):
        spark.sql(CALL, turns=turns.union(turns)).collect()
    with pytest.raises(PySparkException, match="needs a table with embedding"):
        spark.sql(CALL, turns=turns.drop("embedding")).collect()
    with pytest.raises(PySparkException, match="delta_star must lie"):
        spark.sql(CALL.replace("0.6", "3.0"), turns=turns).collect()
