"""The arrays of numbers in JSON documents of any size, found by many tasks.

A document is read as Spark reads text, split at every ``]``. So no array of numbers is
ever cut in two, and each split is a run of records whose only unknown is where in the
document it begins. That is found in two scans:

1. Each split is scanned as if it began inside a string and as if it did not. What comes
   of it, the state at its end and the change of nesting, is a transition, and the
   transitions of the splits before it say how a split begins.
2. From there each split reads its arrays and counts what it opens: the objects that hold
   the wanted keys, and the keys' arrays. The counts of the splits before it say which
   object and key its first arrays belong to, and which number they have.

Both are running folds over one row per split.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamline.sources.text import file_path
from seamline.storage import store

#: Splits up to which their states are broadcast. A split is 128 MB unless set otherwise.
BROADCAST_SPLITS = 100_000

MALFORMED = "not a whole JSON document"

#: A string or what is left of one, or a mark of structure.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|[][{}]', re.S)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*?"', re.S)
_COLON = re.compile(r"\s*:")

_STATES = "path string, split bigint, quoted boolean, ends_quoted boolean, depth bigint"
_FOUND = (
    "path string, split bigint, kind string, object bigint, section bigint, key string, nth bigint, "
    "numbers array<double>, objects bigint, sections bigint, last_key string, tail bigint"
)


def number_arrays(spark: SparkSession, paths: str | list[str], keys: Sequence[str], level: int) -> DataFrame:
    """The arrays of numbers under some keys of the objects at nesting ``level`` (1: the outermost).

    One row per array: ``path``, ``object`` (number of the object in the document, from 0),
    ``key``, ``nth`` (number of the array in the key's array of arrays, null where the key's
    array holds the numbers itself) and ``numbers``. An object also has a row of its own,
    without a key. The rows are written once.
    """
    records = spark.read.text(paths, lineSep="]").select(
        file_path().alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("read"),
        "value",
    )
    states = store(records.mapInArrow(_transitions, _STATES), "splits")
    begins = _begins(states)
    few = states.count() <= 2 * BROADCAST_SPLITS
    joined = records.join(F.broadcast(begins) if few else begins, ["path", "split"])
    if not few:
        # A shuffled join does not keep the order of a split's records.
        joined = joined.repartition("path", "split").sortWithinPartitions("path", "split", "read")
    found = store(joined.drop("read").mapInArrow(_reader(keys, level), _FOUND), "arrays")
    rows = _numbered(found).where(F.col("key").isNull() | F.col("key").isin(*keys))
    other = F.raise_error(F.lit("an array holds something else than numbers")).cast("array<double>")
    numbers = F.when(F.col("key").isNull() | F.col("numbers").isNotNull(), F.col("numbers")).otherwise(other)
    return rows.withColumn("numbers", numbers)


def _runs(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[bool, tuple, list[str]]]:
    """Stretches of records of one split: whether it begins there, its columns ``names``, the records."""
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*[batch.column(n).to_pylist() for n in names]))
        values = batch.column("value").to_pylist()
        start = 0
        for at in range(1, len(rows) + 1):
            if at == len(rows) or rows[at] != rows[start]:
                yield rows[start] != key, rows[start], values[start:at]
                key, start = rows[start], at


def _structure(value: str, quoted: bool) -> tuple[list[tuple[str, int, int]], bool]:
    """Marks and strings of a record, each with where it begins and ends, and whether a string is open at its end."""
    at = 0
    if quoted:
        end = _STRING_END.match(value)
        if not end:
            return [], True
        at = end.end()
    # The end of a string that began before is a token too; it may be a key.
    tokens = [("'", 0, at)] if quoted else []
    for token in _TOKEN.finditer(value, at):
        if token[0][0] == '"' and not token[1]:
            return tokens, True
        tokens.append((token[0][0], token.start(), token.end()))
    return tokens, False


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split and both ways to begin: whether a string is open at its end, and the change of nesting."""
    where, ends, depth = None, [False, True], [0, 0]

    def done():
        rows = [(*where, bool(way), ends[way], depth[way]) for way in (0, 1)]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "split", "quoted", "ends_quoted", "depth"]
        )

    for begins, here, values in _runs(batches, ["path", "split"]):
        if begins:
            if where is not None:
                yield done()
            where, ends, depth = here, [False, True], [0, 0]
        for value in values:
            for way in (0, 1):
                if '"' not in value:
                    if not ends[way]:
                        opened = value.count("[") + value.count("{") - value.count("}")
                        depth[way] += opened - 1
                    continue
                tokens, ends[way] = _structure(value, ends[way])
                depth[way] += sum({"[": 1, "{": 1, "}": -1}.get(t, 0) for t, _, _ in tokens)
                depth[way] -= not ends[way]  # the bracket that the record was split at
    if where is not None:
        yield done()


def _begins(states: DataFrame) -> DataFrame:
    """``(path, split, quoted, depth)``: how each split begins. A document has few splits."""
    order = Window.partitionBy("path").orderBy("split")
    ways = states.groupBy("path", "split").agg(
        *[F.max(F.when(F.col("quoted") == way, F.col("ends_quoted"))).alias(f"ends_{int(way)}") for way in (False, True)],
        *[F.max(F.when(F.col("quoted") == way, F.col("depth"))).alias(f"depth_{int(way)}") for way in (False, True)],
    )
    # A split whose two ways end alike settles the state; of the others each keeps or flips it.
    flips = F.when(F.col("ends_0") == F.col("ends_1"), F.lit(None)).otherwise(F.col("ends_0").cast("int"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    settled = ways.withColumn("flip", flips).withColumn(
        "flipped", F.coalesce(F.sum(F.coalesce("flip", F.lit(0))).over(earlier), F.lit(0))
    )
    # The last settled state, with the flips up to it taken off again.
    mark = F.when(F.col("flip").isNull(), F.struct(F.col("ends_0").alias("state"), (F.col("flipped")).alias("upto")))
    known = settled.withColumn("mark", F.last(mark, ignorenulls=True).over(earlier))
    state = F.coalesce(F.col("mark.state").cast("int"), F.lit(0)) + F.col("flipped") - F.coalesce("mark.upto", F.lit(0))
    begun = known.withColumn("quoted", state % 2 == 1)
    change = F.when(F.col("quoted"), F.col("depth_1")).otherwise(F.col("depth_0"))
    ends = F.when(F.col("quoted"), F.col("ends_1")).otherwise(F.col("ends_0"))
    begun = begun.select(
        "path", "split", "quoted", F.coalesce(F.sum(change).over(earlier), F.lit(0)).alias("depth"),
        change.alias("change"), ends.alias("ends"), F.lead("split").over(order).isNull().alias("last"),
    )
    # After the last bracket a document may go on; then the end of the text is no bracket.
    whole = ~F.col("ends") & (F.col("depth") + F.col("change")).isin(0, -1)
    bad = F.raise_error(F.lit(MALFORMED)).cast("bigint")
    return begun.select("path", "split", "quoted", F.when(F.col("last") & ~whole, bad).otherwise(F.col("depth")).alias("depth"))


def _reader(keys: Sequence[str], level: int):
    wanted = set(keys)
    names = [f.split()[0] for f in _FOUND.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "array<double>": pa.list_(pa.float64())}
    types = [kinds[f.split()[1]] for f in _FOUND.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = None
        rows: list[list] = []
        texts: list[str] = []

        def batch():
            numbers = map(_numbers, json.loads("[[" + "],[".join(texts) + "]]") if texts else [])
            out = [[*r[:7], next(numbers) if r[2] == "array" else None, *r[8:]] for r in rows]
            rows.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        def total():
            return [*where, "split", None, None, None, None, None, objects, sections, key if sections else None, tail]

        for begins, (path, split, entering, nesting), values in _runs(batches, ["path", "split", "quoted", "depth"]):
            if begins:
                if where is not None:
                    rows.append(total())
                where, quoted, depth = (path, split), entering, nesting
                # What the split has opened, the arrays in its last section, and the open array's beginning.
                objects = sections = tail = 0
                key, known = None, False
            for value in values:
                tokens, quoted = _structure(value, quoted)
                begin = None
                for mark, start, stop in tokens:
                    if mark == "[":
                        depth += 1
                        begin = stop
                    elif mark == "{":
                        depth += 1
                        begin = None
                        if depth == level:
                            objects += 1
                            rows.append([path, split, "object", objects, None, None, None, None, None, None, None, None])
                    elif mark == "}":
                        depth -= 1
                        begin = None
                    elif depth == level and _COLON.match(value, stop):
                        sections, tail, known = sections + 1, 0, True
                        # No wanted key has a bracket in it.
                        key = json.loads(value[start:stop]) if mark == '"' else ""
                if quoted:
                    continue
                # The record's own bracket closes an array; one opened in this record holds no other.
                if begin is not None and depth in (level + 1, level + 2) and (key in wanted or not known):
                    nested = depth == level + 2
                    rows.append([path, split, "array", objects, sections, key, tail if nested else None, None, None, None, None, None])
                    texts.append(value[begin:])
                    tail += nested
                depth -= 1
            if len(rows) >= 2000:
                yield batch()
        if where is not None:
            rows.append(total())
            yield batch()

    return read


def _numbers(items: list) -> list | None:
    """The numbers of an array; of an array of other things, which may be of no concern, null."""
    try:
        return None if any(isinstance(x, (str, bool)) for x in items) else [x if x is None else float(x) for x in items]
    except TypeError:
        return None


def _numbered(found: DataFrame) -> DataFrame:
    """What the splits found, with numbers counted over the whole document."""
    order = Window.partitionBy("path").orderBy("split")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    totals = found.where(F.col("kind") == "split").select("path", "split", "objects", "sections", "last_key", "tail")
    totals = totals.withColumn("before", F.coalesce(F.sum("tail").over(earlier), none))
    # The arrays of the section that is open: all counted, less those before the split it was opened in.
    opened = F.max(F.when(F.col("sections") > 0, F.col("before"))).over(earlier)
    entering = totals.select(
        "path",
        "split",
        F.coalesce(F.sum("objects").over(earlier), none).alias("objects_before"),
        F.last("last_key", ignorenulls=True).over(earlier).alias("key_before"),
        (F.col("before") - F.coalesce(opened, none)).alias("arrays_before"),
    )
    continues = F.col("sections_here") == 0
    rows = found.where(F.col("kind") != "split").withColumnRenamed("section", "sections_here")
    rows = rows.drop("objects", "sections", "last_key", "tail")
    return rows.join(entering, ["path", "split"]).select(
        "path",
        (F.col("objects_before") + F.col("object") - 1).alias("object"),
        F.when(continues, F.col("key_before")).otherwise(F.col("key")).alias("key"),
        (F.col("nth") + F.when(continues, F.col("arrays_before")).otherwise(none)).alias("nth"),
        "numbers",
    )
