"""Packing documents into sequences by minimum bin slack.

Documents are tokenized and cut into full sequences and a rest. Rests of one length are
alike, so what is packed is a multiset of lengths: at most ``capacity - 1`` counts,
whatever the number of documents. Window by window, the longest rest left and a subset
of the others that comes closest to the capacity are chosen by subset sums over bitsets
(bit s of a number: some rests sum to s), and the counts used are read back from the
bitsets. A choice is repeated as often as the counts allow, so the number of choices
does not grow with the table either.

A window that no subset fills gets the head of one more rest, which is cut there; its
tail goes back to the others. The last window, if it is not full, is cut into sequences
whose lengths are powers of two, which need no padding. So nothing is padded at all, and
cuts beyond those of too long documents are few.

Spark counts the lengths and numbers the rests of each length; every task finds the
places of its own rests by their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm.packing import BATCH_BYTES, encoded
from seamline.storage import store, store_in_batches

#: Rests of one length that can be numbered.
MOST = 1 << 44
#: Low bits of a row's number within its task (fixed value of Spark).
TASK_BITS = 33


# -------------------------------------------------------------------- choices


@dataclass
class Plan:
    """Where the n-th rest of each length goes.

    A row of ``rows`` takes the rests ``first`` to ``last`` of ``length``: windows from
    ``window`` on get ``each`` of them, one after another from ``offset``. If ``head`` is
    less than the length, only that much goes there and the tails are the rests of length
    ``length - head`` from number ``tail`` on.
    """

    capacity: int
    left: dict[int, int]
    rows: list[tuple[int, ...]] = field(default_factory=list)
    windows: int = 0

    def __post_init__(self) -> None:
        self.taken = dict.fromkeys(self.left, 0)

    def take(self, length: int, window: int, times: int, each: int, offset: int, head: int | None = None) -> None:
        first, count = self.taken.get(length, 0), times * each
        if first + count >= MOST:
            raise ValueError(f"more than {MOST} pieces of one length")
        self.taken[length] = first + count
        self.left[length] -= count
        tail = 0
        if head is not None:
            rest = length - head
            # The tails follow the rests of their length there have been so far.
            tail = self.taken.get(rest, 0) + self.left.get(rest, 0)
            self.left[rest] = self.left.get(rest, 0) + count
        self.rows.append((length, first, window, each, offset, head or length, tail))


def closest(left: dict[int, int], capacity: int) -> dict[int, int]:
    """How many rests of each length fill a window best, the longest one among them."""
    lengths = sorted((n for n, count in left.items() if count), reverse=True)
    sums, full, within = 1 << lengths[0], 1 << capacity, (2 << capacity) - 1
    steps = []
    for length in lengths:
        count = min(left[length] - (length == lengths[0]), (capacity - lengths[0]) // length)
        some = 1
        while count > 0 and not sums & full:
            some = min(some, count)
            steps.append((length, some, sums))
            sums |= (sums << (length * some)) & within
            count -= some
            some *= 2
        if sums & full:
            break
    total = sums.bit_length() - 1
    used = {lengths[0]: 1}
    for length, some, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + some
            total -= length * some
    return used


def planned(counts: dict[int, int], capacity: int) -> Plan:
    """All windows for so many rests of each length, every one shorter than the capacity."""
    plan = Plan(capacity, dict(counts))
    left = plan.left
    while any(left.values()):
        used = closest(left, capacity)
        slack = capacity - sum(length * each for length, each in used.items())
        cut = None
        if slack:
            # Whatever is left is longer than the slack, or it would have been taken.
            cut = max((n for n, count in left.items() if count > used.get(n, 0)), default=None)
            if cut is None:
                _last(plan, used)
                break
        need = dict(used)
        if cut is not None:
            need[cut] = need.get(cut, 0) + 1
        times = min(left[length] // each for length, each in need.items())
        offset = 0
        for length, each in used.items():
            plan.take(length, plan.windows, times, each, offset)
            offset += length * each
        if cut is not None:
            plan.take(cut, plan.windows, times, 1, offset, slack)
        plan.windows += times
        for length in [n for n, count in left.items() if not count]:
            del left[length]
    return plan


def _last(plan: Plan, used: dict[int, int]) -> None:
    """The rests of the last window, which do not fill it, as sequences of powers of two."""
    rests = [length for length, each in used.items() for _ in range(each)]
    total = sum(rests)
    for bit in reversed(range(total.bit_length())):
        room = total & 1 << bit
        if not room:
            continue
        offset = 0
        while offset < room:
            length, head = rests.pop(0), room - offset
            if length > head:
                plan.take(length, plan.windows, 1, 1, offset, head)
                rests.insert(0, length - head)
            else:
                plan.take(length, plan.windows, 1, 1, offset)
            offset += min(length, head)
        plan.windows += 1


def seats(plan: np.ndarray, length: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
    """Places of the ``number``-th rests of ``length``: row, start, length, window and offset of each part."""
    keys = plan[:, 0] * MOST + plan[:, 1]
    row, start = np.arange(len(length)), np.zeros(len(length), np.int64)
    found = []
    while len(row):
        at = np.searchsorted(keys, length * MOST + number, side="right") - 1
        _, first, window, each, offset, head, tail = plan[at].T
        nth = number - first
        found.append((row, start, head, window + nth // each, offset + nth % each * head))
        cut = head < length
        row, start = row[cut], (start + head)[cut]
        length, number = (length - head)[cut], (tail + nth)[cut]
    return [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 5


# --------------------------------------------------------------------- tables


def pack_tightly(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    separator: int = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces of all documents and their places: id, ``start``, ``length``, ``ids``,
    ``doc_tokens``, ``sequence_id`` and ``offset``.

    ``tokenizer`` is the path of a ``tokenizers`` file that all workers see. A document's
    ids are those of its text without special tokens, then ``separator``; ``ids`` are a
    piece's as unsigned little-endian 32-bit numbers, ``doc_tokens`` counts the document's.
    The pieces of one sequence lie at gapless offsets from 0. A null or empty text is the
    separator alone, a repeated row is packed again, a null id stays null, other columns
    are not read, and an empty table gives an empty result.
    """
    id_type = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    kinds = f"id {id_type}, start bigint, length bigint, doc_tokens bigint, ids binary"
    cut = rows.mapInArrow(_cutter(tokenizer, capacity, separator), kinds)
    items = store_in_batches(cut.withColumn("item", F.monotonically_increasing_id()), "items", BATCH_BYTES)
    full = items.where(F.col("length") == capacity)
    placed = [full.select("id", "start", "length", "ids", "doc_tokens", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]

    # At most capacity - 1 lengths.
    rests = items.where(F.col("length") < capacity).select("item", "length", F.shiftright("item", TASK_BITS).alias("task"))
    counts = store(rests.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    plan = planned({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    table = np.array(sorted(plan.rows), np.int64).reshape(-1, 7)

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("task", "length").orderBy("item")) - 1
    numbered = rests.withColumn("nth", nth).join(bases, ["task", "length"])
    parts = numbered.select("item", "length", (F.col("base") + F.col("nth")).alias("number")).mapInArrow(
        _seater(table), "item bigint, part bigint, size bigint, sequence_id bigint, offset bigint"
    )
    ids = F.substring("ids", (F.col("part") * 4 + 1).cast("int"), (F.col("size") * 4).cast("int"))
    placed.append(
        items.where(F.col("length") < capacity)
        .join(parts, "item")
        .select("id", (F.col("start") + F.col("part")).alias("start"), F.col("size").alias("length"), ids.alias("ids"), "doc_tokens", "sequence_id", "offset")
    )
    return placed[0].union(placed[1]).withColumnRenamed("id", id_column)


def _cutter(tokenizer: str, capacity: int, separator: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, stops in encoded(batches, tokenizer, separator):
            begins = np.append(0, stops[:-1])
            sizes = stops - begins
            counts = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), counts)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * capacity
            length = np.minimum(sizes[owner] - start, capacity)
            # The pieces lie end to end, as the ids do.
            bounds = np.append(0, np.cumsum(length * 4))
            values = pa.Array.from_buffers(
                pa.large_binary(), len(length), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]
            )
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(sizes[owner]), values.cast(pa.binary())],
                ["id", "start", "length", "doc_tokens", "ids"],
            )

    return cut


def _seater(plan: np.ndarray):
    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            row, *places = seats(plan, length, number)
            yield pa.RecordBatch.from_arrays(
                [batch.column("item").take(pa.array(row)), *map(pa.array, places)], ["item", "part", "size", "sequence_id", "offset"]
            )

    return seat
