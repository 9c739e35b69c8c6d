"""Scoring tables that hold turns which cannot be scored, in one pass.

Whether a turn can be scored shows only when its vector is there, so telling such turns
first would make every vector twice. Here the kernel sets them aside as it meets them
and scores the others as if they had not come: a turn's context is the fit turns before
it, and its number is its place among the fit turns.

Where dialogues are cut into chunks, what a chunk's first turns need lies before it, and
how far before is not known until the turns there have been looked at. So a chunk is
scored from its own turns alone; its first and last m fit turns go on as its edges, a
handful of vectors per chunk. In the sorted edges of a dialogue the m turns before each
first turn are those before it in the dialogue, so the same kernel, run over the edges,
gives the scores that the chunks could not. The numbers of fit turns per chunk, summed
over the chunks before, close the gaps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.config import SegmenterConfig
from seamline.functions.encoders import Encoder
from seamline.functions.vectors import problem, problems
from seamline.operators.prefix import LEVEL_BITS, carried, chunk_of, number_turns
from seamline.operators.scoring import DISTANCES, MARKS, NOT_DENSE, TOO_LONG, Scorer, score_turns
from seamline.storage import store

#: Kinds of rows of the one pass.
SCORED, UNFIT, EDGE = range(3)


def score_fit_turns(
    turns: DataFrame,
    config: SegmenterConfig = SegmenterConfig(),
    *,
    longest: int | None = None,
    encoder: Encoder | None = None,
    keep: Sequence[str] = (),
    mark: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The scored fit turns, numbered anew, and ``(conv_id, turn, reason, *keep)`` of the others.

    ``turns`` and the parameters are those of ``score_turns``: ``turn`` must number each
    dialogue 0..n-1. The result of the pass is written once and both tables read it; an
    encoder meets each text once. Marks are left out where dialogues are cut.
    """
    payload = [c for c in keep if c not in ("conv_id", "turn")]
    vector = "embedding" if encoder is None else "text"
    rows = turns.select(*dict.fromkeys(["conv_id", "turn", vector, *payload]))
    if config.engine == "jvm":
        return _by_columns(rows, config, longest, encoder, payload, mark)
    split = longest is None or longest > config.chunk_turns
    chunk = chunk_of(F.col("turn"), config.chunk_turns) if split else F.lit(0).cast("bigint")
    placed = rows.withColumn("chunk", chunk).repartition("conv_id", "chunk")
    placed = placed.sortWithinPartitions("conv_id", "chunk", "turn")
    if encoder is not None:
        placed = placed.withColumn("embedding", encoder(F.col("text")))
    placed = placed.select("conv_id", "chunk", "turn", "embedding", *[F.col(c).alias(f"keep_{c}") for c in payload])
    kernel = _OnePass(config, mark and not split, split)
    passed = store(placed.mapInArrow(kernel, _schema(placed, kernel.mark)), "fit")

    unfit = passed.where(F.col("kind") == UNFIT).select(
        "conv_id", F.col("input_turn").alias("turn"), "reason", *[F.col(f"keep_{c}").alias(c) for c in payload]
    )
    scored = passed.where(F.col("kind") == SCORED)
    if split:
        scored = _joined(passed, scored, config)
    marks = [m for m in MARKS if kernel.mark]
    names = [F.col("at").alias("turn"), *[F.col(f"keep_{c}").alias(c) for c in payload]]
    return scored.select("conv_id", *names, *DISTANCES, *marks), unfit


def _by_columns(rows, config, longest, encoder, payload, mark):
    """The same from built-in functions: vectors are written once with what is wrong with them."""
    if encoder is not None:
        rows = rows.withColumn("embedding", encoder(F.col("text")))
    found = store(rows.withColumn("_reason", problem(F.col("embedding"), config.dim)), "fit")
    unfit = found.where("_reason IS NOT NULL").select("conv_id", "turn", F.col("_reason").alias("reason"), *payload)
    fit = number_turns(found.where("_reason IS NULL").drop("_reason"))
    return score_turns(fit, config, longest=longest, keep=payload, mark=mark), unfit


def _schema(placed: DataFrame, mark: bool) -> T.StructType:
    kept = placed.schema.fields[4:]
    fields = [placed.schema["conv_id"], T.StructField("at", T.LongType()), T.StructField("chunk", T.LongType())]
    fields += [T.StructField("input_turn", T.LongType()), *kept]
    fields += [T.StructField(name, T.DoubleType()) for name in DISTANCES]
    fields += [T.StructField(name, T.LongType()) for name in MARKS if mark]
    fields += [T.StructField("kind", T.IntegerType()), T.StructField("reason", T.StringType())]
    return T.StructType([*fields, T.StructField("vector", T.ArrayType(T.DoubleType()))])


def _joined(passed: DataFrame, scored: DataFrame, config: SegmenterConfig) -> DataFrame:
    """The turns of all chunks, the first of each scored from the edges, at their places in the dialogue."""
    m = config.ctx_window
    first = (F.col("chunk") > 0) & (F.col("at") < m)
    edges = passed.where(F.col("kind") == EDGE)
    own = [c for c in passed.columns if c not in DISTANCES]
    ordered = edges.select(*own).repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "at")
    again = ordered.mapInArrow(_Edges(config, own), passed.schema).where(first)
    rows = scored.where(~first).union(again)
    counts = store(
        scored.groupBy("conv_id", F.col("chunk").alias("block")).agg(F.count(F.lit(1)).alias("_before")), "counts"
    )
    before = carried(counts, {"_before": "sum"}, LEVEL_BITS).where("_before > 0")
    before = before.select("conv_id", F.col("block").alias("chunk"), "_before")
    return rows.join(before, ["conv_id", "chunk"], "left").withColumn(
        "at", F.col("at") + F.coalesce("_before", F.lit(0))
    )


def _changes(columns: Sequence[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it, the first row not counted."""
    changed = np.zeros(len(columns[0]), bool)
    for column in columns:
        differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
        changed[1:] |= differs.to_numpy(zero_copy_only=False)
    return changed


class _OnePass:
    """The kernel of the one pass over the sorted rows of a task.

    It holds what ``Scorer`` holds, and of the open chunk its first and last m fit rows.
    """

    def __init__(self, config: SegmenterConfig, mark: bool, split: bool) -> None:
        self.config, self.mark, self.split = config, mark, split

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(self.config, self.mark, local=True)
        key, last, fit_before, head, tail, rows = None, -1, 0, [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, chunk, turn, vectors = batch.columns[:4]
            reasons = problems(vectors, self.config.dim)
            fit = reasons == None  # noqa: E711  elementwise
            opens = _changes([conv, chunk])
            opens[0] = key != (conv[0].as_py(), chunk[0].as_py())
            turns, chunks = turn.to_numpy(), chunk.to_numpy()
            follows = np.concatenate(([last], turns[:-1])) + 1
            starts = chunks * self.config.chunk_turns if self.split else np.zeros(len(turns), np.int64)
            if not np.array_equal(turns, np.where(opens, starts, follows)):
                raise ValueError(NOT_DENSE)
            if (turns - starts >= self.config.chunk_turns).any():
                raise ValueError(TOO_LONG)
            # The place of each fit row among those of its chunk.
            so_far = np.cumsum(fit)
            opened = np.maximum.accumulate(np.where(opens, np.arange(len(fit)), -1))
            at = so_far - fit - np.where(opened < 0, -fit_before, (so_far - fit)[opened])

            rest = batch.columns[4:]
            if not fit.all():
                yield self._row(batch, [conv, None, chunk, turn, *rest], pa.array(reasons), ~fit)
            sub = pa.RecordBatch.from_arrays(
                [conv, chunk, pa.array(at), vectors, chunk, turn, *rest], [f"c{i}" for i in range(6 + len(rest))]
            )
            sub = sub if fit.all() else sub.filter(pa.array(fit))
            if sub.num_rows:
                for scored in scorer.blocks(sub):
                    yield self._named(scored, batch)
            if self.split:
                begins = np.append(0, np.flatnonzero(opens[1:]) + 1)
                ends = np.append(begins[1:], len(fit))
                fits = np.append(0, so_far)
                # Chunks that begin and end within the batch, however many, go on together.
                closed = opens[begins] & (ends < len(fit))
                # A whole short dialogue has no edges that anything needs.
                wanted = closed & ((ends - begins == self.config.chunk_turns) | (chunks[begins] > 0))
                edge = self._edge_rows(sub.column(2).to_numpy(), fits[begins], fits[ends], wanted)
                if edge.any():
                    yield self._as_edges(sub.filter(pa.array(edge)), batch)
                for begin, end in zip(begins[~closed].tolist(), ends[~closed].tolist()):
                    if opens[begin]:
                        yield from self._edges(batch, head, tail, rows)
                        head, tail, rows = [], [], 0
                    rows += end - begin
                    some = sub.slice(int(fits[begin]), int(fits[end] - fits[begin]))
                    short = self.config.ctx_window - sum(b.num_rows for b in head)
                    if short > 0:
                        head.append(some.slice(0, short))
                        some = some.slice(short)
                    tail = self._last([*tail, some])
            key, last = (conv[-1].as_py(), chunk[-1].as_py()), int(turns[-1])
            fit_before = int(at[-1] + fit[-1])
        if self.split and key is not None:
            yield from self._edges(batch, head, tail, rows)

    def _edge_rows(self, at: np.ndarray, begins: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Which fit rows are among the first or last m of a chunk that is wanted."""
        count = ends - begins
        left = np.repeat(count, count) - at
        m = self.config.ctx_window
        return np.repeat(wanted, count) & ((at < m) | (left <= m))

    def _last(self, parts: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        kept, need = [], self.config.ctx_window
        for part in reversed(parts):
            if need and part.num_rows:
                kept.append(part.slice(max(0, part.num_rows - need)))
                need -= kept[-1].num_rows
        return kept[::-1]

    def _edges(self, batch, head, tail, rows) -> Iterator[pa.RecordBatch]:
        """The edges of a chunk that another one follows, or that follows one."""
        for part in [*head, *tail]:
            if part.num_rows and (rows == self.config.chunk_turns or part.column(1)[0].as_py()):
                yield self._as_edges(part, batch)

    def _as_edges(self, part: pa.RecordBatch, batch: pa.RecordBatch) -> pa.RecordBatch:
        conv, chunk, at, vectors, _, turn, *rest = part.columns
        none = pa.nulls(part.num_rows, pa.float64())
        columns = [conv, at, chunk, turn, *rest, none, none, none]
        columns += [pa.array(np.full(part.num_rows, EDGE, np.int32)), pa.nulls(part.num_rows, pa.string())]
        return pa.RecordBatch.from_arrays([*columns, vectors.cast(pa.list_(pa.float64()))], self._names(batch))

    def _names(self, batch: pa.RecordBatch) -> list[str]:
        marks = MARKS if self.mark else ()
        return ["conv_id", "at", "chunk", "input_turn", *batch.schema.names[4:], *DISTANCES, *marks, "kind", "reason", "vector"]

    def _row(self, batch, columns, reasons, chosen) -> pa.RecordBatch:
        n = batch.num_rows
        columns = [pa.nulls(n, pa.int64()) if c is None else c for c in columns]
        columns += [pa.nulls(n, pa.float64())] * 3 + [pa.nulls(n, pa.int64())] * (2 * self.mark)
        columns += [pa.array(np.full(n, UNFIT, np.int32)), reasons.cast(pa.string()), pa.nulls(n, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, self._names(batch)).filter(pa.array(chosen))

    def _named(self, scored: pa.RecordBatch, batch: pa.RecordBatch) -> pa.RecordBatch:
        n = scored.num_rows
        more = [pa.array(np.full(n, SCORED, np.int32)), pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([*scored.columns, *more], self._names(batch))


class _Edges:
    """Scores the edges of each dialogue in their order."""

    def __init__(self, config: SegmenterConfig, names: list[str]) -> None:
        self.config, self.names = config, names

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, key, count = Scorer(self.config, local=True), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, n = batch.column("conv_id"), batch.num_rows
            opens = _changes([conv])
            opens[0] = key is None or key != conv[0].as_py()
            opened = np.maximum.accumulate(np.where(opens, np.arange(n), -1))
            place = np.arange(n) - np.where(opened < 0, -count, opened)
            key, count = conv[-1].as_py(), int(place[-1]) + 1
            zero = pa.array(np.zeros(n, np.int64))
            rows = [conv, zero, pa.array(place), batch.column("vector"), *[batch.column(c) for c in self.names]]
            rows = pa.RecordBatch.from_arrays(rows, [f"c{i}" for i in range(len(rows))])
            for scored in scorer.blocks(rows):
                # What comes out is conv_id, place, all columns of the edges, then the distances.
                by = dict(zip([*self.names, *DISTANCES], scored.columns[2:]))
                out = [*self.names]
                out[out.index("kind") : out.index("kind")] = DISTANCES
                yield pa.RecordBatch.from_arrays([by[c] for c in out], out)
