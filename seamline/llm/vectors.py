"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks of a few dimensions. Two vectors within
a squared distance have a block within its proportional share of it, whatever the
vectors: the shares add up to the whole. So each block is range-joined under its share,
and the union of the candidates, which misses no pair, is verified on whole vectors.

The range join of a block puts vectors into grid cells as wide as the block's radius
and compares neighbouring cells. Cells are dealt into chunks of bounded size, and every
pair of chunks is one group, so a crowded cell is many small groups and not one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.graph import components
from seamline.llm.minhash import grouped
from seamline.storage import store


@dataclass(frozen=True)
class Pigeonhole:
    """Parameters.

    ``cosine``   link from this cosine on
    ``width``    dimensions per block, about
    ``chunk``    vectors of a cell that one group holds on either side, about
    ``seed``     of the rotation
    """

    cosine: float = 0.98
    width: int = 8
    chunk: int = 1024
    seed: int = 11

    def blocks(self, size: int) -> list[tuple[int, int, float]]:
        """First and last dimension of each block, and its radius, for vectors of a size.

        A little is added for rounding; verification takes it back.
        """
        ends = np.linspace(0, size, max(1, round(size / self.width)) + 1).astype(int)
        whole = 2 * (1 - self.cosine)
        return [(a, b, float(np.sqrt(whole * (b - a) / size)) + 1e-5) for a, b in zip(ends, ends[1:])]

    def rotation(self, size: int) -> np.ndarray:
        """A random orthogonal matrix, so that no block holds more of a difference than its share for long."""
        return np.linalg.qr(np.random.default_rng(self.seed).normal(size=(size, size)))[0]


def similar_vectors(
    vectors: DataFrame,
    config: Pigeonhole = Pigeonhole(),
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """One row per row of ``vectors``: id, ``n_links``, ``component_id``, ``kept``.

    Rows are compared if their labels are equal and not null and their vectors equally
    long; vectors that are null, empty or zero or hold a null or a non-finite component
    link with nothing. Links are pairs with a cosine of ``cosine`` or more in double
    precision. Equal vectors of a label are one node of the link graph, however many
    rows they are, and are never paired; their links count by rows all the same.
    ``component_id`` is the smallest id that links reach; a null id takes no part in
    it, has no component and is kept. Rows repeated with one id are rows of their own
    that link with each other. Other columns are not read; an empty table gives an
    empty result.
    """
    value = F.col(f"`{vector_column}`").cast("array<double>")
    sound = F.coalesce(
        F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(value, lambda x: x != 0)
        & F.col(f"`{label_column}`").isNotNull(),
        F.lit(False),
    )
    rows = vectors.select(
        F.col(f"`{id_column}`").cast("bigint").alias("id"),
        F.when(sound, F.col(f"`{label_column}`").cast("string")).alias("label"),
        F.when(sound, value).alias("vector"),
        sound.alias("sound"),
    )
    nodes = store(
        rows.where("sound")
        .groupBy("label", "vector")
        .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    links = store(_verified(_candidates(nodes, config), nodes, config), "links")
    sizes = nodes.select("node", "size")
    ends = links.select("a", "b").union(links.select("b", "a"))
    met = ends.join(sizes.toDF("b", "more"), "b").groupBy("a").agg(F.sum("more").alias("met"))
    roots = components(links)
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = (
        placed.join(least, "root")
        .join(met.withColumnRenamed("a", "node"), "node", "left")
        .select("label", "vector", "component_id", (F.coalesce("met", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    )
    full = rows.where("sound").join(answer, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("id", F.lit(0).cast("bigint").alias("n_links"), "id")
    done = full.union(alone).withColumn("component_id", F.expr("CASE WHEN id IS NOT NULL THEN component_id END"))
    return done.select(
        F.col("id").alias(id_column), "n_links", "component_id", F.expr("id <=> component_id").alias("kept")
    )


_BLOCKS = "node bigint, label string, size int, block int, x bigint, y bigint, part binary"


def _candidates(nodes: DataFrame, config: Pigeonhole) -> DataFrame:
    """Distinct pairs ``(a, b)`` with some block within its share."""
    members = store(nodes.select("node", "label", "vector").mapInArrow(_split(config), _BLOCKS), "blocks")
    cell = ["label", "size", "block", "x", "y"]
    cells = store(
        members.groupBy(cell)
        .agg(F.ceil(F.count(F.lit(1)) / config.chunk).alias("chunks"))
        .withColumn("cell", F.monotonically_increasing_id()),
        "cells",
    )
    # Each unordered pair of neighbours once: a cell with itself and with those after it.
    after = F.explode(F.expr("array(struct(0, 0), struct(0, 1), struct(1, -1), struct(1, 0), struct(1, 1))")).alias("d")
    near = cells.select("label", "size", "block", "x", "y", F.col("cell").alias("left"), F.col("chunks").alias("i"), after)
    near = near.withColumn("x", F.col("x") + F.col("d.col1")).withColumn("y", F.col("y") + F.col("d.col2"))
    right = cells.withColumnRenamed("cell", "right").withColumnRenamed("chunks", "j")
    pairs = store(near.join(right, cell).select("left", "right", "i", "j"), "cell-pairs")
    dealt = members.join(cells, cell).select(
        "cell", F.expr("pmod(xxhash64(node), chunks)").alias("chunk"), "node", "size", "block", "part"
    )
    dealt = store(dealt, "dealt")
    ours = dealt.join(pairs, F.col("cell") == F.col("left")).select(
        "left",
        "right",
        F.col("chunk").alias("i"),
        # Within a cell each pair of chunks once.
        F.explode(F.expr("sequence(if(left = right, chunk, 0L), j - 1)")).alias("j"),
        F.lit(0).alias("side"),
        "node",
        "size",
        "block",
        "part",
    )
    theirs = dealt.join(pairs, F.col("cell") == F.col("right")).select(
        "left",
        "right",
        F.explode(F.expr("filter(sequence(0L, i - 1), n -> left <> right OR n < chunk)")).alias("i"),
        F.col("chunk").alias("j"),
        F.lit(1).alias("side"),
        "node",
        "size",
        "block",
        "part",
    )
    groups = ours.union(theirs).repartition("left", "right", "i", "j")
    return groups.sortWithinPartitions("left", "right", "i", "j", "side").mapInArrow(
        _compare(config), "a bigint, b bigint"
    ).distinct()


def _split(config: Pigeonhole):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(2)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat, starts = vectors.values.to_numpy(), vectors.offsets.to_numpy()[:-1]
            for size in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == size)
                if size not in rotations:
                    rotations[size] = config.rotation(size)
                whole = flat[starts[own][:, None] + np.arange(size)]
                # Divided by the largest component first: no square overflows or vanishes.
                whole = whole / np.abs(whole).max(axis=1, keepdims=True)
                rotated = whole / np.linalg.norm(whole, axis=1, keepdims=True) @ rotations[size]
                rows = batch.take(pa.array(own))
                for number, (first, last, radius) in enumerate(config.blocks(size)):
                    part = rotated[:, first:last]
                    grid = np.floor(part[:, :2] / radius).astype(np.int64)
                    y = grid[:, 1] if grid.shape[1] > 1 else np.zeros(len(grid), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows.column(0),
                            rows.column(1),
                            pa.array(np.full(len(own), size, np.int32)),
                            pa.array(np.full(len(own), number, np.int32)),
                            pa.array(grid[:, 0]),
                            pa.array(y),
                            pa.array([p.tobytes() for p in part.astype(np.float32)], pa.binary()),
                        ],
                        ["node", "label", "size", "block", "x", "y", "part"],
                    )

    return split


def _compare(config: Pigeonhole):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 4):
            parts = np.frombuffer(b"".join(rows["part"]), np.float32).reshape(len(rows["node"]), -1).astype(np.float64)
            radius = config.blocks(int(rows["size"][0]))[int(rows["block"][0])][2]
            left = rows["side"] == 0
            own = rows["left"][0] == rows["right"][0] and rows["i"][0] == rows["j"][0]
            one, two = (parts, parts) if own else (parts[left], parts[~left])
            a, b = (rows["node"], rows["node"]) if own else (rows["node"][left], rows["node"][~left])
            for start in range(0, len(one), 1024):
                some = one[start : start + 1024]
                squared = (some**2).sum(axis=1)[:, None] + (two**2).sum(axis=1)[None, :] - 2 * some @ two.T
                i, j = np.nonzero(squared <= radius**2 + 1e-5)
                i += start
                if own:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j]))], ["a", "b"]
                    )

    return compare


def _verified(pairs: DataFrame, nodes: DataFrame, config: Pigeonhole) -> DataFrame:
    """The pairs whose whole vectors have the cosine, in double precision."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (one, two) in enumerate(zip(batch.column(2), batch.column(3))):
                one, two = one.values.to_numpy(), two.values.to_numpy()
                if len(one) == len(two) and cosine(one, two) >= config.cosine:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    whole = nodes.select("node", "vector")
    both = pairs.join(whole.toDF("a", "one"), "a").join(whole.toDF("b", "two"), "b")
    return both.select("a", "b", "one", "two").mapInArrow(check, "a bigint, b bigint")


def cosine(one: np.ndarray, two: np.ndarray) -> float:
    """Scaled by the largest components, so that tiny and huge vectors have one too."""
    one, two = one / np.abs(one).max(), two / np.abs(two).max()
    return float(one @ two / (np.sqrt(one @ one) * np.sqrt(two @ two)))
