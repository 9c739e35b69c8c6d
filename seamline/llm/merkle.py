"""A Merkle manifest of a table, and proofs for many of its rows at once.

Every row is a leaf: the digest of its fields. The leaves of a group, in order of
their id, are folded pairwise to the group's root, and the roots of the groups, in
order of their names, to the root of the table. A digest is a lower-case hex SHA-256
and enters the next one as that text.

Leaves are put in order by one range shuffle, so a group may hold any share of the
rows. Blocks of ``2**bits`` neighbours are folded side by side, then blocks of their
tops, until each group has one node left.

Proofs are made as in Octopus (multiproofs of a sparse set of leaves): a task that
holds a block's leaves works out the smallest set of node coordinates that it cannot
derive from its own leaves. The coordinates of all blocks meet the stored nodes in one
join. Then each task derives the nodes its leaves share, once, and writes the leaves'
own proofs from them.

Rows whose group is null are a group of their own, the first one; rows without an id
come first in their group. Rows of one id are ordered by their leaves, and equal rows
are leaves of their own. An empty table has no leaves and no root.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm.common import if_small, runs
from seamline.storage import store

#: Levels that one task folds, and so the bits of a place within a block.
BITS = 12
#: Rows up to which a table of runs of leaves, one per group and task, is broadcast.
BROADCAST_RUNS = 100_000
#: Low bits of a row's number within its task (fixed value of Spark).
TASK_BITS = 33

NODES = "name string, level int, idx bigint, total bigint, hash string"
PROOFS = "leaf string, name string, idx bigint, total bigint, subroot string, root string, proof string, folded_root string"
#: Kinds of rows a block's task reads, in this order.
HEADER, OF_GROUP, OF_TOP, LEAF = range(4)


def leaf_of(fields: Sequence[str | Column]) -> Column:
    """The digest of a row: each field as ``-`` if null, else its bytes' number, ``:`` and its text."""
    parts = []
    for field in fields:
        text = (F.col(f"`{field}`") if isinstance(field, str) else field).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


@dataclass(frozen=True)
class Manifest:
    """A table's tree.

    ``leaves``   id, ``name`` (the group), ``idx`` (place in it), ``total`` (leaves of it),
                 ``hash``, ``altered`` (the leaf of a changed row, or null)
    ``nodes``    nodes above the leaves, by ``name``, ``level`` and ``idx``
    ``groups``   ``name``, ``total`` (leaves), ``hash`` (the group's root), ``rank``
    ``top``      nodes above the groups' roots
    ``root``     the root, or null for an empty table
    ``bits``     levels that one task folds
    """

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    top: DataFrame
    root: str | None
    bits: int


# ---------------------------------------------------------------------- trees


def manifest(
    rows: DataFrame,
    fields: Sequence[str | Column],
    id_column: str,
    group_column: str,
    altered: Sequence[str | Column] | None = None,
    bits: int = BITS,
) -> Manifest:
    """The tree over ``rows``; only the named columns are read.

    ``altered`` gives fields like ``fields`` whose digest is kept beside the leaf, for
    checks of copies of the rows; it takes no part in the tree. A task folds ``bits`` levels.
    """
    leaf = leaf_of(fields)
    other = F.lit(None).cast("string") if altered is None else leaf_of(altered)
    slim = rows.select(
        F.col(f"`{group_column}`").cast("string").alias("name"),
        F.col(f"`{id_column}`").alias("id"),
        leaf.alias("hash"),
        other.alias("altered"),
    ).withColumn("altered", F.when(F.col("altered") != F.col("hash"), F.col("altered")))
    leaves = _placed(store(slim, "leaves"), ["id", "hash"])
    nodes = _folded(leaves, bits)
    groups = _tops(leaves, nodes)
    ranked = _placed(groups.select(F.lit(None).cast("string").alias("name"), F.col("name").alias("group"), "hash"), ["group"])
    top = _folded(ranked, bits)
    ranks = ranked.select("group", F.col("idx").alias("rank"), F.col("total").alias("ranks"))
    groups = groups.join(ranks, F.col("name").eqNullSafe(F.col("group"))).drop("group")
    last = _tops(ranked, top).first()
    return Manifest(leaves, nodes, store(groups, "groups"), top, last["hash"] if last else None, bits)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place within ``name`` in this order, and ``total``.

    Equal rows are told apart by their number, so that no task gets all of them.
    """
    numbered = rows.withColumn("_nth", F.monotonically_increasing_id())
    ordered = numbered.repartitionByRange("name", *order, "_nth").sortWithinPartitions("name", *order, "_nth")
    ordered = store(ordered.drop("_nth").withColumn("at", F.monotonically_increasing_id()), "ordered")
    task = F.shiftright("at", TASK_BITS)
    counts = ordered.groupBy(F.col("name").alias("run_name"), task.alias("run_task")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("at").alias("first")
    )
    # One row per group and task of the sort.
    earlier = Window.partitionBy("run_name").orderBy("run_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "run_name",
        "run_task",
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(Window.partitionBy("run_name")).alias("total"),
    )
    same = F.col("name").eqNullSafe(F.col("run_name")) & (task == F.col("run_task"))
    kept = [c for c in rows.columns]
    return ordered.join(if_small(counts, BROADCAST_RUNS), same).select(
        *kept, (F.col("at") + F.col("shift")).alias("idx"), "total"
    )


def _folded(leaves: DataFrame, bits: int) -> DataFrame:
    """The nodes above ``(name, idx, total, hash)``, level 1 and up, written once per ``bits`` levels."""
    row = leaves.agg(F.max("total")).first()
    height = ((row[0] or 1) - 1).bit_length()
    level = leaves.select("name", F.lit(0).alias("level"), "idx", "total", "hash")
    nodes = level.limit(0)
    for bottom in range(0, height, bits):
        block = F.shiftright("idx", bits).alias("block")
        dealt = level.select("*", block).repartition("name", "block").sortWithinPartitions("name", "block", "idx")
        above = store(dealt.mapInArrow(_folder(bits), NODES), "nodes")
        nodes = above if not bottom else nodes.union(above)
        level = above.where(F.col("level") == bottom + bits)
    return nodes


def _folder(bits: int):
    names = [c.split()[0] for c in NODES.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in runs(batches, ["name", "block"]):
            name, bottom, total = (block.column(c)[0].as_py() for c in ("name", "level", "total"))
            at, hashes = block.column("idx")[0].as_py(), block.column("hash").to_pylist()
            for level in range(bottom + 1, min(bottom + bits, (total - 1).bit_length()) + 1):
                hashes = [digest("".join(hashes[i : i + 2])) for i in range(0, len(hashes), 2)]
                at >>= 1
                count = len(hashes)
                columns = [pa.array([name] * count, pa.string()), pa.array([level] * count, pa.int32())]
                columns += [pa.array(np.arange(at, at + count)), pa.array([total] * count, pa.int64()), pa.array(hashes)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return fold


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _tops(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``name``, ``total`` and ``hash`` of the last node of each name: a lone leaf itself, or the top node."""
    alone = leaves.where("total = 1").select("name", "total", "hash")
    height = F.ceil(F.log2(F.col("total").cast("double"))).cast("int")
    # A logarithm of a large number may be off by one; the only node of its level is the top.
    last = nodes.where((F.col("idx") == 0) & F.col("level").between(height - 1, height + 1))
    best = last.groupBy("name", "total").agg(F.max_by("hash", "level").alias("hash"))
    return store(alone.union(best.select("name", "total", "hash")), "tops")


# --------------------------------------------------------------------- proofs


def missing(known: np.ndarray, total: int) -> list[tuple[int, int]]:
    """The fewest ``(level, idx)`` that, with the leaves ``known``, give all nodes above these.

    A sibling that is known, or that follows from known leaves, need not be asked for.
    """
    found, level = [], 0
    known = np.unique(known)
    while total > 1:
        sibling = known ^ 1
        wanted = np.setdiff1d(sibling[sibling < total], known, assume_unique=True)
        found += [(level, i) for i in wanted.tolist()]
        known, total, level = np.unique(known >> 1), (total + 1) // 2, level + 1
    return found


def prove(tree: Manifest, chosen: Column | None = None) -> DataFrame:
    """Proofs of all leaves, or of those where ``chosen`` (over columns of ``leaves``) holds.

    One row per leaf: ``id``, ``leaf``, ``name``, ``idx``, ``total``, ``subroot``, ``root``,
    ``proof`` (the siblings from the leaf to the root, 64 characters each, left to right) and
    ``folded_root``, what the altered leaf, or the leaf itself where none is altered, gives
    with these siblings.
    """
    leaves = tree.leaves if chosen is None else tree.leaves.where(chosen)
    leaves = leaves.withColumn("block", F.shiftright("idx", tree.bits))
    held = leaves.select("name", "block", "idx", "total").repartition("name", "block")
    wanted = store(held.sortWithinPartitions("name", "block", "idx").mapInArrow(_wanted, WANTED), "wanted")
    groups = tree.groups.select(F.col("name").alias("group"), F.col("hash").alias("subroot"), "rank", "ranks")
    # A group's way through the top tree is worked out once, whatever the number of its blocks.
    upper = _found(
        groups.select("group", "rank", "ranks").mapInArrow(_wanted_above, f"of string, {WANTED}"),
        tree.top,
        tree.groups.select(F.lit(None).cast("string").alias("name"), F.lit(0).alias("level"), F.col("rank").alias("idx"), "hash"),
    )
    blocks = wanted.where(F.col("kind") == HEADER)
    header = blocks.join(groups, F.col("name").eqNullSafe(F.col("group"))).select(
        "name", "block", "kind", "level", F.col("rank").alias("idx"), F.col("ranks").alias("total"),
        F.lit(tree.root).alias("hash"), F.col("subroot").alias("altered"),
    )
    ours = _found(
        wanted.where(F.col("kind") == OF_GROUP), tree.nodes, tree.leaves.select("name", F.lit(0).alias("level"), "idx", "hash")
    )
    above = blocks.select("name", "block").join(
        upper.drop("name", "block"), F.col("name").eqNullSafe(F.col("of"))
    )
    fetched = header
    for part in (ours, above):
        fetched = fetched.union(part.select("name", "block", "kind", "level", "idx", "total", "hash", F.lit(None).cast("string")))
    id_type = tree.leaves.schema["id"].dataType
    own = leaves.select("name", "block", F.lit(LEAF).alias("kind"), F.lit(0).alias("level"), "idx", "total", "hash", "altered", "id")
    dealt = fetched.withColumn("id", F.lit(None).cast(id_type)).union(own)
    dealt = dealt.repartition("name", "block").sortWithinPartitions("name", "block", "kind", "idx")
    return dealt.mapInArrow(_expand, f"id {id_type.simpleString()}, {PROOFS}")


def _found(wanted: DataFrame, nodes: DataFrame, ground: DataFrame) -> DataFrame:
    """``wanted`` with the ``hash`` of each coordinate; the leaves in ``ground`` are read only if one is asked for."""
    wanted = store(wanted, "coordinates")
    lowest = wanted.agg(F.min("level")).first()[0]
    nodes = nodes.select("name", "level", "idx", "hash")
    if lowest is not None:
        nodes = nodes.where(F.col("level") >= lowest) if lowest else nodes.union(ground)
    nodes = nodes.select(*[F.col(c).alias(f"at_{c}") for c in ("name", "level", "idx")], "hash")
    here = F.col("name").eqNullSafe(F.col("at_name"))
    for c in ("level", "idx"):
        here &= F.col(c) == F.col(f"at_{c}")
    return wanted.join(nodes, here).select(*wanted.columns, "hash")


WANTED = "name string, block bigint, kind int, level int, idx bigint, total bigint"
_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A header of each block, and the coordinates that it is to fetch of its group's tree."""
    names = [c.split()[0] for c in WANTED.split(", ")]
    for held in runs(batches, ["name", "block"]):
        name, block, total = (held.column(c)[0].as_py() for c in ("name", "block", "total"))
        rows = [(name, block, HEADER, 0, None, total)]
        rows += [(name, block, OF_GROUP, level, i, total) for level, i in missing(held.column("idx").to_numpy(), total)]
        yield _batch(rows, names, _KINDS)


def _wanted_above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The coordinates of the top tree that the leaves of each group need."""
    names = ["of", *[c.split()[0] for c in WANTED.split(", ")]]
    for batch in batches:
        for group in batch.to_pylist():
            total = group["ranks"]
            rows = [(group["group"], None, None, OF_TOP, level, i, total) for level, i in missing(np.array([group["rank"]]), total)]
            if rows:
                yield _batch(rows, names, [pa.string(), *_KINDS])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The proofs of each block's leaves."""
    for block in runs(batches, ["name", "block"]):
        kind = block.column("kind").to_numpy()
        ours = block.slice(int(np.searchsorted(kind, LEAF)))
        if not len(ours):
            continue
        rows = block.slice(0, len(kind) - len(ours)).select(["kind", "level", "idx", "total", "hash", "altered"]).to_pylist()
        header, fetched = rows[0], rows[1:]
        places, leaves = ours.column("idx").to_pylist(), ours.column("hash").to_pylist()
        total = ours.column("total")[0].as_py()
        lower = _derived(dict(zip(places, leaves)), total, [r for r in fetched if r["kind"] == OF_GROUP])
        subroot = lower[-1][0]
        rank, ranks = header["idx"], header["total"]
        upper = _derived({rank: subroot}, ranks, [r for r in fetched if r["kind"] == OF_TOP])
        if subroot != header["altered"] or upper[-1][0] != header["hash"]:
            raise ValueError("the nodes of the manifest do not fit its leaves")
        above = _siblings(upper, [rank], ranks)[rank]
        below = _siblings(lower, places, total)
        proofs = [below[i] + above for i in places]
        starts = [a or leaf for a, leaf in zip(ours.column("altered").to_pylist(), leaves)]
        folded = [folded_root(s, [(i, total), (rank, ranks)], p) for s, i, p in zip(starts, places, proofs)]
        count = len(places)
        yield pa.RecordBatch.from_arrays(
            [c.combine_chunks() for c in (ours.column("id"), ours.column("hash"), ours.column("name"), ours.column("idx"), ours.column("total"))]
            + [pa.array(x) for x in ([subroot] * count, [header["hash"]] * count, proofs, folded)],
            ["id", *[c.split()[0] for c in PROOFS.split(", ")]],
        )


def _derived(known: dict[int, str], total: int, fetched: list[dict]) -> list[dict[int, str]]:
    """Nodes by level, from the leaves up to the root, each derived once."""
    levels, level = [], 0
    while True:
        here = known | {r["idx"]: r["hash"] for r in fetched if r["level"] == level}
        levels.append(here)
        if total == 1:
            return levels
        known = {p: digest(here[2 * p] + (here[2 * p + 1] if 2 * p + 1 < total else "")) for p in {i >> 1 for i in known}}
        total, level = (total + 1) // 2, level + 1


def _siblings(levels: list[dict[int, str]], places: list[int], total: int) -> dict[int, str]:
    """The siblings on the way of each place to the root, shared ends built once."""
    at, counts = set(places), []
    ways = []
    for _ in levels[:-1]:
        ways.append(at)
        counts.append(total)
        at, total = {i >> 1 for i in at}, (total + 1) // 2
    found = {0: ""}
    for nodes, way, count in zip(levels[-2::-1], ways[::-1], counts[::-1]):
        found = {i: (nodes[i ^ 1] if i ^ 1 < count else "") + found[i >> 1] for i in way}
    return found if ways else dict.fromkeys(places, "")


def folded_root(leaf: str, ways: Sequence[tuple[int, int]], proof: str) -> str:
    """The root that ``leaf`` and the siblings in ``proof`` give.

    ``ways`` are the trees passed one after another, each as place and number of leaves.
    """
    at = 0
    for place, total in ways:
        while total > 1:
            if place ^ 1 < total:
                sibling = proof[at : at + 64]
                at += 64
                leaf = digest(sibling + leaf if place & 1 else leaf + sibling)
            else:
                leaf = digest(leaf)
            place, total = place >> 1, (total + 1) // 2
    return leaf
