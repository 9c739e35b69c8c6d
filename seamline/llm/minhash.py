"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

A document's set is its distinct word shingles. The sketch has one coordinate per
bin; in round i every shingle is hashed to one bin, and a bin keeps its smallest
value of the first round that reached it. After as many rounds as there are bins
each further round visits one bin with all shingles, so every coordinate is filled
and the share of equal coordinates of two sketches concentrates about the Jaccard
similarity as it does for independent MinHash, at a cost of about
``bins * ln(bins) + |set|`` hashes (Dahlgaard, Knudsen and Thorup, FOCS 2017).

Bands of coordinates give candidates; only what full sets confirm is a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import lgamma, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import WORD
from seamline.llm.graph import components
from seamline.storage import store, store_in_batches

_FULL = np.iinfo(np.uint64).max
#: Multipliers of the shingle hash: odd, one per word of a shingle, repeated beyond.
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)
#: Words whose hash a Python worker remembers before it starts afresh.
_KNOWN_WORDS = 100_000
#: Bytes of texts or sets in one batch for a Python worker: both sides hold a batch whole.
_BATCH_BYTES = 4 << 20
#: Probability that two sets agree by chance on more halves than allowed for.
_EXCEEDED = 1e-12


@dataclass(frozen=True)
class NearDuplicates:
    """Parameters. A pair of similarity 0.75 misses all of 40 bands of 5 with
    probability (1 - 0.75^5)^40 = 2e-5; more similar pairs far less often.

    ``shingle``      words per shingle
    ``percent``      link when 100 * intersection >= percent * union
    ``bands, rows``  number of bands and coordinates per band
    ``block``        documents whose sets one task holds twice when it compares
                     the members of a bucket
    """

    shingle: int = 5
    percent: int = 75
    bands: int = 40
    rows: int = 5
    block: int = 256

    @property
    def bins(self) -> int:
        return self.bands * self.rows


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", config: NearDuplicates = NearDuplicates()
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``.

    Words are the runs of characters other than space and U+0009 to U+000D, after
    A-Z are lower-cased. With fewer words than a shingle the whole sequence is the
    only shingle. A null text and one without words have an empty set, link with
    nothing and form a component of their own. ``component_id`` is the smallest id
    that links reach, ``kept`` says that it is the row's own. Rows with equal sets
    are one node of the link graph, however many they are, so copies are never
    paired. Rows repeated with one id all carry the same answer; a null id has no
    component and is kept. Other columns are not read; an empty table gives an
    empty result.
    """
    signed, placed = _classes(_named(docs, id_column, text_column), config)
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = placed.join(smallest, "root").select("k1", "k2", "component_id")
    rows = signed.select("id", "n", "k1", "k2")
    full = rows.where("n > 0").join(answer, ["k1", "k2"]).select("id", "n", F.col("component_id"))
    empty = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    # Null ids take no part in a component's smallest id and stand for themselves.
    done = full.union(empty).withColumn("component_id", F.expr("CASE WHEN id IS NOT NULL THEN component_id END"))
    return done.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.expr("id <=> component_id").alias("kept"),
    )


def without_near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", config: NearDuplicates = NearDuplicates()
) -> DataFrame:
    """The rows of ``docs``, with all columns, but one only of each component.

    It is the row with the smallest id, null ids last; of rows with one id that with the
    smallest digest of its text; of rows with one id and text any one, chosen by a hash
    of the whole row. Components are those of ``near_duplicates``, whatever the ids: rows
    of one id with different texts may both stay, and copies without an id do not. Rows
    without a word are in no component and all stay. An empty table gives an empty result.
    """
    named = _named(docs, id_column, text_column)
    _, placed = _classes(named, config)
    first = placed.groupBy("root").agg(F.min("sample").alias("first")).select("first.id", "first.digest")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), *_name_columns(id_column, text_column))
    chosen = rows.join(first, rows["id"].eqNullSafe(first["id"]) & (rows["digest"] == first["digest"]), "left_semi")
    worded = chosen.where(F.col("text").rlike(WORD)).groupBy("id", "digest")
    once = worded.agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    wordless = rows.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return once.select("row.*").union(wordless.select("row.*"))


def _name_columns(id_column: str, text_column: str) -> list[Column]:
    text = F.col(f"`{text_column}`").cast("string")
    return [
        F.col(f"`{id_column}`").cast("bigint").alias("id"),
        text.alias("text"),
        F.md5(text.cast("binary")).alias("digest"),
    ]


def _named(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(id, text, digest)``: id and digest find a text again where ids repeat or lack."""
    return docs.select(*_name_columns(id_column, text_column))


def _classes(docs: DataFrame, config: NearDuplicates) -> tuple[DataFrame, DataFrame]:
    """The rows with their set's name, and every set's ``(k1, k2, least, sample, root)``.

    ``least`` is the smallest id with that set, ``sample`` the id and digest of the row
    that comes first, ids ascending and null last.
    """
    signed = store_in_batches(docs.mapInArrow(_signer(config), _SIGNED), "signed", _BATCH_BYTES)
    sample = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "digest")).alias("sample")
    nodes = store(
        signed.where("n > 0")
        .groupBy("k1", "k2")
        .agg(F.min("id").alias("least"), sample, F.first("n").alias("n"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    shared = _shared_buckets(nodes)
    sets = _sets(docs, nodes, shared, config)
    links = store_in_batches(_confirmed(_star_pairs(shared), sets, config), "links", _BATCH_BYTES)
    left = _pairs_left(shared, links, sets, config)
    missed = store_in_batches(_confirmed(left, sets, config), "links", _BATCH_BYTES)
    roots = components(links.union(missed))
    placed = nodes.join(roots, "node", "left")
    return signed, placed.select("k1", "k2", "least", "sample", F.coalesce("root", "node").alias("root"))


_SIGNED = "id bigint, digest string, n bigint, k1 bigint, k2 bigint, bands array<bigint>"


# ------------------------------------------------------------ sets and sketches


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """Word to 64-bit hash, filled on first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` splits at space and
    U+0009 to U+000D only, which are the rules of ``near_duplicates``.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=1)], np.uint64)
    hashed = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    last = len(found) - size + 1
    total = np.zeros(last, np.uint64)
    for i in range(size):
        total += hashed[i : i + last] * (_ODD[i % len(_ODD)] ^ np.uint64(2 * (i // len(_ODD))))
    return np.unique(mixed(total))


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Fast similarity sketches of non-empty sets, one row each."""
    out = np.full((len(sets), bins), _FULL, np.uint64)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    for round_ in range(2 * bins):
        hashed = mixed(values + _ODD[:1] * np.uint64(round_ + 1))
        bin_ = (hashed >> np.uint64(40)) % np.uint64(bins) if round_ < bins else np.uint64(round_ - bins)
        place = owner * bins + np.asarray(bin_).astype(np.int64)
        # The round leads, so that a later one never replaces an earlier value.
        np.minimum.at(flat, place, (np.uint64(round_) << np.uint64(40)) | (hashed & np.uint64((1 << 40) - 1)))
        open_ = (out == _FULL).any(axis=1)
        if not open_.any():
            break
        still = open_[owner]
        values, owner = values[still], owner[still]
    return out


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per band; the same coordinates in another band differ."""
    parts = sketch.reshape(len(sketch), bands, rows)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _ODD[1], parts.shape[:2]).copy()
    for i in range(rows):
        total = mixed(total + parts[:, :, i] * _ODD[0])
    return total


def _batched(sets: list[np.ndarray], limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of sets with about ``limit`` members each, at least one set."""
    start = total = 0
    for i, one in enumerate(sets):
        if total and total + len(one) > limit:
            yield start, i
            start, total = i, 0
        total += len(one)
    if start < len(sets):
        yield start, len(sets)


def _signer(config: NearDuplicates):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = []
                for text in part.column(1).to_pylist():
                    sets.append(shingle_set(text, config.shingle, words))
                    if len(words) > _KNOWN_WORDS:
                        words.clear()
                n = np.array([len(s) for s in sets], np.int64)
                keys = np.array([_key(s) for s in sets], np.uint64).view(np.int64).reshape(-1, 2)
                full = [s for s in sets if len(s)]
                bands = [
                    band_hashes(sketches(full[a:b], config.bins), config.bands, config.rows) for a, b in _batched(full)
                ]
                flat = np.concatenate(bands).view(np.int64).reshape(-1) if bands else np.empty(0, np.int64)
                ends = np.concatenate(([0], np.cumsum(np.where(n > 0, config.bands, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1])]
                    + [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    ["id", "digest", "n", "k1", "k2", "bands"],
                )

    return sign


def _key(values: np.ndarray) -> tuple[int, int]:
    """128-bit name of a set."""
    digest = xxhash.xxh3_128_intdigest(values.tobytes())
    return digest >> 64, digest & (1 << 64) - 1


# ------------------------------------------------------------------- candidates


def _shared_buckets(nodes: DataFrame) -> DataFrame:
    """``(bucket, node, low, high, size)`` for every bucket with more than one node.

    A bucket is one hash of one band. Its ends are aggregated before the shuffle,
    and members meet them in a join that can be split by key, so a bucket with a
    large share of the nodes is no single task's.
    """
    members = nodes.select(F.explode("bands").alias("bucket"), "node")
    ends = members.groupBy("bucket").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("size")
    )
    return store(members.join(ends.where("low < high"), "bucket"), "buckets")


def _sets(docs: DataFrame, nodes: DataFrame, shared: DataFrame, config: NearDuplicates) -> DataFrame:
    """``(node, n, whole, short)`` of the nodes in shared buckets.

    The texts of one document per node are read again, found by id and digest, so that
    rows without an id or with one id meet no node but their own. ``whole`` holds the
    sorted 64-bit hashes, ``short`` their lower halves in the same number.
    """

    def build(batches):
        words = WordHashes()
        for batch in batches:
            rows = []
            for node, k1, k2, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                one = shingle_set(text, config.shingle, words)
                if len(words) > _KNOWN_WORDS:
                    words.clear()
                if tuple(np.array(_key(one), np.uint64).view(np.int64)) == (k1, k2):
                    short = (one & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    rows.append((node, len(one), one.tobytes(), short.tobytes()))
            node, n, whole, short = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.array(n, pa.int64())]
                + [pa.array(whole, pa.binary()), pa.array(short, pa.binary())],
                ["node", "n", "whole", "short"],
            )

    wanted = nodes.join(shared.select("node").distinct(), "node").select(
        "node", "k1", "k2", F.col("sample.id").alias("of"), F.col("sample.digest").alias("same")
    )
    found = F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same"))
    texts = wanted.join(docs, found).select("node", "k1", "k2", "text")
    built = texts.mapInArrow(build, "node bigint, n bigint, whole binary, short binary")
    return store_in_batches(built.dropDuplicates(["node"]), "sets", _BATCH_BYTES)


def _star_pairs(shared: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's first and last node."""
    ends = F.explode(F.array("low", "high")).alias("end")
    pairs = shared.select("node", ends).where("node <> end")
    return pairs.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, config: NearDuplicates) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    sizes, whole = sets.select("node", "n"), sets.select("node", "whole")
    near = (
        pairs.join(sizes.toDF("a", "na"), "a")
        .join(sizes.toDF("b", "nb"), "b")
        # The smaller set can at most be contained in the larger one.
        .where(f"100 * least(na, nb) >= {config.percent} * greatest(na, nb)")
        .select("a", "b")
    )
    both = near.join(whole.toDF("a", "one"), "a").join(whole.toDF("b", "two"), "b")

    def check(batches):
        for batch in batches:
            keep = []
            for i, (one, two) in enumerate(zip(batch.column(2), batch.column(3))):
                one, two = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                merged = np.concatenate((one, two))
                merged.sort()
                common = int(np.count_nonzero(merged[1:] == merged[:-1]))
                if 100 * common >= config.percent * (len(merged) - common):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.select("a", "b", "one", "two").mapInArrow(check, "a bigint, b bigint")


def _pairs_left(shared: DataFrame, links: DataFrame, sets: DataFrame, config: NearDuplicates) -> DataFrame:
    """Pairs of different components that share a bucket and may still be linked.

    Up to three members of a bucket are all paired by ``_star_pairs``. Larger
    buckets whose members are not yet one component are compared here, whole: the
    members are dealt into blocks, every pair of blocks is one group of at most two
    blocks, and a group's sets are compared by matrix products on the 32-bit halves.
    Halves that meet by chance make the count too small within a set and too large
    between sets; both are bounded. Of the pairs found only a spanning forest over
    the components and the pairs that these bounds leave open leave the group, to be
    confirmed on the full sets.
    """
    roots = components(links)
    members = shared.where("size > 3").join(roots, "node", "left")
    members = members.select("bucket", "node", F.coalesce("root", "node").alias("root"))
    open_ = members.groupBy("bucket").agg(
        F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("size")
    )
    open_ = open_.where("r0 < r1").select("bucket", F.ceil(F.col("size") / config.block).alias("blocks"))
    members = members.join(open_, "bucket").withColumn("block", F.expr("pmod(xxhash64(node), blocks)"))
    other = F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other")
    groups = members.select("bucket", "node", "root", "block", other).select(
        "bucket",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "block",
        "node",
        "root",
    )
    groups = groups.join(sets.select("node", "short"), "node")
    groups = groups.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "block", "node")

    def compare(batches):
        for rows in grouped(batches, 3):
            first = rows["block"] == rows["i"]
            yield _forest(rows["node"], rows["root"], rows["short"], first, rows["i"][0] == rows["j"][0], config)

    ordered = groups.select("bucket", "i", "j", "block", "node", "root", "short")
    return ordered.mapInArrow(compare, "a bigint, b bigint").distinct()


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[dict[str, np.ndarray]]:
    """Rows with the same first ``keys`` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    names: list[str] = []

    def rows() -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        return {n: table.column(n).to_numpy() for n in names}

    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        values = [batch.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for column in values:
            change[1:] |= column[1:] != column[:-1]
        starts = [0, *np.flatnonzero(change), batch.num_rows]
        if held and any(held[0].column(i)[0].as_py() != column[0] for i, column in enumerate(values)):
            yield rows()
            held = []
        for start, end in zip(starts, starts[1:]):
            if start:
                yield rows()
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield rows()


def _chance(sizes: np.ndarray) -> np.ndarray:
    """Halves on which different members of two sets agree, for each pair of sets:
    as many as are exceeded with a probability of ``_EXCEEDED`` at most.

    With m = product of the sizes / 2^32 expected, k are reached with m^k / k! at most.
    """
    logs = np.log(np.maximum(sizes, 1).astype(float))
    expected = logs[:, None] + logs[None, :] - 32 * log(2)
    most = np.zeros(expected.shape)
    k = 1
    while (likely := k * expected - lgamma(k + 1) > log(_EXCEEDED)).any():
        most[likely] = k
        k += 1
    return most


def _forest(nodes, roots, shorts, first, own: bool, config: NearDuplicates) -> pa.RecordBatch:
    """Pairs of similar sets that join components: one for each merger, and all unclear ones."""
    sizes = np.array([len(s) // 4 for s in shorts], np.int64)
    sets = [np.unique(np.frombuffer(s, np.uint32)) for s in shorts]
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    counts = np.diff(np.append(starts, len(values)))
    # Values of one set alone add nothing to an intersection.
    owner, column = owner[np.repeat(counts > 1, counts)], np.repeat(np.arange((counts > 1).sum()), counts[counts > 1])
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        low, high = np.searchsorted(column, (at, at + 8192))
        matrix = np.zeros((len(sets), 8192), np.float32)
        matrix[owner[low:high], column[low:high] - at] = 1
        common += matrix @ matrix.T
    total = sizes[:, None] + sizes[None, :]

    def similar(shared):
        return 100 * shared >= config.percent * (total - shared)

    paired = roots[:, None] != roots[None, :]
    paired &= np.triu(np.ones_like(paired), 1) if own else first[:, None] & ~first[None, :]
    # Halves may agree by chance, so counts next to the bound decide nothing here:
    # those pairs all leave the group, and only clear ones are thinned out. What sets
    # share beyond the common halves meets in halves that are repeated in both.
    repeated = sizes - [len(s) for s in sets]
    clear = similar(common - _chance(sizes)) & paired
    unclear = similar(common + np.minimum(repeated[:, None], repeated[None, :])) & ~clear & paired
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    found = [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for i, j in zip(*np.nonzero(unclear))]
    for i, j in zip(*map(np.ndarray.tolist, np.nonzero(clear))):
        x, y = root(int(roots[i])), root(int(roots[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            found.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
