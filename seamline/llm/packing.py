"""Packing token pieces into sequences with a distributed grouping genetic algorithm.

Documents are tokenized, closed with a separator and cut into pieces of at most
``capacity`` tokens. Only piece lengths take part in packing. Pieces are dealt into
shards of bounded size; every shard is evolved by several islands, each with a
population of whole packings. A child takes well-filled bins of one parent whole,
drops the bins of the other parent that hold the same pieces, and puts the displaced
pieces back by best fit (Falkenauer's grouping crossover). Between epochs the best
packing of an island moves on to the next island. Bins that stay too empty are
dissolved, and their pieces are dealt into fewer shards and evolved again.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm.minhash import mixed
from seamline.storage import store, store_in_batches

#: Parts between spaces that a worker remembers: 33 MB of tables.
_REMEMBERED = 250_000
#: Parts that the tokenizer meets at a time: what it returns takes far more room than ids.
_LEARNT = 4096
#: Bytes of texts encoded at a time.
_BYTES = 1 << 20
#: Bytes of texts in one batch for a Python worker: both sides hold a batch whole.
BATCH_BYTES = 4 << 20
#: The encoder of a worker, by the path of its tokenizer: it outlives a task.
_ENCODERS: dict[str, "Encoder"] = {}


@dataclass(frozen=True)
class Packing:
    """Parameters.

    ``capacity``     tokens per sequence
    ``shard``        pieces one task packs together, on average
    ``islands``      populations per shard
    ``population``   packings per island
    ``generations``  children per island and epoch, in units of the population
    ``epochs``       evolutions with a migration between two of them
    ``dissolve``     fill below which a bin is packed again in the next pass
    ``passes``       passes over what dissolved bins leave, while it needs more
                     than one shard, and one more
    """

    capacity: int = 2048
    shard: int = 4096
    islands: int = 2
    population: int = 4
    generations: int = 4
    epochs: int = 2
    dissolve: float = 0.97
    passes: int = 4


# --------------------------------------------------------------------- pieces


class Encoder:
    """Token ids of many whole texts at once, with vector operations over their bytes.

    The tokenizers this is for never merge across white space, so a text's ids are those
    of its space-separated parts one after another, and most parts occur again and
    again. Where runs of letters stand alone and only their case changes, parts end with
    a run of letters too, and are looked up in lower case. A part of up to 32 bytes is four numbers; a longer one is known by a 128-bit
    hash of its bytes and its length. A hash table over these numbers, probed for all
    parts of many texts together, says which parts have been encoded before; only new
    ones meet the tokenizer. A full table forgets what was not met again since it was last
    full, so a worker's memory is bounded.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same vocabulary for parts that need no more than lower case.
        self.bare = None
        if _splits_as_expected(path):
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = None
            self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.used = self.filled = 0
        #: Per known part its four numbers, hash and number of bytes, and the place and number of its ids.
        self.words, self.hashes = np.empty((4, 1024), np.uint64), np.empty(1024, np.uint64)
        self.size, self.at, self.count = np.empty((3, 1024), np.int64)
        self.pool = np.empty(4096, np.uint32)
        #: Whether a part was met again after it was learnt.
        self.met = np.zeros(1024, bool)
        #: The part that each slot of the table holds, or -1.
        self.slots = np.full(4096, -1, np.int32)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        ends = np.cumsum([0, *map(len, texts)])
        ids, stops = self.flat(np.frombuffer(b"".join(texts), np.uint8), ends)
        return [ids[a:b].tobytes() for a, b in zip(np.append(0, stops[:-1]), stops)]

    def flat(self, data: np.ndarray, ends: np.ndarray, separator: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between ``ends`` in ``data``, end to end, and where each one's end.

        With a separator each text is followed by it.
        """
        split = self.bare is not None
        if split:
            lower = _lowered(data)
            # A token of its own, whatever its letters, must not be taken apart nor made by lower case.
            split = not any(token in lower.tobytes() for token in self.special)
            data = lower if split else data
        start, stop, first = _parts(data, ends, split)
        entry = self._known(data, start, stop)
        count = self.count[entry]
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.pool[np.repeat(self.at[entry] - upto + count, count) + np.arange(total)]
        stops = np.append(0, upto)[first[1:]]
        if separator is not None:
            ids = np.insert(ids, stops, separator)
            stops = stops + np.arange(1, len(stops) + 1)
        return ids, stops

    def _known(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The entry of every part, after new ones have been encoded."""
        size = stop - start
        words, long = _words(data, start, size)
        hashed = _hashed(words[0], words[1], size)
        hashed[long] = _hashed(hashed[long] ^ words[2][long], words[3][long], size[long])
        entry = np.full(len(size), -1, np.int64)
        open_, new = np.arange(len(size)), []
        slot = hashed.astype(np.int64)
        while len(open_):
            found = self.slots[slot & (len(self.slots) - 1)].astype(np.int64)
            empty = found < 0
            new.append(open_[empty])
            open_, slot, found = open_[~empty], slot[~empty], found[~empty]
            same = self.size[found] == size[open_]
            for word, own in zip(self.words[:2], words):
                same &= word[found] == own[open_]
            wide = np.flatnonzero(same & (size[open_] > 16))
            for word, own in zip(self.words[2:], words[2:]):
                same[wide] &= word[found[wide]] == own[open_[wide]]
            entry[open_[same]] = found[same]
            open_, slot = open_[~same], slot[~same] + 1
        self.met[entry[entry >= 0]] = True
        new = np.concatenate(new) if new else np.empty(0, np.int64)
        if len(new):
            keys = np.stack([size[new].astype(np.uint64), *[w[new] for w in words]], axis=1)
            _, where, inverse = np.unique(hashed[new], return_index=True, return_inverse=True)
            if (keys[where][inverse] != keys).any():  # parts that differ have one hash
                _, where, inverse = np.unique(keys, axis=0, return_index=True, return_inverse=True)
            if self.used and self.used + len(where) > _REMEMBERED:
                self._forget()
                return self._known(data, start, stop)
            at = new[where]
            parts = [data[a:b].tobytes() for a, b in zip(start[at].tolist(), stop[at].tolist())]
            self._append(self._learn(parts), [w[at] for w in words], size[at], hashed[at])
            entry[new] = self.used - len(where) + inverse.reshape(-1)
        return entry

    def _forget(self) -> None:
        """Only parts that were met again stay, up to half a table of them; where that frees nothing, none."""
        kept = np.flatnonzero(self.met[: self.used])[: _REMEMBERED // 2]
        kept = kept if len(kept) < self.used else kept[:0]
        ids = [self.pool[a : a + n].tobytes() for a, n in zip(self.at[kept].tolist(), self.count[kept].tolist())]
        words, size, hashes = list(self.words[:, kept]), self.size[kept], self.hashes[kept]
        self._clear()
        if len(kept):
            self._append(ids, words, size, hashes)

    def _append(self, ids: list[bytes], words: list[np.ndarray], size: np.ndarray, hashed: np.ndarray) -> None:
        old, self.used = self.used, self.used + len(ids)
        count = np.array([len(i) // 4 for i in ids], np.int64)
        filled, self.filled = self.filled, self.filled + int(count.sum())
        self.pool = _grown(self.pool, self.filled)
        self.pool[filled : self.filled] = np.frombuffer(b"".join(ids), "<u4")
        self.words = _grown(self.words, self.used)
        for name, values in (("at", filled + np.cumsum(count) - count), ("count", count), ("size", size), ("hashes", hashed)):
            setattr(self, name, _grown(getattr(self, name), self.used))
            getattr(self, name)[old : self.used] = values
        for word, values in zip(self.words, words):
            word[old : self.used] = values
        self.met = _grown(self.met, self.used)
        self.met[old : self.used] = False
        if self.used * 4 > len(self.slots):
            self.slots = np.full(1 << (self.used * 8).bit_length(), -1, np.int32)
            old = 0
        # Of the parts that want one slot the last one written gets it, the others try the next.
        part, slot = np.arange(old, self.used), self.hashes[old : self.used].astype(np.int64)
        while len(part):
            place = slot & (len(self.slots) - 1)
            free = self.slots[place] < 0
            self.slots[place[free]] = part[free]
            lost = self.slots[place] != part
            part, slot = part[lost], slot[lost] + 1

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of new parts; those of lower-case letters by their letters."""
        texts = [word.decode("utf-8", "replace") for word in words]
        plain = [bool(self.bare) and text.isalpha() and _plain(text) for text in texts]
        stems = iter(self._ids(self.bare, [t.lower() for t, p in zip(texts, plain) if p]) if any(plain) else [])
        rest = iter(self._ids(self.tokenizer, [t for t, p in zip(texts, plain) if not p]) if not all(plain) else [])
        return [next(stems if p else rest) for p in plain]

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        ids: list[bytes] = []
        for first in range(0, len(texts), _LEARNT):
            part = texts[first : first + _LEARNT]
            found = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(found.ids, "<u4").tobytes()
            ends = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(part)), side="right") * 4
            ids += [raw[start:end] for start, end in zip([0, *ends.tolist()], ends.tolist())]
        return ids


def _grown(values: np.ndarray, size: int) -> np.ndarray:
    """``values`` with room for ``size`` of them, twice as many if it has to be moved."""
    if values.shape[-1] >= size:
        return values
    more = np.empty((*values.shape[:-1], 2 * size), values.dtype)
    more[..., : values.shape[-1]] = values
    return more


def _words(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The bytes of each part as four numbers, and which parts have more than two."""
    padded = np.concatenate((data, np.zeros(32, np.uint8)))
    # Eight bytes from each place, though places are not aligned.
    eight = np.ndarray(len(data) + 24, "<u8", padded, strides=(1,))
    words = [eight[start] & _MASKS[np.minimum(size, 8)], np.zeros(len(size), np.uint64)]
    words += [np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)]
    more = np.flatnonzero(size > 8)
    words[1][more] = eight[start[more] + 8] & _MASKS[np.minimum(size[more] - 8, 8)]
    long = more[size[more] > 16]
    for number in (2, 3):
        words[number][long] = eight[start[long] + 8 * number] & _MASKS[np.clip(size[long] - 8 * number, 0, 8)]
    for at in long[size[long] > 32].tolist():
        whole = xxhash.xxh3_128_intdigest(data[start[at] : start[at] + size[at]].tobytes())
        words[2][at], words[3][at] = whole >> 64, whole & (1 << 64) - 1
    return words, long


#: Low bytes of a number, by how many.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARK = ~_SPACE & ~_LETTER & (np.arange(256) < 128)
#: Lower case of ASCII letters, and of what follows the first byte of U+00C0 to U+00DE.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_LOWER_SECOND = np.array([b + 32 if 0x80 <= b <= 0x9E and b != 0x97 else b for b in range(256)], np.uint8)
#: The second bytes of U+00C0 to U+00FF that are letters.
_LETTER_SECOND = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])


def _lowered(data: np.ndarray) -> np.ndarray:
    """The texts with the letters of ASCII and Latin-1 in lower case, which are of the same length."""
    lower = _LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    lower[second] = _LOWER_SECOND[data[second]]
    return lower


def _parts(data: np.ndarray, ends: np.ndarray, split: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of each part between white space, and the number of parts before each text.

    With ``split`` a letter and a mark or digit after it belong to two parts.
    """
    solid = ~_SPACE[data]
    joined = np.zeros(len(data) + 1, bool)
    joined[1:-1] = solid[1:] & solid[:-1]
    if split:
        letter = _LETTER[data]
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        letter[second] = _LETTER_SECOND[data[second]]
        joined[1:-1] &= ~(letter[:-1] & _MARK[data[1:]])
    # A part ends with its text.
    joined[ends] = False
    start = np.flatnonzero(solid & ~joined[:-1])
    stop = np.flatnonzero(solid & ~joined[1:]) + 1
    return start, stop, np.searchsorted(start, ends)


def _hashed(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mixed(mixed(low + size.astype(np.uint64)) + high * np.uint64(0x9E3779B97F4A7C15))


#: The steps before the merges of tokenizers for which runs of letters stand
#: alone and only their case changes.
_STEPS = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _splits_as_expected(path: str) -> bool:
    with open(path, encoding="utf-8") as file:
        steps = json.load(file)
    before, split = steps.get("normalizer") or {}, steps.get("pre_tokenizer") or {}
    kinds = ([x["type"] for x in before.get("normalizers", [])], [x["type"] for x in split.get("pretokenizers", [])])
    return kinds == _STEPS and split["pretokenizers"][0]["pattern"] == {"Regex": _PATTERN}


def _plain(letters: str) -> bool:
    """Whether case is all that normalising changes, letter by letter."""
    if letters.isascii():
        return True
    # A capital sigma is lower-cased by its place; some capitals become more than letters.
    return unicodedata.is_normalized("NFC", letters) and "Σ" not in letters and letters.lower().isalpha()


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array without nulls, and where each value ends."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    separator: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: bool = False,
    squeeze: bool = False,
) -> DataFrame:
    """Token pieces of every document: id, ``piece``, ``start``, ``length``, ``ids``.

    ``tokenizer`` is the path of a ``tokenizers`` file whose pre-tokenizer splits at
    white space; all workers must see it. A document's ids are those of its text
    without special tokens, then ``separator``; a null or empty text is the separator
    alone. Documents longer than ``capacity`` are cut into full pieces, the last of
    which may be shorter. A repeated row makes repeated pieces, a null id stays null,
    other columns are not read, and an empty table gives an empty result. With
    ``digest`` the ids are replaced by ``ids_crc32``, the crc32 of the ids as unsigned
    little-endian 32-bit numbers, so that they need not be written. With ``squeeze`` they
    are binary values of a third of the size, for what writes and shuffles pieces;
    ``unsqueezed`` makes arrays of them again.
    """
    last = "ids_crc32 bigint" if digest else "ids binary" if squeeze else "ids array<int>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, stops in encoded(batches, tokenizer, separator):
            begins = np.append(0, stops[:-1])
            sizes = stops - begins
            counts = -(-sizes // capacity)
            owner = np.repeat(np.arange(len(sizes)), counts)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = number * capacity
            length = np.minimum(sizes[owner] - start, capacity)
            if digest:
                view = memoryview(ids.astype("<u4")).cast("B")
                cuts = zip(((begins[owner] + start) * 4).tolist(), ((begins[owner] + start + length) * 4).tolist())
                values = pa.array([zlib.crc32(view[a:b]) for a, b in cuts], pa.int64())
            elif squeeze:
                cuts = zip((begins[owner] + start).tolist(), (begins[owner] + start + length).tolist())
                values = pa.array([_squeezed(ids[a:b]) for a, b in cuts], pa.binary())
            else:
                bounds = np.append(0, np.cumsum(length)).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(owner)), pa.array(number.astype(np.int32)), pa.array(start)]
                + [pa.array(length), values],
                [id_column, "piece", "start", "length", last.split()[0]],
            )

    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(id_column, F.col(text_column).cast("string"))
    return rows.mapInArrow(cut, f"{id_column} {kind}, piece int, start bigint, length bigint, {last}")


def _squeezed(ids: np.ndarray) -> bytes:
    """Bytes per id, then the first bytes of all ids, their second ones and so on, compressed."""
    ids = ids.astype("<u2" if ids.max() < 1 << 16 else "<u4")
    planes = ids.view(np.uint8).reshape(-1, ids.itemsize).T
    return bytes([ids.itemsize]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(packed: DataFrame, column: str = "ids", length_column: str = "length") -> DataFrame:
    """The rows with squeezed ids as arrays of ids; ``length_column`` has their numbers."""
    at, size = (packed.columns.index(c) for c in (column, length_column))
    fields = [T.StructField(column, T.ArrayType(T.IntegerType())) if f.name == column else f for f in packed.schema]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = []
                for value, n in zip(part.column(at).to_pylist(), part.column(size).to_pylist()):
                    planes = pa.decompress(value[1:], value[0] * n, codec="zstd", asbytes=True)
                    whole = np.frombuffer(planes, np.uint8).reshape(value[0], n).T.tobytes()
                    ids.append(np.frombuffer(whole, f"<u{value[0]}").astype(np.int32))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                columns = [values if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return packed.mapInArrow(decode, T.StructType(fields))


def encoded(
    batches: Iterator[pa.RecordBatch], tokenizer: str, separator: int
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """For some rows (id, text) at a time: the rows, all their ids, and where each one's end."""
    encoder = _ENCODERS.get(tokenizer) or Encoder(tokenizer)
    _ENCODERS[tokenizer] = encoder
    for batch in batches:
        for first in range(0, batch.num_rows, 1000):
            part = batch.slice(first, 1000)
            # One copy without gaps for null texts, whose places may hold anything.
            texts = pc.fill_null(part.column(1).cast(pa.large_binary()), b"")
            data, ends = _bytes_of(texts)
            # Rows up to some bytes at a time, long ones alone.
            begin = 0
            while begin < len(texts):
                end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + _BYTES, side="right")) - 1)
                ids, stops = encoder.flat(data[ends[begin] : ends[end]], ends[begin : end + 1] - ends[begin], separator)
                yield part.slice(begin, end - begin), ids, stops
                begin = end
    _give_back()


def _give_back() -> None:
    """What is free within this process goes back to the system: workers wait for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


# -------------------------------------------------------------------- packing


def pack(items: DataFrame, config: Packing = Packing(), length_column: str = "length") -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``, every row in one sequence.

    Lengths must lie between 1 and ``capacity``; another one, or null, stops the job.
    Rows of one sequence lie at gapless offsets from 0. Sequence ids are unique but
    not consecutive. Equal rows are packed one by one; an empty table gives an empty
    result. Columns of ``items`` that carry the names of the new ones are replaced.
    """
    items = items.drop("sequence_id", "offset")
    names = items.columns
    held = F.struct(*[F.col(f"`{n}`") for n in names]).alias("row")
    length = F.col(f"`{length_column}`").cast("bigint")
    fits = F.assert_true(length.between(1, config.capacity) & length.isNotNull(), "a length does not fit a sequence")
    numbered = store_in_batches(
        items.select(held, F.coalesce(fits.cast("bigint"), length).alias("length"))
        .withColumn("item", F.monotonically_increasing_id()),
        "items",
        BATCH_BYTES,
    )
    alone = numbered.where(F.col("length") == config.capacity)
    placed = [alone.select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    open_ = numbered.where(F.col("length") < config.capacity).select("item", "length")
    left = open_.count()
    for number in range(config.passes):
        if not left:
            break
        shards = -(-left // config.shard)
        last = number == config.passes - 1 or shards == 1
        packed = store(_evolved(open_, shards, number, config), "packed")
        done = packed if last else packed.where(F.col("filled") >= config.dissolve * config.capacity)
        placed.append(done.select("item", "sequence_id", "offset"))
        if last:
            break
        open_ = packed.where(F.col("filled") < config.dissolve * config.capacity).select("item", "length")
        left = open_.count()
    seats = placed[0]
    for more in placed[1:]:
        seats = seats.union(more)
    return numbered.join(seats, "item").select("row.*", "sequence_id", "offset")


_STATE = "shard bigint, island int, items array<bigint>, lengths array<int>, packings array<array<int>>"
_SEATS = "item bigint, length bigint, sequence_id bigint, offset bigint, filled bigint"


def _evolved(open_: DataFrame, shards: int, number: int, config: Packing) -> DataFrame:
    """The best packing of every shard, one row per item."""
    shard = F.pmod(F.xxhash64("item", F.lit(number)), F.lit(shards)).alias("shard")
    dealt = open_.select(shard, "item", F.col("length").cast("int").alias("length"))
    # A shard holds its share of hashed items, about `config.shard` however many there are.
    gathered = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("length", "item")), False).alias("of"))
    islands = F.explode(F.array(*map(F.lit, range(config.islands)))).alias("island")
    state = gathered.select(
        "shard",
        islands,
        F.col("of.item").alias("items"),
        F.col("of.length").alias("lengths"),
        F.array().cast("array<array<int>>").alias("packings"),
    )
    for epoch in range(config.epochs):
        if epoch:
            best = state.select(
                "shard",
                F.pmod(F.col("island") + 1, F.lit(config.islands)).cast("int").alias("island"),
                F.slice("packings", 1, 1).alias("guest"),
            )
            state = state.join(best, ["shard", "island"]).select(
                "shard", "island", "items", "lengths", F.concat("packings", "guest").alias("packings")
            )
        else:
            # Islands of one shard are spread, so that they run side by side.
            state = state.repartition("shard", "island")
        state = store(state.mapInArrow(_epoch(config, number, epoch), _STATE), "islands")
    best = state.groupBy("shard").agg(
        F.min_by(
            F.struct("items", "lengths", F.col("packings")[0].alias("packing")),
            F.struct(F.array_max(F.col("packings")[0]), "island"),
        ).alias("best")
    )
    return best.select("shard", "best.*").mapInArrow(_seats(number, config), _SEATS)


def _epoch(config: Packing, number: int, epoch: int):
    def evolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seed = (row["shard"], row["island"], number, epoch)
                lengths = np.array(row["lengths"], np.int64)
                packings = [np.array(p, np.int64) for p in row["packings"]]
                best = evolved(lengths, packings, config, np.random.default_rng(seed))
                yield pa.RecordBatch.from_pylist(
                    [row | {"packings": [p.tolist() for p in best]}], schema=batch.schema
                )

    return evolve


def _seats(number: int, config: Packing):
    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                bins, length = np.array(row["packing"], np.int64), np.array(row["lengths"], np.int64)
                order = np.argsort(bins, kind="stable")
                bins, length = bins[order], length[order]
                before = np.cumsum(length) - length
                filled = np.bincount(bins, length).astype(np.int64)
                first = np.searchsorted(bins, bins)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(row["items"], np.int64)[order]),
                        pa.array(length),
                        pa.array((row["shard"] * config.passes + number) * (1 << 24) + bins),
                        pa.array(before - before[first]),
                        pa.array(filled[bins]),
                    ],
                    ["item", "length", "sequence_id", "offset", "filled"],
                )

    return seat


# ------------------------------------------------------------ genetic operators


def evolved(
    lengths: np.ndarray, packings: list[np.ndarray], config: Packing, rng: np.random.Generator
) -> list[np.ndarray]:
    """A population evolved from ``packings``, best first.

    A packing gives each item the number of its bin, from 0 without gaps.
    """
    bound = -(-int(lengths.sum()) // config.capacity)
    people = list(packings)
    while len(people) < config.population:
        # Decreasing order for the first packing, a disturbed one for the others.
        noise = rng.normal(0, 0.15, len(lengths)) if people else np.zeros(len(lengths))
        order = np.argsort(-lengths * np.exp(noise), kind="stable")
        bins = np.full(len(lengths), -1, np.int64)
        people.append(_best_fit(bins, order, lengths, config.capacity))
    scored = sorted(((_unfitness(p, lengths, config.capacity), i, p) for i, p in enumerate(people)), key=_rank)
    for child in range(config.generations * config.population):
        if scored[0][0][0] <= bound:
            break
        one, two = (scored[min(rng.integers(len(scored), size=2))][2] for _ in range(2))
        born = _crossed(one, two, lengths, config.capacity, rng)
        born = _mutated(born, lengths, config.capacity, rng)
        scored.append((_unfitness(born, lengths, config.capacity), len(people) + child, born))
        scored = sorted(scored, key=_rank)[: config.population]
    return [p for _, _, p in scored[: config.population]]


def _rank(scored: tuple) -> tuple:
    return scored[0], scored[1]


def _unfitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Bins needed, then how evenly they are filled: uneven packings are easier to improve."""
    filled = np.bincount(bins, lengths) / capacity
    return len(filled), -float((filled**2).sum())


def _crossed(one, two, lengths, capacity, rng) -> np.ndarray:
    """Well-filled bins of ``one`` injected into ``two``."""
    filled = np.bincount(one, lengths)
    well = np.flatnonzero(filled >= np.quantile(filled, 0.5))
    chosen = np.zeros(len(filled), bool)
    chosen[well[rng.random(len(well)) < 0.5]] = True
    injected = chosen[one]
    hit = np.zeros(two.max() + 1, bool)
    hit[two[injected]] = True
    child = np.where(injected, one + len(hit), np.where(hit[two], -1, two))
    return _refilled(child, lengths, capacity)


def _mutated(bins, lengths, capacity, rng) -> np.ndarray:
    """The emptiest bins and a few others are dissolved."""
    filled = np.bincount(bins, lengths)
    few = max(2, len(filled) // 50)
    gone = np.zeros(len(filled), bool)
    gone[np.argsort(filled, kind="stable")[:few]] = True
    gone[rng.integers(len(filled), size=few)] = True
    return _refilled(np.where(gone[bins], -1, bins), lengths, capacity)


def _refilled(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bins numbered anew, items without one put back by best fit decreasing."""
    out = np.flatnonzero(bins < 0)
    kept, numbers = np.unique(bins[bins >= 0], return_inverse=True)
    bins = bins.copy()
    bins[bins >= 0] = numbers
    return _best_fit(bins, out[np.argsort(-lengths[out], kind="stable")], lengths, capacity)


def _best_fit(bins: np.ndarray, order: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Each item of ``order`` into the fullest bin that has room, or a new one.

    ``rooms`` has a bit for every amount of room that some bin has, ``by_room`` the
    bins with it, so the tightest room is the lowest bit from the item's length on.
    """
    seated = bins >= 0
    filled = np.bincount(bins[seated], lengths[seated]).astype(np.int64).tolist() if seated.any() else []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for number, used in enumerate(filled):
        by_room[capacity - used].append(number)
        rooms |= 1 << (capacity - used)
    count = len(filled)
    for item, length in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, number = capacity, count
            count += 1
        room -= length
        by_room[room].append(number)
        rooms |= 1 << room
        bins[item] = number
    return bins
