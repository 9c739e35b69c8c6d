"""``.npy`` files, one ``[turns, dim]`` matrix per dialogue, as a data source.

Reading, the driver lists files and their sizes only. A large file is divided among
tasks, which read its header and their share of its rows; small files share a task.

Writing, a task writes whole parts of dialogues under names of its own attempt, and the
commit moves what the successful attempts wrote to its place. A failed or repeated
attempt leaves nothing behind that a reader would see. A dialogue of more turns than a
part holds continues in files whose names end with the number of their first turn, and is
one dialogue again when it is read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import translate
from urllib.parse import quote
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from seamline.operators.prefix import chunk_of
from seamline.operators.scoring import BAD_VECTOR, NOT_DENSE
from seamline.operators.topics import PART_TURNS

#: Bytes of a matrix read by one call.
RANGE_BYTES = 16 << 20

#: Bytes of matrices read by one task.
TASK_BYTES = 128 << 20

#: Name of the data source.
FORMAT = "npy"

TURNS = "conv_id string, turn bigint, embedding array<double>"

#: What the name of a later part of a dialogue ends with: the number of its first turn.
_PART = re.compile(r"\.(\d{12})\.npy$")

#: Where attempts write until they are committed.
_ATTEMPTS = "_temporary"


def turns_from_matrices(
    spark: SparkSession, paths: str | list[str], range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """``(conv_id, turn, embedding)`` of matrix files; ``conv_id`` is the path.

    ``paths`` are files, folders or patterns. A matrix of more than ``range_bytes`` is
    read in shares of that size, by several tasks. Pickled files are refused.
    """
    spark.dataSource.register(MatrixFiles)
    names = [paths] if isinstance(paths, str) else list(paths)
    for name in names:
        scheme = re.match("([a-z0-9+.-]+):", name)
        if scheme and _SCHEMES.get(scheme[1], scheme[1]) not in _READABLE:
            raise ValueError(f"matrices cannot be read from {scheme[1]}: paths")
    return spark.read.format(FORMAT).option("paths", json.dumps(names)).option("rangeBytes", range_bytes).load()


def write_matrices(
    turns: DataFrame, path: str, *, part_turns: int = PART_TURNS, dtype: str = "float64", mode: str = "append"
) -> None:
    """Write ``(conv_id, turn, embedding)`` as matrix files named by ``conv_id``.

    ``turn`` must number each dialogue 0..n-1. A task holds at most ``part_turns`` vectors.
    ``mode`` is ``append`` or ``overwrite``; a file of the same name is replaced either way.
    """
    turns.sparkSession.dataSource.register(MatrixFiles)
    part = chunk_of(F.col("turn"), part_turns)
    rows = turns.select(
        F.col("conv_id").cast("string").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    placed = rows.repartition("conv_id", part).sortWithinPartitions("conv_id", "turn")
    writer = placed.write.format(FORMAT).mode(mode).option("partTurns", part_turns).option("dtype", dtype)
    writer.save(path)


class MatrixFiles(DataSource):
    """Options: ``path`` or ``paths`` (a JSON list), ``rangeBytes``, ``partTurns``, ``dtype``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return TURNS

    def reader(self, schema: StructType) -> DataSourceReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return _Reader(paths, int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(
            self.options["path"],
            int(self.options.get("partTurns", PART_TURNS)),
            np.dtype(self.options.get("dtype", "float64")),
            overwrite,
        )


#: Schemes of Hadoop that name a file system Arrow knows by another one.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss", "": "file"}
_READABLE = {"file", "s3", "gs", "gcs", "hdfs", "viewfs", "abfs", "abfss"}



def _filesystem(path: str):
    """The file system of a path, the path in it, and what to put before such a path."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/"), "file:"
    system, inner = fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")
    return system, inner, path[: path.rindex(inner)] if inner in path else f"{scheme}://"


def _open(path: str):
    system, inner, _ = _filesystem(path)
    return system.open_input_file(inner)


def _listed(path: str) -> list[tuple[str, int]]:
    """The matrix files a path, folder or pattern stands for, and their sizes."""
    from pyarrow import fs

    system, inner, before = _filesystem(path)
    magic = re.search(r"[*?\[]", inner)
    if magic:
        folder = inner[: magic.start()].rpartition("/")[0]
        deep = "/" in inner[magic.start() :]
        # A star stays within one name.
        wanted = re.compile("/".join(translate(p)[4:-3] if p else p for p in inner.split("/")) + r"\Z", re.S)
        found = system.get_file_info(fs.FileSelector(folder or "/", recursive=deep))
        found = [f for f in found if wanted.match(f.path) and f.path.count("/") == inner.count("/")]
    else:
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner))
        found = [f for f in found if info.is_file or f.path.endswith(".npy")]
    return sorted((before + f.path, f.size) for f in found if f.is_file)


# ----------------------------------------------------------------------- read


@dataclass
class _Share(InputPartition):
    """Files, each with the number of the share to read and how many shares it has."""

    items: list[tuple[str, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, paths: Sequence[str], range_bytes: int) -> None:
        self.paths, self.range_bytes = paths, range_bytes

    def partitions(self) -> Sequence[InputPartition]:
        shares, room = [_Share([])], TASK_BYTES
        for path, size in (f for p in self.paths for f in _listed(p)):
            count = max(1, -(-size // self.range_bytes))
            for number in range(count):
                if shares[-1].items and room < size // count:
                    shares.append(_Share([]))
                    room = TASK_BYTES
                shares[-1].items.append((path, number, count))
                room -= size // count
        return shares

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        for path, number, count in partition.items:
            with _open(path) as file:
                (turns, _), _, _, _ = _header(file)
            start, stop = turns * number // count, turns * (number + 1) // count
            if stop == start:
                continue
            rows = _read_rows(path, start, stop)
            part = _PART.search(path)
            first = start + (int(part[1]) if part else 0)
            name = path[: part.start()] + ".npy" if part else path
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(rows), pa.string()),
                    pa.array(np.arange(first, first + len(rows), dtype=np.int64)),
                    pa.ListArray.from_arrays(ends, pa.array(rows.ravel())),
                ],
                names=["conv_id", "turn", "embedding"],
            )


def _header(file) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    version = np.lib.format.read_magic(file)
    read = {
        (1, 0): np.lib.format.read_array_header_1_0,
        (2, 0): np.lib.format.read_array_header_2_0,
    }.get(version)
    if read is None:
        raise ValueError(f"unsupported matrix file version {version}")
    shape, by_column, dtype = read(file)
    if dtype.hasobject:
        raise ValueError("a matrix file must not hold objects")
    if len(shape) != 2 or shape[1] < 1:
        raise ValueError("a matrix file must have the shape [turns, dim]")
    return shape, by_column, dtype, file.tell()


def _read_rows(path: str, start: int, stop: int) -> np.ndarray:
    with _open(path) as file:
        (turns, dim), by_column, dtype, data = _header(file)
        width = dtype.itemsize
        if not by_column:
            file.seek(data + start * dim * width)
            raw = file.read((stop - start) * dim * width)
            rows = np.frombuffer(raw, dtype).reshape(stop - start, dim)
        else:
            rows = np.empty((stop - start, dim), dtype)
            for column in range(dim):
                file.seek(data + (column * turns + start) * width)
                rows[:, column] = np.frombuffer(file.read((stop - start) * width), dtype)
    return np.ascontiguousarray(rows, dtype=np.float64)


# ---------------------------------------------------------------------- write


@dataclass
class _Written(WriterCommitMessage):
    """The folder of an attempt and the files in it."""

    folder: str
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, part_turns: int, dtype: np.dtype, overwrite: bool) -> None:
        self.path, self.part_turns, self.dtype, self.overwrite = path.rstrip("/"), part_turns, dtype, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, root, _ = _filesystem(self.path)
        done = _Written(f"{root}/{_ATTEMPTS}/{uuid4().hex}", [])
        system.create_dir(done.folder, recursive=True)
        for conv, first, rows in self._parts(iterator):
            done.names.append(f"{quote(conv, safe='')}{f'.{first:012d}' if first else ''}.npy")
            with system.open_output_stream(f"{done.folder}/{done.names[-1]}") as out:
                np.lib.format.write_array(out, rows.astype(self.dtype), allow_pickle=False)
        return done

    def _parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
        """The rows of each part; they come one after another."""
        conv, first, rows, count = None, 0, [], 0
        for batch in batches:
            for start, stop, name, turn in self._runs(batch):
                if name != conv or turn != first + count or turn % self.part_turns == 0:
                    if rows:
                        yield conv, first, np.concatenate(rows)
                    if turn % self.part_turns:
                        raise ValueError(NOT_DENSE)
                    conv, first, rows, count = name, turn, [], 0
                vectors = batch.column("embedding").slice(start, stop - start)
                widths = vectors.value_lengths().unique().to_pylist()
                if vectors.null_count or len(widths) != 1 or not widths[0] or (rows and rows[0].shape[1] != widths[0]):
                    raise ValueError(BAD_VECTOR)
                flat = vectors.flatten()
                if flat.null_count:
                    raise ValueError(BAD_VECTOR)
                rows.append(flat.to_numpy(zero_copy_only=False).reshape(-1, widths[0]))
                count += stop - start
        if rows:
            yield conv, first, np.concatenate(rows)

    def _runs(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, str, int]]:
        """Stretches of a batch that go on within one part."""
        if not batch.num_rows:
            return
        codes = batch.column("conv_id").dictionary_encode().indices.to_numpy()
        turn = batch.column("turn").to_numpy()
        breaks = (np.diff(codes) != 0) | (np.diff(turn) != 1) | (turn[1:] % self.part_turns == 0)
        cuts = [0, *(np.flatnonzero(breaks) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            yield start, stop, batch.column("conv_id")[start].as_py(), int(turn[start])

    def commit(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        system, root, _ = _filesystem(self.path)
        written = [m for m in messages if m is not None]
        if self.overwrite:
            new = {name for m in written for name in m.names}
            for old in system.get_file_info(fs.FileSelector(root)):
                if old.is_file and old.path.endswith(".npy") and old.base_name not in new:
                    system.delete_file(old.path)
        for message in written:
            for name in message.names:
                system.move(f"{message.folder}/{name}", f"{root}/{name}")
        self._discard(system, root)

    def abort(self, messages: list[_Written | None]) -> None:
        system, root, _ = _filesystem(self.path)
        self._discard(system, root)

    def _discard(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/{_ATTEMPTS}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{_ATTEMPTS}")
