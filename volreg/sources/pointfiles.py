"""Point files (uncompressed LAS, NPY) as a data source: ``spark.read.format("point_files")``.

Reading. A file is cut into pieces of about ``bytesPerPartition`` (default 64 MB); a piece
reads its points by their numbers, a batch at a time, so a file's size bounds nothing. The
fields read are those of the schema: ask for fewer by ``.schema("x double, z double")``.
Files whose header's box cannot meet the query's filters on x, y and z, or the options
``x0 x1 y0 y1 z0 z1``, are not read further. ``pid`` is the file's place among all files by
name, times 2^40, plus the point's number: it does not depend on pieces.

Writing. Each task writes LAS 1.4 files of point format 6, of ``pointsPerFile`` points
(default 4,000,000) at most, into a folder of its own run; the commit moves them to their
place, an abort deletes them. Coordinates are kept to ``scale`` (default 0.001).

Paths are those that Arrow's file systems know (local and shared folders, hdfs, s3, gs).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "pid long, x double, y double, z double, classification smallint, intensity int, return_number smallint"
BATCH = 1 << 16
_AXES = "xyz"

# Places of fields in a LAS header, and in points of format 0 to 5 and from 6 on.
_SIGNATURE, _HEADER, _LEGACY_HEADER = b"LASF", 375, 227


@dataclass
class _Header:
    """Where a file's points lie, and how a point is read."""

    n: int
    at: int
    size: int
    form: int
    scale: np.ndarray
    offset: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, head: bytes, name: str) -> _Header:
        if head[:4] != _SIGNATURE or len(head) < _LEGACY_HEADER:
            raise ValueError(f"{name} is not a LAS file")
        form = head[104]
        if form & 0xC0:
            raise ValueError(f"{name} is compressed; only plain LAS can be read")
        (at,), (size, n) = struct.unpack_from("<I", head, 96), struct.unpack_from("<HI", head, 105)
        if not n and head[25] >= 4:
            (n,) = struct.unpack_from("<Q", head, 247)
        numbers = np.frombuffer(head, "<f8", 12, 131)
        return cls(n, at, size, form, numbers[:3], numbers[3:6], numbers[7:12:2], numbers[6:12:2])

    def fields(self, raw: np.ndarray, names: list[str]) -> dict[str, np.ndarray]:
        new = self.form >= 6
        out = {}
        for name in names:
            if name in _AXES:
                i = _AXES.index(name)
                out[name] = np.ascontiguousarray(raw[:, 4 * i : 4 * i + 4]).view("<i4")[:, 0] * self.scale[i] + self.offset[i]
            elif name == "classification":
                out[name] = raw[:, 16].astype(np.int16) if new else (raw[:, 15] & 31).astype(np.int16)
            elif name == "intensity":
                out[name] = np.ascontiguousarray(raw[:, 12:14]).view("<u2")[:, 0].astype(np.int32)
            elif name == "return_number":
                out[name] = (raw[:, 14] & (15 if new else 7)).astype(np.int16)
        return out


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Piece(InputPartition):
    path: str
    number: int
    piece: int
    pieces: int


class PointReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        known = dict(x.split() for x in SCHEMA.replace("long", "bigint").split(", "))
        wrong = [f for f in self.fields if known.get(f[0]) != f[1]]
        if wrong:
            raise ValueError(f"points have no such fields: {wrong}; they have {SCHEMA}")
        self.path, self.bytes = options["path"], int(options.get("bytespartition", options.get("bytesPerPartition", 64 << 20)))
        self.low, self.high = (np.array([float(options.get(f"{a}{i}", v)) for a in _AXES]) for i, v in ((0, -np.inf), (1, np.inf)))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in [*_AXES]:
                i = _AXES.index(f.attribute[0])
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low[i] = max(self.low[i], f.value)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high[i] = min(self.high[i], f.value)
            yield f  # files are left out, points are still judged by Spark

    def partitions(self) -> list[Piece]:
        """Pieces from the list of files alone; no file is opened here."""
        found, path = opened(self.path)
        info = found.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else [x for x in found.get_file_info(fs.FileSelector(path, recursive=True)) if x.type == fs.FileType.File]
        files = sorted((x for x in files if not any(p[:1] in "._" for p in x.path[len(path) :].split("/") if p)), key=lambda x: x.path)
        pieces = [max(1, -(-x.size // self.bytes)) for x in files]
        return [Piece(x.path, number, i, n) for number, (x, n) in enumerate(zip(files, pieces, strict=True)) for i in range(n)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        names = [n for n, _ in self.fields]
        with opened(self.path)[0].open_input_file(partition.path) as f:
            source = _npy if partition.path.endswith(".npy") else self._las
            for start, columns, n in source(f, partition, names):
                whole = columns | {"pid": (np.int64(partition.number) << 40) + start + np.arange(n)}
                kinds = {"bigint": pa.int64(), "double": pa.float64(), "smallint": pa.int16(), "int": pa.int32()}
                yield pa.RecordBatch.from_arrays([pa.array(whole[c], kinds[k]) if c in whole else pa.nulls(n, kinds[k]) for c, k in self.fields], names=names)

    def _las(self, f, partition: Piece, names: list[str]) -> Iterator[tuple[int, dict, int]]:
        head = _Header.of(f.read_at(_HEADER, 0), partition.path)
        slack = np.abs(head.scale)  # boxes are rounded by some writers
        if not head.n or (head.high + slack < self.low).any() or (head.low - slack > self.high).any():
            return
        for start, n in _batches(head.n, partition):
            raw = np.frombuffer(f.read_at(n * head.size, head.at + start * head.size), np.uint8).reshape(n, head.size)
            yield start, head.fields(raw, names), n


def _batches(n: int, partition: Piece) -> Iterator[tuple[int, int]]:
    """Numbers of the first points and counts of a piece's batches."""
    first, last = n * partition.piece // partition.pieces, n * (partition.piece + 1) // partition.pieces
    for start in range(first, last, BATCH):
        yield start, min(BATCH, last - start)


def _npy(f, partition: Piece, names: list[str]) -> Iterator[tuple[int, dict, int]]:
    """Columns x, y, z, the class if there is a fourth."""
    version = np.lib.format.read_magic(f)
    shape, by_columns, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if kind.hasobject or len(shape) != 2 or shape[1] < 3:
        raise ValueError(f"{partition.path} is not a table of points")
    at, width, size = f.tell(), shape[1], kind.itemsize
    columns = [c for c in names if c in _AXES or (c == "classification" and width > 3)]
    place = {c: "xyz".find(c) if c in _AXES else 3 for c in columns}
    for start, n in _batches(shape[0], partition):
        if by_columns:
            read = {c: np.frombuffer(f.read_at(n * size, at + (i * shape[0] + start) * size), kind) for c, i in place.items()}
        else:
            rows = np.frombuffer(f.read_at(n * width * size, at + start * width * size), kind).reshape(n, width)
            read = {c: rows[:, i] for c, i in place.items()}
        yield start, {c: v.astype(np.int16 if c == "classification" else float) for c, v in read.items()}, n


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    points: int


class PointWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.scale, self.most = float(options.get("scale", 0.001)), int(options.get("pointsperfile", options.get("pointsPerFile", 4_000_000)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        files, folder = opened(self.path)
        files.create_dir(f"{folder}/_{self.run}")
        context, names, total = TaskContext.get(), [], 0

        def flush(batches: list[pa.RecordBatch]) -> None:
            name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(names):03d}.las"
            with files.open_output_stream(f"{folder}/_{self.run}/{name}") as out:
                for piece in encoded(pa.Table.from_batches(batches), self.scale):
                    out.write(piece)
            names.append(name)

        waiting, n = [], 0
        for batch in iterator:
            while n + batch.num_rows >= self.most:
                flush([*waiting, batch.slice(0, self.most - n)])
                batch, waiting, n, total = batch.slice(self.most - n), [], 0, total + self.most
            waiting, n = [*waiting, batch], n + batch.num_rows
        if n:
            flush(waiting)
        return Written(names, total + n)

    def commit(self, messages: list[Written]) -> None:
        files, folder = opened(self.path)
        names = [x for m in messages if m for x in m.files]
        if self.overwrite:
            for x in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if x.type == fs.FileType.File and x.base_name.startswith("part-"):
                    files.delete_file(x.path)
        for name in names:
            files.move(f"{folder}/_{self.run}/{name}", f"{folder}/{self.run[:8]}-{name}" if not self.overwrite else f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written]) -> None:
        files, folder = opened(self.path)
        if files.get_file_info(f"{folder}/_{self.run}").type == fs.FileType.Directory:
            files.delete_dir(f"{folder}/_{self.run}")


def encoded(points: pa.Table, scale: float) -> Iterator[bytes]:
    """A LAS 1.4 file of point format 6 in pieces: its header, then its points."""
    n = points.num_rows
    xyz = [points.column(a).to_numpy() for a in _AXES]
    low, high = (np.array([f(a) for a in xyz]) for f in (np.min, np.max))
    offset = np.floor(low)
    if (np.rint((high - offset) / scale) >= 2**31).any():
        raise ValueError("points lie too far apart for this scale")
    other = lambda c, default: np.nan_to_num(points.column(c).to_pandas().to_numpy(float), nan=default) if c in points.column_names else np.full(n, float(default))
    returns = np.clip(other("return_number", 1), 0, 15).astype(np.uint8)
    head = bytearray(_HEADER)
    head[:4], head[24:26], head[104] = _SIGNATURE, bytes([1, 4]), 6
    struct.pack_into("<HII", head, 94, _HEADER, _HEADER, 0)
    struct.pack_into("<H", head, 105, 30)
    numbers = [*[scale] * 3, *offset, *(v for pair in zip(high, low, strict=True) for v in pair)]
    struct.pack_into("<12d", head, 131, *numbers)
    struct.pack_into("<Q", head, 247, n)
    struct.pack_into("<15Q", head, 255, *np.bincount(np.maximum(returns, 1), minlength=16)[1:16].tolist())
    yield bytes(head)
    kind, intensity = np.clip(other("classification", 1), 0, 255), np.clip(other("intensity", 0), 0, 65535)
    for i in range(0, n, BATCH):
        some = slice(i, min(n, i + BATCH))
        out = np.zeros(some.stop - i, dtype=[("xyz", "<i4", 3), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("kind", "u1"), ("rest", "u1", 13)])
        for j, a in enumerate(xyz):
            out["xyz"][:, j] = np.rint((a[some] - offset[j]) / scale)
        out["intensity"], out["kind"] = intensity[some], kind[some]
        out["returns"] = returns[some] | (np.maximum(returns[some], 1) << 4)
        yield out.tobytes()


class PointFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "point_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PointReader:
        return PointReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> PointWriter:
        if not {*_AXES} <= {*schema.names}:
            raise ValueError("points need x, y and z")
        return PointWriter(self.options, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """Make the source known to a session, and to its workers."""
    from ..shared import on_workers

    on_workers(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a source that takes filters needs it
    spark.dataSource.register(PointFiles)
    return spark


def read(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    reader = registered(spark).read.format("point_files").options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(points: DataFrame, path: str, mode: str = "append", **options) -> None:
    registered(points.sparkSession)
    points.write.format("point_files").mode(mode).options(**options).save(path)
