"""Binary record files as Spark data sources: read by many tasks at once, written in parts that a commit joins.

Once ``register`` has run, ``spark.read.format(name).load(path)`` and ``df.write.format(name).save(path)`` know

    ply            vertices or faces of a PLY file (option ``element``), one column for each property
    sparse_points  points of a reconstruction with their tracks
    dense_array    (row, col, channel, value) of a "w&h&c&" array
    cameras        intrinsics of a reconstruction
    images         extrinsics of a reconstruction with their points

Reading: files of records of one size are cut at known offsets. Where records vary in size, one pass over the records' heads notes where
every ``rows_per_task``-th one begins. Every task opens the file itself and reads its own bytes, a block at a time.

Writing: each task writes the bytes of its rows to a part of its own beside the target. The commit knows the number of
rows, writes the head and appends the parts in the order of the partitions, block by block: no row comes to the driver, and parts of lost or repeated
tasks are never joined. An order asked for (``orderBy``) is the file's.

Paths are those of ``pyarrow.fs``: plain ones and ``file://``, and the stores that it knows.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructField, StructType

from geofold.sources.binary import CAMERA_MODELS, PLY_TYPES

#: Bytes that are read or copied at once, and bytes and records of a task.
BLOCK, TASK_BYTES, TASK_ROWS = 4 << 20, 32 << 20, 200_000


def store(path: str):
    """(file system, path in it) of a path or address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.FileSystem.from_uri(path) if path.startswith("file:/") else (fs.LocalFileSystem(), path))


def files(path: str) -> list[str]:
    """The file itself, or the files of a folder in the order of their names; addresses stay addresses."""
    from pyarrow import fs

    own, at = store(path)
    info = own.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    inside = own.get_file_info(fs.FileSelector(at))
    return [f"{path.rstrip('/')}/{f.base_name}" for f in sorted(inside, key=lambda f: f.base_name) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]


@dataclass
class Piece(InputPartition):
    """Records from one on, and where in a file their bytes begin and end."""

    path: str
    first: int
    rows: int
    start: int
    stop: int


def _cut(path: str, rows: int, start: int, size: int, task_bytes: int) -> list[Piece]:
    """Pieces of records of one size."""
    each = max(1, task_bytes // max(size, 1))
    return [Piece(path, a, min(each, rows - a), start + a * size, start + min(a + each, rows) * size) for a in range(0, rows, each)]


def _blocks(piece: Piece, size: int) -> Iterator[tuple[int, bytes]]:
    """(number of the first record, bytes of whole records) of a piece of records of one size."""
    own, at = store(piece.path)
    step = max(1, BLOCK // size)
    with own.open_input_file(at) as f:
        for a in range(0, piece.rows, step):
            n = min(step, piece.rows - a)
            yield piece.first + a, f.read_at(n * size, piece.start + a * size)


class _Source(DataSource):
    """Options: path; bytes_per_task, rows_per_task: how much a task reads."""

    columns = ""

    @property
    def path(self) -> str:
        return self.options["path"]

    def schema(self):
        return self.columns

    def size_of_tasks(self) -> tuple[int, int]:
        return int(self.options.get("bytes_per_task", TASK_BYTES)), int(self.options.get("rows_per_task", TASK_ROWS))


# ---- PLY


@dataclass
class Element:
    """An element of a PLY file: its rows, the numpy type of a row and where the first row is. ``lists``: properties that are lists, of three items each."""

    rows: int
    kind: np.dtype
    start: int
    lists: tuple[str, ...]


def ply_elements(path: str) -> dict[str, Element]:
    """Elements by the file's head. Lists have a length each, but only those of triangles have rows of one size; the reader checks it."""
    own, at = store(path)
    with own.open_input_file(at) as f:
        head = b""
        while b"end_header\n" not in head:
            more = f.read(4096)
            if not more or len(head) > 1 << 20:
                raise ValueError(f"{path} has no PLY head")
            head += more
    start = head.index(b"end_header\n") + 11
    order, found = "<", {}
    for words in (line.split() for line in head[:start].decode("ascii").splitlines()):
        if words[:1] == ["format"]:
            if words[1] == "ascii":
                raise ValueError("only binary PLY files are read")
            order = ">" if "big" in words[1] else "<"
        elif words[:1] == ["element"]:
            found[words[1]] = (int(words[2]), [], [])
        elif words[:2] == ["property", "list"]:
            rows, fields, lists = found[list(found)[-1]]
            fields += [(f"{words[4]}__n", order + PLY_TYPES[words[2]]), (words[4], order + PLY_TYPES[words[3]], (3,))]
            lists.append(words[4])
        elif words[:1] == ["property"]:
            found[list(found)[-1]][1].append((words[2], order + PLY_TYPES[words[1]]))
    out = {}
    for name, (rows, fields, lists) in found.items():
        kind = np.dtype(fields)
        out[name] = Element(rows, kind, start, tuple(lists))
        start += rows * kind.itemsize
    return out


def _spark_type(kind: np.dtype) -> DataType:
    return DoubleType() if kind.kind == "f" else LongType()


class PlySource(_Source):
    """``n`` (the row's number in its file) and the properties: numbers as double or long, lists as arrays of three."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    @property
    def element(self) -> str:
        return self.options.get("element", "vertex")

    def schema(self):
        e = ply_elements(files(self.path)[0])[self.element]
        fields = [StructField(f, ArrayType(LongType()) if f in e.lists else _spark_type(e.kind[f])) for f in e.kind.names if not f.endswith("__n")]
        return StructType([StructField("n", LongType()), *fields])

    def reader(self, schema):
        return PlyReader(self.path, self.element, schema, self.size_of_tasks()[0])

    def writer(self, schema, overwrite):
        types = dict(x.split(":") for x in self.options.get("types", "").split(",") if x)
        return PlyWriter(self.path, overwrite, self.element, schema, types)


class PlyReader(DataSourceReader):
    def __init__(self, path: str, element: str, schema: StructType, task_bytes: int):
        self.path, self.element, self.names, self.task_bytes = path, element, schema.names, task_bytes

    def partitions(self):
        out = []
        for path in files(self.path):
            e = ply_elements(path)[self.element]
            out += _cut(path, e.rows, e.start, e.kind.itemsize, self.task_bytes)
        return out

    def read(self, partition):
        if partition is None:  # no rows at all
            return
        e = ply_elements(partition.path)[self.element]
        for first, data in _blocks(partition, e.kind.itemsize):
            rows = np.frombuffer(data, e.kind)
            if any((rows[f"{x}__n"] != 3).any() for x in e.lists):
                raise ValueError(f"{partition.path}: a face is not a triangle")
            yield pa.RecordBatch.from_arrays([self._column(rows, name, first, e) for name in self.names], self.names)

    def _column(self, rows: np.ndarray, name: str, first: int, e: Element) -> pa.Array:
        if name == "n":
            return pa.array(np.arange(first, first + len(rows)))
        if name in e.lists:
            return pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(rows) + 1, 3, dtype=np.int32)), pa.array(rows[name].astype(np.int64).ravel()))
        return pa.array(rows[name].astype(float if e.kind[name].kind == "f" else np.int64))


# ---- writing in parts


@dataclass
class Part(WriterCommitMessage):
    place: int
    path: str
    rows: int


class PartWriter(DataSourceArrowWriter):
    """Writes parts and joins them behind a head. Subclasses: ``encoded`` rows of a batch, and the ``head`` for a number of rows."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.parts = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}"
        own, at = store(path)
        if not overwrite and own.get_file_info(at).type.value:
            raise FileExistsError(path)
        store(self.parts)[0].create_dir(store(self.parts)[1], recursive=True)  # here, so that no late task makes it again

    def encoded(self, batch: pa.RecordBatch) -> bytes:
        raise NotImplementedError

    def head(self, rows: int) -> bytes:
        raise NotImplementedError

    def write(self, iterator):
        own, at = store(self.parts)
        place = TaskContext.get().partitionId()
        path, rows = f"{at}/{place}-{uuid.uuid4().hex}", 0
        with own.open_output_stream(path) as f:
            for batch in iterator:
                f.write(self.encoded(batch))
                rows += batch.num_rows
        return Part(place, path, rows)

    def commit(self, messages):
        own, at = store(self.path)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.place)
        with own.open_output_stream(at) as out:
            out.write(self.head(sum(m.rows for m in done)))
            for m in done:
                with own.open_input_stream(m.path) as f:
                    while block := f.read(BLOCK):
                        out.write(block)
        self.abort(messages)

    def abort(self, messages):
        """Parts go, joined or not."""
        from pyarrow import fs

        own, at = store(self.parts)
        if own.get_file_info(at).type != fs.FileType.NotFound:
            own.delete_dir(at)


#: PLY types of columns, where none is named.
WRITTEN = {DoubleType: "double", FloatType: "float", LongType: "int", IntegerType: "int", ShortType: "short", ByteType: "char"}


class PlyWriter(PartWriter):
    """Columns in order are the properties; arrays are lists of three. Types by column, or as the option ``types`` says ("red:uchar,x:float")."""

    def __init__(self, path: str, overwrite: bool, element: str, schema: StructType, types: dict[str, str]):
        self.element, fields, self.lines = element, [], []
        for f in schema.fields:
            wide = isinstance(f.dataType, ArrayType)
            kind = types.get(f.name) or WRITTEN.get(type(f.dataType.elementType if wide else f.dataType))
            if kind not in PLY_TYPES:
                raise ValueError(f"column {f.name} has no PLY type")
            fields += [(f"{f.name}__n", "u1"), (f.name, "<" + PLY_TYPES[kind], (3,))] if wide else [(f.name, "<" + PLY_TYPES[kind])]
            self.lines.append(f"property list uchar {kind} {f.name}" if wide else f"property {kind} {f.name}")
        self.kind = np.dtype(fields)
        super().__init__(path, overwrite)

    def head(self, rows: int) -> bytes:
        return "\n".join(["ply", "format binary_little_endian 1.0", f"element {self.element} {rows}", *self.lines, "end_header", ""]).encode()

    def encoded(self, batch: pa.RecordBatch) -> bytes:
        out = np.zeros(batch.num_rows, self.kind)
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            if column.null_count:
                raise ValueError(f"column {name} has nulls")
            if f"{name}__n" in self.kind.names:
                if (np.diff(column.offsets.to_numpy()) != 3).any():
                    raise ValueError(f"a list of {name} hasn't three items")
                own = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
                out[f"{name}__n"] = 3
            else:
                own = column.to_numpy(zero_copy_only=False)
            kind = self.kind[name].base
            if kind.kind in "iu" and len(own) and not (np.iinfo(kind).min <= own.min() and own.max() <= np.iinfo(kind).max):
                raise ValueError(f"a number of {name} doesn't fit {kind}")
            out[name] = own
        return out.tobytes()


def join_ply(path: str, parts: list[str]) -> None:
    """One PLY file of the elements of others, in their order; little-endian ones. Bodies are copied block by block."""
    own, at = store(path)
    heads, bodies = [], []
    for part in parts:
        elements = ply_elements(part)
        start = min(e.start for e in elements.values())
        where, inside = store(part)
        with where.open_input_file(inside) as f:
            heads += f.read(start).decode("ascii").splitlines()[2:-1]
        bodies.append((where, inside, start))
    with own.open_output_stream(at) as out:
        out.write("\n".join(["ply", "format binary_little_endian 1.0", *heads, "end_header", ""]).encode())
        for where, inside, start in bodies:
            with where.open_input_file(inside) as f:
                f.seek(start)
                while block := f.read(BLOCK):
                    out.write(block)


# ---- sparse points

#: The head of a point's record, whose last number is that of the pairs which follow.
POINT = np.dtype([("point_id", "<u8"), ("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("error", "<f8"), ("n", "<u8")])
PAIR = 8


def _point_end(data: bytes, at: int) -> int | None:
    """Where the record that begins at ``at`` ends; None if its head isn't whole."""
    end = at + POINT.itemsize
    return end + PAIR * struct.unpack_from("<Q", data, end - 8)[0] if end <= len(data) else None


def _starts(data: bytes, most: int, end_of) -> tuple[list[int], int]:
    """(places of whole records, at most so many; the place after them)."""
    out, at = [], 0
    while len(out) < most:
        end = end_of(data, at)
        if end is None or end > len(data):
            break
        out.append(at)
        at = end
    return out, at


def _records(f, start: int, rows: int, end_of) -> Iterator[tuple[bytes, list[int], int]]:
    """(bytes, places of records in them, where the bytes stand in the file), block by block; a record longer than a block is read whole."""
    at, block = start, BLOCK
    while rows:
        data = f.read_at(block, at)
        places, used = _starts(data, rows, end_of)
        if not places:
            if len(data) < block:
                raise ValueError("the file ends within a record")
            block *= 2
            continue
        yield data, places, at
        rows, at, block = rows - len(places), at + used, BLOCK


class VaryingReader(DataSourceReader):
    """Records that vary in size. Subclasses: where a record ends (``end_of``), and the rows of the records at some places of a block (``decoded``)."""

    end_of = staticmethod(_point_end)

    def __init__(self, path: str, task_rows: int):
        self.path, self.task_rows = path, task_rows

    def decoded(self, data: bytes, places: list[int]) -> pa.RecordBatch:
        raise NotImplementedError

    def partitions(self):
        out = []
        for path in files(self.path):
            own, at = store(path)
            with own.open_input_file(at) as f:
                (rows,) = struct.unpack("<Q", f.read_at(8, 0))
                starts, seen = [], 0
                for _, places, base in _records(f, 8, rows, self.end_of):
                    starts += [base + places[k] for k in range(-seen % self.task_rows, len(places), self.task_rows)]
                    seen += len(places)
            out += [Piece(path, i * self.task_rows, min(self.task_rows, rows - i * self.task_rows), a, 0) for i, a in enumerate(starts)]
        return out

    def read(self, partition):
        if partition is None:
            return
        own, at = store(partition.path)
        with own.open_input_file(at) as f:
            for data, places, _ in _records(f, partition.start, partition.rows, self.end_of):
                yield self.decoded(data, places)


def _gathered(raw: np.ndarray, starts: np.ndarray, counts: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, pa.Array]:
    """(items of all lists, offsets of the lists): lists of so many items begin at some bytes."""
    size, ends = kind.itemsize, np.r_[0, np.cumsum(counts)]
    byte = np.repeat(starts, counts * size) + np.arange(ends[-1] * size) - np.repeat(ends[:-1] * size, counts * size)
    return raw[byte].view(kind), pa.array(ends.astype(np.int32))


class SparsePointSource(_Source):
    columns = "point_id long, x double, y double, z double, r int, g int, b int, error double, track array<struct<image_id:int,point_index:int>>"

    @classmethod
    def name(cls) -> str:
        return "sparse_points"

    def reader(self, schema):
        return SparsePointReader(self.path, self.size_of_tasks()[1])

    def writer(self, schema, overwrite):
        return SparsePointWriter(self.path, overwrite)


class SparsePointReader(VaryingReader):
    def decoded(self, data, places):
        raw, place = np.frombuffer(data, np.uint8), np.array(places)
        head = raw[place[:, None] + np.arange(POINT.itemsize)].copy().view(POINT)[:, 0]
        pairs, ends = _gathered(raw, place + POINT.itemsize, head["n"].astype(np.int64), np.dtype([("image_id", "<i4"), ("point_index", "<i4")]))
        track = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(pairs[c]) for c in pairs.dtype.names], pairs.dtype.names))
        numbers = [pa.array(head[c].astype(t)) for c, t in (("point_id", np.int64), *((c, float) for c in "xyz"), *((c, np.int32) for c in "rgb"), ("error", float))]
        return pa.RecordBatch.from_arrays([*numbers, track], ["point_id", "x", "y", "z", "r", "g", "b", "error", "track"])


class SparsePointWriter(PartWriter):
    def head(self, rows: int) -> bytes:
        return struct.pack("<Q", rows)

    def encoded(self, batch: pa.RecordBatch) -> bytes:
        track = batch.column(batch.schema.get_field_index("track"))
        n = np.diff(track.offsets.to_numpy())
        head = np.zeros(batch.num_rows, POINT)
        for c in ("point_id", "x", "y", "z", "r", "g", "b", "error"):
            head[c] = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
        head["n"] = n
        pairs = np.column_stack([x.to_numpy(zero_copy_only=False) for x in track.flatten().flatten()]).astype("<i4").tobytes()
        heads, ends = head.tobytes(), (np.r_[0, np.cumsum(n)] * PAIR).tolist()
        size = POINT.itemsize
        return b"".join(heads[i * size : i * size + size] + pairs[ends[i] : ends[i + 1]] for i in range(len(n)))


# ---- dense arrays


class DenseArraySource(_Source):
    columns = "row int, col int, channel int, value double"

    @classmethod
    def name(cls) -> str:
        return "dense_array"

    def reader(self, schema):
        return DenseArrayReader(self.path, self.size_of_tasks()[0])

    def writer(self, schema, overwrite):
        return DenseArrayWriter(self.path, overwrite, *(int(self.options[k]) for k in ("width", "height", "channels")))


def _dense_head(path: str) -> tuple[int, int, int, int]:
    own, at = store(path)
    with own.open_input_file(at) as f:
        head = f.read(64)
    w, h, c, _ = head.split(b"&", 3)
    return int(w), int(h), int(c), len(w) + len(h) + len(c) + 3


class DenseArrayReader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int):
        self.path, self.task_bytes = path, task_bytes

    def partitions(self):
        return [p for path in files(self.path) for w, h, c, start in [_dense_head(path)] for p in _cut(path, w * h * c, start, 4, self.task_bytes)]

    def read(self, partition):
        if partition is None:
            return
        w, h, _, _ = _dense_head(partition.path)
        for first, data in _blocks(partition, 4):
            value = np.frombuffer(data, "<f4").astype(float)
            at = np.arange(first, first + len(value))
            yield pa.RecordBatch.from_arrays([pa.array((x).astype(np.int32)) for x in (at // w % h, at % w, at // (w * h))] + [pa.array(value)], ["row", "col", "channel", "value"])


class DenseArrayWriter(PartWriter):
    """Values of all cells, sorted by channel, row, col; options width, height, channels."""

    def __init__(self, path: str, overwrite: bool, width: int, height: int, channels: int):
        super().__init__(path, overwrite)
        self.shape = (width, height, channels)

    def head(self, rows: int) -> bytes:
        if rows != self.shape[0] * self.shape[1] * self.shape[2]:
            raise ValueError(f"{rows} values don't fill an array of {self.shape}")
        return "&".join(map(str, self.shape)).encode() + b"&"

    def encoded(self, batch: pa.RecordBatch) -> bytes:
        return batch.column(batch.schema.get_field_index("value")).to_numpy(zero_copy_only=False).astype("<f4").tobytes()


# ---- cameras and images

#: Heads of the records; an image's name (ended by a zero byte) and its points, behind their number, follow.
CAMERA = np.dtype([("camera_id", "<i4"), ("model", "<i4"), ("width", "<u8"), ("height", "<u8")])
IMAGE = np.dtype([("image_id", "<i4"), ("qvec", "<f8", 4), ("tvec", "<f8", 3), ("camera_id", "<i4")])
SEEN = np.dtype([("x", "<f8"), ("y", "<f8"), ("id", "<i8")])


def _camera_end(data: bytes, at: int) -> int | None:
    end = at + CAMERA.itemsize
    return end + 8 * CAMERA_MODELS[struct.unpack_from("<i", data, at + 4)[0]][1] if end <= len(data) else None


def _image_end(data: bytes, at: int) -> int | None:
    name = data.find(b"\0", at + IMAGE.itemsize)
    return name + 9 + SEEN.itemsize * struct.unpack_from("<Q", data, name + 1)[0] if 0 <= name <= len(data) - 9 else None


class CameraReader(VaryingReader):
    end_of = staticmethod(_camera_end)

    def decoded(self, data, places):
        raw, place = np.frombuffer(data, np.uint8), np.array(places)
        head = raw[place[:, None] + np.arange(CAMERA.itemsize)].copy().view(CAMERA)[:, 0]
        models = [CAMERA_MODELS[m] for m in head["model"].tolist()]
        values, ends = _gathered(raw, place + CAMERA.itemsize, np.array([n for _, n in models]), np.dtype("<f8"))
        size = [pa.array(head[c].astype(np.int64)) for c in ("width", "height")]
        return pa.RecordBatch.from_arrays([pa.array(head["camera_id"]), pa.array([m for m, _ in models]), *size, pa.ListArray.from_arrays(ends, pa.array(values))], ["camera_id", "model", "width", "height", "params"])


class ImageReader(VaryingReader):
    end_of = staticmethod(_image_end)

    def decoded(self, data, places):
        raw, place = np.frombuffer(data, np.uint8), np.array(places)
        head = raw[place[:, None] + np.arange(IMAGE.itemsize)].copy().view(IMAGE)[:, 0]
        ends = [data.index(b"\0", p + IMAGE.itemsize) for p in places]
        names = [data[p + IMAGE.itemsize : e].decode() for p, e in zip(places, ends, strict=True)]
        end = np.array(ends)
        n = raw[end[:, None] + np.arange(1, 9)].copy().view("<u8")[:, 0].astype(np.int64)
        seen, offsets = _gathered(raw, end + 9, n, SEEN)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(head[c].ravel()), head[c].shape[1]).cast(pa.list_(pa.float64())) for c in ("qvec", "tvec")]
        xys = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(seen[c]) for c in "xy"], ["x", "y"]))
        columns = [pa.array(head["image_id"]), *lists, pa.array(head["camera_id"]), pa.array(names, pa.string()), xys, pa.ListArray.from_arrays(offsets, pa.array(seen["id"]))]
        return pa.RecordBatch.from_arrays(columns, ["image_id", "qvec", "tvec", "camera_id", "name", "xys", "point3d_ids"])


class CameraSource(_Source):
    columns = "camera_id int, model string, width long, height long, params array<double>"

    @classmethod
    def name(cls) -> str:
        return "cameras"

    def reader(self, schema):
        return CameraReader(self.path, self.size_of_tasks()[1])

    def writer(self, schema, overwrite):
        return CameraWriter(self.path, overwrite)


class CameraWriter(PartWriter):
    head = SparsePointWriter.head

    def encoded(self, batch: pa.RecordBatch) -> bytes:
        number = {name: (i, n) for i, (name, n) in CAMERA_MODELS.items()}
        out = []
        for r in batch.to_pylist():
            model, n = number[r["model"]]
            out.append(struct.pack(f"<iiQQ{n}d", r["camera_id"], model, r["width"], r["height"], *r["params"]))
        return b"".join(out)


class ImageSource(_Source):
    columns = "image_id int, qvec array<double>, tvec array<double>, camera_id int, name string, xys array<struct<x:double,y:double>>, point3d_ids array<long>"

    @classmethod
    def name(cls) -> str:
        return "images"

    def reader(self, schema):
        return ImageReader(self.path, self.size_of_tasks()[1])

    def writer(self, schema, overwrite):
        return ImageWriter(self.path, overwrite)


class ImageWriter(PartWriter):
    head = SparsePointWriter.head

    def encoded(self, batch: pa.RecordBatch) -> bytes:
        out = []
        for r in batch.to_pylist():
            points = [(p["x"], p["y"], i) for p, i in zip(r["xys"], r["point3d_ids"], strict=True)]
            out.append(struct.pack("<i7di", r["image_id"], *r["qvec"], *r["tvec"], r["camera_id"]) + r["name"].encode() + b"\0" + struct.pack("<Q", len(points)) + b"".join(struct.pack("<ddq", *p) for p in points))
        return b"".join(out)


SOURCES = (PlySource, SparsePointSource, DenseArraySource, CameraSource, ImageSource)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    for source in SOURCES:
        spark.dataSource.register(source)
