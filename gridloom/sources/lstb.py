"""The LSTB column container as a Spark data source.

A file, gzipped or not, is: ``LSTB``, version 1 (one byte), three zero bytes, the
header's length (u32), a JSON header, zero bytes to a multiple of 8, and column
blocks at multiples of 8 bytes. The header has kind, n, meta and columns; a
column has name, dtype, shape, scale, offset, nodata, byte_offset and
byte_length. A value is code * scale + offset, and a code may stand for missing.
A column of shape [n] has a value a row; one of shape [frames, n] has one for
every frame and row.

``spark.read.format("lstb")`` gives a row for each frame and row of the files
that a folder's index names (``columns`` leaves the other blocks unread), and
``df.write.format("lstb")`` writes files of bounded size: tasks write, and the
driver's commit names what finished tasks wrote, so a task's lost or repeated
file is never read. Files that break a rule are refused with the reason.
"""

from __future__ import annotations

import gzip
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MAGIC, VERSION, ALIGN = b"LSTB", 1, 8
#: The types of a column, and the codes for missing that files use.
TYPES = {"int16": "<i2", "uint8": "<u1", "int32": "<i4", "float32": "<f4"}
SHORT = {"i16": "int16", "u8": "uint8", "i32": "int32", "f32": "float32"}
NODATA = {"int16": -32768, "uint8": 255, "int32": -2147483648, "float32": None}
HEAD, OF_COLUMN = ("kind", "n", "meta", "columns"), ("name", "dtype", "shape", "scale", "offset", "nodata", "byte_offset", "byte_length")
ROWS = 1 << 20  # of a file


@dataclass(frozen=True)
class Column:
    """How a column is stored; ``dtype`` by its name in files or i16, u8, i32, f32."""

    name: str
    dtype: str
    scale: float = 1.0
    offset: float = 0.0

    @property
    def kind(self) -> str:
        return SHORT.get(self.dtype, self.dtype)


def encode_values(values: np.ndarray, c: Column) -> np.ndarray:
    """Codes by half-even rounding, clipped to the type's range without the code for missing."""
    kind, missing = np.dtype(TYPES[c.kind]), NODATA[c.kind]
    if missing is None:
        return values.astype(kind)
    info = np.iinfo(kind)
    low, high = (info.min + 1, info.max) if missing == info.min else (info.min, info.max - 1)
    code = np.clip(np.rint((values - c.offset) / c.scale), low, high)
    return np.where(np.isfinite(values), code, missing).astype(kind)


def decode_values(code: np.ndarray, c: dict) -> np.ndarray:
    out = code.astype(np.float64) * c["scale"] + c["offset"]
    return out if c["nodata"] is None else np.where(code == c["nodata"], np.nan, out)


def pack(columns: list[Column], data: list[np.ndarray], kind: str, meta: dict | None = None) -> bytes:
    """A file from arrays of shape (n,) or (frames, n)."""
    heads, blocks, at = [], [], 0
    for c, x in zip(columns, data, strict=True):
        raw = encode_values(np.asarray(x, float), c).tobytes()
        values = (c.name, c.kind, list(np.shape(x)), float(c.scale), float(c.offset), NODATA[c.kind], at, len(raw))
        heads.append(dict(zip(OF_COLUMN, values, strict=True)))
        blocks.append(raw + b"\0" * (-len(raw) % ALIGN))
        at += len(blocks[-1])
    n = int(np.shape(data[0])[-1]) if data else 0
    head = json.dumps(dict(zip(HEAD, (kind, n, meta or {}, heads), strict=True)), allow_nan=False).encode()
    return MAGIC + bytes([VERSION, 0, 0, 0]) + struct.pack("<I", len(head)) + head + b"\0" * (-(12 + len(head)) % ALIGN) + b"".join(blocks)


def _refuse(wrong: bool, why: str) -> None:
    if wrong:
        raise ValueError(f"not a valid LSTB file: {why}")


def _constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def header_of(raw: bytes) -> tuple[dict, int]:
    """The checked header and where the data starts."""
    _refuse(raw[:4] != MAGIC or len(raw) < 12, "it does not begin with LSTB")
    _refuse(raw[4] != VERSION, f"version {raw[4]}")
    _refuse(raw[5:8] != b"\0\0\0", "reserved bytes are not zero")
    end = 12 + struct.unpack("<I", raw[8:12])[0]
    _refuse(end > len(raw), "the header is longer than the file")
    try:
        head = json.loads(raw[12:end].decode(), parse_constant=_constant)
    except ValueError as e:
        raise ValueError(f"not a valid LSTB file: header: {e}") from e
    start = end + -end % ALIGN
    _refuse(any(raw[end:start]), "padding is not zero")
    _refuse(not isinstance(head, dict) or any(k not in head for k in HEAD), "the header lacks a key")
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    _refuse(not whole(head["n"]) or head["n"] < 1, "n is not a positive whole number")
    for c in head["columns"]:
        name = c.get("name")
        _refuse(any(k not in c for k in OF_COLUMN), f"column {name} lacks a key")
        _refuse(c["dtype"] not in TYPES, f"column {name} has the type {c['dtype']}")
        kind = np.dtype(TYPES[c["dtype"]])
        shape, at, size = c["shape"], c["byte_offset"], c["byte_length"]
        _refuse(not isinstance(shape, list) or not shape or not all(whole(s) and s >= 0 for s in shape), f"column {name} has the shape {shape}")
        _refuse(not whole(at) or at < 0 or at % ALIGN != 0, f"column {name} begins at {at}")
        _refuse(size != int(np.prod(shape)) * kind.itemsize, f"column {name} has {size} bytes")
        _refuse(start + at + size > len(raw), f"column {name} ends behind the file")
        _refuse(not number(c["scale"]) or c["scale"] <= 0 or not number(c["offset"]), f"column {name} has a wrong scale or offset")
        missing = c["nodata"]
        if missing is not None:
            _refuse(kind.kind == "f" or not whole(missing) or not np.iinfo(kind).min <= missing <= np.iinfo(kind).max, f"column {name} has the missing code {missing}")
    names = [c["name"] for c in head["columns"]]
    _refuse(len(set(names)) < len(names), "two columns have one name")
    spans = sorted((c["byte_offset"], c["byte_offset"] + c["byte_length"]) for c in head["columns"])
    _refuse(any(b[0] < a[1] for a, b in pairwise(spans)), "columns overlap")
    return head, start


def unpack(raw: bytes, columns: list[str] | None = None) -> dict[str, np.ndarray]:
    """The decoded columns asked for, in their shapes."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    head, start = header_of(raw)
    of = {c["name"]: c for c in head["columns"]}
    out = {}
    for name in columns if columns is not None else of:
        _refuse(name not in of, f"there is no column {name}")
        c = of[name]
        code = np.frombuffer(raw, TYPES[c["dtype"]], int(np.prod(c["shape"])), start + c["byte_offset"])
        out[name] = decode_values(code, c).reshape(c["shape"])
    return out


def frame_rows(got: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Columns as rows of (frame, i): a column without frames has the same values in every frame."""
    shapes = {x.shape[:-1] for x in got.values() if x.ndim > 1}
    _refuse(len(shapes) > 1 or any(len(s) > 1 for s in shapes), "columns have different frames")
    frames = next(iter(shapes))[0] if shapes else 1
    n = next(iter(got.values())).shape[-1] if got else 0
    rows = {"frame": np.repeat(np.arange(frames), n), "i": np.tile(np.arange(n), frames)}
    return rows | {k: np.broadcast_to(x, (frames, n)).ravel() for k, x in got.items()}


def _files(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


@dataclass
class _File(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in _index(self.path)["files"]] or [_File("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, root = _files(self.path)
        with fs.open_input_stream(f"{root}/{partition.name}", compression=None) as f:
            rows = frame_rows(unpack(f.read(), [n for n in self.names if n not in ("frame", "i")]))
        yield pa.RecordBatch.from_arrays([pa.array(rows[n], pa.int64() if n in ("frame", "i") else pa.float64(), from_pandas=True) for n in self.names], names=self.names)


@dataclass
class _Done(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, columns: list[Column], rows: int):
        self.path, self.kind, self.columns, self.rows = path, kind, columns, rows

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _files(self.path)
        fs.create_dir(root, recursive=True)
        files, held, size = [], [], 0

        def flush() -> None:
            t = pa.Table.from_batches(held)
            data = [t[c.name].cast(pa.float64()).to_numpy() for c in self.columns]
            files.append(f"part-{uuid.uuid4().hex}.lstb.gz")
            with fs.open_output_stream(f"{root}/{files[-1]}", compression=None) as f:
                f.write(gzip.compress(pack(self.columns, data, self.kind), 6))

        for b in iterator:
            for at in range(0, b.num_rows, self.rows):
                part = b.slice(at, self.rows)
                if size and size + part.num_rows > self.rows:
                    flush()
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            flush()
        return _Done(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _files(self.path)
        fs.create_dir(root, recursive=True)
        index = {"kind": self.kind, "columns": [c.name for c in self.columns], "files": sorted(f for m in messages if m for f in m.files)}
        with fs.open_output_stream(f"{root}/index.tmp") as f:
            f.write(json.dumps(index).encode())
        fs.move(f"{root}/index.tmp", f"{root}/index.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _files(self.path)
        for f in [f for m in messages if m for f in m.files]:
            fs.delete_file(f"{root}/{f}")


def _index(path: str) -> dict:
    fs, root = _files(path)
    with fs.open_input_stream(f"{root}/index.json") as f:
        return json.loads(f.read())


class LstbSource(DataSource):
    """Options: path; reading: columns (comma-separated); writing: kind and columns (JSON of name, dtype, scale, offset), rows of a file."""

    @classmethod
    def name(cls) -> str:
        return "lstb"

    def _columns(self) -> list[str]:
        asked = self.options.get("columns")
        return [c.strip() for c in asked.split(",")] if asked else _index(self.options["path"])["columns"]

    def schema(self) -> str:
        return ", ".join(["frame bigint", "i bigint", *[f"`{c}` double" for c in self._columns()]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("kind", "table"), [Column(*c) for c in json.loads(self.options["columns"])], int(self.options.get("rows", ROWS)))


def write(df: DataFrame, columns: list[Column], kind: str, path: str | None = None, rows: int = ROWS) -> str:
    """Files below ``path`` (a new folder of the shared one if not given); returns the path."""
    from ..operators.scratch import new_path

    path = path or new_path(df.sparkSession, "lstb")
    df.sparkSession.dataSource.register(LstbSource)
    how = json.dumps([[c.name, c.dtype, c.scale, c.offset] for c in columns])
    df.select(*[c.name for c in columns]).write.format("lstb").option("path", path).option("kind", kind).option("columns", how).option("rows", rows).mode("append").save()
    return path


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All files that the folder's index names, as one frame of doubles; of ``columns`` only, if given."""
    spark.dataSource.register(LstbSource)
    r = spark.read.format("lstb").option("path", path)
    d = (r.option("columns", ",".join(columns)) if columns else r).load()
    return d.drop("frame", "i")


def decode_cubes(files: DataFrame, columns: list[str]) -> DataFrame:
    """path, frame, i, columns of whole files (path, content), from any store that Spark reads."""
    names = ["path", "frame", "i", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = frame_rows(unpack(raw, columns))
                kinds = [pa.int64(), pa.int64(), *[pa.float64()] * len(columns)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows["i"])), *[pa.array(rows[n], k, from_pandas=True) for n, k in zip(names[1:], kinds, strict=True)]], names=names)

    return files.select("path", "content").mapInArrow(run, "path string, frame long, i long, " + ", ".join(f"`{c}` double" for c in columns))
