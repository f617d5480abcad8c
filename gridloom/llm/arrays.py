"""Files of many arrays in the shared folder, mapped into memory by workers.

The arrays of ``PER_FILE`` buckets lie end to end in one file, with a table of
their places at its end. Files are written under a temporary name and moved, so
a lost or repeated task does no harm. A reader keeps a bounded number of files
open. Where the folder is not mounted, it reads the arrays that it looks up
through the file system instead, and keeps a bounded number of bytes of them.
"""

from __future__ import annotations

import json
import mmap
import sys
import uuid
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np
import pyarrow.fs

PER_FILE = 8  # buckets
#: A map without a file descriptor costs little, so there are as many as passes over all files need: to open each again would be most of a pass.
BARE_MAPS = {"trackfd": False} if sys.version_info >= (3, 13) else {}
OPEN_FILES, HELD_BYTES = 128, 256 << 20
OPEN_MAPS = 16384 if BARE_MAPS else OPEN_FILES


def _fs(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{uri}")


def _name(root: str, kind: str, bucket: int) -> str:
    return f"{root}/{kind}-{bucket // PER_FILE:06d}"


class Writer:
    """Arrays of buckets in ascending order; a bucket's file is closed when the next file's buckets come."""

    def __init__(self, root: str, kind: str):
        self.root, self.kind, self.name, self.out = root, kind, None, None

    def put(self, bucket: int, arrays: dict[str, np.ndarray]) -> None:
        name = _name(self.root, self.kind, bucket)
        if name != self.name:
            self.close()
            self.fs, self.path = _fs(name)
            self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
            self.name, self.part, self.at, self.places = name, f"{self.path}.{uuid.uuid4().hex}", 0, {}
            self.out = self.fs.open_output_stream(self.part)
        for key, x in arrays.items():
            raw = np.ascontiguousarray(x).tobytes()
            self.places[f"{bucket}.{key}"] = (self.at, len(raw))
            raw += b"\0" * (-len(raw) % 8)
            self.out.write(raw)
            self.at += len(raw)

    def close(self) -> None:
        if self.out is None:
            return
        table = json.dumps(self.places).encode()
        self.out.write(table + len(table).to_bytes(8, "little"))
        self.out.close()
        self.fs.move(self.part, self.path)
        self.name = self.out = None


class _File:
    def __init__(self, uri: str):
        where = urlparse(uri)
        self.map, self.file, self.held, self.views = None, None, {}, {}
        if where.scheme in ("", "file"):
            try:
                with open(where.path, "rb") as f:
                    self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **BARE_MAPS)
            except FileNotFoundError:  # none of its buckets has anything
                self.places = {}
                return
            size = len(self.map)
        else:
            fs, path = _fs(uri)
            if fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
                self.places = {}
                return
            self.file = fs.open_input_file(path)
            size = self.file.size()
        n = int.from_bytes(self._bytes(size - 8, 8), "little")
        self.places = json.loads(bytes(self._bytes(size - 8 - n, n)))

    def _bytes(self, at: int, n: int):
        return self.map[at : at + n] if self.map is not None else self.file.read_at(n, at)

    def get(self, key: str, dtype) -> np.ndarray:
        if key in self.views:
            return self.views[key]
        at, n = self.places.get(key, (0, 0))
        if not n:
            return np.empty(0, dtype)
        if self.map is not None:
            self.views[key] = np.frombuffer(self.map, dtype, n // np.dtype(dtype).itemsize, at)
            return self.views[key]
        if key not in self.held:
            self.held[key] = np.frombuffer(self.file.read_at(n, at), dtype)
        return self.held[key]


class Reader:
    """Arrays by kind, bucket and name; an array that was not written is empty."""

    def __init__(self, root: str):
        self.root = root
        self.open: OrderedDict[str, _File] = OrderedDict()

    def __getstate__(self):
        return {"root": self.root, "open": OrderedDict()}

    def get(self, kind: str, bucket: int, name: str, dtype) -> np.ndarray:
        uri = _name(self.root, kind, bucket)
        if uri in self.open:
            self.open.move_to_end(uri)
        else:
            held = sum(x.nbytes for f in self.open.values() for x in f.held.values())
            most = OPEN_FILES if urlparse(uri).scheme not in ("", "file") else OPEN_MAPS
            while self.open and (len(self.open) >= most or held > HELD_BYTES):
                _, old = self.open.popitem(last=False)
                held -= sum(x.nbytes for x in old.held.values())
            self.open[uri] = _File(uri)
        return self.open[uri].get(f"{bucket}.{name}", dtype)
