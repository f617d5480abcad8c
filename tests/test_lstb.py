"""The container: bytes laid out by hand, refusals, frames, pruning and commits."""

import gzip
import json
import struct

import numpy as np
import pytest

from gridloom.sources import lstb


def by_hand(columns, data, *, n=2, head=None, version=1, reserved=b"\0\0\0", pad=b"\0"):
    body = head if head is not None else json.dumps({"kind": "cube", "n": n, "meta": {}, "columns": columns}).encode()
    raw = b"LSTB" + bytes([version]) + reserved + struct.pack("<I", len(body)) + body
    return raw + pad * (-len(raw) % 8) + data


def column(**over):
    return {"name": "lst", "dtype": "int16", "shape": [2, 2], "scale": 0.01, "offset": 10.0, "nodata": -32768, "byte_offset": 0, "byte_length": 8} | over


CODES = struct.pack("<4h", 100, -32768, -250, 7)


def test_bytes_laid_out_by_hand():
    off = column(name="off", dtype="uint8", shape=[2], scale=0.05, offset=0.0, nodata=255, byte_offset=8, byte_length=2)
    raw = by_hand([column(), off], CODES + bytes([4, 255]) + b"\0" * 6)
    for form in (raw, gzip.compress(raw)):
        got = lstb.unpack(form)
        assert got["lst"] == pytest.approx(np.array([[11.0, np.nan], [7.5, 10.07]]), nan_ok=True)
        assert got["off"] == pytest.approx(np.array([0.2, np.nan]), nan_ok=True)
        assert list(lstb.unpack(form, ["off"])) == ["off"]
    rows = lstb.frame_rows(lstb.unpack(raw))
    assert rows["frame"].tolist() == [0, 0, 1, 1] and rows["i"].tolist() == [0, 1, 0, 1]
    assert rows["off"] == pytest.approx(np.array([0.2, np.nan, 0.2, np.nan]), nan_ok=True)


def test_layout_of_a_packed_file():
    raw = lstb.pack([lstb.Column("a", "u8"), lstb.Column("b", "f32")], [np.array([1.0, np.nan, 300.0]), np.array([0.5, np.nan, 2.0])], "cells", {"x": 1})
    size = struct.unpack("<I", raw[8:12])[0]
    head, start = json.loads(raw[12 : 12 + size]), 12 + size + -(12 + size) % 8
    assert raw[:8] == b"LSTB\x01\0\0\0" and head["kind"] == "cells" and head["n"] == 3 and head["meta"] == {"x": 1}
    assert [(c["byte_offset"], c["byte_length"], c["shape"], c["nodata"]) for c in head["columns"]] == [(0, 3, [3], 255), (8, 12, [3], None)]
    assert raw[start : start + 3] == bytes([1, 255, 254]) and struct.unpack("<f", raw[start + 8 : start + 12]) == (0.5,)


@pytest.mark.parametrize(
    "raw,why",
    [
        (b"LSTC" + bytes(20), "begin with"),
        (by_hand([column()], CODES, version=2), "version"),
        (by_hand([column()], CODES, reserved=b"\0\1\0"), "reserved"),
        (by_hand([column()], CODES, head=b'{"kind": "a", "n": 1, "meta": {}, "columns": []} ', pad=b"\1"), "padding"),
        (by_hand([column()], CODES, head=b'{"kind": "a", "n": NaN, "meta": {}, "columns": []}'), "NaN"),
        (by_hand([column()], CODES, head=b'{"kind": "a", "n": 1, "columns": []}'), "lacks a key"),
        (by_hand([column()], CODES, n=0), "positive"),
        (by_hand([{k: v for k, v in column().items() if k != "shape"}], CODES), "lacks a key"),
        (by_hand([column(dtype="int64")], CODES), "type"),
        (by_hand([column(shape=[])], CODES), "shape"),
        (by_hand([column(byte_offset=4)], CODES), "begins at"),
        (by_hand([column(byte_length=6)], CODES), "bytes"),
        (by_hand([column()], CODES[:6]), "behind"),
        (by_hand([column(scale=0)], CODES), "scale"),
        (by_hand([column(nodata=70000)], CODES), "missing code"),
        (by_hand([column(dtype="float32", shape=[2], nodata=1)], CODES), "missing code"),
        (by_hand([column(), column()], CODES), "one name"),
        (by_hand([column(), column(name="b", shape=[1], byte_length=2)], CODES), "overlap"),
    ],
)
def test_refusals(raw, why):
    with pytest.raises(ValueError, match=why):
        lstb.unpack(raw)


def test_source_writes_bounded_files_and_reads_what_was_committed(spark, tmp_path):
    d = spark.range(2500).selectExpr("id AS a", "CASE WHEN id % 7 = 0 THEN NULL ELSE id / 10 END AS b").repartition(3)
    path = lstb.write(d, [lstb.Column("a", "i32"), lstb.Column("b", "i16", 0.1)], "cells", f"{tmp_path}/t", rows=400)
    files = list((tmp_path / "t").glob("*.lstb.gz"))
    assert len(files) >= 7
    (tmp_path / "t" / "part-of-a-lost-task.lstb.gz").write_bytes(b"x")
    got = {r.a: r.b for r in lstb.read(spark, path).collect()}
    assert len(got) == 2500 and got[7] is None and got[2498] == pytest.approx(249.8)
    assert lstb.read(spark, path, ["b"]).columns == ["b"] and lstb.read(spark, path, ["b"]).count() == 2500
    rows = spark.read.format("lstb").option("path", path).load()
    assert rows.columns == ["frame", "i", "a", "b"] and rows.filter("frame <> 0 or i >= 400").count() == 0


def test_empty_table(spark, tmp_path):
    path = lstb.write(spark.range(0).selectExpr("id AS a"), [lstb.Column("a", "i32")], "cells", f"{tmp_path}/t")
    assert lstb.read(spark, path).count() == 0


def test_cubes_of_any_store(spark, tmp_path):
    x = np.array([[1.0, 2.0, np.nan], [4.0, 5.0, 6.0]])
    (tmp_path / "c.lstb.gz").write_bytes(gzip.compress(lstb.pack([lstb.Column("lst", "i16", 0.5), lstb.Column("off", "u8")], [x, np.array([7.0, 8.0, 9.0])], "cube")))
    rows = lstb.decode_cubes(spark.read.format("binaryFile").load(str(tmp_path / "c.lstb.gz")), ["lst", "off"]).orderBy("frame", "i").collect()
    assert [(r.frame, r.i, r.lst, r.off) for r in rows] == [(0, 0, 1, 7), (0, 1, 2, 8), (0, 2, None, 9), (1, 0, 4, 7), (1, 1, 5, 8), (1, 2, 6, 9)]
