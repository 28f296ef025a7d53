"""Raster files as a source and a sink: round trips, files made by hand, and chunks that aren't read."""

import struct
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from verdanta.sources import raster, tiff

PLACE = (10.0, 0.0, 500000.0, 0.0, -10.0, 4600000.0)


def classic(order, arrays, strip_rows, compression=1, predictor=1, planar=1, nodata=None):
    """A classic TIFF in strips, put together by hand."""
    n, h, w = arrays.shape
    dtype = arrays.dtype.newbyteorder(order)
    planes = [arrays.transpose(1, 2, 0)] if planar == 1 else [a[..., None] for a in arrays]
    strips = []
    for p in planes:
        for r in range(0, h, strip_rows):
            part = p[r : r + strip_rows].astype(dtype)
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1).astype(dtype)
            strips.append(part.tobytes() if compression == 1 else zlib.compress(part.tobytes()))
    body, offsets = b"", []
    for s in strips:
        offsets.append(8 + len(body))
        body += s
    kind = {"u": 1, "i": 2, "f": 3}[arrays.dtype.kind]
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [arrays.dtype.itemsize * 8] * n), (259, "H", [compression]), (262, "H", [1]), (273, "I", offsets), (277, "H", [n]), (278, "I", [strip_rows]), (279, "I", [len(s) for s in strips]), (284, "H", [planar]), (317, "H", [predictor]), (339, "H", [kind] * n)]
    if nodata:
        tags.append((42113, "s", nodata))
    start = 8 + len(body)
    rest_at, entries, rest = start + 2 + 12 * len(tags) + 4, b"", b""
    for tag, code, values in tags:
        raw = values.encode() + b"\0" if code == "s" else struct.pack(order + code * len(values), *values)
        entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4, "s": 2}[code], len(raw) if code == "s" else len(values))
        if len(raw) > 4:
            entries += struct.pack(order + "I", rest_at + len(rest))
            rest += raw
        else:
            entries += raw.ljust(4, b"\0")
    mark = b"II" if order == "<" else b"MM"
    return mark + struct.pack(order + "HI", 42, start) + body + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0) + rest


@pytest.mark.parametrize(("order", "dtype", "compression", "predictor", "planar"), [("<", "u2", 1, 1, 1), (">", "u2", 8, 2, 1), (">", "f4", 8, 1, 2), ("<", "i4", 32946, 2, 2), (">", "u1", 8, 2, 1), ("<", "f8", 1, 1, 1)])
def test_files_made_by_hand(spark, tmp_path, order, dtype, compression, predictor, planar):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 200, (3, 23, 17)).astype(dtype)
    (tmp_path / "x_B2.TIF").write_bytes(classic(order, a, 5, compression, predictor, planar, nodata="7"))
    got = raster.read_rasters(spark, str(tmp_path), [3, 1]).collect()
    assert len(got) == 23 * 17 and {r["scene"] for r in got} == {"x_B2"}
    for r in got:
        for b in (1, 3):
            want = float(a[b - 1, r["row"], r["col"]])
            assert r[f"b{b}"] == (None if want == 7 else want)


def test_codec_of_every_type():
    rng = np.random.default_rng(2)
    for dtype in ("<f4", "<f8", "<u1", "<u2", "<i2", "<i4", "<i8"):
        a = (rng.normal(0, 50, (2, 70, 41)) if "f" in dtype else rng.integers(0, 100, (2, 70, 41))).astype(dtype)
        raw = tiff.tiff_bytes(a, PLACE, 32643, 5.0, "a note", tile=32)
        header = tiff.read_header(lambda at, n, raw=raw: raw[at : at + n])
        assert (header.height, header.width, header.bands, header.nodata, header.transform, header.epsg, header.description) == (70, 41, 2, 5.0, PLACE, 32643, "a note")
        out = np.zeros_like(a)
        for k, r, c, n, band in header.chunks():
            part = tiff.decoded(raw[header.offsets[k] : header.offsets[k] + header.sizes[k]], header, n, 1)[..., 0]
            out[band, r : r + n, c : c + 32] = part[: 70 - r, : 41 - c]
        assert (out == a).all()
    with pytest.raises(ValueError):
        tiff.read_header(lambda at, n: b"GIF89a"[at : at + n])


def pixels(spark, h=50, w=70):
    rows = [(s, r, c, float(r * 100 + c + s), None if (r + c) % 9 == 0 else r / (c + 1)) for s in (1, 2) for r in range(h) for c in range(w) if (r, c) != (3, 4)]
    return spark.createDataFrame(rows, "scene_id long, row long, col long, nir double, red double")


def test_round_trip_in_blocks(spark, tmp_path):
    path = f"{tmp_path}/out"
    raster.write_rasters(pixels(spark), path, ["nir", "red"], 50, 70, PLACE, 32643, dtype="float64", block=32)
    assert len(list((tmp_path / "out").glob("*.tif"))) == 2 * 2 * 3 and not list((tmp_path / "out" / "_temporary").glob("*"))
    got = raster.read_rasters(spark, path)
    assert got.dtypes == [("scene", "string"), ("row", "bigint"), ("col", "bigint"), ("b1", "double"), ("b2", "double")]
    want = {(str(r[0]), *r[1:3]): tuple(r[3:]) for r in pixels(spark).collect()}
    back = {(r[0], r[1], r[2]): tuple(r[3:]) for r in got.collect()}
    assert len(back) == 2 * 50 * 70 and back.pop(("1", 3, 4)) == back.pop(("2", 3, 4)) == (None, None)
    assert back == want
    block = max((tmp_path / "out").glob("*.tif"), key=lambda p: tiff.read_header(lambda at, n: p.read_bytes()[at : at + n]).transform[2])
    assert tiff.read_header(lambda at, n: block.read_bytes()[at : at + n]).transform[2] == 500000.0 + 64 * 10
    # overwriting leaves only the new files, appending adds to them
    one = pixels(spark).where("scene_id = 1")
    raster.write_rasters(one, path, ["nir"], 50, 70, block=64)
    assert raster.read_rasters(spark, path).columns == ["scene", "row", "col", "b1"] and len(list((tmp_path / "out").glob("*.tif"))) == 2
    raster.write_rasters(one.withColumn("scene_id", F.lit("other")), path, ["nir"], 50, 70, block=64, mode="append")
    assert raster.read_rasters(spark, path).groupBy("scene").count().count() == 2


def test_chunks_outside_of_the_ranges_are_not_read(spark, tmp_path):
    """The bytes of all other chunks are spoilt: reading them would fail."""
    a = np.arange(2 * 64 * 64, dtype="<f4").reshape(2, 64, 64)
    raw = bytearray(tiff.tiff_bytes(a, tile=16))
    header = tiff.read_header(lambda at, n: bytes(raw[at : at + n]))
    for k, r, c, _, band in header.chunks():
        if not (r in (16, 32) and c == 48 and band == 1):
            raw[header.offsets[k] : header.offsets[k] + header.sizes[k]] = b"\xff" * header.sizes[k]
    (tmp_path / "a.tif").write_bytes(raw)
    got = raster.read_rasters(spark, f"file:{tmp_path}/a.tif", [2], (20, 40), (50, 60)).collect()
    assert {(r["row"], r["col"], r["b2"]) for r in got} == {(r, c, float(a[1, r, c])) for r in range(20, 40) for c in range(50, 60)}
    with pytest.raises(Exception, match="zlib"):
        raster.read_rasters(spark, f"{tmp_path}/a.tif", [2]).collect()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = spark.read.format("raster").option("bands", "2").option("pushdown", "true").load(f"{tmp_path}/a.tif").where("row >= 20 AND row < 40 AND col > 49 AND col <= 59 AND b2 > 0")
        assert sorted(map(tuple, pushed.collect())) == sorted(map(tuple, got))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_files_are_split_by_their_bytes(spark, tmp_path):
    a = np.random.default_rng(3).random((2, 300, 200)).astype("f4")
    (tmp_path / "a.tif").write_bytes(tiff.tiff_bytes(a, tile=64))
    spark.dataSource.register(raster.RasterSource)
    df = spark.read.format("raster").option("splitBytes", "50000").load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 5
    got = {(r["row"], r["col"]): (r["b1"], r["b2"]) for r in df.collect()}
    assert len(got) == df.count() == 300 * 200 and all(got[r, c] == (a[0, r, c], a[1, r, c]) for r, c in ((0, 0), (299, 199), (100, 63), (64, 64)))


def test_failed_writes_leave_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="outside"):
        raster.write_rasters(pixels(spark), f"{tmp_path}/bad", ["nir"], 50, 69)
    assert not list(pafs.LocalFileSystem().get_file_info(pafs.FileSelector(f"{tmp_path}/bad", recursive=True, allow_not_found=True))) or not list((tmp_path / "bad").rglob("*.tif"))
    with pytest.raises(Exception, match="no raster files"):
        raster.read_rasters(spark, f"{tmp_path}").count()
    empty = pixels(spark).where("row < 0")
    raster.write_rasters(empty, f"{tmp_path}/none", ["nir"], 5, 5)
    assert not list((tmp_path / "none").rglob("*.tif"))
