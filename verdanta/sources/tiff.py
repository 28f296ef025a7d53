"""Baseline, tiled and big TIFF files: headers, chunks (strips or tiles) and their bytes as numpy arrays.

Read: both byte orders, classic and 64-bit offsets, strips and tiles, bands side by side or one after the other, 8 to
64 bit integers and floats, no compression or deflate, horizontal and floating-point predictors. Written: tiles,
band after band, deflate with the predictor of their type. Only the first image of a file counts, so overviews don't.
"""

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isnan, nan, prod

import numpy as np

#: numbers of tags, by what they say; the last five are those of georeferenced files: fixed values
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIP_OFFSETS, SAMPLES = 256, 257, 258, 259, 262, 270, 273, 277
STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT = 278, 279, 284, 317, 322, 323
TILE_OFFSETS, TILE_BYTES, EXTRA, FORMAT = 324, 325, 338, 339
SCALE, TIEPOINT, TRANSFORM, GEOKEYS, NODATA = 33550, 33922, 34264, 34735, 42113
#: struct codes of the field types: fixed values
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}
DEFLATE = (8, 32946)

#: reads so many bytes from a place on
ReadAt = Callable[[int, int], bytes]


@dataclass
class Header:
    """What a file says of its first image."""

    order: str
    height: int
    width: int
    bands: int
    dtype: np.dtype
    compression: int = 1
    predictor: int = 1
    separate: bool = False
    chunk: tuple[int, int] = (1, 1)
    offsets: tuple[int, ...] = ()
    sizes: tuple[int, ...] = ()
    tiled: bool = False
    nodata: float | None = None
    transform: tuple[float, ...] | None = None
    epsg: int | None = None
    description: str = ""

    def chunks(self) -> Iterator[tuple[int, int, int, int, int | None]]:
        """(number, first row, first column, rows, band from 0 or None for all) of every chunk."""
        down, across = -(-self.height // self.chunk[0]), -(-self.width // self.chunk[1])
        for k in range(min(down * across * (self.bands if self.separate else 1), len(self.offsets))):
            band, at = divmod(k, down * across)
            top = at // across * self.chunk[0]
            yield k, top, at % across * self.chunk[1], self.chunk[0] if self.tiled else min(self.chunk[0], self.height - top), band if self.separate else None


def _values(raw: bytes, order: str, kind: int, count: int) -> tuple:
    code = TYPES.get(kind)
    if code is None:
        return ()
    if code == "s":
        return (raw[:count].split(b"\0")[0].decode("utf-8", "replace"),)
    return struct.unpack(order + code * count, raw[: struct.calcsize(order + code) * count])


def read_header(read: ReadAt) -> Header:
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack(order + "Q", head[8:16])[0] if big else struct.unpack(order + "I", head[4:8])[0]
    n = struct.unpack(order + "Q", read(at, 8))[0] if big else struct.unpack(order + "H", read(at, 2))[0]
    step, inline, lead = (20, 8, 8) if big else (12, 4, 2)
    raw = read(at + lead, n * step)
    tags = {}
    for k in range(n):
        entry = raw[k * step : (k + 1) * step]
        tag, kind = struct.unpack(order + "HH", entry[:4])
        count = struct.unpack(order + ("Q" if big else "I"), entry[4 : 4 + inline])[0]
        size = struct.calcsize(order + TYPES.get(kind, "B").replace("s", "B")) * count
        held = entry[4 + inline :]
        if size > inline:
            held = read(struct.unpack(order + ("Q" if big else "I"), held)[0], size)
        tags[tag] = _values(held, order, kind, count)
    one = lambda tag, other=None: tags[tag][0] if tags.get(tag) else other
    bands, bits, formats = one(SAMPLES, 1), tags.get(BITS, (1,)), tags.get(FORMAT, (1,))
    if len(set(bits)) > 1 or len(set(formats)) > 1 or bits[0] not in (8, 16, 32, 64) or formats[0] not in KINDS:
        raise ValueError(f"samples of {bits} bits and formats {formats} aren't read")
    compression = one(COMPRESSION, 1)
    if compression not in (1, *DEFLATE):
        raise ValueError(f"compression {compression} isn't read")
    height, width, tiled = one(HEIGHT), one(WIDTH), TILE_OFFSETS in tags
    chunk = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(STRIP_ROWS, height), height), width)
    transform = None
    if len(tags.get(TRANSFORM, ())) == 16:
        m = tags[TRANSFORM]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif SCALE in tags and TIEPOINT in tags:
        (sx, sy), (i, j, _, x, y) = tags[SCALE][:2], tags[TIEPOINT][:5]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    keys = tags.get(GEOKEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    told = str(one(NODATA, "")).strip()
    try:
        nodata = float(told) if told else None
    except ValueError:
        nodata = None
    return Header(order, height, width, bands, np.dtype(f"{order}{KINDS[formats[0]]}{bits[0] // 8}"), compression, one(PREDICTOR, 1), one(PLANAR, 1) == 2 and bands > 1, chunk, tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES], tiled, nodata, transform, codes.get(3072, codes.get(2048)), str(one(DESCRIPTION, "")))


def decoded(raw: bytes, header: Header, rows: int, bands: int) -> np.ndarray:
    """(rows, columns, bands) of a chunk's bytes."""
    columns, dtype = header.chunk[1], header.dtype
    shape = rows, columns, bands
    if header.compression in DEFLATE:
        raw = zlib.decompress(raw)
    raw = raw[: prod(shape) * dtype.itemsize]
    if header.predictor == 3:
        # every row holds the first bytes of all values, then the second ones ...; each byte is a difference
        planes = np.frombuffer(raw, np.uint8).reshape(rows, columns * dtype.itemsize * bands)
        steps = planes.reshape(rows, -1, bands).astype(np.uint8)
        whole = np.cumsum(steps, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, columns * bands)
        return np.ascontiguousarray(whole.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(shape)
    out = np.frombuffer(raw, dtype).reshape(shape)
    if header.predictor == 2:
        plain = out.astype(dtype.newbyteorder("=")).view(f"u{dtype.itemsize}")
        return np.cumsum(plain, axis=1, dtype=plain.dtype).view(dtype.newbyteorder("="))
    return out


def encoded(values: np.ndarray) -> bytes:
    """The bytes of a chunk (rows, columns) of little-endian values, with the predictor of its type."""
    rows, columns = values.shape
    if values.dtype.kind == "f":
        planes = np.ascontiguousarray(values.astype(values.dtype.newbyteorder(">"))).view(np.uint8).reshape(rows, columns, -1).transpose(0, 2, 1).reshape(rows, -1)
        return zlib.compress(np.diff(planes, axis=1, prepend=np.zeros((rows, 1), np.uint8)).tobytes())
    plain = values.view(f"u{values.dtype.itemsize}")
    return zlib.compress(np.diff(plain, axis=1, prepend=np.zeros((rows, 1), plain.dtype)).astype(values.dtype.newbyteorder("<").str.replace("i", "u")).tobytes())


def tiff_bytes(bands: np.ndarray, transform: tuple[float, ...] | None = None, epsg: int | None = None, nodata: float | None = nan, description: str = "", tile: int = 256) -> bytes:
    """A file of (bands, height, width): tiles, band after band, deflate."""
    n, height, width = bands.shape
    tile = max(16, -(-min(tile, max(height, width)) // 16) * 16)
    down, across = -(-height // tile), -(-width // tile)
    whole = np.zeros((n, down * tile, across * tile), bands.dtype)
    whole[:, :height, :width] = bands
    parts = [encoded(whole[b, r * tile : (r + 1) * tile, c * tile : (c + 1) * tile]) for b in range(n) for r in range(down) for c in range(across)]
    offsets, at = [], 16
    for p in parts:
        offsets.append(at)
        at += len(p)
    kind = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    tags: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (bands.dtype.itemsize * 8,) * n), (COMPRESSION, 3, (8,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (n,)),
        (PLANAR, 3, (2,)), (PREDICTOR, 3, (3 if kind == 3 else 2,)), (TILE_WIDTH, 4, (tile,)), (TILE_HEIGHT, 4, (tile,)), (TILE_OFFSETS, 16, tuple(offsets)), (TILE_BYTES, 16, tuple(map(len, parts))), (FORMAT, 3, (kind,) * n),
    ]
    if description:
        tags.append((DESCRIPTION, 2, (description,)))
    if n > 1:
        tags.append((EXTRA, 3, (0,) * (n - 1)))
    if transform is not None:
        a, b, c, d, e, f = transform
        tags.append((TRANSFORM, 12, (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)))
    if epsg is not None:
        tags.append((GEOKEYS, 3, (1, 1, 0, 2, 1024, 0, 1, 1 if epsg != 4326 else 2, 3072 if epsg != 4326 else 2048, 0, 1, epsg)))
    if nodata is not None:
        tags.append((NODATA, 2, ("nan" if isnan(nodata) else repr(nodata),)))
    tags.sort()
    place, entries, rest = at + 8 + 20 * len(tags) + 8, b"", b""
    for tag, code, values in tags:
        raw = values[0].encode() + b"\0" if code == 2 else struct.pack("<" + TYPES[code] * len(values), *values)
        count = len(raw) if code == 2 else len(values)
        if len(raw) > 8:
            entries += struct.pack("<HHQQ", tag, code, count, place + len(rest))
            rest += raw + b"\0" * (-len(raw) % 8)
        else:
            entries += struct.pack("<HHQ", tag, code, count) + raw.ljust(8, b"\0")
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) + b"".join(parts) + struct.pack("<Q", len(tags)) + entries + struct.pack("<Q", 0) + rest
