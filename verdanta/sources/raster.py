"""Raster files as tables of pixels, and pixels as raster files: a data source named ``raster``.

    spark.dataSource.register(RasterSource)
    spark.read.format("raster").option("bands", "1,3").option("rows", "0:512").load("s3://bucket/scenes")

Reading gives scene, row, col and a double per band (b1, b2, ...); nodata and NaN are NULL. ``path`` is a file or a folder
whose TIFF files are read, wherever Arrow's file systems reach. Files are split by their bytes, as Spark splits
others: a task opens the header itself and decodes the strips or tiles that begin in its share of the file, so the
driver lists files and reads one header, for the schema. ``bands``, ``rows`` and ``cols`` (1-based bands; ranges from:to)
are told before the read, and chunks outside of them aren't read. With ``pushdown`` (and Spark's own setting
``spark.sql.python.filterPushdown.enabled``) comparisons of row and col in the query do the same.

Writing takes scene, row, col and the bands' columns in their order and makes a file of ``block`` by ``block`` pixels for each
block of each scene, whose description says where it lies, so reading the folder gives the pixels back. A task's
files become visible when the whole job commits; those of failed tasks are removed. ``write_rasters`` puts each block
into one task first; a task holds one block at a time.
"""

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import isnan

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .imagery import nodata_to_null
from .tiff import Header, decoded, read_header, tiff_bytes

SPLIT_BYTES, BLOCK = 64 << 20, 1024
ENDINGS = (".tif", ".tiff")
NO_END = 1 << 62


@dataclass
class Split(InputPartition):
    """The chunks of a file that begin in a range of its bytes."""

    path: str
    start: int
    end: int


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    uri = path if "://" in path else path.removeprefix("file:") if path.startswith("file:/") else path
    return pafs.FileSystem.from_uri(uri)


def listed(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """The raster files at a path, by name; names that begin with _ or . don't count, as elsewhere in Spark."""
    fs, place = opened(path)
    info = fs.get_file_info(place)
    if info.type == pafs.FileType.File:
        return fs, [info]
    files = fs.get_file_info(pafs.FileSelector(place, recursive=True))
    shown = lambda f: not any(part[:1] in "_." for part in f.path[len(place) :].strip("/").split("/"))
    return fs, sorted((f for f in files if f.type == pafs.FileType.File and f.path.lower().endswith(ENDINGS) and shown(f)), key=lambda f: f.path)


def range_of(text: str | None) -> tuple[int, int]:
    """A half-open range written from:to, either of which may be missing."""
    low, _, high = (text or ":").partition(":")
    return int(low or 0), int(high or NO_END)


def placed(header: Header, path: str) -> tuple[str, int, int]:
    """Scene, row and column of a file's first pixel."""
    try:
        told = json.loads(header.description)
        return str(told["scene"]), int(told["row"]), int(told["col"])
    except (ValueError, TypeError, KeyError):
        return path.rsplit("/", 1)[-1].rsplit(".", 1)[0], 0, 0


class RasterReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options = options
        self.path = options["path"]
        self.bands = [int(f.name[1:]) for f in schema.fields[3:]]
        self.within = {"row": range_of(options.get("rows")), "col": range_of(options.get("cols"))}

    def partitions(self) -> Sequence[Split]:
        step = int(self.options.get("splitbytes", SPLIT_BYTES))
        return [Split(f.path, at, at + step) for f in listed(self.path)[1] for at in range(0, max(f.size, 1), step)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        with fs.open_input_file(partition.path) as file:
            header = read_header(lambda at, n: file.read_at(n, at))
            scene, top, left = placed(header, partition.path)
            rows, cols = self.within["row"], self.within["col"]
            for k, r, c, n, band in header.chunks():
                # of bands one after the other, the first wanted one's chunk carries the others'
                if band not in (None, self.bands[0] - 1) or not partition.start <= header.offsets[k] < partition.end:
                    continue
                r0, r1 = max(r, rows[0] - top), min(r + n, header.height, rows[1] - top)
                c0, c1 = max(c, cols[0] - left), min(c + header.chunk[1], header.width, cols[1] - left)
                if r0 >= r1 or c0 >= c1:
                    continue
                if band is None:
                    whole = decoded(file.read_at(header.sizes[k], header.offsets[k]), header, n, header.bands)
                    values = [whole[..., b - 1] for b in self.bands]
                else:
                    per = len(header.offsets) // header.bands
                    spots = [k + (b - self.bands[0]) * per for b in self.bands]
                    values = [decoded(file.read_at(header.sizes[s], header.offsets[s]), header, n, 1)[..., 0] for s in spots]
                yield self.batch(header, scene, values, (r0, r1, c0, c1), (r, c), (top, left))

    def batch(self, header: Header, scene: str, values: list[np.ndarray], window: tuple[int, int, int, int], at: tuple[int, int], base: tuple[int, int]) -> pa.RecordBatch:
        r0, r1, c0, c1 = window
        row, col = np.mgrid[r0:r1, c0:c1]
        columns = [pa.array([scene]).take(pa.array(np.zeros(row.size, np.int32))), pa.array((row + base[0]).ravel()), pa.array((col + base[1]).ravel())]
        for v in values:
            cut = v[r0 - at[0] : r1 - at[0], c0 - at[1] : c1 - at[1]]
            own = cut.astype(np.float64).ravel()
            gone = np.isnan(own)
            if header.nodata is not None and not isnan(header.nodata):
                gone |= own == np.float64(np.array(header.nodata).astype(header.dtype) if header.dtype.kind == "f" else header.nodata)
            columns.append(pa.array(own, mask=gone))
        return pa.RecordBatch.from_arrays(columns, names=["scene", "row", "col", *(f"b{b}" for b in self.bands)])


class PushedReader(RasterReader):
    """Takes comparisons of row and col with numbers from the query."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and len(f.attribute) == 1 else None
            if name not in self.within or not isinstance(f.value, int):
                yield f
                continue
            low, high = self.within[name]
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                low = max(low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                high = min(high, f.value + (not isinstance(f, LessThan)))
            self.within[name] = low, high


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class RasterWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        need = {"height", "width"} - set(options)
        if need:
            raise ValueError(f"options {sorted(need)} are needed to write rasters")
        if schema.names[:3] != ["scene", "row", "col"] or len(schema) < 4:
            raise ValueError("columns must be scene, row, col and the bands")
        self.path, self.overwrite, self.names = options["path"], overwrite, schema.names[3:]
        self.height, self.width, self.block = int(options["height"]), int(options["width"]), int(options.get("block", BLOCK))
        self.dtype = np.dtype(options.get("dtype", "float32"))
        self.transform = tuple(json.loads(options["transform"])) if "transform" in options else None
        self.epsg = int(options["epsg"]) if "epsg" in options else None
        self.told = float(options["nodata"]) if "nodata" in options else float("nan") if self.dtype.kind == "f" else None
        self.nodata = self.told or 0.0
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, place = opened(self.path)
        part = f"{place}/_temporary/{self.job}/{uuid.uuid4().hex}"
        fs.create_dir(part)
        files: list[tuple[str, str]] = []
        now, block = None, None

        def flush() -> None:
            scene, r, c = now
            h, w = block.shape[1:]
            a = self.transform
            moved = a and (a[0], a[1], a[0] * c * self.block + a[1] * r * self.block + a[2], a[3], a[4], a[3] * c * self.block + a[4] * r * self.block + a[5])
            told = json.dumps({"scene": scene, "row": r * self.block, "col": c * self.block})
            name = f"{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(now)).hex}.tif"
            with fs.open_output_stream(f"{part}/{name}") as out:
                out.write(tiff_bytes(block, moved, self.epsg, self.told, told))
            files.append((f"{part}/{name}", f"{place}/{name}"))

        for batch in iterator:
            if not len(batch):
                continue
            scenes = batch.column(0).cast(pa.string()).dictionary_encode()
            row, col = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            if (row < 0).any() or (col < 0).any() or (row >= self.height).any() or (col >= self.width).any():
                raise ValueError("a pixel lies outside of height and width")
            keys = np.stack([scenes.indices.to_numpy(zero_copy_only=False), row // self.block, col // self.block])
            cuts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)]))
            for a, b in zip(cuts, [*cuts[1:], len(row)], strict=True):
                key = (scenes.dictionary[int(keys[0, a])].as_py(), int(keys[1, a]), int(keys[2, a]))
                if key != now:
                    if now is not None:
                        flush()
                    now = key
                    size = min(self.block, self.height - key[1] * self.block), min(self.block, self.width - key[2] * self.block)
                    block = np.full((len(self.names), *size), self.nodata).astype(self.dtype)
                for i in range(len(self.names)):
                    values = batch.column(3 + i).slice(a, b - a).cast(pa.float64()).to_numpy(zero_copy_only=False)  # NULL becomes NaN
                    block[i, row[a:b] % self.block, col[a:b] % self.block] = np.where(np.isnan(values), self.nodata, values).astype(self.dtype)
        if now is not None:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, place = opened(self.path)
        kept = {to for m in messages if m for _, to in m.files}
        for message in messages:
            for made, to in message.files if message else ():
                fs.move(made, to)
        if self.overwrite:
            for f in listed(self.path)[1]:
                if f.path not in kept:
                    fs.delete_file(f.path)
        self.clean(fs, place)

    def abort(self, messages: list[Written | None]) -> None:
        self.clean(*opened(self.path))

    def clean(self, fs: pafs.FileSystem, place: str) -> None:
        if fs.get_file_info(f"{place}/_temporary/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{place}/_temporary/{self.job}")


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> StructType:
        fs, files = listed(self.options["path"])
        if not files:
            raise ValueError(f"no raster files in {self.options['path']}")
        with fs.open_input_file(files[0].path) as file:
            n = read_header(lambda at, size: file.read_at(size, at)).bands
        wanted = [int(b) for b in self.options["bands"].split(",")] if self.options.get("bands") else list(range(1, n + 1))
        if not all(1 <= b <= n for b in wanted) or len(set(wanted)) < len(wanted):
            raise ValueError(f"bands {wanted} of {n}")
        return StructType([StructField("scene", StringType()), StructField("row", LongType()), StructField("col", LongType()), *(StructField(f"b{b}", DoubleType()) for b in wanted)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushedReader if self.options.get("pushdown") == "true" else RasterReader)(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RasterWriter(dict(self.options), schema, overwrite)


def read_rasters(spark: SparkSession, path: str, bands: list[int] | None = None, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """Pixels of the raster files at a path: scene, row, col, and the wanted (1-based) bands as b1, b2, ...; chunks outside the half-open ranges aren't read."""
    spark.dataSource.register(RasterSource)
    told = {"bands": bands and ",".join(map(str, bands)), "rows": rows and f"{rows[0]}:{rows[1]}", "cols": cols and f"{cols[0]}:{cols[1]}"}
    return spark.read.format("raster").options(**{k: v for k, v in told.items() if v}).load(path)


def write_rasters(df: DataFrame, path: str, names: list[str], height: int, width: int, transform: tuple[float, ...] | None = None, epsg: int | None = None, nodata: float | None = None, dtype: str = "float32", block: int = BLOCK, mode: str = "overwrite") -> None:
    """Pixels (scene_id, row, col and the columns ``names``) as raster files of a block of a scene each; a pixel without a row has nodata."""
    df.sparkSession.dataSource.register(RasterSource)
    rows = nodata_to_null(df, names, nodata).select(F.col("scene_id").cast("string").alias("scene"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *names)
    at = [F.expr(f"{x} div {block}") for x in ("row", "col")]
    told = {"height": height, "width": width, "block": block, "dtype": dtype, "transform": transform and json.dumps(list(transform)), "epsg": epsg, "nodata": nodata}
    rows.repartition("scene", *at).sortWithinPartitions("scene", *at).write.format("raster").options(**{k: str(v) for k, v in told.items() if v is not None}).mode(mode).save(path)
