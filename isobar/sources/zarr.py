"""Gridded stores in the Zarr (version 2) layout, as a Spark data source.

A store holds one array a field over the dimensions ``time, [ens,] [lev,] lat,
lon`` (any subset and order), cut into chunks, and one array for each
coordinate; arrays name their dimensions in ``_ARRAY_DIMENSIONS``, as labelled
array libraries do.  Rows of the source are long fields: ``field, year, [season
| month,] [ens,] [lev,] lat, lon, value``.

Reading: one partition for each chunk.  Only metadata and coordinates are read
for planning; chunks that hold no field, year, or place asked for (options of
``load_zarr``, or filters that Spark pushes down where
``spark.sql.python.filterPushdown.enabled`` is on) are not opened.  A chunk
that is absent has the fill value, that is null.

Writing: rows are dealt by chunk, so a chunk has one writer, which holds one
chunk at a time.  Chunks are written beside the store under names of their own
and moved into place when all tasks have ended; the metadata, without which
nothing can read the store, come last.  A task that is lost leaves a file that
nobody names.

Times are decimal years with an attribute ``resolution`` (``season``, ``month``
or ``year``), or CF times (``days since ...`` in the calendars ``noleap``,
``360_day``, ``standard`` and their other names), which are read as months.
"""

from __future__ import annotations

import datetime
import gzip
import itertools
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

#: Values of a coordinate.
AXIS = 1 << 20
#: Bytes of the largest chunk that is written.
CHUNK_BYTES = 256 << 20
DIMENSIONS = ("time", "ens", "lev", "lat", "lon")
#: Names that other programs give the dimensions.
_ALIASES = {"latitude": "lat", "longitude": "lon", "plev": "lev", "level": "lev", "depth": "lev", "member": "ens", "number": "ens"}
_KINDS = {"year": "int", "season": "int", "month": "int", "ens": "int", "lev": "double", "lat": "double", "lon": "double"}


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``path`` and the path in it; paths without a scheme are local."""
    if "://" in path or path.startswith("file:/"):
        fs, p = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
        return fs, p.rstrip("/")
    return pafs.LocalFileSystem(), path.rstrip("/")


def _get(fs: pafs.FileSystem, path: str) -> bytes | None:
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def _put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    with fs.open_output_stream(path, compression=None) as f:
        f.write(data)


# -- arrays -------------------------------------------------------------------


def _unpacked(data: bytes, codec: dict | None) -> bytes:
    kind = (codec or {}).get("id")
    if kind is None:
        return data
    if kind == "zlib":
        return zlib.decompress(data)
    if kind == "gzip":
        return gzip.decompress(data)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"compressor {kind} is not supported")


@dataclass
class Array:
    """One array of a store: its metadata, and how a chunk becomes numbers."""

    meta: dict
    attrs: dict

    def __post_init__(self):
        if self.meta.get("zarr_format") != 2 or self.meta.get("filters"):
            raise ValueError("only Zarr format 2 without filters is supported")

    @cached_property
    def dims(self) -> list[str]:
        return [_ALIASES.get(n, n) for n in self.attrs.get("_ARRAY_DIMENSIONS", [])]

    @property
    def shape(self) -> list[int]:
        return self.meta["shape"]

    @property
    def chunks(self) -> list[int]:
        return self.meta["chunks"]

    def key(self, at: tuple[int, ...]) -> str:
        return self.meta.get("dimension_separator", ".").join(map(str, at)) or "0"

    def grid(self) -> list[range]:
        return [range(-(-n // c)) for n, c in zip(self.shape, self.chunks, strict=True)]

    def values(self, data: bytes | None, at: tuple[int, ...]) -> np.ndarray:
        """The part of a chunk that is inside the array, as doubles; NaN where nothing is recorded."""
        size = [min(c, n - k * c) for k, c, n in zip(at, self.chunks, self.shape, strict=True)]
        fill = self.meta.get("fill_value")
        if data is None:
            x = np.full(size, np.nan if fill is None or fill == "NaN" else float(fill))
        else:
            x = np.frombuffer(_unpacked(data, self.meta.get("compressor")), np.dtype(self.meta["dtype"])).reshape(self.chunks, order=self.meta.get("order", "C"))
            x = x[tuple(slice(n) for n in size)].astype(np.float64)
        for missing in (fill, self.attrs.get("_FillValue"), self.attrs.get("missing_value")):
            if isinstance(missing, (int, float)) and not math.isnan(missing):
                x = np.where(x == missing, np.nan, x)
        return x * self.attrs.get("scale_factor", 1) + self.attrs.get("add_offset", 0)


class Store:
    """Metadata and coordinates of a store."""

    def __init__(self, path: str):
        self.path = path
        self.fs, self.root = _place(path)
        packed = _get(self.fs, f"{self.root}/.zmetadata")
        if packed is not None:
            meta = json.loads(packed)["metadata"]
        else:  # every array by itself
            meta = {}
            if _get(self.fs, f"{self.root}/.zgroup") is None:
                raise ValueError(f"no Zarr group at {path}")
            for e in self.fs.get_file_info(pafs.FileSelector(self.root)):
                if e.type == pafs.FileType.Directory:
                    for n in (".zarray", ".zattrs"):
                        if (data := _get(self.fs, f"{e.path}/{n}")) is not None:
                            meta[f"{e.base_name}/{n}"] = json.loads(data)
        self.arrays = {k.removesuffix("/.zarray"): Array(m, meta.get(k.replace(".zarray", ".zattrs"), {})) for k, m in meta.items() if k.endswith("/.zarray")}

    def whole(self, name: str) -> np.ndarray:
        """A coordinate, read at once."""
        a = self.arrays[name]
        if len(a.shape) != 1 or a.shape[0] > AXIS:
            raise ValueError(f"coordinate {name} has shape {a.shape}: one dimension of at most {AXIS} is supported")
        plain = Array(a.meta | {"fill_value": None}, {k: v for k, v in a.attrs.items() if k in ("scale_factor", "add_offset", "_ARRAY_DIMENSIONS")})
        return np.concatenate([plain.values(_get(self.fs, f"{self.root}/{name}/{a.key((k,))}"), (k,)) for k in a.grid()[0]] or [np.zeros(0)])

    @cached_property
    def fields(self) -> list[str]:
        known = set(DIMENSIONS)
        return sorted(n for n, a in self.arrays.items() if a.dims and set(a.dims) <= known and _ALIASES.get(n, n) not in known)

    @cached_property
    def coordinates(self) -> dict[str, dict[str, np.ndarray]]:
        """Columns of each dimension that a field has, by position."""
        names = {_ALIASES.get(n, n): n for n in self.arrays}
        out = {}
        for d in DIMENSIONS:
            if any(d in self.arrays[f].dims for f in self.fields):
                if d not in names:
                    n = next(self.arrays[f].shape[self.arrays[f].dims.index(d)] for f in self.fields if d in self.arrays[f].dims)
                    if d == "time":
                        raise ValueError("a store without times is not a field")
                    out[d] = {d: np.arange(n)}
                elif d == "time":
                    out[d] = time_columns(self.whole(names[d]), self.arrays[names[d]].attrs)
                else:
                    x = self.whole(names[d])
                    out[d] = {d: x.astype(np.int64) if d == "ens" else x}
        return out

    @property
    def columns(self) -> list[str]:
        return [c for d in DIMENSIONS if d in self.coordinates for c in self.coordinates[d]]

    def ddl(self) -> str:
        return ", ".join(["field string", *[f"{c} {_KINDS[c]}" for c in self.columns], "value double"])


def time_columns(t: np.ndarray, attrs: dict) -> dict[str, np.ndarray]:
    """``year`` with ``season`` or ``month`` of a time axis."""
    if " since " in attrs.get("units", ""):
        return cf_months(t, attrs["units"], attrs.get("calendar", "standard"))
    kind = attrs.get("resolution", "season")
    if kind == "year":
        return {"year": np.floor(t).astype(np.int64)}
    if kind == "month":
        k = np.floor(t * 12 + 1e-6).astype(np.int64)
        return {"year": k // 12, "month": k % 12 + 1}
    # A season's middle: 0.5 months into the year for winter, then every three months.
    k = np.round(t * 4 - 0.5 / 3).astype(np.int64)
    return {"year": k // 4, "season": k % 4}


_MONTHS = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])


def cf_months(t: np.ndarray, units: str, calendar: str) -> dict[str, np.ndarray]:
    step, start = units.split(" since ")
    per_day = {"days": 1, "day": 1, "hours": 24, "hour": 24, "minutes": 1440, "seconds": 86400}.get(step.strip())
    if per_day is None:
        raise ValueError(f"times in {step} are not supported")
    y, m, d = (int(x) for x in start.replace("T", " ").split(" ")[0].split("-"))
    clock = [float(x) for x in start.replace("T", " ").split(" ")[1].split(":")] if len(start.replace("T", " ").split(" ")) > 1 and ":" in start else []
    days = t / per_day + sum(x / s for x, s in zip(clock, (24, 1440, 86400), strict=False))
    if calendar in ("noleap", "365_day"):
        first = np.concatenate([[0], np.cumsum(_MONTHS)])
        day = np.floor(days + y * 365 + first[m - 1] + d - 1 + 1e-9).astype(np.int64)
        return {"year": day // 365, "month": np.searchsorted(first, day % 365, side="right")}
    if calendar == "360_day":
        day = np.floor(days + y * 360 + (m - 1) * 30 + d - 1 + 1e-9).astype(np.int64)
        return {"year": day // 360, "month": day % 360 // 30 + 1}
    if calendar in ("standard", "gregorian", "proleptic_gregorian"):
        if calendar != "proleptic_gregorian" and y < 1583 and len(t):
            raise ValueError("standard calendars that begin before 1583 are not supported")
        zero = datetime.date(y, m, d).toordinal()
        when = [datetime.date.fromordinal(int(zero + np.floor(x + 1e-9))) for x in days]
        return {"year": np.array([w.year for w in when], np.int64), "month": np.array([w.month for w in when], np.int64)}
    raise ValueError(f"calendar {calendar} is not supported")


# -- source -------------------------------------------------------------------


@dataclass
class Chunk(ds.InputPartition):
    field: str
    at: tuple[int, ...]


class Reader(ds.DataSourceReader):
    """Chunks that can hold a row within ``fields`` and ``bounds`` (column: lowest and highest value)."""

    def __init__(self, path: str, fields: list[str] | None, bounds: dict[str, tuple[float, float]]):
        self.path, self.fields, self.bounds = path, fields, dict(bounds)

    def partitions(self) -> list[Chunk]:
        store = Store(self.path)
        out = []
        for f in store.fields:
            if self.fields is not None and f not in self.fields:
                continue
            a = store.arrays[f]
            some = []
            for d, c, ks in zip(a.dims, a.chunks, a.grid(), strict=True):
                inside = np.ones(a.shape[a.dims.index(d)], bool)
                for name, x in store.coordinates[d].items():
                    low, high = self.bounds.get(name, (-math.inf, math.inf))
                    inside &= (x >= low) & (x <= high)
                some.append([k for k in ks if inside[k * c : (k + 1) * c].any()])
            out += [Chunk(f, at) for at in itertools.product(*some)]
        return out

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        store = Store(self.path)
        a = store.arrays[partition.field]
        x = a.values(_get(store.fs, f"{store.root}/{partition.field}/{a.key(partition.at)}"), partition.at)
        columns = {}
        keep = np.ones(x.shape, bool)
        for axis, (d, c, k) in enumerate(zip(a.dims, a.chunks, partition.at, strict=True)):
            for name, v in store.coordinates[d].items():
                part = v[k * c : (k + 1) * c].reshape([-1 if i == axis else 1 for i in range(x.ndim)])
                low, high = self.bounds.get(name, (-math.inf, math.inf))
                keep &= (part >= low) & (part <= high)
                columns[name] = np.broadcast_to(part, x.shape)
        value = x[keep]
        n = len(value)
        kinds = {"int": pa.int32(), "double": pa.float64()}
        cells = {c: pa.array(columns[c][keep], kinds[_KINDS[c]]) if c in columns else pa.nulls(n, kinds[_KINDS[c]]) for c in store.columns}
        batch = pa.record_batch([pa.array([partition.field]).take(pa.array(np.zeros(n, np.int64))), *cells.values(), pa.array(value, mask=np.isnan(value))], names=["field", *cells, "value"])
        for s in range(0, n, 1 << 16):
            yield batch.slice(s, 1 << 16)


class PushingReader(Reader):
    """With filters that Spark pushes down; all are evaluated again after the scan, as a chunk holds more than they ask for."""

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "field" and isinstance(f, (ds.EqualTo, ds.In)):
                some = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
                self.fields = sorted(some if self.fields is None else some & set(self.fields))
            elif name in _KINDS and getattr(f, "value", None) is not None:
                low, high = self.bounds.get(name, (-math.inf, math.inf))
                v = (min(f.value), max(f.value)) if isinstance(f, ds.In) and f.value else (f.value, f.value)
                if isinstance(f, (ds.EqualTo, ds.In, ds.GreaterThan, ds.GreaterThanOrEqual)):
                    low = max(low, math.nextafter(v[0], math.inf) if isinstance(f, ds.GreaterThan) else v[0])
                if isinstance(f, (ds.EqualTo, ds.In, ds.LessThan, ds.LessThanOrEqual)):
                    high = min(high, math.nextafter(v[1], -math.inf) if isinstance(f, ds.LessThan) else v[1])
                self.bounds[name] = (low, high)
            yield f


# -- sink ---------------------------------------------------------------------


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[tuple[str, str, str]]


class Writer(ds.DataSourceArrowWriter):
    """Rows ``field, chunk, place, value``, all of a chunk one after the other, into chunks of the layout given as options."""

    def __init__(self, path: str, layout: dict):
        self.path, self.layout, self.staging = path, layout, f".staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _place(self.path)
        done: list[tuple[str, str, str]] = []
        dtype, size = np.dtype(self.layout["dtype"]), math.prod(self.layout["chunks"])
        name, buffer, filled = None, None, None

        def close() -> None:
            if name is not None:
                temp = f"{self.staging}/{uuid.uuid4().hex}"
                fs.create_dir(f"{root}/{self.staging}", recursive=True)
                _put(fs, f"{root}/{temp}", zlib.compress(buffer.tobytes(), 1))
                done.append((*name, temp))

        for rb in iterator:
            field, chunk = np.asarray(rb.column("field")), np.asarray(rb.column("chunk"))
            place, value = np.asarray(rb.column("place")), rb.column("value").fill_null(math.nan).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero((field[1:] != field[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            for s, e in zip([0, *edge], [*edge, len(field)], strict=True):
                if s == e:
                    continue
                if (field[s], int(chunk[s])) != name:
                    close()
                    name, buffer, filled = (field[s], int(chunk[s])), np.full(size, np.nan, dtype), np.zeros(size, bool)
                at = place[s:e]
                if filled[at].any() or len(np.unique(at)) < len(at):
                    raise ValueError(f"several values for one place of {field[s]}")
                buffer[at], filled[at] = value[s:e], True
        close()
        return Written(done)

    def commit(self, messages) -> None:
        fs, root = _place(self.path)
        lay = self.layout
        grid = [-(-n // c) for n, c in zip(lay["shape"], lay["chunks"], strict=True)]
        files = [f for m in messages if m is not None for f in m.files]
        if len({f[:2] for f in files}) < len(files):
            raise ValueError("a chunk was written by two tasks: rows must be dealt by chunk")
        meta: dict[str, dict] = {".zgroup": {"zarr_format": 2}, ".zattrs": lay["attrs"]}

        def array(name: str, dims: list[str], shape: list[int], chunks: list[int], dtype: str, attrs: dict) -> None:
            fs.create_dir(f"{root}/{name}", recursive=True)
            meta[f"{name}/.zarray"] = {"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": dtype, "compressor": {"id": "zlib", "level": 1}, "fill_value": "NaN", "order": "C", "filters": None}
            meta[f"{name}/.zattrs"] = {"_ARRAY_DIMENSIONS": dims} | attrs

        for f in lay["fields"]:
            array(f, lay["dims"], lay["shape"], lay["chunks"], lay["dtype"], {})
        for d, v in lay["coordinates"].items():
            array(d, [d], [len(v)], [max(1, len(v))], "<f8", lay["time"] if d == "time" else {})
            _put(fs, f"{root}/{d}/0", zlib.compress(np.array(v, "<f8").tobytes(), 1))
        for field, chunk, temp in files:
            fs.move(f"{root}/{temp}", f"{root}/{field}/{'.'.join(map(str, np.unravel_index(chunk, grid)))}")
        for k, m in meta.items():
            _put(fs, f"{root}/{k}", json.dumps(m).encode())
        _put(fs, f"{root}/.zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": meta}).encode())
        self._clear(fs, root)

    def abort(self, messages) -> None:
        self._clear(*_place(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.staging}")


class ZarrSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "zarr"

    def schema(self) -> str:
        return Store(self.options["path"]).ddl()

    def reader(self, schema) -> Reader:
        fields = json.loads(self.options["fields"]) if "fields" in self.options else None
        bounds = {k: tuple(v) for k, v in json.loads(self.options.get("bounds", "{}")).items()}
        return (PushingReader if self.options.get("push") == "true" else Reader)(self.options["path"], fields, bounds)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], json.loads(self.options["layout"]))


def load_zarr(spark: SparkSession, path: str, fields: list[str] | None = None, years: tuple[int, int] | None = None, **bounds: tuple[float, float]) -> DataFrame:
    """Long fields of a store; ``years`` and bounds of other columns (``lat=(-30, 30)``) are inclusive."""
    spark.dataSource.register(ZarrSource)
    if unknown := set(bounds) - set(_KINDS):
        raise ValueError(f"no columns {sorted(unknown)}")
    limits = bounds | ({"year": years} if years else {})
    reader = spark.read.format("zarr").option("bounds", json.dumps({k: list(v) for k, v in limits.items()})).option("push", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (reader.option("fields", json.dumps(fields)) if fields is not None else reader).load(path)


def save_zarr(df: DataFrame, path: str, chunks: dict[str, int] | None = None, double: bool = False, attrs: dict | None = None) -> None:
    """Writes long fields ``field, year[, season | month][, ens][, lev], lat, lon, value``; an existing store is an error.

    ``chunks`` gives the extent of a chunk by dimension (default: 100 times,
    one member, the rest whole).  All fields share the coordinates that occur;
    places without a row, and null values, become missing.  Null coordinates
    and several values for one place are errors.
    """
    spark = df.sparkSession
    fs, root = _place(path)
    if any(fs.get_file_info(f"{root}/{n}").type != pafs.FileType.NotFound for n in (".zmetadata", ".zgroup")):
        raise ValueError(f"{path} exists")
    step = next((c for c in ("season", "month") if c in df.columns), None)
    t = {"season": F.col("year") + (F.col("season") * 3 + 0.5) / 12, "month": F.col("year") + (F.col("month") - 0.5) / 12}.get(step, F.col("year").cast("double"))
    dims = [d for d in DIMENSIONS if d == "time" or d in df.columns]
    rows = df.select("field", t.alias("time"), *[F.col(d).cast("double").alias(d) for d in dims[1:]], F.col("value").cast("double").alias("value"))
    names = [r[0] for r in rows.select("field").distinct().limit(AXIS).collect()]
    axes: dict[str, list[float]] = {}
    for d in dims:  # one coordinate each
        axes[d] = sorted((r[0] for r in rows.select(d).distinct().limit(AXIS + 1).collect()), key=lambda x: (x is not None, x))
        if len(axes[d]) > AXIS or None in axes[d]:
            raise ValueError(f"{d} has nulls or more than {AXIS} values")
    shape = [len(axes[d]) for d in dims]
    size = [max(1, min((chunks or {}).get(d, {"time": 100, "ens": 1}.get(d, n)), n)) for d, n in zip(dims, shape, strict=True)]
    if math.prod(size) * 8 > CHUNK_BYTES:
        raise ValueError(f"chunks of {size} are more than {CHUNK_BYTES} bytes")
    chunk, place = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
    for d, n, c in zip(dims, shape, size, strict=True):
        index = spark.createDataFrame([(x, k) for k, x in enumerate(axes[d])], f"{d} double, _{d} bigint")
        rows = rows.join(F.broadcast(index), d)  # one coordinate, at most AXIS values
        chunk = chunk * -(-n // c) + F.floor(F.col(f"_{d}") / c)
        place = place * c + F.col(f"_{d}") % c
    layout = {"dims": dims, "shape": shape, "chunks": size, "dtype": "<f8" if double else "<f4", "fields": sorted(names), "coordinates": axes, "time": {"resolution": step or "year", "units": "years"}, "attrs": attrs or {}}
    dealt = rows.select("field", chunk.cast("bigint").alias("chunk"), place.cast("bigint").alias("place"), "value").repartition("field", "chunk").sortWithinPartitions("field", "chunk")
    spark.dataSource.register(ZarrSource)
    dealt.write.format("zarr").option("layout", json.dumps(layout)).mode("append").save(path)
