"""Cube files: labels, windows of pixels, and the Spark data source ``isis``.

``spark.read.format("isis").load(path)`` gives (cube, band, line, sample, value), one row a pixel, NULL where there is
no data; with ``option("blocks", "true")`` one row a window: (cube, band, y0, x0, h, w, data), little-endian doubles
with NaN. Filters on band, line and sample cut the windows that are read, when Spark pushes them
(``spark.sql.python.filterPushdown.enabled``). ``option("raw", "true")`` leaves out the stored scaling.
Only label text is read to plan; each task opens the file itself and reads its window alone.
"""

from __future__ import annotations

import fnmatch
import math
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions.bodies import CENTRIC, D2R, GRAPHIC, Body, convert_latitude, wrap_longitude
from ..functions.projections import Params, Projection, build, canonical_name
from ..raster import BY_ISIS, Grid, PixelType
from .files import file_size, is_address, list_folder, open_input
from .pvl import Node, PvlError, parse


class CubeError(ValueError):
    pass


@dataclass
class Cube:
    """What a label tells."""

    path: str
    label: Node = field(repr=False)
    w: int = 0
    h: int = 0
    bands: int = 0
    type: PixelType | None = None
    big_endian: bool = False
    base: float = 0.0
    multiplier: float = 1.0
    start: int = 0
    data_path: str = ""
    tile: tuple[int, int] | None = None  # samples, lines
    band_names: list[str] | None = None
    mapping: Node | None = field(default=None, repr=False)
    projection: Projection | None = None
    projection_error: str = ""
    grid: Grid | None = None

    @property
    def has_scaling(self) -> bool:
        return self.base != 0 or self.multiplier != 1

    @property
    def latitude_kind(self) -> str:
        return mapping_latitude_kind(self.mapping) if self.mapping else CENTRIC

    def center(self) -> tuple[float, float]:
        """Middle of the map: east longitude and planetocentric latitude in degrees."""
        m, body = self.mapping, self.projection.body
        keys = ("MinimumLatitude", "MaximumLatitude", "MinimumLongitude", "MaximumLongitude")
        if all(m.key(k) is not None for k in keys):
            south, north, west, east = (m.number(k, 0.0) for k in keys)
            lon, lat = (west + east) / 2, (south + north) / 2
            if m.text("LongitudeDirection").lower() == "positivewest":
                lon = -lon
            lat = float(convert_latitude(np.float64(lat * D2R), body, self.latitude_kind, CENTRIC)) / D2R
            return float(wrap_longitude(np.float64(lon * D2R))) / D2R + 0.0, lat + 0.0
        lon, lat = self.projection.inverse(np.float64(self.grid.x0 + self.w / 2 * self.grid.resx), np.float64(self.grid.y0 - self.h / 2 * self.grid.resy))
        if math.isnan(lon):
            return self.projection.lon0 / D2R, 0.0
        return float(wrap_longitude(lon)) / D2R, float(lat) / D2R


def mapping_latitude_kind(m: Node) -> str:
    return GRAPHIC if m.text("LatitudeType").lower() == GRAPHIC else CENTRIC


def mapping_projection(m: Node) -> Projection:
    """The projection that a Mapping group describes."""
    name = m.text("ProjectionName")
    try:
        canonical = canonical_name(name)
    except ValueError:
        canonical = "geographic"
    if canonical == "geographic":
        raise CubeError(f"ISIS projection {name!r} is not supported")
    a = m.number("EquatorialRadius")
    clon, clat, par1 = m.number("CenterLongitude", 0.0), m.number("CenterLatitude", 0.0), m.number("FirstStandardParallel", 0.0)
    if m.text("LongitudeDirection").lower() == "positivewest":
        clon = -clon + (360 if clon >= 180 else 0)
    if canonical == "polarstereographic" and clat == 0:
        clat = -90.0 if m.number("MinimumLatitude", 0.0) + m.number("MaximumLatitude", 0.0) < 0 else 90.0
    radius = m.number("CenterLatitudeRadius", 0.0) if canonical == "equirectangular" else 0.0
    return build(Params(canonical, Body(m.text("TargetName"), a, m.number("PolarRadius", a)), mapping_latitude_kind(m), clon, clat, par1, m.number("SecondStandardParallel", par1), m.number("ScaleFactor", 0.0), radius))


def _read_label(path: str, most: int = 256 << 20) -> Node:
    """The label at the head of a file, read in growing pieces up to its End."""
    size = 64 << 10
    with open_input(path) as f:
        while True:
            f.seek(0)
            head = f.read(size)
            try:
                root, complete = parse(head.decode("latin-1"))
            except PvlError:
                root, complete = None, False
            if complete or len(head) < size or size >= most:
                if root is None:
                    parse(head.decode("latin-1"))
                return root
            size = min(most, size * 4)


def open_cube(path: str) -> Cube:
    """Reads and checks a label; raises CubeError for what can't be a cube."""
    try:
        label = _read_label(path)
        root = label.child("IsisCube")
        core = root and root.child("Core")
        dims, pixels = (core and core.child("Dimensions")), (core and core.child("Pixels"))
        if not root:
            raise CubeError("not an ISIS3 cube (no IsisCube object in label)")
        if not (core and dims and pixels):
            raise CubeError("label is missing Core, Dimensions or Pixels")
        c = Cube(path, label, dims.integer("Samples"), dims.integer("Lines"), dims.integer("Bands"))
        if min(c.w, c.h, c.bands) <= 0:
            raise CubeError(f"invalid dimensions {c.w}x{c.h}x{c.bands}")
        c.type = BY_ISIS.get(pixels.text("Type").lower())
        if c.type is None:
            raise CubeError(f"unsupported pixel type {pixels.text('Type')!r}")
        c.big_endian = pixels.text("ByteOrder").lower() == "msb"
        c.base, c.multiplier = pixels.number("Base", 0.0), pixels.number("Multiplier", 1.0)
        c.start = core.integer("StartByte", 1) - 1
        pointer = core.text("^Core")
        c.data_path = os.path.join(os.path.dirname(path), pointer) if pointer else path
        layout = core.text("Format").lower()
        if layout == "tile":
            c.tile = core.integer("TileSamples", 0), core.integer("TileLines", 0)
            if min(c.tile) <= 0:
                raise CubeError(f"invalid tile size {c.tile[0]}x{c.tile[1]}")
        elif layout not in ("bandsequential", "bsq", ""):
            raise CubeError(f"unsupported cube format {core.text('Format')!r}")
        w, h = (c.w, c.h) if not c.tile else (-(-c.w // c.tile[0]) * c.tile[0], -(-c.h // c.tile[1]) * c.tile[1])
        need, size = c.start + w * h * c.bands * c.type.size, file_size(c.data_path)
        if size < need:
            raise CubeError(f"file is truncated: {size} bytes, cube needs {need}")
    except (PvlError, OSError) as e:
        raise CubeError(f"{path}: {e}") from e
    bins = root.child("BandBin")
    for k in ("FilterName", "Name", "Center", "OriginalBand") if bins else ():
        if len(bins.key(k) or []) == c.bands:
            c.band_names = bins.key(k)
            break
    c.mapping = root.child("Mapping")
    if c.mapping:
        try:
            p = mapping_projection(c.mapping)
            res = c.mapping.number("PixelResolution")
            if res <= 0:
                raise PvlError("PixelResolution must be positive")
            c.grid = Grid(c.w, c.h, c.mapping.number("UpperLeftCornerX"), c.mapping.number("UpperLeftCornerY"), res, res)
            c.projection = p
        except ValueError as e:
            c.projection_error = str(e)
    return c


def read_window(c: Cube, band: int, x0: int, y0: int, w: int, h: int) -> np.ndarray:
    """Stored numbers of a window (h, w) in native order; band from 0."""
    if not (0 <= band < c.bands and 0 <= x0 and 0 <= y0 and w > 0 and h > 0 and x0 + w <= c.w and y0 + h <= c.h):
        raise CubeError(f"window {x0},{y0} {w}x{h} of band {band} is outside of {c.w}x{c.h}x{c.bands}")
    kind = c.type.dtype.newbyteorder(">" if c.big_endian else "<")
    out = np.empty((h, w), c.type.dtype)
    with open_input(c.data_path) as f:

        def numbers(offset: int, n: int) -> np.ndarray:
            f.seek(c.start + offset * c.type.size)
            data = f.read(n * c.type.size)
            if len(data) < n * c.type.size:
                raise CubeError(f"{c.data_path}: short read")
            return np.frombuffer(data, kind)

        if not c.tile:
            at = band * c.w * c.h
            if w == c.w:
                out[:] = numbers(at + y0 * c.w, w * h).reshape(h, w)
            else:
                for r in range(h):
                    out[r] = numbers(at + (y0 + r) * c.w + x0, w)
            return out
        ts, tl = c.tile
        across, down = -(-c.w // ts), -(-c.h // tl)
        for ty in range(y0 // tl, (y0 + h - 1) // tl + 1):
            top, bottom = max(y0, ty * tl), min(y0 + h, (ty + 1) * tl)
            for tx in range(x0 // ts, (x0 + w - 1) // ts + 1):
                left, right = max(x0, tx * ts), min(x0 + w, (tx + 1) * ts)
                first = ((band * down + ty) * across + tx) * ts * tl
                rows = numbers(first + (top - ty * tl) * ts, (bottom - top) * ts).reshape(-1, ts)
                out[top - y0 : bottom - y0, left - x0 : right - x0] = rows[:, left - tx * ts : right - tx * ts]
    return out


def decode(c: Cube, stored: np.ndarray, raw: bool = False) -> np.ndarray:
    """Doubles of stored numbers: NaN for special pixels, scaled unless ``raw``."""
    v = stored.astype(np.float64)
    low, high = c.type.valid
    good = (v >= low) & (v <= high)
    if c.type.is_float:
        good &= np.isfinite(v)
    v = np.where(good, v, np.nan)
    return v if raw or not c.has_scaling else v * c.multiplier + c.base


def expand_inputs(args: list[str]) -> list[str]:
    """Files of arguments: a file, a folder (its *.cub in any case), or a pattern in the last part of a path."""
    out: list[str] = []
    for a in args:
        if (inside := list_folder(a)) is not None:
            found = match_names(inside, "*.cub")
        elif any(x in os.path.basename(a) for x in "*?["):
            found = match_names(list_folder(os.path.dirname(a) or ".") or [], os.path.basename(a))
        else:
            found = [a] if is_address(a) or os.path.isfile(a) else []
        if not found:
            raise FileNotFoundError(f"no such file, or no cubes in: {a!r}")
        out += found
    return out


def match_names(paths: list[str], pattern: str) -> list[str]:
    """The paths whose last part matches, case ignored."""
    return [p for p in paths if fnmatch.fnmatchcase(os.path.basename(p).lower(), pattern.lower())]


PIXELS = "cube string, band int, line int, sample int, value double"
BLOCKS = "cube string, band int, y0 int, x0 int, h int, w int, data binary"


@dataclass
class Window(InputPartition):
    path: str
    band: int  # from 0
    y0: int
    x0: int
    h: int
    w: int


class IsisReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = expand_inputs(options["path"].split(","))
        self.raw = options.get("raw", "false").lower() == "true"
        self.blocks = options.get("blocks", "false").lower() == "true"
        self.edge = int(options.get("window", 1024))
        self.limits = {"band": (1, math.inf), "line": (0, math.inf), "sample": (0, math.inf)}
        self.chosen: set[int] | None = None

    def pushFilters(self, filters):
        """Uses what bounds band, line or sample; Spark keeps the filters it must still check."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in self.limits and not self.blocks or name == "band":
                low, high = self.limits[name]
                if isinstance(f, EqualTo):
                    low, high = max(low, f.value), min(high, f.value)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    high = min(high, f.value - isinstance(f, LessThan))
                elif isinstance(f, In) and name == "band":
                    self.chosen = set(f.value)
                self.limits[name] = low, high
            yield f

    def partitions(self) -> list[Window]:
        out = []
        (b0, b1), (l0, l1), (s0, s1) = (self.limits[k] for k in ("band", "line", "sample"))
        with ThreadPoolExecutor(16) as pool:  # labels are small, and may lie in a store far away
            cubes = list(pool.map(open_cube, self.paths))
        for path, c in zip(self.paths, cubes):
            x0, x1 = max(0, s0), min(c.w - 1, s1)
            y0, y1 = max(0, l0), min(c.h - 1, l1)
            for band in range(c.bands):
                if not b0 <= band + 1 <= b1 or self.chosen is not None and band + 1 not in self.chosen:
                    continue
                for y in range(int(y0), int(y1) + 1, self.edge):
                    for x in range(int(x0), int(x1) + 1, self.edge):
                        out.append(Window(path, band, y, x, int(min(self.edge, y1 + 1 - y)), int(min(self.edge, x1 + 1 - x))))
        return out or [Window("", 0, 0, 0, 0, 0)]  # Spark wants one partition at least

    def read(self, part: Window) -> Iterator[pa.RecordBatch]:
        if not part.h:
            return
        c = open_cube(part.path)
        if self.blocks:
            data = decode(c, read_window(c, part.band, part.x0, part.y0, part.w, part.h), self.raw)
            yield pa.RecordBatch.from_pydict({"cube": [part.path], "band": pa.array([part.band + 1], pa.int32()), **{k: pa.array([getattr(part, k)], pa.int32()) for k in ("y0", "x0", "h", "w")}, "data": [data.astype("<f8").tobytes()]})
            return
        rows = max(1, 100_000 // part.w)
        for y in range(part.y0, part.y0 + part.h, rows):
            h = min(rows, part.y0 + part.h - y)
            value = decode(c, read_window(c, part.band, part.x0, y, part.w, h), self.raw).ravel()
            n = len(value)
            line, sample = np.repeat(np.arange(y, y + h, dtype=np.int32), part.w), np.tile(np.arange(part.x0, part.x0 + part.w, dtype=np.int32), h)
            cube = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([part.path])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([cube, pa.array(np.full(n, part.band + 1, np.int32)), pa.array(line), pa.array(sample), pa.array(value, from_pandas=True)], names=["cube", "band", "line", "sample", "value"])


class IsisSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "isis"

    def schema(self) -> str:
        return BLOCKS if self.options.get("blocks", "false").lower() == "true" else PIXELS

    def reader(self, schema) -> IsisReader:
        return IsisReader(dict(self.options))


def register(spark) -> None:
    """Makes the format ``isis`` known to a session, and lets Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IsisSource)


INFO = "path string, samples int, lines int, bands int, type string, byte_order string, base double, multiplier double, format string, band_names array<string>, projection string, latitude_type string, resolution double, x0 double, y0 double, error string"


def cube_info(spark, paths: list[str]):
    """A row for each file: what its label tells, or why it can't be read. Labels are read by tasks."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            rows = []
            for path in frame["path"]:
                try:
                    c = open_cube(path)
                except CubeError as e:
                    rows.append((path, *[None] * 14, str(e)))
                    continue
                p, g = c.projection, c.grid
                rows.append((path, c.w, c.h, c.bands, c.type.name, "Msb" if c.big_endian else "Lsb", c.base, c.multiplier, f"Tile {c.tile[0]}x{c.tile[1]}" if c.tile else "BandSequential", c.band_names, p and p.title, p and c.latitude_kind, g and g.resx, g and g.x0, g and g.y0, c.projection_error or None))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in INFO.split(", ")])
            yield out.astype({k: "Int32" for k in ("samples", "lines", "bands")})

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInPandas(run, INFO)


def summary(info):
    """One row over :func:`cube_info`: readable and unreadable files, mapped ones, bands, and the first mapped file by path."""
    from pyspark.sql import functions as F

    read, mapped = F.col("samples").isNotNull(), F.col("projection").isNotNull()
    return info.agg(F.count_if(read).alias("readable"), F.count_if(~read).alias("unreadable"), F.count_if(mapped).alias("mapped"), F.sum("bands").alias("bands"), F.min(F.when(mapped, F.col("path"))).alias("reference"))


def listing(info, limit: int = 15):
    """The first files of :func:`cube_info` by path: what they are, or what is wrong with them."""
    from pyspark.sql import functions as F

    told = F.format_string("%dx%dx%d %s%s", "samples", "lines", "bands", "type", F.coalesce(F.concat(F.lit(", "), F.col("projection")), F.lit("")))
    return info.orderBy("path").limit(limit).select("path", F.when(F.col("samples").isNotNull(), told).alias("cube"), F.col("error").alias("problem"))


def common_folder(paths: list[str]) -> str:
    """The deepest folder that holds all the files; "" if there is none."""
    try:
        return os.path.commonpath([os.path.dirname(p) for p in paths]) if paths else ""
    except ValueError:
        return ""
