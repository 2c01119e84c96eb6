"""Tiled (Big)GeoTIFF: tile encoding and file layout.

Tasks turn blocks of doubles into compressed tiles. Where files can be written at any place, tasks also write them, each
tile at its offset, and the driver adds header and directories and renames the file into place; in a store that takes
files front to back only, one task does all of that. A failed write leaves no file.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.projections import Projection
from ..operators.values import tile_offsets
from ..raster import Grid, PixelType
from ..sources.files import published
from ..store import by_one_task


@dataclass(frozen=True)
class TileEncoder:
    """How values of a tile become stored bytes."""

    kind: PixelType
    tile: int
    compression: int = 8
    level: int = 6
    predictor: int = 1
    no_data: float | None = None
    stretch: tuple[tuple[float, float], ...] = ()  # lo, hi of each band
    normalize: tuple[float, float, float] | None = None  # lo, k, top
    alpha: bool = False

    @property
    def fill(self) -> float:
        if self.alpha:
            return 0.0
        return self.no_data if self.no_data is not None else math.nan if self.kind.is_float else 0.0

    def numbers(self, v: np.ndarray, band: int) -> np.ndarray:
        """Stored numbers of doubles, NaN as no data."""
        missing = np.isnan(v)
        away = lambda x: np.trunc(x + np.copysign(0.5, x))  # noqa: E731  half away from zero
        low, high = self.kind.range
        with np.errstate(invalid="ignore"):
            if self.normalize:
                lo, k, top = self.normalize
                out = np.clip((v - lo) * k, 0, top)
                out = out if self.kind.is_float else away(out)
            elif self.stretch:
                lo, hi = self.stretch[band]
                out = away(np.clip(1 + (v - lo) * 254 / (hi - lo), 1, 255)) if hi > lo else np.full(v.shape, 128.0)
            else:
                out = np.clip(v if self.kind.is_float else away(v), low, high) if self.kind.name != "float64" else v
        return np.where(missing, 0.0 if self.stretch else self.fill, out).astype(self.kind.dtype.newbyteorder("<"))

    def encode(self, bands: list[np.ndarray], first: int = 0, interleaved: bool = False) -> bytes:
        """One tile: a block of one band, or blocks of all bands by pixel, with an alpha channel if there is one."""
        h, w = bands[0].shape
        planes = [self.numbers(v, first + i) for i, v in enumerate(bands)]
        pad = np.full((), 0.0 if self.stretch else self.fill).astype(planes[0].dtype)
        if self.alpha and interleaved:
            top = self.normalize[2] if self.normalize else self.kind.range[1]
            seen = ~np.logical_and.reduce([np.isnan(v) for v in bands])
            planes.append(np.where(seen, top, 0).astype(planes[0].dtype))
        out = np.full((self.tile, self.tile, len(planes)), pad, planes[0].dtype)
        for i, p in enumerate(planes):
            out[:h, :w, i] = p
            if self.alpha and interleaved and i == len(planes) - 1:
                out[h:, :, i] = 0
                out[:, w:, i] = 0
        return self.pack(out)

    def pack(self, tile: np.ndarray) -> bytes:
        data = predict(tile, self.predictor)
        if self.compression == 8:
            return zlib.compress(data, self.level)
        if self.compression == 50000:
            import zstandard

            return zstandard.ZstdCompressor(level=self.level).compress(data)
        return data


def predict(tile: np.ndarray, predictor: int) -> bytes:
    """Bytes of a (rows, columns, samples) tile after a TIFF predictor."""
    rows, columns, samples = tile.shape
    size = tile.dtype.itemsize
    if predictor == 2:
        whole = np.ascontiguousarray(tile).view(f"<u{size}")
        out = whole.copy()
        out[:, 1:] -= whole[:, :-1]
        return out.tobytes()
    if predictor == 3:
        planes = np.ascontiguousarray(tile).view(np.uint8).reshape(rows, columns * samples, size)[:, :, ::-1]
        flat = np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(rows, -1)
        out = flat.copy()
        out[:, samples:] -= flat[:, :-samples]
        return out.tobytes()
    return np.ascontiguousarray(tile).tobytes()


@dataclass
class Layout:
    sizes: list[tuple[int, int]]  # of all levels
    tile: int
    samples: int
    kind: PixelType
    compression: int
    predictor: int
    interleaved: bool = False
    alpha: bool = False
    rgb: bool = False
    big: bool = False
    no_data: str = ""
    metadata: str = ""
    grid: Grid | None = None
    projection: Projection | None = None
    offsets: list[list[int]] = field(default_factory=list)
    counts: list[list[int]] = field(default_factory=list)

    def tiles(self, level: int) -> tuple[int, int]:
        w, h = self.sizes[level]
        return -(-w // self.tile), -(-h // self.tile)

    def index(self, level: int, plane: int, ty: int, tx: int) -> int:
        across, down = self.tiles(level)
        return (plane * down + ty) * across + tx


#: TIFF field types as (code, struct letter), and GeoKey ids and codes.
SHORT, LONG, LONG8, DOUBLE, ASCII = (3, "H"), (4, "I"), (16, "Q"), (12, "d"), (2, "s")
MODEL_TYPE, RASTER_TYPE, CITATION, GEOGRAPHIC_TYPE, GEOG_CITATION, DATUM, PRIME_MERIDIAN, LINEAR_UNITS, ANGULAR_UNITS, ELLIPSOID, SEMI_MAJOR, SEMI_MINOR = 1024, 1025, 1026, 2048, 2049, 2050, 2051, 2052, 2054, 2056, 2057, 2058
PROJECTED_TYPE, PCS_CITATION, PROJECTION, COORD_TRANS, PROJ_UNITS = 3072, 3073, 3074, 3075, 3076
USER_DEFINED, GREENWICH, METER, DEGREE = 32767, 8901, 9001, 9102
DOUBLES_TAG, ASCII_TAG = 34736, 34737


def geo_keys(p: Projection) -> tuple[list[int], list[float], str]:
    """GeoKeyDirectory, its doubles and its texts."""
    g = p.geotiff
    body = g.ellipsoid.name or "Unknown"
    title = f"GCS_{body}" if g.geographic else f"{p.display_name} {body}"
    names = f"GCS Name = GCS_{body}|Datum = D_{body}|Ellipsoid = {body}{'_localRadius' if g.local_radius else ''}|Primem = Reference_Meridian|AUnits = degree|"
    keys: list[tuple[int, object]] = [
        (MODEL_TYPE, 2 if g.geographic else 1), (RASTER_TYPE, 1), (CITATION, title), (GEOGRAPHIC_TYPE, USER_DEFINED), (GEOG_CITATION, names), (DATUM, USER_DEFINED),
        (PRIME_MERIDIAN, GREENWICH), (LINEAR_UNITS, METER), (ANGULAR_UNITS, DEGREE), (ELLIPSOID, USER_DEFINED), (SEMI_MAJOR, g.ellipsoid.a), (SEMI_MINOR, g.ellipsoid.b),
    ]
    if not g.geographic:
        keys += [(PROJECTED_TYPE, USER_DEFINED), (PCS_CITATION, title), (PROJECTION, USER_DEFINED), (COORD_TRANS, g.transform), (PROJ_UNITS, METER), *((k, float(v)) for k, v in g.params)]
    entries, doubles, text = [], [], ""
    for key, value in keys:
        if isinstance(value, float):
            entries.append((key, DOUBLES_TAG, 1, len(doubles)))
            doubles.append(value)
        elif isinstance(value, str):
            entries.append((key, ASCII_TAG, len(value) + 1, len(text)))
            text += value + "|"
        else:
            entries.append((key, 0, 1, value))
    entries.sort(key=lambda e: e[0])
    return [1, 1, 0, len(entries), *(x for e in entries for x in e)], doubles, text


def directory(lay: Layout, level: int) -> list[tuple[int, tuple[int, str], list]]:
    """(tag, type, values) of a level's directory, by tag."""
    w, h = lay.sizes[level]
    each = [lay.kind.size * 8] * lay.samples
    number = LONG8 if lay.big else LONG
    form = 3 if lay.kind.is_float else 2 if lay.kind.is_signed else 1
    tags = [
        (254, LONG, [int(level > 0)]), (256, LONG, [w]), (257, LONG, [h]), (258, SHORT, each), (259, SHORT, [lay.compression]), (262, SHORT, [2 if lay.rgb else 1]), (277, SHORT, [lay.samples]),
        (284, SHORT, [2 if lay.samples > 1 and not lay.interleaved else 1]), (322, SHORT, [lay.tile]), (323, SHORT, [lay.tile]), (324, number, lay.offsets[level]), (325, number, lay.counts[level]), (339, SHORT, [form] * lay.samples),
    ]
    if lay.predictor > 1:
        tags.append((317, SHORT, [lay.predictor]))
    if (extra := lay.samples - (3 if lay.rgb else 1)) > 0:
        tags.append((338, SHORT, [0] * (extra - 1) + [2 if lay.alpha else 0]))
    if level == 0 and lay.projection:
        g = lay.grid
        keys, doubles, text = geo_keys(lay.projection)
        tags += [(33550, DOUBLE, [g.resx, g.resy, 0.0]), (33922, DOUBLE, [0.0, 0.0, 0.0, g.x0, g.y0, 0.0]), (34735, SHORT, keys), (DOUBLES_TAG, DOUBLE, doubles), (ASCII_TAG, ASCII, [text])]
    if level == 0 and lay.metadata:
        tags.append((42112, ASCII, [lay.metadata]))
    if lay.no_data:
        tags.append((42113, ASCII, [lay.no_data]))
    return sorted(tags, key=lambda t: t[0])


def _pack(kind: tuple[int, str], values: list) -> tuple[int, bytes]:
    if kind == ASCII:
        data = values[0].encode("utf-8") + b"\0"
        return len(data), data
    return len(values), struct.pack(f"<{len(values)}{kind[1]}", *values)


def directories(lay: Layout, at: int) -> bytes:
    """All directories with their values, to stand from the even offset ``at`` on."""
    count, offset = ("<Q", "<Q") if lay.big else ("<H", "<I")
    word = struct.calcsize(offset)
    out = b""
    for level in range(len(lay.sizes)):
        tags = [(tag, kind[0], *_pack(kind, values)) for tag, kind, values in directory(lay, level)]
        head = struct.pack(count, len(tags))
        begin = at + len(out) + len(head) + len(tags) * (4 + 2 * word) + word
        blob = b""
        for tag, code, n, data in tags:
            head += struct.pack("<HH", tag, code) + struct.pack(offset, n)
            if len(data) <= word:
                head += data.ljust(word, b"\0")
            else:
                head += struct.pack(offset, begin + len(blob))
                blob += data + b"\0" * (len(data) % 2)
        last = level == len(lay.sizes) - 1
        out += head + struct.pack(offset, 0 if last else begin + len(blob)) + blob
    if not lay.big and at + len(out) > 0xFFFFFFFF:
        raise ValueError("output exceeds 4 GiB; use BigTIFF")
    return out


def _header(lay: Layout, end: int) -> bytes:
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, end) if lay.big else struct.pack("<2sHI", b"II", 42, end)


def _no_tiles(lay: Layout) -> None:
    planes = 1 if lay.interleaved else lay.samples
    lay.offsets = [[0] * (planes * math.prod(lay.tiles(k))) for k in range(len(lay.sizes))]
    lay.counts = [list(x) for x in lay.offsets]


def write_file(path: str, lay: Layout, tables: list[DataFrame], total: int) -> None:
    """Writes the tiles of ``tables`` (level, plane, ty, tx, payload) of ``total`` bytes in order, then the directories, in one task.

    The sum is known before, so the header can point to the directories and the file is written front to back, as
    object stores ask.
    """
    key = ["level", "plane", "ty", "tx"]
    tiles = tables[0].select(*key, "payload")
    for t in tables[1:]:
        tiles = tiles.unionByName(t.select(*key, "payload"))

    def append(rows) -> int:
        _no_tiles(lay)
        at = 16 if lay.big else 8
        end = at + total + total % 2
        with published(path) as f:
            f.write(_header(lay, end))
            for r in rows:
                i = lay.index(r.level, r.plane, r.ty, r.tx)
                lay.offsets[r.level][i], lay.counts[r.level][i] = at, len(r.payload)
                f.write(r.payload)
                at += len(r.payload)
            if at + total % 2 != end:
                raise ValueError(f"tiles have {at} bytes, not the {total} told")
            f.write(b"\0" * (end - at) + directories(lay, end))
        return at

    by_one_task(tiles, key, append)


#: Tiles whose offsets are broadcast, eight bytes each; files of more are written front to back.
PLACED = 4_000_000


def write_in_place(path: str, lay: Layout, tables: list[DataFrame], total: int) -> None:
    """Writes the tiles of ``tables`` (level, plane, ty, tx, payload) by tasks, each at its offset, to a path that all executors share.

    A task that runs again writes the same bytes to the same places.
    """
    key = ["level", "plane", "ty", "tx"]
    sizes = tables[0].select(*key, F.octet_length("payload").cast("long").alias("bytes"))
    for t in tables[1:]:
        sizes = sizes.unionByName(t.select(*key, F.octet_length("payload").cast("long").alias("bytes")))
    _no_tiles(lay)
    start = 16 if lay.big else 8
    end = start + total + total % 2
    for r in tile_offsets(sizes, start).toLocalIterator():
        i = lay.index(r["level"], r["plane"], r["ty"], r["tx"])
        lay.offsets[r["level"]][i], lay.counts[r["level"]][i] = r["offset"], r["bytes"]
    spark = tables[0].sparkSession
    places = spark.sparkContext.broadcast([np.array(x, np.int64) for x in lay.offsets])
    part, index = path + ".partial", Layout(lay.sizes, lay.tile, lay.samples, lay.kind, lay.compression, lay.predictor, lay.interleaved).index

    def write(frames):
        done = 0
        with open(part, "r+b") as f:
            for frame in frames:
                for r in frame.itertuples():
                    f.seek(int(places.value[r.level][index(r.level, r.plane, r.ty, r.tx)]))
                    f.write(r.payload)
                    done += len(r.payload)
        yield pd.DataFrame({"bytes": [done]})

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    try:
        with open(part, "wb") as f:
            f.write(_header(lay, end))
            f.truncate(end)
        done = sum(t.select(*key, "payload").mapInPandas(write, "bytes long").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] for t in tables)
        if done != total:
            raise ValueError(f"tiles have {done} bytes, not the {total} told")
        with open(part, "r+b") as f:
            f.seek(end)
            f.write(directories(lay, end))
        os.replace(part, path)
    except BaseException:
        if os.path.exists(part):
            os.remove(part)
        raise
    finally:
        places.destroy()


def no_data_text(v: float | None, kind: PixelType) -> str:
    """The text that gives the same sample when it is read back."""
    if v is None:
        return ""
    if math.isnan(v):
        return "nan"
    text = str(np.float32(v)) if kind.name == "float32" else repr(float(v))
    return text.removesuffix(".0")


def metadata_xml(items: list[tuple[str, int | None, str, str]]) -> str:
    """GDAL metadata of (name, sample, role, text)."""
    clean = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    lines = [f'  <Item name="{n}"' + ("" if s is None else f' sample="{s}" role="{r}"') + f">{clean(t)}</Item>\n" for n, s, r, t in items]
    return "<GDALMetadata>\n" + "".join(lines) + "</GDALMetadata>\n" if lines else ""
