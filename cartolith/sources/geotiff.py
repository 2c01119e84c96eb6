"""Tiled (Big)GeoTIFF files back as tables: their directories, and the data source ``geotiff``.

``spark.read.format("geotiff").load(path)`` gives (level, band, line, sample, value), one row a sample as it is stored, some
rows of tiles of a level in a task. ``option("level", n)`` reads one level. Directories alone are read to plan, once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import file_size, open_input

#: Bytes and struct letters of TIFF field types; tags.
FIELDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR, TILE, OFFSETS, COUNTS, EXTRA, FORM = 256, 257, 258, 259, 262, 277, 284, 317, 322, 324, 325, 338, 339


class TiffError(ValueError):
    pass


def directories(path: str) -> list[dict[int, list]]:
    """The tags of each level: values by tag; a text is a list of one."""
    size = file_size(path)
    with open_input(path) as f:

        def take(at: int, n: int) -> bytes:
            f.seek(at)
            data = f.read(n)
            if at + n > size or len(data) < n:
                raise TiffError(f"{path}: cut short")
            return data

        head = take(0, 8)
        magic = struct.unpack("<H", head[2:4])[0]
        if head[:2] != b"II" or magic not in (42, 43):
            raise TiffError(f"{path}: not a little-endian TIFF")
        big = magic == 43
        word, letter = (8, "Q") if big else (4, "I")
        number = lambda data: struct.unpack(f"<{letter}", data)[0]
        at = number(take(8, 8) if big else head[4:])
        out: list[dict[int, list]] = []
        while at:
            lead = 8 if big else 2
            n = struct.unpack("<Q" if big else "<H", take(at, lead))[0]
            each = 4 + 2 * word
            raw = take(at + lead, n * each + word)
            tags: dict[int, list] = {}
            for k in range(n):
                entry = raw[k * each : (k + 1) * each]
                tag, kind = struct.unpack("<HH", entry[:4])
                count = number(entry[4 : 4 + word])
                length, form = FIELDS[kind]
                data = entry[4 + word :] if length * count <= word else take(number(entry[4 + word :]), length * count)
                data = data[: length * count]
                tags[tag] = [data.rstrip(b"\0").decode()] if kind == 2 else list(struct.unpack(f"<{count}{form}", data))
            out.append(tags)
            at = number(raw[n * each :])
        return out


def kind_of(tags: dict[int, list]) -> np.dtype:
    return np.dtype({1: "u", 2: "i", 3: "f"}[tags[FORM][0]] + str(tags[BITS][0] // 8)).newbyteorder("<")


def unpacked(tags: dict[int, list], data: bytes) -> np.ndarray:
    """A stored tile as (rows, columns, samples)."""
    kind, t = kind_of(tags), tags[TILE][0]
    samples = tags[SAMPLES][0] if tags[PLANAR][0] == 1 else 1
    if tags[COMPRESSION][0] == 8:
        data = zlib.decompress(data)
    elif tags[COMPRESSION][0] == 50000:
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(data)
    predictor = tags.get(PREDICTOR, [1])[0]
    if predictor == 3:
        planes = np.frombuffer(data, np.uint8).reshape(t, -1, samples).cumsum(axis=1, dtype=np.uint8)
        planes = planes.reshape(t, kind.itemsize, t * samples)[:, ::-1]
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind).reshape(t, t, samples)
    tile = np.frombuffer(data, kind).reshape(t, t, samples)
    return tile.view(f"<u{kind.itemsize}").cumsum(axis=1, dtype=f"<u{kind.itemsize}").view(kind) if predictor == 2 else tile


def tag_rows(spark: SparkSession, path: str) -> DataFrame:
    """(level, tag, values array<string>) of a file's directories."""
    rows = [(k, tag, [str(v) for v in values]) for k, tags in enumerate(directories(path)) for tag, values in tags.items()]
    return spark.createDataFrame(rows, "level int, tag int, values array<string>")


PIXELS = "level int, band int, line int, sample int, value double"


#: Samples that a task reads: as many rows of tiles as fit, and one at least.
SHARE = 1 << 20


@dataclass
class TileRows(InputPartition):
    """Rows of tiles of a plane, with what a task needs of the directory: its own tiles' offsets and bytes alone."""

    level: int
    plane: int
    ty: int
    tags: dict[int, list]
    offsets: list[int]
    counts: list[int]


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.level = int(options["level"]) if "level" in options else None

    def partitions(self) -> list[TileRows]:
        out = []
        for k, tags in enumerate(directories(self.path)):
            if self.level not in (None, k):
                continue
            t = tags[TILE][0]
            planes, samples = (1, tags[SAMPLES][0]) if tags[PLANAR][0] == 1 else (tags[SAMPLES][0], 1)
            across, down = -(-tags[WIDTH][0] // t), -(-tags[HEIGHT][0] // t)
            if not planes * across * down == len(tags[OFFSETS]) == len(tags[COUNTS]):
                raise TiffError(f"{self.path}: level {k} has {planes * across * down} tiles, {len(tags[OFFSETS])} offsets and {len(tags[COUNTS])} sizes")
            step = max(1, SHARE // (across * t * t * samples))
            few = {tag: tags[tag] for tag in (WIDTH, HEIGHT, BITS, COMPRESSION, SAMPLES, PLANAR, PREDICTOR, TILE, FORM) if tag in tags}
            for p in range(planes):
                for ty in range(0, down, step):
                    own = slice((p * down + ty) * across, (p * down + min(ty + step, down)) * across)
                    out.append(TileRows(k, p, ty, few, tags[OFFSETS][own], tags[COUNTS][own]))
        return out or [TileRows(-1, 0, 0, {}, [], [])]

    def read(self, part: TileRows) -> Iterator[pa.RecordBatch]:
        if part.level < 0:
            return
        w, h, t = part.tags[WIDTH][0], part.tags[HEIGHT][0], part.tags[TILE][0]
        across = -(-w // t)
        with open_input(self.path) as f:
            for i, (offset, count) in enumerate(zip(part.offsets, part.counts, strict=True)):
                ty, tx = part.ty + i // across, i % across
                f.seek(offset)
                tile = unpacked(part.tags, f.read(count))[: h - ty * t, : w - tx * t]
                line, sample = np.mgrid[ty * t : ty * t + tile.shape[0], tx * t : tx * t + tile.shape[1]].astype(np.int32)
                for s in range(tile.shape[2]):
                    n = line.size
                    whole = lambda v: pa.array(np.full(n, v, np.int32))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([whole(part.level), whole(part.plane + s + 1), pa.array(line.ravel()), pa.array(sample.ravel()), pa.array(tile[:, :, s].astype(np.float64).ravel())], names=["level", "band", "line", "sample", "value"])


class GeoTiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> GeoTiffReader:
        return GeoTiffReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format ``geotiff`` known to a session."""
    spark.dataSource.register(GeoTiffSource)
