"""Whole conversions: cube files to GeoTIFF.

A task makes an output tile from the cube itself: it reads the window, or for a reprojection the blocks that the tile's
source positions fall on, so pixels are never shuffled. Overviews group four tiles of doubles into one, level by level.
Encoded tiles are stored, and then written by tasks at their places in the file, or, in stores that take files front to
back, appended by one task in order. Several cubes are converted side by side.
"""

from __future__ import annotations

import os
import time
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.projections import Projection
from ..operators.pyramid import overview_sizes
from ..operators.values import Normalization
from ..operators.warp import source_position, wraps
from ..raster import Grid, PixelType, format_num, round6
from ..sinks.geotiff import PLACED, Layout, TileEncoder, metadata_xml, no_data_text, write_file, write_in_place
from ..sinks.label import label_path, label_text, write_label
from ..sources.files import file_size, is_address
from ..sources.isis import Cube, decode, expand_inputs, open_cube, read_window
from ..store import drop, stored
from .grid import floats, plan_warp
from .options import Options, OptionError, chosen_bands, chosen_compression, chosen_no_data, output_path, output_type


@dataclass
class ConversionPlan:
    """Everything that is decided before pixels are read."""

    cube: Cube
    output: str
    options: Options
    bands: list[int]
    kind: PixelType
    no_data: float | None
    compression: tuple[int, int, int]
    grid: Grid
    projection: Projection | None
    warped: bool
    warnings: list[str]


def plan_conversion(path: str, o: Options, several: bool = False) -> ConversionPlan:
    cube = open_cube(path)
    output = output_path(path, o, several)
    if os.path.abspath(output).casefold() == os.path.abspath(path).casefold():
        raise OptionError("input and output are the same file")
    bands, kind = chosen_bands(cube, o), output_type(cube, o)
    if o.resample not in ("nearest", "bilinear", "cubic"):
        raise OptionError(f"--resample is nearest, bilinear or cubic, not {o.resample!r}")
    if o.overview_method not in ("average", "nearest"):
        raise OptionError(f"--ov-resample is average or nearest, not {o.overview_method!r}")
    warnings: list[str] = []
    grid, projection = cube.grid or Grid(cube.w, cube.h, 0.0, 0.0, 1.0, 1.0), cube.projection
    if o.wants_warp:
        if projection is None:
            raise OptionError(cube.projection_error or "a cube without a Mapping group can't be reprojected")
        projection, grid, warnings = plan_warp(cube, o)
    elif projection is None:
        warnings.append(cube.projection_error or "without a Mapping group the output has no georeference")
    return ConversionPlan(cube, output, o, bands, kind, chosen_no_data(kind, o), chosen_compression(kind, o), grid, projection, o.wants_warp, warnings)


class BlockReader:
    """Decoded source blocks of a cube, the last ones kept."""

    def __init__(self, cube: Cube, raw: bool, edge: int = 512, keep: int = 48):
        self.cube, self.raw, self.edge, self.keep = cube, raw, edge, keep
        self.blocks: OrderedDict[tuple, np.ndarray] = OrderedDict()

    def block(self, band: int, by: int, bx: int) -> np.ndarray:
        key = band, by, bx
        if key not in self.blocks:
            x, y, e = bx * self.edge, by * self.edge, self.edge
            window = read_window(self.cube, band, x, y, min(e, self.cube.w - x), min(e, self.cube.h - y))
            self.blocks[key] = decode(self.cube, window, self.raw)
            if len(self.blocks) > self.keep:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(key)
        return self.blocks[key]

    def gather(self, band: int, ix: np.ndarray, iy: np.ndarray) -> np.ndarray:
        """Values at whole positions; NaN where they are outside (negative ix marks that too)."""
        out = np.full(ix.shape, np.nan)
        inside = (ix >= 0) & (ix < self.cube.w) & (iy >= 0) & (iy < self.cube.h)
        across = -(-self.cube.w // self.edge)
        which = np.where(inside, iy // self.edge * across + ix // self.edge, -1)
        for b in np.unique(which[inside]):
            at = which == b
            by, bx = divmod(int(b), across)
            out[at] = self.block(band, by, bx)[iy[at] - by * self.edge, ix[at] - bx * self.edge]
        return out


def cubic_weight(t: np.ndarray) -> np.ndarray:
    t = np.abs(t)
    return np.where(t <= 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0.0))


def sample_tile(reader: BlockReader, bands: list[int], u: np.ndarray, v: np.ndarray, kernel: str, wrap: bool) -> list[np.ndarray]:
    """Values of a tile for source positions u, v (NaN: none), by the kernels of :func:`cartolith.operators.warp.resample`."""
    w, h = reader.cube.w, reader.cube.h
    with np.errstate(invalid="ignore"):
        if wrap:
            u = u - np.floor(u / w) * w
        good = (v >= 0) & (v < h) & (np.isfinite(u) if wrap else (u >= 0) & (u < w))
    u, v = np.where(good, u, 0.0), np.where(good, v, 0.0)
    column = (lambda ix: ix % w) if wrap else (lambda ix: ix)
    cx, cy = column(np.floor(u).astype(np.int64)), np.floor(v).astype(np.int64)
    bx, by = np.floor(u - 0.5).astype(np.int64), np.floor(v - 0.5).astype(np.int64)
    fu, fv = u - 0.5 - bx, v - 0.5 - by
    out = []
    for band in bands:
        center = reader.gather(band, np.where(good, cx, -1), cy)
        if kernel == "nearest":
            out.append(center)
            continue
        reach = (-1, 0, 1, 2) if kernel == "cubic" else (0, 1)
        near = {(dy, dx): reader.gather(band, column(bx + dx), by + dy) for dy in reach for dx in reach}
        total, weight = np.zeros(u.shape), np.zeros(u.shape)
        for dy in (0, 1):
            for dx in (0, 1):
                value, share = near[dy, dx], (fu if dx else 1 - fu) * (fv if dy else 1 - fv)
                valid = ~np.isnan(value)
                total += np.where(valid, value * share, 0.0)
                weight += np.where(valid, share, 0.0)
        result = np.where(weight >= 1e-9, total / np.maximum(weight, 1e-9), np.nan)
        if kernel == "cubic":
            whole = sum(sum(near[dy, dx] * cubic_weight(fu - dx) for dx in reach) * cubic_weight(fv - dy) for dy in reach)
            result = np.where(np.isnan(whole), result, whole)
        out.append(np.where(np.isnan(center), np.nan, result))
    return out


def interpolated(place, x: np.ndarray, y: np.ndarray, tolerance: float = 0.125, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """``place(x, y)``, linear along stretches of rows where that is within ``tolerance`` pixels at their middles.

    A row is one stretch at first; one that is not straight enough, or has a point without a place at its ends or middle,
    is halved. Stretches of at most ``least`` steps are computed point by point.
    """
    h, w = x.shape
    out = np.full((2, h, w), np.nan)
    row, first, last = np.arange(h), np.zeros(h, np.int64), np.full(h, w - 1)
    while len(row):
        short = last - first <= least
        exact = np.zeros((h, w), bool)
        for r, a, b in zip(row[short], first[short], last[short]):
            exact[r, a : b + 1] = True
        if exact.any():
            out[:, exact] = place(x[exact], y[exact])
        row, first, last = row[~short], first[~short], last[~short]
        if not len(row):
            break
        middle = (first + last) // 2
        at = np.stack([first, middle, last])
        a, m, b = np.moveaxis(np.stack(place(x[row, at], y[row, at])), 1, 0)
        share = (middle - first) / (last - first)
        with np.errstate(invalid="ignore"):
            good = (np.abs(a + (b - a) * share - m) <= tolerance).all(axis=0)
        for size in np.unique(last[good] - first[good]):
            some = np.flatnonzero(good & (last - first == size))
            steps = np.arange(size + 1)
            out[:, row[some][:, None], first[some][:, None] + steps] = a[:, some, None] + (b - a)[:, some, None] * (steps / size)
        row, first, middle, last = row[~good], first[~good], middle[~good], last[~good]
        row, first, last = np.append(row, row), np.append(first, middle), np.append(middle, last)
    return out[0], out[1]


def tile_values(plan: ConversionPlan, reader: BlockReader, ty: int, tx: int, bands: list[int]) -> list[np.ndarray]:
    """Doubles of an output tile's valid part, one block a band."""
    t, g = plan.options.tile, plan.grid
    x0, y0 = tx * t, ty * t
    w, h = min(t, g.w - x0), min(t, g.h - y0)
    if not plan.warped:
        return [decode(plan.cube, read_window(plan.cube, b, x0, y0, w, h), plan.options.raw) for b in bands]
    x, y = np.meshgrid(g.x0 + (np.arange(x0, x0 + w) + 0.5) * g.resx, g.y0 - (np.arange(y0, y0 + h) + 0.5) * g.resy)
    place = lambda x, y: source_position(x, y, plan.projection, plan.cube.projection, plan.cube.grid)
    with np.errstate(all="ignore"):
        u, v = interpolated(place, x, y) if plan.options.approximate else place(x, y)
    return sample_tile(reader, bands, u, v, plan.options.resample, wraps(plan.cube.projection, plan.cube.grid))


def halve_block(v: np.ndarray, method: str) -> np.ndarray:
    """A block at half size, as :mod:`cartolith.operators.pyramid` does it."""
    if method == "nearest":
        return v[::2, ::2]
    h, w = v.shape
    v = np.pad(v, ((0, h % 2), (0, w % 2)), constant_values=np.nan).reshape((h + 1) // 2, 2, (w + 1) // 2, 2)
    count = (~np.isnan(v)).sum(axis=(1, 3))
    return np.where(count, np.nansum(v, axis=(1, 3)) / np.maximum(count, 1), np.nan)


BLOCK = "level int, plane int, ty int, tx int, h int, w int, data binary, payload binary"


def _row(level, plane, ty, tx, blocks, encoder, interleaved, keep):
    h, w = blocks[0].shape
    raw = np.stack(blocks).astype("<f8").tobytes() if keep else None
    return level, plane, ty, tx, h, w, raw, encoder.encode(blocks, plane, interleaved)


def tile_table(spark: SparkSession, plan: ConversionPlan, lay: Layout, encoder: TileEncoder) -> list[DataFrame]:
    """Stored tables of all levels' tiles: doubles of the levels that another is made of, and encoded bytes."""
    names = BLOCK.replace(" int", "").replace(" binary", "").split(", ")
    groups = [(0, plan.bands)] if lay.interleaved else [(i, [b]) for i, b in enumerate(plan.bands)]
    across, down = lay.tiles(0)
    jobs = spark.range(across * down * len(groups)).repartition(max(1, min(across * down * len(groups), plan.options.threads or 4 * spark.sparkContext.defaultParallelism)))
    more = len(lay.sizes) > 1

    def make(frames):
        reader = BlockReader(plan.cube, plan.options.raw, keep=max(16, plan.options.cache // 2))  # two MB a block
        for frame in frames:
            for i in frame["id"]:
                plane, rest = divmod(int(i), across * down)
                ty, tx = divmod(rest, across)
                yield pd.DataFrame([_row(0, plane, ty, tx, tile_values(plan, reader, ty, tx, groups[plane][1]), encoder, lay.interleaved, more)], columns=names)

    plain = {"parquet.enable.dictionary": "false", "compression": "snappy" if more else "uncompressed"}  # tiles are packed already, doubles are not
    tables = [stored(jobs.mapInPandas(make, BLOCK), "tiles", **plain)]
    t = plan.options.tile
    for level in range(1, len(lay.sizes)):
        keys = ["plane", F.expr("ty div 2"), F.expr("tx div 2")]
        merge = _merger(level, lay, [len(g) for _, g in groups], encoder, plan.options.overview_method, names)
        tables.append(stored(tables[-1].drop("payload").groupBy(*keys).applyInPandas(merge, BLOCK), "tiles", **plain))
    return tables


def _merger(level: int, lay: Layout, bands: list[int], encoder: TileEncoder, method: str, names: list[str]):
    """The function that makes a tile of a level from up to four of the level before."""
    t, last, (w, h) = lay.tile, level == len(lay.sizes) - 1, lay.sizes[level]

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        plane, ty, tx = int(frame["plane"].iloc[0]), int(frame["ty"].iloc[0]) // 2, int(frame["tx"].iloc[0]) // 2
        out = np.full((bands[plane], min(t, h - ty * t), min(t, w - tx * t)), np.nan)
        for r in frame.itertuples():
            y, x = r.ty % 2 * (t // 2), r.tx % 2 * (t // 2)
            for b, v in enumerate(np.frombuffer(r.data, "<f8").reshape(bands[plane], r.h, r.w)):
                half = halve_block(v, method)
                out[b, y : y + half.shape[0], x : x + half.shape[1]] = half
        return pd.DataFrame([_row(level, plane, ty, tx, list(out), encoder, lay.interleaved, not last)], columns=names)

    return merge


def _values(spark: SparkSession, plan: ConversionPlan) -> DataFrame:
    """Pixels of the chosen bands of the whole cube, before any crop or reprojection."""
    from ..sources.isis import register

    register(spark)
    pixels = spark.read.format("isis").option("raw", str(plan.options.raw).lower()).load(plan.cube.path)
    return pixels.where(F.col("band").isin(*(b + 1 for b in plan.bands)))


def value_range(spark: SparkSession, plan: ConversionPlan, edge: int = 1024):
    """lo, hi and the number of pixels without data of the chosen bands of the whole cube: a row from each window."""
    c, raw, bands = plan.cube, plan.options.raw, sorted(set(plan.bands))
    across, down = -(-c.w // edge), -(-c.h // edge)
    count = across * down * len(bands)

    def run(frames):
        for frame in frames:
            rows = []
            for i in frame["id"]:
                band, rest = divmod(int(i), across * down)
                y, x = rest // across * edge, rest % across * edge
                v = decode(c, read_window(c, bands[band], x, y, min(edge, c.w - x), min(edge, c.h - y)), raw)
                bad = int(np.isnan(v).sum())
                rows.append((np.nanmin(v), np.nanmax(v), bad) if bad < v.size else (None, None, bad))
            yield pd.DataFrame(rows, columns=["lo", "hi", "invalid"]).astype({"lo": "Float64", "hi": "Float64"})

    found = spark.range(count).repartition(min(count, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "lo double, hi double, invalid long")
    return found.agg(F.min("lo"), F.max("hi"), F.sum("invalid")).first()


def normalization(spark: SparkSession, plan: ConversionPlan) -> Normalization:
    from ..operators.values import plan_normalization

    top = 1.0 if plan.kind.is_float else plan.kind.range[1]
    m, b = (plan.cube.multiplier, plan.cube.base) if plan.options.raw else (1.0, 0.0)
    return plan_normalization(value_range(spark, plan), top, m, b, plan.warped)


def stretches(spark: SparkSession, plan: ConversionPlan) -> tuple[tuple[float, float], ...]:
    from ..operators.values import stretch_limits

    if "," in plan.options.stretch:
        return (floats(plan.options.stretch, 2),) * len(plan.bands)
    rows = stretch_limits(_values(spark, plan), plan.cube.w, plan.cube.h, plan.options.stretch.lower()).collect()
    found = {r["band"]: (r["lo"], r["hi"]) for r in rows}
    return tuple(found[b + 1] for b in plan.bands)


def execute(spark: SparkSession, plan: ConversionPlan) -> str:
    """Runs a plan; returns the path written."""
    o, cube, kind = plan.options, plan.cube, plan.kind
    norm = normalization(spark, plan) if o.normalize else None
    stretch = stretches(spark, plan) if o.stretch else ()
    code, level, predictor = plan.compression
    interleaved = bool(norm) or o.interleave
    overviews = o.overviews and not norm
    sizes = overview_sizes(plan.grid.w, plan.grid.h, o.tile) if overviews else [(plan.grid.w, plan.grid.h)]
    alpha = bool(norm and norm.alpha)
    samples = len(plan.bands) + alpha
    size = plan.grid.w * plan.grid.h * samples * kind.size * (4 / 3 if overviews else 1)
    big = {"auto": size > 3.8e9, "if_needed": size > 3.8e9, "if_safer": size > 3.8e9, "yes": True, "true": True, "1": True, "no": False, "false": False, "0": False}.get(o.bigtiff.lower())
    if big is None:
        raise OptionError(f"--bigtiff is auto, yes or no, not {o.bigtiff!r}")
    items: list[tuple] = []
    if cube.mapping and (name := cube.mapping.text("TargetName")):
        items.append(("TARGET_NAME", None, "", name))
    scaling = (norm.multiplier, norm.base) if norm else (cube.multiplier, cube.base) if o.raw and not stretch and cube.has_scaling else None
    for i, b in enumerate(plan.bands):
        if scaling:
            items += [("OFFSET", i, "offset", repr(scaling[1])), ("SCALE", i, "scale", repr(scaling[0]))]
        if cube.band_names:
            items.append(("DESCRIPTION", i, "description", cube.band_names[b]))
    lay = Layout(sizes, o.tile, samples, kind, code, predictor, interleaved, alpha, bool(norm) and len(plan.bands) == 3, big, no_data_text(plan.no_data, kind), metadata_xml(items), plan.grid, plan.projection)
    encoder = TileEncoder(kind, o.tile, code, level, predictor, plan.no_data, stretch, (norm.lo, norm.k, norm.dn_max) if norm else None, alpha)
    tables = tile_table(spark, plan, lay, encoder)
    total = sum(t.agg(F.coalesce(F.sum(F.octet_length("payload").cast("long")), F.lit(0))).first()[0] for t in tables)
    if not big and total > 0xFFFF0000:
        raise OptionError("over 4 GiB need --bigtiff yes")
    tiles = sum(np.prod(lay.tiles(k)) for k in range(len(sizes))) * (1 if interleaved else samples)
    if is_address(plan.output) or tiles > PLACED:
        write_file(plan.output, lay, tables, total)
    else:
        write_in_place(plan.output, lay, tables, total)
    for t in tables:
        drop(t)
    if norm:
        write_label(label_path(plan.output, cube.path), label_text(plan.output, cube, plan.bands, kind, norm, plan.grid, plan.projection, plan.warped))
    return plan.output


def report(plan: ConversionPlan, seconds: float) -> str:
    """What a conversion did: size, type, resolution, megabytes in and out, and speed."""
    c, g = plan.cube, plan.grid
    before = c.w * c.h * len(plan.bands) * c.type.size / 1e6
    unit = "" if plan.projection is None else f", {format_num(round6(g.resx))} {'deg' if plan.projection.geographic else 'm'} a pixel"
    return f"{plan.output}: {len(plan.bands)} of {g.w} x {g.h} {plan.kind.name}{unit}; {before:.1f} MB read, {file_size(plan.output) / 1e6:.1f} MB written, {seconds:.1f} s, {before / max(seconds, 1e-3):.0f} MB/s"


#: Cubes that are converted side by side.
AT_ONCE = 4


def convert(spark: SparkSession, inputs: list[str], o: Options, tell: Callable[[str], None] = lambda line: None) -> tuple[list[str], dict[str, str]]:
    """Converts each input; returns the files written and the inputs that failed with why, in the order of the inputs.

    ``tell`` is called with a line for each warning and each file. Whatever fails in a cube, on the driver or in a task,
    the others go on.
    """
    paths = expand_inputs(inputs)

    def one(path: str) -> tuple[str | None, str]:
        began = time.monotonic()
        try:
            plan = plan_conversion(path, o, len(paths) > 1)
            for warning in plan.warnings:
                tell(f"{path}: {warning}")
            execute(spark, plan)
            tell(report(plan, time.monotonic() - began))
            return plan.output, ""
        except Exception as e:  # a task's error comes as one of Spark's, with the worker's own error as its last line
            lines = [x.strip() for x in str(e).splitlines() if x.strip() and not x.lstrip().startswith(("at ", "File ", "...", "JVM"))]
            return None, next((x for x in reversed(lines) if "Error: " in x), lines[0] if lines else type(e).__name__)

    with ThreadPoolExecutor(max(1, min(AT_ONCE, len(paths)))) as pool:
        done = list(pool.map(one, paths))
    return [out for out, _ in done if out], {path: why for path, (out, why) in zip(paths, done) if not out}
