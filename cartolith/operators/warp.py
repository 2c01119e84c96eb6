"""Reprojection of pixel tables.

An output grid is generated by ``range``, its pixel centres go through the inverse of the target and the forward of the
source projection as expressions, and source pixels are gathered by an equi-join on their numbers, or, for kernels of several
pixels, on those of their blocks. The transform is computed once for all bands. For whole files see
:mod:`cartolith.plans.convert`, which gathers block by block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.projections import Projection
from ..raster import Grid


def grid_pixels(spark: SparkSession, grid: Grid) -> DataFrame:
    """(line, sample) of every pixel of a grid."""
    n = F.lit(grid.w).cast("bigint")
    return spark.range(grid.w * grid.h).select(F.expr(f"cast(id div {grid.w} as int)").alias("line"), (F.col("id") % n).cast("int").alias("sample"))


def centers(grid: Grid) -> tuple[Column, Column]:
    """Columns x, y of pixel centres."""
    return F.lit(grid.x0) + (F.col("sample") + 0.5) * grid.resx, F.lit(grid.y0) - (F.col("line") + 0.5) * grid.resy


def wraps(source: Projection, grid: Grid) -> bool:
    """Whether a source image goes around the body, so that its columns repeat."""
    return source.period > 0 and abs(source.period / grid.resx - grid.w) < 0.01


def source_position(x, y, target: Projection, source: Projection, grid: Grid):
    """Source pixel coordinates u, v of points of the target plane; Columns or arrays. Equal projections pass straight through."""
    return plane_to_pixels(*source.forward(*target.inverse(x, y)), source, grid)


def plane_to_pixels(sx, sy, source: Projection, grid: Grid):
    from ..functions.backend import backend

    m = backend(sx)
    u, v = (sx - grid.x0) / grid.resx, (grid.y0 - sy) / grid.resy
    if source.period > 0:
        period = source.period / grid.resx
        u = u - m.floor((u - grid.w / 2) / period + 0.5) * period
    return u, v


def computed(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once: a one-row generator, through which filters and projections are not
    pushed, so that later uses of a column do not copy its expression over and over into generated code."""
    row = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select(*keep, F.inline(F.array(row)))


def positions(spark: SparkSession, target: Projection, out: Grid, source: Projection, grid: Grid) -> DataFrame:
    """(line, sample, u, v) of the output pixels that fall on the source image; u is wrapped into it where it repeats."""
    x, y = centers(out)
    at = computed(grid_pixels(spark, out), ["line", "sample"], x=x, y=y)
    lon, lat = target.inverse(F.col("x"), F.col("y"))
    at = computed(at, ["line", "sample"], lon=lon, lat=lat)
    sx, sy = source.forward(F.col("lon"), F.col("lat"))
    at = computed(at, ["line", "sample"], sx=sx, sy=sy)
    u, v = plane_to_pixels(F.col("sx"), F.col("sy"), source, grid)
    at = computed(at, ["line", "sample"], u=u, v=v)
    if wraps(source, grid):
        return at.where((F.col("v") >= 0) & (F.col("v") < grid.h) & F.col("u").isNotNull()).withColumn("u", F.col("u") - F.floor(F.col("u") / grid.w) * grid.w)
    return at.where((F.col("v") >= 0) & (F.col("v") < grid.h) & (F.col("u") >= 0) & (F.col("u") < grid.w))


def cubic_weight(t: Column) -> Column:
    """Catmull-Rom."""
    a = -0.5
    t = F.abs(t)
    near = ((a + 2) * t - (a + 3)) * t * t + 1
    far = ((a * t - 5 * a) * t + 8 * a) * t - 4 * a
    return F.when(t <= 1, near).when(t < 2, far).otherwise(F.lit(0.0))


#: The edge of the blocks that source pixels are put together in, as a power of two.
BITS = 6
EDGE = 1 << BITS


def source_blocks(source: DataFrame, w: int, reach: tuple[int, ...], wrap: bool) -> DataFrame:
    """(by, bx, band, data) of pixels (band, sl, ss, value): the values of a block and of the neighbours that a kernel takes around it.

    A block is of the pixels from (EDGE * by - 1, EDGE * bx - 1) on; ``data`` is by rows, EDGE - 1 wider than the kernel, NULL
    where there is no pixel. Of pixels in the same place the largest counts.
    """
    low, high = reach[0], reach[-1]
    width = EDGE + high - low

    def blocks(q: Column) -> Column:
        """The one or two blocks that hold a row or column, numbered from the first that a kernel takes at block 0."""
        own = F.shiftright(q, BITS)
        return F.explode(F.when((q.bitwiseAND(EDGE - 1) < high - low) & (q >= EDGE), F.array(own - 1, own)).otherwise(F.array(own)))

    column = F.col("ss")
    if wrap:
        again = F.array(*(F.col("ss") + k * w for k in range(low // w, (w - 1 + high) // w + 1)))
        column = F.explode(F.filter(again, lambda c: c.between(low, w - 1 + high)))
    cells = source.select("band", "value", (F.col("sl") + (1 - low)).alias("ql"), column.alias("qs")).withColumn("qs", F.col("qs") + (1 - low))
    cells = cells.select("*", blocks(F.col("ql")).alias("by")).select("*", blocks(F.col("qs")).alias("bx"))
    at = (F.col("ql") - F.col("by") * EDGE) * width + F.col("qs") - F.col("bx") * EDGE

    def together(t: pa.Table) -> pa.Table:
        place, value = t["at"].to_numpy(), t["value"].to_numpy()
        out, missing = np.full(width * width, -np.inf), np.ones(width * width, bool)
        np.maximum.at(out, place, value)
        missing[place] = False
        data = pa.ListArray.from_arrays(pa.array([0, out.size], pa.int32()), pa.array(out, mask=missing))
        return pa.table({k: t[k][:1] for k in ("by", "bx", "band")} | {"data": data})

    kind = source.schema["band"].dataType.simpleString()
    return cells.select("by", "bx", "band", at.alias("at"), "value").groupBy("by", "bx", "band").applyInArrow(together, f"by int, bx int, band {kind}, data array<double>")


def resample(at: DataFrame, pixels: DataFrame, grid: Grid, kernel: str, wrap: bool) -> DataFrame:
    """(band, line, sample, value) for the positions ``at`` (line, sample, u, v) of a source of size ``grid``.

    nearest: the pixel that holds the point. bilinear: the weighted mean of the valid ones of four. cubic: all sixteen,
    or bilinear where one is missing. The pixel that holds the point must be valid for any result. Positions without a
    result have no row. Source pixels come in blocks with their neighbours, so a position is joined once, with the block
    that holds all it takes; values are added in a fixed order, so results do not depend on the order of a shuffle.
    """
    source = pixels.select("band", F.col("line").alias("sl"), F.col("sample").alias("ss"), F.col("value").cast("double").alias("value")).where("value is not null")
    if kernel == "nearest":
        cell = at.withColumns({"cl": F.floor("v").cast("int"), "cs": F.floor("u").cast("int")})
        if wrap:
            cell = cell.withColumn("cs", F.pmod("cs", F.lit(grid.w)))
        return cell.join(source, (F.col("cl") == F.col("sl")) & (F.col("cs") == F.col("ss"))).select("band", "line", "sample", "value")
    reach = {"bilinear": (0, 1), "cubic": (-1, 0, 1, 2)}[kernel]
    low, width = reach[0], EDGE + reach[-1] - reach[0]
    base = at.withColumns({"bl": F.floor(F.col("v") - 0.5), "bs": F.floor(F.col("u") - 0.5)})
    base = base.select("line", "sample", (F.col("v") - 0.5 - F.col("bl")).alias("fv"), (F.col("u") - 0.5 - F.col("bs")).alias("fu"), ((F.floor("v") - F.col("bl")) * width + F.floor("u") - F.col("bs")).cast("int").alias("center"), F.col("bl").cast("int").alias("bl"), F.col("bs").cast("int").alias("bs"))
    if wrap:
        base = base.withColumn("bs", F.pmod("bs", F.lit(grid.w)))
    base = base.withColumns({"by": F.shiftright(F.col("bl") + 1, BITS), "bx": F.shiftright(F.col("bs") + 1, BITS)})
    home = (F.col("bl") + 1 - low - F.col("by") * EDGE) * width + F.col("bs") + 1 - low - F.col("bx") * EDGE
    base = base.select("line", "sample", "fv", "fu", "by", "bx", "center", home.alias("home"))
    joined = base.join(source_blocks(source, grid.w, reach, wrap).hint("merge"), ["by", "bx"]).where(F.get("data", F.col("home") + F.col("center")).isNotNull())
    got = computed(joined, ["band", "line", "sample", "fu", "fv"], **{f"v{dy + 1}{dx + 1}": F.get("data", F.col("home") + (dy * width + dx)) for dy in reach for dx in reach})
    total, weight = F.lit(0.0), F.lit(0.0)
    for dy in (0, 1):
        for dx in (0, 1):
            v = F.col(f"v{dy + 1}{dx + 1}")
            w = (F.col("fu") if dx else 1 - F.col("fu")) * (F.col("fv") if dy else 1 - F.col("fv"))
            total = total + F.when(v.isNotNull(), v * w).otherwise(F.lit(0.0))
            weight = weight + F.when(v.isNotNull(), w).otherwise(F.lit(0.0))
    result = F.when(weight >= 1e-9, total / weight)
    if kernel == "cubic":
        whole, every = F.lit(0.0), F.lit(True)
        for dy in reach:
            row = F.lit(0.0)
            for dx in reach:
                v = F.col(f"v{dy + 1}{dx + 1}")
                row = row + v * cubic_weight(F.col("fu") - dx)
                every = every & v.isNotNull()
            whole = whole + row * cubic_weight(F.col("fv") - dy)
        result = F.when(every, whole).otherwise(result)
    return got.select("band", "line", "sample", result.alias("value")).where("value is not null")


def warp(pixels: DataFrame, source: Projection, grid: Grid, target: Projection, out: Grid, kernel: str = "bilinear", bands: list[int] | None = None, at: DataFrame | None = None) -> DataFrame:
    """``pixels`` of ``grid`` on the grid ``out``: every output pixel of every band, NULL where there is no data.

    ``at`` are the positions (line, sample, u, v), where they are known otherwise than by :func:`positions`.
    """
    spark = pixels.sparkSession
    aligned = source.same(target) and math.isclose(grid.resx, out.resx, rel_tol=1e-12) and math.isclose(grid.resy, out.resy, rel_tol=1e-12)
    dx, dy = (out.x0 - grid.x0) / grid.resx, (grid.y0 - out.y0) / grid.resy
    if aligned and abs(dx - round(dx)) < 1e-6 and abs(dy - round(dy)) < 1e-6:
        from .values import crop

        found = crop(pixels.select("band", "line", "sample", "value"), round(dx), round(dy), out.w, out.h)
    else:
        found = resample(positions(spark, target, out, source, grid) if at is None else at, pixels, grid, kernel, wraps(source, grid))
    names = spark.createDataFrame([(b,) for b in bands], "band int") if bands else pixels.select("band").distinct()
    return grid_pixels(spark, out).crossJoin(F.broadcast(names)).join(found, ["band", "line", "sample"], "left").select("band", "line", "sample", "value")
