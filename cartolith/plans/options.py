"""User options of a conversion, with their defaults and checks."""

from __future__ import annotations

import os
from dataclasses import dataclass

from ..raster import TYPES, PixelType, pixel_type
from ..sources.isis import Cube


class OptionError(ValueError):
    pass


@dataclass(frozen=True)
class Options:
    output: str = ""
    bands: tuple[int, ...] = ()
    raw: bool = False
    type: str = ""
    stretch: str = ""
    normalize: str = ""  # float32, float64, uint8 or uint16
    nodata: str = ""
    proj: str = ""
    lat_type: str = ""
    res: str = ""
    bounds: str = ""
    extent: str = ""
    size: str = ""
    resample: str = "bilinear"
    approximate: bool = False  # interpolate source positions along rows, to an eighth of a pixel
    overviews: bool = False
    overview_method: str = "average"
    compress: str = "deflate"
    level: int = 0  # 0: the codec's default
    predictor: int = 0  # 0: by type
    tile: int = 512
    interleave: bool = False
    bigtiff: str = "auto"
    threads: int = 0  # tasks that make the tiles of a conversion; 0: four for each core
    cache: int = 96  # megabytes of decoded source blocks that a task keeps

    @property
    def wants_warp(self) -> bool:
        return any((self.proj, self.res, self.bounds, self.extent, self.size))


def output_type(cube: Cube, o: Options) -> PixelType:
    """The stored type of the output."""
    if o.normalize:
        found = pixel_type(o.normalize)
        if found.name not in ("float32", "float64", "uint8", "uint16"):
            raise OptionError("--normalize takes float32, float64, uint8 or uint16")
        return found
    if o.stretch:
        if o.type and pixel_type(o.type).name != "uint8":
            raise OptionError("--stretch output is uint8")
        return TYPES["uint8"]
    if o.type:
        return pixel_type(o.type)
    if cube.has_scaling and not o.raw:
        return TYPES["float64" if cube.type.name == "float64" else "float32"]
    return cube.type


def chosen_bands(cube: Cube, o: Options) -> list[int]:
    """Band numbers from 0, in the order asked."""
    if not o.bands:
        return list(range(cube.bands))
    if any(not 1 <= b <= cube.bands for b in o.bands):
        raise OptionError(f"bands must be from 1 to {cube.bands}")
    return [b - 1 for b in o.bands]


def chosen_no_data(kind: PixelType, o: Options) -> float | None:
    """The fill value of the output; None when it has none."""
    if o.stretch and o.normalize:
        raise OptionError("use either --stretch or --normalize")
    if o.normalize:
        if o.nodata:
            raise OptionError("--normalize marks no data in the alpha channel")
        return None
    if o.stretch:
        return 0.0
    if not o.nodata:
        return kind.no_data
    if o.nodata.lower() == "none":
        return None
    try:
        value = float(o.nodata)
    except ValueError:
        raise OptionError(f"bad --nodata {o.nodata!r}") from None
    if value != value and not kind.is_float:
        raise OptionError("--nodata nan needs a float type")
    if not kind.is_float and not kind.range[0] <= value <= kind.range[1]:
        raise OptionError(f"--nodata {o.nodata} does not fit {kind.name}")
    return value


#: TIFF compression codes, default levels and their limits.
CODECS = {"none": (1, 0, (0, 0)), "deflate": (8, 6, (1, 9)), "zstd": (50000, 3, (1, 22))}


def chosen_compression(kind: PixelType, o: Options) -> tuple[int, int, int]:
    """TIFF compression code, level and predictor."""
    if o.compress not in CODECS:
        raise OptionError(f"unknown compression {o.compress!r}")
    code, default, (low, high) = CODECS[o.compress]
    level = o.level or default
    if not low <= level <= high:
        raise OptionError(f"--level for {o.compress} is {low} to {high}")
    if not 16 <= o.tile <= 4096 or o.tile % 16:
        raise OptionError("--tile must be a multiple of 16 from 16 to 4096")
    predictor = o.predictor or (3 if kind.is_float else 2)
    if predictor not in (1, 2, 3) or predictor == 3 and not kind.is_float:
        raise OptionError("--predictor is 1, 2, or 3 for float types")
    return code, level, 1 if code == 1 else predictor


def output_path(source: str, o: Options, several: bool) -> str:
    """Where an output goes: beside its source, in the folder asked, or the file asked when there is one source."""
    name = os.path.splitext(os.path.basename(source))[0] + ".tif"
    if not o.output:
        return os.path.join(os.path.dirname(source), name)
    if o.output.endswith(("/", os.sep)) or os.path.isdir(o.output) or several and os.path.splitext(o.output)[1].lower() not in (".tif", ".tiff"):
        return os.path.join(o.output, name)
    if several:
        raise OptionError("with several inputs the output must be a folder")
    return o.output
