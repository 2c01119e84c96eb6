"""Pixel types, affine grids and number texts."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np


@dataclass(frozen=True)
class PixelType:
    """A stored sample type. ``special`` are the values that mean "no data", as (low, high): outside of them, inclusive."""

    name: str
    isis: str
    spark: str
    valid: tuple[float, float]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.name)

    @property
    def size(self) -> int:
        return self.dtype.itemsize

    @property
    def is_float(self) -> bool:
        return self.dtype.kind == "f"

    @property
    def is_signed(self) -> bool:
        return self.dtype.kind in "if"

    @property
    def range(self) -> tuple[float, float]:
        info = np.finfo(self.dtype) if self.is_float else np.iinfo(self.dtype)
        return float(info.min), float(info.max)

    @property
    def no_data(self) -> float:
        """The default fill value of an output of this type."""
        if self.is_float:
            return NULL32 if self.size == 4 else NULL64
        return self.range[0] if self.is_signed else 0.0


def _bits32(bits: int) -> float:
    return float(np.array([bits], np.uint32).view(np.float32)[0])


def _bits64(bits: int) -> float:
    return float(np.array([bits], np.uint64).view(np.float64)[0])


#: The special-pixel constants of the cube format.
NULL32, LEAST32 = _bits32(0xFF7FFFFB), _bits32(0xFF7FFFFA)
NULL64, LEAST64 = _bits64(0xFFEFFFFFFFFFFFFB), _bits64(0xFFEFFFFFFFFFFFFA)

#: The sample types of the format, and the stored values that are data.
TYPES = {
    t.name: t
    for t in (
        PixelType("uint8", "UnsignedByte", "smallint", (1, 254)),
        PixelType("int8", "SignedByte", "tinyint", (-126, 127)),
        PixelType("int16", "SignedWord", "smallint", (-32752, 32767)),
        PixelType("uint16", "UnsignedWord", "int", (3, 65522)),
        PixelType("int32", "SignedInteger", "int", (-2147483632, 2147483647)),
        PixelType("uint32", "UnsignedInteger", "bigint", (3, 4294967282)),
        PixelType("float32", "Real", "float", (LEAST32, math.inf)),
        PixelType("float64", "Double", "double", (LEAST64, math.inf)),
    )
}
#: Other accepted spellings.
SPELLINGS = {"byte": "uint8", "u8": "uint8", "i8": "int8", "i16": "int16", "u16": "uint16", "i32": "int32", "u32": "uint32", "f32": "float32", "float": "float32", "real": "float32", "f64": "float64", "double": "float64"}
BY_ISIS = {t.isis.lower(): t for t in TYPES.values()}


def pixel_type(name: str) -> PixelType:
    low = name.strip().lower()
    low = SPELLINGS.get(low, low)
    if low not in TYPES:
        raise ValueError(f"unknown pixel type {name!r}")
    return TYPES[low]


@dataclass(frozen=True)
class Grid:
    """A north-up grid: w x h pixels, (x0, y0) the outer corner of the upper left one."""

    w: int
    h: int
    x0: float
    y0: float
    resx: float
    resy: float


def format_num(v: float) -> str:
    """The shortest text of a double, without exponent or trailing zeros."""
    if v == 0:
        return "0"
    if not math.isfinite(v):
        return "NaN" if math.isnan(v) else "+Inf" if v > 0 else "-Inf"
    text = format(Decimal(repr(float(v))), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def round6(v: float) -> float:
    """v to six significant digits."""
    if v == 0 or not math.isfinite(v):
        return v
    m = 10.0 ** (5 - math.floor(math.log10(abs(v))))
    return math.floor(v * m + 0.5) / m if v > 0 else -math.floor(-v * m + 0.5) / m
