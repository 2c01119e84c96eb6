"""The label beside a normalised image: how to get values back, and where the image lies."""

from __future__ import annotations

import os
from datetime import datetime

from ..functions.projections import Projection
from ..operators.values import Normalization
from ..raster import Grid, PixelType
from ..sources.files import published
from ..sources.isis import Cube
from ..sources.pvl import number_text as num
from ..sources.pvl import quoted

#: Units of Mapping keywords.
UNITS = {k: "<meters>" for k in ("EquatorialRadius", "PolarRadius", "UpperLeftCornerX", "UpperLeftCornerY", "CenterLatitudeRadius")} | {"PixelResolution": "<meters/pixel>", "Scale": "<pixels/degree>"}


def label_path(output: str, source: str) -> str:
    """Beside the output, but never on the input."""
    path = os.path.splitext(output)[0] + ".lbl"
    return output + ".lbl" if os.path.abspath(path).lower() == os.path.abspath(source).lower() else path


def _group(name: str, items: list[tuple[str, str]]) -> list[str]:
    width = max(len(k) for k, _ in items)
    return [f"  Group = {name}", *(f"    {k.ljust(width)} = {v}" for k, v in items), "  End_Group", ""]


def _mapping(cube: Cube, grid: Grid) -> list[tuple[str, str]]:
    """The Mapping group with the corner and scale of ``grid``."""
    new = {"UpperLeftCornerX": num(grid.x0), "UpperLeftCornerY": num(grid.y0), "PixelResolution": num(grid.resx)}
    if (scale := cube.mapping.number("Scale", 0.0)) > 0:
        new["Scale"] = num(scale * cube.grid.resx / grid.resx)
    out = []
    for key, values in cube.mapping.items:
        text = new.get(key) or ", ".join(values)
        text = f"({text})" if len(values) > 1 else quoted(text) if any(c in text for c in " \t") else text
        out.append((key, f"{text} {UNITS[key]}" if key in UNITS else text))
    return out


def label_text(output: str, cube: Cube, bands: list[int], kind: PixelType, n: Normalization, grid: Grid, projection: Projection | None, warped: bool) -> str:
    """The label's text, lines ended by CR LF."""
    name = os.path.basename(output)
    lines = [f"/* Physical value = DN * Multiplier + Base, for the pixels of {name}. */", "", "Object = NormalizedImage", f"  ^Image       = {quoted(name)}", f"  SourceCube   = {quoted(os.path.abspath(cube.path))}", f"  CreationTime = {datetime.now():%Y-%m-%dT%H:%M:%S}", ""]
    lines += _group("Dimensions", [("Samples", str(grid.w)), ("Lines", str(grid.h)), ("Bands", str(len(bands)))])
    pixels = [("Type", kind.isis), ("ByteOrder", "Lsb"), ("Base", num(n.base)), ("Multiplier", num(n.multiplier)), ("DnRange", f"(0.0, {num(n.dn_max)})"), ("ValidMinimum", num(n.physical_lo)), ("ValidMaximum", num(n.physical_hi)), ("AlphaChannel", "Yes" if n.alpha else "No")]
    if n.alpha:
        pixels.append(("AlphaMeaning", quoted(f"last channel: {num(n.dn_max)} = data, 0 = no data (Null and other special pixels)")))
    lines += _group("Pixels", pixels)
    if cube.band_names:
        lines += _group("BandBin", [("Name", f"({', '.join(quoted(cube.band_names[b]) for b in bands)})")])
    if projection:
        if cube.mapping and cube.projection and projection.same(cube.projection):
            lines += _group("Mapping", _mapping(cube, grid))
        unit, body = "degrees" if projection.geographic else "meters", projection.geotiff.ellipsoid
        lines += _group("Georeference", [
            ("ProjString", quoted(projection.proj)), ("Projection", quoted(projection.title)), ("TargetName", quoted(body.name)), ("EquatorialRadius", f"{num(body.a)} <meters>"), ("PolarRadius", f"{num(body.b)} <meters>"),
            ("UpperLeftCornerX", f"{num(grid.x0)} <{unit}>"), ("UpperLeftCornerY", f"{num(grid.y0)} <{unit}>"), ("PixelResolutionX", f"{num(grid.resx)} <{unit}/pixel>"), ("PixelResolutionY", f"{num(grid.resy)} <{unit}/pixel>"), ("Reprojected", "Yes" if warped else "No"),
        ])
    return "\r\n".join([*lines, "End_Object", "End", ""])


def write_label(path: str, text: str) -> None:
    with published(path) as f:
        f.write(text.encode("utf-8"))
