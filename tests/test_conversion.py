"""Whole conversions, read back by a small TIFF reader of the tests' own, against whole-image numpy."""

import math
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.cli import join_negative, main
from cartolith.operators import pyramid, values, warp
from cartolith.plans.convert import convert, halve_block, plan_conversion
from cartolith.plans.grid import GridError, GridRequest, plan_grid, plan_warp
from cartolith.plans.options import OptionError, Options, chosen_compression, chosen_no_data, output_path, output_type
from cartolith.plans.spec import parse_spec
from cartolith.queries import MOON, demo_cube, write_cube
from cartolith.raster import TYPES, Grid
from cartolith.sinks.geotiff import geo_keys, no_data_text, predict
from cartolith.sources.isis import decode, open_cube, read_window
from cartolith.sources.pvl import parse

SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 12: 8, 16: 8}
LETTERS = {1: "B", 2: "c", 3: "H", 4: "I", 12: "d", 16: "Q"}


def read_tiff(path):
    """[(tags, array (h, w, samples))] of all directories."""
    data = open(path, "rb").read()
    big = struct.unpack("<H", data[2:4])[0] == 43
    at = struct.unpack("<Q", data[8:16])[0] if big else struct.unpack("<I", data[4:8])[0]
    out = []
    while at:
        assert at % 2 == 0
        n = struct.unpack("<Q", data[at : at + 8])[0] if big else struct.unpack("<H", data[at : at + 2])[0]
        at += 8 if big else 2
        tags = {}
        for k in range(n):
            e = data[at + k * (20 if big else 12) :]
            tag, kind = struct.unpack("<HH", e[:4])
            count = struct.unpack("<Q", e[4:12])[0] if big else struct.unpack("<I", e[4:8])[0]
            inline = e[12:20] if big else e[8:12]
            size = SIZES[kind] * count
            raw = inline[:size] if size <= len(inline) else data[(o := struct.unpack("<Q" if big else "<I", inline)[0]) : o + size]
            tags[tag] = raw[:-1].decode() if kind == 2 else list(struct.unpack(f"<{count}{LETTERS[kind]}", raw))
        assert list(tags) == sorted(tags)
        at += n * (20 if big else 12)
        at = struct.unpack("<Q", data[at : at + 8])[0] if big else struct.unpack("<I", data[at : at + 4])[0]
        out.append((tags, pixels(data, tags)))
    return out


def pixels(data, tags):
    w, h, t, spp = tags[256][0], tags[257][0], tags[322][0], tags[277][0]
    kind = np.dtype({1: "u", 2: "i", 3: "f"}[tags[339][0]] + str(tags[258][0] // 8)).newbyteorder("<")
    interleaved = tags[284][0] == 1
    planes, s = (1, spp) if interleaved else (spp, 1)
    across, down = -(-w // t), -(-h // t)
    out = np.zeros((down * t, across * t, spp), kind)
    for i, (o, n) in enumerate(zip(tags[324], tags[325])):
        raw = data[o : o + n]
        if tags[259][0] == 8:
            raw = zlib.decompress(raw)
        elif tags[259][0] == 50000:
            import zstandard

            raw = zstandard.ZstdDecompressor().decompress(raw)
        predictor = tags.get(317, [1])[0]
        if predictor == 3:
            rows = np.frombuffer(raw, np.uint8).reshape(t, -1).copy()
            for c in range(s, rows.shape[1]):
                rows[:, c] += rows[:, c - s]
            tile = np.ascontiguousarray(rows.reshape(t, kind.itemsize, t * s)[:, ::-1].transpose(0, 2, 1)).view(kind).reshape(t, t, s)
        else:
            tile = np.frombuffer(raw, kind).reshape(t, t, s)
            if predictor == 2:
                tile = np.add.accumulate(tile.view(f"<u{kind.itemsize}"), axis=1, dtype=f"<u{kind.itemsize}").view(kind)
        plane, rest = divmod(i, across * down)
        y, x = rest // across * t, rest % across * t
        out[y : y + t, x : x + t, slice(None) if interleaved else slice(plane, plane + 1)] = tile
    return out[:h, :w]


def whole(path, raw=False):
    c = open_cube(path)
    return c, np.stack([decode(c, read_window(c, b, 0, 0, c.w, c.h), raw) for b in range(c.bands)])


@pytest.fixture(scope="module")
def demo(tmp_path_factory):
    return demo_cube(str(tmp_path_factory.mktemp("demo")))


def run(spark, path, tmp_path, **more):
    written, failed = convert(spark, [path], Options(output=f"{tmp_path}/", **{"tile": 32, **more}))
    assert not failed, failed
    return read_tiff(written[0])


@pytest.mark.parametrize("more", [{}, {"compress": "none"}, {"compress": "zstd", "bigtiff": "yes"}, {"interleave": True, "predictor": 2}, {"type": "int16", "bands": (2, 1)}, {"type": "float64", "nodata": "nan"}])
def test_copy(spark, demo, tmp_path, more):
    c, v = whole(demo)
    ((tags, got),) = run(spark, demo, tmp_path, **more)
    kind = TYPES[more.get("type", "float32")]
    fill = math.nan if more.get("nodata") == "nan" else kind.no_data
    want = np.where(np.isnan(v), fill, v).astype(kind.dtype)
    if "bands" in more:
        want = want[::-1]
    assert np.array_equal(np.moveaxis(got, 2, 0), want, equal_nan=kind.is_float)
    assert tags[33922] == [0, 0, 0, c.grid.x0, c.grid.y0, 0] and tags[33550][0] == c.grid.resx
    assert np.array_equal(np.array([tags[42113]], kind.dtype), np.array([fill], kind.dtype), equal_nan=kind.is_float)
    assert "TARGET_NAME" in tags[42112] and tags[34735][3] == len(tags[34735]) // 4 - 1


@pytest.mark.parametrize("method", ["average", "nearest"])
def test_overviews(spark, demo, tmp_path, method):
    _, v = whole(demo)
    levels = run(spark, demo, tmp_path, overviews=True, overview_method=method, tile=16)
    assert [x.shape[:2] for _, x in levels] == [(60, 120), (30, 60), (15, 30), (8, 15)]
    for k, (tags, got) in enumerate(levels):
        assert tags[254] == [int(k > 0)]
        assert np.array_equal(np.moveaxis(got, 2, 0), np.where(np.isnan(v), TYPES["float32"].no_data, v).astype("f4"))
        v = np.stack([halve_block(b, method) for b in v])


def test_overview_sizes():
    assert pyramid.overview_sizes(1500, 700, 512) == [(1500, 700), (750, 350), (375, 175)]


def test_pyramid_table_equals_blocks(spark):
    v = np.where(np.arange(7 * 9).reshape(7, 9) % 5 == 0, np.nan, np.arange(63.0).reshape(7, 9))
    rows = [(1, int(y), int(x), None if np.isnan(v[y, x]) else float(v[y, x])) for y, x in np.ndindex(v.shape)]
    table = spark.createDataFrame(rows, "band int, line int, sample int, value double")
    for method in ("average", "nearest"):
        got = {(r["level"], r["line"], r["sample"]): r["value"] for r in pyramid.pyramid(table, 9, 7, 2, method).collect()}
        want, level = {}, v
        for k in range(len(pyramid.overview_sizes(9, 7, 2))):
            want |= {(k, y, x): None if np.isnan(level[y, x]) else level[y, x] for y, x in np.ndindex(level.shape)}
            level = halve_block(level, method)
        assert got == pytest.approx(want)


def test_stretch_and_normalize(spark, demo, tmp_path):
    _, v = whole(demo)
    ((tags, got),) = run(spark, demo, tmp_path, stretch="minmax")
    lo, hi = np.nanmin(v, axis=(1, 2)), np.nanmax(v, axis=(1, 2))
    want = np.floor(1 + (v - lo[:, None, None]) * 254 / (hi - lo)[:, None, None] + 0.5)
    assert np.array_equal(np.moveaxis(got, 2, 0), np.where(np.isnan(v), 0, want).astype("u1")) and tags[42113] == "0"
    ((tags, got),) = run(spark, demo, tmp_path, normalize="uint16", overviews=True)
    lo, hi = np.nanmin(v), np.nanmax(v)
    assert tags[277] == [3] and tags[338] == [0, 2] and 42113 not in tags
    assert (got[:, :, 2] == np.where(np.isnan(v).all(axis=0), 0, 65535)).all()
    back = got[:, :, :2] * (hi - lo) / 65535 + lo
    good = ~np.isnan(np.moveaxis(v, 0, 2))
    assert np.abs(back - np.moveaxis(v, 0, 2))[good].max() <= (hi - lo) / 65535 * 0.5 + 1e-9
    label = parse((tmp_path / "demo.lbl").read_text())[0].child("NormalizedImage")
    pix = label.child("Pixels")
    assert pix.number("Base") == lo and pix.number("Multiplier") == (hi - lo) / 65535 and pix.text("AlphaChannel") == "Yes"
    assert label.child("Mapping").number("PixelResolution") == pytest.approx(2 * math.pi * MOON.a / 120)


@pytest.mark.parametrize("kernel", ["nearest", "bilinear", "cubic"])
@pytest.mark.parametrize("proj", ["sinu:clon=40", "ps:north"])
def test_warp_file_equals_table(spark, demo, tmp_path, kernel, proj):
    plan = plan_conversion(demo, Options(proj=proj, res="150000", resample=kernel))
    ((tags, got),) = run(spark, demo, tmp_path, proj=proj, res="150000", resample=kernel, type="float64", nodata="nan")
    c, v = whole(demo)
    rows = [(b + 1, int(y), int(x), None if np.isnan(v[b, y, x]) else float(v[b, y, x])) for b, y, x in np.ndindex(v.shape)]
    table = spark.createDataFrame(rows, "band int, line int, sample int, value double")
    out = warp.warp(table, c.projection, c.grid, plan.projection, plan.grid, kernel, [1, 2])
    assert out.count() == 2 * plan.grid.w * plan.grid.h
    want = np.full(got.shape, np.nan)
    for r in out.where("value is not null").collect():
        want[r["line"], r["sample"], r["band"] - 1] = r["value"]
    assert (~np.isnan(want)).mean() > 0.2
    assert np.array_equal(np.isnan(want), np.isnan(got)) and np.nanmax(np.abs(want - got)) < 1e-6


def test_same_projection_is_a_crop(spark, demo):
    c, v = whole(demo)
    rows = [(1, int(y), int(x), float(y * 1000 + x)) for y, x in np.ndindex(v.shape[1:])]
    table = spark.createDataFrame(rows, "band int, line int, sample int, value double")
    g = Grid(10, 5, c.grid.x0 + 7 * c.grid.resx, c.grid.y0 - 3 * c.grid.resy, c.grid.resx, c.grid.resy)
    out = warp.warp(table, c.projection, c.grid, c.projection, g)
    assert {(r["line"], r["sample"]): r["value"] for r in out.collect()} == {(y, x): (y + 3) * 1000 + x + 7.0 for y in range(5) for x in range(10)}


def test_grid_planning(demo):
    c = open_cube(demo)
    same = plan_warp(c, Options(extent="0,0,500000,300000"))[1]
    assert (same.x0 - c.grid.x0) / c.grid.resx == pytest.approx(60) and same.w == math.ceil(500000 / c.grid.resx)
    sized = plan_warp(c, Options(proj="sinu", size="50,20"))[1]
    assert (sized.w, sized.h) == (50, 20) and sized.resx * 50 == pytest.approx(2 * math.pi * MOON.a, rel=1e-3)
    geo = plan_warp(c, Options(proj="geo", bounds="-30,-20,60,40"))[1]
    assert geo.x0 == pytest.approx(-30) and geo.y0 == pytest.approx(42) and (geo.w, geo.h, geo.resx) == (30, 21, pytest.approx(3)) or geo.w == 30
    for bad in ({"res": "1,2,3"}, {"res": "-1"}, {"bounds": "10,0,5,1"}, {"size": "5,5", "res": "10"}, {"res": "0.01"}):
        with pytest.raises(GridError):
            plan_warp(c, Options(proj="sinu", **bad))
    with pytest.raises(GridError):
        plan_grid(c, parse_spec("ortho:clat=0,clon=0", c), GridRequest(res=1000.0, bounds=(170.0, -10.0, 190.0, 10.0)))


@pytest.mark.parametrize("spec,part", [("sinu", "+proj=sinu +lon_0=0"), ("ortho:clat=30", "+proj=ortho +lat_0=30"), ("ps:south", "+lat_0=-90"), ("PolarStereographic:clat=70", "+lat_ts=70"), ("merc", "+proj=merc"), ("tm:clon=12,k=0.9996", "+lon_0=12 +k=0.9996"), ("lcc:par1=20", "+lat_1=20 +lat_2=20"), ("laea:n", "+lat_0=90"), ("geo", "+proj=longlat"), ("+proj=stere +lat_0=90 +lat_ts=75 +lon_0=10 +R=1000 +units=m", "+lat_ts=75 +lon_0=10"), ("+proj=eqc +lat_ts=30 +lat_0=10", "+lat_ts=30 +lat_0=10")])
def test_specs(demo, spec, part):
    assert part in parse_spec(spec, open_cube(demo)).proj


@pytest.mark.parametrize("spec", ["peirce", "sinu:zoom=3", "sinu:clon=x", "ps:east", "+proj=merc +ellps=WGS84", "+proj=stere +lat_0=45", "+proj=laea +x_0=5", "lcc"])
def test_refused_specs(demo, spec):
    with pytest.raises(ValueError):
        parse_spec(spec, open_cube(demo))


def test_options(demo, tmp_path):
    c = open_cube(demo)
    assert output_type(c, Options()).name == "float32" and output_type(c, Options(stretch="auto")).name == "uint8" and output_type(c, Options(normalize="u16")).name == "uint16"
    assert chosen_no_data(TYPES["int16"], Options()) == -32768 and chosen_no_data(TYPES["uint8"], Options(nodata="none")) is None
    for bad in (Options(compress="lzw"), Options(level=12), Options(tile=100), Options(predictor=3)):
        with pytest.raises(OptionError):
            chosen_compression(TYPES["int16"], bad)
    assert chosen_compression(TYPES["float32"], Options()) == (8, 6, 3) and chosen_compression(TYPES["int16"], Options(compress="none")) == (1, 0, 1)
    assert output_path("/a/b.cub", Options(), False) == "/a/b.tif" and output_path("/a/b.cub", Options(output="/o/"), True) == "/o/b.tif" and output_path("/a/b.cub", Options(output="/o/c.tif"), False) == "/o/c.tif"
    with pytest.raises(OptionError):
        output_path("/a/b.cub", Options(output="c.tif"), True)
    with pytest.raises(OptionError):
        plan_conversion(demo, Options(output=demo))
    text = no_data_text(TYPES["float32"].no_data, TYPES["float32"])
    assert np.float32(float(text)) == np.float32(TYPES["float32"].no_data) and no_data_text(math.nan, TYPES["float32"]) == "nan"


def test_predictors():
    v = np.arange(48, dtype="<i2").reshape(4, 6, 2)
    d = np.frombuffer(predict(v, 2), "<i2").reshape(4, 6, 2)
    assert (np.cumsum(d, axis=1) == v).all()


def test_geo_keys(demo):
    keys, doubles, text = geo_keys(parse_spec("lcc:par1=20,par2=50", open_cube(demo)))
    ids = keys[4::4]
    assert ids == sorted(ids) and keys[:4] == [1, 1, 0, len(ids)] and doubles[:2] == [MOON.a, MOON.b] and "GCS_Moon" in text


def test_values_on_columns(spark):
    rows = spark.createDataFrame([(-2.5,), (2.5,), (300.0,), (None,), (1e300,)], "v double")
    enc = lambda kind: [r[0] for r in rows.select(values.encoded(F.col("v"), TYPES[kind])).collect()]
    assert enc("int16") == [-3, 3, 300, -32768, 32767] and enc("uint8") == [0, 3, 255, 0, 255]
    assert enc("float32")[4] == pytest.approx(3.4028234663852886e38)
    assert [r[0] for r in rows.select(values.stretched(F.col("v"), 0.0, 0.0)).collect()] == [128, 128, 128, 0, 128]


def test_command_line(spark, demo, tmp_path, capsys):
    assert join_negative(["--bounds", "-30,-20,60,40", "a.cub"]) == ["--bounds=-30,-20,60,40", "a.cub"]
    assert main([demo, "-o", f"{tmp_path}/x.tif", "-p", "sinu", "--tile", "64"], spark) == 0
    assert read_tiff(f"{tmp_path}/x.tif")[0][1].shape[2] == 2
    assert main(["--info", demo], spark) == 0 and "samples: 120" in capsys.readouterr().out
    (tmp_path / "bad.cub").write_text("End")
    assert main([str(tmp_path / "bad.cub")], spark) == 1 and main(["--tile"], spark) == 2 and main(["nothing.cub"], spark) == 2
    assert not os.path.exists(tmp_path / "bad.tif.partial")


def test_unmapped_cube(spark, tmp_path):
    path = write_cube(str(tmp_path / "plain.cub"), [np.arange(20.0).reshape(4, 5)], kind="int16", base=10.0, multiplier=2.0)
    ((tags, got),) = run(spark, path, tmp_path, raw=True, tile=16)
    assert 33550 not in tags and (got[:, :, 0] == np.arange(20).reshape(4, 5)).all() and 'role="scale">2.0' in tags[42112]
    ((tags, got),) = run(spark, path, tmp_path, tile=16)
    assert got.dtype == np.float32 and got[1, 0, 0] == 20.0
    assert convert(spark, [path], Options(proj="sinu"))[1]


def test_streaming(spark, tmp_path):
    from cartolith.streaming.ingest import arriving, labels, running_range

    folder = tmp_path / "in"
    folder.mkdir()
    demo_cube(str(folder))
    for name, df, mode in (("lab", labels(arriving(spark, str(folder))), "append"), ("ran", running_range(arriving(spark, str(folder))), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [(r["samples"], r["bands"]) for r in spark.table("lab").collect()] == [(120, 2)]
    got = {r["band"]: (r["lo"], r["hi"]) for r in spark.table("ran").collect()}
    _, v = whole(str(folder / "demo.cub"))
    assert got == {b + 1: (np.nanmin(v[b]), np.nanmax(v[b])) for b in range(2)}


def test_interpolated_positions(demo):
    from cartolith.plans.convert import interpolated

    plan = plan_conversion(demo, Options(proj="ortho:clon=20,clat=30", res="9000"))
    x, y = np.meshgrid(plan.grid.x0 + (np.arange(300) + 0.5) * 9000, plan.grid.y0 - (np.arange(200) + 0.5) * 9000)
    calls = []

    def place(a, b):
        calls.append(a.size)
        with np.errstate(all="ignore"):
            return warp.source_position(a, b, plan.projection, plan.cube.projection, plan.cube.grid)

    for near, exact in zip(interpolated(place, x, y), place(x, y)):
        assert np.array_equal(np.isnan(near), np.isnan(exact)) and np.nanmax(np.abs(near - exact)) < 0.25
    assert sum(calls[:3]) < 0.6 * x.size


def test_source_predicate_on_columns(spark, demo):
    from cartolith.plans.grid import in_source

    c = open_cube(demo)
    c.w = 40
    pts = [(0.1 * i, 0.1 * j) for i in range(-31, 32, 3) for j in range(-15, 16, 3)]
    got = spark.createDataFrame(pts, "lon double, lat double").select(in_source(c, F.col("lon"), F.col("lat")).alias("x")).collect()
    want = in_source(c, *(np.array(a) for a in zip(*pts)))
    assert [bool(r["x"]) for r in got] == want.tolist() and 0 < want.sum() < len(pts)


def test_summary(spark, demo, tmp_path):
    from cartolith.sources.isis import cube_info, summary

    (tmp_path / "bad.cub").write_text("End")
    row = summary(cube_info(spark, [demo, str(tmp_path / "bad.cub")])).first()
    assert (row["readable"], row["unreadable"], row["mapped"], row["bands"], row["reference"]) == (1, 1, 1, 2, demo)


def test_listing_and_common_folder(spark, demo, tmp_path):
    from cartolith.sources.isis import common_folder, cube_info, listing

    (tmp_path / "bad.cub").write_text("End")
    rows = listing(cube_info(spark, [demo, str(tmp_path / "bad.cub")]), limit=15).collect()
    by_name = {os.path.basename(r["path"]): r for r in rows}
    assert by_name["demo.cub"]["cube"].startswith("120x60x2 float32, ") and by_name["demo.cub"]["problem"] is None
    assert by_name["bad.cub"]["cube"] is None and "IsisCube" in by_name["bad.cub"]["problem"]
    assert listing(cube_info(spark, [demo, str(tmp_path / "bad.cub")]), limit=1).count() == 1
    assert common_folder(["/a/b/c.cub", "/a/b/d/e.cub"]) == "/a/b" and common_folder([]) == "" and common_folder(["/a/x.cub", "b.cub"]) == ""


def test_one_bad_cube_does_not_end_a_batch(spark, tmp_path, monkeypatch):
    from cartolith.plans import convert as plans

    good, cut = (write_cube(str(tmp_path / n), [np.arange(64.0).reshape(8, 8)]) for n in ("good.cub", "other.cub"))
    write_cube(str(tmp_path / "late.cub"), [np.arange(64.0).reshape(8, 8)])
    planned = plans.plan_conversion

    def vanishing(path, *more):  # a file that goes between planning and reading: the error is a task's
        plan = planned(path, *more)
        if path.endswith("late.cub"):
            os.remove(path)
        return plan

    monkeypatch.setattr(plans, "plan_conversion", vanishing)
    told = []
    written, failed = plans.convert(spark, [str(tmp_path)], Options(output=f"{tmp_path}/out/", tile=16), told.append)
    assert sorted(map(os.path.basename, written)) == ["good.tif", "other.tif"] and list(map(os.path.basename, failed)) == ["late.cub"]
    assert "late.cub" in failed[str(tmp_path / "late.cub")] and sum("MB/s" in t for t in told) == 2
    assert sorted(os.listdir(tmp_path / "out")) == ["good.tif", "other.tif"]


def test_files_come_back_through_the_source(spark, demo, tmp_path):
    from cartolith.sources.geotiff import TiffError, directories, register

    register(spark)
    _, v = whole(demo)
    for more in ({}, {"interleave": True, "type": "int16", "compress": "zstd"}, {"overviews": True, "bigtiff": "yes", "compress": "none"}):
        levels = run(spark, demo, tmp_path, nodata="-7", **more)
        path = str(tmp_path / "demo.tif")
        got = {(r["level"], r["band"], r["line"], r["sample"]): r["value"] for r in spark.read.format("geotiff").load(path).collect()}
        want = {(k, b + 1, y, x): float(a[y, x, b]) for k, (_, a) in enumerate(levels) for y, x, b in np.ndindex(a.shape)}
        assert got == want
    assert spark.read.format("geotiff").option("level", 9).load(path).count() == 0
    data = (tmp_path / "demo.tif").read_bytes()
    (tmp_path / "cut.tif").write_bytes(data[:-40])
    with pytest.raises(TiffError):
        directories(str(tmp_path / "cut.tif"))


def test_tasks_and_driver_write_the_same_file(spark, demo, tmp_path, monkeypatch):
    from cartolith.plans import convert as plans

    files = []
    for most in (plans.PLACED, 0):
        monkeypatch.setattr(plans, "PLACED", most)
        run(spark, demo, tmp_path, overviews=True)
        files.append((tmp_path / "demo.tif").read_bytes())
    assert files[0] == files[1]


def test_command_line_options(capsys):
    from cartolith import __version__
    from cartolith.cli import Progress, options_of, parser

    def options(*args):
        got = vars(parser().parse_intermixed_args(["a.cub", *args]))
        return options_of({k: v for k, v in got.items() if k not in ("inputs", "info", "quiet")})

    assert options("--normalize", "--type", "uint16").normalize == "uint16" and options("--normalize").normalize == "float32"
    assert options("--out", "x", "-r", "cubic", "--t_srs", "sinu", "--ov-resample", "nearest") == Options(output="x", resample="cubic", proj="sinu", overview_method="nearest")
    assert options("--predictor", "none").predictor == 1 and options("--approximate", "--exact").approximate is False
    assert (options("--threads", "3", "--cache", "10").threads, options("--cache", "10").cache) == (3, 10)
    with pytest.raises(OptionError):
        options("--predictor", "lzw")
    assert main(["--version"]) == 0 and __version__ in capsys.readouterr().out
    assert Progress.bar(1, 4, 8) == "[##......] 1 of 4" and Progress.bar(0, 0, 2) == "[..] 0 of 0"


def test_input_is_not_overwritten_in_other_letters(demo):
    with pytest.raises(OptionError):
        plan_conversion(demo, Options(output=demo.upper()))
