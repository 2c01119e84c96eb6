import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.queries import demo_cube, write_cube
from cartolith.raster import TYPES, format_num, pixel_type, round6
from cartolith.sources import isis, pvl

TEXT = """
Object = IsisCube  /* a comment */
  Group = A
    Three  = (1, 2.5 <m>, "x
       y")  <km>
    Unit   = 5<meters>
    Alone
    Quote  = 'it "is"'
    Nested = ((1, 2), {3})
  End_Group
  # another
  Object = Inner
    K = v
    Group = Deep
      N = -3.7e2 <deg>
    End_Group
  End_Object
End_Object
End
Not = read
"""


def test_label_tree():
    root, complete = pvl.parse(TEXT)
    assert complete
    a = root.child("isiscube").child("a")
    assert a.key("three") == ["1", "2.5", "x y"] and a.text("Unit") == "5" and a.key("Alone") == [] and a.text("quote") == 'it "is"'
    assert a.key("Nested") == ["1", "2", "3"] and root.key("Not") is None
    assert root.find("deep").number("n") == -370.0 and root.find("deep").integer("N") == -370 and root.find("nowhere") is None
    with pytest.raises(pvl.PvlError):
        a.number("Quote")
    assert a.number("missing", 4.0) == 4.0


@pytest.mark.parametrize("text,complete", [("A = 1\nEnd", True), ("A = 1", False), ("A = 1\0End", False), ("END", True), (", ) A = 1 End", True)])
def test_label_end(text, complete):
    assert pvl.parse(text)[1] is complete


@pytest.mark.parametrize("text", ["A = (1, 2", "A ="])
def test_label_cut_short(text):
    with pytest.raises(pvl.PvlError):
        pvl.parse(text)


def test_label_rows(spark):
    labels = spark.createDataFrame([(1, TEXT), (2, "A = (1"), (3, None)], "id int, text string")
    rows = pvl.label_rows(labels, "id", "text").where("keyword = 'N'").collect()
    assert [(r["id"], list(r["path"]), list(r["values"])) for r in rows] == [(1, ["IsisCube", "Inner", "Deep"], ["-3.7e2"])]


@pytest.mark.parametrize("tile", [None, (16, 10)])
@pytest.mark.parametrize("msb", [False, True])
def test_layouts(tmp_path, tile, msb):
    v = (np.arange(37 * 23) % 251 - 100).reshape(23, 37).astype(float)
    c = isis.open_cube(write_cube(str(tmp_path / "a.cub"), [v, v + 1], tile=tile, msb=msb))
    assert (c.w, c.h, c.bands, c.big_endian, c.tile) == (37, 23, 2, msb, tile)
    assert (isis.read_window(c, 1, 0, 0, 37, 23) == v + 1).all()
    assert (isis.read_window(c, 0, 11, 7, 12, 9) == v[7:16, 11:23]).all()
    with pytest.raises(isis.CubeError):
        isis.read_window(c, 0, 30, 0, 8, 1)


def test_detached_and_truncated(tmp_path):
    path = write_cube(str(tmp_path / "a.cub"), [np.ones((4, 4))])
    data = open(path, "rb").read()
    label = data[:4096].rstrip(b"\0").decode().replace("StartByte = 4097", "StartByte = 1\n  ^Core = a.dat")
    (tmp_path / "b.lbl").write_text(label)
    (tmp_path / "a.dat").write_bytes(data[4096:])
    c = isis.open_cube(str(tmp_path / "b.lbl"))
    assert (isis.read_window(c, 0, 0, 0, 4, 4) == 1).all()
    (tmp_path / "c.cub").write_bytes(data[:-1])
    for bad in (tmp_path / "c.cub", tmp_path / "none.cub"):
        with pytest.raises(isis.CubeError):
            isis.open_cube(str(bad))
    (tmp_path / "d.cub").write_bytes(b"Object = Other\nEnd_Object\nEnd\n")
    with pytest.raises(isis.CubeError, match="IsisCube"):
        isis.open_cube(str(tmp_path / "d.cub"))


@pytest.mark.parametrize("kind,stored,want", [
    ("int16", [-32768, -32767, -32766, -32765, -32764, -32752, 10], [None] * 5 + [100 - 32752 * 0.5, 105.0]),
    ("uint8", [0, 255, 7, 1, 254], [None, None, 103.5, 100.5, 227.0]),
    ("uint16", [0, 2, 3, 65522, 65523], [None, None, 101.5, 32861.0, None]),
    ("int8", [-128, -127, -126, 127], [None, None, 37.0, 163.5]),
    ("int32", [-2147483648, -2147483633, -2147483632, 2], [None, None, -1073741716.0, 101.0]),
    ("uint32", [2, 3, 4294967282, 4294967283], [None, 101.5, 2147483741.0, None]),
])
def test_special_pixels(tmp_path, spark, kind, stored, want):
    path = write_cube(str(tmp_path / "a.cub"), [np.array([stored])], kind=kind, base=100.0, multiplier=0.5)
    isis.register(spark)
    rows = spark.read.format("isis").load(path).orderBy("sample").collect()
    assert [r["value"] for r in rows] == want
    raw = spark.read.format("isis").option("raw", "true").load(path).orderBy("sample").collect()
    assert [r["value"] for r in raw] == [None if w is None else float(s) for s, w in zip(stored, want)]


def test_float_specials(tmp_path):
    bits = np.array([0xFF7FFFFB, 0xFF7FFFFC, 0xFF7FFFFD, 0xFF7FFFFE, 0xFF7FFFFF, 0x7FC00000, 0x7F800000], np.uint32).view(np.float32)
    c = isis.open_cube(write_cube(str(tmp_path / "a.cub"), [np.array([[*bits, 1.5]], np.float32)]))
    v = isis.decode(c, isis.read_window(c, 0, 0, 0, 8, 1))[0]
    assert np.isnan(v[:7]).all() and v[7] == 1.5


def test_source_pushdown_and_blocks(tmp_path, spark):
    isis.register(spark)
    path = demo_cube(str(tmp_path))
    c = isis.open_cube(path)
    reader = isis.IsisReader({"path": path, "window": "32"})
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    list(reader.pushFilters([EqualTo(("band",), 2), GreaterThanOrEqual(("line",), 40), LessThan(("sample",), 10)]))
    assert {(p.band, p.y0, p.x0, p.h, p.w) for p in reader.partitions()} == {(1, 40, 0, 20, 10)}
    got = spark.read.format("isis").load(path).where("band = 2 and line = 41 and sample < 3").orderBy("sample").collect()
    want = isis.decode(c, isis.read_window(c, 1, 0, 41, 3, 1))[0]
    assert [r["value"] for r in got] == [None if np.isnan(x) else x for x in want]
    blocks = spark.read.format("isis").option("blocks", "true").option("window", "50").load(path)
    assert blocks.agg(F.sum(F.col("h") * F.col("w"))).first()[0] == 2 * 60 * 120
    assert spark.read.format("isis").load(path).where("band = 9").count() == 0


def test_input_listing(tmp_path):
    for n in ("a.cub", "B.CUB", "notes.txt"):
        (tmp_path / n).write_text("")
    (tmp_path / "maps [v2]").mkdir()
    (tmp_path / "maps [v2]" / "c.cub").write_text("")
    name = lambda paths: [p.rsplit("/", 1)[1] for p in paths]
    assert sorted(name(isis.expand_inputs([str(tmp_path)]))) == ["B.CUB", "a.cub"]
    assert name(isis.expand_inputs([str(tmp_path / "b*")])) == ["B.CUB"]
    assert name(isis.expand_inputs([str(tmp_path / "maps [v2]")])) == ["c.cub"]
    for bad in (tmp_path / "x.cub", tmp_path / "*.png"):
        with pytest.raises(FileNotFoundError):
            isis.expand_inputs([str(bad)])


def test_info(tmp_path, spark):
    path = demo_cube(str(tmp_path))
    bad = tmp_path / "bad.cub"
    bad.write_text("End")
    rows = {r["path"]: r for r in isis.cube_info(spark, [path, str(bad)]).collect()}
    assert rows[path]["samples"] == 120 and rows[path]["band_names"] == ["RED", "BLUE"] and rows[path]["error"] is None
    assert rows[str(bad)]["samples"] is None and "IsisCube" in rows[str(bad)]["error"]


def test_texts():
    assert [format_num(x) for x in (0.0, -0.0, 1.0, 0.1, 1e21, -2.5e-7)] == ["0", "0", "1", "0.1", "1000000000000000000000", "-0.00000025"]
    assert round6(123456.7) == 123457.0 and round6(-0.00123456749) == -0.00123457 and round6(0) == 0
    assert pixel_type("Real").name == "float32" and pixel_type("U16") is TYPES["uint16"]
    with pytest.raises(ValueError):
        pixel_type("int7")
    assert pvl.number_text(1.0) == "1.0" and pvl.number_text(1e20) == "1e+20" and float(pvl.number_text(0.1 + 0.2)) == 0.1 + 0.2
