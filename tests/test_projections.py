import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.functions.bodies import CENTRIC, D2R, GRAPHIC, Body, convert_latitude, local_radius, to_centric, to_graphic, wrap_longitude
from cartolith.functions.projections import Params, build, canonical_name

BODIES = [Body("Sphere", 1737400.0, 1737400.0), Body("Mars", 3396190.0, 3376200.0)]
CASES = [
    ("equirectangular", {"clat": 30.0}), ("simplecylindrical", {"clon": 20.0}), ("geographic", {}), ("sinusoidal", {"clon": -50.0}), ("orthographic", {"clat": 35.0, "clon": 15.0}), ("polarstereographic", {"clat": 90.0}),
    ("polarstereographic", {"clat": -70.0, "clon": 40.0}), ("mercator", {"clat": 20.0}), ("lambertconformal", {"clat": 30.0, "par1": 20.0, "par2": 50.0}), ("lambertconformal", {"clat": -30.0, "par1": -35.0, "par2": -35.0}),
    ("lambertazimuthal", {"clat": 40.0, "clon": 10.0}), ("lambertazimuthal", {"clat": -90.0}), ("transversemercator", {"clat": 10.0, "clon": 5.0, "k0": 0.9996}),
]


@pytest.mark.parametrize("kind", [CENTRIC, GRAPHIC])
@pytest.mark.parametrize("body", BODIES, ids=lambda b: b.name)
@pytest.mark.parametrize("name,more", CASES)
def test_inverse_undoes_forward(name, more, body, kind):
    p = build(Params(name, body, kind, **more))
    lon, lat = (a.ravel() * D2R for a in np.meshgrid(np.arange(-175.0, 176, 5), np.arange(-85.0, 86, 5)))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        inside = p.domain.contains(lon, lat, p.lon0)
        x, y = p.forward(lon[inside], lat[inside])
        good = np.isfinite(x)
        back_lon, back_lat = p.inverse(x[good], y[good])
    assert good.mean() > 0.95 and good.sum() > 100
    assert np.abs(wrap_longitude(back_lon - lon[inside][good])).max() < 1e-9
    assert np.abs(back_lat - lat[inside][good]).max() < 1e-9


@pytest.mark.parametrize("name,more", CASES)
def test_columns_equal_arrays(spark, name, more):
    p = build(Params(name, BODIES[1], CENTRIC, **more))
    pts = [(float(a), float(b)) for a in range(-170, 180, 34) for b in range(-80, 81, 20)]
    x, y = p.forward(F.col("lon") * D2R, F.col("lat") * D2R)
    rows = spark.createDataFrame(pts, "lon double, lat double").repartition(2).select("lon", "lat", x.alias("x"), y.alias("y")).collect()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for r in rows:
            wx, wy = p.forward(np.float64(r["lon"] * D2R), np.float64(r["lat"] * D2R))
            if r["x"] is None:
                assert np.isnan(wx)
            else:
                assert r["x"] == pytest.approx(float(wx), abs=1e-5, rel=1e-9) and r["y"] == pytest.approx(float(wy), abs=1e-5, rel=1e-9)


def test_latitudes():
    mars = BODIES[1]
    lat = np.array([-90, -45, 0, 30, 90]) * D2R
    assert np.allclose(to_centric(to_graphic(lat, mars), mars), lat, atol=1e-15)
    assert to_graphic(lat, mars)[3] > lat[3] and to_graphic(lat, mars)[4] == lat[4]
    assert convert_latitude(lat, BODIES[0], CENTRIC, GRAPHIC) is lat
    assert local_radius(mars, 0) == mars.a and local_radius(mars, 90) == pytest.approx(mars.b)


@pytest.mark.parametrize("lon,want", [(0, 0), (math.pi, -math.pi), (-math.pi, -math.pi), (1.5 * math.pi, -0.5 * math.pi), (-5 * math.pi, -math.pi)])
def test_wrapping(spark, lon, want):
    assert wrap_longitude(np.float64(lon)) == pytest.approx(want, abs=1e-12)
    assert spark.range(1).select(wrap_longitude(F.lit(float(lon)))).first()[0] == pytest.approx(want, abs=1e-12)


def test_refused_parameters():
    for bad in (Params("polarstereographic", BODIES[0]), Params("lambertconformal", BODIES[0], par1=20, par2=-20), Params("equirectangular", BODIES[0], clat=90)):
        with pytest.raises(ValueError):
            build(bad)
    with pytest.raises(ValueError):
        canonical_name("peirce")
    assert canonical_name("Polar_Stereographic") == "polarstereographic"


def test_texts_and_sameness():
    p = build(Params("polarstereographic", BODIES[1], GRAPHIC, clat=90, clon=30))
    assert p.proj == "+proj=stere +lat_0=90 +lon_0=30 +k=1 +x_0=0 +y_0=0 +a=3396190 +b=3376200 +units=m +no_defs"
    assert p.same(build(Params("polarstereographic", BODIES[1], GRAPHIC, clat=90, clon=30))) and not p.same(build(Params("polarstereographic", BODIES[1], GRAPHIC, clat=90)))
