"""Queries against their DuckDB SQL on tables that differ from the driver's small ones: more lines, larger numbers, gaps."""

import uuid

import numpy as np
import pandas as pd
import pytest

from cartolith.operators import values as values_of
from cartolith.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")


def write_events(folder, values, kinds=None, ids=None):
    """A table of events; every 11th is an error unless ``kinds`` are given."""
    n = len(values)
    kinds = np.where(np.arange(n) % 11 == 5, "error", "click") if kinds is None else kinds
    frame = pd.DataFrame({"event_id": np.arange(n) if ids is None else ids, "user_id": np.arange(n) % 999, "event_type": kinds, "value": values})
    frame.to_parquet(folder / "events.parquet", index=False)
    return str(folder)


def same(spark, folder, name, tables=("events",)):
    """Holds a query against its SQL and returns its rows."""
    with duckdb.connect() as db:
        for t in tables:
            db.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
        want = db.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, folder).toPandas()
    columns = sorted(want.columns)
    order = lambda df: df[columns].sort_values(columns, na_position="last").reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, rtol=1e-12, atol=1e-9)
    return got


def test_words_above_their_range_are_data(spark, tmp_path):
    got = same(spark, write_events(tmp_path, np.array([0.0, 0.15, 0.16, 655.35, 655.36, 791.25])), "decode_int16")
    assert got.sort_values("event_id")["value"].isna().tolist() == [True, True, False, False, False, False]


def test_differences_of_numbers_beyond_16_bits(spark, tmp_path):
    values = np.where(np.arange(200) % 3 == 1, 791.25, np.arange(200) / 4)
    got = same(spark, write_events(tmp_path, values, ["click"] * 200), "predictor2_uint16")
    assert got["delta"].min() < 0


def test_levels_of_a_tall_image(spark, tmp_path):
    """A vector far down makes the image so tall that it has a level more than the SQL spells out."""
    vectors = [np.arange(64, dtype=np.float32) / 8 + k for k in range(3)]
    pd.DataFrame({"vec_id": np.array([0, 1, 65_600]), "embedding": vectors}).to_parquet(tmp_path / "embeddings.parquet", index=False)
    got = same(spark, str(tmp_path), "pyramid_levels", ["embeddings"])
    assert sorted(got["level"].unique()) == list(range(13))


@pytest.mark.parametrize("lines", [80, 6000])
def test_places_on_edges_of_lines(spark, tmp_path, lines):
    same(spark, write_events(tmp_path, np.arange(lines * 100) / 4), "reproject_sinusoidal")


@pytest.mark.parametrize("name", ["stretch_limits_auto", "stretch_auto", "stretch_minmax", "geotiff_stretched"])
def test_stretches_by_all_pixels(spark, tmp_path, name):
    """More lines than the 1,024 of a sample, the extremes on lines that it left out."""
    values = np.random.default_rng(5).exponential(50, 150_000).round(2)
    values[201:205] = 0.001, 5000, 6000, 7000  # on line 2; lines 0, 2 and 3 were not all read
    values[301:305] = 0.002, 8000, 9000, 0.003
    same(spark, write_events(tmp_path, values), name)


def test_ranks_of_bands(spark):
    """Bands of one value, of none, of ends of the doubles, against a sort of all values."""
    bands = {1: [4.0], 2: [None, None], 3: [-1e308, 1e308, -5e-324, 5e-324, -0.0, 0.0, float("inf"), float("nan")], 4: [float(k * 37 % 1009) for k in range(1009)] + [None] * 9, 5: [7.0] * 500 + [8.0] * 2}
    table = spark.createDataFrame([(b, v) for b, vs in bands.items() for v in vs], "band int, value double").repartition(5)
    got = {r["band"]: (r["lo"], r["hi"]) for r in values_of.stretch_limits(table, 1, 1).collect()}
    for band, vs in bands.items():
        ranks = sorted((v for v in vs if v is not None), key=lambda v: (v != v, v))
        want = (ranks[int(0.5 / 100 * (len(ranks) - 1))], ranks[int(99.5 / 100 * (len(ranks) - 1))]) if ranks else (0.0, 1.0)
        assert got[band] == want


@pytest.mark.parametrize("name", ["warp_bilinear", "warp_bilinear_wrapped", "warp_cubic", "warp_cubic_wrapped"])
def test_a_position_is_joined_once(spark, tmp_path, name):
    """Over edges of blocks on all sides, gaps included; the plan has no row for each position and neighbour."""
    keep = np.delete(np.arange(14_000), [0, 99, 6_400, 6_463, 6_464, 6_465, 12_900])
    folder = write_events(tmp_path, np.random.default_rng(3).exponential(50, len(keep)).round(2), ids=keep)
    same(spark, folder, name)
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1 and "Aggregate" not in plan and "FlatMapGroupsInArrow" in plan


def test_rounding_near_ties(spark):
    from cartolith.queries import rounded

    ties = [64.2374565, 0.0000005, -1.0000015, 2.5, *(k + 0.1234565 for k in range(200))]
    with duckdb.connect() as db:
        want = [db.sql(f"select round({x!r}::double, 6)").fetchall()[0][0] for x in ties]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in ties], "x double").select(rounded("x", 6)).collect()] == want


def test_cubes_of_events_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """Of two chunks of events and one without, no pixels come to the driver, and lines without events have no data."""
    from pyspark.sql.classic.dataframe import DataFrame

    folder = write_events(tmp_path, np.arange(1100) / 4, ids=np.r_[0:1000, 250_000:250_100])

    def refused(*_, **__):
        raise AssertionError("rows came to the driver")

    with monkeypatch.context() as m:
        m.setattr(DataFrame, "toLocalIterator", refused)
        scan = QUERIES["isis_scan"](spark, folder)
    got = scan.where("value is not null").toPandas()
    kept = np.flatnonzero(np.arange(1100) % 11 != 5)
    where = np.where(kept < 1000, kept, kept + 249_000)
    assert scan.count() == 2 * 250_100
    for band in (1, 2):
        one = got[got["band"] == band].sort_values(["line", "sample"])
        assert (one["line"] * 100 + one["sample"]).tolist() == where.tolist()
        assert one["value"].tolist() == (kept / 4 * band).tolist()


@pytest.mark.parametrize("name", ["isis_scan", "cube_info", "geotiff_copy", "geotiff_interleaved", "geotiff_tags", "geotiff_normalized", "geotiff_warped", "geotiff_georeference", "normalized_label"])
def test_files_in_stores_are_written_by_tasks(spark, tmp_path, monkeypatch, name):
    """Where a file has an address and is written front to back, neither lines nor tiles come to the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    from cartolith import queries

    def refused(*_, **__):
        raise AssertionError("rows came to the driver")

    folder = write_events(tmp_path, np.random.default_rng(7).integers(0, 2000, 110_000) / 4)
    monkeypatch.setattr(queries, "plain", lambda address: address)
    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    same(spark, folder, name)


@pytest.mark.parametrize("name, tasks", [("geotiff_copy", 4), ("geotiff_interleaved", 3), ("geotiff_normalized", 4)])
def test_tasks_read_many_rows_of_tiles(spark, tmp_path, name, tasks):
    """Tasks, whose results the driver gets, are as many as a million samples ask for, not as the 157 or 313 rows of tiles."""
    folder = write_events(tmp_path, np.random.default_rng(9).integers(0, 2000, 1_000_000) / 4)
    assert QUERIES[name](spark, folder).rdd.getNumPartitions() == tasks


@pytest.mark.parametrize("share", [1, 4 * 16 * 48, 1 << 20])
@pytest.mark.parametrize("more", [{}, {"interleave": True}, {"overviews": True}])
def test_rows_of_tiles_are_read_once(spark, tmp_path, monkeypatch, share, more):
    """Runs of rows of tiles that end within and at a plane's end hold each sample once, with few of the offsets each."""
    from cartolith.plans.convert import execute, plan_conversion
    from cartolith.plans.options import Options
    from cartolith.queries import write_cube
    from cartolith.sources import geotiff

    bands = [np.arange(75 * 40).reshape(75, 40) + 10_000.0 * b for b in range(2)]
    cube = write_cube(str(tmp_path / "c.cub"), bands, "float64")
    path = execute(spark, plan_conversion(cube, Options(output=str(tmp_path / "o.tif"), tile=16, **more)))
    monkeypatch.setattr(geotiff, "SHARE", share)
    reader = geotiff.GeoTiffReader({"path": path})
    parts = reader.partitions()
    whole = geotiff.directories(path)
    assert sum(len(p.offsets) for p in parts) == sum(len(tags[geotiff.OFFSETS]) for tags in whole)
    rows = pd.concat([b.to_pandas() for p in parts for b in reader.read(p)])
    assert not rows.duplicated(["level", "band", "line", "sample"]).any()
    assert len(rows) == sum(2 * tags[geotiff.WIDTH][0] * tags[geotiff.HEIGHT][0] for tags in whole)
    first = rows[rows["level"] == 0]
    for k, band in enumerate(bands):
        one = first[first["band"] == k + 1]
        assert (band[one["line"], one["sample"]] == one["value"]).all()
    short = [tags | {geotiff.OFFSETS: tags[geotiff.OFFSETS][:-1]} for tags in whole]
    monkeypatch.setattr(geotiff, "directories", lambda path: short)
    with pytest.raises(geotiff.TiffError, match="tiles"):
        reader.partitions()


def sent(spark, run):
    """Bytes of task results that the driver gets while ``run`` runs."""
    sc, group = spark.sparkContext, f"sent-{uuid.uuid4().hex}"
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return sum(store.lastStageAttempt(s).resultSize() for s in stages)


@pytest.mark.parametrize("name", ["isis_scan", "cube_info", "geotiff_warped", "geotiff_georeference"])
def test_bytes_to_the_driver_do_not_follow_events(spark, tmp_path, name):
    """Of ten times the events the driver gets some more tasks' results, not the 24 bytes an event that lines through it took."""
    told = []
    for n in (50_000, 500_000):
        (folder := tmp_path / str(n)).mkdir()
        path = write_events(folder, np.random.default_rng(n).integers(0, 2000, n) / 4)
        told.append(sent(spark, lambda: QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()))
    assert 0 < told[0] and told[1] - told[0] < 450_000, told
