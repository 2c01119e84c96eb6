"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR is the folder of tables (/root/testdata/sf0.1), BENCH_CPUS the number of threads (8).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from cartolith import queries as raster

HEADLINES = ("normalize_uint16", "stretch_auto", "pyramid_levels", "fwd_polarstereographic", "inv_lambertazimuthal", "warp_nearest", "warp_bilinear_wrapped", "warp_cubic", "reproject_sinusoidal", "predictor2_uint16", "geotiff_overviews")


def image_jobs(folder: str) -> dict:
    """Whole conversions of mapped cubes of 67 and 268 MB."""
    import math

    import numpy as np

    from cartolith.plans.convert import execute, plan_conversion
    from cartolith.plans.options import Options
    from cartolith.queries import moon_mapping, write_cube

    def cube(n: int) -> str:
        y, x = np.ogrid[0:n, 0:n]
        res = 2 * math.pi * 1737400.0 / n
        return write_cube(f"{folder}/image{n}.cub", [np.hypot(x - n / 2, y - n / 3).astype(np.float32)], mapping=moon_mapping(res, -n / 2 * res, n / 2 * res))

    small, large = cube(4096), cube(8192)
    asked = {
        "convert_67mb": (small, Options(output=f"{folder}/a.tif")),
        "convert_67mb_overviews": (small, Options(output=f"{folder}/b.tif", overviews=True)),
        "convert_67mb_polar": (small, Options(output=f"{folder}/c.tif", proj="ps:north")),
        "convert_67mb_ortho_cubic": (small, Options(output=f"{folder}/d.tif", proj="ortho", resample="cubic")),
        "convert_268mb": (large, Options(output=f"{folder}/e.tif")),
        "convert_268mb_none": (large, Options(output=f"{folder}/f.tif", compress="none")),
        "convert_268mb_polar": (large, Options(output=f"{folder}/g.tif", proj="ps:north")),
    }
    return {name: (lambda spark, path=path, o=o: execute(spark, plan_conversion(path, o))) for name, (path, o) in asked.items()}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: raster.QUERIES[n] for n in HEADLINES}
    try:
        from cartolith.llm.queries import QUERIES

        queries |= QUERIES
    except ImportError:
        pass
    raster.flagship(spark, sf_dir).write.format("noop").mode("overwrite").save()  # code is loaded
    times = {}
    for name, f in queries.items():
        began = time.perf_counter()
        f(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    with tempfile.TemporaryDirectory(prefix="bench-") as folder:
        for name, job in image_jobs(folder).items():
            began = time.perf_counter()
            job(spark)
            times[name] = round(time.perf_counter() - began, 3)
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(found[1]) if found else None}))
    spark.stop()


if __name__ == "__main__":
    main()
