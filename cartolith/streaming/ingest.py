"""Structured Streaming over a folder of cubes: labels as files arrive, and their pixels' running range.

File contents do not travel through the stream: the source's content column is pruned, and tasks open the files.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.isis import CubeError, decode, open_cube, read_window

FOUND = "path string, samples int, lines int, bands int, type string, error string"
RANGES = "path string, band int, lo double, hi double, invalid long"


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified) of the cube files of a folder, as a stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[cC][uU][bB]").load(folder).select("path", F.col("modificationTime").alias("modified"))


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def labels(files: DataFrame) -> DataFrame:
    """A row for each file of a stream or table: its size and type, or why it can't be read."""

    def run(frames):
        for frame in frames:
            rows = []
            for path in frame["path"]:
                try:
                    c = open_cube(_local(path))
                    rows.append((path, c.w, c.h, c.bands, c.type.name, None))
                except CubeError as e:
                    rows.append((path, None, None, None, None, str(e)))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in FOUND.split(", ")])
            yield out.astype({k: "Int32" for k in ("samples", "lines", "bands")})

    return files.select("path").mapInPandas(run, FOUND)


def ranges(files: DataFrame, lines: int = 1024) -> DataFrame:
    """(path, band, lo, hi, invalid) in pieces of ``lines`` lines; files that can't be read give none."""

    def run(frames):
        for frame in frames:
            for path in frame["path"]:
                try:
                    c = open_cube(_local(path))
                except CubeError:
                    continue
                for band in range(c.bands):
                    for y in range(0, c.h, lines):
                        v = decode(c, read_window(c, band, 0, y, c.w, min(lines, c.h - y)))
                        valid = v[~np.isnan(v)]
                        yield pd.DataFrame([(path, band + 1, valid.min() if len(valid) else None, valid.max() if len(valid) else None, v.size - len(valid))], columns=[x.split()[0] for x in RANGES.split(", ")])

    return files.select("path").mapInPandas(run, RANGES)


def running_range(files: DataFrame) -> DataFrame:
    """Range and number of pixels without data by band, over all files so far; the state is one row a band."""
    return ranges(files).groupBy("band").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("invalid").alias("invalid"), F.approx_count_distinct("path").alias("files"))
