"""The folder that driver and executors share, and tables stored in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """The path or address of a new folder under ``spark.checkpoint.dir``; where a local session has none, a temporary folder is set."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cartolith-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def plain(address: str) -> str:
    """The path of an address of this machine's files; other addresses stay."""
    return "/" + address.removeprefix("file:").lstrip("/") if address.startswith("file:") else address


def stored(df: DataFrame, what: str, **options: str) -> DataFrame:
    """``df`` written in the shared folder and read again: it is computed once and survives lost executors."""
    path = shared_folder(df.sparkSession, what)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_one_task(df: DataFrame, order: list[str], write: Callable[[Iterator], int]) -> int:
    """What ``write`` returns of the rows of ``df`` in that order. One task sorts them, on its disk where they are many, and
    hands them over one by one, for files that stores take front to back; the driver gets the number alone."""
    import pandas as pd

    def run(frames):
        yield pd.DataFrame({"told": [write(r for frame in frames for r in frame.itertuples())]})

    return df.coalesce(1).sortWithinPartitions(*order).mapInPandas(run, "told long").first()[0]


def drop(df: DataFrame) -> None:
    """Deletes the files of a table from :func:`stored` that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
