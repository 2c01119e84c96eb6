"""Helpers that the document operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SPACE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a session has none (tests in local mode) a temporary folder is set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="cartolith-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Folders of the tables stored inside of the :func:`scratch` that is open in this thread.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def _keep_track(path: str) -> None:
    if (folders := _SCRATCH.get()) is not None:
        folders.append(path)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: it is computed once and survives lost executors."""
    path = new_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    _keep_track(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folders: Iterable[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(df: DataFrame) -> None:
    """Deletes the files of a table from :func:`stored` that nothing reads any more."""
    _delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at its end; what is to stay must be stored outside, or before it begins."""
    token = _SCRATCH.set(folders := [])
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        _delete(spark, folders)


def stored_from(spark: SparkSession, make: Callable[[], DataFrame], what: str) -> DataFrame:
    """What ``make`` gives, stored; the tables that it stored on its way are deleted."""
    path = new_folder(spark, what)
    with scratch(spark):
        df = make()
        df.write.option("compression", "zstd").parquet(path)
    _keep_track(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with as many underscores before it as it takes to be none of ``taken`` (in any case of letters)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = "_" + name
    return name


def spans(texts: pa.Array, budget: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``budget`` bytes each; a longer text is alone in its range."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    start = 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(end, (end[start - 1] if start else 0) + budget, "right")))
        yield start, stop
        start = stop


#: Bytes of text that a task works on at once.
BLOCK_BYTES = 2_000_000


def map_blocks(df: DataFrame, keys: list[str], text: str, schema: str, start: Callable[[], Callable[[pa.Array], list]], last: Callable | None = None, budget: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``keys`` followed by the columns that a function makes of an Arrow array of texts, in blocks of bounded size.

    ``text`` may be one of the keys.
    ``start`` makes the function, once in each task, so that what it keeps goes with the task. ``schema`` names its
    columns; the keys keep their types. ``last``, called with the function when a task has read all, gives the columns
    of rows to add, whose keys are null.
    """
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(schema)
    out = StructType([df.schema[k] for k in keys] + list(made))
    if last:
        for f in out:
            f.nullable = True
    n_keys = len(keys)
    own = keys.index(text) if text in keys else n_keys

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        types = [f.type for f in arrow][n_keys:]
        typed = lambda columns: [c if isinstance(c, pa.Array) and c.type == t else pa.array(c, type=t) for c, t in zip(columns, types)]
        fn = start()
        for batch in batches:
            texts = batch.column(own)
            for a, b in spans(texts, budget):
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(n_keys)] + typed(fn(texts.slice(a, b - a))), schema=arrow)
        if last and (more := last(fn)):
            n = len(more[0])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, arrow.field(i).type) for i in range(n_keys)] + typed(more), schema=arrow)

    return map_arrow(df.select(*map(col, keys if own < n_keys else [*keys, text])), run, out)


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow by the places of columns, which it finds by names that must have no dots."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)


def map_texts(df: DataFrame, keys: list[str], text: str, schema: str, fn: Callable[[list[str | None]], list], budget: int = BLOCK_BYTES) -> DataFrame:
    """:func:`map_blocks` for a function of lists of texts."""
    return map_blocks(df, keys, text, schema, lambda: lambda texts: fn(texts.to_pylist()), budget=budget)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(numbers, begin, words): the words of the texts, runs of anything but ASCII white space, as numbers of ``words``.

    Those of text i are numbers[begin[i] : begin[i + 1]]; a null text has none. ``words`` are different from each other.
    """
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), out=begin[1:])
    words = coded.dictionary.to_pylist()
    if "" in words:  # white space at an end of a text, or an empty one
        fine = numbers != words.index("")
        kept = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(fine, out=kept[1:])
        numbers, begin = numbers[fine], kept[begin]
    return numbers, begin, words


def latin_runs(texts: pa.Array, classes: np.ndarray, alone: int = -1, cut: Callable | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(numbers, begin, runs): the runs of one class of characters in the texts, in lower case, as numbers of ``runs``.

    Only for texts whose characters are all below U+0100, see :func:`is_latin`. ``classes`` tells the class by code
    point of the lower-case character; those of class 0 lie between runs, those of class ``alone`` are a run each.
    ``cut`` may change where runs begin: it gets the bytes, their classes and the mask of beginnings. Text i has
    numbers[begin[i] : begin[i + 1]].
    """
    offsets, data = utf8(texts)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    low = lower[data]
    ascii_classes = np.append(classes[:128], np.zeros(128, np.uint8))
    kind = ascii_classes[low]
    lead = np.flatnonzero(data >= 0xC2)  # of the two bytes of a character from U+0080
    code = (data[lead].astype(np.int64) - 0xC0 << 6) + (data[lead + 1] & 0x3F)
    code += 32 * ((code >= 0xC0) & (code < 0xDF) & (code != 0xD7))
    low[lead], low[lead + 1] = 0xC0 + (code >> 6), 0x80 + (code & 0x3F)
    kind[lead] = kind[lead + 1] = classes[code]
    first = np.empty(len(data), bool)
    if len(data):
        first[0] = True
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        first |= kind == alone
        first[lead + 1] = False
        first &= kind > 0
        if cut:
            cut(low, kind, first, offsets)
    kept = kind > 0
    at = np.cumsum(kept, dtype=np.int32)
    begins = np.flatnonzero(first)
    where = np.append(at[begins] - 1, at[-1] if len(at) else 0).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(where) - 1, pa.py_buffer(where), pa.py_buffer(low[kept])).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(begins, offsets), coded.dictionary


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of texts back to back; a null text has none."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return offsets - offsets[0], np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]


def texts_with(texts: pa.Array, found: np.ndarray) -> np.ndarray:
    """Which texts hold one of the places ``found`` in their bytes back to back."""
    out = np.zeros(len(texts), bool)
    if len(found):
        out[np.searchsorted(utf8(texts)[0], found, "right") - 1] = True
    return out


def beyond_latin(texts: pa.Array) -> np.ndarray:
    """Which texts have a character from U+0100 on."""
    return texts_with(texts, np.flatnonzero(utf8(texts)[1] >= 0xC4))


def spread(codes: np.ndarray, begin: np.ndarray, flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that stand for codes: code c for the ``size[c]`` of ``flat`` from ``first[c]`` on.

    ``begin`` tells where each text's codes begin, and so does the second array for its numbers.
    """
    n = size[codes]
    kind = np.int32 if max(int(n.sum()), len(flat)) < 1 << 31 else np.int64
    end = np.zeros(len(n) + 1, kind)
    np.cumsum(n, out=end[1:], dtype=kind)
    at = np.repeat(first.astype(kind)[codes] - end[:-1], n)
    at += np.arange(len(at), dtype=kind)
    return flat[at], end[begin].astype(np.int64)


def binary_rows(data: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Binary values of which the i-th holds the bytes of data[begin[i] : begin[i + 1]]."""
    data = np.ascontiguousarray(data)
    offsets = (begin * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def is_training(doc_id: str = "doc_id"):
    """Rows that models learn from: crc32 of doc_id as text, mod 3, is not 1."""
    return F.crc32(col(doc_id).cast("string")) % 3 != 1


def is_held_out(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 3 = 1; false for a null doc_id."""
    return F.coalesce(F.crc32(col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def about(df: DataFrame, want: int, count: int) -> DataFrame:
    """All of ``count`` rows if they are at most ``want``, else about that many.

    Rows are drawn one by one with a fixed seed, whatever their keys, so a frequent key can't swell the sample.
    """
    return df if count <= want else df.sample(want / count, seed=29)
