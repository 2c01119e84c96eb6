"""Benchmark decontamination by latent semantic retrieval and verification in word order.

1. Documents are split into words (letters and digits, in lower case) once, and stored as 32-bit word hashes. A word's
   term is its hash modulo ``terms``. Document frequencies are counted over all documents, in the same pass.
2. A randomised SVD is fitted to the TF-IDF matrix of passages: all windows of the benchmark, and all documents cut into
   passages of ``passage`` words. Tasks sum A'(A X) over their passages, and the sums are added up piece by piece; the
   basis and the small eigenproblem are the driver's, on matrices whose size ``terms`` and ``rank`` fix.
3. Documents and items are cut into windows of words, see :func:`scales`. A document's window is a candidate for an
   item's window if the cosine of their latent vectors is ``cosine`` or more. All windows of all documents are compared
   with all windows of all items.
4. Where a candidate places the item in the document, the longest common subsequence of words is taken, in a slice half
   an item longer than the item. The item leaks with ``whole`` of its words in order, or with ``part`` of them, a
   paraphrase, if the slice also holds the answer: ``answer`` of the item's ``answer_words`` rarest words. Slices that
   hold too few of the item's words for that, in whatever order, are told before the subsequence is taken.

Items are searched in blocks of at most ``block_words`` words, each broadcast for one pass over the stored words, so that
memory and plans are bounded for any benchmark. Null, empty and wordless texts, on either side, match nothing. Repeated
items and repeated rows each give their pairs. A null doc_id or item_id is carried. Other columns are ignored. An empty
table on either side gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import beyond_latin, binary_rows, col, fresh, latin_runs, map_arrow, map_blocks, new_folder, quoted, scratch, spans, stored, utf8

ALNUM = re.compile(r"[^\W_]+")
#: By code point below U+0100, whether a character is one of words.
IN_WORD = np.array([chr(c).isalnum() for c in range(256)], np.uint8)


def word_hashes(text: str | None) -> np.ndarray:
    """CRC-32 of each word of a text, in order."""
    return np.array([crc32(w.encode("utf-8", "surrogatepass")) for w in ALNUM.findall(text.lower())] if text else [], np.uint32)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC_TABLE = _crc_table()
#: Bytes of a word up to which its CRC-32 is taken along with those of others.
SHORT = 64


def crc32s(words: pa.Array) -> np.ndarray:
    """CRC-32 of each word's bytes; all ``SHORT`` words take a byte a step, the longest ones first, so that a step's words are a slice."""
    offsets, data = utf8(words)
    size = np.diff(offsets)
    long = np.flatnonzero(size > SHORT)
    size[long] = 0
    order = np.argsort(-size, kind="stable")
    at = offsets[:-1][order]
    longer = len(size) - np.cumsum(np.bincount(size))  # by k, words of more than k bytes
    crc = np.full(len(size), 0xFFFFFFFF, np.uint32)
    for k, n in enumerate(longer[:-1].tolist()):
        crc[:n] = CRC_TABLE[(crc[:n] ^ data[at[:n] + k]) & 0xFF] ^ crc[:n] >> np.uint32(8)
    out = np.empty_like(crc)
    out[order] = ~crc
    for k in long.tolist():
        out[k] = crc32(data[offsets[k] : offsets[k + 1]])
    return out


def all_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """:func:`word_hashes` of many texts: those of text i are hashes[begin[i] : begin[i + 1]]."""
    odd = beyond_latin(texts)
    codes, begin, words = latin_runs(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts, IN_WORD)
    hashes = crc32s(words)[codes]
    if odd.any():
        other = iter(texts.filter(pa.array(odd)).to_pylist())
        each = [word_hashes(next(other)) if o else hashes[a:b] for o, a, b in zip(odd, begin[:-1], begin[1:])]
        hashes, begin = np.concatenate(each), np.cumsum([0, *map(len, each)])
    return hashes, begin


@dataclass(frozen=True)
class Settings:
    terms: int = 1 << 16
    rank: int = 64
    common: int = 24
    extra: int = 8
    power: int = 1
    cosine: float = 0.58
    whole: float = 0.8
    part: float = 0.6
    answer: float = 0.75
    answer_words: int = 8
    passage: int = 48
    block_words: int = 1_000_000


#: Documents are cut into blocks of so many words; windows are runs of blocks.
BLOCK = 6


def scales(n: int) -> tuple[int, int, int]:
    """(words of a window, words between those of a document, words between those of an item) for an item of n words.

    A long item holds a document's window whole, wherever windows begin; one of under 12 words is a window of its own,
    and documents are cut at every word.
    """
    return (24, 12, 6) if n >= 36 else (12, 6, 3) if n >= 12 else (n, 1, 1)


def item_windows(n: int) -> list[tuple[int, int]]:
    """(start, length) of an item's windows, the last one flush with its end."""
    size, _, step = scales(n)
    return [(s, size) for s in dict.fromkeys([*range(0, n - size + 1, step), n - size])] if n else []


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows (Hyyro, 2004)."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


class _Words:
    """A task's splitter: columns (words, n, df) of a block of texts; df is null but for the task's last row."""

    def __init__(self, terms: int):
        self.df = np.zeros(terms, np.int64)
        self.place = np.zeros(terms, np.int64)
        self.rows = 0

    def __call__(self, texts: pa.Array) -> list:
        hashes, begin = all_hashes(texts)
        term = (hashes % len(self.df)).astype(np.int64)
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            own, nth = term[a:b], np.arange(b - a)
            self.place[own] = nth
            self.df[own[self.place[own] == nth]] += 1  # each of its terms once
        self.rows += len(texts)
        return [binary_rows(hashes.astype("<u4"), begin), np.diff(begin), pa.nulls(len(texts), pa.binary())]

    def last(self) -> list:
        at = np.flatnonzero(self.df)
        return [[None], [None], [np.stack([np.append(at, -1), np.append(self.df[at], self.rows)]).astype("<i8").tobytes()]]


def split_words(docs: DataFrame, keys: list[str], text: str, terms: int, names: tuple[str, str, str] = ("words", "n", "df")) -> tuple[DataFrame, np.ndarray]:
    """The stored table (keys, words binary, n long), little-endian 32-bit hashes of a text's words in order; and idf by term.

    idf is ln(1 + (n - df + 0.5) / (df + 0.5)) over all documents, positive in any corpus. ``names`` are those of the
    new columns and of one for the tasks' counts.
    """
    hashes, size, df = names
    own = map_blocks(docs, keys, text, f"{quoted(hashes)} binary, {quoted(size)} long, {quoted(df)} binary", lambda: _Words(terms), _Words.last)
    every = stored(own, "words")

    def spread(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                at, n = np.frombuffer(raw, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"term": at, "n": n})

    found = every.where(col(df).isNotNull()).select(col(df)).mapInArrow(spread, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(terms + 1)
    total[found["term"]] = found["n"]  # -1: the rows
    idf = np.log1p((total[-1] - total[:-1] + 0.5) / (total[:-1] + 0.5)).astype(np.float32)
    return every.where(col(size).isNotNull()).drop(df), idf


#: Passages that a task multiplies at once, and in a step; words of a term that are added up together; terms whose part of A' is a dense matrix.
AT_ONCE, STEP, CHUNK, DENSE = 16_384, 256, 8, 256


def _products(row: np.ndarray, sizes: np.ndarray, shares: np.ndarray, idf: np.ndarray, x: np.ndarray, out: np.ndarray | None) -> np.ndarray:
    """A x for passages of words, given as rows of x: ``sizes`` tells how many of ``row`` each has; ``out`` gets A'(A x) added.

    A row of A has the norm of its passage's share. Words are put into arrays of one width, so that they are multiplied
    in batches: by passage for A x, and by term for A', of which x's first rows, the frequent terms, are a dense part.
    """
    stop = np.append(0, np.cumsum(sizes))
    whose = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    weight = idf[row]
    square = np.add.reduceat(weight.astype(np.float64) ** 2, stop[:-1])
    weight *= (shares / np.sqrt(np.maximum(square, 1e-12))).astype(np.float32)[whose]
    rows = np.empty((len(sizes), x.shape[1]), np.float32)
    for k in range(0, len(sizes), STEP):
        few = sizes[k : k + STEP]
        here = slice(stop[k], stop[k + len(few)])
        filled = np.arange(few.max()) < few[:, None]
        at, part = np.zeros(filled.shape, np.int32), np.zeros(filled.shape, np.float32)
        at[filled], part[filled] = row[here], weight[here]
        np.matmul(part[:, None], np.take(x, at, axis=0, mode="clip"), out=rows[k : k + STEP, None])
    if out is None:
        return rows
    often, n = row < DENSE, min(DENSE, len(x))
    for k in range(0, len(sizes), 8 * STEP):
        few = rows[k : k + 8 * STEP]
        at = np.flatnonzero(often[stop[k] : stop[k + len(few)]]) + stop[k]
        out[:n] += np.bincount((whose[at] - k) * n + row[at], weight[at], len(few) * n).astype(np.float32).reshape(-1, n).T @ few
    rest = np.flatnonzero(~often)
    order = rest[np.argsort(row[rest].astype(np.min_scalar_type(len(x) - 1)), kind="stable")]
    for k in range(0, len(order), 256 * STEP):
        few = order[k : k + 256 * STEP]
        term, at, part, source = row[few], whose[few], weight[few], rows
        while len(term):  # sums of chunks, then of the sums of terms that have several
            first = np.flatnonzero(np.diff(term, prepend=-1))
            count = np.diff(np.append(first, len(term)))
            chunks = -(-count // CHUNK)
            begin = np.cumsum(chunks) - chunks
            place = np.arange(len(term)) + np.repeat(begin * CHUNK - first, count)
            whole, parts = np.zeros((chunks.sum(), CHUNK), np.int32), np.zeros((chunks.sum(), 1, CHUNK), np.float32)
            whole.reshape(-1)[place], parts.reshape(-1)[place] = at, part
            sums = np.empty((len(whole), x.shape[1]), np.float32)
            for j in range(0, len(whole), 2 * STEP):
                np.matmul(parts[j : j + 2 * STEP], np.take(source, whole[j : j + 2 * STEP], axis=0, mode="clip"), out=sums[j : j + 2 * STEP, None])
            alone = chunks == 1
            out[term[first[alone]]] += sums[begin[alone]]
            at = np.flatnonzero(np.repeat(~alone, chunks))
            term, part, source = np.repeat(term[first], chunks)[at], np.ones(len(at), np.float32), sums
    return rows


def orthonormal(z: np.ndarray, block: int = 4096) -> np.ndarray:
    """An orthonormal basis of z's columns, in place: two rounds with the Gram matrix, which needs no copy of z."""
    for _ in range(2):
        gram = np.zeros((z.shape[1], z.shape[1]))
        for k in range(0, len(z), block):
            part = z[k : k + block].astype(np.float64)
            gram += part.T @ part
        value, vector = np.linalg.eigh(gram)
        scale = vector / np.sqrt(np.maximum(value, max(value.max(), 1e-30) * 1e-12))
        for k in range(0, len(z), block):
            z[k : k + block] = z[k : k + block] @ scale
    return z


#: So many rows of a matrix are added up, and go to the driver, at once; so many matrices are added up by one task.
PIECE, FAN = 1024, 32
#: The least tasks that make matrices, and the passages that call for one more.
TASKS, SHARE = 6, 1_000_000


def latent_space(words: DataFrame, idf: np.ndarray, windows: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(terms of the passages, a latent vector for each): right singular vectors of their TF-IDF matrix, each divided by its singular value.

    All passages of all documents (words binary, n long) and all benchmark ``windows`` (words binary) make the matrix,
    and either have the same mass in it. The strongest ``common`` directions, a quarter of them at most, are left out,
    as all texts of a language share them, and the division makes the others equally strong. Terms of no passage have
    the vector zero.
    """
    spark = words.sparkSession
    count, passages = words.agg(F.count("*"), F.coalesce(F.sum(F.ceil(F.col("n") / s.passage)), F.lit(0))).first()
    share = float(np.sqrt(windows.count() / passages)) if passages else 1.0
    tasks = max(TASKS, passages // SHARE)
    rows = words.select("words", F.lit(False).alias("item")).unionByName(windows.select("words", F.lit(True).alias("item"))).coalesce(tasks)

    def terms_of(batches):
        seen = np.zeros(s.terms, bool)
        for batch in batches:
            seen[np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4") % s.terms] = True
        yield pa.RecordBatch.from_pydict({"term": np.flatnonzero(seen)})

    seen = idf < np.log1p((count + 0.5) / 0.5) - 0.5  # a term of no document has that idf, one of a document ln 3 less
    seen[windows.mapInArrow(terms_of, "term long").distinct().toPandas()["term"].to_numpy(np.int64)] = True
    used = np.flatnonzero(seen)
    used = used[np.argsort(idf[used], kind="stable")]  # frequent ones first
    shared_row = spark.sparkContext.broadcast((used, idf[used]))

    def task(shared, last: bool):
        def run(batches):
            from pyspark import TaskContext

            x, (used, weights) = shared.value, shared_row.value
            row = np.zeros(s.terms, np.int32)
            row[used] = np.arange(len(used))
            total = np.zeros((x.shape[1], x.shape[1]) if last else x.shape, np.float32)
            for batch in batches:
                for a, b in spans(batch.column(0), 4 * AT_ONCE * s.passage):
                    raw = batch.column(0).slice(a, b - a).to_pylist()
                    term = row[np.frombuffer(b"".join(raw), "<u4") % s.terms]
                    n = np.array([len(r) // 4 for r in raw], np.int64)
                    cut = -(-n // s.passage)
                    sizes = np.full(cut.sum(), s.passage)
                    sizes[np.cumsum(cut)[cut > 0] - 1] -= (cut * s.passage - n)[cut > 0]
                    shares = np.repeat(np.where(np.array(batch.column(1).slice(a, b - a).to_pylist()), 1.0, share), cut)
                    stop = np.append(0, np.cumsum(sizes))
                    for k in range(0, len(sizes), AT_ONCE):
                        few = sizes[k : k + AT_ONCE]
                        made = _products(term[stop[k] : stop[k + len(few)]], few, shares[k : k + AT_ONCE], weights, x, None if last else total)
                        if last:
                            total += made.T @ made
            for k in range(0, len(total), PIECE):
                yield pa.RecordBatch.from_pydict({"at": [k], "part": [TaskContext.get().partitionId()], "sums": [total[k : k + PIECE].tobytes()]})

        return run

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        total = np.zeros(len(frame["sums"].iloc[0]) // 4, np.float32)
        for raw in frame["sums"]:
            total += np.frombuffer(raw, np.float32)
        return pd.DataFrame({"at": frame["at"].iloc[:1], "part": frame["part"].iloc[:1], "sums": [total.tobytes()]})

    def summed(x: np.ndarray, last: bool) -> np.ndarray:
        shared = spark.sparkContext.broadcast(x)
        total = np.zeros((x.shape[1], x.shape[1]) if last else x.shape, np.float32)
        schema, parts = "at long, part long, sums binary", tasks
        made = rows.mapInArrow(task(shared, last), schema)
        while parts > FAN:
            parts = -(-parts // FAN)
            made = made.groupBy("at", F.col("part") % parts).applyInPandas(add, schema)
        for r in made.groupBy("at").applyInPandas(add, schema).toLocalIterator():
            part = np.frombuffer(r["sums"], np.float32).reshape(-1, x.shape[1])
            total[r["at"] : r["at"] + len(part)] = part
        shared.destroy()
        return total

    k = min(s.rank + s.common + s.extra, len(used))
    x = np.random.default_rng(5).standard_normal((len(used), k), dtype=np.float32)
    for _ in range(s.power + 1):
        x = orthonormal(summed(x, False))
    value, vector = np.linalg.eigh(summed(x, True).astype(np.float64))
    order = np.argsort(-value)
    order = order[value[order] > max(value.max(), 1e-9) * 1e-6]
    first = min(s.common, len(order) // 4)
    keep = order[first : first + s.rank]
    shared_row.destroy()
    return used, (x @ (vector[:, keep] / np.sqrt(value[keep]))).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Searcher:
    """One block of benchmark items, ready to be searched for in documents."""

    def __init__(self, items: list[np.ndarray], idf: np.ndarray, space: tuple[np.ndarray, np.ndarray], s: Settings):
        self.s = s
        used, vectors = space
        self.weighted = np.vstack([idf[used][:, None] * vectors, np.zeros((1, vectors.shape[1]), np.float32)])
        self.row = np.full(s.terms, len(used), np.int32)
        self.row[used] = np.arange(len(used))
        found: dict[tuple[int, int], list] = {}
        for k, item in enumerate(items):
            row = self.row[item % s.terms]
            size, step, _ = scales(len(item))
            for a, n in item_windows(len(item)):
                found.setdefault((size, step), []).append((k, a, self.weighted[row[a : a + n]].sum(axis=0)))
        self.scales = {key: (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), unit(np.stack([r[2] for r in rows])).T.copy()) for key, rows in found.items()}
        self.sizes = np.array([len(i) for i in items], np.int64)
        self.lists = [i.tolist() for i in items]
        words = np.concatenate(items) if items else np.zeros(0, np.uint32)
        self.holds = np.zeros(1 << 24, bool)  # hashed (item, word) pairs; a collision only lets a candidate pass
        self.holds[self._slot(np.repeat(np.arange(len(items)), self.sizes), words.astype(np.int64))] = True
        self.answers = []
        for item in items:
            rare = sorted(set(item.tolist()), key=lambda w: (-idf[w % s.terms], w))
            self.answers.append(rare[: s.answer_words])

    def _blocks(self, row: np.ndarray, begin: np.ndarray, n: int, step: int, most: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, number in it, where it begins, latent sum of its ``n`` words) of a block at every ``step`` words; past a document's end it holds nothing."""
        count = -(-np.diff(begin) // step)
        doc = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        at = begin[doc] + nth * step
        stop = begin[1:][doc]
        latent = np.empty((len(at), self.weighted.shape[1]), np.float32)
        buffer = np.empty((min(most, len(at)), latent.shape[1]), np.float32)
        for k in range(0, len(at), most):
            few, end, part = at[k : k + most], stop[k : k + most], latent[k : k + most]
            np.take(self.weighted, row[few], axis=0, out=part, mode="clip")
            for j in range(1, n):
                part += np.take(self.weighted, row[np.where(few + j < end, few + j, len(row) - 1)], axis=0, out=buffer[: len(few)], mode="clip")
        return doc, nth, at, latent

    def candidates(self, words: np.ndarray, begin: np.ndarray, most: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, where the item would begin in ``words``, cosine) of every pair of windows that are close enough.

        ``words`` holds documents one after another: the i-th is words[begin[i] : begin[i + 1]]. Left out are pairs in
        which under a third of the document's window are words of the item; where a leak is, some window has that many.
        """
        row = np.append(self.row[words % self.s.terms], len(self.weighted) - 1)
        padded = np.append(words, -1)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        grid = None
        for (n, step), (item, start, vectors) in self.scales.items():
            if n % BLOCK or step % BLOCK:
                doc, nth, at, latent = self._blocks(row, begin, n, step)
                use, stop, more = np.arange(len(at)), None, 0
            else:
                grid = grid or self._blocks(row, begin, BLOCK, BLOCK)
                doc, nth, at, latent = grid
                use, stop, more = np.flatnonzero(nth % (step // BLOCK) == 0), np.searchsorted(doc, doc, "right"), n // BLOCK - 1
                doc, at, stop = doc[use], at[use], stop[use]
            buffer = np.empty((min(most, len(at)), vectors.shape[1]), np.float32)
            for k in range(0, len(at), most):
                few = use[k : k + most]
                whole = latent[few]
                for j in range(1, more + 1):  # the blocks after a window's first, where its document has them
                    inside = few + j < stop[k : k + most]
                    if inside.all():
                        whole += latent[few + j]
                    else:
                        whole[inside] += latent[few[inside] + j]
                close = np.matmul(unit(whole), vectors, out=buffer[: len(few)])
                some = np.flatnonzero(close.max(axis=1) >= self.s.cosine)
                if len(some):
                    i, j = np.nonzero(close[some] >= self.s.cosine)
                    cosine, i = close[some[i], j], some[i] + k
                    place = at[i][:, None] + np.arange(n)
                    own = padded[np.where(place < begin[doc[i] + 1][:, None], place, len(words))]
                    fine = np.flatnonzero(3 * (self.holds[self._slot(item[j][:, None], own)] & (own >= 0)).sum(axis=1) >= np.minimum(n, self.sizes[item[j]]))
                    i, j = i[fine], j[fine]
                    found.append((doc[i], item[j], at[i] - start[j], cosine[fine]))
        return tuple(np.concatenate(x) for x in zip(*found))

    @staticmethod
    def _slot(item, word):
        return (item * 0x9E3779B1 + word * 0x5BD1E995 >> 20) & 0xFFFFFF

    def enough(self, words: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which of the slices words[low : high] hold as many of the item's words, in whatever order, as a leak needs."""
        need = np.ceil(min(self.s.part, self.s.whole) * self.sizes[item] - 1e-9).astype(np.int64)
        n = high - low
        inside = words[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        hit = np.append(0, np.cumsum(self.holds[self._slot(np.repeat(item, n), inside)]))
        stop = np.cumsum(n)
        fine = np.flatnonzero(hit[stop] - hit[stop - n] >= need)
        if not len(fine):
            return fine
        held = [set(words[a:b].tolist()) for a, b in zip(low[fine].tolist(), high[fine].tolist())]
        got = np.array([sum(w in h for w in self.lists[i]) for h, i in zip(held, item[fine].tolist())])
        return fine[got >= need[fine]]

    def leaks(self, docs: list[np.ndarray]) -> list[tuple[int, int, float, float, float]]:
        """(document, item, cosine, share of its words in order, share of its answer) of what leaks, best place of each."""
        s = self.s
        begin = np.cumsum([0, *map(len, docs)])
        words = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
        doc, item, at, close = self.candidates(words, begin)
        order = np.lexsort((-close, at, item, doc))  # places once each, with the largest cosine
        doc, item, at, close = doc[order], item[order], at[order], close[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1])
        doc, item, at, close = doc[new], item[new], at[new], close[new]
        m = self.sizes[item]
        low = np.maximum(begin[doc], at - m // 4)
        high = np.maximum(low, np.minimum(begin[doc + 1], at + m + -(-m // 4)))
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for k in range(0, len(doc), 8192):
            few = slice(k, k + 8192)
            fine = self.enough(words, item[few], low[few], high[few]) + k
            for d, i, a, b, c in zip(doc[fine].tolist(), item[fine].tolist(), low[fine].tolist(), high[fine].tolist(), close[fine].tolist()):
                part = words[a:b].tolist()
                in_order = common_subsequence(self.lists[i], part) / len(self.lists[i])
                answer = len(set(self.answers[i]) & set(part)) / len(self.answers[i])
                if (in_order >= s.whole or in_order >= s.part and answer >= s.answer) and ((d, i) not in best or (in_order, answer, c) > (best[d, i][1], best[d, i][2], best[d, i][0])):
                    best[d, i] = c, in_order, answer
        return [(*key, *v) for key, v in sorted(best.items())]


def item_blocks(benchmark: DataFrame, item_id: str, text: str, s: Settings) -> Iterator[list[tuple[object, np.ndarray]]]:
    """Benchmark items in blocks of bounded size, read one partition at a time."""
    block, size = [], 0
    for row in benchmark.select(col(item_id), col(text)).toLocalIterator():
        words = word_hashes(row[1])
        if not len(words):
            continue
        if block and size + len(words) > s.block_words:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    if block:
        yield block


def benchmark_windows(benchmark: DataFrame, text: str) -> DataFrame:
    """(words binary): windows of all items end to end."""

    def cut(batches):
        for batch in batches:
            out = []
            for x in batch.column(0).to_pylist():
                words = word_hashes(x).astype("<u4")
                size = scales(len(words))[0]
                out += [words[k : k + size].tobytes() for k in range(0, len(words) - len(words) % max(1, size), max(1, size))]
            yield pa.RecordBatch.from_pydict({"words": pa.array(out, pa.binary())})

    return stored(benchmark.select(col(text)).mapInArrow(cut, "words binary"), "windows")


def _searchers(words: DataFrame, idf: np.ndarray, benchmark: DataFrame, item_id: str, item_text: str, s: Settings) -> Iterator:
    """For each block of items what a task calls to get (ids of the items, Searcher); ``words`` has columns words and n."""
    spark = words.sparkSession
    space = None
    for block in item_blocks(benchmark, item_id, item_text, s):
        if space is None:
            with scratch(spark):
                space = latent_space(words, idf, benchmark_windows(benchmark, item_text), s)
        shared = spark.sparkContext.broadcast(([i for i, _ in block], [w for _, w in block], idf, space, s))
        yield lambda shared=shared: (shared.value[0], Searcher(*shared.value[1:]))


def _leaks_of(raw: list[bytes], searcher: Searcher, most: int = 200_000) -> list[tuple]:
    """(row, item, cosine, ...) of the leaks of rows of hashes, in blocks of about ``most`` words."""
    docs = [np.frombuffer(x, "<u4") for x in raw]
    found, at = [], 0
    while at < len(docs):
        stop, size = at, 0
        while stop < len(docs) and (stop == at or size + len(docs[stop]) <= most):
            size += len(docs[stop])
            stop += 1
        found += [(at + d, *rest) for d, *rest in searcher.leaks(docs[at:stop])]
        at = stop
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, cosine, words_in_order, answer_found) of every document that holds a benchmark item; a stored table."""
    spark = docs.sparkSession
    words, idf = split_words(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")), ["doc_id"], "text", settings.terms)
    schema = StructType([StructField(doc_id, docs.schema[doc_id].dataType), StructField(item_id, benchmark.schema[item_id].dataType), *(StructField(x, DoubleType()) for x in ("cosine", "words_in_order", "answer_found"))])
    folder = new_folder(spark, "leaks")
    spark.createDataFrame([], schema).write.parquet(folder)
    for load in _searchers(words, idf, benchmark, item_id, text, settings):

        def run(batches, load=load):
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(schema)
            ids, searcher = load()
            for batch in batches:
                if found := _leaks_of(batch.column(1).to_pylist(), searcher):
                    row, item, *rest = zip(*found)
                    columns = [batch.column(0).take(pa.array(row)), pa.array([ids[k] for k in item], arrow.types[1]), *(pa.array(c, pa.float64()) for c in rest)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        words.select("doc_id", "words").mapInArrow(run, schema).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns stay.

    Verdicts are made beside the rows, which are stored with their words, so each row is judged by its own text
    whatever its doc_id, and rows with equal texts alike.
    """
    own = tuple(fresh(docs.columns, x) for x in ("words", "n", "df"))
    every, idf = split_words(docs, docs.columns, text, settings.terms, own)
    words = every.select(col(own[0]).alias("words"), col(own[1]).alias("n"))
    schema, names, n_keys = every.schema, every.columns, len(docs.columns)

    def cleaned(rows: DataFrame, load) -> DataFrame:
        def run(batches):
            _, searcher = load()
            for batch in batches:
                fine = np.ones(batch.num_rows, bool)
                fine[[row for row, *_ in _leaks_of(batch.column(n_keys).to_pylist(), searcher)]] = False
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(fine)).columns, names=names)

        return map_arrow(rows, run, schema)

    kept, last = every, None
    for load in _searchers(words, idf, benchmark, item_id, text, settings):
        if last:
            kept = stored(cleaned(kept, last), "cleaned")
        last = load
    return (cleaned(kept, last) if last else kept).select(*map(col, docs.columns))
