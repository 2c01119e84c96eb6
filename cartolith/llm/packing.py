"""Packing of documents into token windows with their lexical neighbours, by a sharded BM25 inverted index.

1. Each text is tokenised (its ids and a closing one) and stored with a routing key, the least hash over its pairs of
   neighbouring ids: texts that share much of their wording tend to share the key. Each different piece of a
   block of texts is encoded once. Each task adds a row with the document frequencies of its texts.
2. Document frequencies of all token ids and the mean length are summed over all documents. The vocabulary bounds them.
3. Documents are range-partitioned by (routing key, doc_id, place in the table): a shard holds about ``shard_tokens``
   tokens, and a frequent key, a group of copies or a repeated row is split over as many shards as it needs.
4. A shard builds an inverted index of its documents: postings by token id with BM25 weights. A document's full windows
   stand alone. Of the rest, the first unused document is the seed of a window; the index ranks the unused documents by
   BM25 for all of the seed's terms; they fill the window in that order, the last one cut to fit exactly, and what is
   left of it waits to seed the next window. So only the last window of a shard can have padding.

Each id of a document is in exactly one piece. A null or empty text has the closing id alone. Repeated rows and null
doc_ids are packed like any other rows (start and length tell pieces apart, equal rows give equal pieces). Equal scores
go to the document that comes first in the shard. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import beyond_latin, binary_rows, col, latin_runs, map_blocks, spread, stored, texts_with, utf8

CLOSING = 1
#: Bytes of text that a task tokenises at once; the more, the fewer pieces it meets again.
BLOCK_BYTES = 4_000_000
#: Fixed values of the tokenizer's split, by code points below U+0100: white space, letters, digits (each alone), others;
#: and endings that a mark of omission begins.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0]
LETTERS = [*range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]
DIGITS = [*range(0x30, 0x3A), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, DIGIT, OTHER = range(4)
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[SPACES], CLASSES[LETTERS], CLASSES[DIGITS] = SPACE, LETTER, DIGIT


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_endings(low: np.ndarray, kind: np.ndarray, first: np.ndarray, offsets: np.ndarray) -> None:
    """Makes runs of a mark of omission and the ending after it, as in "it's"."""
    marks = np.flatnonzero((low == ord("'")) & first)
    if not len(marks):
        return
    stop = offsets[np.searchsorted(offsets, marks, "right")]  # of the mark's text
    after = [np.where(marks + k < stop, low[np.minimum(marks + k, len(low) - 1)], 0) for k in (1, 2)]
    size = np.zeros(len(marks), np.int64)
    for e in ENDINGS:
        size[(after[0] == ord(e[0])) & (len(e) == 1 or after[1] == ord(e[-1]))] = len(e)
    marks, stop, size = marks[size > 0], stop[size > 0], size[size > 0]
    first[marks + 1] = False
    rest = marks + 1 + size
    rest = rest[rest < stop]
    first[rest[kind[rest] == LETTER]] = True


class Encoder:
    """Ids of whole texts, the same as the tokenizer's.

    Texts are cut as the tokenizer cuts them before it merges, and each different piece of a block of texts is encoded
    once; the first ``keep`` pieces are kept for later blocks. Texts with characters from U+0100 on, or with what may be
    a special token, go to the tokenizer itself.
    """

    def __init__(self, path: str, keep: int = 300_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        model = self.tokenizer.model
        self.ascii, self.bare = Tokenizer(model), Tokenizer(model)  # the merges alone, over pieces between spaces
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # bytes of printable ASCII stand for themselves
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(len(vocabulary), max(vocabulary.values()) + 1, CLOSING + 1)
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(model.end_of_word_suffix)]] = True
        self.kind = np.dtype("<u4" if self.size > 1 << 16 else "<u2")
        self.known = pa.array([], pa.string())  # the pieces that are kept, and all their ids one after another
        self.ids, self.counts = np.zeros(0, self.kind), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str], at_once: int = 2000) -> list[bytes]:
        """Ids of each piece: many are encoded as one text, whose ids are cut after each that ends a word."""
        out: list[bytes] = []
        for k in range(0, len(pieces), at_once):
            few = pieces[k : k + at_once]
            text = " ".join(few)
            plain = text.isascii() and text.isprintable()
            ids = np.array((self.ascii if plain else self.bare).encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(few):
                out += self._encode(few)
                continue
            raw, last = ids.tobytes(), 0
            for c in (cut * self.kind.itemsize).tolist():
                out.append(raw[last:c])
                last = c
        return out

    def _of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each piece begin, how many it has)."""
        at = pc.index_in(pieces, value_set=self.known)
        new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        strange = pieces.take(pa.array(new))
        texts = strange.to_pylist()
        order = sorted(range(len(texts)), key=lambda i: texts[i].isascii())  # so that most runs of pieces are plain
        raw = [b""] * len(texts)
        for i, x in zip(order, self._encode_pieces([texts[i] for i in order])):
            raw[i] = x
        ids = np.concatenate([self.ids, np.frombuffer(b"".join(raw), self.kind)])
        counts = np.concatenate([self.counts, np.fromiter(map(len, raw), np.int64, len(raw)) // self.kind.itemsize])
        number = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        number[new] = len(self.known) + np.arange(len(new))
        first = np.cumsum(counts) - counts
        if room := min(len(new), self.keep - len(self.known)):
            self.known = pa.concat_arrays([self.known, strange.slice(0, room).cast(pa.string())])
            self.counts = counts[: len(self.known)]
            self.ids = ids[: self.counts.sum()]
        return ids, first[number], counts[number]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, begin): text i has ids[begin[i] : begin[i + 1]]."""
        data = utf8(texts)[1]
        odd = texts_with(texts, np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))) | beyond_latin(texts)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        codes, begin, pieces = latin_runs(plain, CLASSES, DIGIT, cut_endings)
        ids, begin = spread(codes, begin, *self._of(pieces))
        if odd.any():
            other = iter(self._encode(texts.filter(pa.array(odd)).to_pylist()))
            each = [np.frombuffer(next(other), self.kind) if o else ids[a:b] for o, a, b in zip(odd, begin[:-1], begin[1:])]
            ids, begin = np.concatenate(each), np.cumsum([0, *map(len, each)])
        return ids, begin


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def routing_keys(ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Of each document the least 32-bit hash over the pairs of neighbouring ids; 2^32 for fewer than two ids."""
    if not len(ids):
        return np.full(len(begin) - 1, 1 << 32)
    x = ids.astype(np.uint32)
    pair = np.append((x[:-1] << np.uint32(16) ^ x[1:]) * np.uint32(0x9E3779B1), np.uint32(0))
    pair = ((pair ^ pair >> np.uint32(15)) * np.uint32(0x85EBCA77)).astype(np.int64)
    sizes = np.diff(begin)
    pair[begin[1:][sizes > 0] - 1] = 1 << 32  # the last id of a document has no pair
    out = np.full(len(sizes), 1 << 32)
    full = np.flatnonzero(sizes)
    out[full] = np.minimum.reduceat(pair, begin[:-1][full])
    return out


class _Tokens:
    """A task's tokeniser: columns (ids, n, route, df) of a block of texts; df is null but for the task's last row."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        self.df = np.zeros(self.encoder.size, np.int64)

    def __call__(self, texts: pa.Array) -> list:
        ids, begin = self.encoder(texts)
        ids = np.insert(ids, begin[1:], CLOSING)
        begin = begin + np.arange(len(begin))
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
            self.df[np.unique(ids[a:b])] += 1
        return [binary_rows(ids, begin), np.diff(begin), routing_keys(ids, begin), pa.nulls(len(texts), pa.binary())]

    def last(self) -> list:
        at = np.flatnonzero(self.df)
        return [[None], [None], [None], [np.stack([at, self.df[at]]).astype("<i8").tobytes()]] if len(at) else []


def tokenized(docs: DataFrame, doc_id: str, text: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Stored tables (doc_id, ids binary, n long, route long), ids as little-endian integers of two or four bytes, and (df binary) of the tasks' document frequencies."""
    own = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    every = stored(map_blocks(own, ["doc_id"], "text", "ids binary, n long, route long, df binary", lambda: _Tokens(path), _Tokens.last, BLOCK_BYTES), "tokens")
    return every.where("n is not null").drop("df"), every.where("df is not null").select("df")


def frequencies(each: DataFrame, size: int) -> np.ndarray:
    """Document frequency by token id, over all documents: the sum of what the tasks counted."""

    def spread(batches):
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                at, n = np.frombuffer(raw, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"id": at, "n": n})

    found = each.mapInArrow(spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(size, np.int64)
    total[found["id"]] = found["n"]
    return total


class Bm25:
    """Inverted index of a shard: for each term the documents that hold it and their weights, in document order.

    Postings of terms that a ``DENSE``-th of the documents hold are rows with a weight for each document, at most
    ``DENSE`` cells for a posting. Terms of one document alone tell nothing about another, and are left out.
    """

    DENSE = 8

    def __init__(self, ids: np.ndarray, begin: np.ndarray, idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        self.n = n = len(begin) - 1
        length = np.diff(begin)
        pairs, tf = np.unique(np.repeat(np.arange(n), length) * len(idf) + ids, return_counts=True)
        doc, term = np.divmod(pairs, len(idf))
        df = np.bincount(term, minlength=len(idf))
        shared = df[term] > 1
        doc, term, tf = doc[shared], term[shared], tf[shared]
        weight = (idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean))).astype(np.float32)
        dense = df * self.DENSE >= max(n, 2 * self.DENSE)
        row = np.cumsum(dense) - 1
        common = dense[term]
        self.rows = np.zeros((int(dense.sum()), n), np.float32)
        self.rows[row[term[common]], doc[common]] = weight[common]
        self.common, self.common_begin = row[term[common]], np.searchsorted(doc[common], np.arange(n + 1))
        doc, term, weight = doc[~common], term[~common], weight[~common]
        self.rare, self.rare_begin = term, np.searchsorted(doc, np.arange(n + 1))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.begin = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 scores of all documents for the seed's terms, each term once."""
        out = self.rows[self.common[self.common_begin[seed] : self.common_begin[seed + 1]]].sum(axis=0)
        terms = self.rare[self.rare_begin[seed] : self.rare_begin[seed + 1]]
        if len(terms):
            spans = [slice(a, b) for a, b in zip(self.begin[terms].tolist(), self.begin[terms + 1].tolist())]
            out = out + np.bincount(np.concatenate([self.doc[x] for x in spans]), np.concatenate([self.weight[x] for x in spans]), self.n)
        return out


#: So many neighbours are ranked at first, all others only if these do not fill the window.
NEAREST = 48


def pack_shard(ids: np.ndarray, begin: np.ndarray, idf: np.ndarray, mean: float, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces of a shard's documents: (document, start, length, sequence, offset); ids of document i are ids[begin[i] : begin[i + 1]]."""
    pieces, sequence = [], 0
    n_docs = len(begin) - 1
    left = np.diff(begin)
    start = np.zeros(n_docs, np.int64)
    for i in np.flatnonzero(left >= window).tolist():
        for _ in range(left[i] // window):
            pieces.append((i, int(start[i]), window, sequence, 0))
            sequence += 1
            start[i] += window
    left %= window
    index, first = Bm25(ids, begin, idf, mean), 0
    waiting = None
    while True:
        if waiting is not None and left[waiting]:
            seed = waiting
        else:
            while first < n_docs and not left[first]:
                first += 1
            if first == n_docs:
                break
            seed = first
        offset = 0
        scores, best, waiting = None, None, None
        queue = iter((seed,))
        while offset < window:
            i = next(queue, None)
            if i is None:
                if scores is None:
                    scores = np.where(left > 0, index.scores(seed), -1.0)
                    best = np.argpartition(-scores, NEAREST)[:NEAREST] if len(scores) > NEAREST else np.arange(len(scores))
                elif best is not None and len(scores) > NEAREST:
                    best = np.arange(len(scores))  # the nearest did not fill the window
                else:
                    break
                queue = iter(best[np.lexsort((best, -scores[best]))].tolist())
                if len(best) == len(scores):
                    best = None
                continue
            n = int(min(left[i], window - offset))
            if not n:
                continue
            pieces.append((i, int(start[i]), n, sequence, offset))
            start[i] += n
            left[i] -= n
            offset += n
            if left[i]:
                waiting = i
        sequence += 1
    return pieces


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, window: int = 2048, shard_tokens: int = 1_000_000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece.

    ``tokenizer`` is the path of a tokenizer file that driver and executors have. A sequence's id is its shard's number
    times 2^32 plus its number there. Sequences are ``window`` long, but for the last of each shard.
    """
    path = tokenizer or default_tokenizer()
    tokens, counted = tokenized(docs, doc_id, text, path)
    total, n = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    own = encoder(path)
    kind = own.kind.str
    df = frequencies(counted, own.size)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    shared = docs.sparkSession.sparkContext.broadcast((idf, max(1.0, total / max(1, n))))
    placed = tokens.withColumn("at", F.monotonically_increasing_id())  # so that equal rows can part
    shards = placed.repartitionByRange(max(1, -(-total // shard_tokens)), "route", "doc_id", "at")
    names = [doc_id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = StructType([StructField(names[0], docs.schema[doc_id].dataType)] + [StructField(x, LongType()) for x in names[1:]])

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        keys, parts, sizes = [], [], []
        for batch in batches:
            keys.append(batch.column(0))
            raw = batch.column(1).to_pylist()
            parts.append(b"".join(raw))
            sizes += map(len, raw)
        if not sizes:
            return
        ids = np.frombuffer(b"".join(parts), kind)
        del parts
        begin = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(np.array(sizes, np.int64) // ids.itemsize, out=begin[1:])
        base = TaskContext.get().partitionId() << 32
        pieces = pack_shard(ids, begin, *shared.value, window)
        i, start, length, sequence, offset = np.array(pieces, np.int64).T
        wide = ids.astype("<u4")
        crc = [crc32(wide[a : a + k]) for a, k in zip((begin[i] + start).tolist(), length.tolist())]
        keys = pa.chunked_array(keys).take(pa.array(i)).combine_chunks()
        columns = [keys, *(pa.array(x, pa.int64()) for x in (start, length, crc, np.diff(begin)[i], sequence + base, offset))]
        yield pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(schema))

    return shards.sortWithinPartitions("route", "doc_id", "at").select("doc_id", "ids").mapInArrow(run, schema)
