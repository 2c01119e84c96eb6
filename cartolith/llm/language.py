"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text is put in lower case; each run of anything but letters becomes one space. Its n-grams of 1 to 3 characters, of
which those of a space alone are left out, are hashed into ``buckets`` counters. Training sums the counters by language
(tasks give their non-zero sums, so what is shuffled is bounded by languages times buckets for each task). What is
broadcast is the matrix of log-probabilities, as its cells that differ from a language's smoothed floor. Texts are
scored in numpy, a block of them at once: their sparse matrix of counts times that matrix, ``AT_ONCE`` languages at a
time, so that any number of languages fits.

``lang_pred`` is ``und``, with score 0, for a null text or one without a letter. Equal scores go to the language that
is first by name. A null doc_id counts as not held out. With no training row at all, everything is ``und``. Repeated
rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import about, col, fresh, is_held_out, is_training, map_texts, quoted, spans, stored

BUCKETS = 1 << 15
#: Languages that a task holds dense counters or probabilities of at once.
AT_ONCE = 64
#: Bytes of text that are worked on at once; n-grams take about 60 times as much.
BLOCK_BYTES = 500_000


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(texts: list[str | None], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse matrix of n-gram counts, (text * buckets + bucket, count) in that order, and whether each text has a letter."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.cumsum([0, *(len(t) + 1 for t in low)])
    letter = letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a run of other characters is kept once, as a space
    keep[begin[1:] - 1] = True
    c = np.where(letter, points, 32)[keep].astype(np.uint32)
    kind = np.uint32 if len(low) * buckets < 1 << 32 else np.int64
    text = np.repeat(np.arange(len(low), dtype=kind), np.diff(begin))[keep]
    a, b = c[:-1], c[1:]
    two = a * np.uint32(0x01000193) ^ b
    three = two[:-1] * np.uint32(0x01000193) ^ c[2:]
    shift = np.uint32(33 - buckets.bit_length())
    mix = lambda x, salt: ((x + np.uint32(salt)) * np.uint32(0x9E3779B1)) >> shift
    first = text * kind(buckets)
    parts = [(first + mix(c, 1))[c != 32], (first[:-1] + mix(two, 0x3C6EF372))[(text[:-1] == text[1:]) & ((a != 32) | (b != 32))]]
    parts.append((first[:-2] + mix(three, 0x78DDE6E4))[(text[:-2] == text[2:]) & (c[1:-1] != 32)])
    has = np.bincount(text[c != 32], minlength=len(low)) > 0
    return *np.unique(np.concatenate(parts), return_counts=True), has


class Model:
    """Languages by name, and what a text's counts are multiplied with.

    ``base`` and ``floor`` are the log prior and the log-probability of a bucket without a count; ``lang``, ``bucket``
    and ``more`` the cells above the floor, by language.
    """

    def __init__(self, found, buckets: int, smoothing: float):
        """``found`` has columns lang, bucket (-1: the rows) and n."""
        self.names, self.buckets = sorted(found["lang"].unique()), buckets
        number = found["lang"].map({n: k for k, n in enumerate(self.names)}).to_numpy(np.int32)
        bucket, n = found["bucket"].to_numpy(np.int32), found["n"].to_numpy(np.float64)
        rows = bucket < 0
        prior, total = (np.bincount(number[at], n[at], len(self.names)) for at in (rows, ~rows))
        self.base = np.log(prior / max(1.0, prior.sum())) if len(self.names) else prior
        self.floor = np.log(smoothing / (total + smoothing * buckets))
        order = np.lexsort((bucket, number))
        order = order[bucket[order] >= 0]
        self.lang, self.bucket = number[order], bucket[order]
        self.more = np.log((n[order] + smoothing) / smoothing).astype(np.float32)
        self._whole = None

    def matrix(self, low: int, high: int) -> np.ndarray:
        """Log-probabilities above the floor, buckets x languages from ``low`` to ``high``."""
        if self._whole is not None:
            return self._whole
        part = slice(*np.searchsorted(self.lang, [low, high]))
        out = np.zeros((self.buckets, high - low), np.float32)
        out[self.bucket[part], self.lang[part] - low] = self.more[part]
        if len(self.names) <= AT_ONCE:
            self._whole = out
        return out

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its posterior probability."""
        keys, n, has = gram_counts(texts, self.buckets)
        text, bucket = np.divmod(keys.astype(np.int64), self.buckets)
        rows, first = np.unique(text, return_index=True)
        length = np.bincount(text, n, len(texts))[rows]
        top = np.full(len(rows), -np.inf)
        best, mass = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        for low in range(0, len(self.names), AT_ONCE):
            high = min(low + AT_ONCE, len(self.names))
            log = self.base[low:high] + length[:, None] * self.floor[low:high]
            if len(rows):
                log += np.add.reduceat(n[:, None] * self.matrix(low, high)[bucket].astype(np.float64), first, axis=0)
            own = log.argmax(axis=1)
            most = log[np.arange(len(log)), own]
            better = most > top
            new = np.maximum(top, most)
            mass = mass * np.exp(top - new) + np.exp(log - new[:, None]).sum(axis=1)
            best[better], top = low + own[better], new
        names, sure = ["und"] * len(texts), np.zeros(len(texts))
        if self.names:
            for i, k, p in zip(rows.tolist(), best.tolist(), (1 / mass).tolist()):
                if has[i]:
                    names[i], sure[i] = self.names[k], p
        return names, sure.tolist()


def train(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS, smoothing: float = 0.5) -> Model:
    """The model of rows that have a text and a language."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}

        def told():
            for name, total in sums.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict({"lang": [name] * (len(at) + 1), "bucket": np.append(at, -1), "n": np.append(total[at], rows[name])})
            sums.clear()
            rows.clear()

        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b in spans(batch.column(1), BLOCK_BYTES):
                keys, n, _ = gram_counts(batch.column(1).slice(a, b - a).to_pylist(), buckets)
                whose, bucket = np.divmod(keys.astype(np.int64), buckets)
                at = np.searchsorted(whose, np.arange(b - a + 1))
                for k, name in enumerate(names[a:b]):
                    if name not in sums:
                        if len(sums) == AT_ONCE:  # of many languages the sums so far are told, to be added up later
                            yield from told()
                        sums[name], rows[name] = np.zeros(buckets, np.int64), 0
                    own = slice(at[k], at[k + 1])
                    sums[name][bucket[own]] += n[own]
                    rows[name] += 1
        yield from told()

    rows = docs.where(col(lang).isNotNull() & col(text).isNotNull()).select(col(lang).cast("string"), col(text))
    sums = stored(rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "grams")
    return Model(sums.toPandas(), buckets, smoothing)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 20_000, **options):
    """The broadcast model, learned from rows that are not held out and have a language.

    From all of them up to ``sample``, else from about that many.
    """
    labelled = docs.where(is_training(doc_id) & col(lang).isNotNull())
    labelled = about(labelled, sample, labelled.count())
    return docs.sparkSession.sparkContext.broadcast(train(labelled, text, lang, **options))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; ``options`` are those of :func:`fit` and :func:`train`."""
    model = fit(docs, doc_id, text, lang, **options)
    out = map_texts(docs, [doc_id], text, "lang_pred string, score double", lambda texts: list(model.value.score(texts)), BLOCK_BYTES)
    return out.select(col(doc_id), is_held_out(doc_id).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.5, **options) -> DataFrame:
    """``docs`` without rows whose language can't be told: ``und``, or a probability under ``least``. All columns stay.

    The verdict is made beside the row, so rows with equal or null doc_ids are judged one by one.
    """
    model = fit(docs, doc_id, text, lang, **options)
    verdict = fresh(docs.columns, "keep")
    keep = lambda texts: [[x != "und" and p >= least for x, p in zip(*model.value.score(texts))]]
    return map_texts(docs, docs.columns, text, f"{quoted(verdict)} boolean", keep, BLOCK_BYTES).where(col(verdict)).select(*map(col, docs.columns))
