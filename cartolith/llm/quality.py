"""Quality classifier: random Fourier features of document statistics, ridge regression and isotonic calibration.

1. A text is described by :data:`STATISTICS`, from the whole text, null as empty. They are computed once and stored.
2. Statistics are standardised by their mean and deviation over the training rows. ``features`` random cosines
   approximate a Gaussian kernel of width ``width``.
3. Tasks sum the normal equations of their training rows; the sums are added up in rounds, ``FAN`` of them by a task, so
   that no task holds more, and the driver gets one. Ridge regression solves them there.
4. A disjoint part of the training rows is scored; its labels are counted in ``bins`` bins of the score, and pooling of
   adjacent violators makes a monotone curve of them.

Training rows are those whose crc32(doc_id as text) mod 3 is not 1, with a label that is not null: remainder 0 fits the
ridge, remainder 2 calibrates. A doc_id with several labels has their
mean, so a join never multiplies rows. Without training rows every score is
0.5. Repeated rows give repeated results, a null doc_id is scored and not held out, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, WORD_SPACE, col, is_held_out, map_texts, scratch, stored

STATISTICS = (
    "log_chars", "log_words", "log_lines", "word_length", "word_length_deviation", "longest_word", "symbols", "digits", "capitals",
    "sentence_marks", "exclamations", "not_ascii", "spaces", "duplicate_lines", "distinct_words", "distinct_trigrams", "most_frequent_word",
    "capital_words", "words_without_letter", "compressed",
)


def _classes() -> np.ndarray:
    """For each byte value a row of class memberships, summed by one product with the byte histogram."""
    groups = [b"#*$%&|<>", b"0123456789", bytes(range(65, 91)), b".,;:?", b"!", bytes(range(128, 256)), b" \t\r\n"]
    return np.array([[b in g for g in groups] for b in range(256)], np.float64)


CLASSES = _classes()


def statistics(text: str | None) -> list[float]:
    text = text or ""
    words = WORD.findall(text)
    n, chars = len(words), len(text)
    if not n:
        return [float(np.log1p(chars))] + [0.0] * (len(STATISTICS) - 1)
    raw = text.encode("utf-8", "surrogatepass")
    shares = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ CLASSES / len(raw)
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = [x for x in text.split("\n") if x.strip(WORD_SPACE)]
    counts = Counter(words)
    trigrams = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0
    capital = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / n
    bare = sum(c for w, c in counts.items() if w.upper() == w.lower()) / n
    return [
        float(np.log1p(chars)), float(np.log1p(n)), float(np.log1p(len(lines))), float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())), *shares.tolist(),
        1 - len(set(lines)) / len(lines), len(counts) / n, trigrams, max(counts.values()) / n, capital, bare, len(zlib.compress(raw, 1)) / len(raw),
    ]


class Fourier:
    """Random cosine features of standardised statistics, with a constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, width: float, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.standard_normal((len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))])


def isotonic(ones: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Non-decreasing shares of ones by bin, by pooling adjacent violators; empty bins take those of their neighbours."""
    blocks: list[list[float]] = []  # ones, count, bins
    for y, n in zip(ones, count):
        blocks.append([float(y), float(n), 1])
        while len(blocks) > 1 and (not blocks[-1][1] or not blocks[-2][1] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]):
            y, n, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y, blocks[-1][1] + n, blocks[-1][2] + k]
    return np.concatenate([np.full(int(k), y / n if n else 0.5) for y, n, k in blocks])


def _matrix_rows(frames, features: Fourier):
    """One row of a task's summed normal equations."""
    total = None
    for frame in frames:
        z = features(np.stack(frame["stats"].to_numpy()).astype(np.float64))
        own = z.T @ np.column_stack([z, frame["label"].to_numpy(np.float64)])
        total = own if total is None else total + own
    if total is not None:
        from pyspark import TaskContext

        yield pd.DataFrame({"part": np.array([TaskContext.get().partitionId()], np.int32), "sums": [total.tobytes()]})


def _add_up(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"part": frame["part"].iloc[:1] // FAN, "sums": [sum(np.frombuffer(x) for x in frame["sums"]).tobytes()]})


#: So many matrices are added up by one task, round by round, until one is left.
FAN = 32


def summed(sums: DataFrame) -> np.ndarray:
    """The sum of the matrices of ``sums`` (part int, sums binary), whose parts are different from each other."""
    sums = stored(sums, "sums")
    while (most := sums.agg(F.max("part")).first()[0]) > 0:
        grouped = sums.groupBy((F.col("part") / FAN).cast("int").alias("g"))
        sums = grouped.applyInPandas(lambda f: _add_up(f), "part int, sums binary")
        sums = stored(sums, "sums") if most >= FAN else sums
        if most < FAN:
            break
    return np.frombuffer(sums.first()["sums"])


def fit(rows: DataFrame, features: int = 256, width: float = 4.0, ridge: float = 1e-2, bins: int = 512):
    """(Fourier, weights, bin curve) from (part int, stats array<float>, label double): part 0 fits, part 2 calibrates; None without rows."""
    own = rows.where("part = 0")
    each = [F.element_at("stats", i + 1).cast("double") for i in range(len(STATISTICS))]
    moments = own.agg(F.count("*"), *(f for x in each for f in (F.avg(x), F.stddev_pop(x)))).first()
    if not moments[0]:
        return None
    fourier = Fourier(np.array(moments[1::2], float), np.array(moments[2::2], float), features, width)
    sums = own.select("stats", "label").mapInPandas(lambda frames: _matrix_rows(frames, fourier), "part int, sums binary")
    with scratch(rows.sparkSession):
        total = summed(sums).reshape(features + 1, features + 2)
    weights = np.linalg.solve(total[:, :-1] + ridge * moments[0] / features * np.eye(features + 1), total[:, -1])

    def in_bins(frames):
        for frame in frames:
            z = fourier(np.stack(frame["stats"].to_numpy()).astype(np.float64)) @ weights
            yield pd.DataFrame({"bin": bin_of(z, bins), "label": frame["label"]})

    counted = rows.where("part = 2").select("stats", "label").mapInPandas(in_bins, "bin long, label double").groupBy("bin").agg(F.sum("label").alias("ones"), F.count("*").alias("n")).toPandas()
    if not len(counted):
        return fourier, weights, np.clip((np.arange(bins) + 0.5) / bins * 2 - 0.5, 0, 1)
    ones, n = np.zeros(bins), np.zeros(bins)
    ones[counted["bin"]], n[counted["bin"]] = counted["ones"], counted["n"]
    return fourier, weights, isotonic(ones, n)


def bin_of(z: np.ndarray, bins: int) -> np.ndarray:
    return np.clip(np.floor((z + 0.5) / 2 * bins), 0, bins - 1).astype(np.int64)


def calibrated(z: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """The curve at z, with a slope within a step so small that it orders ties but moves no score over a step."""
    inner = np.clip((z + 0.5) / 2, 0, 1)
    return np.clip(curve[bin_of(z, len(curve))] * (1 - 1e-6) + inner * 1e-6, 0, 1)


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; ``labels`` holds doc_id and a 0/1 ``label``."""
    own = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    stats = stored(map_texts(own, ["doc_id"], "text", "stats array<float>", lambda texts: [[statistics(t) for t in texts]]), "statistics")
    told = labels.groupBy(col(doc_id).alias("_id")).agg(F.avg(col(label).cast("double")).alias("label")).where("label is not null")
    rows = stats.join(told, stats["doc_id"] == told["_id"]).select((F.crc32(F.col("doc_id").cast("string")) % 3).alias("part"), "stats", "label").where("part <> 1")
    model = fit(rows, **options)

    def judge(frames):
        for frame in frames:
            if model is None or not len(frame):
                value = np.full(len(frame), 0.5)
            else:
                fourier, weights, curve = model
                value = calibrated(fourier(np.stack(frame["stats"].to_numpy()).astype(np.float64)) @ weights, curve)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": value, "predicted": (value >= 0.5).astype(np.int32)})

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    schema = StructType([stats.schema["doc_id"], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    out = stats.mapInPandas(judge, schema)
    return out.select(F.col("doc_id").alias(doc_id), is_held_out("doc_id").alias("held_out"), "score", "predicted")
