"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics of a text (shares of character classes, word and line lengths, repetition) are read once. Cosines of
random projections of the standardised statistics approximate a Gaussian kernel; the ridge weights come from normal
equations whose sums every partition makes for itself and a few tasks add up. The fitted values are calibrated by
pooling adjacent violators over a histogram of a fixed number of bins. What reaches the driver has a fixed size:
means, FAN_IN sums of the normal equations, and the histogram. All labelled rows take part; none is sampled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import write_shared

N_COSINES = 256
FAN_IN = 8
N_BINS = 1024
CLIP = 6.0

#: Character classes by byte, for shares of a text.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "blank": b" \t", "line": b"\n\r", "symbol": b"#*$%&<>@^~_=+\\", "bar": b"|", "mark": b"!?", "stop": b".", "comma": b",;:",
    "bracket": b"()[]{}", "quote": b"\"'`", "slash": b"/-", "control": bytes([*range(9), 11, 12, *range(14, 32), 127]), "beyond": bytes(range(128, 256)),
}
_BYTE_CLASS = np.zeros((256, len(_CLASSES)))
for _i, _members in enumerate(_CLASSES.values()):
    _BYTE_CLASS[list(_members), _i] = 1
N_STATISTICS = len(_CLASSES) + 12
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def statistics(text: str) -> np.ndarray:
    """The statistics of a whole text; an empty one has zeros only."""
    out = np.zeros(N_STATISTICS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return out
    codes = np.frombuffer(data, np.uint8)
    shares = np.bincount(codes, minlength=256) / len(codes)
    k = len(_CLASSES)
    out[:k] = np.sqrt(shares @ _BYTE_CLASS)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    space = _SPACE[codes]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    first = codes[starts]
    last = codes[starts + lengths - 1]
    lines = [x for x in data.split(b"\n") if x.strip()]
    present = shares[shares > 0]
    out[k:] = (
        math.log1p(n),
        lengths.mean(),
        lengths.std(),
        (lengths <= 3).mean(),
        len(set(words)) / n,
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        -(present * np.log2(present)).sum(),
        ((first >= 65) & (first <= 90)).mean(),
        ((last >= 33) & (last <= 47) | (last >= 58) & (last <= 64)).mean(),
        (lengths >= 20).mean(),
    )
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label may be learned from: crc32 of the id as text leaves 1 modulo 3. A null id isn't one."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def read_statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "x"])

    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    at: np.ndarray  # knots of the calibration: fitted values and scores
    score: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -CLIP, CLIP)
        return np.hstack([np.cos(z @ self.waves + self.phase) * math.sqrt(2 / N_COSINES), np.ones((len(z), 1))])

    def fitted(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1. One hundredth is the fitted value itself, so that ties within a step of the calibration keep its order."""
        raw = self.fitted(x)
        return np.clip(0.99 * np.interp(raw, self.at, self.score) + 0.01 * np.clip(raw, 0, 1), 0, 1)


def isotonic(at: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: knots whose values rise, at the pools' mean places."""
    pools: list[list[float]] = []
    for a, v, w in zip(at, value, weight, strict=True):
        pools.append([a * w, v * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(rows: DataFrame, seed: int = 7, ridge: float = 1e-4) -> Model | None:
    """rows: x and y (0 to 1), in a table that can be read again. None if there are no rows."""
    d = N_STATISTICS

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * d + 1)
        for batch in batches:
            x = _matrix(batch.column(0))
            total += np.concatenate([x.sum(0), (x * x).sum(0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    def added(parts: DataFrame) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                part = _matrix(batch.column(0)).sum(0)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        return np.sum([r["sums"] for r in parts.repartition(FAN_IN).mapInArrow(add, "sums array<double>").collect()], axis=0)

    sums = added(rows.select("x").mapInArrow(moments, "sums array<double>"))
    n = sums[-1]
    if not n:
        return None
    mean = sums[:d] / n
    scale = np.sqrt(np.maximum(sums[d : 2 * d] / n - mean**2, 0))
    scale[scale < 1e-9] = 1
    random = np.random.default_rng(seed)
    model = Model(mean, scale, random.normal(0, 1 / math.sqrt(d), (d, N_COSINES)), random.uniform(0, 2 * math.pi, N_COSINES), np.zeros(N_COSINES + 1), np.array([0.0]), np.array([0.5]))
    size = N_COSINES + 1

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size + size)
        for batch in batches:
            c, y = model.cosines(_matrix(batch.column(0))), batch.column(1).to_numpy()
            total += np.concatenate([(c.T @ c).ravel(), c.T @ y])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

    sums = added(rows.select("x", "y").mapInArrow(normal, "sums array<double>"))
    penalty = np.eye(size) * (0.1 + ridge * n)
    penalty[-1, -1] = 1e-6
    model.weights = np.linalg.solve(sums[: size * size].reshape(size, size) + penalty, sums[size * size :])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.clip(model.fitted(_matrix(batch.column(0))), -0.5, 1.5)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum((raw + 0.5) * N_BINS / 2, N_BINS - 1).astype(np.int32)), pa.array(raw), batch.column(1)], ["bin", "raw", "y"])

    bins = rows.select("x", "y").mapInArrow(binned, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("at"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    model.at, model.score = isotonic(*(np.array([r[k] for r in bins], float) for k in ("at", "y", "n")))
    return model


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", statistics_of: DataFrame | None = None) -> Model | None:
    """A model of label_col, learned from the rows of df that have labels and aren't held out.

    Several labels of an id count by their mean; null labels and ids are ignored.
    """
    rows = statistics_of if statistics_of is not None else read_statistics(df, id_col, text_col)
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.avg("y").alias("y"))
    known = known.where(~held_out("id"))
    return fit(write_shared(rows.join(known, "id").select("x", "y"), "labelled"))


def _scores(model: Model | None, x: np.ndarray) -> np.ndarray:
    return np.full(len(x), 0.5) if model is None else model.scores(x)


def score_documents(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """For each row of df: id_col, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5).

    Scores depend on the text alone. Null and empty texts get the score of a text without words. Without a single
    label to learn from, every score is 0.5. Repeated rows and ids give a row each; an empty table gives none.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = write_shared(read_statistics(df, id_col, text_col), "statistics")
    model = train(df, labels, id_col, text_col, label_col, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, _matrix(batch.column(1))), pa.float64())], ["id", "score"])

    scored = rows.mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows of df whose score is `least` or more, with all their columns. The text is read twice, and never shuffled."""
    model = train(df, labels, id_col, text_col, label_col)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([statistics(t or "") for t in batch.column(at).to_pylist()])
                yield batch.filter(pa.array(_scores(model, x) >= least))

    return df.mapInArrow(run, df.schema)
