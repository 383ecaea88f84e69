"""Quality by a regularised quadratic discriminant over transformed statistics of a text.

Each class has a mean and a covariance; the covariance is shrunk towards the pooled one and its diagonal. A
text's score is the logistic of the difference of the two classes' log densities (Mahalanobis distances by cached
Cholesky factors, log determinants, log priors). Means and covariances are sums over all labelled training rows,
gathered by one aggregate; nothing is sampled.

Null texts count as empty and get a score. Labels other than 0 and 1 are ignored; a row with several labels counts
once for each. If a class has no training rows there is no model: every score is 0.5, and a filter keeps all rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import as_bytes, map_batches
from millrace.session import written

FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digit", "stop", "shout", "symbol", "bar", "wide", "newline", "distinct", "lines", "packed", "commonest", "space")
THRESHOLD = 0.7
#: Share of the pooled covariance, and of its diagonal, in each class's own.
POOLED, DIAGONAL = 0.1, 0.02
#: Added to variances, so that a constant feature does no harm.
FLOOR = 1e-4


def _marks(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8)).astype(np.float64)


_classes = np.stack(
    [
        _marks(bytes(range(65, 91))), _marks(bytes(range(97, 123))), _marks(b"0123456789"), _marks(b".,;:?'\"-()"), _marks(b"!"), _marks(b"#$%&*+<=>@^~\\/_`"), _marks(b"|[]{}"),
        _marks(bytes(range(128, 256))), _marks(b"\n"), _marks(b" \t\r"),
    ],
    axis=1,
)


def features(text: bytes) -> list[float]:
    """Statistics of one text, transformed so that they are of order 1."""
    n = max(1, len(text))
    upper, lower, digit, stop, shout, symbol, bar, wide, newline, space = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _classes
    counts = Counter(text.split())
    words = sum(counts.values())
    m = max(1, words)
    lines = text.split(b"\n")
    root = lambda x: float(np.sqrt(x))
    return [
        float(np.log1p(len(text))), float(np.log1p(words)), float(np.log1p(len(text) / m)), root(upper / max(1.0, upper + lower)), root(digit / n), root(stop / n), root(shout / n),
        root(symbol / n), root(bar / n), root(wide / n), root(newline / m), float(np.log((len(counts) + 1) / (words + 1))), len(set(lines)) / len(lines),
        len(zlib.compress(text, 1)) / (n + 11), root(max(counts.values(), default=0) / m), root(space / n),
    ]


def held_out(id_col: str, folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


@dataclass(frozen=True)
class Model:
    """Per class: mean, inverse Cholesky factor of the covariance, and the constant of the log density."""

    mean: np.ndarray
    inverse: np.ndarray
    constant: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.mean):
            return np.full(len(x), 0.5)
        d = [self.constant[k] - 0.5 * (((x - self.mean[k]) @ self.inverse[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(d[0] - d[1], -700, 700)))


def featured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the array x of features for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], names=[id_col, "x"])

    return map_batches(df.select(F.col(id_col), as_bytes(text_col)), run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, x array<double>")


def fit(rows: DataFrame, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Model:
    """rows: columns x, quality and times, how often the row counts. One row of sums for each class comes to the driver."""
    p = len(FEATURES)
    x = [F.col("x")[i] for i in range(p)]
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.sum(x[i] * F.col("times")).alias(f"s{i}") for i in range(p)] + [F.sum(x[i] * x[j] * F.col("times")).alias(f"p{i}_{j}") for i, j in pairs]
    found = {r["quality"]: r for r in rows.groupBy("quality").agg(F.sum("times").alias("n"), *sums).collect()}
    if len(found) < 2:
        return Model(np.zeros((0, p)), np.zeros((0, p, p)), np.zeros(0))
    n, mean, cov = [], [], []
    for k in (0, 1):
        r = found[k]
        square = np.zeros((p, p))
        for i, j in pairs:
            square[i, j] = square[j, i] = r[f"p{i}_{j}"]
        n.append(r["n"])
        mean.append(np.array([r[f"s{i}"] for i in range(p)]) / r["n"])
        cov.append(square / r["n"] - np.outer(mean[k], mean[k]))
    both = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    inverse, constant = [], []
    for k in (0, 1):
        shrunk = (1 - pooled - diagonal) * cov[k] + pooled * both + diagonal * np.diag(np.diag(both)) + FLOOR * np.eye(p)
        factor = np.linalg.cholesky(shrunk)
        inverse.append(np.linalg.inv(factor))
        constant.append(np.log(n[k]) - np.log(np.diag(factor)).sum())
    return Model(np.array(mean), np.array(inverse), np.array(constant))


def training_rows(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Columns x, quality and times for the rows that are not held out. Labels are counted first, so each row meets one row of theirs."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count_if(F.col("quality") == 0).alias("n0"), F.count_if(F.col("quality") == 1).alias("n1"))
    both = rows.where(~held_out(id_col)).select(id_col, "x").join(known, id_col)
    kinds = F.array(*[F.struct(F.lit(k).alias("quality"), F.col(f"n{k}").alias("times")) for k in (0, 1)])
    return both.select("x", F.explode(kinds).alias("k")).select("x", "k.*").where("times > 0")


def digests(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Columns id_col, held_out, score, predicted for each row of df. Texts are read once: their features are written."""
    rows = written(featured(df, id_col, text_col), "features")
    model = fit(training_rows(rows, labels, id_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(2).to_pylist(), np.float64).reshape(-1, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return map_batches(rows.select(id_col, held_out(id_col).alias("held_out"), "x"), run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, all their columns, whose score reaches the threshold; all rows if a class has no training rows.

    The rows that may train are read for fitting, and all rows for scoring, so features of three quarters of the rows are computed twice.
    Writing them beside the rows instead would take a second copy of all texts, which has to stay until the result is read.
    """
    model = fit(training_rows(featured(df.where(~held_out(id_col)), id_col, text_col), labels, id_col))
    if not len(model.mean):
        return df

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            values = np.array([features((t or "").encode()) for t in texts], np.float64).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(values) >= threshold))

    return map_batches(df, kept, df.schema)
