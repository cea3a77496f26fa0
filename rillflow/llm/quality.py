"""Quality classifier: regularised quadratic discriminant analysis over transformed text statistics.

Each class gets a mean and a covariance shrunk towards the pooled diagonal; the Cholesky factors are
kept, so a score costs two triangular products.  The difference of the log densities is turned into a
probability by a logistic calibration on the training sample.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, texts_of
from .labelled import fit_logistic, fold, labelled_sample

FOLDS, HELD_OUT = 3, 1
#: Labelled rows of each class that are used at most.
PER_CLASS = 8000
SHRINKAGE, FLOOR = 0.15, 1e-4
SYMBOLS = str.maketrans("", "", "#*$%&|<>")
ENDS = re.compile(r"[.!?]")
LETTER_CASE = re.compile(r"[A-ZÀ-ÖØ-Þ]")
FEATURES = ("length", "word_length", "symbols", "capitals", "repeats", "variety", "exclaims", "digits", "dup_lines", "ends")


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text; an empty one has zeros for every share."""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    repeats = sum(map(str.__eq__, words, words[1:]))
    root = lambda part, whole: math.sqrt(part / whole) if whole else 0.0
    return [
        math.log1p(n) / 4,
        math.log1p(chars / (n + 1)) if n else 0.0,
        root(chars - len(text.translate(SYMBOLS)), chars) if text else 0.0,
        root(len(LETTER_CASE.findall(text)), chars),
        root(repeats, n),
        math.log1p(len(set(words))) / math.log1p(n) if n else 1.0,
        root(text.count("!"), n + 1),
        root(sum(map(text.count, "0123456789")), chars),
        root(len(lines) - len(set(lines)), len(lines)),
        root(len(ENDS.findall(text)), n + 1),
    ]


@dataclass
class QualityModel:
    """Of each class: mean, inverse Cholesky factor, log determinant and log share; and the calibration."""

    means: np.ndarray
    inverse_factors: np.ndarray
    constants: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def log_density_difference(self, x: np.ndarray) -> np.ndarray:
        z = np.einsum("cij,cnj->cni", self.inverse_factors, x[None] - self.means[:, None])
        d = self.constants[:, None] - 0.5 * (z * z).sum(axis=2)
        return d[1] - d[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        t = self.slope * squash(self.log_density_difference(x)) + self.shift
        return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def squash(difference: np.ndarray) -> np.ndarray:
    """Signed logarithm: densities far out in a tail must not decide the calibration alone."""
    return np.sign(difference) * np.log1p(np.abs(difference))


def fit_arrays(x: np.ndarray, y: np.ndarray, shares: tuple[float, float], shrinkage: float = SHRINKAGE, floor: float = FLOOR) -> QualityModel:
    """Class covariance = (1 - shrinkage) * own + shrinkage * pooled diagonal + floor on the diagonal."""
    width = x.shape[1]
    groups = [x[y == c] for c in (0, 1)]
    if not all(len(g) for g in groups):
        side = 6.0 if len(groups[1]) else -6.0
        return QualityModel(np.zeros((2, width)), np.zeros((2, width, width)), np.zeros(2), 0.0, side if len(x) else 0.0)
    pooled = sum(np.cov(g, rowvar=False, bias=True) * len(g) for g in groups) / len(x)
    means, inverse, constants = [], [], []
    for g, share in zip(groups, shares):
        own = np.cov(g, rowvar=False, bias=True) if len(g) > 1 else pooled
        covariance = (1 - shrinkage) * own + shrinkage * np.diag(np.diag(pooled)) + floor * np.eye(width)
        factor = np.linalg.cholesky(covariance)
        means.append(g.mean(axis=0))
        inverse.append(np.linalg.inv(factor))
        constants.append(math.log(share) - np.log(np.diag(factor)).sum())
    model = QualityModel(np.array(means), np.array(inverse), np.array(constants))
    weight = np.where(y == 1, shares[1] / (y == 1).mean(), shares[0] / (y == 0).mean())
    model.slope, model.shift = fit_logistic(squash(model.log_density_difference(x))[:, None], y.astype(float), weight, np.array([1.0, 0.0]))
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """Fit on the training folds; at most twice ``per_class`` rows of statistics come to the driver."""
    sample, sizes = labelled_sample(texts_of(docs), labels, "quality", FOLDS, HELD_OUT, per_class)

    def work(rows: dict[str, list]) -> dict[str, list]:
        return {"label": rows["label"], "x": [statistics(t or "") for t in rows["text"]]}

    figures = map_columns(sample.select("label", "text"), work, "label int, x array<double>").collect()
    total = max(1, sum(sizes.values()))
    x = np.array([r["x"] for r in figures]).reshape(-1, len(FEATURES))
    return fit_arrays(x, np.array([r["label"] for r in figures]), (sizes.get(0, 0) / total, sizes.get(1, 0) / total))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for each whole text; a null text counts as empty.

    Equal texts have equal scores; a score of just 0.5 is predicted 1.  Repeated rows give repeated rows, an
    empty table none; a null doc_id stays null and counts as 0 for the fold.  Very long texts are counted
    whole; further columns are not read.
    """

    def work(rows: dict[str, list]) -> dict[str, list]:
        x = np.array([statistics(t or "") for t in rows["text"]]).reshape(-1, len(FEATURES))
        return {"doc_id": rows["doc_id"], "score": model.scores(x).tolist()}

    scored = map_columns(texts_of(docs), work, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
