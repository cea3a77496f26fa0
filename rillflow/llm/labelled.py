"""Bounded samples of labelled rows, and the regularised logistic fit that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of


def fold(doc_id, folds: int):
    """crc32 of the decimal doc_id modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id, F.lit(0)).cast("long").cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, label of at most ``per_class`` training rows of each class, and the class sizes.

    A class with more labelled ids gives those with the smallest hash of doc_id, and an id with several rows the one
    with the smallest text.  Rows of the held-out fold never take part.  The ids that are broadcast number at
    most twice ``per_class``, and so do the rows.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    sizes = {int(r["label"]): int(r["count"]) for r in known.groupBy("label").count().collect()}
    ranked = known.withColumn("rank", F.xxhash64("doc_id"))
    taken = [ranked.filter(F.col("label") == c).orderBy("rank", "doc_id").limit(per_class) for c in (0, 1)]
    ids = taken[0].unionByName(taken[1]).drop("rank")
    return texts_of(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), sizes


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray, strength: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton steps for logistic regression; the weights are drawn to ``prior`` (the bias, last, is free)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = prior.astype(float).copy()
    pull = np.full(len(w), strength)
    pull[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + pull * (w - prior)
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(hessian, gradient)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return w
