"""Smoothing of series: three-point low pass and Savitzky-Golay.

A series of more than ``most`` rows is smoothed in ranges of its order, each with copies of the few rows beside it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import MOST, OWN, PART, along, with_halo


def low_pass(df: DataFrame, series: str, value: str, order: list[str], alpha: float = 0.25, name: str = "smooth", most: int = MOST) -> DataFrame:
    """alpha * previous + (1 - 2 alpha) * value + alpha * next; a series' ends stay as they are."""
    w = along(series, order)
    mixed = alpha * F.lag(value).over(w) + (1 - 2 * alpha) * F.col(value) + alpha * F.lead(value).over(w)
    smooth = with_halo(df, series, order, 1, most).withColumn(name, F.coalesce(mixed, F.col(value)))
    return smooth.filter(OWN).drop(PART, OWN)


def savgol_weights(window: int, degree: int) -> list[float]:
    """The centre row of the least-squares fit of a polynomial over ``window`` equally spaced points."""
    if window % 2 != 1 or window < degree + 2:
        raise ValueError("the window must be odd and hold at least degree + 2 points")
    half = window // 2
    return np.linalg.pinv(np.vander(np.arange(-half, half + 1), degree + 1, increasing=True))[0].tolist()


def savgol(df: DataFrame, series: str, value: str, order: list[str], window: int = 19, degree: int = 2, name: str = "smooth", most: int = MOST) -> DataFrame:
    """Polynomial smoothing, clamped at 0; points nearer to an end than half a window are null."""
    half = window // 2
    w = along(series, order)
    terms = [c * (F.lag(value, -k).over(w) if k else F.col(value)) for k, c in zip(range(-half, half + 1), savgol_weights(window, degree))]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    smooth = with_halo(df, series, order, half, most).withColumn(name, F.when(total.isNotNull(), F.greatest(total, F.lit(0.0))))
    return smooth.filter(OWN).drop(PART, OWN)


def savgol_mirrored(df: DataFrame, series: str, value: str, order: list[str], window: int = 19, degree: int = 2, name: str = "smooth", most: int = MOST) -> DataFrame:
    """The same for every point: a series goes on beyond its ends as its mirror image, turned downwards before the
    first value and upwards after the last.  Series of half a window or less stay as they are.

    All that a point's mirror needs lies within half a window of it; so does a whole series of half a window or less.
    """
    half = window // 2
    w = along(series, order)
    near = F.collect_list(value).over(w.rowsBetween(-half, half))
    left, right = F.count(F.lit(1)).over(w.rowsBetween(-half, -1)), F.count(F.lit(1)).over(w.rowsBetween(1, half))
    framed = with_halo(df, series, order, half, most).withColumns({"__near": near, "__left": left, "__right": right})
    first, last = F.get("__near", F.lit(0)), F.get("__near", F.size("__near") - 1)
    before = F.transform(F.slice(F.reverse(F.slice("__near", 2, F.lit(half) - F.col("__left"))), 1, half), lambda v: first - F.abs(v - first))
    after = F.transform(F.slice(F.reverse("__near"), 2, F.lit(half) - F.col("__right")), lambda v: last + F.abs(v - last))
    weights = F.array(*(F.lit(c) for c in savgol_weights(window, degree)))
    products = F.zip_with(F.concat(before, "__near", after), weights, lambda v, c: v * c)
    total = F.aggregate(products, F.lit(0.0), lambda a, b: a + b)
    long = F.col("__left") + F.col("__right") + 1 > half
    smooth = framed.withColumn(name, F.when(long, F.greatest(total, F.lit(0.0))).otherwise(F.col(value)))
    return smooth.filter(OWN).drop("__near", "__left", "__right", PART, OWN)


__all__ = ["low_pass", "savgol", "savgol_mirrored", "savgol_weights"]
