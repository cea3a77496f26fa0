"""Quality rules by robust multivariate outliers.  DataFrame functions only.

Each language and source gets a minimum-covariance-determinant estimate of transformed text statistics.
Three starts (quartiles; hyperbolic tangents; spatial signs, all around the medians) are each improved by
concentration steps: the ``KEPT_SHARE`` of the group's weight with the smallest distances gives the next
mean and covariance.  Steps go on until no determinant falls any more, and of a group's starts the one with
the smallest determinant is taken.  The covariance is regularised, as if ``PRIOR_ROWS`` further rows had the
language's quartile spreads, which decides for small groups; the mean of the winner is drawn in the same way
to the language's.  A row is rejected when its squared Mahalanobis distance exceeds ``CUTOFF``.

Quantiles come from counts of fixed bins, and a group's share ends with a part of its last bin's weight, so
any group, however hot, is combined before it moves and the result does not depend on the partitioning.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GROUP = ("lang", "source")
WIDTH = 4
KEPT_SHARE, PRIOR_ROWS = 0.75, 20
#: A step that lowers no log determinant by more than ``FALL`` is the last; there are ``STEPS`` at most.
FALL, STEPS = 1e-3, 30
#: Smallest standard deviations of the transformed statistics: a line that stands twice is no outlier.
FLOORS = (0.03, 0.04, 0.06, 0.05)
TAIL = 1e-6
BIN, DISTANCE_BINS = 0.004, 50
#: Groups whose estimates are broadcast at most; more are joined by Spark's skew join.
BROADCAST_GROUPS = 50_000


def chi2_cdf(x: float, k: int) -> float:
    """For an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


CUTOFF = chi2_quantile(1 - TAIL, WIDTH)
#: Makes the covariance of the kept share right for normal rows.
CONSISTENCY = KEPT_SHARE / chi2_cdf(chi2_quantile(KEPT_SHARE, WIDTH), WIDTH + 2)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each whole text; a null text has none.

    n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_capitals.
    Repeats are found by sorting a text's hashed five-word windows, so long texts stay cheap.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("-")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("-")).alias("source"),
        text.alias("text"),
        F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     ")).alias("flat"),
    )
    none = F.array().cast("array<string>")
    split = base.select(
        "doc_id",
        *GROUP,
        F.when(F.col("flat") == "", none).otherwise(F.split("flat", " +")).alias("words"),
        F.length(F.translate("flat", " ", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.translate("text", CAPITALS, ""))).cast("long").alias("n_capitals"),
        F.filter(F.split("text", "\n"), lambda line: F.trim(F.translate(line, "\t\x0b\x0c\r", "    ")) != "").alias("lines"),
    )
    window = lambda first, i: F.xxhash64(first, *(F.get("words", i + k) for k in range(1, 5)))
    hashed = split.select(
        "doc_id",
        *GROUP,
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 5, F.transform(F.slice("words", 1, F.size("words") - 4), window)).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    placed = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    paired = hashed.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed)).drop("windows")
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    repeated = F.filter("sorted", lambda s, i: same(s, F.when(i > 0, F.get("sorted", i - 1))) | same(s, F.get("sorted", i + 1)))
    starts = paired.withColumn("starts", F.array_sort(F.transform(repeated, lambda s: s["i"]))).drop("sorted")
    covered = F.transform("starts", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("starts", i + 1) - p, F.lit(5))))
    return starts.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")).drop("starts")


def transformed() -> list[Column]:
    """Log of the mean word length, roots of the shares of symbols and capitals, and the mean share of repeats."""
    share = lambda part, whole: F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(whole), F.lit(1))))
    return [
        F.log((F.col("word_chars") + 100) / (F.col("n_words") + 20)),
        share("n_symbols", "word_chars"),
        share("n_capitals", "word_chars"),
        F.least(F.lit(1.0), (F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)) + F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))) / 2),
    ]


def _add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


PAIRS = [(a, b) for a in range(WIDTH) for b in range(a + 1)]
AXES = range(WIDTH)
ESTIMATE = ("n", *(f"m{a}" for a in AXES), *(f"i{a}{b}" for a, b in PAIRS))


def _with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], small: bool) -> DataFrame:
    return rows.join(F.broadcast(groups) if small else groups, keys)


def _quartiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mid0.. and spread0.. (the quartile range as a standard deviation, at least the axis' floor) from counts of bins by axis."""
    by = [*keys, "axis"]
    up = W.partitionBy(*by).orderBy("bin")
    reached = counts.groupBy(*by, "bin").agg(F.sum("count").alias("count")).withColumn("__so_far", F.sum("count").over(up) / F.sum("count").over(W.partitionBy(*by)))
    at = lambda share: F.min(F.when(F.col("__so_far") >= share, F.col("bin"))) * BIN + BIN / 2
    found = reached.groupBy(*by).agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
    pick = lambda j, value: F.max(F.when(F.col("axis") == j, value))
    return found.groupBy(*keys).agg(*(pick(j, F.col("mid")).alias(f"mid{j}") for j in AXES), *(F.greatest(F.lit(FLOORS[j]), pick(j, (F.col("high") - F.col("low")) / 1.349)).alias(f"spread{j}") for j in AXES))


def _factored(found: DataFrame, spreads: DataFrame, consistency: float) -> DataFrame:
    """lang, source, start, logdet and ``ESTIMATE`` from rows with n, m.., c.. (plain covariances) and the languages' spreads.

    The covariance is regularised; i.. is its inverse Cholesky factor.
    """
    weight = F.col("n") / (F.col("n") + PRIOR_ROWS)
    own = found.join(spreads.select("lang", *(F.col(f"spread{a}").alias(f"t{a}") for a in AXES)), "lang")
    factor = own.select("*", *((weight * consistency * F.col(f"c{a}{b}") + ((1 - weight) * F.pow(f"t{a}", F.lit(2)) + FLOORS[a] ** 2 if a == b else F.lit(0.0))).alias(f"k{a}{b}") for a, b in PAIRS))
    for a, b in PAIRS:  # covariance to Cholesky factor, column names l..
        rest = F.col(f"k{a}{b}") - _add([F.lit(0.0), *(F.col(f"l{a}{k}") * F.col(f"l{b}{k}") for k in range(b))])
        factor = factor.withColumn(f"l{a}{b}", F.sqrt(rest) if a == b else rest / F.col(f"l{b}{b}"))
    for a in AXES:  # and its inverse, by rows
        factor = factor.withColumn(f"i{a}{a}", 1 / F.col(f"l{a}{a}"))
        for b in range(a):
            factor = factor.withColumn(f"i{a}{b}", -_add([F.col(f"l{a}{k}") * F.col(f"i{k}{b}") for k in range(b, a)]) / F.col(f"l{a}{a}"))
    return factor.select(*GROUP, "start", (2 * _add([F.log(f"l{a}{a}") for a in AXES])).alias("logdet"), *ESTIMATE)


def _starts(good: DataFrame, middles: DataFrame, spreads: DataFrame, small: bool) -> DataFrame:
    """Three estimates of each group around its medians, from its rows scaled by its quartile spreads."""
    z = [(F.col(f"x{a}") - F.col(f"mid{a}")) / F.col(f"spread{a}") for a in AXES]
    length = F.sqrt(_add([F.pow(v, F.lit(2)) for v in z]))
    scaled = _with_groups(good, middles, list(GROUP), small).select(*GROUP, *(F.tanh(v).alias(f"y{a}") for a, v in enumerate(z)), *(F.when(length > 0, v / length).otherwise(0.0).alias(f"u{a}") for a, v in enumerate(z)))
    sums = scaled.groupBy(*GROUP).agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.avg(f"y{a}").alias(f"y{a}") for a in AXES), *(F.avg(F.col(f"y{a}") * F.col(f"y{b}")).alias(f"y{a}{b}") for a, b in PAIRS), *(F.avg(F.col(f"u{a}") * F.col(f"u{b}")).alias(f"u{a}{b}") for a, b in PAIRS))
    known = sums.join(middles, list(GROUP))
    covariances = (
        lambda a, b: F.lit(1.0 if a == b else 0.0),
        lambda a, b: F.col(f"y{a}{b}") - F.col(f"y{a}") * F.col(f"y{b}"),
        lambda a, b: WIDTH * F.col(f"u{a}{b}"),
    )
    parts = [F.struct(F.lit(i).alias("start"), *((c(a, b) * F.col(f"spread{a}") * F.col(f"spread{b}")).alias(f"c{a}{b}") for a, b in PAIRS)) for i, c in enumerate(covariances)]
    rows = known.select(*GROUP, "n", *(F.col(f"mid{a}").alias(f"m{a}") for a in AXES), F.explode(F.array(*parts)).alias("s"))
    return _factored(rows.select(*GROUP, "n", *(f"m{a}" for a in AXES), "s.*"), spreads, 1.0)


def _distance() -> Column:
    """Squared Mahalanobis distance: the inverse Cholesky factor's rows times the centred vector."""
    return _add([F.pow(_add([F.col(f"i{a}{b}") * (F.col(f"x{b}") - F.col(f"m{b}")) for b in range(a + 1)]), F.lit(2)) for a in AXES])


def _concentrated(good: DataFrame, estimate: DataFrame, spreads: DataFrame, small: bool) -> DataFrame:
    """One concentration step of every group and start."""
    keys = [*GROUP, "start"]
    measured = _with_groups(good, estimate, list(GROUP), small).select(*keys, *(f"x{a}" for a in AXES), F.floor(F.log(_distance() + 1e-6) * DISTANCE_BINS).alias("bin"))
    counts = measured.groupBy(*keys, "bin").count()
    so_far, whole = W.partitionBy(*keys).orderBy("bin"), W.partitionBy(*keys)
    reached = counts.withColumn("__so_far", F.sum("count").over(so_far)).withColumn("__kept", KEPT_SHARE * F.sum("count").over(whole))
    last = reached.filter(F.col("__so_far") >= F.col("__kept")).groupBy(*keys).agg(F.min(F.struct("bin", "__so_far", "count", "__kept")).alias("l"))
    edge = last.select(*keys, F.col("l.bin").alias("last"), (1 - (F.col("l.__so_far") - F.col("l.__kept")) / F.col("l.count")).alias("part"))
    weighed = _with_groups(measured, edge, keys, small).filter("bin <= last").withColumn("w", F.when(F.col("bin") < F.col("last"), 1.0).otherwise(F.col("part")))
    sums = weighed.groupBy(*keys).agg(F.sum("w").alias("n"), *(F.sum(F.col("w") * F.col(f"x{a}")).alias(f"s{a}") for a in AXES), *(F.sum(F.col("w") * F.col(f"x{a}") * F.col(f"x{b}")).alias(f"p{a}{b}") for a, b in PAIRS))
    found = sums.select(*keys, "n", *((F.col(f"s{a}") / F.col("n")).alias(f"m{a}") for a in AXES), *((F.col(f"p{a}{b}") / F.col("n") - F.col(f"s{a}") / F.col("n") * F.col(f"s{b}") / F.col("n")).alias(f"c{a}{b}") for a, b in PAIRS))
    return _factored(found, spreads, CONSISTENCY)


def estimates(good: DataFrame) -> tuple[DataFrame, bool]:
    """lang, source, m.., i.. of each group of rows with x.., and whether the groups are few enough to broadcast."""
    counts = cut(good.select(*GROUP, F.posexplode(F.array(*(F.floor(F.col(f"x{a}") / BIN) for a in AXES))).alias("axis", "bin")).groupBy(*GROUP, "axis", "bin").count())
    middles, spreads = cut(_quartiles(counts, list(GROUP))), cut(_quartiles(counts, ["lang"]))
    small = middles.count() <= BROADCAST_GROUPS
    keys = [*GROUP, "start"]
    found = cut(_concentrated(good, cut(_starts(good, middles, spreads, small)), spreads, small))
    for _ in range(STEPS - 1):
        both = found.withColumn("__old", F.lit(True)).unionByName(_concentrated(good, found, spreads, small).withColumn("__old", F.lit(False)))
        lower = both.groupBy(*keys).agg(F.min(F.struct("logdet", *ESTIMATE)).alias("e"), F.max(F.when(F.col("__old"), F.col("logdet"))).alias("before"))
        lower = cut(lower.select(*keys, "e.*", (F.col("before") - F.col("e.logdet")).alias("fall")))
        found = lower.drop("fall")
        if (lower.agg(F.max("fall")).first()[0] or 0.0) <= FALL:
            break
    best = found.groupBy(*GROUP).agg(F.min(F.struct("logdet", "start", *ESTIMATE)).alias("e")).select(*GROUP, "e.*")
    lang, weight = W.partitionBy("lang"), F.col("n") + PRIOR_ROWS  # over groups, not rows
    drawn = ((F.col("n") * F.col(f"m{a}") + PRIOR_ROWS * F.sum(F.col("n") * F.col(f"m{a}")).over(lang) / F.sum("n").over(lang)) / weight for a in AXES)
    return cut(best.select(*GROUP, *(m.alias(f"m{a}") for a, m in enumerate(drawn)), *(f"i{a}{b}" for a, b in PAIRS))), small


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the four base counts, base_failed, distance (squared, null where base_failed) and kept.

    Null lang and source are groups of their own; null and empty texts fail the base rule; a null doc_id
    stays null.  Repeated rows are judged each.  A group of one row has its language's spread.  Very long
    texts are counted whole; further columns are not read.  An empty table gives none.
    """
    counted = cut(text_statistics(docs))  # texts are read once; what follows moves counts
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = counted.withColumn("base_failed", failed).select("*", *(x.alias(f"x{j}") for j, x in enumerate(transformed())))
    estimate, small = estimates(rows.filter(~F.col("base_failed")).select(*GROUP, *(f"x{a}" for a in AXES)))
    judged = rows.join(F.broadcast(estimate) if small else estimate, list(GROUP), "left")
    distance = F.when(~F.col("base_failed"), _distance())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"), (~F.col("base_failed") & (F.coalesce(_distance(), F.lit(0.0)) <= CUTOFF)).alias("kept"))
