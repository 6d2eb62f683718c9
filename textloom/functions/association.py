"""Association and keyness measures as columns. Minus infinity stands for 'no measure'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = float("-inf")


def _log2(x: Column) -> Column:
    return F.log2(x)


def pmi(joint, left, right, total, vocabulary=0, smoothing: float = 0.0, exponent: float = 1.0, normalize: bool = False) -> Column:
    """Pointwise mutual information of a pair from its count and margins."""
    v = F.lit(vocabulary) if not isinstance(vocabulary, Column) else vocabulary
    f = joint + F.lit(smoothing)
    f1 = left + F.lit(smoothing) * v
    f2 = right + F.lit(smoothing) * v
    n = total + F.lit(smoothing) * v * v
    value = _log2(F.pow(f, F.lit(exponent)) * n / (f1 * f2))
    if normalize:
        scale = -_log2(f / n)
        value = F.when(scale == 0, value).otherwise(F.try_divide(value, scale))
    return F.when((f > 0) & (f1 > 0) & (f2 > 0) & (n > 0), value).otherwise(F.lit(NEVER))


def log_dice(joint, left, right, vocabulary=0, smoothing: float = 0.0) -> Column:
    v = F.lit(vocabulary) if not isinstance(vocabulary, Column) else vocabulary
    f = joint + F.lit(smoothing)
    f1 = left + F.lit(smoothing) * v
    f2 = right + F.lit(smoothing) * v
    return F.when((f > 0) & (f1 > 0) & (f2 > 0), F.lit(14.0) + _log2(2 * f / (f1 + f2))).otherwise(F.lit(NEVER))


def minimum_sensitivity(joint, reverse, left, right, vocabulary=0, smoothing: float = 0.0) -> Column:
    """Smaller of the two shares of the pair in its margins; none where a raw count is zero."""
    v = F.lit(vocabulary) if not isinstance(vocabulary, Column) else vocabulary
    one = F.try_divide(joint + F.lit(smoothing), left + F.lit(smoothing) * v)
    two = F.try_divide(reverse + F.lit(smoothing), right + F.lit(smoothing) * v)
    return F.when((joint > 0) & (reverse > 0), F.least(one, two)).otherwise(F.lit(NEVER))


def percent_difference(o11, o12, o21, o22) -> Column:
    """Difference of the relative frequencies in percent of the second; infinite where that is zero."""
    p1 = F.try_divide(o11, o11 + o21)
    p2 = F.try_divide(o12, o12 + o22)
    return F.when(p2 == 0, F.when(p1 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(100 * F.try_divide(p1 - p2, p2))


def log_likelihood(o11, o12, o21, o22) -> Column:
    """Two-term log-likelihood, negative where the term is rarer in the study corpus.

    A zero count has no logarithm: null.
    """
    n1, n2 = o11 + o21, o12 + o22
    both = o11 + o12
    e1, e2 = F.try_divide(n1 * both, n1 + n2), F.try_divide(n2 * both, n1 + n2)
    value = 2 * (o11 * F.ln(F.try_divide(o11, e1)) + o12 * F.ln(F.try_divide(o12, e2)))
    rarer = F.try_divide(o11, n1) < F.try_divide(o12, n2)
    return F.when((o11 > 0) & (o12 > 0), F.when(rarer, -value).otherwise(value))


def g_test(o11, o12, o21, o22) -> Column:
    """Four-cell G with the continuity correction of 2x2 tables, signed as log_likelihood."""
    n = o11 + o12 + o21 + o22
    rows, columns = (o11 + o12, o21 + o22), (o11 + o21, o12 + o22)
    value = F.lit(0.0)
    for k, o in enumerate((o11, o12, o21, o22)):
        e = F.try_divide(rows[k // 2] * columns[k % 2], n)
        step = F.least(F.lit(0.5), F.abs(o - e))
        near = o + F.signum(e - o) * step
        value = value + F.when(near > 0, near * F.ln(F.try_divide(near, e))).otherwise(0.0)
    rarer = F.try_divide(o11, columns[0]) < F.try_divide(o12, columns[1])
    return F.when(rarer, -2 * value).otherwise(2 * value)


def bayes_factor(o11, o12, o21, o22) -> Column:
    return log_likelihood(o11, o12, o21, o22) - F.ln(o11 + o12 + o21 + o22)


def odds_ratio(o11, o12, o21, o22) -> Column:
    below = o12 * o21
    return F.when(below == 0, F.lit(float("inf"))).otherwise(F.try_divide(o11 * o22, below))


KEYNESS = {
    "percent_difference": percent_difference,
    "log_likelihood": log_likelihood,
    "g_test": g_test,
    "bayes_factor": bayes_factor,
    "odds_ratio": odds_ratio,
}


def keyness_metric(metric):
    """The metric itself, or that of the name."""
    if callable(metric):
        return metric
    if metric not in KEYNESS:
        raise ValueError(f"unknown keyness metric {metric!r}; known are {sorted(KEYNESS)}")
    return KEYNESS[metric]
