"""Metrics over marginals and log-probabilities, as aggregates and as expressions per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-9
EPSILON = 1e-12


def coverage_error(observed: Column, target: Column) -> Column:
    """Root mean square difference of two marginal vectors."""
    return F.sqrt(F.avg(F.pow(observed - target, F.lit(2.0))))


def sanitised(value: Column, tolerance: float = TOLERANCE) -> Column:
    """A marginal clipped to [0, 1]; beyond the tolerance outside it is an error."""
    bad = value.isNull() | F.isnan(value) | (value < -tolerance) | (value > 1 + tolerance)
    return F.when(bad, F.raise_error(F.lit("marginal outside [0, 1]")).cast("double")).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def _term(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))


def js_term(p: Column, q: Column) -> Column:
    """A category's part of the Jensen-Shannon divergence (bits) of two normalised distributions."""
    m = (p + q) / 2
    return (_term(p, m) + _term(q, m)) / 2


def jensen_shannon(left: Column, right: Column, left_total: Column, right_total: Column) -> Column:
    """An aggregate over categories; totals are constant per group. Both empty: 0; one empty: 1."""
    parts = F.sum(js_term(F.try_divide(left, left_total), F.try_divide(right, right_total)))
    l, r = F.max(left_total), F.max(right_total)
    return F.when((l == 0) & (r == 0), F.lit(0.0)).when((l == 0) | (r == 0), F.lit(1.0)).otherwise(parts)


def bernoulli_js(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence (bits) of two yes/no distributions."""
    return js_term(p, q) + js_term(1 - p, 1 - q)


def bernoulli_kl(p: Column, q: Column, epsilon: float = EPSILON) -> Column:
    """Kullback-Leibler divergence (nats) of two yes/no distributions, clipped away from 0 and 1."""
    cut = lambda x: F.least(F.greatest(x, F.lit(epsilon)), F.lit(1 - epsilon))
    p, q = cut(p), cut(q)
    return p * F.ln(p / q) + (1 - p) * F.ln((1 - p) / (1 - q))


def bits_per_token(log_probability: Column) -> Column:
    """An aggregate over tokens; null over none."""
    return -F.avg(log_probability) / F.ln(F.lit(2.0))


def perplexity(log_probability: Column) -> Column:
    return F.exp(-F.avg(log_probability))


def rare_coverage(observed: Column) -> Column:
    """An aggregate: the share of rare features that occur; 1 if there are none."""
    return F.coalesce(F.avg((observed > 0).cast("double")), F.lit(1.0))


def rate(flag: Column) -> Column:
    """An aggregate: the share of rows for which a flag holds; 0 over none."""
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))
