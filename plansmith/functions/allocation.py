"""Quotas: largest remainder, fixed and apportioned quotas, smooth weighted schedules, step counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def half_up_count(total: int, fraction: float) -> int:
    return math.floor(total * fraction + 0.5)


def largest_remainder(total: int, weights: dict[str, float], order: list[str] | None = None) -> dict[str, int]:
    """Whole shares that sum to the total; what flooring leaves goes to the largest fractions, ties by declared order."""
    order = list(weights) if order is None else order
    mass = sum(weights.get(k, 0) for k in order)
    if not order or mass <= 0:
        if total:
            raise ValueError("nothing to share by")
        return dict.fromkeys(order, 0)
    raw = {k: total * weights.get(k, 0) / mass for k in order}
    out = {k: math.floor(v) for k, v in raw.items()}
    for k in sorted(order, key=lambda k: (out[k] - raw[k], order.index(k)))[: total - sum(out.values())]:
        out[k] += 1
    return out


def apportion(weights: DataFrame, total: DataFrame | int, weight: str = "weight", order: str = "ord") -> DataFrame:
    """The same over a DataFrame of keys: adds ``share``. total: a number, or a one-row DataFrame with ``total``."""
    all_ = Window.partitionBy()
    w = weights.crossJoin(F.broadcast(total)) if isinstance(total, DataFrame) else weights.withColumn("total", F.lit(total))
    w = w.withColumn("_raw", F.col("total") * F.col(weight) / F.sum(weight).over(all_)).withColumn("_base", F.floor("_raw"))
    first = Window.orderBy(F.desc(F.col("_raw") - F.col("_base")), order)
    w = w.withColumn("_more", F.row_number().over(first) <= F.col("total") - F.sum("_base").over(all_))
    return w.withColumn("share", (F.col("_base") + F.col("_more").cast("long")).cast("long")).drop("_raw", "_base", "_more", "total")


def quotas(total: int, weights: dict[str, float], fixed: dict[str, int] | None = None, order: list[str] | None = None) -> dict[str, int]:
    """Fixed quotas as they are, the rest of the total apportioned over the other keys."""
    fixed, order = fixed or {}, list(weights) if order is None else order
    rest = [k for k in order if k not in fixed]
    left = total - sum(fixed[k] for k in order if k in fixed)
    if left < 0:
        raise ValueError("fixed quotas exceed the total")
    return {k: v for k in order for v in ([fixed[k]] if k in fixed else [largest_remainder(left, weights, rest)[k]])}


def smooth_schedule(budget: int, weights: dict[str, float], order: list[str] | None = None) -> list[tuple[int, str, int]]:
    """(step, key, how many of the key before): every prefix holds the keys nearly in proportion to their weights."""
    order = list(weights) if order is None else order
    share, mass = largest_remainder(budget, weights, order), sum(weights[k] for k in order)
    used, out = dict.fromkeys(order, 0), []
    for step in range(budget):
        open_ = [k for k in order if used[k] < share[k]]
        k = max(open_, key=lambda k: ((step + 1) * weights[k] / mass - used[k], -order.index(k)))
        out.append((step, k, used[k]))
        used[k] += 1
    return out


def optimizer_steps(rows: int, epochs: int, micro_batch: int, accumulation: int) -> int:
    return math.ceil(rows * epochs / (micro_batch * accumulation))


def checkpoint_steps(total: int, every: int, explicit: list[int] | None = None) -> list[int]:
    """Multiples of a cadence, explicit steps up to the total, and the total."""
    return sorted({*range(every, total + 1, every), *(s for s in explicit or [] if 0 < s <= total), total})
