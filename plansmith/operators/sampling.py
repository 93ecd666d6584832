"""Deterministic sampling, splitting and draws."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.allocation import apportion, half_up_count, largest_remainder, smooth_schedule
from ..functions.canon import bucket, bucket_counts, edges, json_string, numbered, ranked, stable_rank, uniform


def strata(keys: list[str]) -> F.Column:
    """The stratum as an array of JSON values; everything is one stratum without keys."""
    return F.array(*map(json_string, keys)) if keys else F.array(F.lit("all"))


def stratified_sample(df: DataFrame, id_col: str, keys: list[str], target: int | float, seed: int) -> DataFrame:
    """A proportional sample without replacement: largest-remainder shares of the strata, in each the rows of least stable
    hash. target: a count, or a fraction of the rows (half up). More than there are is an error."""
    d = df.withColumn("_stratum", strata(keys))
    hashed = d.withColumn("_hash", stable_rank(seed, F.to_json("_stratum"), id_col))
    # the counts that ranks are made of give the strata's sizes too: one pass over the rows counts, one takes
    sizes = bucket_counts(hashed, ["_stratum"], "_hash").groupBy("_stratum").agg(F.sum("_n").alias("weight"))
    n = F.sum("weight")
    total = F.floor(n * target + 0.5).cast("long") if isinstance(target, float) else F.when(n < target, F.raise_error(F.lit("sample larger than the population")).cast("long")).otherwise(F.lit(target).cast("long"))
    shares = apportion(sizes, sizes.agg(total.alias("total")), order="_stratum")
    order = ranked(hashed, ["_stratum"], "_hash", [id_col], "_rank")
    return order.join(shares.select("_stratum", "share"), "_stratum").filter("_rank <= share").drop("_stratum", "_hash", "_rank", "share")


def two_stage_sample(df: DataFrame, id_col: str, keys: list[str], population: int | float, target: int | float, seed: int) -> DataFrame:
    """First a population, then with the next seed the target out of it."""
    return stratified_sample(stratified_sample(df, id_col, keys, population, seed), id_col, keys, target, seed + 1)


def shuffled(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Adds ``position`` (from 0) in a seeded order."""
    return ranked(df.withColumn("_hash", stable_rank(seed, "shuffle", id_col)).withColumn("_all", F.lit(0)), ["_all"], "_hash", [id_col], "_rank").withColumn("position", F.col("_rank") - 1).drop("_hash", "_all", "_rank")


def group_split(df: DataFrame, group: str, fractions: dict[str, float], seed: int) -> DataFrame:
    """Adds ``split``: whole groups in hash order, each to the split furthest below its target (ties: declared order).

    Where all groups are single rows, targets don't rise and the tail is even, the split follows from the rank alone.
    Otherwise one task streams the groups' sizes in order; its memory doesn't grow with them."""
    if abs(sum(fractions.values()) - 1) > 1e-9:
        raise ValueError("fractions must sum to 1")
    names = list(fractions)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).cast("long").alias("_size")).withColumn("_hash", stable_rank(seed, "group", group))
    n, most = sizes.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.max("_size"), F.lit(0))).first()
    targets = [largest_remainder(n, fractions, names)[k] for k in names] if n else [0] * len(names)
    if most == 1 and targets[0] >= targets[1] and len(set(targets[1:])) == 1:
        r = ranked(sizes.withColumn("_all", F.lit(0)), ["_all"], "_hash", [group], "_rank")
        lead = targets[0] - targets[1]
        at = F.when(F.col("_rank") <= lead, F.lit(0)).otherwise(F.pmod(F.col("_rank") - lead - 1, F.lit(len(names))))
        dest = r.select(F.col(group).alias("_g"), F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int")).alias("split"))
    else:

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fill = [-t for t in targets]
            for b in batches:
                out = []
                for size in b.column("_size").to_pylist():
                    k = min(range(len(fill)), key=lambda i: (fill[i], i))
                    fill[k] += size
                    out.append(names[k])
                yield pa.RecordBatch.from_arrays([b.column("_g"), pa.array(out, pa.string())], names=["_g", "split"])

        kind = df.schema[group].dataType.simpleString()
        one = sizes.select(F.col(group).alias("_g"), "_size", "_hash").repartition(1).sortWithinPartitions("_hash", "_g").select("_g", "_size")
        dest = one.mapInArrow(deal, f"_g {kind}, split string")
    return df.join(dest, df[group].eqNullSafe(F.col("_g"))).drop("_g")


#: Totals up to this are solved exactly; of larger ones the largest items that leave at least this are taken first.
EXACT = 1 << 20


def _subset(items: list[int], target: int) -> set[int]:
    """Indices of items whose sizes sum to the target."""
    if target > EXACT:
        taken, left = set(), target
        for i in sorted(range(len(items)), key=lambda i: -items[i]):
            if left - items[i] >= EXACT // 2:
                taken.add(i)
                left -= items[i]
        rest = [i for i in range(len(items)) if i not in taken]
        return taken | {rest[i] for i in _solved([items[i] for i in rest], left)}
    return _solved(items, target)


def _solved(items: list[int], target: int) -> set[int]:
    come: dict[int, tuple[int, int]] = {0: (-1, 0)}
    for i, size in enumerate(items):
        for t in sorted(come, reverse=True):
            if t + size <= target and t + size not in come:
                come[t + size] = (i, t)
    best, picked = max(come), set()
    if best != target:
        raise ValueError("no set of groups has exactly the target's size")
    while best:
        i, best = come[best]
        picked.add(i)
    return picked


def exact_group_split(df: DataFrame, group: str, strata_cols: list[str], target: int, names: tuple[str, str] = ("train", "validation")) -> DataFrame:
    """Adds ``split`` with exactly ``target`` rows in the second one, groups kept whole. Groups of a size are interleaved
    over strata (a group's stratum is its least row's) and cut into runs of 1, 2, 4, ... groups; the driver sees only how
    many groups a size has and solves the subset sum over runs. Places are counted within buckets, so that the groups of one
    size aren't numbered in one task."""
    first = F.min(F.struct(*strata_cols)).alias("_stratum") if strata_cols else F.lit(0).alias("_stratum")
    g = df.groupBy(group).agg(F.count(F.lit(1)).cast("long").alias("_size"), first)
    # strata of a size are few: they are numbered, and a group's place follows from its turn and its stratum's number
    kinds = g.select("_size", "_stratum").distinct().withColumn("_at_stratum", F.row_number().over(Window.partitionBy("_size").orderBy("_stratum")))
    kinds = kinds.select(F.col("_size").alias("_n"), F.col("_stratum").alias("_of"), "_at_stratum")
    g = g.join(kinds, F.col("_size").eqNullSafe(F.col("_n")) & F.col("_stratum").eqNullSafe(F.col("_of"))).drop("_n", "_of")
    g = numbered(g, ["_size", "_at_stratum"], group, "_turn")
    g = g.withColumn("_place", F.col("_turn") * F.lit(1 << 31) + F.col("_at_stratum"))
    g = numbered(g, ["_size"], "_place", "_at")
    g = g.withColumn("_run", F.floor(F.log2(F.col("_at").cast("double")) + 1e-9).cast("int"))
    runs = g.groupBy("_size", "_run").agg((F.count(F.lit(1)) * F.first("_size")).alias("rows")).orderBy("_size", "_run").collect()
    picked = _subset([r["rows"] for r in runs], target)
    chosen = [(runs[i]["_size"], runs[i]["_run"]) for i in sorted(picked)]
    is_in = F.lit(False)
    for size, run in chosen:
        is_in = is_in | ((F.col("_size") == size) & (F.col("_run") == run))
    dest = g.select(F.col(group).alias("_g"), F.when(is_in, F.lit(names[1])).otherwise(F.lit(names[0])).alias("split"))
    return df.join(dest, df[group].eqNullSafe(F.col("_g"))).drop("_g")


def hash_uniforms(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """draw (from 0) and u, from digests: replayable in any engine."""
    return spark.range(count).select(F.col("id").alias("draw"), uniform(seed, "id").alias("u"))


def numpy_uniforms(spark: SparkSession, count: int, seed: int) -> DataFrame:
    """The same from NumPy's default generator, for draws equal to its weighted choice."""
    u = np.random.default_rng(seed).random(count)
    return spark.createDataFrame(list(enumerate(u.tolist())), "draw long, u double")


SLICES = 1024


def weighted_draw(states: DataFrame, draws: DataFrame, order: str, weight: str = "p", within: list[str] | None = None) -> DataFrame:
    """draws(draw, u, *within) with the state whose slice of the cumulative weights (of its ``within`` group) holds u.

    The range join is an equi-join on slices of [0, 1): a state is listed under each slice that its interval touches."""
    keys = within or []
    some = states.filter(F.col(weight) > 0)
    s = some.withColumn("_bucket", bucket(order, edges(some, order)))
    # cumulative weights: within buckets of the order, on top of what the buckets before hold
    of, at = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_b")
    sums = s.groupBy(*keys, F.col("_bucket").alias("_b")).agg(F.sum(weight).alias("_w"))
    sums = sums.withColumn("_stop", F.sum("_w").over(at)).withColumn("_total", F.sum("_w").over(of)).withColumn("_last", F.lead("_b").over(at).isNull())
    sums = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_b", F.lag("_stop", 1, 0).over(at).alias("_start"), "_stop", "_total", "_last")
    on = F.col("_bucket").eqNullSafe(F.col("_b"))
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    w = Window.partitionBy(*keys, "_bucket").orderBy(order)
    s = s.join(F.broadcast(sums) if not keys else sums, on)
    s = s.withColumn("_run", F.col("_start") + F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.when(F.lead("_run").over(w).isNotNull(), F.col("_run") / F.col("_total")).when(F.col("_last"), F.lit(1.0)).otherwise(F.col("_stop") / F.col("_total"))
    s = s.withColumn("_lo", F.coalesce(F.lag("_run").over(w), F.col("_start")) / F.col("_total")).withColumn("_hi", end).filter("_hi > _lo")
    s = s.drop("_bucket", "_b", "_start", "_stop", "_total", "_last", "_run", *[f"_k_{k}" for k in keys])
    s = s.withColumn("_slice", F.explode(F.sequence(F.floor(F.col("_lo") * SLICES), F.least(F.floor(F.col("_hi") * SLICES), F.lit(SLICES - 1)))))
    d = draws.withColumn("_slice", F.floor(F.col("u") * SLICES))
    return d.join(s, [*keys, "_slice"]).filter("u >= _lo AND u < _hi").drop("_slice", "_lo", "_hi")


def scheduled(pool: DataFrame, id_col: str, domain: str, weights: dict[str, float], budget: int) -> DataFrame:
    """An evaluation order of the budget's length: smooth weighted round robin over domains, in each the pool by id, again
    from its start where it runs out. Adds ``step``."""
    spark = pool.sparkSession
    sizes = pool.groupBy(domain).agg(F.count(F.lit(1)).cast("long").alias("_n"))
    steps = spark.createDataFrame(smooth_schedule(budget, weights), "step long, _domain string, _k long")
    lacking = [r[0] for r in steps.select("_domain").distinct().join(sizes, F.col("_domain") == F.col(domain), "left_anti").collect()]
    if lacking:
        raise ValueError(f"no pool for {lacking}")
    order = numbered(pool, [domain], id_col, "_r").withColumn("_r", F.col("_r") - 1)
    at = steps.join(sizes, F.col("_domain") == F.col(domain)).select("step", "_domain", F.pmod("_k", "_n").alias("_at"))
    return at.join(order, (F.col("_domain") == F.col(domain)) & (F.col("_at") == F.col("_r"))).drop("_domain", "_at", "_r")


def whitelisted(df: DataFrame, column: str, names: list[str] | None) -> DataFrame:
    """Rows whose value is one of the names; without names all rows."""
    return df if names is None else df.filter(F.col(column).isin(list(names)))


def rotation(attempts: DataFrame, source: str, order: str) -> DataFrame:
    """Adds ``attempt`` (from 0), a row's number within its source."""
    return attempts.withColumn("attempt", F.row_number().over(Window.partitionBy(source).orderBy(order)) - 1)


def capped_accept(candidates: DataFrame, domain: str, quotas: dict[str, int], order: list[str], accepted: str = "accepted") -> DataFrame:
    """Accepted candidates up to each domain's quota; fewer than a quota asks for is an error."""
    q = candidates.sparkSession.createDataFrame([(k, int(v)) for k, v in quotas.items()], f"{domain} string, _quota long")
    r = candidates.filter(accepted).withColumn("_r", F.row_number().over(Window.partitionBy(domain).orderBy(*order)))
    r = r.filter(F.col("_r") <= max(quotas.values(), default=0))  # a constant: rows beyond it go before the shuffle
    out = r.join(F.broadcast(q), domain).filter("_r <= _quota").drop("_r", "_quota")
    short = q.join(out.groupBy(domain).count(), domain, "left").filter("coalesce(count, 0) < _quota").collect()
    if short:
        raise ValueError(f"quotas not met: {[r[domain] for r in short]}")
    return out


__all__ = ["capped_accept", "exact_group_split", "group_split", "hash_uniforms", "numpy_uniforms", "rotation", "scheduled", "shuffled", "strata", "stratified_sample", "two_stage_sample", "weighted_draw", "whitelisted"]
