"""Attempts at a candidate: seeds of retries, the first that holds, the fallback, and what is reported of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import realize

#: Fixed value: how far the seeds of one candidate's retries lie apart.
RETRY_STEP = 1_000_003


def retry_seed(seed: Column, attempt: Column) -> Column:
    return seed + attempt.cast("long") * F.lit(RETRY_STEP)


def accepted(parse: str = "parse_valid", phi: str = "phi_valid", facts: str = "factual_consistency") -> Column:
    return F.coalesce(F.col(parse) & F.col(phi) & F.col(facts), F.lit(False))


def resolve(tries: DataFrame, keys: list[str], order: str = "retry", candidate: str = "candidate") -> DataFrame:
    """tries(keys, the order's number of a try from 0, candidate and the flags and reject_reason of ``validate.verify``): one row a key.

    The first attempt that holds is taken; later ones count as not made. ``attempts`` is how many were made, ``reasons`` says in
    order why those before failed, ``fallback`` is true where none held; ``candidate`` then is null. A candidate's retries
    are few by configuration, so one row holds them."""
    one = F.struct(F.col(order).alias("at"), accepted().alias("ok"), F.coalesce("reject_reason", F.lit("verification_failed")).alias("why"), F.col(candidate).alias("made"))
    per = tries.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("_t"))
    first = F.get(F.filter("_t", lambda x: x["ok"]), 0)
    per = per.withColumn("_first", first)
    before = F.filter("_t", lambda x: F.col("_first").isNull() | (x["at"] < F.col("_first.at")))
    per = per.withColumn("reasons", F.transform(before, lambda x: x["why"]))
    return per.select(*keys, (F.size("reasons") + F.col("_first").isNotNull().cast("int")).alias("attempts"), "reasons", F.col("_first").isNull().alias("fallback"), F.col("_first.made").alias(candidate))


def with_fallback(resolved: DataFrame, plan: str = "reference_plan", candidate: str = "candidate") -> DataFrame:
    """Where no attempt held, the candidate is the reference plan with the template's text."""
    template = F.to_json(F.struct(F.col(plan).alias("plan"), realize.plan_text(F.col(plan)).alias("text")))
    return resolved.withColumn(candidate, F.coalesce(candidate, template))


def totals(resolved: DataFrame, domain: str = "domain") -> DataFrame:
    """Per domain: candidates, those of the fallback, attempts that were retries, and attempts that were rejected."""
    n = F.count(F.lit(1))
    return resolved.groupBy(domain).agg(
        n.alias("candidates"),
        F.count_if("fallback").alias("fallbacks"),
        F.sum(F.greatest(F.col("attempts") - 1, F.lit(0))).cast("long").alias("retries"),
        F.sum(F.size("reasons")).cast("long").alias("rejected"),
    )


def reasons(resolved: DataFrame, domain: str = "domain") -> DataFrame:
    """How often each domain's attempts failed for each reason."""
    return resolved.select(domain, F.explode("reasons").alias("reason")).groupBy(domain, "reason").agg(F.count(F.lit(1)).alias("n"))
