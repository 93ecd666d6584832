"""A discrete distribution over states: fitting, features, marginals, projection onto soft targets, sampling reports.

States are rows (state_id, source_id, domain, plan_key, p, p_base); features are rows (state_id, feature)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canon import clean
from .realize import entities, relations

ALPHA = 1e-8
FLOOR = 1e-8


def plan_key(plan: Column) -> Column:
    return F.sha2(F.to_json(plan), 256)


def state_key(source: Column, plan: Column) -> Column:
    return F.sha2(F.to_json(F.struct(plan.alias("plan"), source.alias("source_id"))), 256)


def fit(observed: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """observed(state_id, domain, ...): one row per state with n and p, smoothed in two levels: the domain's share, then the
    state's share within it. Further columns must depend on the state."""
    more = [c for c in observed.columns if c not in ("state_id", "domain")]
    n = observed.groupBy("state_id", "domain").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in more])
    per = n.groupBy("domain").agg(F.sum("n").alias("_nd"), F.count(F.lit(1)).alias("_sd"))
    all_ = Window.partitionBy()
    per = per.withColumn("_pd", (F.col("_nd") + alpha) / F.sum(F.col("_nd") + alpha).over(all_))
    out = n.join(per, "domain").withColumn("p", F.col("_pd") * (F.col("n") + alpha) / (F.col("_nd") + alpha * F.col("_sd")))
    return out.withColumn("p_base", F.col("p")).drop("_nd", "_sd", "_pd")


def check(states: DataFrame, floor: float = FLOOR) -> None:
    """Probabilities are finite, sum to 1 and lie above the floor; shares within domains sum to 1."""
    r = states.agg(F.sum("p").alias("s"), F.min("p").alias("least"), F.count_if(F.isnan("p") | F.col("p").isNull()).alias("bad")).first()
    if r["s"] is None or r["bad"] or abs(r["s"] - 1) > 1e-9 or r["least"] < floor:
        raise ValueError(f"not a distribution: {r}")
    off = local_parameters(states).groupBy("domain").agg(F.sum("share").alias("s")).filter(F.abs(F.col("s") - 1) > 1e-9)
    if not off.isEmpty():
        raise ValueError("shares within a domain do not sum to 1")


def local_parameters(states: DataFrame) -> DataFrame:
    """state_id, domain, the domain's mass and the state's share of it."""
    mass = states.groupBy("domain").agg(F.sum("p").alias("mass"))
    return states.join(mass, "domain").select("state_id", "domain", "mass", (F.col("p") / F.col("mass")).alias("share"))


def basic_features(plan: Column, domain: Column) -> Column:
    """domain:…, attribute:domain:term and relation:domain:term."""
    made = lambda kind, terms: F.transform(terms, lambda t: F.concat_ws(":", F.lit(kind), domain, clean(t)))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("domain:"), domain)), made("attribute", entities(plan)), made("relation", relations(plan))))


def _capped(weights: DataFrame, family: str, limit: int) -> DataFrame:
    """Half of the limit the rarest, the rest the commonest; what both name counts once."""
    w = weights.filter(F.startswith("feature", F.lit(family)))
    rare = w.orderBy("weight", "feature").limit(limit // 2)
    common = w.orderBy(F.desc("weight"), "feature").limit(limit - limit // 2)
    return rare.unionByName(common).dropDuplicates(["feature"])


def rare_pairs(features: DataFrame, states: DataFrame, kept: DataFrame, quantile: float = 0.25, limit: int = 128) -> DataFrame:
    """Pairs of kept features active in one state whose weight lies at or under the quantile of all pair weights: the
    lightest ones, named rare_pair:["left","right"]. Only kept features are paired, so a state gives few pairs."""
    f = features.join(F.broadcast(kept.select("feature")), "feature")
    pairs = f.select("state_id", F.col("feature").alias("l")).join(f.select("state_id", F.col("feature").alias("r")), "state_id").filter("l < r")
    w = pairs.join(states.select("state_id", "p"), "state_id").groupBy("l", "r").agg(F.sum("p").alias("weight"))
    cut = w.agg(F.percentile("weight", F.lit(quantile)).alias("cut"))
    name = F.concat(F.lit("rare_pair:"), F.to_json(F.array("l", "r")))
    return w.crossJoin(F.broadcast(cut)).filter("weight > 0 AND weight <= cut").select("l", "r", name.alias("feature"), "weight").orderBy("weight", "l", "r").limit(limit)


def feature_space(features: DataFrame, states: DataFrame, limits: tuple[int, int, int] = (512, 256, 128), quantile: float = 0.25) -> DataFrame:
    """feature, family and feature_id (from 0): domains, attributes, relations, rare pairs, each in order."""
    weights = features.join(states.select("state_id", "p"), "state_id").groupBy("feature").agg(F.sum("p").alias("weight"))
    atoms = _capped(weights, "attribute:", limits[0]).unionByName(_capped(weights, "relation:", limits[1]))
    pairs = rare_pairs(features, states, atoms, quantile, limits[2])
    all_ = weights.filter(F.startswith("feature", F.lit("domain:"))).select("feature").unionByName(atoms.select("feature")).unionByName(pairs.select("feature"))
    family = F.substring_index("feature", ":", 1)
    rank = F.when(family == "domain", 0).when(family == "attribute", 1).when(family == "relation", 2).otherwise(3)
    return all_.select("feature", family.alias("family"), (F.row_number().over(Window.orderBy(rank, "feature")) - 1).alias("feature_id"))


def local(space: DataFrame) -> DataFrame:
    """A feature space as a table of its own, computed once: its limits bound it."""
    return space.sparkSession.createDataFrame(space.collect(), space.schema)


def with_pairs(features: DataFrame, space: DataFrame) -> DataFrame:
    """Features (state_id, feature) restricted to the space, its pairs among them."""
    kept = features.join(F.broadcast(space.select("feature")), "feature")
    pairs = space.filter("family = 'rare_pair'").select("feature", F.from_json(F.substring("feature", 11, 1 << 20), "array<string>").alias("lr"))
    left = kept.select("state_id", F.col("feature").alias("l"))
    right = kept.select(F.col("state_id").alias("_s"), F.col("feature").alias("r"))
    p = pairs.select("feature", F.get("lr", 0).alias("l"), F.get("lr", 1).alias("r"))
    got = left.join(F.broadcast(p), "l").join(right, (F.col("state_id") == F.col("_s")) & (p["r"] == right["r"])).select("state_id", "feature")
    return kept.select("state_id", "feature").unionByName(got).distinct()


def marginals(states: DataFrame, features: DataFrame, weight: str = "p") -> DataFrame:
    """feature and its probability."""
    return features.join(states.select("state_id", weight), "state_id").groupBy("feature").agg(F.sum(weight).alias("marginal"))


def plan_probabilities(states: DataFrame) -> DataFrame:
    """Of each plan, whatever its state: plan_key and the probability of all its states."""
    return states.groupBy("plan_key").agg(F.sum("p").alias("p"))


def probability(states: DataFrame, key: str) -> float:
    return states.filter(F.col("plan_key") == key).agg(F.coalesce(F.sum("p"), F.lit(0.0))).first()[0]


def conditional_marginals(states: DataFrame, features: DataFrame, selector: Column) -> DataFrame:
    """Marginals given the selected states; empty where these have no mass."""
    s = states.filter(selector)
    return marginals(s.crossJoin(F.broadcast(s.agg(F.sum("p").alias("_m")))).withColumn("p", F.col("p") / F.col("_m")), features)


def targets(marginals_: DataFrame, overrides: dict[str, float] | None = None, limit: int = 32) -> DataFrame:
    """feature, base and target: given ones, else the lightest rare pairs raised by a quarter, by at most 0.02."""
    if overrides:
        spark = marginals_.sparkSession
        o = spark.createDataFrame(sorted(overrides.items()), "feature string, target double")
        return marginals_.join(F.broadcast(o), "feature").select("feature", F.col("marginal").alias("base"), "target")
    b = F.col("marginal")
    raised = F.least(b * 1.25, b + 0.02, F.lit(1 - 1e-8))
    return marginals_.filter(F.startswith("feature", F.lit("rare_pair:")) & (b > 0)).select("feature", b.alias("base"), raised.alias("target")).orderBy("base", "feature").limit(limit)


@dataclass
class Projection:
    states: DataFrame
    multipliers: dict[str, float]
    iterations: int
    violation: float
    divergence: float


PATTERNS = 100_000


def _sums(has, mass, m: int, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Of patterns with masses: the greatest exponent, and the sums of exp, f·exp and ff'·exp relative to it."""
    f = np.zeros((len(has), m))
    for i, x in enumerate(has):
        f[i, list(x)] = 1
    z = np.log(np.asarray(mass, float)) + f @ w
    top = z.max()
    e = np.exp(z - top)
    return top, e.sum(), f.T @ e, (f * e[:, None]).T @ f


def _moments(patterns: DataFrame, m: int):
    """A function of w: log Z, mean and covariance of the features under the tilted distribution."""
    few = patterns.limit(PATTERNS + 1).collect()
    if len(few) <= PATTERNS:
        part = lambda w: [_sums([r["_has"] for r in few], [r["p"] for r in few], m, w)]
    else:
        held = patterns.persist()

        def part(w):
            def run(batches):
                for b in batches:
                    if len(b):
                        top, *sums = _sums(b.column("_has").to_pylist(), b.column("p").to_numpy(), m, w)
                        yield pa.RecordBatch.from_arrays([pa.array([top]), *(pa.array([np.asarray(x, float).tobytes()], pa.binary()) for x in sums)], names=["top", "e", "f", "ff"])

            got = held.mapInArrow(run, "top double, e binary, f binary, ff binary").collect()
            return [(r[0], np.frombuffer(r[1])[0], np.frombuffer(r[2]), np.frombuffer(r[3]).reshape(m, m)) for r in got]

    def moments(w):
        parts = part(w)
        top = max(p[0] for p in parts)
        scale = [np.exp(p[0] - top) for p in parts]
        e, f, ff = (sum(k * p[i] for k, p in zip(scale, parts, strict=True)) for i in (1, 2, 3))
        return top + np.log(e), f / e, ff / e - np.outer(f / e, f / e)

    return moments


def _newton(moments, t: np.ndarray, tolerance: float) -> tuple[float, np.ndarray, np.ndarray, int]:
    w, steps = np.zeros(len(t)), 0
    log_z, mean, cov = moments(w)
    for steps in range(1, 1001):
        grad = mean - t
        if np.abs(grad).max() <= tolerance * 1e-3:
            break
        d = np.linalg.solve(cov + 1e-10 * np.eye(len(t)), -grad)
        size = 1.0
        while True:
            got = moments(w + size * d)
            if got[0] - (w + size * d) @ t <= log_z - w @ t + 1e-4 * size * (grad @ d) or size < 1e-8:
                break
            size /= 2
        if size < 1e-8:
            break
        w = w + size * d
        log_z, mean, cov = got
    return float(log_z), mean, w, steps


def project(states: DataFrame, features: DataFrame, goal: DataFrame, tolerance: float = 1e-6, limit: int = 64) -> Projection:
    """The distribution nearest to p in Kullback-Leibler divergence whose targeted marginals are met: p·exp(F·w)/Z.

    States matter only by which of the targeted features (at most ``limit``) they have: their masses are summed by that pattern.
    The driver solves for w by damped Newton steps; each needs the moments of the tilted patterns, which come from one array
    where patterns are few and from sums by partition where they aren't."""
    wanted = goal.orderBy("feature").limit(limit + 1).collect()
    if len(wanted) > limit:
        raise ValueError("too many targets")
    names = [r["feature"] for r in wanted]
    if not names:
        return Projection(states, {}, 0, 0.0, 0.0)
    t = np.array([r["target"] for r in wanted])
    index = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    has = features.filter(F.col("feature").isin(names)).groupBy("state_id").agg(F.array_sort(F.collect_set(index[F.col("feature")])).alias("_has"))
    known = states.join(has, "state_id", "left").withColumn("_has", F.coalesce("_has", F.array().cast("array<int>")))
    patterns = known.filter("p > 0").groupBy("_has").agg(F.sum("p").alias("p"))
    log_z, mean, w, steps = _newton(_moments(patterns, len(names)), t, tolerance)
    violation = float(np.abs(mean - t).max())
    if violation > tolerance:
        raise ValueError(f"targets can't be met: off by {violation}")
    tilt = F.lit(0.0)
    for i, x in enumerate(w.tolist()):
        tilt = tilt + F.when(F.array_contains("_has", i), F.lit(x)).otherwise(F.lit(0.0))
    out = known.withColumn("p", F.col("p") * F.exp(tilt - F.lit(log_z))).drop("_has")
    return Projection(out, dict(zip(names, w.tolist(), strict=True)), steps, violation, float(mean @ w - log_z))


def sampling_report(drawn: DataFrame, states: DataFrame, features: DataFrame) -> DataFrame:
    """One row: count, duplicate_rate (by plan), marginal_rmse and rare_coverage of a draw of states."""
    n = drawn.agg(F.count(F.lit(1)).alias("count"), (1 - F.count_distinct("plan_key") / F.count(F.lit(1))).alias("duplicate_rate"))
    times = drawn.groupBy("state_id").agg(F.count(F.lit(1)).cast("double").alias("p"))
    seen = marginals(times, features).withColumnRenamed("marginal", "seen")
    both = marginals(states, features).join(seen, "feature", "left").crossJoin(F.broadcast(n)).withColumn("o", F.coalesce("seen", F.lit(0.0)) / F.col("count"))
    rare = F.startswith("feature", F.lit("rare_pair:"))
    m = both.agg(F.sqrt(F.avg(F.pow(F.col("o") - F.col("marginal"), 2))).alias("marginal_rmse"), F.coalesce(F.avg(F.when(rare, (F.col("o") > 0).cast("double"))), F.lit(1.0)).alias("rare_coverage"))
    return n.crossJoin(m)


def domain_shares(drawn: DataFrame) -> DataFrame:
    n = drawn.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return n.select("domain", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


#: What stands behind the distribution, for reports.
BACKEND = {"backend": "states as rows", "arithmetic": "float64", "can": ["fit", "marginals", "conditional marginals", "projection", "weighted draws"]}


def conformance(spark) -> dict[str, bool]:
    """The distribution's operators on three states with one feature, whose results are known; anything else is an error."""
    states = spark.createDataFrame([("a", "d", 0.2), ("b", "d", 0.3), ("c", "d", 0.5)], "state_id string, domain string, p double")
    features = spark.createDataFrame([("b", "f"), ("c", "f")], "state_id string, feature string")
    goal = spark.createDataFrame([("f", 0.8, 0.9)], "feature string, base double, target double")
    tilted = {r["state_id"]: r["p"] for r in project(states, features, goal).states.select("state_id", "p").collect()}
    check(states)
    report = {
        "marginals": abs(marginals(states, features).first()["marginal"] - 0.8) <= 1e-12,
        "projection": all(abs(tilted[k] - v) <= 1e-6 for k, v in {"a": 0.1, "b": 0.3375, "c": 0.5625}.items()),
        "normalised": abs(sum(tilted.values()) - 1) <= 1e-9,
    }
    if not all(report.values()):
        raise RuntimeError(f"the distribution's operators do not conform: {report}")
    return report
