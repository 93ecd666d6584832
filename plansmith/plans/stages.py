"""The staged pipeline: records, silver, fit, project, plans, student split, outputs, metrics. Stages speak through Parquet
tables under the root and are skipped where their manifest still holds.

Models are plug-ins: a Realizer maps plans to texts; the template is the default. Without a model, unconstrained variants
give the template's text with a seeded share of sentences lost, constrained ones a seeded choice of a realisation."""

from __future__ import annotations

import argparse
import json
from functools import reduce
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import allocation as A
from ..functions import canon as C
from ..operators import attempts, circuit, evaluate, realize, records, sampling, validate
from ..sources import readers, sinks
from . import config as cfg
from . import preflight
from .manifest import STAGES, UPSTREAM, ManifestStore, code_hash


class Realizer(Protocol):
    def __call__(self, plan: Column, seed: Column) -> Column: ...


def template(plan: Column, seed: Column) -> Column:
    return realize.plan_text(plan)


def loose(plan: Column, seed: Column) -> Column:
    """A stand-in for unconstrained decoding: one time in four the text loses its first sentence or clause."""
    text = realize.plan_text(plan)
    return F.when(F.pmod(seed, F.lit(4)) == 0, F.regexp_replace(text, r"^.*?(\. |; )", "")).otherwise(text)


def constrained(plan: Column, seed: Column) -> Column:
    r = realize.realizations(plan)
    return F.element_at(r, (F.pmod(seed, F.size(r)) + 1).cast("int"))


class Pipeline:
    def __init__(self, spark: SparkSession, config: dict, teacher: Realizer = template, realizer: Realizer = loose):
        self.spark, self.config, self.teacher, self.realizer = spark, config, teacher, realizer
        self.root = config["runtime"]["root"]
        self.code = {s: code_hash([getattr(Pipeline, s), circuit.fit, records.normalize, validate.errors, realize.facts, sampling.stratified_sample, evaluate.quality, C.clean, A.apportion]) for s in STAGES}
        self.store = ManifestStore(self.root, config, self.code)
        self.files = self.store.files
        self.log = sinks.EventLog(f"{self.root}/events", self.files)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    # stages: each returns the names of its tables

    def records(self) -> list[str]:
        c, seed = self.config, self.config["seed"]
        parts = []
        for name, spec in c["datasets"].items():
            r = readers.read_family(self.spark, name, spec, seed)
            keys = c["sample"]["stratify_by"].get(name, [])
            kind = F.regexp_replace("domain", "^zebra_", "") if name == "zebralogic" else F.col("official_split")
            r = sampling.whitelisted(r.withColumn("_kind", kind), "_kind", c["sample"]["splits"].get(name)).drop("_kind")
            for split in [x[0] for x in r.select("official_split").distinct().orderBy("official_split").collect()]:
                s = r.filter(F.col("official_split") == split)
                population = c["sample"]["population"].get(name, {}).get(split)
                if population is not None:
                    s = sampling.stratified_sample(s, "source_id", keys, int(population), seed)
                parts.append(sampling.stratified_sample(s, "source_id", keys, float(c["sample"]["fraction"]), seed + 1).select(*r.columns))
        out = self.write(reduce(DataFrame.unionByName, parts) if parts else readers.empty_records(self.spark), "records")
        leaked = out.groupBy("record_sha256").agg(F.count_distinct("official_split").alias("n")).filter("n > 1").count()
        if leaked:
            raise ValueError(f"{leaked} records lie in several splits")
        n = F.count(F.lit(1))
        manifest = out.groupBy("dataset", "official_split").agg(n.alias("selected"), (n - F.count_distinct("record_sha256")).alias("duplicates"), C.fingerprint(F.col("record_sha256")).alias("fingerprint"))
        self.write(manifest.withColumn("leakage", F.lit(leaked)), "record_manifest")
        self.write(records.infer_schema(out), "schemas")
        return ["records", "record_manifest", "schemas"]

    def silver(self) -> list[str]:
        c = self.config["silver"]
        r, schemas = readers.load_prepared(self.spark, self.root)
        train = r.filter(F.col("official_split").isin("train", "research_train"))
        sizes = {x["domain"]: x["count"] for x in train.groupBy("domain").count().orderBy("domain").collect()}
        total = c["total"] or A.half_up_count(sum(sizes.values()), c["fraction"])
        quotas = A.quotas(total, sizes, c["quotas"])
        room = {k: n * c["max_candidates"] for k, n in sizes.items()}
        short = {k: q for k, q in quotas.items() if q > room.get(k, 0)}
        if short:
            raise ValueError(f"quotas beyond what the sources can give: {short}")
        tries = train.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(c["max_candidates"] - 1))))
        seed = self.config["seed"] + C.hash_seed(F.concat_ws("|", "source_id", F.col("attempt").cast("string")))
        tries = tries.withColumn("candidate_seed", seed).withColumn("sample_id", F.substring(C.sha256(F.concat_ws("|", "source_id", F.col("candidate_seed").cast("string"))), 1, 24))
        retried = tries.withColumn("retry", F.explode(F.sequence(F.lit(0), F.lit(c["retries"] - 1))))
        said = self.teacher(F.col("reference_plan"), attempts.retry_seed(F.col("candidate_seed"), F.col("retry")))
        made = retried.withColumn("candidate", F.to_json(F.struct(F.col("reference_plan").alias("plan"), said.alias("text"))))
        checked = validate.verify(made.select("source_id", "attempt", "retry", "candidate"), schemas, True, ("attempt", "retry", "candidate"))
        resolved = self.write(attempts.resolve(checked, ["source_id", "attempt"]), "silver_tries")
        # what the template stands in for is verified like any other
        filled = attempts.with_fallback(tries.join(resolved, ["source_id", "attempt"]))
        flags = validate.verify(filled.select("source_id", "attempt", "candidate"), schemas, True, ("attempt",)).drop("plan")
        every = filled.drop("candidate").join(flags, ["source_id", "attempt"]).withColumnRenamed("reference_plan", "plan")
        every = self.write(every.withColumn("accepted", attempts.accepted()), "silver_attempts")
        # a source's first attempts come first, so that quotas spread over sources
        got = sampling.capped_accept(every.withColumn("_h", C.stable_rank(self.config["seed"], "silver", F.col("sample_id"))), "domain", {k: v for k, v in quotas.items() if v}, ["attempt", "_h"]).drop("_h")
        got = self.write(got, "silver")
        self.log.log("progress", stage="silver", attempts=every.count(), accepted=got.count())
        report = every.groupBy("domain").agg(F.count_if("accepted").alias("acceptable"), F.count_if(~F.col("accepted")).alias("rejected"))
        report = report.join(attempts.totals(got).select("domain", F.col("candidates").alias("accepted"), "fallbacks", "retries"), "domain", "left")
        self.write(report, "quota_report")
        self.write(attempts.reasons(every), "attempt_reasons")
        return ["silver_tries", "silver_attempts", "silver", "quota_report", "attempt_reasons"]

    def fit(self) -> list[str]:
        c, f = self.config["fit"], self.config["features"]
        s = self.table("silver")
        obs = s.select(circuit.state_key(F.col("source_id"), F.col("plan")).alias("state_id"), "domain", "source_id", "dataset", circuit.plan_key(F.col("plan")).alias("plan_key"), "plan")
        if obs.isEmpty():
            raise ValueError("nothing to fit")
        states = self.write(circuit.fit(obs, c["alpha"]), "states")
        if states.count() > c["max_states"]:
            raise ValueError("more states than fit.max_states")
        circuit.check(states, c["floor"])
        basic = self.write(states.select("state_id", F.explode(circuit.basic_features(F.col("plan"), F.col("domain"))).alias("feature")), "basic_features")
        space = self.write(circuit.feature_space(basic, states, (f["attributes"], f["relations"], f["rare_pairs"]), f["quantile"]), "feature_space")
        self.write(circuit.with_pairs(basic, space), "state_features")
        return ["states", "basic_features", "feature_space", "state_features"]

    def project(self) -> list[str]:
        c = self.config["project"]
        states, features = self.table("states"), self.table("state_features")
        goal = circuit.targets(circuit.marginals(states, features), c["targets"], c["limit"])
        p = circuit.project(states, features, goal, c["tolerance"])
        self.write(p.states, "projected")
        outside = self.table("projected").select("source_id", "plan", "domain").join(self.table("schemas").select("source_id", "schema_id", "constraints"), "source_id").filter(F.size(validate.errors()) > 0).count()
        sinks.write_json(f"{self.root}/projection.json", {"iterations": p.iterations, "violation": p.violation, "kl": p.divergence, "multipliers": p.multipliers, "invalid_states": outside}, self.files)
        return ["projected"]

    def plans(self) -> list[str]:
        states, features = self.table("projected"), self.table("state_features")
        u = sampling.numpy_uniforms(self.spark, self.config["plans"]["count"], self.config["seed"] + 5000)
        drawn = sampling.weighted_draw(states.select("state_id", "source_id", "domain", "plan_key", "plan", "p"), u, "state_id")
        drawn = self.write(drawn.withColumn("plan_id", F.concat(F.lit("plan-"), F.lpad(F.col("draw").cast("string"), 6, "0"))), "sampled_plans")
        bad = drawn.join(self.table("schemas").select("source_id", "schema_id", "constraints"), "source_id", "left").filter("constraints IS NULL").count()
        if bad:
            raise ValueError(f"{bad} sampled plans have no schema")
        self.write(circuit.sampling_report(drawn, states, features), "sampling_report")
        self.write(circuit.domain_shares(drawn), "sampled_domains")
        return ["sampled_plans", "sampling_report", "sampled_domains"]

    def student(self) -> list[str]:
        c = self.config["student"]
        s = self.table("silver").withColumn("cardinality", realize.cardinality(F.col("plan")))
        n = s.count()
        held = A.half_up_count(n, c["validation"])
        split = sampling.exact_group_split(s, "source_id", ["domain", "cardinality"], held)
        rows = split.select("sample_id", "source_id", "domain", "split", realize.training_example(F.col("plan"), realize.plan_text(F.col("plan"))).alias("example"))
        self.write(sampling.shuffled(rows, "sample_id", self.config["seed"] + 6000), "student_rows")
        both = split.groupBy("source_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count()
        if both:
            raise ValueError("a source lies on both sides of the split")
        steps = A.optimizer_steps(n - held, c["epochs"], c["micro_batch"], c["accumulation"])
        sinks.write_json(f"{self.root}/student.json", {"train": n - held, "validation": held, "steps": steps, "checkpoints": A.checkpoint_steps(steps, c["every"], c["steps"])}, self.files)
        return ["student_rows"]

    def outputs(self) -> list[str]:
        seed, budgets = self.config["seed"], cfg.budgets(self.config)
        r, schemas = readers.load_prepared(self.spark, self.root)
        pool = r.filter(F.col("official_split").isin("test", "research_test"))
        sizes = {x["domain"]: float(x["count"]) for x in pool.groupBy("domain").count().orderBy("domain").collect()}
        weights = {k: float(self.config["evaluate"]["weights"].get(k, n)) for k, n in sizes.items()}
        most = max(budgets.values())
        held = sampling.scheduled(pool.select("source_id", "domain", F.col("reference_plan").alias("plan")), "source_id", "domain", weights, most)
        held = held.select(F.col("step").alias("generation_index"), "source_id", "domain", "plan")
        u = sampling.numpy_uniforms(self.spark, most, seed + 7000).withColumnRenamed("draw", "generation_index")
        asked = held.select("generation_index", "domain", F.col("source_id").alias("eval_source")).join(u, "generation_index")

        def draws(table: str) -> DataFrame:
            s = self.table(table).select("state_id", "source_id", "domain", "plan", "p")
            return sampling.weighted_draw(s, asked.select("generation_index", "domain", "u"), "state_id", "p", ["domain"]).select("generation_index", "source_id", "domain", "plan")

        sources = {"teacher_direct": held, "distill_only": held}
        base, tilted = draws("states"), draws("projected")
        sources |= {"psdd_only": base, "psdd_fsa": base, "psdd_pgd": tilted, "full_pipeline": tilted}
        parts = []
        for name, n in budgets.items():
            x = sources[name].filter(F.col("generation_index") < n).withColumn("variant", F.lit(name))
            s = F.col("generation_index") + F.lit(seed + 9000)
            bound = name in ("psdd_fsa", "full_pipeline")
            say = constrained if bound else self.teacher if name == "teacher_direct" else self.realizer
            x = x.withColumn("generation_seed", s).withColumn("text", say(F.col("plan"), C.hash_seed(F.col("generation_seed"))))
            words = F.concat(realize.tokens("text"), F.array(F.lit(realize.EOS)))
            parts.append(x.withColumns({"tokens": words, "fsa": realize.accepts(F.col("plan"), words) if bound else F.lit(None).cast("boolean")}))
        o = reduce(DataFrame.unionByName, parts)
        o = o.withColumn("eval_id", F.concat(F.lit("eval-"), F.lpad(F.col("generation_index").cast("string"), 6, "0")))
        o = o.withColumn("output_id", F.substring(C.sha256(F.concat_ws("|", "variant", "eval_id", F.col("generation_seed").cast("string"))), 1, 24))
        o = o.join(schemas.select("source_id", "schema_id", "constraints"), "source_id")
        o = o.withColumn("plan_valid", F.size(validate.errors()) == 0)
        o = o.withColumn("validation", realize.post_validation(F.col("plan"), F.col("text"), F.col("plan_valid"), F.col("fsa")))
        group = r.select("source_id", records.record_group(F.col("domain"), F.col("category"), F.col("source"), F.col("n_star")).alias("group"))
        o = o.join(group, "source_id", "left").withColumns({"dataset": records.dataset_name(F.col("domain")), "group": F.coalesce("group", "domain"), "token_log_probabilities": F.array().cast("array<double>"), "generation_ms": F.lit(0.0)})
        self.write(o.drop("constraints", "schema_id", "fsa"), "outputs")
        return ["outputs"]

    def metrics(self) -> list[str]:
        o = self.table("outputs")
        off = evaluate.aligned(o, cfg.budgets(self.config)).filter("NOT same").collect()
        if off:
            raise ValueError(f"variants without a budget, short of theirs, or unlike others of it in ids or seeds: {off}")
        states, features, space = self.table("projected"), self.table("state_features"), self.table("feature_space")
        vocabulary = states.select("domain", F.explode(F.transform(realize.facts(F.col("plan")), realize.canonical_fact)).alias("fact"))
        terms = states.select(F.explode(realize.plan_terms(F.col("plan"))).alias("term")).distinct()
        scored = o.withColumn("valid", validate.realized_valid()).join(evaluate.fact_scores(o, "output_id", vocabulary), "output_id").join(evaluate.term_precision(o, "output_id", terms), "output_id")
        scored = self.write(scored, "scored")
        self.write(evaluate.quality(scored), "quality")
        groups = self.table("records").select("source_id", records.record_group(F.col("domain"), F.col("category"), F.col("source"), F.col("n_star")).alias("group"))
        s = states.join(groups, "source_id", "left").withColumn("group", F.coalesce("group", "domain"))
        self.write(evaluate.divergence(scored, "output_id", space, evaluate.slice_targets(s, features)), "divergence")
        tables = evaluate.report_tables(self.table("quality"), self.table("divergence"), "full_pipeline")
        for name, t in tables.items():
            self.write(t, name)
        self.write(evaluate.variant_digests(o), "variant_digests")
        return ["scored", "quality", "divergence", *tables, "variant_digests"]

    def fingerprint(self, tables: list[str]) -> tuple[dict[str, int], dict[str, str]]:
        counts, prints = {}, {}
        for name in tables:
            t = self.table(name)
            n, h = t.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.to_json(F.struct(*t.columns))).cast("decimal(38,0)"))).first()
            counts[name], prints[name] = n, f"{n}:{h}"
        return counts, prints

    def fresh(self, stage: str) -> tuple[bool, str]:
        """Whether a stage is complete and its tables still are what it wrote."""
        ok, why = self.store.check(stage)
        if not ok:
            return ok, why
        try:
            _, prints = self.fingerprint(list(self.store.load(stage)["artifacts"]))
        except AnalysisException:
            return False, "artifacts are missing"
        return self.store.check(stage, prints)

    def run_stage(self, stage: str) -> None:
        for u in UPSTREAM[stage]:
            ok, why = self.fresh(u)
            if not ok:
                raise RuntimeError(f"{stage} needs {u}: {why}")
        self.store.save(stage, "in_progress")
        self.log.log("stage_start", stage=stage)
        try:
            tables = getattr(self, stage)()
            counts, prints = self.fingerprint(tables)
            self.store.save(stage, "complete", counts, prints)
            self.log.log("stage_complete", stage=stage, counts=counts)
        except BaseException as e:
            self.store.save(stage, "interrupted" if isinstance(e, KeyboardInterrupt) else "failed", error=str(e)[:500])
            self.log.log("stage_failed", stage=stage, error=str(e)[:500])
            raise

    def run(self, start: str = STAGES[0], stop: str = STAGES[-1]) -> None:
        for stage in STAGES[STAGES.index(start) : STAGES.index(stop) + 1]:
            if not self.fresh(stage)[0]:
                self.run_stage(stage)

    def status(self) -> dict[str, str]:
        return {s: self.fresh(s)[1] for s in STAGES}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plansmith", description="Run the staged pipeline")
    p.add_argument("command", choices=("run", "status", "preflight"))
    p.add_argument("--config")
    p.add_argument("--set", action="append", default=[], metavar="PATH=VALUE")
    p.add_argument("--start", default=STAGES[0], choices=STAGES)
    p.add_argument("--stop", default=STAGES[-1], choices=STAGES)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    config = cfg.load(a.config, a.set)
    spark = spark or SparkSession.builder.appName("plansmith").getOrCreate()
    if a.command == "preflight":
        print(json.dumps(preflight.report(spark, config)))
        return 0
    p = Pipeline(spark, config)
    if a.command == "status":
        print(json.dumps(p.status(), indent=2))
        return 0
    sinks.write_json(f"{p.root}/config.json", config, p.files)
    p.run(a.start, a.stop)
    return 0

