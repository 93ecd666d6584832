"""What round one left out: raw forms, divergence of one-sided features, given budgets, buckets, and sums by partition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plansmith.functions import canon
from plansmith.operators import circuit, evaluate, grids, realize, records, salvage, sampling, validate
from plansmith.plans.model import empty_plan


def norm(spark, row, schema, family="webnlg"):
    return records.normalize(spark.createDataFrame([row], schema), family, F.lit("train")).first()


def test_triple_forms(spark):
    part = "struct<head:string,relation:string,tail:string>"
    r = norm(spark, ("1", [("A", "p", "B")], "City"), f"id string, tripleset array<{part}>, category string")
    t = r["reference_plan"]["triples"][0]
    assert tuple(t) == ("A", "p", "B", "City", "Entity") and (r["category"], r["triple_count"], r["schema_id"]) == ("City", 1, "webnlg:City")
    assert tuple(norm(spark, ("1", ["A", "p", "B", "C"]), "id string, input array<string>")["reference_plan"]["triples"][0])[:3] == ("A", "p", "B")
    assert len(norm(spark, ("1", [[["A", "p", "B"], ["C", "q", "D"]]]), "id string, triples array<array<array<string>>>")["reference_plan"]["triples"]) == 2
    r = norm(spark, ("1", ["x | a | 1", "x | b | 2", "y | a | 3"], ["first", "second"]), "id string, triples array<string>, target_sources array<string>", "dart")
    assert (r["source"], r["schema_cardinality"], r["triple_count"]) == ("first", 2, 3)
    import hashlib
    import json

    pairs = json.dumps(sorted([["x", "a"], ["x", "b"], ["y", "a"]]), separators=(",", ":"))
    assert r["schema_id"] == f"dart:first:1:{hashlib.sha256(pairs.encode()).hexdigest()[:12]}"
    two = spark.createDataFrame([("1", ["A | p | B"]), ("2", ["A | p | B"])], "id string, triples array<string>")
    assert records.normalize(two, "webnlg", F.lit("train")).select("record_sha256").distinct().count() == 2  # equal plans, other rows


def test_groups(spark):
    rows = [("webnlg", "c", None, None), ("dart", None, "s", None), ("zebra_hard", None, None, None), ("visfd", None, None, 4), ("webnlg", None, None, None)]
    d = spark.createDataFrame(rows, "domain string, category string, source string, n_star int")
    got = [r[0] for r in d.select(records.record_group(*[F.col(c) for c in ("domain", "category", "source", "n_star")])).collect()]
    assert got == ["c", "s", "Hard", "star_4", "unknown"]


def test_disjoint_errors_come_last(spark):
    t = "array(named_struct('subject', 'a', 'predicate', 'p', 'object', 'b', 'subject_type', 'X', 'object_type', 'Y'), named_struct('subject', '', 'predicate', CAST(NULL AS string), 'object', 'b', 'subject_type', 'Y', 'object_type', 'Y'))"
    d = spark.range(1).select(F.lit("webnlg").alias("domain"), F.lit("s").alias("schema_id"), F.expr(t).alias("t"))
    d = d.withColumn("reference_plan", F.expr(empty_plan(domain="domain", triples="t"))).withColumn("plan", F.col("reference_plan"))
    c = records.constraints("webnlg").withField("disjoint_types", F.array(F.array(F.lit("X"), F.lit("Y")))).withField("allowed_predicates", F.array(F.lit("p"))).withField("domain_range", F.lit(None).cast("map<string,array<string>>")).withField("allowed_triples", F.lit(None).cast("array<struct<subject:string,predicate:string,object:string,subject_type:string,object_type:string>>"))
    got = [e["code"] for e in d.withColumn("constraints", c).select(validate.errors()).first()[0]]
    assert got == ["required", "relation", "disjoint"]


def test_divergence_counts_what_one_side_holds(spark):
    t = "array<struct<subject:string,predicate:string,object:string,subject_type:string,object_type:string>>"
    rows = [("o1", "full", "d", "webnlg", "g", "A says B", [("A", "says", "B", None, None)]), ("o2", "full", "d", "webnlg", "h", "C says B", [("C", "says", "B", None, None)])]
    o = spark.createDataFrame(rows, f"output_id string, variant string, dataset string, domain string, group string, text string, t {t}").withColumn("plan", F.expr(empty_plan(domain="domain", triples="t")))
    space = spark.createDataFrame([(f"attribute:webnlg:{x}", "attribute") for x in "ABCD"] + [("attribute:dart:A", "attribute")], "feature string, family string")
    targets = spark.createDataFrame([("domain", "webnlg", "attribute:webnlg:B", 1.0, 1.0), ("domain", "webnlg", "attribute:webnlg:D", 0.5, 1.0), ("group", "g", "attribute:webnlg:A", 1.0, 0.5)], "level string, slice string, feature string, target double, mass double")
    got = {(r["level"], r["slice"]): r for r in evaluate.divergence(o, "output_id", space, targets).collect()}

    def kl(p, q):
        p, q = (min(1 - 1e-12, max(1e-12, x)) for x in (p, q))
        return p * math.log(p / q) + (1 - p) * math.log((1 - p) / (1 - q))

    # A and C are held by the outputs alone, D by the target alone; dart's feature is of no domain of the slice
    assert got["all", "all"]["kl"] == pytest.approx(np.mean([kl(0.5, 0), kl(1, 1), kl(0.5, 0), kl(0, 0.5)]), rel=1e-3)
    assert got["group", "g"]["kl"] == pytest.approx(np.mean([kl(1, 1), kl(1, 0)]), rel=1e-3)  # its own target
    assert got["group", "h"]["kl"] == pytest.approx(np.mean([kl(1, 1), kl(1, 0), kl(0, 0.5)]), rel=1e-3)  # the domain's
    assert got["all", "all"]["rare_coverage"] == 1.0 and got["all", "all"]["all_feature_error"] == pytest.approx(0.5 * math.sqrt(3 / 4), abs=1e-9)
    tables = evaluate.report_tables(spark.createDataFrame([("full", "all", "all", 2, 1.0, 0.0, 1.0, 3.0), ("full", "group", "g", 1, 0.5, 0.5, 1.0, 3.0)], "variant string, level string, slice string, outputs long, schema_validity double, violation_rate double, fact_precision double, mean_ms double"), evaluate.divergence(o, "output_id", space, targets), "full")
    assert [r["schema_validity_percent"] for r in tables["report_groups"].collect()] == [50.0] and tables["report_variants"].first()["mean_ms"] == 3.0


def test_buckets(spark):
    rng = np.random.default_rng(1)
    d = spark.createDataFrame([(f"{x:09d}", int(x) % 3) for x in rng.permutation(100_000)[:3000].tolist()], "k string, g int")
    at = canon.edges(d, "k", 32)
    assert 20 <= len(at) <= 32 and at == sorted(at)
    got = canon.numbered(d, ["g"], "k").toPandas().sort_values(["g", "k"])
    assert all(list(x["rank"]) == list(range(1, len(x) + 1)) for _, x in got.groupby("g"))
    w = spark.createDataFrame([(f"{i:05d}", float(p)) for i, p in enumerate(rng.dirichlet(np.ones(2000)))], "state_id string, p double")
    p = np.array([r["p"] for r in w.orderBy("state_id").collect()])
    drawn = sampling.weighted_draw(w, sampling.numpy_uniforms(spark, 4000, 3), "state_id").orderBy("draw").collect()
    assert [int(r["state_id"]) for r in drawn] == np.random.default_rng(3).choice(2000, 4000, p=p / p.sum()).tolist()


def test_projection_by_partition_sums(spark, monkeypatch):
    rng = np.random.default_rng(2)
    states = spark.createDataFrame([(i, float(p)) for i, p in enumerate(rng.dirichlet(np.ones(60)))], "state_id long, p double").withColumn("domain", F.lit("d"))
    feats = spark.createDataFrame([(i, f"rare_pair:{j}") for i in range(60) for j in range(4) if rng.random() < 0.4], "state_id long, feature string")
    goal = circuit.targets(circuit.marginals(states, feats), limit=4)
    near = circuit.project(states, feats, goal)
    monkeypatch.setattr(circuit, "PATTERNS", 2)
    far = circuit.project(states, feats, goal)
    assert far.divergence == pytest.approx(near.divergence, rel=1e-6) and far.multipliers == pytest.approx(near.multipliers, rel=1e-5)
    p = {r["state_id"]: (r["p"], r["p_base"]) for r in far.states.withColumn("p_base", F.lit(0.0)).collect()}
    base = {r["state_id"]: r["p"] for r in states.collect()}
    assert far.divergence == pytest.approx(sum(x * math.log(x / base[i]) for i, (x, _) in p.items()), abs=1e-9)


def test_subset_of_many(monkeypatch):
    monkeypatch.setattr(sampling, "EXACT", 64)
    items = [1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 3, 6, 12]
    for target in (700, 65, 999, 3):
        assert sum(items[i] for i in sampling._subset(items, target)) == target


def test_small_things(spark):
    assert salvage.find_object('{"a":' * 5000 + "1" + "}" * 4990 + ' {"plan": {}}') is not None
    plan = F.expr(empty_plan(domain="'webnlg'", triples="array(named_struct('subject', 'é😀\"', 'predicate', 'p', 'object', 'o', 'subject_type', CAST(NULL AS string), 'object_type', CAST(NULL AS string)))"))
    assert spark.range(1).select(realize.serialize(plan)).first()[0] == '<domain=webnlg> <triple subject="\\u00e9\\ud83d\\ude00\\"" predicate="p" object="o">'
    names, clauses = grids.to_cnf("webnlg", {"allowed_triples": [{"subject": "a", "predicate": "p", "object": x} for x in "bcd"], "cardinality": [1, 2]})
    holds = lambda true: all(any((v > 0) == (abs(v) in true) for v in c) for c in clauses)
    assert len(names) == 3 and not holds(set()) and holds({1}) and holds({1, 3}) and not holds({1, 2, 3})
    names, clauses = grids.to_cnf("dart", {"allowed_cells": [["r", "a", "1"], ["r", "b", "2"]], "required_fields": [["r", "a"], ["r", "b"]], "cardinality": [2, 2]})
    assert holds({1, 2}) and not holds({1})
