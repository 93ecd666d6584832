import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plansmith.operators import circuit, evaluate, grids, realize, records, salvage, sampling, validate
from plansmith.plans.model import empty_plan


def plans(spark, rows):
    """rows of (source_id, [(s, p, o)])"""
    raw = spark.createDataFrame([(i, [list(x) for x in t], " ".join(" ".join(x) + "." for x in t)) for i, t in rows], "id string, triples array<array<string>>, text string")
    return records.normalize(raw, "webnlg", F.lit("train"))


def test_stratified_sample(spark):
    d = spark.createDataFrame([(f"r{i}", str(i % 2)) for i in range(20)], "source_id string, category string")
    a = sorted(r[0] for r in sampling.stratified_sample(d, "source_id", ["category"], 8, 42).collect())
    b = sorted(r[0] for r in sampling.stratified_sample(d.repartition(5), "source_id", ["category"], 8, 42).collect())
    assert a == b and len(a) == 8 and sum(int(x[1:]) % 2 for x in a) == 4
    assert sampling.stratified_sample(d, "source_id", ["category"], 20, 42).count() == 20
    with pytest.raises(Exception, match="larger"):
        sampling.stratified_sample(d, "source_id", ["category"], 21, 42).collect()
    nulls = d.withColumn("category", F.when(F.col("category") == "1", F.col("category")))
    assert sampling.stratified_sample(nulls, "source_id", ["category"], 0.5, 42).count() == 10


def greedy(sizes, targets):
    fill, out = [-t for t in targets], []
    for s in sizes:
        k = min(range(len(fill)), key=lambda i: (fill[i], i))
        fill[k] += s
        out.append(k)
    return out


def test_group_split(spark):
    d = spark.createDataFrame([(g, i) for g in range(30) for i in range(1 + g % 4)], "g long, i long")
    got = sampling.group_split(d, "g", {"a": 0.6, "b": 0.3, "c": 0.1}, 1)
    assert got.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    n = {r[0]: r[1] for r in got.groupBy("split").count().collect()}
    assert abs(n["a"] - 45) <= 3 and sum(n.values()) == d.count()
    one = sampling.group_split(spark.range(3000), "id", {"a": 0.8, "b": 0.1, "c": 0.1}, 1).groupBy("split").count()
    assert {r[0]: r[1] for r in one.collect()} == {"a": 2400, "b": 300, "c": 300}
    assert len(greedy([1] * 10, [8, 1, 1])) == 10


def test_exact_split(spark):
    d = spark.createDataFrame([(g, i, str(g % 3)) for g in range(40) for i in range(1 + g % 3)], "g long, i long, s string")
    got = sampling.exact_group_split(d, "g", ["s"], 13)
    assert {r[0]: r[1] for r in got.groupBy("split").count().collect()}["validation"] == 13
    assert got.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    with pytest.raises(ValueError):
        sampling.exact_group_split(d.filter("g % 3 = 2"), "g", ["s"], 4)


def test_weighted_draw_equals_numpy(spark):
    p = np.array([0.1, 0.25, 0.05, 0.6])
    s = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "state_id long, p double")
    got = sampling.weighted_draw(s, sampling.numpy_uniforms(spark, 500, 7), "state_id").orderBy("draw").collect()
    assert [r["state_id"] for r in got] == np.random.default_rng(7).choice(4, 500, p=p).tolist()


def test_schedule_wraps_and_needs_pools(spark):
    d = spark.createDataFrame([(i, "a" if i else "b") for i in range(5)], "id long, k string")
    assert sampling.scheduled(d, "id", "k", {"a": 1.0, "b": 1.0}, 20).count() == 20
    with pytest.raises(ValueError):
        sampling.scheduled(d, "id", "k", {"a": 1.0, "z": 1.0}, 4)


def test_normalisation(spark):
    raw = spark.createDataFrame([("1", ["A | p | B", "C|||q|||D", "x | y"], ["hello  world"])], "id string, tripleset array<string>, references array<string>")
    r = records.normalize(raw, "webnlg", F.lit("train")).first()
    assert r["source_id"] == "webnlg:train:1" and r["reference_text"] == "hello world"
    assert [(t["subject"], t["predicate"], t["object"]) for t in r["reference_plan"]["triples"]] == [("A", "p", "B"), ("C", "q", "D")]
    empty = spark.createDataFrame([("1", [])], "id string, triples array<string>")
    with pytest.raises(Exception, match="no triples"):
        records.normalize(empty, "webnlg", F.lit("train")).collect()
    for given, want in (("Dev", "validation"), ("TRAIN", "train"), ("test", "test")):
        assert spark.range(1).select(records.split_name(F.lit(given))).first()[0] == want
    with pytest.raises(Exception, match="unknown split"):
        spark.range(1).select(records.split_name(F.lit("other"))).collect()


def test_labels(spark):
    parse = lambda x: spark.range(1).select(records.parse_label(F.lit(x)).alias("l")).first()["l"]
    r = parse("{CAMERA#Positive};{BATTERY#Negative};{OTHERS};")
    assert [tuple(p) for p in r["pairs"]] == [("BATTERY", "Negative"), ("CAMERA", "Positive")] and r["others"]
    r = parse('{"camera": "neutral", "UNKNOWN": "Positive"}')
    assert [tuple(p) for p in r["pairs"]] == [("CAMERA", "Neutral")] and not r["others"]
    with pytest.raises(Exception, match="unknown aspect"):
        parse("{NOTHING#Positive};")


def codes(df):
    return [[e["code"] for e in r["e"]] for r in df.withColumn("constraints", records.constraints()).select(validate.errors().alias("e")).collect()]


def test_triple_rules(spark):
    r = plans(spark, [("1", [("Paris", "locatedIn", "France")])])
    assert codes(r.withColumn("plan", F.col("reference_plan"))) == [[]]
    bad = r.withColumn("t", F.expr("transform(reference_plan.triples, x -> named_struct('subject', x.subject, 'predicate', 'forbidden', 'object', x.object, 'subject_type', 'City', 'object_type', x.object_type))"))
    assert codes(bad.withColumn("plan", F.expr(empty_plan(domain="domain", triples="t")))) == [["relation", "grounding"]]
    assert codes(r.withColumn("plan", F.expr(empty_plan(domain="'dart'")))) == [["domain"]]


def test_grids(spark):
    g = grids.generate(spark, {"zebra_easy": 3, "zebra_medium": 4, "zebra_hard": 3}, 42)
    p = g.withColumns({"schema_id": F.lit(None).cast("string"), "plan": F.expr(empty_plan(domain="domain", grid_size="grid_size", categories="categories", clues="clues", assignment="assignment"))}).withColumn("reference_plan", F.col("plan"))
    assert codes(p) == [[]] * 10
    odd = p.withColumn("c", F.expr("transform(clues, (x, i) -> IF(i = 0, named_struct('type', 'unsupported', 'left', x.left, 'right', x.right, 'position', x.position), x))"))
    odd = odd.withColumn("reference_plan", F.expr(empty_plan(domain="domain", grid_size="grid_size", categories="categories", clues="c", assignment="assignment")))
    assert all(c == ["unknown_clue"] for c in codes(odd))
    for r in g.filter("domain = 'zebra_easy'").collect():
        con = {"grid_size": r["grid_size"], "categories": r["categories"], "clues": [{"type": c["type"], "left": c["left"].asDict(), "right": c["right"].asDict() if c["right"] else None, "position": c["position"]} for c in r["clues"]]}
        assert grids.enumerate_grid(con) == [{c: dict(x) for c, x in sorted(r["assignment"].items())}]
        names, clauses = grids.to_cnf(r["domain"], con)
        true = {v for (c, x, p), v in names.items() if r["assignment"][c][x] == p}
        assert all(any((v > 0) == (abs(v) in true) for v in cl) for cl in clauses)


def test_realisation(spark):
    r = plans(spark, [("1", [("A", "p", "B"), ("C", "q", "D")])]).select(realize.plan_text(F.col("reference_plan")).alias("t"), realize.realizations(F.col("reference_plan")).alias("r"), realize.facts(F.col("reference_plan")).alias("f"), realize.serialize(F.col("reference_plan")).alias("s")).first()
    assert r["t"] == r["r"][0] == "A p B. C q D." and r["r"][1] == "C q D. A p B."
    assert r["f"] == [["A", "p", "B"], ["C", "q", "D"]] and r["s"].startswith('<domain=webnlg> <triple subject="A"')
    e = realize.automaton(spark.createDataFrame([(["4", "5"],), (["4", "6"],)], "seq array<string>"), []).cache()
    s = realize.run_automaton(e, ["4"])
    assert {x[0] for x in realize.next_tokens(e, s).collect()} == {"5", "6"} and realize.run_automaton(e, ["4", "7"]) is None
    assert realize.run_automaton(e, ["4", "5", realize.EOS]) is not None


def test_reviews(spark):
    assert spark.range(1).select(validate.language_valid(F.lit("pin có đánh giá tích cực."))).first()[0]
    for bad in ("pin 电池", "привет", ""):
        assert not spark.range(1).select(validate.language_valid(F.lit(bad))).first()[0]


def test_verification_reasons(spark):
    r = plans(spark, [("1", [("Paris", "locatedIn", "France")])])
    good = r.select(F.to_json(F.struct(F.col("reference_plan").alias("plan"), F.lit("Paris locatedIn France.").alias("text")))).first()[0]
    rows = [("webnlg:train:1", c) for c in (good, good[:10], good.replace("Paris locatedIn France.", "nothing"), good.replace("Paris locatedIn France.", ""), None)]
    got = validate.verify(spark.createDataFrame(rows, "source_id string, candidate string"), records.infer_schema(r)).select("reject_reason").collect()
    assert sorted(str(x[0]) for x in got) == ["None", "json_parse", "json_parse", "plan_text_inconsistent", "required_fields"]
    with pytest.raises(Exception, match="no schema"):
        validate.verify(spark.createDataFrame([("x", good)], "source_id string, candidate string"), records.infer_schema(r)).collect()


def test_salvage():
    assert salvage.find_object('x {bad} ```json\n{"a": {"b": 1}} tail}') == '{"a": {"b": 1}}'
    assert salvage.find_object("none") is None and salvage.find_object(None) is None
    assert salvage.normalise('{"plan": {"triples": [["a", "b", "c"]]}}', "webnlg") == "null"
    assert salvage.normalise('{"assignment": {"x": []}}', "zebra_easy") == "null"
    assert json.loads(salvage.normalise('{"plan": {"triples": [{"subject": "a"}]}, "text": "t"}', "webnlg"))["text"] == "t"


def test_distribution(spark):
    r = plans(spark, [("1", [("A", "p", "B"), ("C", "q", "D")]), ("2", [("A", "p", "B"), ("E", "r", "F")]), ("3", [("G", "p", "B"), ("E", "q", "D")])])
    obs = r.select(circuit.state_key(F.col("source_id"), F.col("reference_plan")).alias("state_id"), "domain", "source_id", circuit.plan_key(F.col("reference_plan")).alias("plan_key"), F.col("reference_plan").alias("plan"))
    s = circuit.fit(obs.unionByName(obs.filter("source_id LIKE '%1'"))).cache()
    circuit.check(s)
    assert s.agg(F.sum("p")).first()[0] == pytest.approx(1) and circuit.probability(s, "x") == 0
    f = s.select("state_id", F.explode(circuit.basic_features(F.col("plan"), F.col("domain"))).alias("feature")).cache()
    space = circuit.feature_space(f, s, (8, 8, 8), 0.5)
    every = circuit.with_pairs(f, space).cache()
    m = circuit.marginals(s, every)
    goal = circuit.targets(m, limit=3)
    p = circuit.project(s, every, goal)
    got = {x["feature"]: x["marginal"] for x in circuit.marginals(p.states, every).collect()}
    for g in goal.collect():
        assert got[g["feature"]] == pytest.approx(g["target"], abs=1e-6)
    assert p.divergence >= 0 and p.states.agg(F.sum("p")).first()[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        circuit.project(s, every, circuit.targets(m, {"relation:webnlg:p": 0.2}))
    assert sampling.weighted_draw(p.states.select("state_id", "p"), sampling.hash_uniforms(spark, 12, 1), "state_id").count() == 12


def test_perfect_output(spark):
    r = plans(spark, [("1", [("Paris", "locatedIn", "France")]), ("2", [("Rome", "locatedIn", "Italy")])])
    o = r.select(F.col("source_id").alias("output_id"), "domain", F.col("reference_plan").alias("plan"), realize.plan_text(F.col("reference_plan")).alias("text"))
    v = o.select("domain", F.explode(F.transform(realize.facts(F.col("plan")), realize.canonical_fact)).alias("fact"))
    for x in evaluate.fact_scores(o, "output_id", v).collect():
        assert (x["hits"], x["facts"], x["precision"]) == (1, 1, 1.0)
    wrong = o.withColumn("text", F.lit("Paris locatedIn France. Rome locatedIn Italy."))
    assert [x["precision"] for x in evaluate.fact_scores(wrong, "output_id", v).collect()] == [0.5, 0.5]
    none = o.withColumn("text", F.lit(None).cast("string"))
    assert [(x["hits"], x["precision"]) for x in evaluate.fact_scores(none, "output_id", v).collect()] == [(0, 0.0)] * 2
    t = evaluate.term_precision(o, "output_id", spark.createDataFrame([("Paris",), ("Rome",), ("of Rome",)], "term string"))
    assert [x["term_precision"] for x in t.collect()] == [1.0, 1.0]


def test_mentions_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    texts = [(i, "-", "; ".join(" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(rng.randint(0, 4)))) for i in range(60)]
    facts = [("-", [" ".join(rng.choices(words, k=rng.randint(1, 2))) for _ in range(rng.randint(1, 2))]) for _ in range(40)]
    got = {(r[0], tuple(r[2])) for r in evaluate.mentions(spark.createDataFrame(texts, "id long, domain string, text string"), "id", spark.createDataFrame(facts, "domain string, fact array<string>")).collect()}
    want = {(i, tuple(f)) for i, _, t in texts for _, f in facts if any(all(f" {x} " in f" {c} " for x in f) for c in t.split("; ") if c)}
    assert got == want


def test_fact_keys_are_the_rarest_tokens(spark):
    facts = [("-", ["a b", "c"]), ("-", ["c", "a d"]), ("-", ["a"]), ("-", ["a c", "a"]), ("-", ["a b", "c"]), ("-", []), ("x", ["a", "e"]), ("x", ["e"])]
    got = {(r["domain"], tuple(r["fact"])): r["token"] for r in evaluate.fact_keys(spark.createDataFrame(facts, "domain string, fact array<string>")).collect()}
    assert got == {("-", ("a b", "c")): "b", ("-", ("c", "a d")): "d", ("-", ("a",)): "a", ("-", ("a c", "a")): "c", ("x", ("a", "e")): "a", ("x", ("e",)): "e"}


def test_scores_keep_columns(spark):
    r = plans(spark, [("1", [("Paris", "locatedIn", "France")])])
    o = r.select(F.col("source_id").alias("output_id"), "domain", F.lit("v").alias("variant"), F.col("reference_plan").alias("plan"), realize.plan_text(F.col("reference_plan")).alias("text"))
    v = o.select("domain", F.explode(F.transform(realize.facts(F.col("plan")), realize.canonical_fact)).alias("fact"))
    got = evaluate.fact_scores(o, "output_id", v, ("variant", "domain", "text"))
    assert got.columns == ["output_id", "variant", "domain", "text", "hits", "facts", "precision"]
    want = o.join(evaluate.fact_scores(o, "output_id", v), "output_id").select(*got.columns)
    assert [tuple(x) for x in got.collect()] == [tuple(x) for x in want.collect()]
