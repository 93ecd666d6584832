import hashlib

import pytest
from pyspark.sql import functions as F

from plansmith.operators import attempts, circuit, grids, realize, salvage, sampling
from plansmith.plans import config as cfg
from plansmith.plans import manifest, preflight
from plansmith.sources import readers

FLAGS = "k string, retry int, parse_valid boolean, phi_valid boolean, factual_consistency boolean, reject_reason string, candidate string"


def test_first_try_that_holds(spark):
    rows = [
        ("a", 1, True, True, True, None, "a1"), ("a", 0, True, False, False, "cardinality", "a0"), ("a", 2, False, False, False, "json_parse", "a2"),
        ("b", 0, False, False, False, None, "b0"), ("b", 1, True, None, True, "x", "b1"),
        ("c", 0, True, True, True, None, "c0"),
        (None, 0, True, True, True, None, "n0"),
    ]
    got = {r["k"]: r for r in attempts.resolve(spark.createDataFrame(rows, FLAGS), ["k"]).collect()}
    assert (got["a"]["attempts"], got["a"]["reasons"], got["a"]["fallback"], got["a"]["candidate"]) == (2, ["cardinality"], False, "a1")
    assert (got["b"]["attempts"], got["b"]["reasons"], got["b"]["fallback"], got["b"]["candidate"]) == (2, ["verification_failed", "x"], True, None)
    assert got["c"]["attempts"] == 1 and got["c"]["reasons"] == [] and got[None]["candidate"] == "n0"
    assert attempts.resolve(spark.createDataFrame([], FLAGS), ["k"]).count() == 0


def test_totals(spark):
    r = spark.createDataFrame([("d", 3, ["x", "y", "x"], True), ("d", 1, [], False), ("e", 2, ["x"], False)], "domain string, attempts int, reasons array<string>, fallback boolean")
    assert {tuple(x) for x in attempts.totals(r).collect()} == {("d", 2, 1, 2, 3), ("e", 1, 0, 1, 1)}
    assert {tuple(x) for x in attempts.reasons(r).collect()} == {("d", "x", 2), ("d", "y", 1), ("e", "x", 1)}


@pytest.mark.parametrize(("raw", "text"), [
    ('{"text": " a "}', "a"), ('{"text": "", "review": "b"}', "b"), ('{"text": 3, "output": "c"}', "c"), ('{"other": "d"}', ""),
    ("plain words ", "plain words"), ('{"text": broken', ""), ("", ""), (None, ""), ("  { no", ""), ('say {"comment": "e"} so', "e"),
])
def test_said(raw, text):
    assert salvage.said(raw) == text


def test_dead_ends(spark):
    said = spark.createDataFrame([("p", ["a", "b"]), ("p", ["a", "c"]), ("q", ["a"])], "k string, seq array<string>")
    edges = realize.automaton(said, ["k"])
    asked = spark.createDataFrame([("p", ["a", "x", "y"]), ("q", ["a", realize.EOS]), ("r", ["a"]), ("s", [])], "k string, seq array<string>")
    got = {r["k"]: (r["step"], r["token"], r["legal"]) for r in realize.dead_ends(asked, ["k"], edges).collect()}
    assert got == {"p": (1, "x", ["b", "c"]), "r": (0, "a", [])}


def test_normal_forms_of_a_table(spark):
    c = {"required_pairs": [["PRICE", "Positive"]], "allowed_aspects": ["PRICE"], "allowed_sentiments": ["Positive", "Negative"], "required_others": True}
    kind = "required_pairs:array<array<string>>,allowed_aspects:array<string>,allowed_sentiments:array<string>,required_others:boolean"
    x = spark.createDataFrame([(1, "visfd", c)], f"id long, domain string, constraints struct<{kind}>")
    names, rules = grids.to_cnf("visfd", c)
    r = grids.normal_forms(x, "id").first()
    assert (r["id"], r["variables"], r["clauses"]) == (1, len(names), len(rules)) == (1, 3, 4)


def test_exact_split_of_equal_groups(spark):
    d = spark.range(600).select((F.col("id") % 200).alias("g"), F.when(F.col("id") % 200 < 150, "big").otherwise("small").alias("s"))
    got = sampling.exact_group_split(d, "g", ["s"], 30)
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 570, "validation": 30}
    assert got.groupBy("g").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0


def test_budgets_and_whitelist(spark):
    c = cfg.merge(cfg.DEFAULTS, {"evaluate": {"budget": 9, "variants": {"distill_only": True, "psdd_only": False}}})
    cfg.validate(c)
    assert cfg.budgets(c)["distill_only"] == 9 and "psdd_only" not in cfg.budgets(c) and cfg.budgets(c)["psdd_fsa"] == 300
    d = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert sampling.whitelisted(d, "s", None).count() == 3 and sampling.whitelisted(d, "s", ["a"]).count() == 1 and sampling.whitelisted(d, "s", []).count() == 0


def test_preflight(spark, tmp_path):
    (tmp_path / "x.json").write_text("{}\n")
    c = cfg.merge(cfg.DEFAULTS, {"datasets": {"dart": {"splits": {"train": {"path": str(tmp_path / "x.json")}}}}, "runtime": {"root": str(tmp_path)}})
    r = preflight.report(spark, c)
    assert all(r["conformance"].values()) and r["sources"] == {"dart": True} and r["memory_bytes"] > 0 and r["packages"]["pyspark"]
    assert r["config"] == manifest.scientific_hash(cfg.merge(c, {"runtime": {"root": "elsewhere"}}))
    with pytest.raises(FileNotFoundError, match="dart"):
        preflight.report(spark, cfg.merge(c, {"datasets": {"dart": {"splits": {"train": {"path": str(tmp_path / "none")}}}}}))
    assert circuit.conformance(spark)["projection"]


def test_digests_of_files_and_code(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(b"abc")
    (tmp_path / "in/b.bin").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["sha256"]) for r in readers.file_digests(spark, str(tmp_path / "in")).collect()}
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in (("a.bin", b"abc"),)}  # an empty file has no row
    assert manifest.code_revision(tmp_path) == "unversioned"
    git = tmp_path / ".git"
    (git / "refs/heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "packed-refs").write_text("# pack\nf00 refs/heads/main\n")
    assert manifest.code_revision(tmp_path) == "f00"
    (git / "refs/heads/main").write_text("ba5\n")
    assert manifest.code_revision(tmp_path) == "ba5"
