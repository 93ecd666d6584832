import json

import pytest

from plansmith.plans import config as cfg
from plansmith.plans.manifest import ManifestStore
from plansmith.plans.stages import Pipeline
from plansmith.sources import readers, sinks


def test_config():
    c = cfg.load(None, ["seed=7", "silver.fraction=0.2"])
    assert c["seed"] == 7 and c["silver"]["fraction"] == 0.2
    with pytest.raises(KeyError):
        cfg.load(None, ["nothing.here=1"])
    with pytest.raises(ValueError):
        cfg.load(None, ["sample.fraction=2"])


def test_manifest(spark, tmp_path):
    c = cfg.load(None, [])
    s = ManifestStore(tmp_path, c, {"records": "x"})
    assert s.check("records") == (False, "missing")
    s.save("records", "complete", {"records": 1}, {"records": "f"})
    assert s.check("records", {"records": "f"}) == (True, "complete")
    assert s.check("records", {"records": "g"})[1] == "artifacts differ"
    assert ManifestStore(tmp_path, c, {"records": "y"}).check("records")[1] == "stale implementation"
    assert ManifestStore(tmp_path, cfg.load(None, ["sample.fraction=0.4"]), {"records": "x"}).check("records")[1] == "stale configuration"
    s.save("silver", "complete")
    s.save("records", "complete", {"records": 2})
    assert s.check("silver")[1] == "stale input records" and s.first_incomplete() == "silver"
    m = s.load("records") | {"counts": {}}
    s.files.write(s.path("records"), json.dumps(m))
    assert s.check("records")[1] == "manifest was changed"


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", None), (2, "é", 3)], "z long, a string, n long")
    sinks.write_jsonl(df, str(tmp_path / "x"), ["z"])
    back = readers.read_jsonl(spark, str(tmp_path / "x"), "z long, a string, n long")
    assert sorted(map(tuple, back.collect())) == [(1, "b", None), (2, "é", 3)]
    assert readers.read_jsonl(spark, str(tmp_path / "none"), "a string").count() == 0
    lines = [x for f in (tmp_path / "x").glob("part-*") for x in f.read_text(encoding="utf-8").splitlines()]
    assert '{"a":"b","n":null,"z":1}' in lines


def test_all_stages(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for split, n in (("train", 30), ("test", 20)):
        (raw / f"{split}.json").write_text("".join(json.dumps({"id": f"{split}{i}", "category": f"c{i % 2}", "triples": [[f"{split} s{i}", "likes", f"o{i % 5}"], [f"{split} s{i}", "owns", f"t{i}"]], "text": f"text {split} {i}"}) + "\n" for i in range(n)))
    (raw / "reviews.json").write_text("".join(json.dumps({"index": i, "type": "train" if i % 3 else "test", "comment": f"c {i}", "label": "{CAMERA#Positive};{PRICE#Negative};{OTHERS};" if i % 2 else "{BATTERY#Neutral};"}) + "\n" for i in range(30)))
    kind = "id string, category string, triples array<array<string>>, text string"
    c = cfg.merge(cfg.load(None, []), {
        "runtime": {"root": str(tmp_path / "out")},
        "datasets": {
            "webnlg": {"splits": {s: {"path": str(raw / f"{s}.json"), "schema": kind} for s in ("train", "test")}},
            "visfd": {"source": {"path": str(raw / "reviews.json"), "schema": "index long, type string, comment string, label string"}},
            "zebralogic": {"counts": {"zebra_easy": 20}},
        },
        "sample": {"fraction": 1.0},
        "silver": {"fraction": 0.9},
        "plans": {"count": 50},
        "student": {"validation": 0.2},
        "evaluate": {"variants": {"distill_only": 20, "psdd_fsa": 20, "full_pipeline": 20}},
    })
    p = Pipeline(spark, c)
    p.run()
    assert set(p.status().values()) == {"complete"}
    q = {(r["variant"], r["level"], r["slice"]): r for r in p.table("quality").collect()}
    assert q["full_pipeline", "all", "all"]["schema_validity"] == 1.0 and q["full_pipeline", "all", "all"]["fact_coverage"] == 1.0
    assert q["distill_only", "all", "all"]["schema_validity"] < 1.0
    assert json.loads((tmp_path / "out/projection.json").read_text())["invalid_states"] == 0
    assert {r["slice"] for r in p.table("report_groups").collect()} >= {"c0", "c1"}
    before = p.store.load("metrics")["self"]
    p.run()
    assert p.store.load("metrics")["self"] == before
    with pytest.raises(RuntimeError, match="stale"):
        Pipeline(spark, cfg.merge(c, {"sample": {"fraction": 0.9}})).run_stage("silver")
