"""Configuration of the staged pipeline: YAML or JSON, dotted overrides, checks."""

from __future__ import annotations

import copy
import json
from pathlib import Path

DEFAULTS: dict = {
    "seed": 42,
    "datasets": {},
    "sample": {"fraction": 0.5, "stratify_by": {"webnlg": ["category", "triple_count"], "dart": ["source", "schema_cardinality", "triple_count"], "zebralogic": ["official_split", "grid_size", "clue_count", "clue_type"], "visfd": ["n_star"]}, "population": {}, "splits": {}},
    "silver": {"fraction": 0.1, "total": None, "quotas": {}, "max_candidates": 5, "retries": 1},
    "fit": {"alpha": 1e-8, "floor": 1e-8, "max_states": 100_000},
    "features": {"attributes": 512, "relations": 256, "rare_pairs": 128, "quantile": 0.25},
    "project": {"tolerance": 1e-6, "targets": None, "limit": 32},
    "plans": {"count": 4000},
    "student": {"validation": 0.05, "epochs": 1, "micro_batch": 1, "accumulation": 16, "every": 500, "steps": []},
    "evaluate": {"budget": 500, "variants": {"distill_only": 300, "psdd_only": 300, "psdd_fsa": 300, "psdd_pgd": 300, "full_pipeline": 300}, "weights": {}},
    "runtime": {"root": "out"},
}


def merge(base: dict, more: dict) -> dict:
    out = copy.deepcopy(base)
    for k, v in more.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def override(config: dict, path: str, value: str) -> None:
    """Sets one value by its dotted path; a path that isn't there is an error. Values are JSON, else text."""
    at, (*parents, last) = config, path.split(".")
    for p in parents:
        at = at[p]
    if last not in at:
        raise KeyError(path)
    try:
        at[last] = json.loads(value)
    except ValueError:
        at[last] = value


def load(path: str | Path | None, overrides: list[str] | None = None) -> dict:
    """The defaults, a file over them, and overrides of the form path=value over both."""
    given: dict = {}
    if path is not None:
        text = Path(path).read_text(encoding="utf-8")
        if str(path).endswith(".json"):
            given = json.loads(text)
        else:
            import yaml

            given = yaml.safe_load(text) or {}
    config = merge(DEFAULTS, given)
    for o in overrides or []:
        k, _, v = o.partition("=")
        override(config, k, v)
    validate(config)
    return config


def validate(config: dict) -> None:
    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(what)

    need(isinstance(config["seed"], int), "seed must be a whole number")
    need(0 < config["sample"]["fraction"] <= 1, "sample.fraction must lie in (0, 1]")
    need(0 < config["silver"]["fraction"] <= 1, "silver.fraction must lie in (0, 1]")
    need(config["silver"]["max_candidates"] >= 1, "silver.max_candidates must be at least 1")
    need(config["silver"]["retries"] >= 1, "silver.retries must be at least 1")
    need(config["fit"]["alpha"] > 0 and 0 <= config["fit"]["floor"] < 1, "fit.alpha must be positive and fit.floor lie in [0, 1)")
    need(0 <= config["features"]["quantile"] <= 1, "features.quantile must lie in [0, 1]")
    need(config["project"]["limit"] <= 64, "project.limit is at most 64")
    need(0 < config["student"]["validation"] < 1, "student.validation must lie in (0, 1)")
    need(all(isinstance(v, int) and (isinstance(v, bool) or v > 0) for v in config["evaluate"]["variants"].values()), "evaluate.variants must be positive counts, true or false")
    need(isinstance(config["evaluate"]["budget"], int) and config["evaluate"]["budget"] > 0, "evaluate.budget must be a positive count")
    for name, spec in config["datasets"].items():
        need(name in ("webnlg", "dart", "zebralogic", "visfd"), f"unknown dataset {name}")
        need(bool({"splits", "source"} & set(spec)) or (name == "zebralogic" and "counts" in spec), f"dataset {name} names no source")


def budgets(config: dict) -> dict[str, int]:
    """Outputs of each variant that is on: its own number, or the default where it is only said to be on."""
    e = config["evaluate"]
    return {k: e["budget"] if v is True else v for k, v in e["variants"].items() if v is not False}
