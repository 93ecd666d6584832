"""Stage manifests: what a stage wrote, under which configuration, code and inputs; and whether that still holds."""

from __future__ import annotations

import inspect
import json
from collections.abc import Iterable
from pathlib import Path

from ..functions.canon import digest
from ..sources.sinks import Files, write_json

STAGES = ("records", "silver", "fit", "project", "plans", "student", "outputs", "metrics")
#: Which stages a stage reads, and which parts of the configuration it depends on.
UPSTREAM = {"records": (), "silver": ("records",), "fit": ("silver",), "project": ("fit",), "plans": ("project",), "student": ("silver",), "outputs": ("records", "fit", "project"), "metrics": ("outputs", "project", "records")}
SECTIONS = {
    "records": ("seed", "datasets", "sample"),
    "silver": ("seed", "silver"),
    "fit": ("fit", "features"),
    "project": ("project",),
    "plans": ("seed", "plans"),
    "student": ("seed", "student"),
    "outputs": ("seed", "evaluate"),
    "metrics": ("evaluate",),
}


def config_hash(config: dict, stage: str) -> str:
    return digest({k: config[k] for k in SECTIONS[stage]})


def scientific_hash(config: dict) -> str:
    """The digest of all that results depend on: where a run writes is left out."""
    return digest({k: v for k, v in config.items() if k != "runtime"})


def code_revision(root: str | Path = Path(__file__).resolve().parents[2]) -> str:
    """The commit of a checkout, read from its files; ``unversioned`` where there is none."""
    git = Path(root) / ".git"
    try:
        head = (git / "HEAD").read_text().strip()
        if not head.startswith("ref: "):
            return head
        ref = git / head[5:]
        if ref.exists():
            return ref.read_text().strip()
        packed = (line.split(" ") for line in (git / "packed-refs").read_text().splitlines() if not line.startswith(("#", "^")))
        return next(h for h, name in packed if name == head[5:])
    except (OSError, StopIteration):
        return "unversioned"


def code_hash(functions: Iterable) -> str:
    """The digest of the sources of all modules that the functions come from."""
    modules = sorted({inspect.getmodule(f) for f in functions}, key=lambda m: m.__name__)
    return digest([inspect.getsource(m) for m in modules])


class ManifestStore:
    def __init__(self, root: object, config: dict, code: dict[str, str] | None = None):
        self.root, self.config, self.code, self.files = str(root), config, code or {}, Files()

    def path(self, stage: str) -> str:
        return f"{self.root}/manifests/{stage}.json"

    def load(self, stage: str) -> dict | None:
        text = self.files.read(self.path(stage))
        try:
            return None if text is None else json.loads(text)
        except ValueError:
            return None

    def save(self, stage: str, status: str, counts: dict[str, int] | None = None, artifacts: dict[str, str] | None = None, error: str | None = None) -> dict:
        """artifacts: name to a fingerprint of what was written."""
        up = {u: (self.load(u) or {}).get("self") for u in UPSTREAM[stage]}
        m = {"stage": stage, "status": status, "config": config_hash(self.config, stage), "scientific": scientific_hash(self.config), "revision": code_revision(), "code": self.code.get(stage, ""), "counts": counts or {}, "artifacts": artifacts or {}, "upstream": up, "error": error}
        m["self"] = digest(m)
        write_json(self.path(stage), m, self.files)
        return m

    def check(self, stage: str, artifacts: dict[str, str] | None = None) -> tuple[bool, str]:
        """Whether a stage is complete and fresh, and if not, why; the first reason counts."""
        m = self.load(stage)
        if m is None:
            return False, "missing"
        if digest({k: v for k, v in m.items() if k != "self"}) != m.get("self"):
            return False, "manifest was changed"
        if m["status"] != "complete":
            return False, f"status is {m['status']}"
        if m["config"] != config_hash(self.config, stage):
            return False, "stale configuration"
        if m["code"] != self.code.get(stage, ""):
            return False, "stale implementation"
        if artifacts is not None and artifacts != m["artifacts"]:
            return False, "artifacts differ"
        for u in UPSTREAM[stage]:
            if (self.load(u) or {}).get("self") != m["upstream"].get(u):
                return False, f"stale input {u}"
        return True, "complete"

    def first_incomplete(self) -> str | None:
        return next((s for s in STAGES if not self.check(s)[0]), None)
