"""What a run finds before it starts: memory, disk, packages, the distribution's self-test, and whether its sources are there."""

from __future__ import annotations

import os
import shutil
from importlib import metadata

from pyspark.sql import SparkSession

from ..operators import circuit
from ..sources import readers
from .manifest import code_revision, scientific_hash

PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy")


def memory_bytes() -> int | None:
    """The driver machine's memory; None where the system does not say."""
    try:
        return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (AttributeError, OSError, ValueError):
        return None


def versions() -> dict[str, str | None]:
    found = {}
    for name in PACKAGES:
        try:
            found[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            found[name] = None
    return found


def sources(spark: SparkSession, config: dict) -> dict[str, bool]:
    """Whether the path of each dataset's sources exists; generated grids need none."""
    out = {}
    for name, spec in config["datasets"].items():
        given = [spec["source"]] if "source" in spec else list(spec.get("splits", {}).values())
        out[name] = all(readers.exists(spark, s["path"]) for s in given)
    return out


def report(spark: SparkSession, config: dict) -> dict:
    """Raises where a source is missing or the self-test fails. No accelerator is asked for: models are plug-ins."""
    there = sources(spark, config)
    if not all(there.values()):
        raise FileNotFoundError(f"sources are missing: {sorted(k for k, v in there.items() if not v)}")
    return {
        "spark": spark.version,
        "parallelism": spark.sparkContext.defaultParallelism,
        "root": config["runtime"]["root"],
        "datasets": sorted(config["datasets"]),
        "memory_bytes": memory_bytes(),
        "scratch_free_bytes": shutil.disk_usage(os.getcwd()).free,
        "packages": versions(),
        "sources": there,
        "conformance": circuit.conformance(spark),
        "backend": circuit.BACKEND,
        "config": scientific_hash(config),
        "revision": code_revision(),
    }
