"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import chat, decontamination, langid, line_dedup, mixing, neighbours, secret_scan, simhash, toxicity, url_filter

MODULES = [toxicity, chat, langid, line_dedup, neighbours, decontamination, simhash, mixing, secret_scan, url_filter]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2:3].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "ORACLE_SQL", {}).items()}
