"""JSON out of a model's free text: the first decodable object, and candidates brought into one shape."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_DECODER = json.JSONDecoder()


def find_object(text: str | None) -> str | None:
    """The first substring that decodes as a JSON object, fences left out; None where there is none."""
    if not text:
        return None
    at = text.find("{")
    while at >= 0:
        try:
            value, end = _DECODER.raw_decode(text, at)
            if isinstance(value, dict):
                return text[at:end]
        except (ValueError, RecursionError):  # nested deeper than the decoder goes: no object that could be a plan
            pass
        at = text.find("{", at + 1)
    return None


def shape_ok(plan: object, domain: str) -> bool:
    """Whether a decoded plan has its family's arm in the right shape."""
    if not isinstance(plan, dict):
        return False
    if domain.startswith("zebra"):
        a = plan.get("assignment")
        return isinstance(a, dict) and all(isinstance(v, dict) for v in a.values())
    items = plan.get({"webnlg": "triples", "dart": "fields", "visfd": "pairs"}.get(domain, ""))
    return isinstance(items, list) and all(isinstance(x, dict) for x in items)


def normalise(raw: str | None, domain: str, schema_id: str | None = None) -> str:
    """A candidate as JSON of plan and text; ``null`` where it has no usable shape."""
    found = find_object(raw)
    if found is None:
        return "null"
    value = json.loads(found)
    plan = value.get("plan", value)
    if not shape_ok(plan, domain):
        return "null"
    plan = {**plan, "domain": domain} | ({"schema_id": schema_id} if schema_id else {})
    text = value.get("text") if isinstance(value.get("text"), str) else ""
    return json.dumps({"plan": plan, "text": text}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


# Keys under which a model may have put a text, in the order in which they are looked for.
SAID_KEYS = ("text", "review", "comment", "response", "output")


def said(raw: str | None) -> str:
    """The text of an answer whose plan is known: the first of the text keys that isn't blank, or the whole answer where it
    is no object; empty where there is none."""
    found = find_object(raw)
    if found is not None:
        values = json.loads(found)
        return next((v.strip() for k in SAID_KEYS if isinstance(v := values.get(k), str) and v.strip()), "")
    whole = (raw or "").strip()
    return "" if whole.startswith("{") else whole


def attached(raw: Column, plan: Column) -> Column:
    """A candidate of a fixed plan and the text that the answer gives, as JSON."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(said)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.to_json(F.struct(plan.alias("plan"), pandas_udf(run, "string")(F.coalesce(raw, F.lit(""))).alias("text")))


def first_object(text: Column) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(find_object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(run, "string")(text)


def normalised(raw: Column, domain: Column, schema_id: Column) -> Column:
    def run(batches):
        for a, b, c in batches:
            yield pd.Series([normalise(x, y, z) for x, y, z in zip(a, b, c, strict=True)], dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return pandas_udf(run, "string")(raw, domain, schema_id)
