"""Validation of plans against schemas: ordered arrays of errors, built from nested columns without a shuffle.

Rules fire per atom in order, and the first error is what a rejection is named by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import canonical_text, contains_phrase, let
from ..plans.model import ERROR, PLAN
from .realize import plan_terms

#: Scripts that a Vietnamese review can't hold: CJK, kana, Hangul, Cyrillic, Arabic and Thai blocks.
FOREIGN_SCRIPT = r"[Ѐ-ԯ؀-ۿݐ-ݿ฀-๿ᄀ-ᇿ぀-ヿ㄰-㆏㐀-䶿一-鿿가-힯豈-﫿]"
_NONE = f"CAST(array() AS array<{ERROR}>)"


def _err(code: str, path: str, message: str, when: str) -> str:
    return f"IF(coalesce({when}, false), array(named_struct('code', '{code}', 'path', {path}, 'message', '{message}')), {_NONE})"


def _per(items: str, rules: list[str]) -> str:
    """Errors of each item x at index i, in order."""
    return f"flatten(transform({items}, (x, i) -> concat({', '.join(rules)})))"


def _all(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


def _blank(x: str) -> str:
    return f"coalesce(trim({x}), '') = ''"


def triple_errors(plan: str = "plan", c: str = "constraints") -> str:
    t = f"{plan}.triples"
    path = "concat('triples[', i, ']')"
    same = "struct(x.subject, x.predicate, x.object) = struct(y.subject, y.predicate, y.object)"
    rules = [
        _err("required", path, "subject, predicate and object are required", " OR ".join(_blank(f"x.{k}") for k in ("subject", "predicate", "object"))),
        _err("relation", path, "predicate is not allowed", f"{c}.allowed_predicates IS NOT NULL AND NOT coalesce(array_contains({c}.allowed_predicates, x.predicate), false)"),
        _err("domain", path, "subject type does not fit the predicate", f"{c}.domain_range[x.predicate][0] IS NOT NULL AND NOT x.subject_type <=> {c}.domain_range[x.predicate][0]"),
        _err("range", path, "object type does not fit the predicate", f"{c}.domain_range[x.predicate][1] IS NOT NULL AND NOT x.object_type <=> {c}.domain_range[x.predicate][1]"),
        _err("grounding", path, "triple is not in the source", f"{c}.allowed_triples IS NOT NULL AND NOT exists({c}.allowed_triples, y -> {same})"),
        _err("duplicate", path, "triple repeats an earlier one", f"exists(slice({t}, 1, i), y -> {same})"),
    ]
    both = "d[0] <> d[1] AND array_contains(array(x.subject_type, x.object_type), d[0]) AND array_contains(array(x.subject_type, x.object_type), d[1])"
    # pair by pair over all triples, behind all other rules
    apart = f"coalesce(flatten(transform({c}.disjoint_types, d -> flatten(transform({t}, (x, i) -> {_err('disjoint', path, 'subject and object types are disjoint', both)})))), {_NONE})"
    return f"CASE WHEN {t} IS NULL OR size({t}) = 0 THEN {_err('required', repr('triples'), 'a plan needs triples', 'true')} ELSE {_all(_err('cardinality', repr('triples'), 'number of triples out of bounds', f'{c}.cardinality IS NOT NULL AND NOT size({t}) BETWEEN {c}.cardinality[0] AND {c}.cardinality[1]'), _per(t, rules), apart)} END"


def cell_errors(plan: str = "plan", c: str = "constraints", schema_id: str = "schema_id") -> str:
    f = f"{plan}.fields"
    path = "concat('fields[', i, ']')"
    number = "try_cast(x.value AS double) IS NULL"
    rules = [
        _err("type", path, "row, column and value are required", f"x.row IS NULL OR x.value IS NULL OR {_blank('x.column')}"),
        _err("field", path, "column is not allowed", f"NOT array_contains({c}.allowed_columns, x.column)"),
        _err("compatibility", path, "value is not a number", f"{c}.field_value_types[x.column] = 'number' AND {number}"),
        _err("grounding", path, "cell is not in the source", f"CASE WHEN size({c}.allowed_cells) > 0 THEN NOT array_contains({c}.allowed_cells, array(x.row, x.column, x.value)) ELSE {c}.allowed_values[x.column] IS NOT NULL AND NOT array_contains({c}.allowed_values[x.column], x.value) END"),
        _err("duplicate", path, "cell repeats an earlier one", f"exists(slice({f}, 1, i), y -> y.row = x.row AND y.column = x.column)"),
    ]
    seen = f"transform({f}, x -> array(x.row, x.column))"
    missing = f"transform(array_except({c}.required_fields, {seen}), m -> named_struct('code', 'required', 'path', concat_ws('/', m), 'message', 'required cell is missing'))"
    head = _err("schema_identity", "'schema_id'", "plan belongs to another schema", f"{schema_id} IS NOT NULL AND NOT {plan}.schema_id <=> {schema_id}")
    return f"CASE WHEN {f} IS NULL OR size({f}) = 0 THEN {_all(head, _err('required', repr('fields'), 'a plan needs fields', 'true'))} ELSE {_all(head, _err('cardinality', repr('fields'), 'number of fields out of bounds', f'{c}.cardinality IS NOT NULL AND NOT size({f}) BETWEEN {c}.cardinality[0] AND {c}.cardinality[1]'), _per(f, rules), f'coalesce({missing}, {_NONE})')} END"


def clue_holds(assignment: str, x: str = "x") -> str:
    left = f"try_element_at(try_element_at({assignment}, {x}.left.category), {x}.left.item)"
    right = f"try_element_at(try_element_at({assignment}, {x}.right.category), {x}.right.item)"
    return (
        f"coalesce(CASE {x}.type WHEN 'fixed_position' THEN {left} = {x}.position WHEN 'equality' THEN {left} = {right} WHEN 'inequality' THEN {left} <> {right} "
        f"WHEN 'left_of' THEN {left} + 1 = {right} WHEN 'right_of' THEN {left} = {right} + 1 WHEN 'adjacent' THEN abs({left} - {right}) = 1 WHEN 'not_adjacent' THEN abs({left} - {right}) <> 1 END, false)"
    )


def grid_errors(plan: str = "plan", c: str = "constraints") -> str:
    a = f"{plan}.assignment"
    cats = f"array_sort(map_keys({c}.categories))"
    path = "concat('assignment.', x)"
    items = f"map_keys(try_element_at({a}, x))"
    want = f"{c}.categories[x]"
    pos = f"map_values(try_element_at({a}, x))"
    rules = [
        _err("complete_assignment", path, "items do not match the category", f"{items} IS NULL OR size(array_except({items}, {want})) > 0 OR size(array_except({want}, {items})) > 0"),
        _err("position", path, "position out of range", f"exists({pos}, p -> p IS NULL OR p < 0 OR p >= {c}.grid_size)"),
        _err("bijectivity", path, "positions are not distinct", f"{pos} IS NOT NULL AND (size(array_distinct({pos})) <> size({pos}) OR size({pos}) <> {c}.grid_size)"),
    ]
    from ..plans.model import CLUE_TYPES

    known = ", ".join(map(repr, CLUE_TYPES))
    cpath = "concat('clues[', i, ']')"
    clues = [_err("unknown_clue", cpath, "clue type is unknown", f"NOT coalesce(x.type IN ({known}), false)"), _err("clue", cpath, "clue does not hold", f"x.type IN ({known}) AND NOT {clue_holds(a)}")]
    extra = _err("complete_assignment", "'assignment'", "categories do not match", f"{a} IS NULL OR size(array_except(map_keys({a}), map_keys({c}.categories))) > 0")
    return _all(extra, _per(cats, rules), f"coalesce({_per(f'{c}.clues', clues)}, {_NONE})")


def review_errors(plan: str = "plan", c: str = "constraints") -> str:
    p = f"{plan}.pairs"
    path = "concat('pairs[', i, ']')"
    rules = [
        _err("aspect", path, "aspect is unknown", f"NOT coalesce(array_contains({c}.allowed_aspects, x.aspect), false)"),
        _err("sentiment", path, "sentiment is unknown", f"NOT coalesce(array_contains({c}.allowed_sentiments, x.sentiment), false)"),
        _err("duplicate", path, "aspect repeats", f"exists(slice({p}, 1, i), y -> y.aspect = x.aspect)"),
    ]
    got = f"array_sort(transform({p}, x -> array(x.aspect, x.sentiment)))"
    match = _err("grounding", "'pairs'", "pairs differ from the annotation", f"size({c}.required_pairs) > 0 AND {got} <> array_sort({c}.required_pairs)")
    other = _err("grounding", "'others'", "others differs from the annotation", f"{c}.required_others IS NOT NULL AND NOT coalesce({plan}.others, false) <=> {c}.required_others")
    empty = _err("required", "'pairs'", "a plan needs a pair or others", f"coalesce(size({p}), 0) <= 0 AND NOT coalesce({plan}.others, false)")
    return _all(_err("type", "'pairs'", "pairs is not a list", f"{p} IS NULL"), empty, f"coalesce({_per(p, rules)}, {_NONE})", match, other)


def errors(plan: str = "plan", constraints: str = "constraints", domain: str = "domain", schema_id: str = "schema_id") -> Column:
    """The ordered errors of a plan against its schema's constraints (column names)."""
    bad = _err("domain", "'domain'", "plan belongs to another domain", "true")
    return F.expr(
        f"CASE WHEN NOT coalesce({plan}.domain = {domain}, false) THEN {bad} WHEN {domain} = 'webnlg' THEN {triple_errors(plan, constraints)} WHEN {domain} = 'dart' THEN {cell_errors(plan, constraints, schema_id)} "
        f"WHEN startswith({domain}, 'zebra_') THEN {grid_errors(plan, constraints)} WHEN {domain} = 'visfd' THEN {review_errors(plan, constraints)} ELSE {bad} END"
    )


def language_valid(text: Column) -> Column:
    return F.coalesce((F.trim(text) != "") & ~F.rlike(text, F.lit(FOREIGN_SCRIPT)), F.lit(False))


def text_consistent(plan: Column, text: Column) -> Column:
    """Whether the text mentions every term of the plan."""
    said = lambda t: F.forall(plan_terms(plan), lambda x: let(canonical_text(x), lambda c: contains_phrase(t, c) | (c == "")))
    return let(canonical_text(F.coalesce(text, F.lit(""))), said)


def verify(candidates: DataFrame, schemas: DataFrame, check_script: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """candidates(source_id, candidate: JSON of plan and text) against schemas(source_id, ...): parse_valid, phi_valid,
    factual_consistency, reject_reason (the first that applies), plan, text and errors, and the candidates' columns to keep. A
    candidate without a schema is an error."""
    parsed = F.from_json("candidate", f"plan {PLAN}, text string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    j = candidates.join(schemas.select("source_id", "schema_id", "domain", "constraints"), "source_id", "left").withColumn("_p", parsed)
    j = j.withColumn("domain", F.when(F.col("domain").isNull(), F.raise_error(F.concat(F.lit("no schema for "), "source_id")).cast("string")).otherwise(F.col("domain")))
    j = j.withColumns({"plan": F.col("_p.plan"), "text": F.col("_p.text"), "_broken": F.col("candidate").isNull() | F.col("_p._bad").isNotNull() | F.col("_p").isNull()})
    j = j.withColumn("errors", errors())
    j = j.withColumn("_fields", F.col("plan").isNotNull() & (F.coalesce(F.trim("text"), F.lit("")) != ""))
    script = language_valid(F.col("text")) | (F.col("domain") != "visfd") if check_script else F.lit(True)
    consistent = text_consistent(F.col("plan"), F.col("text"))
    reason = F.when(F.col("_broken"), "json_parse").when(~F.col("_fields"), "required_fields").when(F.size("errors") > 0, F.get("errors", 0)["code"]).when(~script, "language_violation").when(~consistent, "plan_text_inconsistent")
    j = j.withColumn("reject_reason", reason)
    ok = ~F.col("_broken") & F.col("_fields")
    return j.select("source_id", *keep, ok.alias("parse_valid"), (ok & (F.size("errors") == 0)).alias("phi_valid"), F.coalesce(ok & F.col("reject_reason").isNull(), F.lit(False)).alias("factual_consistency"), "reject_reason", "plan", "text", "errors")


def realized_valid(v: str = "validation") -> Column:
    """All flags hold, and the automaton, where there was one, accepted."""
    return F.expr(f"{v}.parse_valid AND {v}.plan_consistent AND {v}.schema_valid AND {v}.required_entities_present AND {v}.required_relations_present AND coalesce({v}.fsa_accepted, true)")

