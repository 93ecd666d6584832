"""Plans as terms, facts, tagged strings and sentences; finite languages of realisations and their automata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canon import canonical_text, clauses, clean, contains_phrase, let
from ..plans.model import ASPECTS, OTHER_ASPECT, SENTIMENTS


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def cells_of(plan: Column) -> Column:
    """An assignment as (category, item, position) sorted by category and item."""
    per = F.transform(F.map_entries(plan["assignment"]), lambda c: F.transform(F.map_entries(c["value"]), lambda x: F.struct(c["key"].alias("category"), x["key"].alias("item"), x["value"].alias("position"))))
    return F.array_sort(F.flatten(per))


def _some(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def entities(plan: Column) -> Column:
    a = F.flatten(F.transform(plan["triples"], lambda t: F.array(t["subject"], t["object"])))
    b = F.flatten(F.transform(plan["fields"], lambda f: F.array(f["row"], f["value"])))
    c = F.flatten(F.transform(cells_of(plan), lambda x: F.array(x["item"], x["position"].cast("string"))))
    d = F.transform(plan["pairs"], lambda p: _lookup(SENTIMENTS)[p["sentiment"]])
    return _terms(F.concat(_some(a), _some(b), _some(c), _some(d)))


def relations(plan: Column) -> Column:
    a = F.transform(plan["triples"], lambda t: t["predicate"])
    b = F.transform(plan["fields"], lambda f: f["column"])
    c = F.transform(cells_of(plan), lambda x: x["category"])
    d = F.transform(plan["pairs"], lambda p: _lookup(ASPECTS)[p["aspect"]])
    e = F.when(plan["others"], F.array(F.lit(OTHER_ASPECT)))
    return _terms(F.concat(_some(a), _some(b), _some(c), _some(d), _some(e)))


def _terms(x: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(x, clean), lambda t: t.isNotNull() & (t != "")))


def plan_terms(plan: Column) -> Column:
    return F.array_union(entities(plan), relations(plan))


def cardinality(plan: Column) -> Column:
    size = lambda x: F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0))
    return size(plan["triples"]) + size(plan["fields"]) + size(cells_of(plan)) + size(plan["pairs"]) + F.coalesce(plan["others"], F.lit(False)).cast("int")


def facts(plan: Column) -> Column:
    """Facts as arrays of terms: triples and cells have three, grid cells four, reviews two and one."""
    kind = "array<array<string>>"
    some = lambda x: F.coalesce(x, F.array().cast(kind))
    a = F.transform(plan["triples"], lambda t: F.array(t["subject"], t["predicate"], t["object"]))
    b = F.transform(plan["fields"], lambda f: F.array(f["row"], f["column"], f["value"]))
    c = F.transform(cells_of(plan), lambda x: F.array(x["category"], x["item"], F.lit("position"), x["position"].cast("string")))
    d = F.transform(plan["pairs"], lambda p: F.array(_lookup(ASPECTS)[p["aspect"]], _lookup(SENTIMENTS)[p["sentiment"]]))
    e = F.when(plan["others"], F.array(F.array(F.lit(OTHER_ASPECT))))
    return F.array_distinct(F.concat(some(a), some(b), some(c), some(d), some(e)))


def canonical_fact(fact: Column) -> Column:
    return F.filter(F.transform(fact, canonical_text), lambda t: t != "")


def fact_mentioned(fact: Column, text_clauses: Column) -> Column:
    """Whether one clause holds all terms of a canonical fact."""
    return (F.size(fact) > 0) & F.exists(text_clauses, lambda c: F.forall(fact, lambda t: contains_phrase(c, t)))


def _sentence(plan: Column, flip: bool) -> Column:
    turn = (lambda x: F.reverse(x)) if flip else (lambda x: x)
    triples = F.array_join(F.transform(turn(plan["triples"]), lambda t: F.concat(t["subject"], F.lit(" "), t["predicate"], F.lit(" "), t["object"], F.lit("."))), " ")
    cells = F.concat(F.array_join(F.transform(turn(plan["fields"]), lambda f: F.concat_ws(" ", f["row"], f["column"], f["value"])), "; "), F.lit("."))
    grid = F.concat(F.array_join(F.transform(turn(cells_of(plan)), lambda x: F.concat_ws(" ", x["category"], x["item"], F.lit("position"), x["position"].cast("string"))), "; "), F.lit("."))
    said = F.transform(turn(plan["pairs"]), lambda p: F.concat(_lookup(ASPECTS)[p["aspect"]], F.lit(" có đánh giá "), _lookup(SENTIMENTS)[p["sentiment"]]))
    other = F.when(plan["others"], F.array(F.lit(OTHER_ASPECT + " cũng được đề cập"))).otherwise(F.array().cast("array<string>"))
    review = F.concat(F.array_join(F.concat(said, other), "; "), F.lit("."))
    return F.when(plan["triples"].isNotNull(), triples).when(plan["fields"].isNotNull(), cells).when(plan["assignment"].isNotNull(), grid).when(plan["pairs"].isNotNull(), review)


def plan_text(plan: Column) -> Column:
    """The template's text of a plan."""
    return _sentence(plan, False)


def realizations(plan: Column) -> Column:
    """The controlled realisations: the template's text first, then that of the reversed order."""
    return F.array_distinct(F.array(_sentence(plan, False), _sentence(plan, True)))


def _quoted(x: Column) -> Column:
    """A JSON string literal in ASCII: other characters by their UTF-16 units."""
    plain = F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    one = lambda c: F.when(F.rlike(c, F.lit(r"^[\x00-\x7F]$")), c).otherwise(units(c))
    return F.when(F.rlike(plain, F.lit(r"[^\x00-\x7F]")), F.array_join(F.transform(F.regexp_extract_all(plain, F.lit("(?s)."), F.lit(0)), one), "")).otherwise(plain)


def serialize(plan: Column) -> Column:
    """A plan as one tagged string."""
    triples = F.transform(plan["triples"], lambda t: F.concat(F.lit("<triple subject="), _quoted(t["subject"]), F.lit(" predicate="), _quoted(t["predicate"]), F.lit(" object="), _quoted(t["object"]), F.lit(">")))
    cells = F.transform(plan["fields"], lambda f: F.concat(F.lit("<field row="), _quoted(f["row"]), F.lit(" column="), _quoted(f["column"]), F.lit(" value="), _quoted(f["value"]), F.lit(">")))
    grid = F.transform(cells_of(plan), lambda x: F.concat(F.lit("<assign category="), _quoted(x["category"]), F.lit(" item="), _quoted(x["item"]), F.lit(" position="), x["position"].cast("string"), F.lit(">")))
    pairs = F.transform(plan["pairs"], lambda p: F.concat(F.lit("<aspect="), _quoted(p["aspect"]), F.lit(" sentiment="), _quoted(p["sentiment"]), F.lit(">")))
    other = F.when(plan["others"], F.array(F.lit("<others=true>")))
    atoms = F.concat(_some(triples), _some(cells), _some(grid), _some(pairs), _some(other))
    return F.concat_ws(" ", F.concat(F.lit("<domain="), plan["domain"], F.lit(">")), F.array_join(atoms, " "))


# What a student is asked, around the serialised plan; reviews are asked for in Vietnamese.
ASK = ("Realize the semantic plan faithfully.\nPlan: ", "\nText:")
ASK_REVIEW = (
    "Hãy hiện thực hóa kế hoạch ngữ nghĩa sau thành một đánh giá điện thoại bằng tiếng Việt. "
    "Chỉ trả về nội dung đánh giá bằng tiếng Việt, không giải thích và không dùng ngôn ngữ khác.\nKế hoạch: ",
    "\nĐánh giá:",
)


def student_prompt(plan: Column) -> Column:
    """What training and generation ask for a plan."""
    asked = lambda ask: F.concat(F.lit(ask[0]), serialize(plan), F.lit(ask[1]))
    return F.when(plan["domain"] == "visfd", asked(ASK_REVIEW)).otherwise(asked(ASK))


def training_example(plan: Column, text: Column) -> Column:
    """Prompt and target of a student's training row; generation uses the same prompt."""
    return F.struct(student_prompt(plan).alias("prompt"), text.alias("target"))


def prompt(plan: Column, schema_id: Column, constraints: Column) -> Column:
    """The instruction for a model that proposes a candidate, as one JSON object."""
    ask = "Return one JSON object with the keys plan and text; the plan must satisfy the schema and the text must mention every term."
    return F.to_json(F.struct(constraints.alias("constraints"), F.lit(ask).alias("instruction"), plan.alias("reference_plan"), schema_id.alias("schema_id")))


def tokens(text: Column) -> Column:
    """A stand-in tokenizer: words by single blanks."""
    return F.split(text, " ")


EOS = "</s>"


def accepts(plan: Column, seq: Column) -> Column:
    """Whether a token sequence ending in EOS is one of the plan's realisations. The language is finite, so this is
    membership."""
    return F.exists(realizations(plan), lambda r: F.concat(tokens(r), F.array(F.lit(EOS))) == seq)


def automaton(sequences: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The trie of the sequences of a key as edges (state, token, next): states are prefixes, named by their digest; the
    empty prefix begins; complete sequences have an EOS edge."""
    full = sequences.select(*key, F.concat(F.col(seq), F.array(F.lit(EOS))).alias("_s"))
    name = lambda x: F.when(F.size(x) == 0, F.lit("")).otherwise(F.substring(F.sha2(F.to_json(x), 256), 1, 16))
    steps = full.select(*key, "_s", F.explode(F.sequence(F.lit(1), F.size("_s"))).alias("_i"))
    prefix = F.slice("_s", F.lit(1), F.col("_i") - 1)
    return steps.select(*key, name(prefix).alias("state"), F.element_at("_s", F.col("_i")).alias("token"), name(F.slice("_s", F.lit(1), F.col("_i"))).alias("next")).distinct()


def next_tokens(edges: DataFrame, state: str) -> DataFrame:
    return edges.filter(F.col("state") == state).select("token").distinct()


def run_automaton(edges: DataFrame, seq: list[str]) -> str | None:
    """The state after a sequence, or None where a step is illegal: states are named by their prefixes, so one join holds all
    steps against the edges. For many sequences use ``accepts``."""
    if not seq:
        return ""
    spark = edges.sparkSession
    name = lambda x: F.when(F.size(x) == 0, F.lit("")).otherwise(F.substring(F.sha2(F.to_json(x), 256), 1, 16))
    one = spark.createDataFrame([(seq,)], "_s array<string>").select("_s", F.explode(F.sequence(F.lit(1), F.size("_s"))).alias("_i"))
    steps = one.select("_i", name(F.slice("_s", F.lit(1), F.col("_i") - 1)).alias("state"), F.element_at("_s", F.col("_i")).alias("token"), name(F.slice("_s", F.lit(1), F.col("_i"))).alias("next"))
    met = edges.select("state", "token", "next").join(F.broadcast(steps), ["state", "token", "next"]).select("_i", "next").distinct().collect()
    return max(met)[1] if len(met) == len(seq) else None


def dead_ends(sequences: DataFrame, key: list[str], edges: DataFrame, seq: str = "seq") -> DataFrame:
    """Where sequences leave their key's automaton: key, ``step`` (from 0), ``token``, ``state`` and the ``legal`` tokens there,
    sorted, for each sequence's first illegal step; sequences that are accepted or merely break off have no row. Keys of
    sequences are unique; a state's legal tokens are as few as the plan's realisations."""
    name = lambda x: F.when(F.size(x) == 0, F.lit("")).otherwise(F.substring(F.sha2(F.to_json(x), 256), 1, 16))
    steps = sequences.select(*key, F.col(seq).alias("_s")).withColumn("_i", F.explode(F.sequence(F.lit(1), F.greatest(F.size("_s"), F.lit(1)))))
    steps = steps.filter(F.col("_i") <= F.size("_s")).select(*key, (F.col("_i") - 1).alias("step"), name(F.slice("_s", F.lit(1), F.col("_i") - 1)).alias("state"), F.element_at("_s", F.col("_i")).alias("token"))
    legal = edges.groupBy(*key, "state").agg(F.array_sort(F.collect_set("token")).alias("legal"))
    # the first step that its state does not list; every state before it is one of the automaton's
    wrong = steps.join(legal, [*key, "state"], "left").filter(~F.coalesce(F.array_contains("legal", F.col("token")), F.lit(False)))
    first = wrong.groupBy(*key).agg(F.min_by(F.struct("step", "token", "state", "legal"), "step").alias("_f"))
    return first.select(*key, "_f.step", "_f.token", "_f.state", F.coalesce("_f.legal", F.array().cast("array<string>")).alias("legal"))


def post_validation(plan: Column, text: Column, schema_valid: Column, fsa_accepted: Column) -> Column:
    """The validation struct of a generated text; terms are looked for in the canonical text."""
    whole = canonical_text(F.coalesce(text, F.lit("")))
    has = lambda xs: let(whole, lambda t: F.forall(xs, lambda x: let(canonical_text(x), lambda c: contains_phrase(t, c) | (c == ""))))
    e, r = has(entities(plan)), has(relations(plan))
    return F.struct((F.trim(text) != "").alias("parse_valid"), (e & r).alias("plan_consistent"), schema_valid.alias("schema_valid"), e.alias("required_entities_present"), r.alias("required_relations_present"), fsa_accepted.cast("boolean").alias("fsa_accepted"))


def text_clauses(text: Column) -> Column:
    """Canonical clauses; the whole text where there is none."""
    c = clauses(text)
    return F.when(F.size(c) > 0, c).otherwise(F.filter(F.array(canonical_text(F.coalesce(text, F.lit("")))), lambda x: x != ""))
