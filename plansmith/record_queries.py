"""Further registered queries: realisation of every family, prompts, answers, retries, automata, and the checks of outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import allocation as A
from .functions import canon as C
from .functions import metrics as M
from .operators import attempts, circuit, evaluate, grids, realize, records, salvage, sampling, validate
from .plans.model import GRID_SHAPES, PLAN, empty_plan
from .queries import _FEATURES_SQL, _JSON, _PART, _SPACE_SQL, _STATES_SQL, SEED, _order_space, line_records, order_features, order_states, part_outputs, part_records, query, t


def label_records(spark, d):
    """Labels as review records; the quality stands for the stars."""
    x = t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), F.expr(_LABEL).alias("label"), F.col("quality").cast("int").alias("n_star"))
    return records.normalize(x, "visfd", F.lit("train"))


_LABEL = "concat('{screen#', CASE quality WHEN 1 THEN 'positive' ELSE 'NEGATIVE' END, '};{BATTERY# ', CASE toxic WHEN 1 THEN 'Negative' ELSE 'neutral' END, '};', CASE WHEN doc_id % 3 = 0 THEN '{OTHERS};' ELSE '' END)"
_REVIEW = """SELECT doc_id, 'visfd:train:' || doc_id AS source_id, quality, doc_id % 3 = 0 AS others, CASE toxic WHEN 1 THEN 'Negative' ELSE 'Neutral' END AS b, CASE quality WHEN 1 THEN 'Positive' ELSE 'Negative' END AS s,
CASE toxic WHEN 1 THEN 'tiêu cực' ELSE 'trung tính' END AS vb, CASE quality WHEN 1 THEN 'tích cực' ELSE 'tiêu cực' END AS vs FROM labels"""
_REVIEW_TEXT = "'pin có đánh giá ' || vb || '; màn hình có đánh giá ' || vs || CASE WHEN others THEN '; khía cạnh khác cũng được đề cập' ELSE '' END || '.'"
_REVIEW_TAGGED = """'<domain=visfd> <aspect="BATTERY" sentiment="' || b || '"> <aspect="SCREEN" sentiment="' || s || '">' || CASE WHEN others THEN ' <others=true>' ELSE '' END"""


def _plan_columns(df):
    p = F.col("reference_plan")
    return df.select(
        "source_id",
        realize.plan_text(p).alias("text"),
        realize.serialize(p).alias("tagged"),
        F.array_join(realize.entities(p), "|").alias("entities"),
        F.array_join(realize.relations(p), "|").alias("relations"),
        F.size(realize.facts(p)).alias("facts"),
        realize.cardinality(p).alias("cardinality"),
        F.size(realize.realizations(p)).alias("realizations"),
    )


@query(f"""SELECT source_id, {_REVIEW_TEXT} AS text, {_REVIEW_TAGGED} AS tagged, CASE WHEN vb = vs THEN vb ELSE vb || '|' || vs END AS entities,
'pin|màn hình' || CASE WHEN others THEN '|khía cạnh khác' ELSE '' END AS relations, 2 + CAST(others AS INT) AS facts, 2 + CAST(others AS INT) AS cardinality, 2 AS realizations FROM ({_REVIEW})""")
def review_plans(spark, d):
    """Reviews' plans as texts, tagged strings, terms and facts."""
    return _plan_columns(label_records(spark, d))


_LINE = "SELECT l_orderkey || '-' || l_linenumber AS n, l_returnflag AS f, l_linestatus AS s, CAST(CAST(trunc(l_quantity) AS INT) AS VARCHAR) AS q FROM lineitem"


@query(f"""SELECT 'dart:train:' || n AS source_id, n || ' flag ' || f || '; ' || n || ' status ' || s || '; ' || n || ' quantity ' || q || '.' AS text,
'<domain=dart> <field row="' || n || '" column="flag" value="' || f || '"> <field row="' || n || '" column="status" value="' || s || '"> <field row="' || n || '" column="quantity" value="' || q || '">' AS tagged,
array_to_string(list_filter([n, f, CASE WHEN s <> f THEN s END, q], lambda x: x IS NOT NULL), '|') AS entities, 'flag|status|quantity' AS relations, 3 AS facts, 3 AS cardinality, 2 AS realizations FROM ({_LINE})""")
def cell_plans(spark, d):
    """Cell records' plans as texts, tagged strings, terms and facts."""
    return _plan_columns(line_records(spark, d))


def customer_grids(spark, d):
    """Each customer and a friend on two places, as raw grids."""
    c = t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("a"), F.concat("c_name", F.lit("'s friend")).alias("b"))
    first, second = F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0), F.when(F.col("c_custkey") % 3 == 0, 0).otherwise(1)
    ref = lambda x: F.struct(F.lit("who").alias("category"), x.alias("item")).cast("struct<category:string,item:string>")
    clue = lambda kind, x, y, p: F.struct(F.lit(kind).alias("type"), ref(x).alias("left"), y.cast("struct<category:string,item:string>").alias("right"), p.cast("int").alias("position"))
    clues = F.array(clue("fixed_position", F.col("a"), F.lit(None), first), clue("inequality", F.col("a"), ref(F.col("b")), F.lit(None)))
    raw = c.select(F.col("c_custkey").cast("string").alias("id"), F.lit("easy").alias("difficulty"), F.create_map(F.lit("who"), F.array("a", "b")).alias("categories"), clues.alias("clues"), F.create_map(F.lit("who"), F.create_map("a", first, "b", second)).alias("assignment"))
    return records.normalize(raw, "zebralogic", F.lit("train"))


_GRID = "SELECT 'zebralogic:train:' || c_custkey AS source_id, c_name AS a, c_name || '''s friend' AS b, CASE WHEN c_custkey % 3 = 0 THEN '1' ELSE '0' END AS x, CASE WHEN c_custkey % 3 = 0 THEN '0' ELSE '1' END AS y FROM customer"


@query(f"""SELECT source_id, 'who ' || a || ' position ' || x || '; who ' || b || ' position ' || y || '.' AS text,
'<domain=zebra_easy> <assign category="who" item="' || a || '" position=' || x || '> <assign category="who" item="' || b || '" position=' || y || '>' AS tagged,
a || '|' || x || '|' || b || '|' || y AS entities, 'who' AS relations, 2 AS facts, 2 AS cardinality, 2 AS realizations FROM ({_GRID})""")
def grid_plans(spark, d):
    """Grids' plans as texts, tagged strings, terms and facts."""
    return _plan_columns(customer_grids(spark, d))


@query(f"""SELECT source_id, sha256('Hãy hiện thực hóa kế hoạch ngữ nghĩa sau thành một đánh giá điện thoại bằng tiếng Việt. Chỉ trả về nội dung đánh giá bằng tiếng Việt, không giải thích và không dùng ngôn ngữ khác.' || chr(10) || 'Kế hoạch: ' || {_REVIEW_TAGGED} || chr(10) || 'Đánh giá:') AS prompt_sha, {_REVIEW_TEXT} AS target FROM ({_REVIEW})
UNION ALL SELECT source_id, sha256('Realize the semantic plan faithfully.' || chr(10) || 'Plan: <domain=zebra_easy> <assign category="who" item="' || a || '" position=' || x || '> <assign category="who" item="' || b || '" position=' || y || '>' || chr(10) || 'Text:'), 'who ' || a || ' position ' || x || '; who ' || b || ' position ' || y || '.' FROM ({_GRID})""")
def training_rows(spark, d):
    """Prompts and targets of a student, of reviews and grids."""
    r = label_records(spark, d).unionByName(customer_grids(spark, d))
    e = realize.training_example(F.col("reference_plan"), realize.plan_text(F.col("reference_plan")))
    return r.select("source_id", e.alias("e")).select("source_id", C.sha256("e.prompt").alias("prompt_sha"), "e.target")


@query("""SELECT dataset, domain, official_split, "group", count(*) AS n FROM (
SELECT 'visfd' AS dataset, 'visfd' AS domain, 'train' AS official_split, 'star_' || CAST(quality AS INT) AS "group" FROM labels UNION ALL
SELECT 'webnlg', 'webnlg', 'train', 'part' FROM part UNION ALL SELECT 'dart', 'dart', 'train', 'lines' FROM lineitem UNION ALL SELECT 'zebralogic', 'zebra_easy', 'train', 'Easy' FROM customer) GROUP BY ALL""")
def record_groups(spark, d):
    """How many records each dataset, domain, split and group of the reports has, of all families."""
    r = label_records(spark, d).unionByName(part_records(spark, d)).unionByName(line_records(spark, d)).unionByName(customer_grids(spark, d))
    group = records.record_group(F.col("domain"), F.col("category"), F.col("source"), F.col("n_star"))
    return r.groupBy(records.dataset_name(F.col("domain")).alias("dataset"), "domain", "official_split", group.alias("group")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, (['train', 'validation', 'validation', 'validation', 'test'])[CAST(o_orderkey % 5 AS INT) + 1] AS split, o_orderkey % 5 = 4 AS held_out FROM orders WHERE o_orderkey % 5 NOT IN (1, 2)""")
def split_names(spark, d):
    """Names of splits as given, brought into one form; two of the five given forms are not on the whitelist."""
    forms = F.array(*map(F.lit, (" Train ", "dev", "VAL", "valid", "test")))
    o = t(spark, d, "orders").select("o_orderkey", F.element_at(forms, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("given"))
    o = sampling.whitelisted(o, "given", [" Train ", "valid", "test"])
    return o.select("o_orderkey", records.split_name("given").alias("split")).withColumn("held_out", F.col("split") == "test")


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN c_name WHEN 2 THEN c_name || ' lex' WHEN 3 THEN c_name || ' out' ELSE '' END AS text FROM customer""")
def reference_texts(spark, d):
    """A reference text from whichever of a row's keys holds one: a string, or the first element of a list."""
    c, k = t(spark, d, "customer").select("c_custkey", "c_name"), F.col("c_custkey") % 5
    given = c.select(
        "c_custkey",
        F.when(k == 0, F.concat(F.lit("  "), "c_name", F.lit("\n"))).otherwise(F.when(k != 4, F.lit("  "))).alias("comment"),
        F.when(k == 1, F.array(F.concat("c_name", F.lit(" ")), F.lit("second"))).alias("references"),
        F.when(k == 2, F.array(F.concat("c_name", F.lit("  lex")))).alias("lex"),
        F.when(k == 3, F.concat("c_name", F.lit(" out"))).alias("output"),
    )
    return given.select("c_custkey", records.reference_text(given).alias("text"))


_SAID = "regexp_replace(regexp_replace(text, '^[\\t-\\r\\x1c-\\x20\\x85\\xa0]+', ''), '[\\t-\\r\\x1c-\\x20\\x85\\xa0]+$', '')"


@query(f"""SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN sha256('') ELSE sha256({_SAID}) END AS said_sha, b AS battery, others
FROM documents JOIN ({_REVIEW}) USING (doc_id) WHERE text IS NOT NULL""")
def attached_plans(spark, d):
    """Whole documents as a model's answers on reviews of known plans: under several keys, fenced, without an object, broken."""
    x = t(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text")
    r = label_records(spark, d).select(F.substring_index("source_id", ":", -1).cast("long").alias("doc_id"), F.col("reference_plan").alias("plan"))
    k = F.col("doc_id") % 5
    # without braces the whole is no object: a document that begins with one would be none either
    raw = (
        F.when(k == 0, F.to_json(F.struct(F.lit(" ").alias("text"), F.col("text").alias("review"), F.lit("x").alias("output"))))
        .when(k == 1, F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("text").alias("response"), F.array(F.lit(1)).alias("comment"))), F.lit("\n```")))
        .when(k == 2, F.to_json(F.struct(F.col("text").alias("output"))))
        .when(k == 3, F.concat(F.lit('{"text": '), F.to_json(F.array("text"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("text"))))
    )
    made = x.join(r, "doc_id").select("doc_id", F.from_json(salvage.attached(raw, F.col("plan")), f"plan {PLAN}, text string").alias("m"))
    return made.select("doc_id", C.sha256("m.text").alias("said_sha"), F.col("m.plan.pairs")[0]["sentiment"].alias("battery"), F.col("m.plan.others").alias("others"))


@query("""SELECT 'webnlg:train:' || p_partkey AS source_id, p_partkey % 5 < 3 AS usable, CASE WHEN p_partkey % 5 < 2 THEN p_name WHEN p_partkey % 5 = 2 THEN '' END AS text FROM part""")
def answer_shapes(spark, d):
    """Answers of several shapes: plan and text, the same in a fence with words around it, a plan alone, triples that are no
    list, and no object."""
    r, k = part_records(spark, d), F.substring_index("source_id", ":", -1).cast("long") % 5
    x = r.join(t(spark, d, "part").select(F.concat(F.lit("webnlg:train:"), F.col("p_partkey").cast("string")).alias("source_id"), "p_name"), "source_id")
    both = F.to_json(F.struct(F.col("reference_plan").alias("plan"), F.col("p_name").alias("text")))
    raw = (
        F.when(k == 0, both)
        .when(k == 1, F.concat(F.lit("Here it is:\n```json\n"), both, F.lit("\n``` {end")))
        .when(k == 2, F.to_json("reference_plan"))
        .when(k == 3, F.lit('{"plan": {"triples": "none"}, "text": "x"}'))
        .otherwise(F.lit("[1, 2"))
    )
    made = salvage.normalised(raw, F.lit("webnlg"), F.col("schema_id"))
    return x.select("source_id", made.alias("m")).select("source_id", (F.col("m") != "null").alias("usable"), F.get_json_object("m", "$.text").alias("text"))


# --- retries ------------------------------------------------------------------------------------------------------------


def part_tries(spark, d):
    """Three tries at each part by key: the first holds, the second, the third, none; tries fail for different reasons."""
    r = part_records(spark, d)
    k = F.substring_index("source_id", ":", -1).cast("long") % 4
    x = r.withColumn("retry", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("seed", attempts.retry_seed(F.lit(7), F.col("retry")))
    text = realize.plan_text(F.col("reference_plan"))
    good = F.to_json(F.struct(F.col("reference_plan").alias("plan"), text.alias("text")))
    unlike = F.to_json(F.struct(F.col("reference_plan").alias("plan"), F.lit("nothing here").alias("text")))
    made = F.when(F.col("retry") >= k, good).when(F.col("seed") == 7, F.lit("broken {")).otherwise(unlike)
    c = x.select("source_id", "retry", made.alias("candidate"))
    checked = validate.verify(c, records.infer_schema(r), keep=("retry", "candidate"))
    resolved = attempts.resolve(checked, ["source_id"])
    return attempts.with_fallback(r.select("source_id", "domain", "reference_plan").join(resolved, "source_id"))


_WHY = "list_slice(['json_parse', 'plan_text_inconsistent', 'plan_text_inconsistent'], 1, CAST(p_partkey % 4 AS INT))"


@query(f"""WITH p AS (SELECT p_partkey, p_name || '#' || p_partkey AS s, p_brand AS b, p_size::VARCHAR AS z, p_type AS ty FROM part)
SELECT 'webnlg:train:' || p_partkey AS source_id, CAST(least(p_partkey % 4 + 1, 3) AS INT) AS attempts, array_to_string({_WHY}, ',') AS reasons, p_partkey % 4 = 3 AS fallback,
s || ' brand ' || b || '. ' || s || ' size ' || z || '. ' || s || ' type ' || ty || '.' AS text FROM p""")
def attempt_outcomes(spark, d):
    """Of each part's tries the first that holds, else the template; why the tries before it failed."""
    return part_tries(spark, d).select("source_id", "attempts", F.array_join("reasons", ",").alias("reasons"), "fallback", F.get_json_object("candidate", "$.text").alias("text"))


@query("""SELECT 'webnlg' AS domain, count(*) AS candidates, count(*) FILTER (p_partkey % 4 = 3) AS fallbacks, CAST(sum(least(p_partkey % 4, 2)) AS BIGINT) AS retries, CAST(sum(p_partkey % 4) AS BIGINT) AS rejected FROM part""")
def quota_totals(spark, d):
    return attempts.totals(part_tries(spark, d))


@query(f"SELECT 'webnlg' AS domain, reason, count(*) AS n FROM (SELECT unnest({_WHY}) AS reason FROM part) GROUP BY reason")
def attempt_reasons(spark, d):
    return attempts.reasons(part_tries(spark, d))


# --- automata -----------------------------------------------------------------------------------------------------------

_TWO = f"""p AS ({_PART}), s AS (SELECT p_partkey, string_split(s || ' brand ' || b || '. ' || s || ' size ' || z || '. ' || s || ' type ' || ty || '.', ' ') || ['</s>'] AS a,
string_split(s || ' type ' || ty || '. ' || s || ' size ' || z || '. ' || s || ' brand ' || b || '.', ' ') || ['</s>'] AS b FROM p)"""


def part_automata(spark, d):
    r = part_records(spark, d).select("source_id", F.explode(realize.realizations(F.col("reference_plan"))).alias("_t"))
    return realize.automaton(r.select("source_id", realize.tokens(F.col("_t")).alias("seq")), ["source_id"])


@query(f"""WITH {_TWO}, e AS (SELECT p_partkey, list_slice(q, 1, i - 1) AS state, q[i] AS token FROM (SELECT p_partkey, q, unnest(range(1, len(q) + 1)) AS i FROM (SELECT p_partkey, a AS q FROM s UNION ALL SELECT p_partkey, b FROM s)))
SELECT 'webnlg:train:' || p_partkey AS source_id, count(DISTINCT state) AS states, count(DISTINCT {{'s': state, 't': token}}) AS edges, count(DISTINCT {{'s': state, 't': token}}) FILTER (token = '</s>') AS ends FROM e GROUP BY p_partkey""")
def automata(spark, d):
    """The automaton of each part's realisations: states that go on, edges, and how many realisations end."""
    e = part_automata(spark, d)
    return e.groupBy("source_id").agg(F.count_distinct("state").alias("states"), F.count(F.lit(1)).alias("edges"), F.count_if(F.col("token") == realize.EOS).alias("ends"))


@query(f"""WITH {_TWO}, w AS (SELECT p_partkey, a, b, CASE p_partkey % 3 WHEN 1 THEN 1 ELSE len(a) END AS i FROM s WHERE p_partkey % 3 <> 0)
SELECT 'webnlg:train:' || p_partkey AS source_id, CAST(i - 1 AS INT) AS step, CASE WHEN p_partkey % 3 = 1 THEN 'zz' ELSE 'more' END AS token,
array_to_string(list_sort(list_distinct(list_filter([a[i], CASE WHEN list_slice(a, 1, i - 1) = list_slice(b, 1, i - 1) THEN b[i] END], lambda x: x IS NOT NULL))), ' ') AS legal FROM w""")
def dead_ends(spark, d):
    """Sequences that leave their automaton, by key: not at all, at the first token, and where they should have ended."""
    r = part_records(spark, d)
    words, k = realize.tokens(realize.plan_text(F.col("reference_plan"))), F.substring_index("source_id", ":", -1).cast("long") % 3
    seq = F.when(k == 1, F.concat(F.array(F.lit("zz")), words)).when(k == 2, F.concat(words, F.array(F.lit("more"), F.lit(realize.EOS)))).otherwise(F.concat(words, F.array(F.lit(realize.EOS))))
    out = realize.dead_ends(r.select("source_id", seq.alias("seq")), ["source_id"], part_automata(spark, d))
    return out.select("source_id", "step", "token", F.array_join("legal", " ").alias("legal"))


# --- outputs ------------------------------------------------------------------------------------------------------------


@query("""SELECT v || '/webnlg:train:' || p_partkey AS output_id, ok AS entities, ok AS relations, ok AS consistent, ok AS fsa, ok AS valid FROM (SELECT v, p_partkey, NOT (v = 'free' AND p_partkey % 2 = 1) AS ok FROM part, (VALUES ('constrained'), ('free')) x(v))""")
def output_flags(spark, d):
    """What holds of each output after generation: a text without its first sentence lacks a term, a relation and a realisation."""
    o = part_outputs(spark, d)
    words = F.concat(realize.tokens(F.col("text")), F.array(F.lit(realize.EOS)))
    o = o.withColumn("validation", realize.post_validation(F.col("plan"), F.col("text"), F.lit(True), realize.accepts(F.col("plan"), words)))
    v = "validation."
    return o.select("output_id", F.col(v + "required_entities_present").alias("entities"), F.col(v + "required_relations_present").alias("relations"), F.col(v + "plan_consistent").alias("consistent"), F.col(v + "fsa_accepted").alias("fsa"), validate.realized_valid().alias("valid"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS term_precision FROM customer""")
def term_precision(spark, d):
    """Of the vocabulary's terms that a text mentions, the share of its plan: all, all but one, and none mentioned."""
    c = t(spark, d, "customer").select("c_custkey", "c_name")
    triples = F.array(F.struct(F.col("c_name").alias("subject"), F.lit("lives in").alias("predicate"), F.lit("house").alias("object"), F.lit(None).cast("string").alias("subject_type"), F.lit(None).cast("string").alias("object_type")))
    k, text = F.col("c_custkey") % 3, F.concat_ws(" ", "c_name", F.lit("lives in house"))
    said = F.when(k == 0, text).when(k == 1, F.concat(text, F.lit("; not in a garden."))).otherwise(F.lit("nothing"))
    o = c.withColumn("_t", triples).withColumn("plan", F.expr(empty_plan(domain="'webnlg'", triples="_t"))).select("c_custkey", "plan", said.alias("text"))
    terms = o.select(F.explode(realize.plan_terms(F.col("plan"))).alias("term")).unionByName(spark.createDataFrame([("Garden",)], "term string")).distinct()
    return evaluate.term_precision(o, "c_custkey", terms)


@query("""SELECT family, domain, count(*) AS features FROM (
SELECT 'domain' AS family, o_orderstatus AS domain, o_orderstatus AS f FROM orders GROUP BY ALL UNION ALL SELECT 'attribute', o_orderstatus, o_orderpriority FROM orders GROUP BY ALL UNION ALL SELECT 'relation', o_orderstatus, month(o_orderdate)::VARCHAR FROM orders GROUP BY ALL) GROUP BY ALL""")
def feature_domains(spark, d):
    """The domain that each feature belongs to."""
    f = order_features(order_states(spark, d)).select("feature").distinct()
    return f.groupBy(F.split_part("feature", F.lit(":"), F.lit(1)).alias("family"), evaluate.feature_domain(F.col("feature")).alias("domain")).agg(F.count(F.lit(1)).alias("features"))


@query(f"WITH {_STATES_SQL} SELECT priority || '/' || month AS plan_key, round(sum(p), 10) AS p FROM st GROUP BY ALL")
def plan_probabilities(spark, d):
    """Of each plan the probability of all its states."""
    s = order_states(spark, d).withColumn("plan_key", F.concat_ws("/", "priority", "month"))
    return circuit.plan_probabilities(s).select("plan_key", F.round("p", 10).alias("p"))


@query(f"""WITH {_STATES_SQL}, m AS (SELECT sum(p) FILTER (month = 2) AS m, sum(p) AS z FROM st), g AS (SELECT m / z AS m, least(1.25 * m / z, m / z + 0.02) AS t FROM m)
SELECT state_id, round(CASE WHEN month = 2 THEN p * t / m ELSE p * (1 - t) / (1 - m) END, 6) AS p FROM st, g""")
def project_one(spark, d):
    """The projection onto one raised marginal, which has a closed form."""
    s = order_states(spark, d)
    f = s.filter("month = 2").select("state_id", F.lit("february").alias("feature"))
    goal = circuit.marginals(s, f).select("feature", F.col("marginal").alias("base"), F.least(F.col("marginal") * 1.25, F.col("marginal") + 0.02).alias("target"))
    return circuit.project(s, f, goal, 1e-8).states.select("state_id", F.round("p", 6).alias("p"))


@query(f"""WITH {_STATES_SQL}, r AS (SELECT 'rare_pair:' || state_id AS feature, p FROM st) SELECT feature, round(p, 12) AS base, round(least(p * 1.25, p + 0.02, 1 - 1e-8), 12) AS target FROM r ORDER BY p, feature LIMIT 32""")
def projection_targets(spark, d):
    """The lightest pairs, raised: what a projection aims at where nothing is given."""
    s = order_states(spark, d)
    m = s.select(F.concat(F.lit("rare_pair:"), "state_id").alias("feature"), F.col("p").alias("marginal"))
    return circuit.targets(m).select("feature", F.round("base", 12).alias("base"), F.round("target", 12).alias("target"))


@query("""SELECT source_id, CAST(n AS INT) AS variables, CAST(c AS INT) AS clauses FROM (
SELECT 'visfd:train:' || doc_id AS source_id, 10 * 3 + 1 AS n, 10 * (3 + 3) + 1 AS c FROM labels UNION ALL SELECT 'webnlg:train:' || p_partkey, 3, 1 FROM part UNION ALL
SELECT 'dart:train:' || l_orderkey || '-' || l_linenumber, 3, 3 FROM lineitem UNION ALL SELECT 'zebralogic:train:' || c_custkey, 2 * 2, 2 * 2 + 2 * 2 + 1 FROM customer)""")
def normal_forms(spark, d):
    """The rules of every record of all families as clauses: how many variables and clauses."""
    r = label_records(spark, d).unionByName(part_records(spark, d)).unionByName(line_records(spark, d)).unionByName(customer_grids(spark, d))
    s = r.select("source_id", "domain", records.constraints().alias("constraints"))
    return grids.normal_forms(s, "source_id").select("source_id", "variables", "clauses")


@query(f"""SELECT source_id, 'BATTERY/' || b || ',SCREEN/' || s AS pairs, others AS required_others, 10 AS aspects, 2 AS cardinality FROM ({_REVIEW})""")
def review_schemas(spark, d):
    """The schema that each review's annotation implies."""
    s, c = records.infer_schema(label_records(spark, d)), F.col("constraints")
    return s.select("source_id", F.array_join(F.transform(c["required_pairs"], lambda x: F.array_join(x, "/")), ",").alias("pairs"), c["required_others"].alias("required_others"), F.size(c["allowed_aspects"]).alias("aspects"), c["cardinality"][0].alias("cardinality"))


@query(f"""SELECT 'dart:train:' || n AS source_id, 'flag,quantity,status' AS columns, f AS flags, q AS quantities, 3 AS low, 3 AS high, n || '/status/' || s AS second FROM ({_LINE})""")
def cell_schemas(spark, d):
    """The schema that each cell record implies."""
    r = line_records(spark, d).select("source_id", records.constraints("dart").alias("c"))
    v = F.col("c.allowed_values")
    return r.select("source_id", F.array_join("c.allowed_columns", ",").alias("columns"), F.array_join(v["flag"], ",").alias("flags"), F.array_join(v["quantity"], ",").alias("quantities"), F.col("c.cardinality")[0].alias("low"), F.col("c.cardinality")[1].alias("high"), F.array_join(F.col("c.allowed_cells")[1], "/").alias("second"))


@query("""WITH n AS (SELECT count(*) AS n FROM orders), s AS (SELECT CAST(ceil(n * 3 / 64.0) AS BIGINT) AS s FROM n)
SELECT CAST(step AS BIGINT) AS step, step = s AS last FROM (SELECT DISTINCT unnest(list_concat(range(500, s + 1, 500), [7, s])) AS step, s FROM s) WHERE step <= s""")
def checkpoint_plan(spark, d):
    """After which steps of a training over all orders a checkpoint is due."""
    steps = A.optimizer_steps(t(spark, d, "orders").count(), 3, 4, 16)
    return spark.createDataFrame([(s, s == steps) for s in A.checkpoint_steps(steps, 500, [7, 1 << 40])], "step long, last boolean")


@query("""WITH w AS (SELECT o_orderstatus AS domain, count(*) AS n FROM orders GROUP BY ALL), total AS (SELECT CAST(floor(sum(n) * 0.1 + 0.5) AS BIGINT) AS t FROM w),
b AS (SELECT domain, n, (t - 25) * n / sum(n) OVER () AS raw, floor((t - 25) * n / sum(n) OVER ()) AS base, t FROM w, total WHERE domain <> 'P')
SELECT domain, CAST(base + CASE WHEN row_number() OVER (ORDER BY raw - base DESC, domain) <= t - 25 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM b UNION ALL SELECT 'P', 25""")
def fixed_quotas(spark, d):
    """Quotas of a tenth of all orders: one is given, the others share the rest."""
    n = {r["domain"]: r["n"] for r in t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("domain")).agg(F.count(F.lit(1)).alias("n")).orderBy("domain").collect()}
    return spark.createDataFrame(sorted(A.quotas(A.half_up_count(sum(n.values()), 0.1), n, {"P": 25}).items()), "domain string, quota long")


@query("""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS attempt FROM orders""")
def attempt_numbers(spark, d):
    """A row's number within its source."""
    return sampling.rotation(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").select("o_orderkey", "attempt")


@query("""SELECT event_type, round(avg(CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END), 9) AS rare_coverage FROM (SELECT e.event_type, h.h, count(x.event_id) AS k FROM (SELECT DISTINCT event_type FROM events) e CROSS JOIN range(24) h(h)
LEFT JOIN (SELECT * FROM events WHERE day(ts) = 3) x ON x.event_type = e.event_type AND hour(x.ts) = h.h GROUP BY ALL) GROUP BY event_type""")
def rare_coverage(spark, d):
    """Of the hours of a day, the share in which each type of event occurs on the third."""
    e = t(spark, d, "events").select("event_type", F.hour("ts").alias("h"), (F.dayofmonth("ts") == 3).alias("on"))
    seen = e.filter("on").groupBy("event_type", "h").agg(F.count(F.lit(1)).alias("k"))
    every = e.select("event_type").distinct().withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return every.join(seen, ["event_type", "h"], "left").groupBy("event_type").agg(F.round(M.rare_coverage(F.coalesce("k", F.lit(0))), 9).alias("rare_coverage"))


@query(f"""SELECT doc_id, sha256('{{"lang":' || CASE WHEN lang IS NULL THEN 'null' ELSE {_JSON.format('lang')} END || ',"n":' || length(text) || '}}') AS digest FROM documents""")
def row_digests(spark, d):
    """Digests of rows as canonical JSON."""
    x = t(spark, d, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    return x.select("doc_id", C.sha256(F.to_json(F.struct("lang", "n"), {"ignoreNullFields": "false"})).alias("digest"))


@query(f"""WITH {_STATES_SQL}, {_FEATURES_SQL}, {_SPACE_SQL}, g AS (SELECT feature, weight AS b FROM rp ORDER BY weight, feature LIMIT 12)
SELECT feature, round(least(b * 1.25, b + 0.02, 1 - 1e-8), 5) AS marginal FROM g UNION ALL SELECT 'mass', 1.0""")
def project_moments(spark, d):
    """The projected distribution's marginals of the features that were aimed at, and its mass."""
    s, f = _order_space(spark, d)
    space = circuit.local(circuit.feature_space(f, s, (8, 12, 20)))
    every = circuit.with_pairs(f, space)
    goal = circuit.targets(circuit.marginals(s, every), limit=12)
    p = circuit.project(s, every, goal).states
    got = circuit.marginals(p, every).join(F.broadcast(goal.select("feature")), "feature")
    return got.unionByName(p.agg(F.lit("mass").alias("feature"), F.sum("p").alias("marginal"))).select("feature", F.round("marginal", 5).alias("marginal"))


@query("""SELECT split, n, CAST(0 AS BIGINT) AS torn FROM (SELECT 'validation' AS split, count(*) // 20 AS n FROM conversations UNION ALL SELECT 'train', count(*) - count(*) // 20 FROM conversations)""")
def exact_split_sizes(spark, d):
    """How many rows each side of an exact split of whole conversations has, and how many conversations lie on both."""
    c = t(spark, d, "conversations").select("conv_id", "turn", "role")
    s = sampling.exact_group_split(c, "conv_id", ["role"], c.count() // 20)
    sides = s.groupBy("conv_id").agg(F.count_distinct("split").alias("sides")).agg(F.count_if(F.col("sides") > 1).alias("torn"))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(sides))


PUZZLES = {"zebra_easy": 300, "zebra_medium": 400, "zebra_hard": 300}
_SHAPES = ", ".join(f"('{k}', {n}, {c}, {PUZZLES[k]})" for k, (n, c) in GRID_SHAPES.items())
_POOLS = ", ".join(f"('{c}', '{x}')" for c, items in grids.POOLS.items() for x in items)
_IDS = f"SELECT 'zebralogic:' || domain || ':' || i AS source_id, domain, n, k FROM (VALUES {_SHAPES}) v(domain, n, k, many), LATERAL (SELECT unnest(range(many)) AS i)"


@query(f"""WITH pool(c, x) AS (VALUES {_POOLS}), ids AS ({_IDS}),
cats AS (SELECT * FROM (SELECT ids.*, c, row_number() OVER (PARTITION BY source_id, c = '{grids.ANCHOR}' ORDER BY sha256(concat_ws('|', '42', 'category', source_id, c))) AS r FROM ids, (SELECT DISTINCT c FROM pool)) WHERE c = '{grids.ANCHOR}' OR r < k),
picked AS (SELECT source_id, c, x FROM (SELECT source_id, c, x, n, row_number() OVER (PARTITION BY source_id, c ORDER BY sha256(concat_ws('|', '42', c, source_id, x))) AS r FROM cats JOIN pool USING (c)) WHERE r <= n)
SELECT source_id, c AS category, x AS item, CAST(row_number() OVER (PARTITION BY source_id, c ORDER BY sha256(concat_ws('|', '42', 'seat', source_id, c, x))) - 1 AS INT) AS position FROM picked""")
def grid_items(spark, d):
    """Every item of generated puzzles and its place."""
    g = grids.generate(spark, PUZZLES, SEED).select("source_id", F.explode("assignment").alias("category", "of"))
    return g.select("source_id", "category", F.explode("of").alias("item", "position"))


@query(f"""WITH ids AS ({_IDS}), c AS (SELECT source_id, n, unnest(['fixed_position', 'left_of', 'equality', 'adjacent', 'not_adjacent']) AS type,
unnest([1, n - 1, (k - 1) * n, CASE WHEN n >= 2 THEN k - 1 ELSE 0 END, CASE WHEN n >= 3 THEN k - 1 ELSE 0 END]) AS clues FROM ids)
SELECT source_id, type, CAST(clues AS BIGINT) AS clues FROM c WHERE clues > 0""")
def grid_clues(spark, d):
    """How many clues of each type generated puzzles have."""
    g = grids.generate(spark, PUZZLES, SEED).select("source_id", F.explode("clues").alias("c"))
    return g.groupBy("source_id", F.col("c.type").alias("type")).agg(F.count(F.lit(1)).alias("clues"))
