"""Registered queries of the engine's own operators over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import canon as C
from .functions import metrics as M
from .functions.allocation import apportion
from .operators import circuit, evaluate, grids, realize, records, sampling, validate
from .plans.model import PLAN, empty_plan

SEED = 42
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- sampling, splits, quotas -------------------------------------------------------------------------------------------

_JSON = """'"' || {} || '"'"""


def _sample_sql(source: str, fraction: float, seed: int, out: str) -> str:
    s, g = "to_json(source)::VARCHAR", "to_json(lang)::VARCHAR"
    return f"""{out}_d AS (SELECT *, [{s}, {g}] AS st, sha256(concat_ws('|', '{seed}', to_json([{s}, {g}])::VARCHAR, doc_id::VARCHAR)) AS h FROM {source}),
{out}_w AS (SELECT st, count(*) AS n, (SELECT floor(count(*) * {fraction} + 0.5) FROM {source}) AS total, sum(count(*)) OVER () AS al FROM {out}_d GROUP BY st),
{out}_b AS (SELECT *, total * n / al AS raw, floor(total * n / al) AS base FROM {out}_w),
{out}_a AS (SELECT st, base + CASE WHEN row_number() OVER (ORDER BY raw - base DESC, st) <= total - sum(base) OVER () THEN 1 ELSE 0 END AS share FROM {out}_b),
{out} AS (SELECT * EXCLUDE (st, h, r, share) FROM (SELECT d.*, row_number() OVER (PARTITION BY d.st ORDER BY h, doc_id) AS r FROM {out}_d d) x JOIN {out}_a USING (st) WHERE r <= share)"""


@query(f"WITH {_sample_sql('documents', 0.3, 42, 's')} SELECT doc_id, source, lang FROM s")
def stratified_sample(spark, d):
    return sampling.stratified_sample(t(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id", ["source", "lang"], 0.3, SEED)


@query(f"WITH {_sample_sql('documents', 0.8, 42, 'p')}, {_sample_sql('p', 0.5, 43, 's')} SELECT doc_id, source, lang FROM s")
def two_stage_sample(spark, d):
    return sampling.two_stage_sample(t(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id", ["source", "lang"], 0.8, 0.5, SEED)


@query("SELECT count(*) AS n, count(*) - count(DISTINCT sha256(text)) AS duplicates FROM documents")
def duplicate_count(spark, d):
    return t(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct(C.sha256("text"))).alias("duplicates"))


@query("SELECT count(*) AS leaked FROM (SELECT sha256(text) FROM documents GROUP BY sha256(text) HAVING count(DISTINCT lang) > 1)")
def leakage(spark, d):
    return t(spark, d, "documents").groupBy(C.sha256("text").alias("k")).agg(F.count_distinct("lang").alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("leaked"))


@query("SELECT source, lang, count(*) AS available, CAST(floor(count(*) * 0.5 + 0.5) AS BIGINT) AS selected, count(*) - count(DISTINCT sha256(text)) AS duplicates FROM documents GROUP BY source, lang")
def split_manifest(spark, d):
    n = F.count(F.lit(1))
    return t(spark, d, "documents").groupBy("source", "lang").agg(n.alias("available"), C.half_up(n, 0.5).alias("selected"), (n - F.count_distinct(C.sha256("text"))).alias("duplicates"))


_QUARTERS = " || ':' || ".join(f"sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT))::HUGEINT::VARCHAR" for i in range(4))


@query(f"SELECT source, sha256(count(h)::VARCHAR || ':' || {_QUARTERS}) AS fingerprint FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY source")
def fingerprints(spark, d):
    return t(spark, d, "documents").select("source", C.sha256("text").alias("h")).groupBy("source").agg(C.fingerprint(F.col("h")).alias("fingerprint"))


_LR = """WITH w AS (SELECT {k} AS k, count(*) AS n FROM {t} GROUP BY {k}), b AS (SELECT k, n, {total} * n / sum(n) OVER () AS raw, floor({total} * n / sum(n) OVER ()) AS base FROM w)
SELECT k, n, CAST(base + CASE WHEN row_number() OVER (ORDER BY raw - base DESC, k) <= {total} - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM b"""


@query(_LR.format(k="o_orderpriority", t="orders", total=4000))
def largest_remainder_quota(spark, d):
    w = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return apportion(w, 4000, weight="n", order="k")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256(concat_ws('|', '42', 'group', doc_id::VARCHAR)), doc_id) AS r, count(*) OVER () AS n FROM documents),
x AS (SELECT *, n - 2 * (n // 10) AS t0, n // 10 AS t1 FROM r)
SELECT doc_id, CASE WHEN r <= t0 - t1 THEN 'train' ELSE (['train', 'validation', 'test'])[CAST((r - (t0 - t1) - 1) % 3 AS INT) + 1] END AS split FROM x""")
def research_split_documents(spark, d):
    return sampling.group_split(t(spark, d, "documents").select("doc_id"), "doc_id", {"train": 0.8, "validation": 0.1, "test": 0.1}, SEED)


@query("""WITH RECURSIVE g AS (SELECT conv_id, n, row_number() OVER (ORDER BY sha256(concat_ws('|', '42', 'group', conv_id::VARCHAR)), conv_id) AS i FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)),
f AS (SELECT k, total * w AS raw, floor(total * w) AS base FROM (SELECT sum(n)::DOUBLE AS total FROM g), (VALUES (1, 0.8::DOUBLE), (2, 0.1::DOUBLE), (3, 0.1::DOUBLE)) v(k, w)),
t AS (SELECT k, CAST(base + CASE WHEN row_number() OVER (ORDER BY raw - base DESC, k) <= (SELECT sum(n) FROM g) - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS t FROM f),
s(i, conv_id, a, b, c, part) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), -(SELECT t FROM t WHERE k = 1), -(SELECT t FROM t WHERE k = 2), -(SELECT t FROM t WHERE k = 3), 0
  UNION ALL
  SELECT x.i, x.conv_id, a + CASE WHEN y = 1 THEN n ELSE 0 END, b + CASE WHEN y = 2 THEN n ELSE 0 END, c + CASE WHEN y = 3 THEN n ELSE 0 END, y
  FROM (SELECT g.i, g.conv_id, g.n, s.a, s.b, s.c, CASE WHEN s.a <= s.b AND s.a <= s.c THEN 1 WHEN s.b <= s.c THEN 2 ELSE 3 END AS y FROM s JOIN g ON g.i = s.i + 1) x)
SELECT conv_id, turn, (['train', 'validation', 'test'])[part] AS split FROM s JOIN conversations USING (conv_id) WHERE s.i > 0""")
def research_split_conversations(spark, d):
    return sampling.group_split(t(spark, d, "conversations").select("conv_id", "turn"), "conv_id", {"train": 0.8, "validation": 0.1, "test": 0.1}, SEED)


@query()
def exact_split_conversations(spark, d):
    c = t(spark, d, "conversations").select("conv_id", "turn", "role")
    return sampling.exact_group_split(c, "conv_id", ["role"], c.count() // 20)


@query("SELECT CAST(row_number() OVER (ORDER BY sha256(concat_ws('|', '42', 'shuffle', doc_id::VARCHAR)), doc_id) - 1 AS BIGINT) AS position, doc_id FROM documents")
def seeded_shuffle(spark, d):
    return sampling.shuffled(t(spark, d, "documents").select("doc_id"), "doc_id", SEED)


@query("""WITH RECURSIVE w(k, w, ord, share) AS (VALUES ('de', 2.0, 0, 60), ('en', 5.0, 1, 150), ('es', 1.0, 2, 30), ('fr', 2.0, 3, 60)),
s(step, k, used, pos) AS (
  SELECT -1, NULL::VARCHAR, [0, 0, 0, 0], 0
  UNION ALL
  SELECT step + 1, p.k, [CASE WHEN p.ord = i - 1 THEN used[i] + 1 ELSE used[i] END FOR i IN [1, 2, 3, 4]], p.pos
  FROM s, LATERAL (SELECT k, ord, s.used[ord + 1] AS pos FROM w WHERE s.used[ord + 1] < share ORDER BY (s.step + 2) * w / 10.0 - s.used[ord + 1] DESC, ord LIMIT 1) p WHERE s.step < 299),
pool AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT CAST(step AS BIGINT) AS step, doc_id, lang FROM s JOIN pool ON lang = k AND r = pos % n WHERE step >= 0""")
def weighted_round_robin(spark, d):
    return sampling.scheduled(t(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang", {"de": 2.0, "en": 5.0, "es": 1.0, "fr": 2.0}, 300)


_HEX = "(SELECT list_sum(list_transform(generate_series(1, 13), lambda i: (strpos('0123456789abcdef', h[i]) - 1) * power(16::DOUBLE, 13 - i))))"
_STATES_SQL = """obs AS (SELECT o_orderstatus AS domain, o_orderpriority AS priority, month(o_orderdate) AS month FROM orders),
n AS (SELECT domain, priority, CAST(month AS INT) AS month, domain || '/' || priority || '/' || lpad(month::VARCHAR, 2, '0') AS state_id, count(*) AS n FROM obs GROUP BY ALL),
dm AS (SELECT domain, sum(n)::DOUBLE AS nd, count(*) AS sd FROM n GROUP BY domain),
st AS (SELECT n.*, (nd + 1e-8) / (SELECT sum(nd + 1e-8) FROM dm) * (n + 1e-8) / (nd + 1e-8 * sd) AS p FROM n JOIN dm USING (domain))"""


def order_states(spark, d) -> DataFrame:
    """A distribution over (status, priority, month) of orders; the plan is one triple a state."""
    o = t(spark, d, "orders").select(F.col("o_orderstatus").alias("domain"), F.col("o_orderpriority").alias("priority"), F.month("o_orderdate").alias("month"))
    o = o.withColumn("state_id", F.concat_ws("/", "domain", "priority", F.lpad(F.col("month").cast("string"), 2, "0")))
    return circuit.fit(o)


def order_features(states: DataFrame) -> DataFrame:
    atom = F.array(F.concat(F.lit("domain:"), F.col("domain")), F.concat_ws(":", F.lit("attribute"), "domain", "priority"), F.concat_ws(":", F.lit("relation"), "domain", F.concat(F.lit("m"), F.lpad(F.col("month").cast("string"), 2, "0"))))
    return states.select("state_id", F.explode(atom).alias("feature"))


_FEATURES_SQL = """ft AS (SELECT state_id, domain, p, unnest(['domain:' || domain, 'attribute:' || domain || ':' || priority, 'relation:' || domain || ':m' || lpad(month::VARCHAR, 2, '0')]) AS feature FROM st)"""


@query(f"WITH {_STATES_SQL} SELECT state_id, domain, n, round(p, 12) AS p FROM st")
def fit_mle(spark, d):
    s = order_states(spark, d)
    circuit.check(s)
    return s.select("state_id", "domain", "n", F.round("p", 12).alias("p"))


@query(f"WITH {_STATES_SQL} SELECT state_id, domain, round(sum(p) OVER (PARTITION BY domain), 10) AS mass, round(p / sum(p) OVER (PARTITION BY domain), 10) AS share FROM st")
def local_parameters(spark, d):
    return circuit.local_parameters(order_states(spark, d)).select("state_id", "domain", F.round("mass", 10).alias("mass"), F.round("share", 10).alias("share"))


@query(f"WITH {_STATES_SQL}, {_FEATURES_SQL} SELECT feature, round(sum(p), 10) AS marginal FROM ft GROUP BY feature")
def marginals(spark, d):
    s = order_states(spark, d)
    return circuit.marginals(s, order_features(s)).select("feature", F.round("marginal", 10).alias("marginal"))


@query(f"WITH {_STATES_SQL}, {_FEATURES_SQL}, s AS (SELECT *, sum(p) OVER () AS m FROM st WHERE domain = 'F') SELECT feature, round(sum(s.p / m), 10) AS marginal FROM s JOIN ft USING (state_id) GROUP BY feature")
def conditional_marginals(spark, d):
    s = order_states(spark, d)
    return circuit.conditional_marginals(s, order_features(s), F.col("domain") == "F").select("feature", F.round("marginal", 10).alias("marginal"))


_SPACE_SQL = """fw AS (SELECT feature, round(sum(p), 12) AS weight FROM ft GROUP BY feature),
kept AS (SELECT DISTINCT feature FROM (SELECT * FROM (SELECT feature FROM fw WHERE feature LIKE 'attribute:%' ORDER BY weight, feature LIMIT 4) UNION ALL SELECT * FROM (SELECT feature FROM fw WHERE feature LIKE 'attribute:%' ORDER BY weight DESC, feature LIMIT 4)
 UNION ALL SELECT * FROM (SELECT feature FROM fw WHERE feature LIKE 'relation:%' ORDER BY weight, feature LIMIT 6) UNION ALL SELECT * FROM (SELECT feature FROM fw WHERE feature LIKE 'relation:%' ORDER BY weight DESC, feature LIMIT 6))),
kf AS (SELECT state_id, feature, p FROM ft WHERE feature IN (SELECT feature FROM kept)),
pw AS (SELECT a.feature AS l, b.feature AS r, sum(a.p) AS weight FROM kf a JOIN kf b ON a.state_id = b.state_id AND a.feature < b.feature GROUP BY 1, 2),
rp AS (SELECT l, r, 'rare_pair:["' || l || '","' || r || '"]' AS feature, weight FROM pw WHERE weight > 0 AND weight <= (SELECT quantile_cont(weight, 0.25) FROM pw) ORDER BY weight, l, r LIMIT 20)"""


def _order_space(spark, d):
    s = order_states(spark, d)
    return s, order_features(s)


@query(f"WITH {_STATES_SQL}, {_FEATURES_SQL}, {_SPACE_SQL} SELECT feature, round(weight, 10) AS weight FROM rp")
def rare_pairs(spark, d):
    s, f = _order_space(spark, d)
    w = f.join(s.select("state_id", "p"), "state_id").groupBy("feature").agg(F.round(F.sum("p"), 12).alias("weight"))
    kept = circuit._capped(w, "attribute:", 8).unionByName(circuit._capped(w, "relation:", 12))
    return circuit.rare_pairs(f, s, kept, 0.25, 20).select("feature", F.round("weight", 10).alias("weight"))


@query(f"""WITH {_STATES_SQL}, {_FEATURES_SQL}, {_SPACE_SQL}, al AS (SELECT feature FROM fw WHERE feature LIKE 'domain:%' UNION ALL SELECT feature FROM kept UNION ALL SELECT feature FROM rp)
SELECT feature, split_part(feature, ':', 1) AS family, CAST(row_number() OVER (ORDER BY list_position(['domain', 'attribute', 'relation', 'rare_pair'], split_part(feature, ':', 1)), feature) - 1 AS INT) AS feature_id FROM al""")
def feature_space(spark, d):
    s, f = _order_space(spark, d)
    return circuit.feature_space(f, s, (8, 12, 20))


@query()
def project(spark, d):
    s, f = _order_space(spark, d)
    space = circuit.local(circuit.feature_space(f, s, (8, 12, 20)))
    every = circuit.with_pairs(f, space)
    goal = circuit.targets(circuit.marginals(s, every), limit=12)
    return circuit.project(s, every, goal).states.select("state_id", "domain", F.round("p", 9).alias("p"), F.round("p_base", 9).alias("p_base"))


@query(f"""WITH {_STATES_SQL}, c AS (SELECT state_id, n, sum(n) OVER (ORDER BY state_id) AS hi, sum(n) OVER () AS total FROM st),
u AS (SELECT draw, {_HEX} / 4503599627370496.0 AS u FROM (SELECT range AS draw, sha256(concat_ws('|', '5042', 'uniform', range::VARCHAR)) AS h FROM range(2000)))
SELECT draw, state_id FROM u JOIN c ON u >= (hi - n) / total AND (u < hi / total OR hi = total)""")
def weighted_draw(spark, d):
    return sampling.weighted_draw(order_states(spark, d).select("state_id", "n"), sampling.hash_uniforms(spark, 2000, SEED + 5000), "state_id", "n").select("draw", "state_id")


@query(f"""WITH {_STATES_SQL}, c AS (SELECT state_id, domain, n, sum(n) OVER (PARTITION BY domain ORDER BY state_id) AS hi, sum(n) OVER (PARTITION BY domain) AS total FROM st),
u AS (SELECT draw, (['F', 'O', 'P'])[CAST(draw % 3 AS INT) + 1] AS domain, {_HEX} / 4503599627370496.0 AS u FROM (SELECT range AS draw, sha256(concat_ws('|', '7042', 'uniform', range::VARCHAR)) AS h FROM range(1500)))
SELECT draw, state_id FROM u JOIN c USING (domain) WHERE u >= (hi - n) / total AND (u < hi / total OR hi = total)""")
def conditional_draw(spark, d):
    u = sampling.hash_uniforms(spark, 1500, SEED + 7000).withColumn("domain", F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("draw") % 3 + 1).cast("int")))
    return sampling.weighted_draw(order_states(spark, d).select("state_id", "domain", "n"), u, "state_id", "n", ["domain"]).select("draw", "state_id")


@query(f"""WITH {_STATES_SQL}, {_FEATURES_SQL}, c AS (SELECT state_id, priority || '/' || month AS plan_key, p, sum(p) OVER (ORDER BY state_id) AS hi FROM st),
u AS (SELECT range AS draw, {_HEX} / 4503599627370496.0 AS u FROM (SELECT range, sha256(concat_ws('|', '5042', 'uniform', range::VARCHAR)) AS h FROM range(2000))),
dr AS (SELECT draw, state_id, plan_key FROM u JOIN c ON u >= (hi - p) / (SELECT max(hi) FROM c) AND (u < hi / (SELECT max(hi) FROM c) OR hi = (SELECT max(hi) FROM c))),
ct AS (SELECT count(*) AS n, 1 - count(DISTINCT plan_key) / count(*) AS dup FROM dr),
seen AS (SELECT feature, count(*) AS k FROM dr JOIN ft USING (state_id) GROUP BY feature),
m AS (SELECT feature, sum(p) AS marginal FROM ft GROUP BY feature)
SELECT n AS count, round(dup, 9) AS duplicate_rate, round(rmse, 9) AS marginal_rmse, 1.0::DOUBLE AS rare_coverage FROM ct, (SELECT sqrt(avg(power(coalesce(k, 0) / (SELECT n FROM ct) - marginal, 2))) AS rmse FROM m LEFT JOIN seen USING (feature))""")
def sampling_report(spark, d):
    s, f = _order_space(spark, d)
    drawn = sampling.weighted_draw(s.withColumn("plan_key", F.concat_ws("/", "priority", "month")).select("state_id", "plan_key", "p"), sampling.hash_uniforms(spark, 2000, SEED + 5000), "state_id", "p")
    r = circuit.sampling_report(drawn, s, f)
    return r.select("count", *[F.round(c, 9).alias(c) for c in ("duplicate_rate", "marginal_rmse", "rare_coverage")])


# --- records, labels, validation, realisation ---------------------------------------------------------------------------


def part_records(spark, d) -> DataFrame:
    """Parts as triple records: three properties of each."""
    p = t(spark, d, "part")
    name = F.concat_ws("#", "p_name", F.col("p_partkey").cast("string"))
    row = lambda k, v: F.struct(name.alias("subject"), F.lit(k).alias("predicate"), v.cast("string").alias("object"))
    raw = p.select(F.col("p_partkey").cast("string").alias("id"), F.array(row("brand", F.col("p_brand")), row("size", F.col("p_size")), row("type", F.col("p_type"))).alias("tripleset"), F.lit("part").alias("category"), F.lit("").alias("text"))
    return records.normalize(raw, "webnlg", F.lit("train"))


_PART = "SELECT p_partkey, p_name || '#' || p_partkey AS s, p_brand AS b, p_size::VARCHAR AS z, p_type AS ty FROM part"


@query(f"""WITH p AS ({_PART}) SELECT 'webnlg:train:' || p_partkey AS source_id, u.pos, s AS subject, u.pr AS predicate, u.ob AS object
FROM p, LATERAL (SELECT unnest([0, 1, 2]) AS pos, unnest(['brand', 'size', 'type']) AS pr, unnest([b, z, ty]) AS ob) u""")
def normalize_triples(spark, d):
    # no record is without triples; a plain explode would filter by the parsed array and so parse it twice
    return part_records(spark, d).select("source_id", F.posexplode_outer("reference_plan.triples").alias("pos", "t")).select("source_id", "pos", "t.subject", "t.predicate", "t.object")


def line_records(spark, d) -> DataFrame:
    """Lines as cell records: two columns of each, from delimited strings."""
    li = t(spark, d, "lineitem")
    name = F.concat_ws("-", "l_orderkey", "l_linenumber")
    cell = lambda k, v: F.concat_ws(" | ", name, F.lit(k), v)
    raw = li.select(name.alias("id"), F.array(cell("flag", F.col("l_returnflag")), cell("status", F.col("l_linestatus")), cell("quantity", F.col("l_quantity").cast("int").cast("string"))).alias("tripleset"), F.lit("lines").alias("target_sources"))
    return records.normalize(raw, "dart", F.lit("train"))


@query("""SELECT 'dart:train:' || l_orderkey || '-' || l_linenumber AS source_id, u.pos, l_orderkey || '-' || l_linenumber AS "row", u.c AS "column", u.v AS value
FROM lineitem, LATERAL (SELECT unnest([0, 1, 2]) AS pos, unnest(['flag', 'status', 'quantity']) AS c, unnest([l_returnflag, l_linestatus, CAST(CAST(trunc(l_quantity) AS INT) AS VARCHAR)]) AS v) u""")
def normalize_cells(spark, d):
    return line_records(spark, d).select("source_id", F.posexplode_outer("reference_plan.fields").alias("pos", "f")).select("source_id", "pos", "f.row", "f.column", "f.value")


_LABEL = "concat('{screen#', CASE quality WHEN 1 THEN 'positive' ELSE 'NEGATIVE' END, '};{BATTERY# ', CASE toxic WHEN 1 THEN 'Negative' ELSE 'neutral' END, '};', CASE WHEN doc_id % 3 = 0 THEN '{OTHERS};' ELSE '' END)"


@query("""SELECT doc_id, CASE toxic WHEN 1 THEN 'Negative' ELSE 'Neutral' END AS battery, CASE quality WHEN 1 THEN 'Positive' ELSE 'Negative' END AS screen, doc_id % 3 = 0 AS others, 2 AS n FROM labels""")
def label_parse(spark, d):
    x = t(spark, d, "labels").select("doc_id", records.parse_label(F.expr(_LABEL)).alias("l"))
    return x.select("doc_id", F.col("l.pairs")[0]["sentiment"].alias("battery"), F.col("l.pairs")[1]["sentiment"].alias("screen"), "l.others", F.size("l.pairs").alias("n"))


@query("SELECT 'webnlg:train:' || p_partkey AS source_id, 'webnlg:part' AS schema_id, 'brand,size,type' AS predicates, 1 AS low, 3 AS high FROM part")
def schema_inference(spark, d):
    s = records.infer_schema(part_records(spark, d))
    c = F.col("constraints")
    return s.select("source_id", "schema_id", F.array_join(c["allowed_predicates"], ",").alias("predicates"), c["cardinality"][0].alias("low"), c["cardinality"][1].alias("high"))


@query("""SELECT 'webnlg:train:' || p_partkey AS source_id, CASE p_partkey % 5 WHEN 1 THEN 'relation,grounding' WHEN 2 THEN 'cardinality,duplicate' WHEN 3 THEN 'required,grounding' WHEN 4 THEN 'required' ELSE '' END AS codes FROM part""")
def validate_triples(spark, d):
    """Corruptions by key: a foreign predicate, a repeated triple, a missing object, no triples."""
    r = part_records(spark, d)
    k = "CAST(substring_index(source_id, ':', -1) AS long) % 5"
    tr = "reference_plan.triples"
    bad = f"CASE {k} WHEN 1 THEN transform({tr}, (x, i) -> IF(i = 0, named_struct('subject', x.subject, 'predicate', 'foreign', 'object', x.object, 'subject_type', x.subject_type, 'object_type', x.object_type), x)) WHEN 2 THEN concat({tr}, slice({tr}, 1, 1)) WHEN 3 THEN transform({tr}, (x, i) -> IF(i = 2, named_struct('subject', x.subject, 'predicate', x.predicate, 'object', CAST(NULL AS string), 'subject_type', x.subject_type, 'object_type', x.object_type), x)) WHEN 4 THEN slice({tr}, 1, 0) ELSE {tr} END"
    j = r.withColumn("constraints", records.constraints("webnlg")).withColumn("_t", F.expr(bad)).withColumn("plan", F.expr(empty_plan(domain="domain", schema_id="schema_id", triples="_t")))
    # a triple with a missing part can't be grounded either
    return j.select("source_id", F.array_join(F.transform(validate.errors(), lambda e: e["code"]), ",").alias("codes"))


@query("""SELECT 'dart:train:' || l_orderkey || '-' || l_linenumber AS source_id, CASE l_orderkey % 4 WHEN 1 THEN 'grounding' WHEN 2 THEN 'cardinality,required' WHEN 3 THEN 'field,grounding,required' ELSE '' END AS codes FROM lineitem""")
def validate_cells(spark, d):
    """Corruptions by key: another value, a missing cell, a foreign column."""
    r = line_records(spark, d)
    k = "CAST(split(split(source_id, ':')[2], '-')[0] AS long) % 4"
    f = "reference_plan.fields"
    bad = f"CASE {k} WHEN 1 THEN transform({f}, (x, i) -> IF(i = 0, named_struct('row', x.row, 'column', x.column, 'value', 'zz'), x)) WHEN 2 THEN slice({f}, 1, 2) WHEN 3 THEN transform({f}, (x, i) -> IF(i = 1, named_struct('row', x.row, 'column', 'foreign', 'value', x.value), x)) ELSE {f} END"
    j = r.withColumn("constraints", records.constraints("dart")).withColumn("_f", F.expr(bad)).withColumn("plan", F.expr(empty_plan(domain="domain", schema_id="schema_id", fields="_f")))
    return j.select("source_id", F.array_join(F.transform(validate.errors(), lambda e: e["code"]), ",").alias("codes"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'grounding' WHEN 2 THEN 'duplicate,grounding' WHEN 3 THEN 'grounding' ELSE '' END AS codes FROM labels""")
def validate_reviews(spark, d):
    """Corruptions by key: another sentiment, a repeated pair, others turned round."""
    x = t(spark, d, "labels").select("doc_id", F.expr(_LABEL).alias("label"), F.col("doc_id").alias("id"))
    r = records.normalize(x.select("id", "label"), "visfd", F.lit("train"))
    p = "reference_plan.pairs"
    k = "CAST(substring_index(source_id, ':', -1) AS long) % 4"
    bad = f"CASE {k} WHEN 1 THEN transform({p}, (x, i) -> IF(i = 1, named_struct('aspect', x.aspect, 'sentiment', IF(x.sentiment = 'Positive', 'Negative', 'Positive')), x)) WHEN 2 THEN concat({p}, slice({p}, 1, 1)) ELSE {p} END"
    j = r.withColumn("constraints", records.constraints()).withColumns({"_p": F.expr(bad), "_o": F.expr(f"IF({k} = 3, NOT reference_plan.others, reference_plan.others)")})
    j = j.withColumn("plan", F.expr(empty_plan(domain="domain", schema_id="schema_id", pairs="_p", others="_o")))
    return j.select(F.substring_index("source_id", ":", -1).cast("long").alias("doc_id"), F.array_join(F.transform(validate.errors(), lambda e: e["code"]), ",").alias("codes"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    from .operators.salvage import first_object

    noisy = F.concat(F.lit("```json\nnote: "), "props", F.lit(" trailing } text\n```"))
    return t(spark, d, "events").select("event_id", F.get_json_object(first_object(noisy), "$.k").cast("long").alias("k"))


_WORDS = r"[\p{L}\p{N}_]+"
_CANON_SQL = "array_to_string(regexp_extract_all(replace(replace(replace(replace(lower({}), 'ß', 'ss'), 'ſ', 's'), 'ς', 'σ'), 'µ', 'μ'), '[\\p{{L}}\\p{{N}}_]+'), ' ')"


@query(f"SELECT doc_id, sha256({_CANON_SQL.format('text')}) AS canonical_sha FROM documents")
def canonical_text(spark, d):
    return t(spark, d, "documents").select("doc_id", C.sha256(C.canonical_text("text")).alias("canonical_sha"))


_CLAUSES_SQL = f"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), ';\\s*|\\n+|\\.\\s+'), lambda x: {_CANON_SQL.format('x')}), lambda x: x <> '')"


@query(f"SELECT doc_id, CAST(len(c) AS INT) AS n, sha256(array_to_string(c, '|')) AS clauses_sha FROM (SELECT doc_id, {_CLAUSES_SQL} AS c FROM documents)")
def clause_split(spark, d):
    return t(spark, d, "documents").select("doc_id", C.clauses("text").alias("c")).select("doc_id", F.size("c").alias("n"), C.sha256(F.array_join("c", "|")).alias("clauses_sha"))


@query("SELECT doc_id, doc_id % 7 <> 0 AND trim(text) <> '' AS valid FROM documents")
def script_filter(spark, d):
    x = t(spark, d, "documents").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" 评论"))).otherwise(F.col("text")))
    return x.select("doc_id", validate.language_valid(F.col("text")).alias("valid"))


@query(f"""WITH b AS (SELECT unnest({_CLAUSES_SQL}) AS fact FROM benchmark), c AS (SELECT doc_id, unnest({_CLAUSES_SQL}) AS c FROM documents)
SELECT DISTINCT doc_id, fact FROM c JOIN (SELECT DISTINCT fact FROM b WHERE fact IS NOT NULL) b ON contains(' ' || c || ' ', ' ' || fact || ' ')""")
def fact_mentions(spark, d):
    """Every clause of every benchmark item, looked for in the documents' clauses."""
    b = t(spark, d, "benchmark").select(F.lit("-").alias("domain"), F.explode(C.clauses("text")).alias("fact")).select("domain", F.array("fact").alias("fact"))
    docs = t(spark, d, "documents").select("doc_id", F.lit("-").alias("domain"), "text")
    return evaluate.mentions(docs, "doc_id", b).select("doc_id", F.get("fact", 0).alias("fact"))


@query(f"""WITH p AS ({_PART}) SELECT 'webnlg:train:' || p_partkey AS source_id, s || ' brand ' || b || '. ' || s || ' size ' || z || '. ' || s || ' type ' || ty || '.' AS text,
s || ' type ' || ty || '. ' || s || ' size ' || z || '. ' || s || ' brand ' || b || '.' AS flipped, 2 AS n FROM p""")
def realize_plans(spark, d):
    r = part_records(spark, d).select("source_id", realize.realizations(F.col("reference_plan")).alias("r"), realize.plan_text(F.col("reference_plan")).alias("text"))
    return r.select("source_id", "text", F.col("r")[1].alias("flipped"), F.size("r").alias("n"))


@query(f"""WITH p AS ({_PART}) SELECT 'webnlg:train:' || p_partkey AS source_id, p_partkey % 2 = 0 AS accepted FROM p""")
def realization_accept(spark, d):
    r = part_records(spark, d)
    plan, words = F.col("reference_plan"), realize.tokens(realize.plan_text(F.col("reference_plan")))
    even = F.substring_index("source_id", ":", -1).cast("long") % 2 == 0
    seq = F.when(even, F.concat(words, F.array(F.lit(realize.EOS)))).otherwise(words)
    return r.select("source_id", realize.accepts(plan, seq).alias("accepted"))


@query(f"""WITH p AS ({_PART}) SELECT 'webnlg:train:' || p_partkey AS source_id, '<domain=webnlg> <triple subject="' || s || '" predicate="brand" object="' || b || '"> <triple subject="' || s || '" predicate="size" object="' || z || '"> <triple subject="' || s || '" predicate="type" object="' || ty || '">' AS tagged, 3 AS cardinality FROM p""")
def serialize_plans(spark, d):
    return part_records(spark, d).select("source_id", realize.serialize(F.col("reference_plan")).alias("tagged"), realize.cardinality(F.col("reference_plan")).alias("cardinality"))


@query("""SELECT 'webnlg:train:' || p_partkey AS source_id, p_partkey % 4 <> 3 AS parse_valid, p_partkey % 4 IN (0, 1) AS phi_valid, p_partkey % 4 = 0 AS factual_consistency,
CASE p_partkey % 4 WHEN 1 THEN 'plan_text_inconsistent' WHEN 2 THEN 'cardinality' WHEN 3 THEN 'json_parse' END AS reject_reason FROM part""")
def verify_candidates(spark, d):
    """Candidates by key: as they should be, another text, too many triples, broken JSON."""
    r = part_records(spark, d)
    k = F.substring_index("source_id", ":", -1).cast("long") % 4
    more = F.expr("concat(reference_plan.triples, transform(slice(reference_plan.triples, 1, 1), x -> named_struct('subject', x.subject, 'predicate', x.predicate, 'object', 'other', 'subject_type', x.subject_type, 'object_type', x.object_type)))")
    x = r.withColumns({"_text": realize.plan_text(F.col("reference_plan")), "_k": k, "_more": more})
    x = x.withColumn("_plan", F.when(F.col("_k") == 2, F.expr(empty_plan(domain="domain", schema_id="schema_id", triples="_more"))).otherwise(F.col("reference_plan").cast(PLAN)))
    made = F.to_json(F.struct(F.col("_plan").alias("plan"), F.when(F.col("_k") == 1, F.lit("nothing here")).otherwise(F.col("_text")).alias("text")))
    c = x.select("source_id", F.when(F.col("_k") == 3, F.substring(made, 1, 20)).otherwise(made).alias("candidate"))
    return validate.verify(c, records.infer_schema(r)).select("source_id", "parse_valid", "phi_valid", "factual_consistency", "reject_reason")


@query()
def grid_generate(spark, d):
    return grids.generate(spark, {"zebra_easy": 30, "zebra_medium": 40, "zebra_hard": 30}, SEED).select("source_id", "domain", "grid_size", F.size("clues").alias("clues"), "text")


@query("""SELECT domain, CAST(count(*) AS INT) AS n, CAST(count(*) FILTER (i % 3 <> 1) AS INT) AS valid, CAST(count(*) FILTER (i % 3 = 1) AS INT) AS off
FROM (SELECT 'zebra_easy' AS domain, range AS i FROM range(30) UNION ALL SELECT 'zebra_medium', range FROM range(40) UNION ALL SELECT 'zebra_hard', range FROM range(30)) GROUP BY domain""")
def grid_validate(spark, d):
    """Every third puzzle's assignment turned round: its clues no longer hold."""
    g = grids.generate(spark, {"zebra_easy": 30, "zebra_medium": 40, "zebra_hard": 30}, SEED)
    off = F.substring_index("source_id", ":", -1).cast("long") % 3 == 1
    turned = F.transform_values("assignment", lambda c, x: F.transform_values(x, lambda k, p: F.col("grid_size") - 1 - p))
    g = g.withColumn("_a", F.when(off, turned).otherwise(F.col("assignment")))
    p = g.withColumn("plan", F.expr(empty_plan(domain="domain", grid_size="grid_size", categories="categories", clues="clues", assignment="_a")))
    p = p.withColumn("reference_plan", F.expr(empty_plan(domain="domain", grid_size="grid_size", categories="categories", clues="clues", assignment="assignment"))).withColumn("schema_id", F.lit(None).cast("string"))
    e = p.withColumn("constraints", records.constraints("zebralogic")).select("domain", validate.errors().alias("e"))
    return e.groupBy("domain").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(F.size("e") == 0).cast("int").alias("valid"), F.count_if(F.exists("e", lambda x: x["code"] == "clue")).cast("int").alias("off"))


@query("""SELECT 'webnlg:train:' || p_partkey AS source_id, form, p_name AS subject, 'brand' AS predicate, p_brand AS object, p_type AS category, 1 AS triple_count
FROM part, (VALUES ('head'), ('property'), ('alone'), ('listed'), ('nested'), ('text')) v(form)""")
def triple_forms(spark, d):
    """One triple of each part in the forms that raw rows may give it in."""
    p = t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("category"), "p_name", "p_brand")
    s, o, k = F.col("p_name"), F.col("p_brand"), F.lit("brand")
    forms = {
        "head": F.array(F.struct(s.alias("head"), k.alias("relation"), o.alias("tail"))),
        "property": F.array(F.struct(F.lit("").alias("subject"), s.alias("s"), k.alias("property"), o.alias("o"))),
        "alone": F.struct(s.alias("subject"), k.alias("r"), o.alias("object")),
        "listed": F.array(F.array(s, k, o, F.lit("more"))),
        "nested": F.array(F.array(F.array(s, k, o))),
        "text": F.array(F.concat_ws("|||", s, k, o), F.lit("no triple")),
    }
    out = None
    for name, form in forms.items():
        r = records.normalize(p.select("id", "category", form.alias("modified_triple_sets")), "webnlg", F.lit("train"))
        r = r.select("source_id", F.lit(name).alias("form"), F.explode("reference_plan.triples").alias("t"), "category", "triple_count").select("source_id", "form", "t.subject", "t.predicate", "t.object", "category", "triple_count")
        out = r if out is None else out.unionByName(r)
    return out


_DART_SQL = """r AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_linestatus AS source, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 2 END AS n FROM lineitem),
q AS (SELECT *, 'dart:train:' || id AS source_id, [to_json(source)::VARCHAR, to_json(CAST(n AS VARCHAR))::VARCHAR, to_json(CAST(n AS VARCHAR))::VARCHAR] AS st FROM r),
h AS (SELECT *, sha256(concat_ws('|', '42', to_json(st)::VARCHAR, source_id)) AS h FROM q),
w AS (SELECT st, count(*) AS c, (SELECT floor(count(*) * 0.1 + 0.5) FROM q) AS total, sum(count(*)) OVER () AS al FROM q GROUP BY st),
b AS (SELECT *, total * c / al AS raw, floor(total * c / al) AS base FROM w),
a AS (SELECT st, base + CASE WHEN row_number() OVER (ORDER BY raw - base DESC, st) <= total - sum(base) OVER () THEN 1 ELSE 0 END AS share FROM b)"""


@query(f"WITH {_DART_SQL} SELECT source_id, source, n AS schema_cardinality, n AS triple_count FROM (SELECT *, row_number() OVER (PARTITION BY st ORDER BY h, source_id) AS k FROM h) JOIN a USING (st) WHERE k <= share")
def dart_sample(spark, d):
    """A tenth of cell records, proportional over their source, number of columns and number of cells."""
    li = t(spark, d, "lineitem")
    name = F.concat_ws("-", "l_orderkey", "l_linenumber")
    cells = F.array(F.array(name, F.lit("flag"), F.col("l_returnflag")), F.array(name, F.lit("status"), F.col("l_linestatus")))
    raw = li.select(name.alias("id"), F.slice(cells, F.lit(1), F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(2)).alias("tripleset"), F.array("l_linestatus").alias("target_sources"))
    r = records.normalize(raw, "dart", F.lit("train")).select("source_id", "source", "schema_cardinality", "triple_count")
    return sampling.stratified_sample(r, "source_id", ["source", "schema_cardinality", "triple_count"], 0.1, SEED)


@query("""SELECT 'zebralogic:train:' || c_custkey AS source_id, 'zebra_' || lower(CASE WHEN c_custkey % 2 = 0 THEN 'EASY' ELSE 'Hard' END) AS domain, 'zebra_' || lower(CASE WHEN c_custkey % 2 = 0 THEN 'EASY' ELSE 'Hard' END) || ':' || c_custkey AS schema_id,
2 AS grid_size, 2 AS clue_count, 'fixed_position,left_of' AS clue_types, CAST(c_custkey AS VARCHAR) AS puzzle_family, CAST(c_custkey % 3 = 0 AS INT) AS errors, upper(substr(x, 1, 1)) || lower(substr(x, 2)) AS "group" FROM customer, LATERAL (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'EASY' ELSE 'Hard' END AS x)""")
def raw_grids(spark, d):
    """Grids given as raw rows, columns as JSON text or as maps; for every third the solution contradicts its clues."""
    c = t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("a"), F.concat("c_name", F.lit("'s friend")).alias("b"))
    first, second = F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0), F.when(F.col("c_custkey") % 3 == 0, 0).otherwise(1)
    ref = lambda x: F.struct(F.lit("who").alias("category"), x.alias("item"))
    none = F.lit(None).cast("struct<category:string,item:string>")
    clue = lambda kind, x, y, p: F.struct(F.lit(kind).alias("type"), ref(x).alias("left"), y.alias("right"), p.cast("int").alias("position"))
    clues = F.array(clue("fixed_position", F.col("a"), none, F.lit(0)), clue("left_of", F.col("a"), ref(F.col("b")).cast("struct<category:string,item:string>"), F.lit(None)))
    raw = c.select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "EASY").otherwise("Hard").alias("level"), F.to_json(F.create_map(F.lit("who"), F.array("a", "b"))).alias("categories"), clues.alias("clues"), F.create_map(F.lit("who"), F.create_map("a", first, "b", second)).alias("solution"))
    r = records.normalize(raw, "zebralogic", F.lit("train"))
    e = r.withColumn("plan", F.col("reference_plan")).withColumn("constraints", records.constraints("zebralogic"))
    e = e.withColumn("errors", F.size(F.array_distinct(F.transform(validate.errors(), lambda x: x["code"]))))
    group = records.record_group(F.col("domain"), F.col("category"), F.col("source"), F.col("n_star"))
    return e.select("source_id", "domain", "schema_id", "grid_size", "clue_count", F.array_join("clue_type", ",").alias("clue_types"), "puzzle_family", "errors", group.alias("group"))


# --- metrics -------------------------------------------------------------------------------------------------------------

_WEEKS = "SELECT event_type, count(*) FILTER (day(ts) <= 7)::DOUBLE AS a, count(*) FILTER (day(ts) BETWEEN 8 AND 14)::DOUBLE AS b FROM events GROUP BY event_type"


def weeks(spark, d) -> DataFrame:
    e = t(spark, d, "events").select("event_type", F.dayofmonth("ts").alias("day"))
    w = e.groupBy("event_type").agg(F.count_if(F.col("day") <= 7).cast("double").alias("a"), F.count_if(F.col("day").between(8, 14)).cast("double").alias("b"))
    all_ = Window.partitionBy()
    return w.withColumns({"ta": F.sum("a").over(all_), "tb": F.sum("b").over(all_)})


_P = f"SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM ({_WEEKS})"


@query(f"SELECT round(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 9) AS js FROM ({_P})")
def js_divergence(spark, d):
    return weeks(spark, d).agg(F.round(M.jensen_shannon(F.col("a"), F.col("b"), F.col("ta"), F.col("tb")), 9).alias("js"))


_C = "least(greatest({0}, 1e-12), 1 - 1e-12)"


@query(f"SELECT round(avg({_C.format('p')} * ln({_C.format('p')} / {_C.format('q')}) + (1 - {_C.format('p')}) * ln((1 - {_C.format('p')}) / (1 - {_C.format('q')}))), 9) AS kl FROM ({_P})")
def marginal_kl(spark, d):
    w = weeks(spark, d)
    return w.agg(F.round(F.avg(M.bernoulli_kl(F.col("a") / F.col("ta"), F.col("b") / F.col("tb"))), 9).alias("kl"))


_B = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"


@query(f"SELECT round(avg(({_B.format('p', 'q')} + {_B.format('q', 'p')} + {_B.format('(1 - p)', '(1 - q)')} + {_B.format('(1 - q)', '(1 - p)')}) / 2), 9) AS js FROM ({_P})")
def marginal_js(spark, d):
    w = weeks(spark, d)
    return w.agg(F.round(F.avg(M.bernoulli_js(F.col("a") / F.col("ta"), F.col("b") / F.col("tb"))), 9).alias("js"))


@query(f"SELECT round(sqrt(avg(power(p - q, 2))), 9) AS rmse FROM ({_P})")
def coverage_error(spark, d):
    w = weeks(spark, d)
    return w.agg(F.round(M.coverage_error(M.sanitised(F.col("a") / F.col("ta")), M.sanitised(F.col("b") / F.col("tb"))), 9).alias("rmse"))


@query("SELECT event_type, round(avg(ln(1 + value)) / ln(2), 9) AS bpt, round(exp(avg(ln(1 + value))), 6) AS ppl FROM events GROUP BY event_type")
def bpt_perplexity(spark, d):
    e = t(spark, d, "events").select("event_type", (-F.ln(1 + F.col("value"))).alias("lp"))
    return e.groupBy("event_type").agg(F.round(M.bits_per_token(F.col("lp")), 9).alias("bpt"), F.round(M.perplexity(F.col("lp")), 6).alias("ppl"))


@query("""WITH o AS (SELECT o_orderstatus AS variant, o_orderpriority AS dataset, CAST(o_custkey % 3 AS VARCHAR) AS grp, o_totalprice AS v FROM orders)
SELECT variant, level, slice, count(*) AS n, round(avg(CASE WHEN v > 100000 THEN 1.0 ELSE 0.0 END), 9) AS rate FROM (SELECT variant, v, unnest(['all', 'dataset', 'domain', 'group']) AS level, unnest(['all', dataset, dataset || '/' || grp, grp]) AS slice FROM o) GROUP BY ALL""")
def metric_slices(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderstatus").alias("variant"), F.col("o_orderpriority").alias("dataset"), F.pmod("o_custkey", F.lit(3)).cast("string").alias("group"), (F.col("o_totalprice") > 100000).alias("ok"))
    s = evaluate.slices(o.withColumn("domain", F.concat_ws("/", "dataset", "group")))
    return s.groupBy("variant", "level", "slice").agg(F.count(F.lit(1)).alias("n"), F.round(M.rate(F.col("ok")), 9).alias("rate"))


def part_outputs(spark, d) -> DataFrame:
    """Outputs of two variants: the template's text, and one that lost its first sentence for odd keys."""
    r = part_records(spark, d).select("source_id", F.col("reference_plan").alias("plan"), F.substring_index("source_id", ":", -1).cast("long").alias("k"))
    text = realize.plan_text(F.col("plan"))
    x = r.withColumn("v", F.explode(F.array(F.lit("constrained"), F.lit("free"))))
    x = x.withColumn("text", F.when((F.col("v") == "free") & (F.col("k") % 2 == 1), F.regexp_replace(text, r"^.*?\. ", "")).otherwise(text))
    return x.select(F.concat_ws("/", "v", "source_id").alias("output_id"), F.col("v").alias("variant"), "k", F.lit("webnlg").alias("domain"), F.lit("webnlg").alias("dataset"), (F.col("k") % 2).cast("string").alias("group"), "plan", "text")


@query("""SELECT v || '/webnlg:train:' || p_partkey AS output_id, CASE WHEN v = 'free' AND p_partkey % 2 = 1 THEN 2 ELSE 3 END AS hits, 3 AS facts, 1.0::DOUBLE AS "precision" FROM part, (VALUES ('constrained'), ('free')) x(v)""")
def fact_coverage(spark, d):
    o = part_outputs(spark, d)
    vocabulary = o.select("domain", F.explode(F.transform(realize.facts(F.col("plan")), realize.canonical_fact)).alias("fact"))
    return evaluate.fact_scores(o, "output_id", vocabulary)


@query("""SELECT x.v AS variant, s.level, CASE s.level WHEN 'all' THEN 'all' WHEN 'group' THEN CAST(p_partkey % 2 AS VARCHAR) ELSE 'webnlg' END AS slice, count(*) AS outputs,
avg(CASE WHEN v = 'free' AND p_partkey % 2 = 1 THEN 0.0 ELSE 1.0 END) AS schema_validity, 1.0::DOUBLE AS fact_precision, round(sum(CASE WHEN v = 'free' AND p_partkey % 2 = 1 THEN 2 ELSE 3 END) / sum(3), 9) AS fact_coverage, 1.0::DOUBLE AS bits_per_token
FROM part, (VALUES ('constrained'), ('free')) x(v), (VALUES ('all'), ('dataset'), ('domain'), ('group')) s(level) GROUP BY ALL""")
def evaluation_report(spark, d):
    o = part_outputs(spark, d)
    vocabulary = o.select("domain", F.explode(F.transform(realize.facts(F.col("plan")), realize.canonical_fact)).alias("fact"))
    s = evaluate.fact_scores(o, "output_id", vocabulary, ("variant", "dataset", "domain", "group")).withColumns({"valid": F.col("hits") == F.col("facts"), "plan_valid": F.lit(True), "term_precision": F.lit(1.0), "generation_ms": F.lit(0.0), "token_log_probabilities": F.array_repeat(F.lit(-0.6931471805599453), 2)})
    r = evaluate.quality(s)
    return r.select("variant", "level", "slice", "outputs", "schema_validity", F.round("fact_precision", 9).alias("fact_precision"), F.round("fact_coverage", 9).alias("fact_coverage"), F.round("bits_per_token", 9).alias("bits_per_token"))


@query()
def slice_divergence(spark, d):
    o = part_outputs(spark, d)
    one = o.filter("variant = 'constrained'")
    n = one.agg(F.count(F.lit(1)).alias("n"))
    states = one.crossJoin(F.broadcast(n)).select(F.col("output_id").alias("state_id"), "dataset", "domain", "group", (1 / F.col("n")).alias("p"))
    f = evaluate.realized_features(one, "output_id").withColumnRenamed("output_id", "state_id")
    space = circuit.local(circuit.feature_space(f, states, (64, 64, 16)))
    kept = evaluate.slice_targets(states, circuit.with_pairs(f, space))
    r = evaluate.divergence(o, "output_id", space, kept)
    return r.select("variant", "level", "slice", *[F.round(c, 9).alias(c) for c in ("coverage_error", "rare_coverage", "jensen_shannon", "kl", "all_feature_error")])


_BERNOULLI = "greatest(1e-12, least(1 - 1e-12, {0}))"


@query(f"""WITH o AS (SELECT p_partkey, v AS variant, CAST(p_partkey % 2 AS VARCHAR) AS grp, CASE WHEN v = 'free' AND p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS z FROM part, (VALUES ('constrained'), ('free')) x(v)),
s AS (SELECT variant, level, slice, z FROM (SELECT variant, z, unnest(['all', 'dataset', 'domain', 'group']) AS level, unnest(['all', 'webnlg', 'webnlg', grp]) AS slice FROM o)),
n AS (SELECT variant, level, slice, count(*) AS n FROM s GROUP BY ALL),
e AS (SELECT variant, level, slice, z, count(*) AS k FROM s WHERE z IS NOT NULL GROUP BY ALL),
t AS (SELECT level, slice, z, k / n AS target FROM e JOIN n USING (variant, level, slice) WHERE variant = 'constrained' AND z <> '1'),
a AS (SELECT z FROM t UNION SELECT '1'),
j AS (SELECT n.variant, n.level, n.slice, coalesce(e.k, 0) / n.n AS o, {_BERNOULLI.format('coalesce(t.target, 0.0)')} AS q, coalesce(t.target, 0.0) AS target FROM n CROSS JOIN a LEFT JOIN e ON n.variant = e.variant AND n.level = e.level AND n.slice = e.slice AND a.z = e.z LEFT JOIN t ON n.level = t.level AND n.slice = t.slice AND a.z = t.z)
SELECT variant, level, slice, round(avg({_BERNOULLI.format('o')} * ln({_BERNOULLI.format('o')} / q) + (1 - {_BERNOULLI.format('o')}) * ln((1 - {_BERNOULLI.format('o')}) / (1 - q))), 6) AS kl, count(*) AS features FROM j WHERE target > 0 OR o > 0 GROUP BY ALL""")
def slice_drift(spark, d):
    """Drift of one attribute's marginals: a feature that outputs hold has no target, and one variant lacks some of them."""
    p = t(spark, d, "part").select("p_partkey", F.concat(F.lit("z"), F.col("p_size").cast("string")).alias("z"))
    o = p.withColumn("variant", F.explode(F.array(F.lit("constrained"), F.lit("free"))))
    triples = F.array(F.struct(F.lit("s").alias("subject"), F.lit("r").alias("predicate"), F.col("z").alias("object"), F.lit(None).cast("string").alias("subject_type"), F.lit(None).cast("string").alias("object_type")))
    o = o.withColumn("_t", triples).withColumn("plan", F.expr(empty_plan(domain="'webnlg'", schema_id="NULL", triples="_t")))
    text = F.when((F.col("variant") == "free") & (F.col("p_partkey") % 4 == 0), "nothing").otherwise(F.col("z"))
    o = o.select(F.concat_ws("/", "variant", "p_partkey").alias("output_id"), "variant", F.lit("webnlg").alias("dataset"), F.lit("webnlg").alias("domain"), (F.col("p_partkey") % 2).cast("string").alias("group"), "plan", text.alias("text"))
    one = o.filter("variant = 'constrained'").select(F.col("output_id").alias("state_id"), "dataset", "domain", "group", F.lit(1.0).alias("p"), F.element_at("plan.triples", 1)["object"].alias("z"))
    f = one.filter("z <> 'z1'").select("state_id", F.concat(F.lit("attribute:webnlg:"), "z").alias("feature"))
    space = one.select(F.concat(F.lit("attribute:webnlg:"), "z").alias("feature"), F.lit("attribute").alias("family")).distinct()
    r = evaluate.divergence(o, "output_id", space, evaluate.slice_targets(one, f))
    used = evaluate.slices(o.withColumn("feature", F.explode(evaluate.realized(F.col("plan"), F.col("text"), F.col("domain"))))).join(F.broadcast(space), "feature")
    seen = used.select("variant", "level", "slice", "feature")
    held = evaluate.slices(one).filter("z <> 'z1'").select("level", "slice", F.concat(F.lit("attribute:webnlg:"), "z").alias("feature")).distinct()
    both = seen.unionByName(o.select("variant").distinct().join(F.broadcast(held)).select("variant", "level", "slice", "feature")).distinct()
    n = both.groupBy("variant", "level", "slice").agg(F.count(F.lit(1)).alias("features"))
    return r.join(n, ["variant", "level", "slice"]).select("variant", "level", "slice", F.round("kl", 6).alias("kl"), "features")


_ALIGN_SQL = """WITH n AS (SELECT max(p_partkey) AS n FROM part),
o AS (SELECT v AS variant, p_partkey AS k, CASE WHEN v = 'moved' AND p_partkey = 3 THEN 'x' ELSE CAST(p_partkey AS VARCHAR) END AS id FROM part, n, (VALUES ('constrained'), ('free'), ('short'), ('half'), ('moved'), ('extra')) x(v)
  WHERE v IN ('constrained', 'free') OR (v = 'short' AND p_partkey <= n // 4) OR (v IN ('half', 'moved') AND p_partkey <= n // 2) OR (v = 'extra' AND p_partkey <= 5)),
b AS (SELECT variant, budget FROM n, LATERAL (VALUES ('constrained', n), ('free', n), ('short', n // 4 + 1), ('half', n // 2), ('moved', n // 2)) x(variant, budget)),
p AS (SELECT variant, count(*) AS c, string_agg(k || '/' || id, ',' ORDER BY k) AS ids FROM o GROUP BY variant),
j AS (SELECT coalesce(p.variant, b.variant) AS variant, budget, coalesce(c = budget, false) AS complete, ids FROM p FULL JOIN b ON p.variant = b.variant)
SELECT CAST(budget AS BIGINT) AS budget, count(*) AS variants, bool_and(complete) AS complete, bool_and(complete) AND count(DISTINCT ids) <= 1 AS same FROM j GROUP BY budget"""


@query(_ALIGN_SQL)
def variant_alignment(spark, d):
    """Two variants that agree, one short of its budget, two of a budget that differ in one id, and one without a budget."""
    n = t(spark, d, "part").agg(F.max("p_partkey")).first()[0]
    upto = {"constrained": n, "free": n, "short": n // 4, "half": n // 2, "moved": n // 2, "extra": 5}
    limit = F.create_map(*[F.lit(x) for k, v in upto.items() for x in (k, v)])
    o = t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.explode(F.array(*map(F.lit, upto))).alias("variant")).filter(F.col("k") <= limit[F.col("variant")])
    name = F.when((F.col("variant") == "moved") & (F.col("k") == 3), "x").otherwise(F.col("k").cast("string"))
    o = o.select("variant", F.col("k").alias("generation_index"), name.alias("eval_id"), C.hash_seed(F.col("k")).alias("generation_seed"))
    return evaluate.aligned(o, {"constrained": n, "free": n, "short": n // 4 + 1, "half": n // 2, "moved": n // 2})


@query("""WITH r AS (SELECT o_orderstatus AS domain, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k FROM orders WHERE o_totalprice > 50000)
SELECT domain, o_orderkey FROM r WHERE k <= CASE domain WHEN 'F' THEN 20 WHEN 'O' THEN 30 ELSE 10 END""")
def quota_acceptance(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderstatus").alias("domain"), "o_orderkey", (F.col("o_totalprice") > 50000).alias("accepted"))
    return sampling.capped_accept(o, "domain", {"F": 20, "O": 30, "P": 10}, ["o_orderkey"]).select("domain", "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def resume_pending(spark, d):
    o = t(spark, d, "orders").select(F.lit("v").alias("variant"), F.col("o_orderkey").alias("generation_index"))
    return evaluate.pending(o, o.filter("generation_index % 3 = 0")).select(F.col("generation_index").alias("o_orderkey"))


from . import record_queries  # noqa: E402, F401  registers its queries beside these
