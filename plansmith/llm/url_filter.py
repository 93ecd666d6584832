"""URL filters: longest matching rule, and link-graph propagation of trust and distrust for what no rule covers.

A rule (host and path prefix) fits its host and all subdomains where the url's path begins with the rule's; of several the
longest wins. Hosts with pages under an allow rule are trusted seeds, hosts with pages under a block rule that covers whole
hosts (path /) are blocked seeds. Links of the pages' HTML become weighted edges between hosts (relative links stay on
their host and carry nothing). Trust is personalised PageRank from the trusted seeds along the edges; distrust is the same
from the blocked seeds along reversed edges, so that it reaches who links to blocked hosts. Every seed begins with a mass of 1,
whatever the number of seeds; a host whose distrust reaches ``threshold`` and exceeds its trust is blocked, and pages
that no rule fits take their host's verdict. Masses are told apart to ``DIGITS`` decimals, which sums' order doesn't reach; equal
ones (a host that is a seed of both, with no links) trust. A page without a host is allowed.

Edges are summed by (from, to) before anything else, so that no host's pages meet in one task; rounds are joins and grouped
sums over the host edges, written to the shared folder, until the changes of a kind's masses add up to less than ``tolerance`` seeds'.
A round leaves 0.85 of them at most, so that comes at any size.

Defined results: a null url, or one without ://, has empty host and path and no rule; null HTML has no links; repeated
pages each get their row and count as links once more; extra columns are left alone; empty tables give empty results.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read

#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
THRESHOLD = 0.1
DIGITS = 9
#: Changes, as a share of a kind's total mass, that are rounding errors of the sums.
ROUNDING = 1e-14
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]*)"""


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"(?s)^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"(?s)^[^/?#]*([^?#]*)", 1)


def matched(host_: Column, path_: Column, rules=RULES) -> Column:
    """The longest fitting rule as host and path, else null. Few rules: they become one CASE."""
    out = None
    for _, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host_ == h) | F.endswith(host_, F.lit("." + h))) & F.startswith(path_, F.lit(p))
        out = F.when(fits, F.lit(h + p)) if out is None else out.when(fits, F.lit(h + p))
    return out


def ruled(rule: Column, rules=RULES) -> Column:
    out = None
    for v, h, p in rules:
        out = F.when(rule == h + p, F.lit(v)) if out is None else out.when(rule == h + p, F.lit(v))
    return out


def edges(pages: DataFrame) -> DataFrame:
    """src, dst and w: how many links of src's pages lead to another host."""
    links = pages.select(host(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("to"))
    whole = F.when(F.startswith("to", F.lit("//")), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))
    return links.select("src", host(whole).alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def propagate(links: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = DAMPING, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """links(kind, src, dst, w), seeds(kind, host, seed: its mass): kind, host and rank. Mass of hosts without links goes back to
    the seeds. Rounds are not limited unless ``rounds`` says so."""
    out = links.groupBy("kind", "src").agg(F.sum("w").alias("sum"))
    shares = scratch.keep(links.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("sum")).alias("p")))
    ranks = scratch.keep(seeds.select("kind", "host", F.col("seed").alias("rank")), few=True)
    if shares.isEmpty():
        return ranks
    total = seeds.groupBy("kind").agg(F.sum("seed").alias("total"), F.avg("seed").alias("mean"))
    masses = {r["kind"]: (r["total"], r["mean"]) for r in total.collect()}
    seeds = seeds.join(F.broadcast(total.select("kind", "total")), "kind")  # a row a kind
    for _ in itertools.count() if rounds is None else range(rounds):
        flow = shares.join(ranks.select("kind", F.col("host").alias("src"), "rank"), ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg((damping * F.sum(F.col("p") * F.col("rank"))).alias("got"))
        moved = flow.groupBy("kind").agg(F.sum("got").alias("moved"))
        back = seeds.join(moved, "kind", "left").select("kind", "host", (F.col("seed") * (1 - F.coalesce("moved", F.lit(0.0)) / F.col("total"))).alias("got"))
        new = flow.unionByName(back).groupBy("kind", "host").agg(F.sum("got").alias("rank"))
        nxt = scratch.keep(new.join(ranks.withColumnRenamed("rank", "was"), ["kind", "host"], "full").select("kind", "host", F.coalesce("rank", F.lit(0.0)).alias("rank"), F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))).alias("change")), few=True)
        changes = nxt.groupBy("kind").agg(F.sum("change").alias("change")).collect()
        scratch.drop(ranks)
        ranks = nxt
        if all(r["change"] < max(tolerance * masses[r["kind"]][1], ROUNDING * masses[r["kind"]][0]) for r in changes if r["kind"] in masses):
            break
    return ranks.select("kind", "host", "rank")


def judge_hosts(pages: DataFrame, rules=RULES, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """host, trust, distrust (a seed begins with 1) and blocked, for hosts that either reaches."""
    scratch = Scratch(pages.sparkSession, "hosts")
    known = pages.select(host(F.col("url")).alias("host"), matched(host(F.col("url")), path(F.col("url")), rules).alias("rule")).filter("host <> ''")
    wide = [h + p for v, h, p in rules if v == "block" and p == "/"]
    allow = [h + p for v, h, p in rules if v == "allow"]
    under = lambda names: F.max(F.col("rule").isin(names)) if names else F.lit(False)
    marks = known.groupBy("host").agg(F.coalesce(under(allow), F.lit(False)).alias("trust"), F.coalesce(under(wide), F.lit(False)).alias("distrust"))
    seeds = scratch.keep(marks.select("host", F.explode(F.array(F.when(F.col("trust"), F.lit("trust")), F.when(F.col("distrust"), F.lit("distrust")))).alias("kind")).filter("kind IS NOT NULL").withColumn("seed", F.lit(1.0)))
    e = scratch.keep(edges(pages))
    both = e.select(F.lit("trust").alias("kind"), "src", "dst", "w").unionByName(e.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    ranks = propagate(both, seeds, scratch, damping)
    mass = ranks.select("kind", "host", F.col("rank").alias("mass"))
    each = mass.groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("mass"))), F.lit(0.0)).alias("trust"), F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("mass"))), F.lit(0.0)).alias("distrust"))
    more = (F.round("distrust", DIGITS) >= threshold) & (F.round(F.col("distrust") - F.col("trust"), DIGITS) > 0)
    return each.withColumn("blocked", more)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict."""
    p = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    p = p.withColumn("rule", matched(F.col("host"), F.col("path"), rules))
    blocked = judge_hosts(pages.select("url", "html"), rules).filter("blocked").select(F.col("host").alias("_host"))
    # only pages without a rule need their host's verdict; the rest pass by the join
    asked = F.when(F.col("rule").isNull(), F.col("host"))
    verdict = F.coalesce(ruled(F.col("rule"), rules), F.when(F.col("_host").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    open_ = p.filter("rule IS NULL").withColumn("asked", asked).join(blocked, F.col("asked") == F.col("_host"), "left")
    return p.filter("rule IS NOT NULL").withColumn("_host", F.lit(None).cast("string")).unionByName(open_.drop("asked")).withColumn("verdict", verdict).drop("_host")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _fits_sql(h: str, p: str) -> str:
    return f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')"


_LONGEST = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_SEED_SQL = {v: " OR ".join(f"rule = '{h + p}'" for x, h, p in RULES if x == v and (v == "allow" or p == "/")) for v in ("allow", "block")}
#: For tables without links between hosts, as the given ones are: there every seed keeps its mass of 1.
ORACLE_SQL = {
    "op10_url_filter": f"""
WITH a AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT *, CASE {' '.join(f"WHEN {_fits_sql(x, p)} THEN '{x + p}'" for _, x, p in _LONGEST)} END AS rule FROM h),
s AS (SELECT host, coalesce(bool_or({_SEED_SQL['allow']}), false) AS trust, coalesce(bool_or({_SEED_SQL['block']}), false) AS distrust FROM r WHERE host <> '' GROUP BY host)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{x + p}' THEN '{v}'" for v, x, p in RULES)} WHEN distrust AND NOT trust THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN s USING (host)"""
}
