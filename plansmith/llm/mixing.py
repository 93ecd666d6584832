"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: sources in order of their code points (null last) weigh ``WEIGHTS`` in turn and share all words; a target stops at
``EPOCHS`` times its source's size, and the excess is shared anew by weight until no target is above its stop.

Each source's documents are laid end to end in a shuffled order (MD5 of id and text), a line that is walked again and again,
and cut into blocks of equal numbers of words: ``BLOCK``, or as many as give the mix about ``SLOTS`` slots, if those are fewer.
Slot t of the schedule is the point t·g mod 2^31, g being 2^31 over the golden ratio, mapped through the sources' cumulative
targets: any stretch of the schedule holds each source nearly in proportion. Slots are ranked per source, and the r-th slot of
a source takes its r-th block. The mix is the schedule's first slots, as many as hold all words: what a source gives is what
its slots take, some blocks more or less than its target, and never more than its stop. Words that a document gives are
summed over its blocks; the first slot that takes of it, and how many do, say where it stands in the mix.

Nothing is ordered in one task: offsets in a source's line and ranks of slots are sums over buckets that grow in number with
the rows, plus a running sum over the buckets; slots find their source by an equi-join on slices of the interval. Sizes are
counted once, the text isn't moved.

Defined results: null and empty texts have size 0 and give 0; a source of size 0 has target 0; a null source is a source; a
null id is one like any other; rows that repeat source, id and text share evenly, in whole words, what they give together (what
is left over isn't taken); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read

WEIGHTS = (5, 2, 1)
EPOCHS = 3
BLOCK = 512
SLOTS = 1 << 19
#: Rows that a bucket of a source's line is meant to hold.
BUCKET_ROWS = 1 << 12
_GRID = 1 << 31
_STEP = 1327217885  # 2^31 over the golden ratio, odd
_SLICE = 1 << 19
_CHUNK = 1 << 14
_WORD = r"[^\x20\x09-\x0D]+"


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, text: Column) -> Column:
    """Where a row stands in its source's line; equal only for rows of equal id and text."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sizes(source, source_size): adds sid (rank from 1), stop, target (double) and quota (the target in whole words)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("sid", F.row_number().over(order)).withColumn("w", weight.cast("long")).withColumn("stop", epochs * F.col("source_size"))
    # the sources that stop are the first by stop over weight: one running sum finds where sharing begins
    by = Window.orderBy(F.col("stop") / F.col("w"), "sid")
    all_ = Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(all_) - F.sum("stop").over(by) + F.col("stop")).withColumn("wleft", F.sum("w").over(all_) - F.sum("w").over(by) + F.col("w"))
    s = s.withColumn("stops", F.col("stop") * F.col("wleft") <= F.col("left") * F.col("w"))
    open_ = F.min(F.when(~F.col("stops"), F.struct(F.col("stop") / F.col("w"), "sid", "left", "wleft"))).over(all_)
    s = s.withColumn("open", open_).withColumn("target", F.when(F.col("stops"), F.col("stop").cast("double")).otherwise(F.col("w") * (F.col("open.left") / F.col("open.wleft"))))
    return s.select("source", "source_size", "sid", "stop", "target", F.floor(F.col("target") + 0.5).cast("long").alias("quota"))


def lines(rows: DataFrame, n: int) -> DataFrame:
    """rows(sid, h, size, copies), one a sid and h, about n in all: adds off, where the row's copies begin in its source's line."""
    digits = 3
    while n >> 4 * digits > BUCKET_ROWS:
        digits += 1
    d = rows.withColumn("bucket", F.substring("h", 1, digits)).withColumn("length", F.col("size") * F.col("copies"))
    sums = d.groupBy("sid", "bucket").agg(F.sum("length").alias("n"))
    before = Window.partitionBy("sid").orderBy("bucket")
    starts = sums.select("sid", "bucket", (F.sum("n").over(before) - F.col("n")).alias("start"))
    inside = Window.partitionBy("sid", "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("run", F.sum("length").over(inside)).join(starts, ["sid", "bucket"]).withColumn("off", F.col("start") + F.col("run") - F.col("length")).drop("bucket", "run", "start")


def block_of(words: int, block: int = BLOCK, slots: int = SLOTS) -> int:
    return max(1, min(block, words // slots))


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """slot, sid and rank (of the slot among its source's): the first slots of the mix in order. sources(sid, quota)."""
    spark = sources.sparkSession
    by = Window.orderBy("sid")
    scale = F.lit(float(_GRID)) / F.col("all")
    upto = sources.filter("quota > 0").select("sid", "quota", F.sum("quota").over(by).alias("upto"), F.sum("quota").over(Window.partitionBy()).alias("all"))
    hi = F.when(F.col("upto") == F.col("all"), F.lit(_GRID)).otherwise(F.floor(F.col("upto") * scale)).cast("long")
    ivals = upto.select("sid", F.floor((F.col("upto") - F.col("quota")) * scale).cast("long").alias("lo"), hi.alias("hi")).filter("hi > lo")
    slices = ivals.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / _SLICE), F.floor((F.col("hi") - 1) / _SLICE))).alias("slice"))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.pmod("id", F.lit(_GRID)) * F.lit(_STEP), F.lit(_GRID)).alias("u")).withColumn("slice", F.floor(F.col("u") / _SLICE))
    dealt = points.join(slices, "slice").filter("u >= lo AND u < hi").select("slot", "sid", F.floor(F.col("slot") / _CHUNK).alias("chunk"))
    counts = dealt.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("sid", "chunk", (F.sum("c").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("c")).alias("start"))
    inside = Window.partitionBy("chunk", "sid").orderBy("slot")
    return dealt.withColumn("rn", F.row_number().over(inside)).join(before, ["sid", "chunk"]).select("slot", "sid", (F.col("start") + F.col("rn") - 1).alias("rank"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK) -> DataFrame:
    """One row per source and h of docs(doc_id, source, text): doc_id, source, h (see order_key), copies (rows alike), size,
    source_size, target, taken (by each copy), first_slot (null where nothing is taken) and slots (that take of the copies)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    counted = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", order_key(F.col("doc_id"), F.col("text")).alias("h"), size(F.col("text")).alias("size")), few=True)
    sources = scratch.keep(targets(counted.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs), few=True)
    n, words = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    alike = counted.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id"), F.min("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    known = alike.join(F.broadcast(sources.withColumnRenamed("source", "_source")) if _few(sources) else sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = scratch.keep(lines(known, n), few=True)
    block = block_of(words, block)
    return _taken(placed, scratch.keep(schedule(sources, -(-words // block)), few=True), block)


def _few(sources: DataFrame) -> bool:
    return sources.limit(10_001).count() <= 10_000


def _taken(placed: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    # what a source's slots reach of its line, walked again and again, and where each pass of a row overlaps each block
    reach = slots.groupBy("sid").agg((F.count(F.lit(1)) * block).alias("reach"))
    line = placed.filter("size > 0").join(reach, "sid").withColumn("reach", F.least("reach", "stop")).filter("reach > off")
    line = line.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("reach") - 1 - F.col("off")) / F.col("source_size")))))
    line = line.withColumn("a", F.col("pass") * F.col("source_size") + F.col("off")).withColumn("b", F.least(F.col("a") + F.col("length"), F.col("reach")))
    pieces = line.select("sid", "h", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))).alias("rank"))
    words = F.least(F.col("b"), (F.col("rank") + 1) * block) - F.greatest(F.col("a"), F.col("rank") * block)
    given = pieces.join(slots, ["sid", "rank"]).groupBy("sid", "h").agg(F.sum(words).alias("words"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("slots"))
    out = placed.join(given, ["sid", "h"], "left")
    taken = F.floor(F.coalesce("words", F.lit(0)) / F.col("copies")).cast("long")
    return out.select("doc_id", "source", "h", "copies", "size", "source_size", "target", taken.alias("taken"), "first_slot", F.coalesce("slots", F.lit(0)).cast("long").alias("slots"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "slots")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target, taken and first_slot beside their columns. A
    column of docs that bears one of these names gives way."""
    new = ["size", "source_size", "target", "taken", "first_slot"]
    taken = mix(docs.select("doc_id", "source", "text"), weights, epochs).filter("taken > 0").select("h", F.col("source").alias("_source"), *new)
    # the row's columns travel as one struct, so that no name can clash
    own = docs.select(order_key(F.col("doc_id"), F.col("text")).alias("_h"), F.struct(*[F.col(c) for c in docs.columns if c not in new]).alias("_doc"))
    on = (F.col("_h") == F.col("h")) & F.col("_doc.source").eqNullSafe(F.col("_source"))
    return own.join(taken.hint("shuffle_hash"), on).select("_doc.*", *new)


_SIZE_SQL = r"CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)"
ORACLE_SQL = {
    "op8_mixing": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_SIZE_SQL} AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY source),
s AS (SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS stop FROM s0),
share(k, stopped, lam) AS (
  SELECT 0, CAST([] AS BIGINT[]), (SELECT CAST(sum(source_size) AS DOUBLE) / sum(w) FROM s)
  UNION ALL
  SELECT k + 1, now, (SELECT CAST((SELECT sum(source_size) FROM s) - coalesce(sum(stop) FILTER (list_contains(now, sid)), 0) AS DOUBLE) / sum(w) FILTER (NOT list_contains(now, sid)) FROM s)
  FROM (SELECT k, stopped, (SELECT coalesce(list(sid), []) FROM s WHERE stop <= w * lam) AS now FROM share) WHERE len(now) > len(stopped)),
l AS (SELECT stopped, lam FROM (SELECT * FROM share ORDER BY k DESC LIMIT 1)),
t AS (SELECT s.*, CASE WHEN stop <= w * lam THEN CAST(stop AS DOUBLE) ELSE w * lam END AS target FROM s, l),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t),
c AS (SELECT *, CAST(greatest(1, least({BLOCK}, words // {SLOTS})) AS BIGINT) AS block FROM (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS words FROM d)),
i0 AS (SELECT sid, quota, CAST(sum(quota) OVER (ORDER BY sid) AS BIGINT) AS upto, CAST(sum(quota) OVER () AS BIGINT) AS al FROM q WHERE quota > 0),
iv AS (SELECT sid, CAST(floor((upto - quota) * ({_GRID}.0::DOUBLE / al)) AS BIGINT) AS lo, CASE WHEN upto = al THEN {_GRID} ELSE CAST(floor(upto * ({_GRID}.0::DOUBLE / al)) AS BIGINT) END AS hi FROM i0),
sl AS (SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM (SELECT r.range AS slot, ((r.range % {_GRID}) * {_STEP}) % {_GRID} AS u FROM c, LATERAL (SELECT unnest(range((words + block - 1) // block)) AS range) r), iv WHERE u >= lo AND u < hi),
re AS (SELECT sid, count(*) AS n FROM sl GROUP BY sid),
p AS (SELECT doc_id, size, source_size, target, q.sid, stop, CAST(sum(size) OVER (PARTITION BY q.sid ORDER BY h ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS off FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
pa AS (SELECT doc_id, sid, k * source_size + off AS a, least(k * source_size + off + size, reach) AS b FROM (SELECT p.*, least(n * block, stop) AS reach, block FROM p JOIN re USING (sid), c WHERE size > 0), LATERAL (SELECT unnest(range(3)) AS k) ks WHERE k * source_size + off < reach),
g AS (SELECT doc_id, CAST(sum(least(b, (rank + 1) * block) - greatest(a, rank * block)) AS BIGINT) AS taken, min(slot) AS first_slot, count(DISTINCT slot) AS slots
  FROM (SELECT doc_id, sid, a, b, block, unnest(range(a // block, (b - 1) // block + 1)) AS rank FROM pa, c) JOIN sl USING (sid, rank) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, coalesce(slots, 0) AS slots FROM p LEFT JOIN g USING (doc_id)"""
}
