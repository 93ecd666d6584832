"""Deterministic primitives: canonical text and JSON, stable hashes, rounding, phrase containment. All are column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters whose case folding is more than lower case.
FOLDS = {"ß": "ss", "ſ": "s", "ς": "σ", "µ": "μ"}
#: What counts as white space (the characters that Python's split breaks at), as a plain class: no Unicode properties to look up.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BLANK = f"[{BLANKS}]+"
WORD = r"[\p{L}\p{N}_]+"
CLAUSE_BREAK = r";\s*|\n+|\.\s+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row even where the body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def stripped(c: Column | str) -> Column:
    """No white space of any kind at the ends."""
    return F.btrim(col(c).cast("string"), F.lit(BLANKS))


def clean(c: Column | str) -> Column:
    """White space of any kind collapsed to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(col(c).cast("string"), BLANK, " "))


def canonical_text(c: Column | str) -> Column:
    """Case-folded words with single blanks between; null stays null."""
    s = F.lower(col(c))
    for a, b in FOLDS.items():
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.array_join(F.regexp_extract_all(s, F.lit(WORD), F.lit(0)), " ")


def contains_phrase(text: Column, term: Column) -> Column:
    """Whether canonical text holds a canonical term as whole words; no text holds an empty term."""
    return (term != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), term, F.lit(" ")))


def clauses(c: Column | str) -> Column:
    """Non-empty canonical clauses of a text."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), CLAUSE_BREAK), canonical_text), lambda x: x != "")


def sha256(c: Column | str) -> Column:
    return F.sha2(col(c).cast("string"), 256)


def stable_rank(seed: int, namespace: Column | str, value: Column | str) -> Column:
    """A hex digest to order by: the same for the same seed, namespace and value, wherever the row lies."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(namespace) if isinstance(namespace, str) else namespace, col(value).cast("string")), 256)


def hash_seed(c: Column | str) -> Column:
    """The first eight hex digits of a digest as a number."""
    return F.conv(F.substring(sha256(c), 1, 8), 16, 10).cast("long")


def uniform(seed: int, c: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of the value's digest."""
    return F.conv(F.substring(stable_rank(seed, "uniform", c), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def half_up(n: Column | float, fraction: float = 1.0) -> Column:
    return F.floor((col(n) if isinstance(n, str) else F.lit(n) if not isinstance(n, Column) else n) * F.lit(float(fraction)) + F.lit(0.5)).cast("long")


def canonical_json(value) -> str:
    """Sorted keys, no blanks, plain UTF-8; for small driver-side values."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def json_string(c: Column | str) -> Column:
    """A value as a JSON string literal, null as null."""
    c = col(c).cast("string")
    quoted = F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return F.when(c.isNull(), F.lit("null")).otherwise(quoted)


def fingerprint(values: Column) -> Column:
    """An aggregate over hex digests: a digest of their number and of the sums of their four quarters, so that no row holds
    them all and their order doesn't matter."""
    part = lambda i: F.sum(F.conv(F.substring(values, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.sha2(F.concat_ws(":", F.count(values).cast("string"), *[part(i) for i in range(4)]), 256)


def edges(df: DataFrame, order: str, n: int = 256) -> list:
    """At most n - 1 values of the column that cut its order into buckets of like size: of a fixed sample of 16 a bucket."""
    sample = df.select(order).distinct().orderBy(F.xxhash64(order), order).limit(16 * n).collect()
    got = sorted(r[0] for r in sample if r[0] is not None)
    return got[16::16]


def bucket(order: str, at: list) -> Column:
    """The number of the bucket that a value lies in, from ``edges``."""
    if not at:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, at)), lambda x: x <= F.col(order)))


def numbered(df: DataFrame, keys: list[str], order: str, name: str = "rank") -> DataFrame:
    """Adds the row's rank (from 1) within its keys by a column, counted within buckets of its order that are then summed up:
    no key's rows are sorted in one task."""
    d = df.withColumn("_bucket", bucket(order, edges(df, order)))
    counts = d.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")).alias("_start"))
    d = d.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order)))
    on = F.col("_bucket").eqNullSafe(F.col("_b"))  # a plain equality would filter nulls out first, by evaluating the rows once more
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return d.join(before, on).withColumn(name, (F.col("_start") + F.col("_row")).cast("long")).drop("_bucket", "_b", "_row", "_start", *[f"_k{i}" for i in range(len(keys))])


def bucket_counts(df: DataFrame, keys: list[str], order: str, digits: int = 3) -> DataFrame:
    """keys, _bucket (the leading digits of a hex digest) and _n."""
    return df.withColumn("_bucket", F.substring(order, 1, digits)).groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))


def ranked(df: DataFrame, keys: list[str], order: str, tie: list[str], name: str = "rank", digits: int = 3) -> DataFrame:
    """Adds the row's rank (from 1) within its keys by a hex digest. Rows are ranked within (keys, leading digits) and
    counts of these buckets are summed up, so that a key with most of the rows doesn't land in one task."""
    d = df.withColumn("_bucket", F.substring(order, 1, digits))
    counts = bucket_counts(df, keys, order, digits)
    before = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")).alias("_start"))
    d = d.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order, *tie)))
    on = F.col("_bucket").eqNullSafe(F.col("_b"))  # a plain equality would filter nulls out first, by evaluating the rows once more
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return d.join(before, on).withColumn(name, (F.col("_start") + F.col("_row")).cast("long")).drop("_bucket", "_b", "_n", "_row", "_start", *[f"_k{i}" for i in range(len(keys))])
