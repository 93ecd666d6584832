import hashlib
import math

import pytest
from pyspark.sql import functions as F

from plansmith.functions import allocation as A
from plansmith.functions import canon as C
from plansmith.functions import metrics as M


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()[0]


def test_counts_and_quotas():
    assert (A.half_up_count(13211, 0.5), A.half_up_count(1667, 0.5)) == (6606, 834)
    assert A.largest_remainder(30, {"a": 0.4, "b": 0.6}) == {"a": 12, "b": 18}
    assert A.largest_remainder(4000, {"webnlg": 6606, "dart": 25000, "easy": 1500, "medium": 2000, "hard": 1500}) == {"webnlg": 722, "dart": 2732, "easy": 164, "medium": 218, "hard": 164}
    assert A.largest_remainder(0, {}) == {}
    with pytest.raises(ValueError):
        A.largest_remainder(3, {"a": 0.0})
    assert A.quotas(10, {"a": 1, "b": 1, "c": 2}, {"a": 4}) == {"a": 4, "b": 2, "c": 4}
    assert A.optimizer_steps(28500, 1, 1, 16) == 1782
    assert A.checkpoint_steps(1782, 500) == [500, 1000, 1500, 1782]


def test_schedule_prefixes():
    s = A.smooth_schedule(300, {"dart": 5, "webnlg": 2, "medium": 2, "easy": 1})
    assert len(s) == 300
    for n in (50, 100, 300):
        k = [x[1] for x in s[:n]]
        for name, w in (("dart", 0.5), ("webnlg", 0.2), ("easy", 0.1)):
            assert abs(k.count(name) - n * w) <= 1


def test_canonical(spark):
    assert one(spark, C.clean(F.lit("  a\t b\u001c c \n"))) == "a b c"
    assert one(spark, C.canonical_text(F.lit("Straße, ÉTÉ--x_1 2"))) == "strasse été x_1 2"
    assert one(spark, C.contains_phrase(F.lit("a bc d"), F.lit("bc"))) and not one(spark, C.contains_phrase(F.lit("a bc d"), F.lit("b")))
    assert not one(spark, C.contains_phrase(F.lit("a"), F.lit("")))
    assert one(spark, C.clauses(F.lit("A b; c.  D\n\ne"))) == ["a b", "c", "d", "e"]
    assert one(spark, C.stable_rank(42, "n", F.lit("x"))) == hashlib.sha256(b"42|n|x").hexdigest()
    assert one(spark, C.hash_seed(F.lit("x"))) == int(hashlib.sha256(b"x").hexdigest()[:8], 16)
    assert one(spark, C.half_up(F.lit(13211), 0.5)) == 6606
    assert one(spark, C.json_string(F.lit('a"b'))) == '"a\\"b"'
    assert one(spark, C.json_string(F.lit(None).cast("string"))) == "null"


def test_ranks_do_not_depend_on_layout(spark):
    d = spark.range(500).withColumn("k", F.col("id") % 3 == 0).withColumn("h", C.stable_rank(1, "r", "id"))
    a = {r["id"]: r["rank"] for r in C.ranked(d, ["k"], "h", ["id"]).collect()}
    b = {r["id"]: r["rank"] for r in C.ranked(d.repartition(7), ["k"], "h", ["id"]).collect()}
    want = {}
    for k in (True, False):
        ids = sorted((i for i in range(500) if (i % 3 == 0) == k), key=lambda i: hashlib.sha256(f"1|r|{i}".encode()).hexdigest())
        want |= {i: n + 1 for n, i in enumerate(ids)}
    assert a == b == want


def test_metrics(spark):
    d = spark.createDataFrame([(0.5, 0.5, 1.0, 1.0)], "o double, t double, a double, b double")
    assert d.agg(M.coverage_error(F.col("o"), F.col("t"))).first()[0] == 0
    assert d.agg(M.jensen_shannon(F.col("a"), F.col("b"), F.lit(1.0), F.lit(1.0))).first()[0] == 0
    assert d.agg(M.jensen_shannon(F.lit(0.0), F.col("b"), F.lit(0.0), F.lit(1.0))).first()[0] == 1
    assert d.agg(M.jensen_shannon(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))).first()[0] == 0
    assert one(spark, M.bernoulli_js(F.lit(0.0), F.lit(1.0))) == pytest.approx(1.0)
    assert one(spark, M.bernoulli_kl(F.lit(0.3), F.lit(0.3))) == pytest.approx(0.0, abs=1e-12)
    lp = spark.createDataFrame([(-math.log(2),)] * 3, "l double")
    r = lp.agg(M.bits_per_token(F.col("l")).alias("b"), M.perplexity(F.col("l")).alias("p")).first()
    assert (r["b"], r["p"]) == (pytest.approx(1.0), pytest.approx(2.0))
    assert lp.filter("l > 0").agg(M.bits_per_token(F.col("l"))).first()[0] is None
    assert one(spark, M.sanitised(F.lit(-1e-12))) == 0 and one(spark, M.sanitised(F.lit(1 + 1e-12))) == 1
    with pytest.raises(Exception, match="marginal"):
        one(spark, M.sanitised(F.lit(1.01)))
