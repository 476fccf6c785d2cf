"""Guards let right tables through and name what is wrong in others; metrics without positives or negatives are null."""

import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import guards, layout, metrics


def test_guards(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    two = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k long, w string")
    assert guards.one_to_one(one, two.filter("w <> 'y'"), ["k"]).count() == 2
    assert guards.many_to_one(two, one, ["k"]).count() == 3
    with pytest.raises(guards.Rejected, match=r"right table with several rows: \[\(1,\)\]"):
        guards.one_to_one(one, two, ["k"])
    with pytest.raises(guards.Rejected, match="right table"):
        guards.many_to_one(one, two, ["k"])
    with pytest.raises(guards.Rejected, match="empty"):
        guards.one_to_one(one, two.limit(0), ["k"])
    with pytest.raises(guards.Rejected, match="None"):
        guards.unique(one.union(one.filter("k is null")), ["k"], "one")
    words = spark.createDataFrame([("a",), ("b",)], "v string")
    with pytest.raises(guards.Rejected, match=r"unknown values of v: \[\('c',\)\]"):
        guards.in_vocabulary(one, "v", words)
    assert guards.in_vocabulary(one.withColumn("v", F.when(F.col("v") != "c", F.col("v"))), "v", words).count() == 3
    assert guards.one_owner(one, "k", "v").count() == 3
    with pytest.raises(guards.Rejected, match="several owners"):
        guards.one_owner(two, "k", "w")


def test_metrics_of_one_sided_classes(spark):
    rows = [("both", k, k % 2, p, 1.0) for k, p in enumerate([0.9, 0.9, 0.4, 0.1, 1.0, 1.0])] + [("pos", k, 1, 0.5, 1.0) for k in range(3)] + [("neg", 9, 0, 0.5, 2.0)]
    df = spark.createDataFrame(rows, "class string, id long, y int, p double, w double")
    one = {r["class"]: r for r in metrics.one_vs_rest(df).collect()}
    # positives .9, .1, 1 against negatives .9, .4, 1: wins .5 + 1, 0, .5 + 1 + 1
    assert one["both"].auroc == one["__MACRO__"].auroc == 4 / 9 and one["pos"].auroc is None and one["neg"].auroc is None
    roc = {r["class"]: r for r in metrics.binned_roc(df, 10).collect()}
    assert (roc["pos"].auc, roc["neg"].auc, roc["pos"].positives, roc["neg"].negatives) == (None, None, 3, 1)
    # 1.0 falls in the bin of 0.9: two positives and two negatives there
    assert roc["both"].auc == (0.5 * 2 * 2 + 1 * 2 + 0) / 9
    ap = {r["class"]: r.ap for r in metrics.weighted_precision(df).collect()}
    assert ap["pos"] is None and ap["neg"] is None and abs(ap["both"] - (1 / 2 + 2 / 4 + 3 / 6) / 3) < 1e-12


def test_coverage_of_valid_pixels(spark):
    rng = random.Random(3)
    tiles = [(s, rng.randint(0, 12), rng.randint(0, 12), rng.randint(1, 8), rng.randint(1, 8)) for s in (1, 2) for _ in range(25)]
    valid = [(s, y, x) for s in (1, 2, 3) for y in range(14) for x in range(14) if rng.random() < 0.4]
    count = lambda s, y, x: sum(t == s and a <= y < a + h and b <= x < b + w for t, a, b, h, w in tiles)
    df = spark.createDataFrame(tiles, "sample long, y0 long, x0 long, h long, w long"), spark.createDataFrame(valid, "sample long, iy long, ix long")
    assert {(r["sample"], r.iy, r.ix): r.covered for r in layout.coverage(*df).collect()} == {k: count(*k) for k in valid}
    with pytest.raises(guards.Rejected, match="uncovered"):
        layout.verified(*df)
    whole = spark.createDataFrame([(s, 0, 0, 14, 14) for s in (1, 2, 3)], "sample long, y0 long, x0 long, h long, w long")
    assert {r["sample"]: r.least for r in layout.verified(whole, df[1]).collect()} == {1: 1, 2: 1, 3: 1}


def test_serpentine(spark):
    rows = [(1, k, float(k % 3), float(k // 3)) for k in range(9)] + [(2, 100, 5.0, 5.0), (3, 101, 1.0, 2.0), (3, 102, 0.0, 2.0)]
    got = {r.id: r.place for r in layout.serpentine(spark.createDataFrame(rows, "sample long, id long, x double, y double")).collect()}
    assert [got[k] for k in range(9)] == [1, 2, 3, 6, 5, 4, 7, 8, 9] and got[100] == 1 and (got[101], got[102]) == (2, 1)
