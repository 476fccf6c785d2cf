"""Queries and operators without SQL against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from cellweave.operators import grouped
from cellweave.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_greedy_matching(spark):
    rng = np.random.default_rng(2)
    rows = [(s, g, p, float(np.round(rng.random(), 1))) for s in (1, 2) for g in range(12) for p in range(12) if rng.random() < 0.5]
    want = set()
    for s in (1, 2):
        free = set(range(12))
        for g in range(12):
            own = sorted((-v, p) for t, h, p, v in rows if t == s and h == g and v >= 0.5 and p in free)
            if own:
                free.discard(own[0][1])
                want.add((s, g, own[0][1], -own[0][0]))
    got = grouped.greedy_iou(spark.createDataFrame(rows, "sample long, gold long, pred long, iou double"), 0.5)
    assert {tuple(r) for r in got.collect()} == want


def test_watershed(spark):
    """Always the highest pixel beside the flood, looked for among all; plateaus and empty pixels included."""
    rng = np.random.default_rng(7)
    d = {s: np.round(rng.random((14, 17)) * 6) * (rng.random((14, 17)) < 0.85) for s in (1, 2)}
    want = {}
    for s, m in d.items():
        h, w = m.shape
        near = lambda y, x: [(v, u) for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= v < h and 0 <= u < w]  # noqa: B023
        top = [(y, x) for y, x in np.ndindex(m.shape) if m[y, x] > 0 and m[y, x] == m[max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2].max()]
        label, waiting, spread = {}, set(top), set()
        while waiting:
            y, x = min(waiting, key=lambda p: (-m[p], p[0] * w + p[1]))  # noqa: B023
            waiting.discard((y, x))
            if (y, x) in spread:
                continue
            spread.add((y, x))
            label.setdefault((y, x), y * w + x + 1)
            for p in near(y, x):
                if p not in label and m[p] > 0:
                    label[p] = label[y, x]
                    waiting.add(p)
        want |= {(s, *p): k for p, k in label.items()}
    rows = [(s, int(y), int(x), float(m[y, x])) for s, m in d.items() for y, x in np.ndindex(m.shape) if m[y, x]]
    got = grouped.watershed(spark.createDataFrame(rows, "sample long, iy long, ix long, density double"), 17, 14)
    assert {(r["sample"], r.iy, r.ix): r.basin for r in got.collect()} == want


def test_bootstrap_of_the_median(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderpriority", "o_orderkey", "o_totalprice")
    u = (F.pmod(F.xxhash64("o_orderkey", "rep"), F.lit(1 << 20)) / float(1 << 20)).alias("u")
    rows = o.select("*", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("rep")).select("*", u).toPandas()
    rows["w"] = np.searchsorted([0.3679, 0.7358, 0.9197, 0.9810], rows.u, "right")
    se = {}
    for k, part in rows.groupby("o_orderpriority"):
        medians = [np.median(np.repeat(r.o_totalprice, r.w)) for _, r in part.groupby("rep") if r.w.sum()]
        se[k] = np.std(medians, ddof=1)
    got = {r.o_orderpriority: r.se for r in QUERIES["a9_bootstrap_median"][0](spark, SF).collect()}
    assert got.keys() == se.keys() and all(np.isclose(got[k], v) for k, v in se.items())
