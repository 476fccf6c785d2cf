"""What larger tables show: ties, long sections and many pieces."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import grouped, pieces, spatial
from cellweave.plans.catalog import QUERIES


def test_best_sets_is_best_jaccard_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    for marks, size in ((9, 5), (900, 6)):  # by bits, and by the rows of each mark
        sides = [[(s, i, int(m)) for s in (1, 2) for i in range(20) for m in np.unique(rng.integers(0, marks, rng.integers(1, size)))] for _ in range(2)]
        old, new = (spark.createDataFrame(rows, f"sample long, {k} long, m long") for rows, k in zip(sides, ("old", "new"), strict=True))
        sets = [{(s, i): {m for t, j, m in rows if (t, j) == (s, i)} for s, i, _ in rows} for rows in sides]
        pairs = [(s, i, j, len(a & b) / len(a | b)) for (s, i), a in sets[0].items() for (t, j), b in sets[1].items() if s == t and a & b]
        want = grouped.best_jaccard(spark.createDataFrame(pairs, "sample long, old long, new long, jaccard double")).collect()
        assert sorted(map(tuple, grouped.best_sets(old, new).collect())) == sorted(map(tuple, want)) and want


def test_median_nearest_of_a_long_narrow_strip():
    """60,000 points of a section 100 wide and 90,000 long took minutes when all lay within the window in x."""
    p = np.random.default_rng(3).random((60_000, 2)) * (100, 90_000)
    begin = time.process_time()
    got = pieces.median_nearest(p)
    assert time.process_time() - begin < 20
    some = np.argsort(p[:, 1])  # against neighbours in y
    q, best = p[some], np.full(len(p), np.inf)
    for k in range(1, 400):
        d = np.hypot(*(q[k:] - q[:-k]).T)
        best[k:] = np.minimum(best[k:], d)
        best[:-k] = np.minimum(best[:-k], d)
    assert got == np.median(best)


def test_mutual_nearest_orders_near_ties_as_sql_does(spark):
    """Distances that hypot rounds apart and the square root of the sum of squares does not, or the other way round."""
    rng, found = np.random.default_rng(1), []
    while len(found) < 20:
        p, q = np.round(rng.random((2, 2)) * 15, 2)
        for r in (q, q[::-1]):
            d, e = p - q, (p - r)
            if np.sqrt((d**2).sum()) != np.hypot(*d) and not np.array_equal(d, e):
                found.append((p, q))
                break
    a = [(1, k, float(p[0] + 1000 * k), float(p[1])) for k, (p, _) in enumerate(found)]
    b = [(1, k, float(q[0] + 1000 * k), float(q[1])) for k, (_, q) in enumerate(found)]
    schema = "sample long, cell_id long, x double, y double"
    got = {r.a: r.d for r in spatial.near_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 30.0).filter("a = b").collect()}
    assert got == {k: float(np.sqrt((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2)) for (_, k, *_), p, q in zip(a, a, b, strict=True)}
    assert any(got[k] != np.hypot(p[2] - q[2], p[3] - q[3]) for k, (p, q) in enumerate(zip(a, b, strict=True)))


@pytest.mark.parametrize("order", [(0, 1, 2), (1, 2, 0), (2, 0, 1)])
def test_equal_scores_stay_equal_in_any_order(spark, tmp_path, order):
    """Three quantities on each side, the same ones in another order: A wins a tie."""
    quantity = [(1.0, 2.0, 3.0), (1.0, 2.0, 9.0), (1.0, 2.0, 18.0)]
    rows = [(k, n, q[n - 1] if n <= 3 else q[order[n - 4]]) for k, q in enumerate(quantity) for n in range(1, 7)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.typed for r in QUERIES["e3_marker_argmax"][0](spark, str(tmp_path)).collect()} == {"A"}


def test_anchors_of_many_squares_are_their_best(spark, monkeypatch):
    """With enough squares none is added, so no distances are taken: a table of all squares by all candidates took the memory."""
    rows = [(1, k, float(k % 50 * 100 + k % 7), float(k // 50 * 10), float(k % 13)) for k in range(2000)]
    kind = spark.createDataFrame(rows, "sample long, id long, x double, y double, score double")
    from cellweave.operators import evaluation

    got = evaluation.spread_anchors(kind, square=100.0, first=0.0, last=0.0, step=1.0, wanted=12).collect()
    best = {}
    for _, i, x, y, s in rows:
        square = (x // 100, y // 100)
        best[square] = max(best.get(square, (-1.0, 0)), (s, -i))
    assert {r.id for r in got} == {-i for _, i in best.values()} and all(r.best for r in got)


def test_replicate_medians_in_and_outside_the_narrow_range(spark):
    """Values in two far clusters, of which resamples take either, and plain ones; a margin that is too small falls back on all rows."""
    rng = np.random.default_rng(4)
    rows = [(g, k, float(v)) for g, n in ((1, 60), (2, 3000), (3, 1)) for k, v in enumerate(np.where(rng.random(n) < 0.5, 0, 1000) + rng.random(n))] + [(2, -1, None)]
    df = spark.createDataFrame(rows, "g long, k long, v double")
    weight = F.pmod(F.xxhash64("g", "k", "rep"), F.lit(4)).cast("int")
    r = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("w", weight).filter("w > 0 and v is not null")
    want = {(x.g, x.rep): x.m for x in r.groupBy("g", "rep").agg(F.expr("percentile(v, 0.5, w)").alias("m")).collect()}
    for margin in (4.0, 0.0):
        assert {(x.g, x.rep): x.m for x in grouped.replicate_medians(df, "g", "v", weight, 30, margin).collect()} == want


def test_published_key_is_dealt_over_tasks(spark, tmp_path):
    from cellweave.sources import publish

    path = f"{tmp_path}/out"
    rows = spark.range(0, 3 * publish.BLOCK, 1, 1).select(F.lit("one").alias("k"), "id")
    publish.publish(spark, [publish.stage(rows, path)], path, "k", spark.createDataFrame([("one",)], "k string"))
    per = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in per) == 3 * publish.BLOCK and max(r["count"] for r in per) < 3 * publish.BLOCK


def test_near_pairs_across_bucket_borders(spark):
    rng = np.random.default_rng(9)
    p = np.round(rng.random((300, 2)) * 12 - 6)
    schema = "sample long, cell_id long, x double, y double"
    df = spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate(p)], schema)
    got = [(r.a, r.b) for r in spatial.near_pairs(df, df, 2.0).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(300) for j in range(300) if ((p[i] - p[j]) ** 2).sum() <= 4}


def test_nearest_lanes_are_those_of_all_pairs(spark):
    from cellweave.operators import linking

    rng = np.random.default_rng(8)
    lanes = lambda n, most: sorted(rng.choice(most, n, replace=False).tolist())
    sides = [[(z, k, lane, float(rng.integers(0, 300)), float(lane * 10 + rng.integers(0, 10))) for z, k in ((1, "x"), (2, "x"), (2, "y")) for lane in lanes(n, 400)] for n in (60, 40)]
    sides[1].append((7, "x", 5000, 0.0, 50_000.0))
    sides[0].append((7, "x", 2, 0.0, 20.0))  # one far candidate alone
    own, other = (spark.createDataFrame(s, "z long, kind string, lane long, x double, y double") for s in sides)
    got = {(r.z, r.kind, r.lane, r["rank"]): r.to for r in linking.lane_nearest(own, other, 10.0).collect()}
    want = {}
    for z, k, lane, x, y in sides[0]:
        near = sorted((round(float(np.sqrt((x - u) ** 2 + (y - v) ** 2)), 9), to) for w, m, to, u, v in sides[1] if (w, m) == (z, k))
        want |= {(z, k, lane, i): to for i, (_, to) in enumerate(near[:2], 1)}
    assert got == want


def test_small_disks_by_tiles(spark, monkeypatch, capsys):
    """Over tiles' borders the same pixels as a plain disk, and no row for each pixel of the disk."""
    monkeypatch.setattr(spatial, "TILE", 8)
    rng = np.random.default_rng(6)
    masks = {1: rng.random((27, 21)) < 0.15, 2: rng.random((27, 21)) < 0.85}
    wide = lambda m: spatial.widened(np.pad(m, 9), 2)
    thin = lambda m: ~spatial.widened(np.pad(~m, 9, constant_values=True), 2)[9:-9, 9:-9]
    cut = lambda m: m[9:-9, 9:-9]
    for m in masks.values():
        y, x = np.mgrid[:27, :21]
        near = [((y - a) ** 2 + (x - b) ** 2 <= 4) for a, b in np.argwhere(m)]
        assert np.array_equal(cut(wide(m)), np.any(near, axis=0))
    df = spark.createDataFrame([(s, int(y), int(x)) for s, m in masks.items() for y, x in np.argwhere(m)], "sample long, iy long, ix long")
    sides = spark.createDataFrame([(1, 21), (2, 21)], "sample long, n long"), 27
    want = {
        "dilate": lambda m: cut(wide(m)), "erode": thin, "opening": lambda m: cut(wide(thin(m))),
        "closing": lambda m: cut(thin(wide(m))), "rim": lambda m: thin(cut(wide(m))),
    }
    got = {
        "dilate": spatial.dilate(df, 2, *sides), "erode": spatial.erode(df, 2), "opening": spatial.opening(df, 2, *sides),
        "closing": spatial.closing(df, 2, *sides), "rim": spatial.closing(df, 2, *sides, rim=True),
    }
    for name, plain in want.items():
        rows = [(r["sample"], r.iy, r.ix) for r in got[name].collect()]
        assert len(rows) == len(set(rows)) and set(rows) == {(s, int(y), int(x)) for s, m in masks.items() for y, x in np.argwhere(plain(m))}, name
    keyed = df.select(F.struct("sample", F.lit(7).alias("k")).alias("sample"), "iy", "ix")
    moved = [(r["sample"], r.iy, r.ix) for r in spatial.dilate(keyed, 2, None, None).select("sample.*", "iy", "ix").collect()]
    assert set(moved) == {(s, int(y) - 9, int(x) - 9) for s, m in masks.items() for y, x in np.argwhere(wide(m))} and len(moved) == len(set(moved))
    got["dilate"].explain()
    assert "HashAggregate" not in capsys.readouterr().out


def test_lines_blurred_together():
    """Many lines at once: the same as one by one against a plain sum over reflected places."""
    rng, w = np.random.default_rng(7), np.array([v for _, v in spatial.weights(1.5)])
    sides = np.array([3, 40, 1, 17])
    of = np.array([0, 0, 1, 1, 1, 3, 3])
    at, n = np.array([0, 2, 5, 6, 39, 0, 9]), rng.random(7)
    line, place, value = spatial.blur(of, at, n, sides, w)
    got = {(int(a), int(b)): v for a, b, v in zip(line, place, value, strict=True)}
    want = {}
    for k, p, v in zip(of, at, n, strict=True):
        for d, weight in spatial.weights(1.5):
            q = (p + d) % (2 * sides[k])
            q = q if q < sides[k] else 2 * sides[k] - 1 - q
            want[int(k), int(q)] = want.get((int(k), int(q)), 0.0) + v * weight
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def plain_cores(m, density, threshold, hole, connect, neck):
    """Of one window, after the recipe: holes, depths, cores, and what they take."""
    gap, n = pieces.labels(~m)
    rim = {*gap[0], *gap[-1], *gap[:, 0], *gap[:, -1]}
    for k in set(range(1, n + 1)) - rim:
        if (gap == k).sum() <= hole or density[gap == k].mean() >= connect * threshold:
            m = m | (gap == k)
    outside = np.argwhere(~m)
    depth = np.array([[np.hypot(*(outside - (y, x)).T).min() for x in range(m.shape[1])] for y in range(m.shape[0])])
    core, n = pieces.labels(m & (depth >= neck))
    taken = pieces.flood(-depth, core, m, line=True) if n > 1 else m * n
    return {(k, int(y), int(x)) for k, p in pieces.whole(taken) for y, x in p}


def test_cores_of_many_windows_at_a_time(spark, monkeypatch, capsys):
    """Windows of several sizes together, and one by one: what the recipe gives for each alone, without a group of pandas for each."""
    rng, rows, want = np.random.default_rng(8), [], {}
    for k in range(12):
        h, w = rng.integers(8, 26, 2)
        m = np.zeros((h, w), bool)
        m[1:-1, 1:-1] = spatial.widened(rng.random((h - 2, w - 2)) < 0.06, 2) & (rng.random((h - 2, w - 2)) < 0.98)
        density = rng.random((h, w))
        rows += [(1 + k % 2, k, y, x + 5, bool(v), float(density[y, x]), 0.9) for (y, x), v in np.ndenumerate(m)]
        want |= {(k, p, y, x + 5): 1 for p, y, x in plain_cores(m, density, 0.9, 1, 0.6, 2.0)}
    windows = spark.createDataFrame(rows, "sample long, region long, iy long, ix long, inside boolean, density double, threshold double")
    for at_once in (1 << 18, 1):
        monkeypatch.setattr(pieces, "PIXELS_AT_ONCE", at_once)
        found = pieces.cores(windows, 1, 0.6, 2.0, ["sample", "region"])
        got = [(r.region, r.piece, r.iy, r.ix) for r in found.collect()]
        assert len(got) == len(want) and set(got) == set(want)
    assert len({p for _, p, _, _ in got}) > 1
    found.explain()
    assert "InPandas" not in capsys.readouterr().out


def test_tight_parts_against_lattice_operators(spark):
    """Basins' dense parts, all in one array, against the same steps by Spark's operators on a plane."""
    rng, rows, counts = np.random.default_rng(9), [], []
    for k in range(5):
        h, w = rng.integers(12, 30, 2)
        y0 = 40 * k
        rows += [(1, 3, k, y0 + y, x) for y in range(h) for x in range(w) if rng.random() < 0.97]
        counts += [(1, y0 + int(y), int(x), int(n)) for (y, x), n in np.ndenumerate(rng.poisson(0.4, (h, w))) if n]
    basins, counts = spark.createDataFrame(rows, "sample long, region long, basin long, iy long, ix long"), spark.createDataFrame(counts, "sample long, iy long, ix long, n long")
    got = {tuple(r) for r in pieces.tight(basins, counts, 32, 190, 1.2, 0.4, 1, 1, 2, 0.5, 1.4).select("basin", "piece", "iy", "ix", "part").collect()}
    b = ["sample", "region", "basin"]
    keyed = lambda df: df.select(F.struct(*b).alias("sample"), *[c for c in df.columns if c not in b])
    d = spatial.gaussian(keyed(basins.join(counts, ["sample", "iy", "ix"])), 1.2, None, None).select("sample.*", "iy", "ix", "density").cache()
    top = d.groupBy(*b).agg((0.4 * F.max("density")).alias("threshold"))
    dense = d.join(top, b).filter("density > threshold").join(basins, [*b, "iy", "ix"], "left_semi")
    shape = spatial.opening(spatial.closing(keyed(dense.select(*b, "iy", "ix")), 1, None, None), 1, None, None).select("sample.*", "iy", "ix").join(basins, [*b, "iy", "ix"], "left_semi")
    at = {k: np.array([(r.iy, r.ix) for r in shape.filter(f"basin = {k}").collect()]) for k in range(5)}
    parts = []
    for k, p in at.items():
        m = np.zeros((p[:, 0].max() + 1, p[:, 1].max() + 1), bool)
        m[p[:, 0], p[:, 1]] = True
        label = pieces.labels(m)[0]
        parts += [(1, 3, k, int(label[y, x]), int(y), int(x)) for y, x in p]
    parts = spark.createDataFrame(parts, "sample long, region long, basin long, part long, iy long, ix long")
    want = pieces.cores(pieces.boxed(parts, d, 32, 190, 1, [*b, "part"], b).join(top, b), 2, 0.5, 1.4, [*b, "part"])
    want = {tuple(r) for r in want.select("basin", "piece", "iy", "ix", "part").collect()}
    assert got == want and len({(k, p) for k, *_, p in got}) > 5
