"""Splitting, tracts, links through sections, affine maps, anchors, folds and array files against plain versions."""

import itertools

import numpy as np
import pytest

from cellweave.operators import evaluation, linking, pieces
from cellweave.sources.tables import read_blocks, read_npz, write_grids

RNG = np.random.default_rng(3)


def pixels(spark, masks):
    rows = [(1, int(y), int(x), k) for k, m in masks.items() for y, x in np.argwhere(m)]
    return spark.createDataFrame(rows, "sample long, iy long, ix long, region long")


def lattice(spark, a):
    return spark.createDataFrame([(1, y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "sample long, iy long, ix long, density double")


def as_sets(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.region, r.piece), set()).add((r.iy, r.ix))
    return out


def test_depth_is_the_distance_to_the_outside(spark):
    masks = {1: RNG.random((13, 17)) < 0.8, 2: np.ones((3, 3), bool)}
    rows = [(1, k, y, x, bool(m[y, x])) for k, m in masks.items() for y, x in np.ndindex(m.shape)]
    got = pieces.deepened(spark.createDataFrame(rows, "sample long, region long, iy long, ix long, inside boolean"), ["sample", "region"]).collect()
    outside = np.argwhere(~masks[1])
    want = {(y, x): np.hypot(*(outside - (y, x)).T).min() for y, x in np.ndindex(13, 17)}
    assert len(got) == len(rows) and all(np.isclose(r.depth, want[r.iy, r.ix]) for r in got if r.region == 1)
    assert min(r.depth for r in got if r.region == 2) > 1000


def test_fill_and_label():
    m = np.zeros((7, 9), bool)
    m[1:6, 1:6] = True
    m[3, 3] = m[0, 8] = False
    m[6, 8] = True
    assert pieces.filled(m)[3, 3] and pieces.filled(m).sum() == m.sum() + 1
    assert pieces.labels(m)[1] == 2
    assert pieces.filled(np.zeros((2, 2), bool)).sum() == 0


def test_necks_part_two_disks(spark):
    y, x = np.mgrid[:21, :44]
    two = ((y - 10) ** 2 + (x - 10) ** 2 <= 64) | ((y - 10) ** 2 + (x - 33) ** 2 <= 64) | ((abs(y - 10) <= 1) & (x > 10) & (x < 33))
    hole = two.copy()
    hole[10, 10] = False
    got = as_sets(pieces.neck_split(pixels(spark, {5: hole, 6: (y < 2) & (x < 5)}), lattice(spark, two * 1.0), 44, 21))
    assert sorted(got) == [(5, 1), (5, 2)]  # region 6 is nowhere deep enough
    a, b = got.values()
    assert (10, 10) in a | b and not a & b and all(c <= 22 for _, c in min(a, b, key=lambda s: min(q for _, q in s)))


def test_necks_of_the_recipes_cores(spark):
    """With the rules of c2_lymphoid_structures and c3_aggregates a bridge two pixels wide parts a core, and a strip as narrow is none."""
    from cellweave.plans.composition_queries import CORES

    m = np.zeros((9, 22), bool)
    m[1:8, 1:8] = m[1:8, 14:21] = m[4:6, 8:14] = True
    strip = np.zeros((9, 22), bool)
    strip[3:5, 2:20] = True
    rows = [(1, k, y, x, bool(v), float(v), 0.5) for k, w in ((1, m), (2, strip)) for (y, x), v in np.ndenumerate(w)]
    windows = spark.createDataFrame(rows, "sample long, region long, iy long, ix long, inside boolean, density double, threshold double")
    got = as_sets(pieces.cores(windows, CORES.core_hole, CORES.connect, CORES.neck, ["sample", "region"]))
    assert sorted(got) == [(1, 1), (1, 2)]
    left, right = got[1, 1], got[1, 2]
    assert not left & right and {(4, 4)} <= left and {(4, 17)} <= right and m.sum() - len(left | right) in (1, 2)  # the line between


def test_valleys_and_oversized_regions(spark):
    y, x = np.mgrid[:20, :60]
    bumps = np.exp(-((y - 10) ** 2 + (x - 14) ** 2) / 40) + np.exp(-((y - 10) ** 2 + (x - 44) ** 2) / 40)
    box = (y > 2) & (y < 18) & (x > 2) & (x < 57)
    r, d = pixels(spark, {1: box}), lattice(spark, bumps)
    assert {k: len(v) for k, v in as_sets(pieces.valley_split(r, d, 60, 20, apart=5)).items()}.keys() == {(1, 1), (1, 2)}
    assert as_sets(pieces.valley_split(r, d, 60, 20, apart=5, least=600)).keys() == {(1, 1)}  # a part would be too small
    counts = d.withColumnRenamed("density", "n")
    whole = as_sets(pieces.oversized_split(r, counts, 60, 20, most=10_000))
    assert len(whole[1, 1]) == box.sum()
    split = as_sets(pieces.oversized_split(r, counts, 60, 20, most=100, broad=1.0, apart=5, neck=1.0))
    assert len(split) == 2 and not set.intersection(*split.values())


def test_tracts_keep_lines_and_drop_blobs(spark):
    line = [(1, i, 20.0 + 20 * i, 100.0 + (i % 2)) for i in range(20)]
    blob = [(1, 100 + i, 300.0 + 10 * (i % 5), 300.0 + 10 * (i // 5)) for i in range(25)]
    few = [(1, 200, 10.0, 450.0), (1, 201, 20.0, 450.0)]
    p = spark.createDataFrame(line + blob + few, "sample long, cell_id long, x double, y double")
    (t,) = pieces.tracts(p, 60, 60).collect()
    assert t.tract == 0 and t.n == 20 and t.major > 300 and abs(t.median_nn - np.hypot(20, 1)) < 1e-9
    assert {(q.iy, q.ix) for q in t.pixels} >= {(10, int(v[2] // 10)) for v in line}
    assert pieces.tracts(p.filter("x < 0"), 60, 60).count() == 0


def test_tracts_many_at_a_time(spark, monkeypatch, capsys):
    """A task draws many tracts at once: the same figures as one by one, those of the cheapest tree, and no group for each tract."""
    rows, reach = [], 22.0
    for k in range(30):
        x, y = 40.0 + np.cumsum(RNG.uniform(5, 25, 12)), 60.0 * k + 30 + np.cumsum(RNG.uniform(-4, 4, 12))
        rows += [(1 + k % 2, 1000 - 20 * k + i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    p = spark.createDataFrame(rows, "sample long, cell_id long, x double, y double")
    found = pieces.tracts(p, 60, 190, link=26.0, reach=reach, least=3, wide=1, major=60.0, aspect=1.5)
    got = {r.tract: r for r in found.collect()}
    monkeypatch.setattr(pieces, "TRACTS_AT_ONCE", 1)
    assert {r.tract: r for r in pieces.tracts(p, 60, 190, link=26.0, reach=reach, least=3, wide=1, major=60.0, aspect=1.5).collect()} == got
    assert 0 < len(got) < 30
    at = {i: (s, a, b) for s, i, a, b in rows}
    for t, r in got.items():
        own = {i: v[1:] for i, v in at.items() if t <= i < t + 12 and v[0] == r["sample"]}
        d = lambda a, b: float(np.sqrt((own[a][0] - own[b][0]) ** 2 + (own[a][1] - own[b][1]) ** 2))  # noqa: B023
        tree, group = [], {i: {i} for i in own}
        for w, a, b in sorted((d(a, b), a, b) for a, b in itertools.combinations(sorted(own), 2)):
            if w <= 26.0 and group[a] is not group[b]:
                tree.append((a, b))
                group |= dict.fromkeys(group[a] | group[b], group[a] | group[b])
        drawn = {q for a, b in tree for q in pieces.line(*(int(v // 10) for v in own[a][::-1]), *(int(v // 10) for v in own[b][::-1]))}
        assert {(q.iy, q.ix) for q in r.pixels} == {(y + a, x + b) for y, x in drawn for a, b in pieces.disk(1)} and r.n == 12
        assert abs(r.median_nn - np.median([min(d(a, b) for b in own if b != a) for a in own])) < 1e-9
    found.explain()
    assert "InPandas" not in capsys.readouterr().out


def test_lines_join_their_ends():
    for a, b, c, d in itertools.product((0, 3, 7), repeat=4):
        got = pieces.line(a, b, c, d)
        assert got[0] == (a, b) and got[-1] == (c, d) and all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1 for p, q in itertools.pairwise(got))


def test_median_nearest_and_clustering(spark):
    p = RNG.random((1300, 2)) * 50
    d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    np.fill_diagonal(d, np.inf)
    assert np.isclose(pieces.median_nearest(p), np.median(d.min(axis=1)))
    tight = [(1, 1, float(x), float(y), True) for x, y in RNG.random((10, 2))] + [(1, 1, float(x), float(y), False) for x, y in RNG.random((90, 2)) * 100] + [(1, 2, 0.0, 0.0, True)]
    got = {r.region: r.ratio for r in pieces.clustering(spark.createDataFrame(tight, "sample long, region long, x double, y double, marked boolean")).collect()}
    assert got[1] < 0.5 and got[2] is None


def test_drifting_links_against_plain_dilation(spark):
    masks, at = {}, {}
    for s in range(4):
        for k in range(3):
            m = np.zeros((24, 30), bool)
            y, x = RNG.integers(2, 16), RNG.integers(2, 22)
            m[y : y + 5, x : x + 5] = True
            masks[10 * s + k], at[10 * s + k] = m, s
    rows = [(at[k], int(y), int(x), k) for k, m in masks.items() for y, x in np.argwhere(m)]
    r = spark.createDataFrame(rows, "sample long, iy long, ix long, region long")
    sections = spark.createDataFrame([(s, s, 5.0 * s) for s in range(4)], "sample long, place long, z double")
    got = {(v.a, v.b, v.skip) for v in linking.drifting_links(r, sections, base=10.0, drift=2.0, farthest=10.0).collect()}
    up, down, want = set(), set(), set()
    for skip in (1, 2):
        n = max(1, round((10 + 2.0 * 5 * skip) / 10))
        for s in range(4 - skip):
            found = []
            for a, b in itertools.product([k for k in masks if at[k] == s and k not in up], [k for k in masks if at[k] == s + skip and k not in down]):
                grown = np.any([pieces.shifted(masks[a], y, x, False) for y in range(-n, n + 1) for x in range(-n, n + 1) if abs(y) + abs(x) <= n], axis=0)
                share = (grown & masks[b]).sum() / min(masks[a].sum(), masks[b].sum())
                if share >= 0.3:
                    found.append((-share, a, b))
            for _, a, b in sorted(found):
                if a not in up and b not in down:
                    up.add(a)
                    down.add(b)
                    want.add((a, b, skip))
    assert got == want and want


def test_lobes_merge_until_none_touches(spark):
    members = [(0, c, z, 10 * c + z) for c in range(4) for z in range(3)]
    shares = [(0, z, 10 + z, z, 0.6) for z in range(2)] + [(0, z, 10 + z, 20 + z, 0.7) for z in range(3)] + [(0, 0, 0, 30, 0.9)]
    m = spark.createDataFrame(members, "sample long, chain long, z long, region long")
    s = spark.createDataFrame(shares, "sample long, z long, a long, b long, share double")
    assert {r.chain: r.merged for r in linking.merge_lobes(m, s).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    assert {r.chain: r.merged for r in linking.merge_lobes(m, s.limit(0)).collect()} == {k: k for k in range(4)}
    assert linking.merge_lobes(m.limit(0), s).count() == 0


def test_stitching_follows_the_curve(spark):
    line = [(0, 1, 10.0 * z, 30.0 * z, 0.0) for z in range(5)] + [(0, 2, 10.0 * z, 30.0 * z, 0.0) for z in range(7, 11)] + [(0, 3, 10.0 * z, 900.0, 900.0) for z in range(7, 11)]
    c = spark.createDataFrame(line, "sample long, object long, z double, x double, y double")
    none = spark.createDataFrame([], "sample long, z double, x double, y double")
    group = lambda **how: {r.object: r.stitched for r in linking.stitch(c, how.pop("points", none), **how).collect()}
    assert group() == {1: 1, 2: 1, 3: 3}
    assert group(farthest=20.0) == {1: 1, 2: 2, 3: 3}
    off = c.replace(2, 9, "object")
    assert {r.object: r.stitched for r in linking.stitch(off, none).collect()} == {1: 1, 9: 1, 3: 3}


def test_lobes_of_connected_chains_merge_as_in_the_whole_case(spark):
    rng = np.random.default_rng(1)
    members = [(s, c, z, 100 * c + int(rng.integers(0, 2))) for s in (0, 1) for c in range(14) for z in range(*sorted(rng.choice(12, 2, replace=False)))]
    shares = [(s, z, a, b, float(rng.choice([0.2, 0.6, 0.9]))) for s, c, z, a in members for t, d, y, b in members if s == t and z == y and c < d <= c + 2 and rng.random() < 0.5]
    df = [spark.createDataFrame(members, "sample long, chain long, z long, region long"), spark.createDataFrame(shares, "sample long, z long, a long, b long, share double")]
    got = {(r["sample"], r.chain): r.merged for r in linking.merge_lobes(*df).collect()}
    want = {}
    for s in (0, 1):
        own, table = (d.filter(f"sample = {s}").toPandas() for d in df)
        want |= {(s, int(r.chain)): int(r.merged) for r in linking.merged_chains(own, table, 0.5, 0.5, 2).itertuples()}
    assert got == want and 4 < len(set(want.items())) and len({(k[0], v) for k, v in want.items()}) < len(want) - 3


def test_stitching_equals_a_walk_over_all_pairs(spark):
    """Supported gaps, bends, conflicts for an end, and joins of later rounds, against all ends compared with all others."""
    rng = np.random.default_rng(5)
    lines, number = {}, 0
    for x0, y0 in rng.uniform(0, 500, (9, 2)):
        slope, z, cut = rng.normal(0, 1.2, 2), 0, 0
        while z < 30:
            n = int(rng.integers(1, 7))
            number += 1
            lines[number] = [(10.0 * k, x0 + slope[0] * 10 * k + rng.normal(0, 3), y0 + slope[1] * 10 * k + rng.normal(0, 3)) for k in range(z, z + n)]
            z += n + int(rng.integers(1, 4))
    cloud = [(10.0 * int(rng.integers(0, 30)), *rng.uniform(0, 500, 2)) for _ in range(900)]
    how = dict(base=14.0, drift=0.6, farthest=40.0, bend=35.0, gain=1.0, planes=4, radius=40.0, full=4, rounds=6)
    levels = sorted({z for c in lines.values() for z, _, _ in c} | {z for z, _, _ in cloud})

    def curve(part):
        z, xy = np.array([p[0] for p in part]), np.array([p[1:] for p in part])
        degree = 2 if len(z) >= 4 else min(len(z) - 1, 1)
        c = np.polyfit(z - z[0], xy, degree)
        slope = np.polyder(np.poly1d(c[:, 0])), np.polyder(np.poly1d(c[:, 1]))
        return (lambda t: np.array([np.polyval(c[:, 0], t - z[0]), np.polyval(c[:, 1], t - z[0])])), (lambda t: np.array([slope[0](t - z[0]), slope[1](t - z[0]), 1.0]) if degree else None)

    group = {k: k for k in lines}
    for _ in range(how["rounds"]):
        whole = {}
        for g in set(group.values()):
            by = {}
            for p in (p for k, c in lines.items() if group[k] == g for p in c):
                by.setdefault(p[0], []).append(p)
            whole[g] = [tuple(np.mean(by[z], 0)) for z in sorted(by)]
        found = []
        for (a, p), (b, q) in ((u, v) for u in whole.items() for v in whole.items() if u[0] != v[0]):
            dz, gap = q[0][0] - p[-1][0], np.subtract(q[0][1:], p[-1][1:])
            if not 0 < dz <= how["farthest"]:
                continue
            (f, df), (h, dh) = curve(p[-4:]), curve(q[:4])
            angles = [np.degrees(np.arccos(np.clip(t @ [*gap, dz] / np.linalg.norm(t) / np.linalg.norm([*gap, dz]), -1, 1))) for t in (df(p[-1][0]), dh(q[0][0])) if t is not None]
            if np.hypot(*gap) > how["base"] and max(angles, default=0) > how["bend"]:
                continue
            support = []
            for z in (z for z in levels if p[-1][0] < z < q[0][0]):
                w = (z - p[-1][0]) / dz
                at = (1 - w) * f(z) + w * h(z)
                support.append(min(1.0, sum(np.hypot(x - at[0], y - at[1]) <= 40 for t, x, y in cloud if t == z) / 4))
            middle = p[-1][0] + dz / 2
            ratio = min(np.hypot(*gap), np.hypot(*(h(middle) - f(middle)))) / ((14 + 0.6 * dz) * (1 + np.mean(support or [0])))
            if ratio <= 1:
                found.append((ratio, a, b))
        tops, lows = set(), set()
        for _, a, b in sorted(found):
            if a not in tops and b not in lows:
                tops.add(a)
                lows.add(b)
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
        if not tops:
            break
    curves = spark.createDataFrame([(0, k, *map(float, p)) for k, c in lines.items() for p in c], "sample long, object long, z double, x double, y double")
    points = spark.createDataFrame([(0, *map(float, p)) for p in cloud], "sample long, z double, x double, y double")
    assert 3 < len(set(group.values())) < len(lines) - 5
    assert {r.object: r.stitched for r in linking.stitch(curves, points, **how).collect()} == group


def test_affine_is_refitted_without_outliers(spark):
    p = RNG.random((12, 2)) * 100
    m = np.array([[1.1, -0.2], [0.3, 0.9]])
    q = p @ m.T + (5, -7) + RNG.normal(0, 2, (12, 2))
    q[3] += 90
    w = 1.0 + np.arange(12)
    x = np.column_stack([p, np.ones(12)])
    fit = lambda k: np.linalg.lstsq(x[k] * np.sqrt(w[k])[:, None], q[k] * np.sqrt(w[k])[:, None], rcond=None)[0].T
    residual = np.hypot(*(x @ fit(np.arange(12)).T - q).T)
    keep = residual <= max(15, 2.5 * np.median(residual))
    want = fit(keep)
    on_a_line = [(2, float(k), 2.0 * k, 0.0, 0.0, 1.0) for k in range(5)]
    rows = [(1, *map(float, (*a, *b, c))) for a, b, c in zip(p, q, w, strict=True)] + on_a_line
    (r,) = linking.robust_affine(spark.createDataFrame(rows, "sample long, x double, y double, u double, v double, w double")).collect()
    assert 4 <= keep.sum() < 12 and (r.sample, r.n, r.n_kept) == (1, 12, keep.sum())
    assert np.allclose([r.a, r.b, r.e, r.c, r.d, r.f], want.ravel())


def test_weight_maps_of_a_square(spark):
    ring = [{"x": x, "y": y} for x, y in ((4.0, 4.0), (12.0, 4.0), (12.0, 12.0), (4.0, 12.0))]
    p = spark.createDataFrame([(1, [ring]), (2, []), (3, None), (4, [[]])], "cell_id long, rings array<array<struct<x: double, y: double>>>")
    got = {r.cell_id: r for r in evaluation.weight_maps(p, side=16, patch=4, sigma=0.5).collect()}
    assert got[1].area == 64 and got[1].n_half == 4 and np.array(got[1].weights).reshape(4, 4)[1:3, 1:3].min() > 200
    assert all(got[k].area == 0 and not any(got[k].weights) for k in (2, 3, 4))


def test_folds_keep_groups_whole_and_classes_even(spark):
    rows = [(g, c, int(RNG.integers(1, 20))) for g in range(60) for c in range(3)]
    got = evaluation.stratified_folds(spark.createDataFrame(rows, "group long, class long, n long"), 5).toPandas()
    assert sorted(got.group) == list(range(60))
    fold = dict(zip(got.group, got.fold, strict=True))
    for c in range(3):
        load = [sum(n for g, k, n in rows if k == c and fold[g] == f) for f in range(5)]
        assert max(load) < 1.25 * min(load)


def test_anchors_fill_up_at_falling_distance(spark):
    rows = [(1, k, float(x), float(y), float(s)) for k, (x, y, s) in enumerate(RNG.random((80, 3)) * (1200, 1200, 1))]
    got = evaluation.spread_anchors(spark.createDataFrame(rows, "sample long, id long, x double, y double, score double"), square=400.0).collect()
    best = {}
    for r in sorted(rows, key=lambda r: -r[4]):
        best.setdefault((r[2] // 400, r[3] // 400), r[1])
    assert {r.id for r in got if r.best} == set(best.values()) and len(got) <= 12
    extra = [r for r in got if not r.best]
    assert all(np.hypot(a.x - b.x, a.y - b.y) >= 200 for a in extra for b in got if a.id != b.id)


def test_threshold_choice_without_positives(spark):
    truth = spark.createDataFrame([(1, 1, 0, 0, 0), (1, 1, 0, 1, 0)], "sample long, patient long, iy long, ix long, y int")
    p = spark.createDataFrame([(1, 0, 0, 0.1)], "sample long, iy long, ix long, p double")
    (r,) = evaluation.threshold_choice(truth, p).collect()
    assert (r.threshold, r.dice, r.n_uncovered) == (0.5, 1.0, 1)


def test_array_files(spark, tmp_path):
    for k in range(2):
        np.savez(tmp_path / f"{k}.npz", y=np.arange(3) + k, prob=np.full((3, 2), 0.5), patient=np.array(f"p{k}"), known=np.array([True, False, True]))
    got = read_npz(spark, str(tmp_path), "y long, prob array<double>, patient string", mask="known").collect()
    assert sorted((r.patient, r.y, tuple(r.prob)) for r in got) == [("p0", 0, (0.5, 0.5)), ("p0", 2, (0.5, 0.5)), ("p1", 1, (0.5, 0.5)), ("p1", 3, (0.5, 0.5))]
    np.savez(tmp_path / "bad.npz", y=np.arange(3), prob=np.zeros((2, 2)), patient=np.array("x"))
    with pytest.raises(Exception, match="differ in length"):
        read_npz(spark, str(tmp_path / "bad.npz"), "y long, prob array<double>, patient string").collect()


def test_blocks_and_grids(spark, tmp_path):
    t = spark.createDataFrame([(r, c, float(r * c)) for r in range(10) for c in range(3)], "row long, col long, value double")
    t.write.parquet(str(tmp_path / "m"))
    assert {r.row for r in read_blocks(spark, str(tmp_path / "m"), [(0, 2), (7, 9)]).collect()} == {0, 1, 7, 8}
    assert read_blocks(spark, str(tmp_path / "m"), []).count() == 0
    grids = spark.createDataFrame([(1, 0, 0, 2.0), (2, 0, 1, 3.0)], "sample long, iy long, ix long, density double")
    write_grids(grids, grids.groupBy("sample").count(), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/grids")).count() == spark.read.parquet(str(tmp_path / "out/stats")).count() == 2


def test_load_folds_deal_the_largest_first(spark):
    rows = [(c, g, int(RNG.integers(1, 9))) for c in range(2) for g in range(15)]
    got = {(r.sample, r.group): r.fold for r in evaluation.load_folds(spark.createDataFrame(rows, "sample long, group long, n long"), 4).collect()}
    for c in range(2):
        load = [0] * 4
        for _, g, n in sorted((r for r in rows if r[0] == c), key=lambda r: (-r[2], r[1])):
            k = min(range(4), key=lambda i: (load[i], i))
            load[k] += n
            assert got[c, g] == k


def test_curves_are_no_more_bent_than_needed(spark):
    t = np.linspace(-400, 400, 40)
    shapes = {1: 0 * t, 2: t**2 / 800, 4: RNG.normal(0, 200, 40)}
    rows = [(1, k, float(a), float(b), float(0.1 * a)) for k, v in shapes.items() for a, b in zip(t, v, strict=True)] + [(1, 5, 0.0, 0.0, 0.0)]
    got = {r.object: r.model for r in linking.curve_models(spark.createDataFrame(rows, "sample long, object long, x double, y double, z double"), radius=100.0).collect()}
    assert got == {1: "line", 2: "parabola", 4: None, 5: None}
    assert {r.model for r in linking.curve_models(spark.createDataFrame([(1, 1, float(a), float(a**3 / 1e6), 0.0) for a in t], "sample long, object long, x double, y double, z double"), rms=1.0).collect()} == {"scurve"}
