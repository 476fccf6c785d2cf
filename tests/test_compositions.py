"""Recipes against plain numpy, and their pieces on hand-made masks."""

import numpy as np
import pytest

from cellweave.operators import bodies, compositions, runs, spatial, structures
from cellweave.operators.graph import components, merged

RNG = np.random.default_rng(4)


def frame(spark, masks):
    rows = [(s, int(y), int(x)) for s, m in masks.items() for y, x in np.argwhere(m)]
    return spark.createDataFrame(rows, "sample long, iy long, ix long")


def flood(mask, eight=False):
    """Label of each mask pixel: its component's first pixel."""
    out = np.full(mask.shape, -1)
    for y, x in np.argwhere(mask):
        if out[y, x] < 0:
            stack, out[y, x] = [(y, x)], y * mask.shape[1] + x
            while stack:
                a, b = stack.pop()
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        c, d = a + dy, b + dx
                        if (eight or abs(dy) + abs(dx) == 1) and 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and out[c, d] < 0:
                            out[c, d] = out[y, x]
                            stack.append((c, d))
    return out


@pytest.mark.parametrize("eight", [False, True])
def test_components_by_runs_over_strips(spark, monkeypatch, eight):
    monkeypatch.setattr(runs, "STRIP", 4)
    masks = {1: RNG.random((21, 17)) < 0.55, 2: RNG.random((21, 17)) < 0.4, 3: np.ones((21, 17), bool)}
    got = {(r["sample"], r.iy, r.ix): r.region for r in spatial.lattice_components(frame(spark, masks), eight).collect()}
    want = {(s, y, x): (s << 40) + (k // 17 << 20) + k % 17 for s, m in masks.items() for (y, x), k in np.ndenumerate(flood(m, eight)) if k >= 0}
    assert got == want


@pytest.mark.parametrize("most", [None, 3])
def test_holes_by_runs(spark, monkeypatch, most):
    monkeypatch.setattr(runs, "STRIP", 4)
    mask = RNG.random((23, 19)) < 0.6
    rest = flood(~mask)
    edge = {*rest[0], *rest[-1], *rest[:, 0], *rest[:, -1]}
    want = mask | np.isin(rest, [k for k in np.unique(rest[rest >= 0]) if k not in edge and (most is None or (rest == k).sum() <= most)])
    got = {(r.iy, r.ix) for r in spatial.fill_holes(frame(spark, {1: mask}), 19, 23, most).collect()}
    assert got == set(map(tuple, np.argwhere(want)))


def test_distance_fields(spark):
    """Distances to both sides and the nearest pixel, of equally near ones the first by row and column; a full lattice has no rest."""
    masks = {1: RNG.random((15, 18)) < 0.06, 2: RNG.random((15, 18)) < 0.9, 3: np.ones((15, 18), bool)}
    masks[1][7, 3] = True
    got = {(r["sample"], r.iy, r.ix): (r.o2, r.i2, r.jy, r.jx) for r in spatial.distance_fields(frame(spark, masks), 18, 15).collect()}
    for s, m in masks.items():
        own, rest = np.argwhere(m), np.argwhere(~m)
        for y, x in np.ndindex(m.shape):
            d = ((own - [y, x]) ** 2).sum(1)
            k = min(range(len(d)), key=lambda i: (d[i], *own[i]))
            assert got[s, y, x] == (d[k], ((rest - [y, x]) ** 2).sum(1).min() if len(rest) else None, *own[k])
    near = spatial.distance_fields(frame(spark, masks), 18, 15, within=3).select("sample", "iy", "ix", "o2").collect()
    assert {tuple(r) for r in near} == {(*k, v[0]) for k, v in got.items() if v[0] <= 9}


def test_contracted_graph(spark):
    a, b = RNG.integers(0, 300, (2, 260))
    root = merged(300, a, b)
    edges = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long").repartition(5)
    assert {r.node: r.component for r in components(spark.range(300).toDF("node"), edges).collect()} == dict(enumerate(root.tolist()))


def test_few_seeds_give_no_mask(spark):
    rows = [(k, 1, float(k % 40), float(k // 40), "Tumor" if k < 9 else "Other") for k in range(400)]
    rules = compositions.BoundaryRules(size=1.0, pad=10.0, tissue_sigma=1, tissue_close=2, sigma=1, close=1, open_=1, area=1, normal_area=1)
    out = compositions.boundary(spark.createDataFrame(rows, "cell_id long, sample long, x double, y double, kind string"), rules).collect()
    assert len(out) == 400 and {(r.region, r.side, r.dist_sdf_um, r.dist_sdf_region, r.dist_iface_um) for r in out} == {("Unassigned", "Normal", None, "", None)}


def test_perimeter_and_clip():
    disk = np.hypot(*np.mgrid[-12:13, -12:13]) <= 10.5
    assert abs(structures.perimeter(disk) / (2 * np.pi * 10.5) - 1) < 0.06
    core = np.zeros_like(disk)
    core[11:14, 11:14] = True
    assert not structures.clipped(disk, core, 0.5, 0.65)
    bar = np.zeros((25, 60), bool)
    bar[8:16, 2:58] = True
    core = np.zeros_like(bar)
    core[10:14, 28:32] = True
    assert structures.clipped(bar, core, 0.5, 0.65) and not structures.clipped(bar, core, 0.0, 0.0)


def test_gates_and_ownership(spark):
    """First failures by a plain loop over cores, in order, each claiming the pixels that are left."""
    rng = np.random.default_rng(9)
    ground = rng.random((60, 60)) < 0.97
    cores = []
    for k in range(14):
        y, x, h, w = *rng.integers(3, 50, 2), *rng.integers(2, 9, 2)
        m = np.zeros((60, 60), bool)
        m[y : y + h, x : x + w] = True
        cores.append(m & ground)
    n = {k: rng.poisson(r, (60, 60)) for k, r in (("B", 0.5), ("T", 0.4), ("P", 0.1), ("L", 0.002), ("O", 0.2))}
    r = structures.CoreRules(halo=40.0, points=6, area=0.0012, density=4_300, big_density=4_900, region_area=0.009, partners=30, all_density=9_700, region_density=4_900)
    near = np.array(spatial.offsets(4))
    taken, want, number = np.zeros((60, 60), int), {}, 0
    for k, core in enumerate(cores, 1):
        px, b, big = int(core.sum()), int(n["B"][core].sum()), k % 3 == 0
        wide = np.zeros((60, 60), bool)
        for y, x in np.argwhere(core):
            p = near + [y, x]
            p = p[((p >= 0) & (p < 60)).all(1)]
            wide[p[:, 0], p[:, 1]] = True
        wide &= ground
        area, t = wide.sum() * 1e-4, n["T"][wide].sum()
        small = wide.sum() < 90
        gate = (
            "size" if b < r.points or px < 12 else "density" if b / (px * 1e-4) < (r.big_density if big else r.density) else ("reshape_too_small" if structures.clipped(wide, core, 0.5, 0.65) else "region_area") if small else "partners" if t < 30
            else "all_density" if (n["B"][wide].sum() + t + n["P"][wide].sum()) / area < r.all_density else "region_density" if n["B"][wide].sum() / area < r.region_density else None
        )
        number += gate is None
        taken[wide & (taken == 0)] = number if gate is None else 0
        want[k] = (gate, number if gate is None else None)
    assert len({g for g, _ in want.values()}) >= 4
    rows = [(1, k, k % 3 == 0, int(y), int(x)) for k, m in enumerate(cores, 1) for y, x in np.argwhere(m)]
    points = [(1, int(y), int(x), kind) for kind, a in n.items() for y, x in np.argwhere(a) for _ in range(a[y, x])]
    out, owned = structures.structures(spark.createDataFrame(rows, "sample long, core long, big boolean, iy long, ix long"), spark.createDataFrame(points, "sample long, iy long, ix long, kind string"), frame(spark, {1: ground}), 60, 60, r)
    got = {q.core: q for q in out.collect()}
    assert {k: (q.gate, q.id) for k, q in got.items()} == want
    assert {(q.iy, q.ix): q.id for q in owned.collect()} == {(y, x): k for (y, x), k in np.ndenumerate(taken) if k}
    for q in got.values():
        if q.id:
            own = taken == q.id
            assert (q.owned_px, q.n_b_owned, q.n_t_owned, q.n_p_owned, q.n_l_owned) == (own.sum(), *(n[k][own].sum() for k in "BTPL"))


def planted(rng):
    """A compact blob, a thick bar, two bars in line with a gap, and a thin chain, far from each other; others are scattered."""
    blob = rng.normal(0, 14, (40, 2)) + [200, 200]
    bar = np.stack([np.linspace(600, 900, 60), 200 + rng.uniform(-14, 14, 60)], 1)
    pair = np.concatenate([np.stack([np.linspace(a, a + 160, 34), 600 + rng.uniform(-14, 14, 34)], 1) for a in (100, 320)])
    chain = np.stack([np.linspace(600, 820, 14), np.full(14, 700.0)], 1)
    marked = np.concatenate([blob, bar, pair, chain])
    rest = np.stack([rng.uniform(0, 1100, 400), rng.uniform(0, 900, 400)], 1)
    return [(1, k, float(x), float(y), k < len(marked)) for k, (x, y) in enumerate(np.concatenate([marked, rest]))]


def test_bodies_and_tracts(spark):
    rows = planted(np.random.default_rng(12)) + [(2, 5000 + k, 10.0 * k, 0.0, k < 4) for k in range(30)]
    df = spark.createDataFrame(rows, "sample long, cell_id long, x double, y double, marked boolean")
    got = bodies.region_operator(df, bodies.BodyRules(sigma=2, peak=0.05, loose_all=500.0)).collect()
    assert {r["sample"] for r in got} == {1}
    by = sorted((r.kind, r["shape"], r.n, r.confidence) for r in got)
    # each of the two bars in line is too short for a long one; the chain is too thin for a body
    assert by == [("body", "compact", 34, "high"), ("body", "compact", 34, "high"), ("body", "compact", 40, "high"), ("body", "elongated", 60, "high"), ("tract", "elongated", 14, "low")]
    assert [r.cluster for r in sorted(got, key=lambda r: r.cluster)] == list(range(1, len(got) + 1))


def test_shapes_part_by_their_branch(spark):
    """A long part with two groups of points is split at its middle; a round one at the valley between its peaks."""
    long = [(1, 7, y, x) for y in range(20, 24) for x in range(10, 60)]
    round_ = [(1, 9, y, x) for y in range(40, 60) for x in range(10, 34)]
    at = [(1, k, 21, x) for k, x in enumerate([10, 11, 12, 13, 14, 15, 50, 51, 52, 53, 54, 55])]
    peaks = {(50, 14): 1.0, (50, 29): 0.9}
    density = [(1, y, x, max(v - 0.05 * (abs(y - a) + abs(x - b)) for (a, b), v in peaks.items())) for _, _, y, x in round_]
    side = spark.createDataFrame([(1, 80)], "sample long, n long")
    out = bodies.parts_by_shape(
        spark.createDataFrame(long + round_, "sample long, region long, iy long, ix long"), spark.createDataFrame(at, "sample long, cell_id long, iy long, ix long"),
        spark.createDataFrame(density, "sample long, iy long, ix long, density double"), side, side, bodies.BodyRules(peak=0.5),
    ).collect()
    assert len(out) == len(long) + len(round_)
    piece = {(r.region, r.iy, r.ix): r.piece for r in out}
    for y in range(20, 24):
        assert [piece[7, y, x] for x in range(10, 33)] == [1] * 23 and [piece[7, y, x] for x in range(33, 60)] == [2] * 27
    assert piece[9, 50, 14] != piece[9, 50, 29] and {v for k, v in piece.items() if k[0] == 9} == {1, 2}
