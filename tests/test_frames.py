"""Lattices that take each section's frame from its points."""

import numpy as np

from cellweave.operators import spatial

POINTS = [(1, 1, 5.0, 3.0), (1, 2, 31.0, 905.0), (1, 3, 33.0, 921.0), (2, 4, -700.0, 40.0), (2, 5, 90.0, 44.0)]


def section(s):
    own = np.array([p[2:] for p in POINTS if p[0] == s])
    low = own.min(0) - 30
    nx, ny = np.ceil((own.max(0) - own.min(0) + 60) / 10).astype(int)
    a = np.zeros((ny, nx))
    for x, y in own - low:
        a[int(y // 10), int(x // 10)] += 1
    return a


def blurred(a):
    """Kernel cut at 4 sigma, reflected borders."""
    w = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    for axis in (0, 1):
        p = np.pad(a, [(4, 4) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
        a = sum(np.take(p, range(d, d + a.shape[axis]), axis) * v / w.sum() for d, v in enumerate(w))
    return a


def distance(to):
    at = np.argwhere(to)
    y, x = np.indices(to.shape)
    return np.sqrt(((y[..., None] - at[:, 0]) ** 2 + (x[..., None] - at[:, 1]) ** 2).min(-1))


def test_frames_hold_all_points_of_each_section(spark):
    points, nx, ny = spatial.framed(spark.createDataFrame(POINTS, "sample long, cell_id long, x double, y double"), pad=30.0)
    n = spatial.rasterise(points, nx, ny)
    mask = n.select(*spatial.KEY)
    tables = {"n": n, "density": spatial.gaussian(n, 1.0, nx, ny), "sdf": spatial.signed_distance(mask, nx, ny)}
    for s in (1, 2):
        a = section(s)
        want = {"n": a, "density": blurred(a), "sdf": (distance(a > 0) - distance(a == 0)) * 10}
        for k, t in tables.items():
            got = np.zeros(a.shape)
            for r in t.filter(f"sample = {s}").collect():
                got[r.iy, r.ix] = r[k]
            assert np.allclose(got, want[k], atol=1e-6), (s, k)


def test_queries_on_frames_do_not_fold_rows_onto_a_rim(spark, tmp_path):
    """Two pairs of purchases far beyond y = 150; on the fixed lattice all four were one pixel."""
    from datetime import datetime

    from cellweave.plans.catalog import QUERIES

    rows = [(i, 20.0, y, "purchase", datetime(2024, 1, 1)) for i, y in enumerate((1000, 1001, 1400, 1401))]
    spark.createDataFrame(rows, "event_id long, value double, user_id long, event_type string, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    run = lambda name: QUERIES[name][0](spark, str(tmp_path)).collect()
    assert sorted((r.iy, r.n) for r in run("a5_histogram_2d_framed")) == [(10, 2), (50, 2)]
    assert len({r.basin for r in run("r13_watershed")}) == 2
    assert {r.iy for r in run("r22_mask_from_cells")} == {10, 50}
