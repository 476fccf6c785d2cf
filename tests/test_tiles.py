import numpy as np
import pytest

from cellweave.operators import spatial, tiles
from cellweave.operators.graph import merged


def brute(rows, link):
    """Smallest reachable cell_id of rows (sample, cell_id, x, y)."""
    s, c, x, y = (np.array(v) for v in zip(*rows, strict=True))
    order = np.argsort(c)
    s, c, x, y = s[order], c[order], x[order].astype(float), y[order].astype(float)
    d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)
    a, b = np.nonzero((d <= np.array([link[k] for k in s])[:, None]) & (s[:, None] == s))
    return dict(zip(c.tolist(), c[merged(len(c), a, b)].tolist(), strict=True))


@pytest.mark.parametrize("block", [7, 1 << 22])
def test_linked_squares(monkeypatch, block):
    monkeypatch.setattr(tiles, "BLOCK", block)
    rng = np.random.default_rng(1)
    for t in range(40):
        n = int(rng.integers(1, 200))
        tile = np.unique(np.sort(rng.integers(0, 3, n)), return_inverse=True)[1]
        x, y = (rng.random(n) * (3, 10, 30)[t % 3] - 5 for _ in "xy")
        if t % 2:
            x, y = np.round(x), np.round(y)
        a, b = np.nonzero((np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2) <= 4) & (tile[:, None] == tile))
        pairs = set(zip(tiles.linked(tile, x, y, np.full(n, 4.0)).tolist(), merged(n, a, b).tolist(), strict=True))
        assert len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs})


def test_linkage_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 2)
    rng = np.random.default_rng(2)
    rows = [(int(s), i, float(x), float(y)) for i, (s, x, y) in enumerate(zip(rng.integers(0, 3, 900), rng.integers(-60, 60, 900), rng.integers(-60, 60, 900), strict=True))]
    rows += [(5, 1000 + i, 3.0 * i, 0.0) for i in range(100)]  # one chain through many tiles
    link = {0: 4.0, 1: 2.5, 2: 7.0, 5: 4.0}
    points = spark.createDataFrame(rows, "sample long, cell_id long, x double, y double")
    assert {r.node: r.component for r in spatial.linkage(points, 4.0).collect()} == brute(rows, dict.fromkeys(link, 4.0))
    own = points.join(spark.createDataFrame(list(link.items()), "sample long, link double"), "sample")
    assert {r.node: r.component for r in tiles.linkage(own).collect()} == brute(rows, link)


def test_linkage_of_crowds(spark, monkeypatch):
    """Crowds would be hundreds of millions of pairs; points without a place stand alone."""
    monkeypatch.setattr(spatial, "near_pairs", None)
    crowds = spark.range(30_000).selectExpr("1L sample", "id cell_id", "double(id % 3 * 100) x", "0D y")
    odd = spark.createDataFrame([(1, -1, None, 0.0), (1, -2, float("nan"), 0.0), (1, -3, float("inf"), 0.0), (1, -4, 0.0, 3.0)], crowds.schema)
    got = {(r.node if r.node < 3 else 3, r.component) for r in spatial.linkage(crowds.unionByName(odd), 4.0).collect()}
    assert got == {(-1, -1), (-2, -2), (-3, -3), (-4, -4), (0, -4), (1, 1), (2, 2), (3, -4), (3, 1), (3, 2)}
    assert spatial.linkage(crowds.limit(0), 4.0).count() == 0
