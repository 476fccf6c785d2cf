"""Large disks by distances against disks by copies."""

import numpy as np
import pytest

from cellweave.operators import spatial

RNG = np.random.default_rng(11)


def pixels(df):
    return {(r["sample"], r.iy, r.ix) for r in df.select(*spatial.KEY).collect()}


@pytest.mark.parametrize("radius", [2, 5])
def test_disks_by_distances_equal_disks_by_copies(spark, monkeypatch, radius):
    rows = [(s, int(y), int(x)) for s, share in ((1, 0.1), (2, 0.9)) for y, x in np.argwhere(RNG.random((23, 31)) < share)] + [(3, y, x) for y in range(23) for x in range(31)]
    mask = spark.createDataFrame(rows, "sample long, iy long, ix long")
    wide = spark.createDataFrame([(1, 31), (2, 31), (3, 31)], "sample long, n long")
    found = {}
    for way in (0, 100):
        monkeypatch.setattr(spatial, "BY_COPIES", way)
        found[way] = [pixels(f(mask, radius, wide, 23)) for f in (spatial.dilate, spatial.opening, spatial.closing)]
    assert found[0] == found[100]
