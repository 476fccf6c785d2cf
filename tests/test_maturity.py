"""Maturity with missing measures and doubtful calls, by hand."""

from cellweave.operators.maturity import MaturityRules, maturity, tiers

COLUMNS = "sample long, region long, aicda_frac double, bcl6_frac double, mki67_frac double, gcb_frac double, tfh_frac double, plasma_frac double, lamp3_density double, hev_density double, area_mm2 double, circularity double, shell_index double, moran double, n_aicda long, gc_score double, n_scored long"
NONE = (None,) * 4


def test_maturity(spark):
    rows = [
        (1, 1, 0.024, 0.0, 0.0, 0.0, 0.0, 0.3, 1.0, 2.0, 0.2, 0.8, 0.5, -0.5, 5, 0.1, 60),  # scored, few positive cells, no witness
        (1, 2, 0.024, 0.02, 0.0, 0.0, 0.0, 0.05, 3.0, 0.0, 0.1, 0.4, 2.0, 0.5, 5, 0.1, 60),  # a witness
        (1, 3, 0.013, 0.0, 0.0, 0.0, 0.0, 0.1, 2.0, 1.0, 0.1, 0.4, 0.5, 0.0, 5, None, None),  # not scored: by share
        (1, 4, 0.005, 0.0, 0.0, 0.08, 0.06, 0.1, 2.0, 1.0, 0.1, 0.4, 0.5, 0.0, 0, -1.0, 60),  # the second path
        (1, 5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.1, 2.0, 1.0, 0.1, 0.4, 0.5, 0.0, 0, -0.1, 60),  # low by its score
        (2, 6, *NONE, None, None, None, None, None, None, None, None, None, None, None),  # nothing was measured
    ]
    got = {r.region: r for r in maturity(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert {k: (r.rung, r.path, r.confidence) for k, r in got.items()} == {1: (2, "score", "LOW"), 2: (2, "score", "HIGH"), 3: (2, "frac", "LOW"), 4: (2, "path2", "HIGH"), 5: (1, "none", "HIGH"), 6: (0, "none", "HIGH")}
    assert [got[k].composition for k in (1, 2, 3)] == ["plasma_dominant", "b_dominant", "mixed"]
    assert abs(got[1].gc_axis - 1 / 2.5) < 1e-12 and abs(got[1].plasma_axis - 0.5) < 1e-12 and abs(got[1].structure_axis - (1 + 0.8 + 1) / 3) < 1e-12
    assert got[6].score is None and got[6].gc_axis is None
    unscored = {r.region: r.path for r in maturity(spark.createDataFrame(rows, COLUMNS), MaturityRules(tau=None, tau_low=None)).collect()}
    assert unscored == {1: "frac", 2: "frac", 3: "frac", 4: "path2", 5: "none", 6: "none"}


def test_tiers(spark):
    rows = [(1, 4, 0.75, 0.05), (2, 4, 0.75, None), (3, 4, None, 0.9), (4, 1, 1.0, 0.9), (5, 2, 1.0, 0.9)]
    df = spark.createDataFrame(rows, "object long, n_sections long, margin_frac double, median_area double")
    assert {r.object: r.tier for r in tiers(df).collect()} == {1: "A", 2: "A", 3: "B", 4: "C", 5: "B"}
    assert {r.object: r.tier for r in tiers(df, area=0.05).collect()} == {1: "A", 2: "B", 3: "B", 4: "C", 5: "B"}
