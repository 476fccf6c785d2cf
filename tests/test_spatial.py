import numpy as np
import pytest

from cellweave.operators import grouped, spatial
from cellweave.operators.graph import components
from cellweave.sources import tables


def test_hole_is_filled_up_to_its_size(spark):
    ring = [(1, y, x) for y in range(4, 28) for x in range(4, 28) if not (10 <= y < 22 and 10 <= x < 22)]
    mask = spark.createDataFrame(ring, "sample long, iy long, ix long")
    assert spatial.fill_holes(mask, 32, 32, 143).count() == len(ring)
    assert spatial.fill_holes(mask, 32, 32, 144).count() == len(ring) + 144


def test_points_rasterise_and_link(spark):
    points = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 9.9, 0.0), (1, 3, 10.1, 0.0)], "sample long, cell_id long, x double, y double")
    assert sorted((r.ix, r.n) for r in spatial.rasterise(points, 2, 2).collect()) == [(0, 2), (1, 1)]
    near = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0), (1, 3, 8.0, 0.0)], "sample long, cell_id long, x double, y double")
    assert sorted((r.node, r.component) for r in spatial.linkage(near, 2.0).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    nodes = spark.range(42).toDF("node")
    assert {r.node: r.component for r in components(nodes, edges).collect()} == {**dict.fromkeys(range(41), 0), 41: 41}


def test_assignment_is_optimal():
    import itertools

    rng = np.random.default_rng(0)
    for n in range(1, 6):
        cost = rng.random((n, n))
        to = grouped.assignment(cost)
        assert sorted(to) == list(range(n))
        assert np.isclose(sum(cost[i, j] for i, j in enumerate(to)), min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "NA"), (2, "x")], "k long, v string")
    tables.write_once(df, f"{tmp_path}/once")
    tables.write_once(df, f"{tmp_path}/once")
    with pytest.raises(ValueError):
        tables.write_once(df.limit(1), f"{tmp_path}/once")
    tables.append_new(df, f"{tmp_path}/more", ["k"])
    tables.append_new(df, f"{tmp_path}/more", ["k"])
    assert spark.read.parquet(f"{tmp_path}/more").count() == 2
    (tmp_path / "t.tsv").write_text("# note\nk\tv\n1\tNA\n")
    assert [tuple(r) for r in tables.read_delimited(spark, f"{tmp_path}/t.tsv", "k long, v string", comment="#").collect()] == [(1, "NA")]


def test_manifests_trees_and_partitions(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"v": 1,\n "slides": [{"id": "a", "n": 2}, {"id": "b", "n": null}]}')
    got = tables.read_manifest(spark, f"{tmp_path}/m.json", "slides array<struct<id string, n long>>", "slides")
    assert sorted((r.id, r.n) for r in got.collect()) == [("a", 2), ("b", None)]
    for cohort in ("x", "y"):
        (tmp_path / "tree" / cohort).mkdir(parents=True)
        (tmp_path / "tree" / cohort / "s-lowqc.csv").write_text("k\n1\n")
    tree = tables.read_tree(spark, f"{tmp_path}/tree", "k long", "/([^/]+)/([^/]+?)(?:-lowqc)?[.]csv$", ["cohort", "field"], "csv")
    assert sorted(map(tuple, tree.collect())) == [(1, "x", "s"), (1, "y", "s")]
    tables.write_partitioned(spark.createDataFrame([(1, "p"), (2, "q")], "k long, project string"), f"{tmp_path}/out", ["project"])
    assert {f.name for f in (tmp_path / "out").iterdir() if f.is_dir()} == {"project=p", "project=q"}


@pytest.mark.parametrize("weight", [0.0, 40.0])
def test_assignment_by_components_equals_the_dense_one(spark, weight):
    """Near pairs, a sample whose points are far apart, a shifted row whose cheapest pairs would leave one out, and unequal numbers."""
    rng = np.random.default_rng(3)
    a = [(1, k, *rng.uniform(0, 300, 2).tolist(), float(rng.uniform(0, 1))) for k in range(40)]
    b = [(s, 100 + k, x + float(rng.normal(0, 6)), y + float(rng.normal(0, 6)), z) for s, k, x, y, z in a]
    a += [(2, 50 + k, float(k), 0.0, 0.5) for k in range(4)] + [(3, 60 + k, 10.0 * k, 0.0, 0.5) for k in range(5)] + [(4, 70, 0.0, 0.0, 0.5)]
    b += [(2, 150 + k, 900.0 + k * k, 5.0, 0.1) for k in range(4)] + [(3, 160 + k, 10.0 * k + 9.0, 0.0, 0.5) for k in range(5)]
    schema = "sample long, cell_id long, x double, y double, area double"
    got = grouped.optimal_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 8.0, weight).collect()
    for s in (1, 2, 3):
        p, q = [r for r in a if r[0] == s], [r for r in b if r[0] == s]
        cost = np.array([[np.hypot(i[2] - j[2], i[3] - j[3]) + weight * abs(i[4] - j[4]) for j in q] for i in p])
        mine = [r for r in got if r["sample"] == s]
        assert len(mine) == len({r.b for r in mine}) == len(p)
        assert np.isclose(sum(r.d for r in mine), sum(cost[i, j] for i, j in enumerate(grouped.assignment(cost))))
    assert not any(r["sample"] == 4 for r in got)
