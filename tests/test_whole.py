"""Queries that take all rows, against brute force on a small fixture."""

from datetime import datetime

from cellweave.operators.grouped import balanced_folds
from cellweave.plans.catalog import QUERIES


def run(spark, path, name):
    return QUERIES[name][0](spark, str(path)).collect()


def test_groups_of_all_orders(spark, tmp_path):
    orders = [(1, 10, 5.0), (5001, 20, 490000.0), (2, 20, 7.0), (3, 30, 9.0), (4, 40, 481000.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    groups = {}
    for key, customer, _ in orders:
        a, b = groups.get(customer, {customer}), groups.get(-1 - key % 5000, {-1 - key % 5000})
        for node in a | b:
            groups[node] = a | b
    assert {r.node: r.component for r in run(spark, tmp_path, "g2_bipartite_groups")} == {node: min(g) for node, g in groups.items()}


def test_rings_and_bridges_of_all_sections(spark, tmp_path):
    at = [(1, 5.0, 5), (1, 15.0, 5), (2, 5.0, 5), (3, 5.0, 5), (3, 25.0, 5)]
    rows = [(i, x, y, "view", datetime(2024, 1, d)) for i, (d, x, y) in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, value double, user_id long, event_type string, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    tiles = {(d, int(y // 10), int(x // 10)) for d, x, y in at}
    want = {(d, y, x, dy, dx, (y + dy) * 1000 + x + dx if (d, y + dy, x + dx) in tiles else -1) for d, y, x in tiles for dy in range(-2, 3) for dx in range(-2, 3) if dy or dx}
    got = run(spark, tmp_path, "j22_ring_neighbours")
    assert len(got) == len(want) and {(r.sample, r.iy, r.ix, r.dy, r.dx, r.neighbour) for r in got} == want
    assert [(r.z, r.a, r.z2, r.b, r.d) for r in run(spark, tmp_path, "g6_bridged_ends")] == [(1, "view", 3, "view", 5.0)]


def test_folds_of_groups_without_positives_go_by_rows(spark):
    groups = spark.createDataFrame([(1, 1, 1), (2, 0, 100), (3, 0, 50), (10, 1, 5)], "group long, pos long, size long")
    # 1 and 10 have as many positives: "1" is before "10". Then the largest to the smaller fold each time.
    assert {r.group: r.fold for r in balanced_folds(groups, 2).collect()} == {1: 0, 10: 1, 2: 0, 3: 1}
    few = groups.filter("group < 10")
    assert {r.group: r.fold for r in balanced_folds(few, 2).collect()} == {1: 0, 2: 1, 3: 0}
