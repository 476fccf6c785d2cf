"""Parted scans that are killed, sinks with a missing shard, offsets against a plain search, nearest neighbours against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import evaluation, quality, regions
from cellweave.sources import publish, streams


def labels(tmp_path, parts):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, rows in enumerate(parts):
        (folder / f"{k}.tsv").write_text("cell_id\tlabel\n" + "".join(f"{a}\t{b}\n" for a, b in rows))
    return str(folder)


PARTS = [[(f"{k:03d}_s{k % 3}", ("x", "y", "odd")[k % 3 if p else 0]) for k in range(p * 40, p * 40 + 40)] for p in range(4)]


@pytest.mark.parametrize("when", [0, 2])
def test_killed_scan_goes_on(spark, tmp_path, when):
    vocabulary = spark.createDataFrame([("x", 0), ("y", 1)], "label string, code long")
    allowed = spark.createDataFrame([("s0",), ("s2",), ("none",)], "sample string")
    folder = labels(tmp_path, PARTS)
    tables = lambda out, **more: [sorted(map(str, t.collect())) for t in streams.route_stream(spark, folder, str(out), vocabulary, allowed, 3, **more)]
    want = tables(tmp_path / "whole")
    assert len(want[0]) == sum(a.endswith(("s0", "s2")) for p in PARTS for a, _ in p)

    def kill(batch):
        if batch == when:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        tables(tmp_path / "killed", before_write=kill)
    assert tables(tmp_path / "killed") == want
    assert tables(tmp_path / "killed") == want  # nothing new


def test_bad_separator_fails(spark, tmp_path):
    vocabulary, allowed = spark.createDataFrame([("x", 0)], "label string, code long"), spark.createDataFrame([("s0",)], "sample string")
    with pytest.raises(Exception, match="no _ after the barcode"):
        streams.route_stream(spark, labels(tmp_path, [[("001-s0", "x")]]), str(tmp_path / "out"), vocabulary, allowed, 3)


def test_nothing_is_published_until_all_is_there(spark, tmp_path):
    path, rows = str(tmp_path / "table"), spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "k string, v long")
    expected = rows.select("k").distinct()
    shards = [publish.stage(rows.filter("k = 'a'"), path), publish.stage(rows.filter("k = 'b'"), path)]
    with pytest.raises(publish.Incomplete, match=r"missing \['c'\]"):
        publish.publish(spark, shards, path, "k", expected)
    with pytest.raises(publish.Incomplete, match=r"unexpected \['b'\]"):
        publish.publish(spark, shards, path, "k", expected.filter("k = 'a'"))

    @F.udf("string")
    def fails(k):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        publish.stage(rows.filter("k = 'c'").withColumn("k", fails("k")), path)
    assert not publish.exists(spark, path)
    shards.append(publish.stage(rows.filter("k = 'c'"), path))
    assert publish.publish(spark, shards, path, "k", expected) == {"key": "k", "keys": 3, "rows": 4}
    assert sorted(map(tuple, spark.read.parquet(path).select("k", "v").collect())) == [("a", 1), ("a", 2), ("b", 3), ("c", 4)]
    assert publish.read_text(spark, f"{path}/{publish.MANIFEST}") == '{"key": "k", "keys": 3, "rows": 4}'
    with pytest.raises(FileExistsError):
        publish.publish(spark, shards, path, "k", expected)


def test_keep_table(spark):
    cells = spark.createDataFrame([(1, 1, True, None), (2, 1, False, False), (3, 2, True, False), (4, 2, True, True)], "cell_id long, block long, has_model boolean, drop_blank boolean")
    focus = spark.createDataFrame([(1, False, None, False), (3, True, True, False)], "cell_id long, out_of_focus boolean, no_visible_nucleus boolean, featureless boolean")
    kept = quality.cell_keep(cells, focus)
    assert {r.cell_id: r.keep for r in kept.collect()} == {1: True, 2: False, 3: False, 4: False}
    assert {r.block: (r.n_keep, r.blur) for r in quality.block_report(kept).collect()} == {1: (1, True), 2: (0, False)}
    with pytest.raises(ValueError):
        quality.cell_keep(cells, None)
    assert {r.cell_id: r.keep for r in quality.cell_keep(cells, None, allow_missing=True).collect()} == {1: True, 2: False, 3: True, 4: False}


def plain_offsets(y, lf, classes, scored):
    def f1(b):
        confusion = np.zeros((classes, classes))
        np.add.at(confusion, (y, (lf + b).argmax(1)), 1)
        return evaluation.macro_f1(confusion, scored)

    b = np.zeros(classes)
    now = f1(b)
    while True:
        before = now
        for c in range(classes):
            tries = [(f1(b + d * np.eye(classes)[c]), d) for d in evaluation.STEPS]
            f, d = max(tries, key=lambda t: t[0])
            if f > now:
                b, now = b + d * np.eye(classes)[c], f
        if now == before:
            return b, now


def test_offsets(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 4, 500)
    lf = np.round(rng.normal(0, 1, (500, 4)) + 0.6 * np.eye(4)[y] - [0, 0.5, 0.2, 0.9], 1)  # with ties
    b, f = plain_offsets(y, lf, 4, 3)
    got, best = evaluation.class_offsets(spark.createDataFrame([(int(a), v.tolist()) for a, v in zip(y, lf)], "y int, lf array<double>"), 4, 3)
    assert np.allclose(got, b) and np.isclose(best, f)


def test_nearest_k(spark):
    """Far points, ties, repeated places, and samples with fewer points than asked for."""
    rng = np.random.default_rng(8)
    rows = [(1, k, float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, 12, (60, 2)))] + [(1, 99, 900.0, 900.0), (2, 100, 0.0, 0.0), (2, 101, 300.0, 0.0), (3, 102, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "sample long, cell_id long, x double, y double")
    got = {(r["sample"], r.a, r["rank"]): r.b for r in regions.nearest_k(df, df, 4, 2.0).collect()}
    want = {}
    for s, i, x, y in rows:
        near = sorted((np.hypot(x - c, y - d), j) for t, j, c, d in rows if t == s and j != i)[:4]
        want |= {(s, i, k): j for k, (_, j) in enumerate(near, 1)}
    assert got == want
    one = {r.cell_id: (r.n_10, r.mean_d) for r in regions.density_features(df, (10.0, 20.0), 4).collect()}
    assert one[102] == (0, None) and one[100] == (0, 300.0)
