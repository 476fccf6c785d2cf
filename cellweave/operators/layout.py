"""Orders, tilings and directions: serpentine order, coverage by tiles of any size, linearity of neighbourhoods in space."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .guards import Rejected
from .spatial import KEY


def serpentine(points: DataFrame) -> DataFrame:
    """points(sample, id, x, y) with `place` from 1: about sqrt(n) bands of equal height from the lowest y, odd ones from the right; ties by id."""
    frame = points.groupBy("sample").agg(F.min("y").alias("low"), (F.max("y") - F.min("y")).alias("span"), F.greatest(F.lit(1), F.rint(F.sqrt(F.count("*")))).cast("long").alias("bands"))
    at = points.join(frame, "sample")
    band = F.when(F.col("span") > 0, F.least(F.floor((F.col("y") - F.col("low")) / F.col("span") * F.col("bands")), F.col("bands") - 1)).otherwise(0)
    at = at.withColumn("band", band).withColumn("along", F.when(F.col("band") % 2 == 0, F.col("x")).otherwise(-F.col("x")))
    # places within a band, upon the points of the bands before
    before = Window.partitionBy("sample").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    sizes = at.groupBy("sample", "band").agg(F.count("*").alias("k"))
    starts = sizes.select("sample", "band", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("sample", "band").orderBy("along", "id"))
    return at.join(starts, ["sample", "band"]).withColumn("place", F.col("start") + own).select("sample", "id", "place")


def coverage(tiles: DataFrame, valid: DataFrame) -> DataFrame:
    """(sample, iy, ix, covered) for each valid pixel: by how many of tiles(sample, y0, x0, h, w) of any size.

    A tile is four steps of a difference array, which running sums along the rows and then along the columns of its corners turn into counts; a valid pixel
    takes the last of these at or before it. So a tile costs four rows, whatever its area; beside them there is a row for each row of valid pixels and column of steps."""
    y1, x1 = F.col("y0") + F.col("h"), F.col("x0") + F.col("w")
    corner = lambda y, x, d: F.struct(y.cast("long").alias("iy"), x.cast("long").alias("ix"), F.lit(d).alias("d"))
    steps = tiles.select("sample", F.explode(F.array(corner(F.col("y0"), F.col("x0"), 1), corner(y1, F.col("x0"), -1), corner(F.col("y0"), x1, -1), corner(y1, x1, 1))).alias("c")).select("sample", "c.*")
    # along each column of steps: totals down to the row of each valid pixel's row
    lines = valid.select("sample", "iy").distinct().withColumn("is_row", F.lit(True))
    columns = steps.select("sample", "ix").distinct()
    marks = lines.join(columns, "sample").select("sample", "ix", "iy", F.lit(0).alias("d"), "is_row")
    down = Window.partitionBy("sample", "ix").orderBy("iy").rangeBetween(Window.unboundedPreceding, 0)
    rows = steps.withColumn("is_row", F.lit(False)).unionByName(marks).withColumn("total", F.sum("d").over(down)).filter("is_row").select("sample", "iy", "ix", F.col("total").alias("step"), F.lit(False).alias("wanted"))
    every = rows.unionByName(valid.select(*KEY, F.lit(0).alias("step"), F.lit(True).alias("wanted")))
    across = Window.partitionBy("sample", "iy").orderBy("ix").rangeBetween(Window.unboundedPreceding, 0)
    return every.withColumn("covered", F.sum("step").over(across)).filter("wanted").select(*KEY, F.col("covered").cast("long").alias("covered"))


def verified(tiles: DataFrame, valid: DataFrame) -> DataFrame:
    """(sample, valid, least, most) of the coverage by sample; Rejected if a valid pixel is in no tile."""
    out = coverage(tiles, valid).groupBy("sample").agg(F.count("*").alias("valid"), F.min("covered").alias("least"), F.max("covered").alias("most"))
    if bad := [r["sample"] for r in out.filter("least <= 0").limit(5).collect()]:
        raise Rejected(f"tiles leave valid pixels uncovered: {bad}")
    return out


def near_in_space(points: DataFrame, radius: float) -> DataFrame:
    """(a, b) of points(cell_id, x, y, z) within `radius`, each with itself too: equi-join on cubes of that side and their neighbours."""
    cube = [F.floor(F.col(c) / radius) for c in "xyz"]
    left = points.select(F.col("cell_id").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"], *[v.alias(f"q{c}") for v, c in zip(cube, "xyz", strict=True)])
    around = F.array(*[F.struct(*[(v + d).alias(f"q{c}") for v, d, c in zip(cube, (i, j, k), "xyz", strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    right = points.select(F.col("cell_id").alias("b"), "x", "y", "z", F.explode(around).alias("q")).select("b", "x", "y", "z", "q.*")
    d2 = sum(((F.col(f"a{c}") - F.col(c)) ** 2 for c in "xyz"), F.lit(0.0))
    return left.join(right, ["qx", "qy", "qz"]).filter(d2 <= radius * radius).select("a", "b", "x", "y", "z")


def linearity_in_space(points: DataFrame, radius: float, least: int = 3) -> DataFrame:
    """(cell_id, n, linearity): l1 / (l2 + l3) of the covariance of each point's neighbourhood, itself included; null under `least` points or if these are on one line or place.

    The eigenvalues of the symmetric matrix come in closed form, so a point costs nine sums."""
    pairs = near_in_space(points, radius)
    cov = {p + q: F.covar_pop(p, q).alias(p + q) for p, q in ("xx", "yy", "zz", "xy", "xz", "yz")}
    s = pairs.groupBy("a").agg(F.count("*").alias("n"), *cov.values())
    xx, yy, zz, xy, xz, yz = map(F.col, cov)
    mean = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - mean) ** 2 + (yy - mean) ** 2 + (zz - mean) ** 2 + 2 * off) / 6)
    a, b, c = (xx - mean), (yy - mean), (zz - mean)
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))) / 3
    top = F.when(p > 0, mean + 2 * p * F.cos(angle)).otherwise(mean)
    rest = 3 * mean - top
    return s.select(F.col("a").alias("cell_id"), "n", F.when((F.col("n") >= least) & (rest > 1e-9 * top), top / rest).alias("linearity"))
