"""Following regions and curves through sections: drifting overlaps, merged lobes, stitched ends, robust affine maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .graph import _cut, components
from .spatial import KEY


def one_to_one(pairs: DataFrame) -> DataFrame:
    """pairs(sample, a, b, share): by falling share (ties to smaller ids), each end once; a group is a pair of sections."""

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        used_a, used_b, keep = set(), set(), []
        own = pdf.sort_values(["share", "a", "b"], ascending=[False, True, True])
        for a, b in zip(own.a, own.b, strict=True):
            keep.append(a not in used_a and b not in used_b)
            if keep[-1]:
                used_a.add(a)
                used_b.add(b)
        return own[keep][["sample", "a", "b", "share"]]

    return pairs.groupBy("sample").applyInPandas(greedy, "sample long, a long, b long, share double")


def drifting_links(regions: DataFrame, sections: DataFrame, base: float = 60.0, drift: float = 2.0, least: float = 0.3, farthest: float = 60.0, skips: int = 3, size: float = 10.0) -> DataFrame:
    """a, b, share and skip: regions(sample, iy, ix, region; ids unique over sections) linked to those 1, 2, ... `skips` sections on.

    sections(sample, place, z): place is the number in order. A region grows by base + drift * dz (in pixels of `size`, along
    steps to the four neighbours); the pixels shared with the other region, over the smaller of both, must reach `least`.
    Each region has one link up and one down; nearer sections go first, and beyond the next only up to `farthest`. Only a
    region's border is grown, since its inside is in it already. Regions without a section are left out.
    """
    r = _cut(regions.select(*KEY, "region"))
    cross = F.array(*[F.struct((F.col("iy") + dy).alias("iy"), (F.col("ix") + dx).alias("ix")) for dy, dx in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))])
    inner = r.select("sample", "region", F.explode(cross).alias("p")).groupBy("sample", "region", "p.iy", "p.ix").count().filter("count = 5")
    border = _cut(r.join(inner, ["sample", "region", "iy", "ix"], "left_anti"))
    sizes = r.groupBy("region").agg(F.count("*").alias("n"))
    done = None
    for skip in range(1, skips + 1):
        here = sections.select("sample", "place", "z")
        pair = here.join(here.select((F.col("place") - skip).alias("place"), F.col("sample").alias("above"), F.col("z").alias("z2")), "place")
        pair = pair.withColumn("dz", F.col("z2") - F.col("z"))
        pair = (pair if skip == 1 else pair.filter(F.col("dz") <= farthest)).select("sample", "above", F.greatest(F.lit(1), F.round((base + drift * F.col("dz")) / size).cast("int")).alias("reach"))
        lower, edge, upper = (d if done is None else d.join(done.select(F.col(k).alias("region")), "region", "left_anti") for d, k in ((r, "a"), (border, "a"), (r, "b")))
        grown = edge.join(pair, "sample").withColumn("dy", F.explode(F.sequence(-F.col("reach"), F.col("reach"))))
        grown = grown.withColumn("dx", F.explode(F.sequence(F.abs("dy") - F.col("reach"), F.col("reach") - F.abs("dy"))))
        grown = grown.select(F.col("above").alias("sample"), F.col("region").alias("a"), (F.col("iy") + F.col("dy")).alias("iy"), (F.col("ix") + F.col("dx")).alias("ix"))
        whole = lower.join(pair, "sample").select(F.col("above").alias("sample"), F.col("region").alias("a"), "iy", "ix")
        shared = grown.unionByName(whole).distinct().join(upper.withColumnRenamed("region", "b"), KEY).groupBy("sample", "a", "b").agg(F.count("*").alias("k"))
        both = shared.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").withColumn("share", F.col("k") / F.least("na", "nb"))
        links = _cut(one_to_one(both.filter(F.col("share") >= least).select("sample", "a", "b", "share")).select("a", "b", "share", F.lit(skip).alias("skip")))
        done = links if done is None else _cut(done.unionByName(links))
    return done


def followed(regions: DataFrame, links: DataFrame) -> DataFrame:
    """region and track, the smallest region that links reach."""
    return components(regions.select(F.col("region").alias("node")).distinct(), links.select("a", "b")).toDF("region", "track")


def merge_lobes(members: DataFrame, shares: DataFrame, touch: float = 0.5, part: float = 0.5, least: int = 2) -> DataFrame:
    """chain and merged (the first chain of its group): chains that overlap on enough of the sections they share become one.

    members(sample, chain, z, region), shares(sample, z, a, b, share) for two regions of a section in any order. In order of
    the chains the first pair that touches (share of at least `touch`) on `least` sections and on a `part` of the shared ones
    is merged, and the search begins anew; of two regions of a group on one section the later chain's counts. Chains that no
    touching shares connect can never meet, so a task holds one connected group of chains. chain is below 2^32.
    """
    node = F.col("sample") * (1 << 32) + F.col("chain")
    at = members.select("sample", "z", "region", node.alias("node")).distinct()
    end = lambda k: at.select("sample", "z", F.col("region").alias(k), F.col("node").alias(f"n{k}"))
    close = shares.filter(F.col("share") >= touch)
    edges = close.join(end("a"), ["sample", "z", "a"]).join(end("b"), ["sample", "z", "b"]).select(F.col("na").alias("a"), F.col("nb").alias("b")).filter("a <> b").distinct()
    label = _cut(components(members.select(node.alias("node")).distinct(), edges))
    own = members.withColumn("node", node).join(label, "node").select("component", "sample", "chain", "z", "region")
    met = close.join(end("a").withColumnRenamed("na", "node"), ["sample", "z", "a"]).join(label.withColumnRenamed("component", "of"), "node").select("of", "z", "a", "b", "share").distinct()
    work = lambda own, table: merged_chains(own, table, touch, part, least)
    return own.groupBy("component").cogroup(met.groupBy("of")).applyInPandas(_some(work, ["sample", "chain", "merged"]), "sample long, chain long, merged long")


def merged_chains(own: pd.DataFrame, table: pd.DataFrame, touch: float, part: float, least: int) -> pd.DataFrame:
    share = {}
    for z, a, b, v in zip(table.z, table.a, table.b, table.share, strict=True):
        share[z, a, b] = share[z, b, a] = v
    own = own.sort_values(["chain", "z", "region"])
    groups = [([c], dict(zip(g.z, g.region, strict=True))) for c, g in own.groupby("chain")]

    def meets(p: dict, q: dict) -> bool:
        common = p.keys() & q.keys()
        n = sum(share.get((z, p[z], q[z]), 0.0) >= touch for z in common)
        return n >= least and n >= np.ceil(part * len(common))

    def first() -> tuple[int, int] | None:
        return next(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)) if meets(groups[i][1], groups[j][1])), None)

    while pair := first():
        i, j = pair
        chains = sorted(groups[i][0] + groups.pop(j)[0])
        rows = own[own.chain.isin(chains)]
        groups[i] = chains, dict(zip(rows.z, rows.region, strict=True))
    return pd.DataFrame([(own["sample"].iloc[0], c, chains[0]) for chains, _ in groups for c in chains], columns=["sample", "chain", "merged"])


def _some(work, columns: list[str]):
    """Cases without rows on the left have none in the result."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return work(left, right) if len(left) else pd.DataFrame(columns=columns)

    return run


END = StructType([StructField(n, DoubleType()) for n in ("z0", "x0", "x1", "x2", "y0", "y1", "y2")] + [StructField("degree", IntegerType())])


@F.pandas_udf(END)
def through(zs: pd.Series, xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    """A curve by least squares through a few planes: of degree 2 from four on, 1 from two on, else a point; coefficients count z from the first."""
    out = []
    for z, x, y in zip(zs, xs, ys, strict=True):
        t = np.asarray(z, float) - z[0]
        degree = 2 if len(t) >= 4 else min(len(t) - 1, 1)
        cx, cy = (np.pad(np.polyfit(t, v, degree)[::-1], (0, 2 - degree)) for v in (x, y))
        out.append((z[0], *cx, *cy, degree))
    return pd.DataFrame(out, columns=END.names)


def _value(curve: str, axis: str, z: Column) -> Column:
    t = z - F.col(f"{curve}.z0")
    return F.col(f"{curve}.{axis}0") + t * (F.col(f"{curve}.{axis}1") + t * F.col(f"{curve}.{axis}2"))


def ends(lines: DataFrame, planes: int, top: bool) -> DataFrame:
    """(sample, g, z, x, y, curve) of the upper or lower end of each line of lines(sample, g, z, x, y)."""
    from_end = Window.partitionBy("sample", "g").orderBy(F.desc("z") if top else F.asc("z"))
    few = lines.withColumn("k", F.row_number().over(from_end)).filter(F.col("k") <= planes).groupBy("sample", "g").agg(F.array_sort(F.collect_list(F.struct("z", "x", "y"))).alias("p"))
    last = F.element_at("p", -1 if top else 1)
    return few.select("sample", "g", last["z"].alias("z"), last["x"].alias("x"), last["y"].alias("y"), through("p.z", "p.x", "p.y").alias("curve"))


def _near(left: DataFrame, right: DataFrame, on: list[str], a: tuple[str, str], b: tuple[str, str], reach: float) -> DataFrame:
    """Rows that agree on `on` and whose places a and b fall in the same or neighbouring squares of side `reach`."""
    square = lambda c: F.floor(F.col(c) / reach)
    steps = F.explode(F.array(*[F.struct((square(b[0]) + i).alias("qx"), (square(b[1]) + j).alias("qy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    spread = right.withColumn("q", steps).select(*right.columns, "q.qx", "q.qy")
    return left.withColumn("qx", square(a[0])).withColumn("qy", square(a[1])).join(spread, [*on, "qx", "qy"]).drop("qx", "qy")


def meetings(upper: DataFrame, lower: DataFrame, farthest: float, reach: float) -> DataFrame:
    """Pairs of an upper and a lower end above it that can meet within `reach`: the ends are near, or their curves at the gap's middle.

    An upper end is carried to the middle of the gap to each level in range, a lower end to that from each level below; only
    those of the same two levels and neighbouring squares are paired."""
    up = upper.select("sample", F.col("g").alias("a"), F.col("z").alias("za"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("curve").alias("ca"))
    low = lower.select("sample", F.col("g").alias("b"), F.col("z").alias("zb"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("curve").alias("cb"))
    gap = (F.col("zb") > F.col("za")) & (F.col("zb") <= F.col("za") + farthest)
    starts, stops = low.select("sample", "zb").distinct(), up.select("sample", "za").distinct()
    between = stops.join(starts, "sample").filter(gap)  # two rows of levels, not of ends
    middle = (F.col("za") + F.col("zb")) / 2
    up = up.join(between, ["sample", "za"]).withColumn("mxa", _value("ca", "x", middle)).withColumn("mya", _value("ca", "y", middle))
    low = low.join(between, ["sample", "zb"]).withColumn("mxb", _value("cb", "x", middle)).withColumn("myb", _value("cb", "y", middle))
    on = ["sample", "za", "zb"]
    keys = lambda a, b: _near(up.select(*on, "a", *a), low.select(*on, "b", *b), on, a, b, reach).select(*on, "a", "b")
    pairs = keys(("xa", "ya"), ("xb", "yb")).union(keys(("mxa", "mya"), ("mxb", "myb"))).distinct().filter("a <> b")
    return pairs.join(up, [*on, "a"]).join(low, [*on, "b"])


def support_of(pairs: DataFrame, points: DataFrame, levels: DataFrame, radius: float, full: int) -> DataFrame:
    """(sample, a, b, support): on each level of a gap, points within `radius` of the path from one curve to the other, full at `full`; their mean over the levels, 0 without one."""
    empty = pairs.join(levels, "sample").filter((F.col("z") > F.col("za")) & (F.col("z") < F.col("zb")))
    w = (F.col("z") - F.col("za")) / (F.col("zb") - F.col("za"))
    at = lambda v: ((1 - w) * _value("ca", v, F.col("z")) + w * _value("cb", v, F.col("z"))).alias(f"p{v}")
    path = empty.select("sample", "a", "b", "z", at("x"), at("y"))
    near = _near(points.select("sample", "z", "x", "y"), path, ["sample", "z"], ("x", "y"), ("px", "py"), radius).filter(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) <= radius)
    seen = near.groupBy("sample", "a", "b", "z").agg(F.least(F.lit(1.0), F.count("*") / full).alias("s"))
    return path.join(seen, ["sample", "a", "b", "z"], "left").groupBy("sample", "a", "b").agg(F.avg(F.coalesce("s", F.lit(0.0))).alias("support"))


def best_first(pairs: DataFrame) -> DataFrame:
    """Of pairs(sample, a, b, ratio) those that a walk by rising ratio (ties to smaller a, then b) takes, each a and each b once: pairs that
    are best for both of their ends are taken together, and the search goes on among what is left."""
    out, left = None, _cut(pairs.select("sample", "a", "b", "ratio"))
    order = lambda k: F.row_number().over(Window.partitionBy("sample", k).orderBy("ratio", "a", "b"))
    while not left.isEmpty():
        taken = _cut(left.withColumn("i", order("a")).withColumn("j", order("b")).filter("i = 1 and j = 1").select("sample", "a", "b"))
        out = taken if out is None else out.unionByName(taken)
        left = _cut(left.join(taken.select("sample", "a"), ["sample", "a"], "left_anti").join(taken.select("sample", "b"), ["sample", "b"], "left_anti"))
    return pairs.select("sample", "a", "b").limit(0) if out is None else out


def stitch(
    curves: DataFrame, points: DataFrame, base: float = 150.0, drift: float = 1.5, farthest: float = 60.0, bend: float = 60.0, gain: float = 1.0, planes: int = 5, radius: float = 150.0, full: int = 8, rounds: int = 8
) -> DataFrame:
    """sample, object and stitched (the smallest object of its group): upper ends joined to lower ends that begin above them.

    curves(sample, object, z, x, y) are centre lines, points(sample, z, x, y) what may support a gap; objects are unique. In a round every upper
    end, continued by a curve through its last `planes` planes, meets the lower ends within `farthest`; the distance at the
    gap's middle, or of the ends if less, must keep base + drift * dz, widened by `gain` times the mean support of the
    empty planes (points within `radius` of the path, full at `full`). Ends further apart than `base` must not bend by more than
    `bend` degrees. The best ratio to its tolerance goes first, each end once; rounds go on until none joins. Ends, gaps and
    supporting points are tables that meet by level and square; an end's few planes are all that a function sees. A join leads upwards, so none closes a ring.
    """
    group = _cut(curves.select("sample", "object").distinct().withColumn("g", F.col("object")))
    levels = _cut(curves.select("sample", "z").union(points.select("sample", "z")).distinct())
    reach = (base + drift * farthest) * (1 + gain)
    for _ in range(rounds):
        lines = _cut(curves.join(group, ["sample", "object"]).groupBy("sample", "g", "z").agg(F.avg("x").alias("x"), F.avg("y").alias("y")))
        met = _cut(meetings(ends(lines, planes, True), ends(lines, planes, False), farthest, reach))
        dz = F.col("zb") - F.col("za")
        chord = (F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya"), dz)
        apart = F.hypot(chord[0], chord[1])

        def angle(c: str, z: Column) -> Column:
            slope = [F.col(f"{c}.{v}1") + 2 * F.col(f"{c}.{v}2") * (z - F.col(f"{c}.z0")) for v in "xy"]  # noqa: B023
            dot, long = slope[0] * chord[0] + slope[1] * chord[1] + chord[2], F.sqrt(slope[0] * slope[0] + slope[1] * slope[1] + 1) * F.sqrt(chord[0] * chord[0] + chord[1] * chord[1] + chord[2] * chord[2])  # noqa: B023
            return F.when(F.col(f"{c}.degree") > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / long))))).otherwise(0.0)

        straight = (apart <= base) | (F.greatest(angle("ca", F.col("za")), angle("cb", F.col("zb"))) <= bend)
        held = met.filter(straight).join(support_of(met, points, levels, radius, full), ["sample", "a", "b"], "left")
        d = F.least(apart, F.hypot(F.col("mxb") - F.col("mxa"), F.col("myb") - F.col("mya")))
        ratio = d / ((base + drift * dz) * (1 + gain * F.coalesce("support", F.lit(0.0))))
        joined = _cut(best_first(held.withColumn("ratio", ratio).filter(F.col("ratio") <= 1)))
        if joined.isEmpty():
            break
        label = components(group.select(F.col("g").alias("node")).distinct(), joined)
        group = _cut(group.join(label, F.col("g") == F.col("node")).select("sample", "object", F.col("component").alias("g")))
    return group.withColumnRenamed("g", "stitched")


def affine(pairs: DataFrame) -> DataFrame:
    """pairs(sample, x, y, u, v, w): the map (x, y) -> (a x + b y + e, c x + d y + f) of least weighted squares for each sample;
    samples whose points lie on one line have no row. Sums only: any number of pairs is pre-aggregated before the shuffle."""
    mean = pairs.groupBy("sample").agg(*[(F.sum(F.col("w") * F.col(k)) / F.sum("w")).alias("m" + k) for k in "xyuv"])
    at = pairs.join(mean, "sample")
    s = at.groupBy("sample", "mx", "my", "mu", "mv").agg(*[F.sum(F.col("w") * (F.col(p) - F.col("m" + p)) * (F.col(q) - F.col("m" + q))).alias(p + q) for p, q in ("xx", "xy", "yy", "xu", "yu", "xv", "yv")])
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    s = s.withColumn("det", det).filter(F.col("det") > 1e-9 * F.col("xx") * F.col("yy"))
    one = lambda p, q: F.expr(f"({p} - {q}) / det")
    s = s.select("sample", "mx", "my", "mu", "mv", one("xu * yy", "yu * xy").alias("a"), one("yu * xx", "xu * xy").alias("b"), one("xv * yy", "yv * xy").alias("c"), one("yv * xx", "xv * xy").alias("d"))
    return s.select("sample", "a", "b", "c", "d", F.expr("mu - a * mx - b * my").alias("e"), F.expr("mv - c * mx - d * my").alias("f"))


def robust_affine(pairs: DataFrame, least: float = 15.0, factor: float = 2.5) -> DataFrame:
    """`affine`, fitted again without the pairs whose residual exceeds both `least` and `factor` times the median, if at least four stay;
    n and n_kept count the pairs."""
    residual = F.expr("sqrt(pow(a * x + b * y + e - u, 2D) + pow(c * x + d * y + f - v, 2D))")
    r = pairs.join(affine(pairs), "sample").withColumn("r", residual).select("sample", "x", "y", "u", "v", "w", "r")
    limit = r.groupBy("sample").agg(F.greatest(F.lit(least), factor * F.expr("percentile(r, 0.5)")).alias("limit"), F.count("*").alias("n"))
    r = r.join(limit, "sample").withColumn("good", F.col("r") <= F.col("limit"))
    r = r.join(r.groupBy("sample").agg(F.count_if("good").alias("k")), "sample").filter("good or k < 4")
    kept = r.groupBy("sample", "n").agg(F.count("*").alias("n_kept"))
    return affine(r).join(kept, "sample").select("sample", "n", "n_kept", "a", "b", "c", "d", "e", "f")


def curve_models(points: DataFrame, rms: float = 30.0, radius: float = 150.0, slack: float = 1.3, turn: float = 120.0) -> DataFrame:
    """sample, object, model, rms and curvature of points(sample, object, x, y, z): a line, a parabola or an S in the plane of the
    two longest axes. A model needs 2, 4 or 6 points, must not curve tighter than `radius`, an S not turn by more than `turn`
    degrees in all; of those with a root mean square distance of at most `rms` the simplest within `slack` of the best is
    chosen. Distances are taken across the longest axis and out of the plane. Objects without a model have a null one."""
    least = {1: 2, 2: 4, 3: 6}
    names = {1: "line", 2: "parabola", 3: "scurve"}

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y", "z"]].to_numpy(float)
        p = p - p.mean(axis=0)
        _, _, axes = np.linalg.svd(p, full_matrices=True)
        u, v, w = (p @ a for a in axes)
        at, found = np.linspace(u.min(), u.max(), 200), []
        for degree, n in least.items():
            if len(p) < n or np.ptp(u) == 0:
                continue
            f = np.poly1d(np.polyfit(u / np.ptp(u), v, degree))
            d1, d2 = f.deriv()(at / np.ptp(u)) / np.ptp(u), f.deriv(2)(at / np.ptp(u)) / np.ptp(u) ** 2
            curvature = float((np.abs(d2) / (1 + d1**2) ** 1.5).max())
            turned = float(np.degrees(np.abs(np.diff(np.arctan(d1))).sum()))
            error = float(np.sqrt(np.mean((v - f(u / np.ptp(u))) ** 2 + w**2)))
            if error <= rms and curvature <= 1 / radius and (degree < 3 or turned <= turn):
                found.append((names[degree], error, curvature))
        best = min((e for _, e, _ in found), default=0.0)
        pick = next((m for m in found if m[1] <= slack * best + 1e-9), (None, None, None))
        return pd.DataFrame([(pdf["sample"].iloc[0], pdf.object.iloc[0], *pick)], columns=["sample", "object", "model", "rms", "curvature"])

    return points.groupBy("sample", "object").applyInPandas(choose, "sample long, object long, model string, rms double, curvature double")


def lane_nearest(own: DataFrame, other: DataFrame, width: float, k: int = 2, reach: int = 4) -> DataFrame:
    """own(z, kind, lane, x, y), other the same: (z, kind, lane, to, d, rank), the `k` nearest of `other` with that z and kind, by distance to nine digits,
    then lane. A lane is a stretch of y of `width`, so lanes more than n apart are more than n * width apart: a few lanes around are looked at, four times
    as many for those whose k-th could be farther, never all by all."""
    key, order = ["z", "kind"], Window.partitionBy("z", "kind", "lane").orderBy(F.round("d", 9), "to")
    there = other.groupBy(*key).agg(F.min("lane").alias("lo"), F.max("lane").alias("hi"))
    rest, out = _cut(own.join(there, key)), None
    far = other.select(*key, F.col("lane").alias("to"), F.col("x").alias("u"), F.col("y").alias("v"))
    while True:
        first, last = F.greatest(F.col("lane") - reach, F.col("lo")), F.least(F.col("lane") + reach, F.col("hi"))
        seen = rest.filter(first <= last).withColumn("to", F.explode(F.sequence(first, last))).join(far, [*key, "to"])
        dx, dy = F.col("x") - F.col("u"), F.col("y") - F.col("v")
        best = seen.withColumn("d", F.sqrt(dx * dx + dy * dy)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        every = (F.col("lane") - reach <= F.col("lo")) & (F.col("lane") + reach >= F.col("hi"))
        kth = F.max(F.when(F.col("rank") == k, F.col("d"))).over(Window.partitionBy("z", "kind", "lane"))
        sure = F.coalesce(every | (kth < width * reach - 1e-6), F.lit(False))
        done = _cut(best.withColumn("sure", sure).filter("sure").select(*key, "lane", "to", "d", "rank"))
        out = done if out is None else out.unionByName(done)
        rest = _cut(rest.join(done.select(*key, "lane").distinct(), [*key, "lane"], "left_anti"))
        if rest.isEmpty():
            return out
        reach *= 4
