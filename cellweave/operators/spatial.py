"""Point and lattice operators. A lattice is a sparse table (sample, iy, ix, ...); a point is in pixel floor(x / size)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .graph import _cut, components
from .runs import gaps, labelled, pixels, runs
from .tiles import linkage as linkage  # part of this module's interface
from .tiles import whole_groups

KEY = ["sample", "iy", "ix"]
#: A lattice's number of rows or columns: one for all samples, a table (sample, n), or None for a plane without a rim, if both are None
#: (rasterise, cut and what is made of them, gaussian); there `sample` may be of any type.
Side = int | DataFrame | None


def pixel(v: str, size: float, n: int) -> Column:
    """Outliers go to the border."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.col(v) / size))).cast("long")


def sided(df: DataFrame, **sides: Side) -> DataFrame:
    """df with a column for each side."""
    for name, n in sides.items():
        df = df.withColumn(name, F.lit(n)) if isinstance(n, int) else df.join(n.select("sample", F.col("n").alias(name)), "sample")
    return df


def framed(points: DataFrame, size: float = 10.0, pad: float = 100.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The points with x and y counted from the corner of their sample's frame (all its points and `pad` around), nx and ny."""
    x0, y0 = F.min("x") - pad, F.min("y") - pad
    side = lambda c: F.ceil((F.max(c) - F.min(c) + 2 * pad) / size).cast("long")
    frame = points.groupBy("sample").agg(x0.alias("x0"), y0.alias("y0"), side("x").alias("nx"), side("y").alias("ny"))
    moved = points.join(frame.select("sample", "x0", "y0"), "sample").withColumn("x", F.col("x") - F.col("x0")).withColumn("y", F.col("y") - F.col("y0")).drop("x0", "y0")
    return moved, frame.select("sample", F.col("nx").alias("n")), frame.select("sample", F.col("ny").alias("n"))


def at_pixel(points: DataFrame, nx: Side, ny: Side, size: float = 10.0) -> DataFrame:
    """points with iy and ix; points of a frame lie inside it."""
    for k, v, n in (("iy", "y", ny), ("ix", "x", nx)):
        points = points.withColumn(k, pixel(v, size, n) if isinstance(n, int) else F.floor(F.col(v) / size).cast("long"))
    return points


def rasterise(points: DataFrame, nx: Side, ny: Side, size: float = 10.0) -> DataFrame:
    return at_pixel(points, nx, ny, size).groupBy(*KEY).agg(F.count("*").alias("n"))


def cut(df: DataFrame, nx: Side, ny: Side) -> DataFrame:
    """The rows inside the lattice; a plane without a rim has all."""
    if nx is None and ny is None:
        return df
    inside = F.col("iy").between(0, F.col("__ny") - 1) & F.col("ix").between(0, F.col("__nx") - 1)
    return sided(df, __nx=nx, __ny=ny).filter(inside).drop("__nx", "__ny")


def offsets(radius: int) -> list[tuple[int, int]]:
    """The disk dx² + dy² <= radius²."""
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dx * dx + dy * dy <= radius * radius]


#: Disks wider than this go by distances, whose cost does not grow with the radius; smaller ones by copies of a tile, one for each pixel of the disk.
BY_COPIES = 4
#: A tile's side, and the pixels that a task takes up at a time.
TILE, PIXELS_AT_ONCE = 256, 1 << 18


def widened(a: np.ndarray, radius: int) -> np.ndarray:
    """Dilation with a disk."""
    (h, w), p, out = a.shape, np.pad(a, radius), np.zeros_like(a)
    for dy, dx in offsets(radius):
        out |= p[radius + dy : radius + dy + h, radius + dx : radius + dx + w]
    return out


def narrowed(a: np.ndarray, radius: int) -> np.ndarray:
    """Erosion with a disk; what is beyond the border is background."""
    return ~widened(np.pad(~a, radius, constant_values=True), radius)[radius : radius + a.shape[0], radius : radius + a.shape[1]]


def _by_tiles(mask: DataFrame, steps: list[int], nx: Side, ny: Side, rim: bool = False) -> DataFrame:
    """The mask widened by each step with a disk (narrowed where it is negative; outside is background) and cut to the lattice at the end, with
    `rim` after each step. A tile's pixels and those that can reach it are one array; a mask of millions of pixels is never copied for its disk."""
    reach = sum(abs(k) for k in steps)
    plane = nx is None and ny is None
    sides = [] if plane else ["__ny", "__nx"]
    own = mask.select("sample", *[F.col(c).cast("long").alias(c) for c in ("iy", "ix")])
    own = own if plane else sided(own, __nx=nx, __ny=ny).withColumns({c: F.col(c).cast("long") for c in sides})
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / TILE), F.floor((F.col(c) + reach) / TILE)))
    near = own.withColumn("ty", tiles("iy")).withColumn("tx", tiles("ix"))
    keys = ["sample", "ty", "tx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, of in whole_groups(batches, keys, PIXELS_AT_ONCE):
            y, x, ty, tx, *size = (t.column(c).to_numpy() for c in ("iy", "ix", "ty", "tx", *sides))
            first = np.searchsorted(of, np.arange(of[-1] + 2))
            found = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                top, left = int(y[a:b].min()) - reach, int(x[a:b].min()) - reach
                box = np.zeros((int(y[a:b].max()) - top + reach + 1, int(x[a:b].max()) - left + reach + 1), bool)
                box[y[a:b] - top, x[a:b] - left] = True
                lattice = [slice(max(0, -low), max(0, int(n[a]) - low)) for n, low in zip(size, (top, left), strict=False)]
                for k, step in enumerate(steps):
                    box = widened(box, step) if step > 0 else narrowed(box, -step)
                    if not plane and (rim or k == len(steps) - 1):
                        inside = np.zeros_like(box)
                        inside[*lattice] = box[*lattice]
                        box = inside
                low = [max(0, int(c[a]) * TILE - v) for c, v in ((ty, top), (tx, left))]
                at = np.argwhere(box[low[0] : max(0, (int(ty[a]) + 1) * TILE - top), low[1] : max(0, (int(tx[a]) + 1) * TILE - left)])
                found.append(at + (top + low[0], left + low[1]))
            n = np.array([len(p) for p in found])
            at = np.concatenate(found)
            sample = t.column("sample").combine_chunks().take(pa.array(np.repeat(first[:-1], n)))
            yield pa.RecordBatch.from_arrays([sample, pa.array(at[:, 0]), pa.array(at[:, 1])], KEY)

    kind = StructType([mask.schema["sample"], StructField("iy", LongType()), StructField("ix", LongType())])
    return near.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, kind)


def dilate(mask: DataFrame, radius: int, nx: Side, ny: Side) -> DataFrame:
    if radius > BY_COPIES and nx is not None:
        return distance_fields(mask, nx, ny, within=radius).select(*KEY)
    return _by_tiles(mask, [radius], nx, ny)


def erode(mask: DataFrame, radius: int) -> DataFrame:
    """A pixel stays if its whole disk is in the mask; outside the lattice is background."""
    return _by_tiles(mask, [-radius], None, None)


def _eroded(mask: DataFrame, radius: int, nx: Side, ny: Side) -> DataFrame:
    """`erode` of a mask inside the lattice, a large disk by the distance to what is outside: rest of the lattice, or beyond its rim."""
    if radius <= BY_COPIES or nx is None:
        return erode(mask, radius)
    rim = F.least("iy", "ix", F.col("__ny") - 1 - F.col("iy"), F.col("__nx") - 1 - F.col("ix"))
    inner = distance_fields(mask, nx, ny, own=True).filter(F.col("i2").isNull() | (F.col("i2") > radius * radius))
    return sided(inner.select(*KEY), __nx=nx, __ny=ny).filter(rim >= radius).select(*KEY)


def opening(mask: DataFrame, radius: int, nx: Side, ny: Side) -> DataFrame:
    if radius <= BY_COPIES or nx is None:
        return _by_tiles(mask, [-radius, radius], nx, ny)
    return dilate(_eroded(mask, radius, nx, ny), radius, nx, ny)


def closing(mask: DataFrame, radius: int, nx: Side, ny: Side, rim: bool = False) -> DataFrame:
    """Dilation on an unbounded plane, so that erosion does not see the border, then cut to the lattice; with `rim` what is beyond it
    counts as background, so pixels within `radius` of the border go."""
    if radius <= BY_COPIES or nx is None:
        return _by_tiles(mask, [radius, -radius], nx, ny, rim)
    if rim:
        return _eroded(dilate(mask, radius, nx, ny), radius, nx, ny)
    moved = lambda df, by: df.select("sample", (F.col("iy") + by).alias("iy"), (F.col("ix") + by).alias("ix"))
    wider = lambda n: n + 2 * radius if isinstance(n, int) else n.select("sample", (F.col("n") + 2 * radius).alias("n"))
    sides = wider(nx), wider(ny)
    return cut(moved(_eroded(dilate(moved(mask, radius), radius, *sides), radius, *sides), -radius), nx, ny).select(*KEY)


def disk_count(counts: DataFrame, radius: int, nx: Side, ny: Side) -> DataFrame:
    disk = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets(radius)])
    moved = counts.select(*KEY, "n", F.explode(disk).alias("o"))
    moved = moved.select("sample", (F.col("iy") + F.col("o.dy")).alias("iy"), (F.col("ix") + F.col("o.dx")).alias("ix"), "n")
    return cut(moved, nx, ny).groupBy(*KEY).agg(F.sum("n").alias("n"))


def weights(sigma: float) -> list[tuple[int, float]]:
    """(step, weight) of a 1-D Gaussian cut at 4 sigma."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    return [(d, v / sum(w)) for d, v in zip(range(-r, r + 1), w, strict=True)]


def kernel(n: int, sigma: float) -> list[tuple[int, int, float]]:
    """(target, source, weight) of a 1-D Gaussian cut at 4 sigma with reflected borders."""
    out = []
    for t in range(n):
        for d, w in weights(sigma):
            s = (t + d) % (2 * n)
            out.append((t, s if s < n else 2 * n - 1 - s, w))
    return out


def blur(of: np.ndarray, at: np.ndarray, n: np.ndarray, sides: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines, places that their values n at `at` reach and what arrives there; `of` numbers the values' lines and the borders of a line 0..side-1 reflect."""
    r, side, start = len(w) // 2, sides[of][:, None], np.cumsum(sides) - sides
    to = (at[:, None] + np.arange(-r, r + 1)) % (2 * side)
    to = (start[of][:, None] + np.where(to < side, to, 2 * side - 1 - to)).ravel()
    total = np.bincount(to, (n[:, None] * w).ravel(), int(sides.sum()))
    where = np.flatnonzero(np.bincount(to, minlength=len(total)))
    line = np.searchsorted(start, where, "right") - 1
    return line, where - start[line], total[where]


#: Places of lines, and values times weights, that are blurred at a time; a line is blurred whole.
PLACES_AT_ONCE = 1 << 20


def gaussian(counts: DataFrame, sigma: float, nx: Side, ny: Side) -> DataFrame:
    """Separable density: each row's pixels are one array, then each column's, so a pixel is one row in each of two shuffles
    whatever sigma, and many lines are blurred at a time; on a plane without a rim, one explode and sum along each axis, nothing reflected."""
    d = counts
    w = np.array([v for _, v in weights(sigma)])

    @F.arrow_udf(ArrayType(StructType([StructField("at", LongType()), StructField("n", DoubleType())])))
    def blurred(line: pa.Array, side: pa.Array) -> pa.Array:
        at, n, sides = line.flatten().field(0).to_numpy(), line.flatten().field(1).to_numpy(), side.to_numpy()
        ends = line.offsets.to_numpy() - line.offsets[0].as_py()
        of = np.repeat(np.arange(len(sides)), np.diff(ends))
        work, done = np.cumsum(np.maximum(sides, np.diff(ends) * len(w))), []
        for part in np.split(np.arange(len(sides)), np.flatnonzero(np.diff(work // PLACES_AT_ONCE)) + 1):
            if len(part):
                a, b = ends[part[0]], ends[part[-1] + 1]
                where, *found = blur(of[a:b] - part[0], at[a:b], n[a:b], sides[part], w)
                done.append((where + part[0], *found))
        cat = lambda k, t: np.concatenate([np.zeros(0, t), *(x[k] for x in done)])
        reached = np.bincount(cat(0, np.int64), minlength=len(sides))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(reached)), pa.int32()), pa.StructArray.from_arrays([pa.array(cat(1, np.int64)), pa.array(cat(2, float))], ["at", "n"]))

    for c, n, other in (("ix", nx, "iy"), ("iy", ny, "ix")):
        if n is None:
            steps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("w")) for k, v in weights(sigma)])).alias("s")
            d = d.select(*KEY, "n", steps).groupBy("sample", other, (F.col(c) + F.col("s.k")).alias(c)).agg(F.sum(F.col("n") * F.col("s.w")).alias("n"))
            continue
        lines = d.groupBy("sample", other).agg(F.collect_list(F.struct(F.col(c).cast("long").alias("at"), F.col("n").cast("double").alias("n"))).alias("line"))
        d = sided(lines, side=n).select("sample", other, F.inline(blurred("line", F.col("side").cast("long")))).withColumnRenamed("at", c)
    return d.select(*KEY, F.col("n").alias("density"))


def lattice(mask: DataFrame, nx: Side, ny: Side) -> DataFrame:
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    samples = sided(mask.select("sample").distinct(), __nx=nx, __ny=ny)
    return samples.withColumn("iy", number("__ny")).withColumn("ix", number("__nx")).select(*KEY)


def column_nearest(iy: np.ndarray, ny: int, within: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a column with mask pixels at iy: places, the nearest mask pixel of each (the upper of two), and how far the nearest other pixel is, -1 without one."""
    iy = np.sort(iy)
    y = np.arange(ny)
    after = np.minimum(np.searchsorted(iy, y), len(iy) - 1)
    before = np.maximum(after - 1, 0)
    own = np.where(np.abs(y - iy[before]) <= np.abs(y - iy[after]), iy[before], iy[after])
    if within is not None:
        near = np.abs(y - own) <= within
        return y[near], own[near], np.zeros(int(near.sum()), np.int64)
    rest, free = np.zeros(ny, np.int64), np.setdiff1d(y, iy, assume_unique=True)
    if len(free):
        k = np.minimum(np.searchsorted(free, iy), len(free) - 1)
        rest[iy] = np.minimum(np.abs(free[k] - iy), np.abs(free[np.maximum(k - 1, 0)] - iy))
    else:
        rest[iy] = -1
    return y, own, rest


def envelope(at: list[int], f: list[int], scale: int, n: int) -> np.ndarray:
    """For i in 0..n-1 the index of the parabola scale (i - at)² + f that is lowest there; no two are equal at an integer, or the left one wins."""
    kept, begins = [], []
    for k, (q, h) in enumerate(zip(at, f, strict=True)):
        begin = 0
        while kept:
            p = kept[-1]
            begin = (h + scale * q * q - f[p] - scale * at[p] * at[p]) // (2 * scale * (q - at[p])) + 1
            if begin > begins[-1]:
                break
            kept.pop()
            begins.pop()
            begin = 0
        if begin < n:
            kept.append(k)
            begins.append(max(begin, 0))
    return np.array(kept, np.int64)[np.searchsorted(np.array(begins), np.arange(n), "right") - 1]


#: Row and column numbers stay under this.
WIDE = 1 << 21


def row_nearest(ix: np.ndarray, own: np.ndarray, rest: np.ndarray, iy: int, nx: int, within: int | None, inside: bool) -> tuple[np.ndarray, ...]:
    """Of a row: ix, squared distance to the mask, to the rest (-1 without one), and the nearest mask pixel; of equally near ones the first by iy and ix."""
    order = np.argsort(ix)
    ix, own, rest = ix[order], own[order], rest[order]
    g = (own - iy) ** 2
    scale = WIDE * WIDE
    key = [int(d) * scale + int(y) * WIDE + int(x) for d, y, x in zip(g, own, ix, strict=True)]
    k = envelope(ix.tolist(), key, scale, nx)
    i = np.arange(nx)
    o2 = g[k] + (i - ix[k]) ** 2
    i2 = np.zeros(nx, np.int64)
    hit = ix[g == 0]
    if within is not None:
        show = o2 <= within * within
    else:
        show = np.isin(i, hit) if inside else np.ones(nx, bool)
        if len(hit):
            away = np.zeros(nx, np.int64)
            away[hit] = rest[g == 0]
            free = np.flatnonzero(away >= 0)  # columns with anything that is not mask
            if len(free):
                j = free[envelope(free.tolist(), (away[free] ** 2).tolist(), 1, nx)]
                i2[hit] = (away[j] ** 2 + (i - j) ** 2)[hit]
            else:
                i2[hit] = -1
    return i[show], o2[show], i2[show], own[k][show], ix[k][show]


def _listed(parts: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Array:
    flat = [pa.array(np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)])) for k in range(len(names))]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(p[0]) for p in parts)]), pa.int32()), pa.StructArray.from_arrays(flat, names))


def _fields(*names: str) -> ArrayType:
    return ArrayType(StructType([StructField(n, LongType()) for n in names]))


def distance_fields(mask: DataFrame, nx: Side, ny: Side, within: int | None = None, own: bool = False) -> DataFrame:
    """(sample, iy, ix, o2, i2, jy, jx) for each pixel of a lattice with mask pixels: squared pixel distance to the mask, to its complement
    (null without one), and the nearest mask pixel, of equally near ones the first by iy and ix.

    A column with mask pixels is one array, and so is a row of what the columns tell; empty columns are never made. The row pass is a lower
    envelope of parabolas, linear in the row. within: only pixels so near the mask (i2 is not looked for); own: only the mask's.
    """

    @F.arrow_udf(_fields("iy", "own", "rest"))
    def down(pixels: pa.Array, side: pa.Array) -> pa.Array:
        return _listed([column_nearest(np.array(v, np.int64), n, within) for v, n in zip(pixels.to_pylist(), side.to_pylist(), strict=True)], ["iy", "own", "rest"])

    @F.arrow_udf(_fields("ix", "o2", "i2", "jy", "jx"))
    def across_row(line: pa.Array, iy: pa.Array, side: pa.Array) -> pa.Array:
        flat, cut = line.flatten(), (line.offsets.to_numpy() - line.offsets[0].as_py()).tolist()
        x, o, r = (flat.field(k).to_numpy() for k in range(3))
        return _listed([row_nearest(x[a:b], o[a:b], r[a:b], y, n, within, own) for a, b, y, n in zip(cut, cut[1:], iy.to_pylist(), side.to_pylist(), strict=False)], ["ix", "o2", "i2", "jy", "jx"])

    columns = mask.groupBy("sample", F.col("ix").cast("long").alias("ix")).agg(F.collect_set(F.col("iy").cast("long")).alias("pixels"))
    told = sided(columns, side=ny).select("sample", "ix", F.inline(down("pixels", F.col("side").cast("long"))))
    rows = told.groupBy("sample", "iy").agg(F.collect_list(F.struct("ix", "own", "rest")).alias("line"))
    out = sided(rows, side=nx).select("sample", "iy", F.inline(across_row("line", "iy", F.col("side").cast("long"))))
    return out.select(*KEY, "o2", F.when(F.col("i2") >= 0, F.col("i2")).alias("i2"), "jy", "jx")


def squared_distance(mask: DataFrame, nx: Side, ny: Side) -> DataFrame:
    """Exact squared pixel distance to the nearest mask pixel of the lattice."""
    return distance_fields(mask, nx, ny).select(*KEY, F.col("o2").alias("d2"))


def window_sum(counts: DataFrame, half: int, nx: Side, ny: Side) -> DataFrame:
    """For each pixel of the lattice the sum of n over the square `half` pixels around it, what lies beyond the border left out:
    running totals along the rows, then along the columns, each taken at a window's two ends."""
    every = lattice(counts, nx, ny).join(counts.select(*KEY, "n"), KEY, "left").withColumn("total", F.coalesce("n", F.lit(0)))
    for line, along in (("iy", "ix"), ("ix", "iy")):
        w = Window.partitionBy("sample", line).orderBy(along)
        every = every.withColumn("upto", F.sum("total").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        end = F.coalesce(F.lead("upto", half).over(w), F.last("upto").over(w.rowsBetween(0, half)))
        every = every.withColumn("end", end).withColumn("total", F.col("end") - F.coalesce(F.lag("upto", half + 1).over(w), F.lit(0)))
    return every.select(*KEY, "total")


def signed_distance(mask: DataFrame, nx: Side, ny: Side, size: float = 10.0) -> DataFrame:
    """(distance to the mask - distance to its complement) * size: negative inside."""
    return distance_fields(mask, nx, ny).select(*KEY, ((F.sqrt("o2") - F.sqrt(F.coalesce("i2", F.lit(0)))) * size).alias("sdf"))


def lattice_components(mask: DataFrame, eight: bool = False) -> DataFrame:
    """mask with region: the smallest pixel number of its 4- or 8-connected component within a sample."""
    return pixels(labelled(runs(mask), eight), "region")


def remove_small(mask: DataFrame, least: int, eight: bool = False) -> DataFrame:
    of = labelled(runs(mask), eight)
    big = of.groupBy("region").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("size")).filter(F.col("size") >= least)
    return pixels(of.join(big, "region"), "region", "size")


def fill_holes(mask: DataFrame, nx: Side, ny: Side, most: int | None = None) -> DataFrame:
    """Adds background components that do not touch the border, all or those of at most `most` pixels. The background is
    known by its runs, a few for each row. The mask is checkpointed, because its plan would otherwise run once for each use."""
    mask = _cut(mask.select(*KEY))
    sides = sided(mask.select("sample").distinct(), nx=nx, ny=ny)
    empty = labelled(gaps(runs(mask), sides)).join(sides, "sample")
    edge = (F.col("iy") == 0) | (F.col("iy") == F.col("ny") - 1) | (F.col("x0") == 0) | (F.col("x1") == F.col("nx") - 1)
    holes = empty.groupBy("region").agg(F.max(edge).alias("open"), F.sum(F.col("x1") - F.col("x0") + 1).alias("size")).filter("not open")
    holes = holes.filter(F.col("size") <= most) if most is not None else holes
    return mask.unionByName(pixels(empty.join(holes, "region", "left_semi")))


def near_pairs(a: DataFrame, b: DataFrame, radius: float, places: bool = False) -> DataFrame:
    """Pairs of points of a sample within `radius`: equi-join on buckets of twice that size, each b copied to the 4 that it can reach.
    With `places` also x and y of b. All pairs of a point a come out of one task, so what is summed by a is small."""
    side = 2 * radius
    x, y = F.floor(F.col("x") / side), F.floor(F.col("y") / side)
    left = a.select(F.col("sample"), F.col("cell_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), x.alias("bx"), y.alias("by"))
    reach = radius * (1 + 1e-9)  # also where rounding puts a point across a bucket's border
    ends = lambda c: F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side))
    spread = F.flatten(F.transform(ends("x"), lambda bx: F.transform(ends("y"), lambda by: F.struct(bx.alias("bx"), by.alias("by")))))
    right = b.select("sample", F.col("cell_id").alias("b"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.explode(spread).alias("s")).select("sample", "b", "cx", "cy", "s.bx", "s.by")
    dx, dy = F.col("ax") - F.col("cx"), F.col("ay") - F.col("cy")
    d = F.sqrt(dx * dx + dy * dy)  # rounded as in SQL: hypot would order some near ties otherwise
    return left.join(right, ["sample", "bx", "by"]).withColumn("d", d).filter(F.col("d") <= radius).select("sample", "a", "b", "d", *([F.col("cx").alias("x"), F.col("cy").alias("y")] if places else []))


def nearest(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """The nearest b of each a within `radius`; ties go to the smaller id."""
    return near_pairs(a, b, radius).groupBy("sample", "a").agg(F.min_by("b", F.struct("d", "b")).alias("b"), F.min("d").alias("d"))


def mutual_nearest(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    pairs = near_pairs(a, b, radius)
    first = F.row_number().over(Window.partitionBy("sample", "a").orderBy("d", "b"))
    back = F.row_number().over(Window.partitionBy("sample", "b").orderBy("d", "a"))
    return pairs.withColumn("i", first).withColumn("j", back).filter("i = 1 and j = 1").select("sample", "a", "b", "d")
