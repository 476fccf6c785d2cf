"""Components of points that lie close together, tile by tile: a task links the points of its tiles, and only points that several tiles
share go through the rounds of `graph.components`. Pairs of points are never rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import AT_ONCE, _cut, components, merged

#: A tile's side in links; a point is copied to the tiles that reach a link to its left or below.
TILE = 16
#: Squares of a link's two thirds: points in one are always linked, and a link ends at most two squares away.
PARTS = 1.5
AHEAD = [(dy, dx) for dy in range(3) for dx in range(-2, 3) if dy or dx > 0]
#: Pairs of points looked at in one piece.
BLOCK = 1 << 22


def _within(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Distances are rounded as SQL rounds them."""
    return np.sqrt((x[p] - x[q]) * (x[p] - x[q]) + (y[p] - y[q]) * (y[p] - y[q])) <= link


def _any_within(x: np.ndarray, y: np.ndarray, start: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Whether squares i and j, of n points from `start` on, hold a pair within `link`, BLOCK pairs at a time."""
    out = np.zeros(len(i), bool)
    total = n[i] * n[j]
    wide = total > BLOCK
    for k in np.flatnonzero(wide):
        q = np.arange(start[j[k]], start[j[k]] + n[j[k]])
        for p in np.array_split(np.arange(start[i[k]], start[i[k]] + n[i[k]]), total[k] // BLOCK + 1):
            if _within(x, y, p[:, None], q[None, :], link[k]).any():
                out[k] = True
                break
    few = np.flatnonzero(~wide)
    for part in np.split(few, np.flatnonzero(np.diff(np.cumsum(total[few]) // BLOCK)) + 1):
        if len(part):
            m = total[part]
            at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            other = np.repeat(n[j[part]], m)
            near = _within(x, y, np.repeat(start[i[part]], m) + at // other, np.repeat(start[j[part]], m) + at % other, np.repeat(link[part], m))
            out[part] = np.logical_or.reduceat(near, np.cumsum(m) - m)
    return out


def squares(tile: np.ndarray, x: np.ndarray, y: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each point's square of its tile, so that a step down is `wide` more and one to the right 1 more; and `wide`."""
    cy, cx = (np.floor(v / side).astype(np.int64) for v in (y, x))
    corner = np.zeros(int(tile.max()) + 1, np.int64)
    for c in (cy, cx):
        corner[:] = np.iinfo(np.int64).max
        np.minimum.at(corner, tile, c)
        c -= corner[tile] - 2
    wide, high = int(cx.max()) + 3, int(cy.max()) + 3
    return (tile * high + cy) * wide + cx, wide


def near(tile: np.ndarray, x: np.ndarray, y: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs p < q of points of a tile within its link, and their distances, by p and q; BLOCK candidates at a time."""
    key, wide = squares(tile, x, y, link * (1 + 1e-9))
    order = np.argsort(key, kind="stable")
    k = key[order]
    out = []
    for first, last in ((np.arange(1, len(k) + 1), np.searchsorted(k, k + 1, "right")), (np.searchsorted(k, k + wide - 1), np.searchsorted(k, k + wide + 1, "right"))):
        n = np.maximum(last - first, 0)
        for part in np.split(np.arange(len(k)), np.flatnonzero(np.diff(np.cumsum(n) // BLOCK)) + 1):
            m = n[part]
            p = order[np.repeat(part, m)]
            q = order[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m - first[part], m)]
            d = np.sqrt((x[p] - x[q]) * (x[p] - x[q]) + (y[p] - y[q]) * (y[p] - y[q]))
            keep = d <= link[p]
            out.append((np.minimum(p, q)[keep], np.maximum(p, q)[keep], d[keep]))
    p, q, d = (np.concatenate([o[c] for o in out]) for c in range(3))
    order = np.lexsort((q, p))
    return p[order], q[order], d[order]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of rows sorted by `keys`: tables of whole groups, each of at least `most` rows but the last, and the number of each row's group in it."""
    held: list[pa.RecordBatch] = []

    def numbered(t: pa.Table) -> np.ndarray:
        differs = np.zeros(len(t), bool)
        for c in keys:
            column = t.column(c).combine_chunks()
            for part in column.flatten() if pa.types.is_struct(column.type) else [column]:
                codes = part.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                differs[1:] |= codes[1:] != codes[:-1]
        return np.cumsum(differs)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            t = pa.Table.from_batches(held)
            group = numbered(t)
            if end := int(np.searchsorted(group, group[-1])):
                yield t.slice(0, end), group[:end]
            held = t.slice(end).combine_chunks().to_batches()
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield t, numbered(t)


def linked(tile: np.ndarray, x: np.ndarray, y: np.ndarray, link: np.ndarray) -> np.ndarray:
    """For each point the number of its component among the points of its tile (numbered by tile) that chains of links reach;
    a tile's points have one link.

    Points of a square are one; two squares are linked if their outermost points are, and of those that are still apart all points are compared.
    """
    key, wide = squares(tile, x, y, link / PARTS)
    order = np.lexsort((y, x, key))
    k, px, py = key[order], x[order], y[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (px[1:] != px[:-1]) | (py[1:] != py[:-1])
    square = np.empty(len(k), np.int64)  # of each point
    names, square[order] = np.unique(k, return_inverse=True)
    k, px, py, pl = k[fresh], px[fresh], py[fresh], link[order][fresh]  # each place once
    start = np.searchsorted(k, names)
    n = np.diff(np.append(start, len(k)))
    reach = pl[start]
    where = np.repeat(np.arange(len(names)), n)
    low, top = ([f.reduceat(v, start) for v in (py, px)] for f in (np.minimum, np.maximum))
    outermost = lambda v, edge: np.minimum.reduceat(np.where(v == edge[where], np.arange(len(v)), len(v)), start)
    least, most = ([outermost(v, e) for v, e in zip((py, px), side, strict=True)] for side in (low, top))
    i, j, sure = [], [], []
    for dy, dx in AHEAD:
        to = np.searchsorted(names, names + dy * wide + dx)
        a = np.flatnonzero(names[np.minimum(to, len(names) - 1)] == names + dy * wide + dx)
        b = to[a]
        gap = [np.maximum(np.maximum(low[c][a] - top[c][b], low[c][b] - top[c][a]), 0) for c in (0, 1)]
        may = np.sqrt(gap[1] * gap[1] + gap[0] * gap[0]) <= reach[a]
        a, b = a[may], b[may]
        hit = np.zeros(len(a), bool)
        for p in [most[0]] * (dy > 0) + [most[1]] * (dx > 0) + [least[1]] * (dx < 0):
            for q in [least[0]] * (dy > 0) + [least[1]] * (dx > 0) + [most[1]] * (dx < 0):
                hit |= _within(px, py, p[a], q[b], reach[a])
        i.append(a)
        j.append(b)
        sure.append(hit)
    i, j, sure = (np.concatenate(v) for v in (i, j, sure))
    label = merged(len(names), i[sure], j[sure])
    left = np.flatnonzero(label[i] != label[j])
    left = left[_any_within(px, py, start, n, i[left], j[left], reach[i[left]])]
    return merged(len(names), np.append(i[sure], i[left]), np.append(j[sure], j[left]))[square]


def linkage(points: DataFrame, radius: float | None = None) -> DataFrame:
    """node and component (its smallest node) of points(sample, cell_id, x, y): the graph that links points of a sample within `radius`, or
    within the sample's own `link`, a column, without it. cell_ids are unique over samples; a point without a finite place stands alone.

    A tile's points are in one task, AT_ONCE or one tile at a time; the rest of the work is on tiles' components that share points.
    """
    link = F.lit(float(radius)) if radius is not None else F.col("link").cast("double")
    finite = F.coalesce((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.lit(False)) & (link > 0)
    placed = points.select("sample", F.col("cell_id").cast("long").alias("node"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), link.alias("link"), finite.alias("finite"))
    side = F.col("link") * TILE
    tiles = lambda c: F.when(F.col("finite"), F.sequence(F.floor((F.col(c) - F.col("link") * (1 + 1e-9)) / side), F.floor(F.col(c) / side))).otherwise(F.array(F.lit(0).cast("long")))
    spread = placed.withColumn("tx", tiles("x")).withColumn("ty", tiles("y")).withColumn("shared", F.size("tx") * F.size("ty") > 1)
    spread = spread.select("sample", "node", "x", "y", "link", "finite", "shared", F.explode("tx").alias("tx"), "ty").withColumn("ty", F.explode("ty"))

    order = ["sample", "tx", "ty"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, tile in whole_groups(batches, order, AT_ONCE):
            node = t.column("node").to_numpy()
            finite = np.flatnonzero(t.column("finite").to_numpy())
            root = node.copy()
            if len(finite):
                x, y, link = (t.column(c).to_numpy()[finite] for c in ("x", "y", "link"))
                name, of = np.unique(linked(np.unique(tile[finite], return_inverse=True)[1], x, y, link), return_inverse=True)
                lowest = np.full(len(name), np.iinfo(np.int64).max)
                np.minimum.at(lowest, of, node[finite])
                root[finite] = lowest[of]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), t.column("shared").combine_chunks()], ["node", "root", "shared"])

    dealt = spread.repartition(*order).sortWithinPartitions(*order)
    rooted = _cut(dealt.mapInArrow(run, "node long, root long, shared boolean"))
    meet = rooted.filter("shared").groupBy("node").agg(F.collect_set("root").alias("roots"), F.min("root").alias("a"))
    edges = _cut(meet.select("a", F.explode("roots").alias("b")).filter("a <> b").distinct())
    own = rooted.filter("not shared").select("node", "root").unionByName(meet.select("node", F.col("a").alias("root")))
    joined = components(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), edges).select(F.col("node").alias("root"), "component")
    return own.join(joined, "root", "left").select("node", F.coalesce("component", "root").alias("component"))
