"""Stitched evaluation, polygon weight maps and stratified folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import _cut
from .spatial import KEY


def hann(at: Column, side: int, floor: float) -> Column:
    return F.greatest(F.lit(floor), 0.5 - 0.5 * F.cos(2 * np.pi * (at + 1) / (side + 1)))


def overlap_add(tiles: DataFrame, side: int, floor: float = 0.05) -> DataFrame:
    """tiles(sample, y0, x0, iy, ix, p): each pixel's mean of the tiles over it, weighted by a Hann window of that side."""
    t = tiles.withColumn("w", hann(F.col("iy") - F.col("y0"), side, floor) * hann(F.col("ix") - F.col("x0"), side, floor))
    return t.groupBy(*KEY).agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("p"))


def threshold_choice(truth: DataFrame, stitched: DataFrame, steps: int = 20) -> DataFrame:
    """One row: the threshold k / steps (0 < k < steps) of the best Dice, a sample's Dice averaged within its patient and the
    patients' means averaged; ties go to the nearest to 0.5, then the lower. n_uncovered counts truth pixels without a prediction, which
    count as negatives. truth(sample, patient, iy, ix, y): each pixel is counted in its bin first, so the sweep costs
    samples times steps. A sample without positives of either kind has a Dice of 1."""
    at = truth.join(stitched, KEY, "left")
    k = F.least(F.lit(steps - 1), F.coalesce(F.floor(F.round("p", 9) * steps), F.lit(0))).cast("int")
    bins = at.groupBy("sample", "patient", k.alias("k")).agg(F.sum("y").alias("pos"), F.count("*").alias("n"), F.count_if(F.col("p").isNull()).alias("gap"))
    every = bins.groupBy("sample", "patient").agg(F.sum("pos").alias("all"), F.sum("gap").alias("gap")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(steps - 1))))
    low = bins.groupBy("sample", "patient").agg(F.collect_list(F.struct("k", "pos", "n")).alias("bins"))
    over = lambda c: F.aggregate(F.filter("bins", lambda b: b.k >= F.col("k")), F.lit(0).cast("long"), lambda s, b: s + b[c])
    d = every.join(low, ["sample", "patient"]).withColumn("tp", over("pos")).withColumn("called", over("n"))
    dice = F.when(F.col("called") + F.col("all") == 0, 1.0).otherwise(2.0 * F.col("tp") / (F.col("called") + F.col("all")))
    patients = d.groupBy("k", "patient").agg(F.avg(dice).alias("dice"), F.sum("gap").alias("gap"))
    means = patients.groupBy("k").agg(F.round(F.avg("dice"), 8).alias("dice"), F.sum("gap").alias("n_uncovered"))
    best = means.orderBy(F.desc("dice"), F.abs(2 * F.col("k") - steps), "k").limit(1)
    return best.select((F.col("k") / steps).alias("threshold"), "dice", "n_uncovered")


def rasterised(ring_list, side: int) -> np.ndarray:
    """Pixels whose centre is inside a ring by the even-odd rule; the rings of a polygon are joined."""
    out = np.zeros((side, side), bool)
    c = np.arange(side) + 0.5
    for ring in ring_list:
        own = np.zeros((side, side), bool)
        p = np.array([(q["x"], q["y"]) for q in ring], float).reshape(-1, 2)
        for (x0, y0), (x1, y1) in zip(p, np.roll(p, -1, axis=0), strict=True):
            if y0 != y1:
                rows = (y0 > c) != (y1 > c)
                own[rows] ^= c[None, :] < ((x1 - x0) * (c[rows] - y0) / (y1 - y0) + x0)[:, None]
        out |= own
    return out


def weight_maps(polygons: DataFrame, side: int = 224, patch: int = 14, sigma: float = 8.0, steps: int = 255) -> DataFrame:
    """polygons(cell_id, rings: array<array<struct<x, y>>>, in pixels of the crop): area in pixels, the number of patches at least half
    covered, and the blurred mask's mean on each patch, quantised to 0..steps by rows. Outside the crop is empty. Null or
    empty rings give an area of 0. Arrow batches; a polygon is worked on alone."""
    r = int(round(3.0 * sigma))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    grid = side // patch

    def blurred(a: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            a = np.apply_along_axis(np.convolve, axis, a, w)
            a = np.take(a, np.arange(r, r + side), axis=axis)
        return a

    def pooled(a: np.ndarray) -> np.ndarray:
        return a.reshape(grid, patch, grid, patch).mean(axis=(1, 3))

    def run(batches):
        for pdf in batches:
            rows = []
            for cell, rings in zip(pdf.cell_id, pdf.rings, strict=True):
                mask = rasterised([] if rings is None else rings, side).astype(float)
                q = np.rint(np.clip(pooled(blurred(mask)), 0, 1) * steps).astype(int) if mask.any() else np.zeros((grid, grid), int)
                rows.append((cell, int(mask.sum()), int((pooled(mask) >= 0.5).sum()), q.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["cell_id", "area", "n_half", "weights"])

    return polygons.select("cell_id", "rings").mapInPandas(run, "cell_id long, area long, n_half long, weights array<int>")


def stratified_folds(groups: DataFrame, folds: int) -> DataFrame:
    """groups(group, class, n): whole groups dealt so that every class is spread evenly. The most uneven group goes first, each to
    the fold that leaves the smallest sum over classes of squared shares; ties to the fold with fewer rows, then by number. The
    table has one row for each group and class (patients, not rows of data)."""

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.pivot_table(index="group", columns="class", values="n", aggfunc="sum", fill_value=0).sort_index()
        share = t.to_numpy(float) / np.maximum(t.to_numpy(float).sum(axis=0), 1)
        load, size, out = np.zeros((folds, share.shape[1])), np.zeros(folds), []
        for i in np.lexsort([np.arange(len(t)), -t.to_numpy().sum(axis=1), -share.std(axis=1)]):
            cost = ((load + share[i]) ** 2 - load**2).sum(axis=1)
            best = min(range(folds), key=lambda k: (round(cost[k], 12), size[k], k))
            load[best] += share[i]
            size[best] += t.iloc[i].sum()
            out.append((t.index[i], best))
        return pd.DataFrame(out, columns=["group", "fold"])

    return groups.groupBy().applyInPandas(deal, "group long, fold long")


def load_folds(groups: DataFrame, folds: int) -> DataFrame:
    """groups(sample, group, n): within each sample (a cancer) groups by falling n, then id, each to the fold with the fewest rows so
    far (ties by number). One row for each group reaches a task, never its rows."""

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        load, out = [0] * folds, []
        for r in pdf.sort_values(["n", "group"], ascending=[False, True]).itertuples():
            k = load.index(min(load))
            load[k] += r.n
            out.append((r.sample, r.group, r.n, k))
        return pd.DataFrame(out, columns=["sample", "group", "n", "fold"])

    return groups.groupBy("sample").applyInPandas(deal, "sample long, group long, n long, fold long")


def spread_anchors(candidates: DataFrame, square: float = 600.0, first: float = 600.0, last: float = 200.0, step: float = 100.0, wanted: int = 12) -> DataFrame:
    """candidates(sample, id, x, y, score): the best of each square, then others by falling score that keep `first` apart from all
    chosen, until `wanted` are; when none is left at a distance it is lowered by `step`, down to `last`. Squares are ranked in Spark;
    a task holds the candidates of one section."""
    rank = F.row_number().over(Window.partitionBy("sample", F.floor(F.col("x") / square), F.floor(F.col("y") / square)).orderBy(F.desc("score"), "id"))
    ranked = candidates.select("sample", "id", "x", "y", "score", (rank == 1).alias("best"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        p, chosen, apart = own[["x", "y"]].to_numpy(float), own.index[own.best].tolist(), first
        if len(chosen) >= wanted:  # no other can be chosen
            return own[own.best][["sample", "id", "x", "y", "score", "best"]]
        gap = np.full(len(p), np.inf)
        for i in chosen:
            gap = np.minimum(gap, np.hypot(*(p - p[i]).T))
        while apart >= last:
            for i in range(len(p)):
                if len(chosen) < wanted and gap[i] >= apart:
                    chosen.append(i)
                    gap = np.minimum(gap, np.hypot(*(p - p[i]).T))
            apart -= step
        return own.iloc[sorted(chosen)][["sample", "id", "x", "y", "score", "best"]]

    return ranked.groupBy("sample").applyInPandas(choose, "sample long, id long, x double, y double, score double, best boolean")


#: The steps tried along one coordinate, in this order.
STEPS = (-0.5, -0.3, -0.15, -0.07, 0.07, 0.15, 0.3, 0.5)


def macro_f1(confusion: np.ndarray, scored: int) -> float:
    """Mean F1 of the first `scored` classes of confusion[truth, predicted]; 0 for a class that never occurs on either side."""
    tp, both = np.diag(confusion), confusion.sum(0) + confusion.sum(1)
    return float(np.mean(np.where(both > 0, 2 * tp / np.maximum(both, 1), 0.0)[:scored]))


def class_offsets(scores: DataFrame, classes: int, scored: int | None = None, rounds: int = 20) -> tuple[list[float], float]:
    """Offsets of the log scores by coordinate ascent on the macro F1 of their argmax (ties to the first class), and that F1. scores(y, lf): class and array of `classes` numbers.

    All steps along a coordinate are judged from one aggregation: by truth, by the best of the other classes, and by the first
    step that is enough for this one to win. So a round reads the rows once for each class and brings classes² x steps counts to the driver.
    """
    scored = classes if scored is None else scored
    order = sorted(STEPS)
    rows = _cut(scores.select(F.col("y").cast("int").alias("y"), "lf"))
    offsets = [0.0] * classes

    def table(c: int) -> np.ndarray:
        """counts[truth, other, k]: rows of which the steps order[k:] let class c win; k = len(order) for none."""
        score = lambda j: F.col("lf")[j] + F.lit(offsets[j])
        others = F.array(*[F.struct(score(j).alias("s"), F.lit(-j).alias("j")) for j in range(classes) if j != c])
        best = F.array_max(others)
        wins = lambda d: (score(c) + F.lit(d) > best["s"]) | ((score(c) + F.lit(d) == best["s"]) & (F.lit(c) < -best["j"]))
        with_zero = sorted([*order, 0.0])
        k = F.lit(len(with_zero))
        for i in reversed(range(len(with_zero))):
            k = F.when(wins(with_zero[i]), i).otherwise(k)
        out = np.zeros((classes, classes, len(with_zero) + 1))
        for r in rows.groupBy("y", (-best["j"]).alias("o"), k.alias("k")).agg(F.count("*").alias("n")).collect():
            out[r.y, r.o, r.k] = r.n
        return out

    def judged(counts: np.ndarray, c: int, d: float) -> float:
        at = sorted([*order, 0.0]).index(d) + 1
        confusion = counts[:, :, at:].sum(2)
        confusion[:, c] += counts[:, :, :at].sum((1, 2))
        return macro_f1(confusion, scored)

    now = None
    for _ in range(rounds):
        better = False
        for c in range(classes):
            counts = table(c)
            now = judged(counts, c, 0.0) if now is None else now
            gains = [(judged(counts, c, d), d) for d in STEPS]
            f, d = max(gains, key=lambda g: g[0])  # the first of equal ones
            if f > now:
                offsets[c], now, better = offsets[c] + d, f, True
        if not better:
            break
    return offsets, now or 0.0
