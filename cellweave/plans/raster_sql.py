"""The lattice operators as SQL for DuckDB, written from their definitions: disks by copies, floods by recursion, distances by all pairs.

Each function gives common table expressions, of which `name` is the result; masks have the columns sample, iy, ix. `frame` has the sides.
"""

from __future__ import annotations

from cellweave.operators.spatial import offsets, weights


def _disk(name: str, r: int) -> str:
    return f"{name}_disk(dy, dx) AS (VALUES {', '.join(map(str, offsets(r)))})"


def blur(name: str, counts: str, sigma: float) -> str:
    steps = ", ".join(f"({d}, {w!r}::DOUBLE)" for d, w in weights(sigma))
    half = lambda out, src, c, n, keys: f"{out} AS (SELECT sample, {keys}, CASE WHEN m < {n} THEN m ELSE 2 * {n} - 1 - m END AS {c}, sum(n * w) AS n FROM (SELECT s.*, f.{n}, w, (({c} + d) % (2 * {n}) + 2 * {n}) % (2 * {n}) AS m FROM {src} s JOIN frame f USING (sample) CROSS JOIN {name}_w) t GROUP BY ALL)".replace(" GROUP BY ALL)", " GROUP BY 1, 2, 3)")
    return f"{name}_w(d, w) AS (VALUES {steps}), {half(name + '_x', counts, 'ix', 'nx', 'iy')}, {half(name, name + '_x', 'iy', 'ny', 'ix')}"


def dilate(name: str, src: str, r: int, rim: bool = True) -> str:
    """Cut to the lattice, or on a plane without a rim."""
    if not rim:
        return f"{_disk(name, r)}, {name} AS (SELECT DISTINCT sample, iy + dy AS iy, ix + dx AS ix FROM {src} CROSS JOIN {name}_disk)"
    return f"{_disk(name, r)}, {name} AS (SELECT DISTINCT s.sample, s.iy + dy AS iy, s.ix + dx AS ix FROM {src} s CROSS JOIN {name}_disk JOIN frame f ON f.sample = s.sample AND s.iy + dy BETWEEN 0 AND f.ny - 1 AND s.ix + dx BETWEEN 0 AND f.nx - 1)"


def erode(name: str, src: str, r: int) -> str:
    return f"{_disk(name, r)}, {name} AS (SELECT sample, iy, ix FROM (SELECT s.sample, s.iy + dy AS iy, s.ix + dx AS ix FROM {src} s CROSS JOIN {name}_disk) t GROUP BY 1, 2, 3 HAVING count(*) = {len(offsets(r))})"


def closed(name: str, src: str, r: int, rim: bool = True) -> str:
    """With a rim beyond which all is background, or on a plane without one, then cut to the lattice."""
    if rim:
        return f"{dilate(name + '_d', src, r)}, {erode(name, name + '_d', r)}"
    return f"{dilate(name + '_d', src, r, False)}, {erode(name + '_c', name + '_d', r)}, {name} AS (SELECT c.sample, iy, ix FROM {name}_c c JOIN frame f ON f.sample = c.sample AND iy BETWEEN 0 AND ny - 1 AND ix BETWEEN 0 AND nx - 1)"


def opened(name: str, src: str, r: int) -> str:
    return f"{erode(name + '_e', src, r)}, {dilate(name, name + '_e', r)}"


def grid(src: str) -> str:
    """The lattices of the sections that have rows in src."""
    return f"(SELECT sample, iy, unnest(range(0, nx)) AS ix FROM (SELECT sample, nx, unnest(range(0, ny)) AS iy FROM frame WHERE sample IN (SELECT sample FROM {src})) r)"


def parts(name: str, src: str, eight: bool = False) -> str:
    """src with `part`, the smallest pixel number of the component; by runs, whose links are closed by recursion."""
    reach = 1 if eight else 0
    number = "sample * 1099511627776 + iy * 1048576"
    return f"""{name}_r AS (SELECT sample, iy, min(ix) AS x0, max(ix) AS x1, min({number} + ix) AS node FROM (SELECT *, ix - row_number() OVER (PARTITION BY sample, iy ORDER BY ix) AS k FROM {src}) t GROUP BY sample, iy, k),
      {name}_e AS (SELECT a.node AS a, b.node AS b FROM {name}_r a JOIN {name}_r b ON a.sample = b.sample AND abs(a.iy - b.iy) = 1 AND a.x0 <= b.x1 + {reach} AND b.x0 <= a.x1 + {reach}),
      {name}_c AS (SELECT node AS a, node AS b FROM {name}_r UNION SELECT c.a, e.b FROM {name}_c c JOIN {name}_e e ON c.b = e.a),
      {name} AS (SELECT sample, iy, unnest(range(x0, x1 + 1)) AS ix, part FROM (SELECT r.*, l.part FROM {name}_r r JOIN (SELECT a, min(b) AS part FROM {name}_c GROUP BY a) l ON l.a = r.node) t)"""


def large(name: str, src: str, least: int) -> str:
    return f"{parts(name + '_p', src)}, {name} AS (SELECT sample, iy, ix, part, size FROM (SELECT *, count(*) OVER (PARTITION BY part) AS size FROM {name}_p) t WHERE size >= {least})"


def filled(name: str, src: str, most: int | None = None) -> str:
    """src and its holes: what a flood from the border through the background does not reach, of at most `most` pixels."""
    size = "" if most is None else f" WHERE size <= {most}"
    return f"""{name}_b AS (SELECT g.*, iy = 0 OR iy = ny - 1 OR ix = 0 OR ix = nx - 1 AS edge FROM {grid(src)} g JOIN frame USING (sample) ANTI JOIN {src} s USING (sample, iy, ix)),
      {name}_o AS (SELECT sample, iy, ix FROM {name}_b WHERE edge UNION SELECT b.sample, b.iy, b.ix FROM {name}_o o CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx) JOIN {name}_b b ON b.sample = o.sample AND b.iy = o.iy + dy AND b.ix = o.ix + dx),
      {name}_h AS (SELECT sample, iy, ix FROM {name}_b b ANTI JOIN {name}_o o USING (sample, iy, ix)), {large(name + '_s', name + '_h', 1)},
      {name} AS (SELECT sample, iy, ix FROM {src} UNION ALL SELECT sample, iy, ix FROM {name}_s{size})"""


def nearest(name: str, at: str, src: str) -> str:
    """For each pixel of `at` the squared distance d2 to the nearest pixel of src, and that pixel, of equally near ones the first."""
    return f"{name} AS (SELECT sample, iy, ix, k >> 42 AS d2, (k >> 21) & 2097151 AS jy, k & 2097151 AS jx FROM (SELECT a.sample, a.iy, a.ix, min((((a.iy - s.iy) * (a.iy - s.iy) + (a.ix - s.ix) * (a.ix - s.ix)) << 42) + (s.iy << 21) + s.ix) AS k FROM {at} a JOIN {src} s ON a.sample = s.sample GROUP BY 1, 2, 3) t)"
