"""Relational, aggregate, window, metric and scalar operators as SQL that both engines read.

`ID_slug: sql`, or (spark sql, oracle sql) where the dialects differ. Spark's percentile is quantile_cont in the oracle.
"""

from __future__ import annotations

CELLS = "cells AS (SELECT event_id AS cell_id, value AS x, CAST(user_id AS DOUBLE) AS y, event_type AS cell_type, CAST(day(ts) AS BIGINT) AS sample FROM events)"
SCORES = """scores AS (SELECT l.doc_id, l.quality AS y, d.source AS patient, d.lang AS cancer, (d.n_chars % 997) / 997.0 AS p
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
BINNED = "g AS (SELECT p, CAST(floor(p * 1024) AS BIGINT) AS bin, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM scores GROUP BY p), bins AS (SELECT bin, sum(pos) AS pos, sum(neg) AS neg FROM g GROUP BY bin)"
PRED = "pred AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS yhat FROM scores)"
#: z ~ c + ax x + ay y by least squares for each sample, from centred moments; a sample whose points lie on one line has no plane.
PLANE = """v AS (SELECT sample, x, y, CAST(cell_id % 97 AS DOUBLE) AS z FROM cells), moments AS (SELECT sample, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM v GROUP BY sample),
  slopes AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS ax, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS ay FROM moments WHERE xx * yy - xy * xy > 0.000000001 * xx * yy), plane AS (SELECT sample, mz, ax, ay, mz - ax * mx - ay * my AS c FROM slopes)"""

SQL: dict[str, str | tuple[str, str]] = {
    # projections, filters, predicates
    "p1_prefix_class": "SELECT event_id, CASE WHEN event_type LIKE 'p%' THEN 1 ELSE 0 END AS is_tumor FROM events",
    "p2_class_mapping": "SELECT event_id, CASE WHEN event_type IN ('error') THEN 'X' WHEN event_type IN ('purchase', 'error') THEN 'T' WHEN event_type IN ('view', 'click') THEN 'B' ELSE 'O' END AS class FROM events",
    "p3_suffix_strip": "SELECT page_id, CASE WHEN url LIKE '%/index.html' THEN substr(url, 1, length(url) - 11) WHEN url LIKE '%.html' THEN substr(url, 1, length(url) - 5) ELSE url END AS stem FROM pages",
    "p4_rejection_union": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, NOT (coalesce(l_discount > 0.08, false) OR coalesce(l_tax > 0.06, false) OR coalesce(l_quantity < 5, false)) AS keep FROM lineitem",
    "p5_exclusive_counts": """WITH r AS (SELECT l_discount > 0.08 AS a, l_tax > 0.06 AS b, l_quantity < 5 AS c FROM lineitem)
      SELECT count_if(a) AS n_a, count_if(b) AS n_b, count_if(c) AS n_c, count_if(a AND NOT (b OR c)) AS only_a, count_if(b AND NOT (a OR c)) AS only_b, count_if(c AND NOT (a OR b)) AS only_c FROM r""",
    "p6_exclusion_causes": """SELECT concat_ws(';', CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_tax > 0.06 THEN 'tax' END, CASE WHEN l_quantity < 5 THEN 'small' END) AS causes, count(*) AS n
      FROM lineitem GROUP BY 1""",
    "p7_status_cascade": "SELECT o_orderkey, CASE WHEN o_totalprice < 5000 THEN 'too_small' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderpriority LIKE '5%' THEN 'low' ELSE 'pass' END AS status FROM orders",
    "p8_quadrants": "SELECT s_suppkey, CASE WHEN s_acctbal >= 4000 AND s_nationkey >= 12 THEN 'both' WHEN s_acctbal >= 4000 THEN 'b_only' WHEN s_nationkey >= 12 THEN 'dc_only' ELSE 'neither' END AS state FROM supplier",
    "p9_zone_majority": f"""WITH {CELLS}, f AS (SELECT sample, count(*) AS n, avg(CASE WHEN x < 150 THEN 1.0 ELSE 0.0 END) AS intra, avg(CASE WHEN x >= 150 AND x < 300 THEN 1.0 ELSE 0.0 END) AS peri, avg(CASE WHEN x >= 300 THEN 1.0 ELSE 0.0 END) AS distant FROM cells GROUP BY sample)
      SELECT sample, n, CASE WHEN n = 0 THEN 'mixed' WHEN intra >= 0.5 THEN 'intra' WHEN peri >= 0.5 THEN 'peri' WHEN distant >= 0.8 THEN 'distant' WHEN intra + peri >= 0.7 THEN 'peri' ELSE 'mixed' END AS zone FROM f""",
    "p10_three_way_label": "SELECT l_orderkey, round(hundredths / 100.0, 6) AS frac, CASE WHEN hundredths IS NULL OR n < 2 THEN -1 WHEN hundredths >= 6 THEN 1 WHEN hundredths <= 3 THEN 0 ELSE -1 END AS label FROM (SELECT l_orderkey, count(*) AS n, avg(round(l_discount * 100)) AS hundredths FROM lineitem GROUP BY l_orderkey) t",
    "p11_quality_gates": "SELECT c_custkey, (c_acctbal IS NOT NULL AND c_acctbal < 0) AS drop_flat, coalesce(c_acctbal > 9000, false) AS drop_blur, NOT (coalesce(c_acctbal < 0, false) OR coalesce(c_acctbal > 9000, false)) AS keep FROM customer",
    "p12_distance_band": "SELECT event_id, CASE WHEN value - 100 <= 0 THEN 'inside' WHEN value - 100 <= 50 THEN '0-50' WHEN value - 100 <= 100 THEN '50-100' ELSE '>100' END AS band FROM events",
    "p13_rectangle_assignment": f"""WITH {CELLS}, rect AS (SELECT * FROM (VALUES (1, 0.0, 200.0, 0.0, 80.0), (2, 100.0, 300.0, 40.0, 120.0), (3, 250.0, 400.0, 0.0, 150.0)) AS t(k, x0, x1, y0, y1))
      SELECT c.cell_id, max(r.k) AS block FROM cells c LEFT JOIN rect r ON c.x >= r.x0 AND c.x < r.x1 AND c.y >= r.y0 AND c.y < r.y1 GROUP BY c.cell_id""",
    "p14_block_model": f"""WITH {CELLS}, model AS (SELECT * FROM (VALUES ('click', 1.5, 0.0, 0.0), ('view', 0.5, 0.01, -0.02)) AS t(block, c, ax, ay))
      SELECT cell_id, CAST(round(CAST(m.c AS DOUBLE) + CAST(m.ax AS DOUBLE) * x + CAST(m.ay AS DOUBLE) * y, 6) AS DOUBLE) AS dx, m.block IS NOT NULL AS has_model FROM cells LEFT JOIN model m ON cell_type = m.block""",
    "p15_affine_pixels": f"WITH {CELLS} SELECT cell_id, round((x + 1.5) / CAST(0.2125 AS DOUBLE), 4) AS px, round((y - 0.5) / CAST(0.2125 AS DOUBLE), 4) AS py FROM cells",
    "p16_audit_flags": "SELECT o_orderkey, o_totalprice IS NULL AS flag_missing, coalesce(abs(o_totalprice - 250000) > 200000, false) AS flag_far, coalesce(o_totalprice < 10000, false) AS flag_small FROM orders",
    "p17_region_number": "SELECT c_custkey, CAST(regexp_extract(c_name, '#0*([0-9]+)', 1) AS BIGINT) AS number FROM customer",
    "p18_patient_key": "SELECT page_id, CASE WHEN url LIKE 'https:%' THEN 's' ELSE 'p' END || regexp_extract(url, '//(www|m|blog)?[.]?([a-z]+)', 2) AS patient FROM pages",
    "p19_vocabulary_check": "SELECT count(*) AS unknown FROM events e LEFT ANTI JOIN (SELECT * FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) AS t(label)) v ON e.event_type = v.label",
    # joins
    "j1_inner": "SELECT o.o_orderkey, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "j2_left_default": "SELECT c.c_custkey, coalesce(sum(CAST(o.o_totalprice AS DECIMAL(18, 2))), 0) AS total, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey".replace("coalesce(sum(CAST(o.o_totalprice AS DECIMAL(18, 2))), 0) AS total", "CAST(coalesce(sum(CAST(o.o_totalprice AS DECIMAL(18, 2))), 0) AS DOUBLE) AS total"),
    "j3_one_to_one_audit": """SELECT count_if(a.k IS NULL) AS only_right, count_if(b.k IS NULL) AS only_left, count_if(a.k IS NOT NULL AND b.k IS NOT NULL) AS both
      FROM (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0) a FULL OUTER JOIN (SELECT c_custkey AS k FROM customer WHERE c_nationkey < 15) b ON a.k = b.k""",
    "j4_many_to_one": "SELECT l.l_suppkey, n.n_name, count(*) AS n FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY l.l_suppkey, n.n_name",
    "j5_multi_key": "SELECT a.o_custkey, a.o_orderstatus, count(*) AS pairs FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus WHERE a.o_orderkey < b.o_orderkey GROUP BY a.o_custkey, a.o_orderstatus",
    "j6_three_way": "SELECT r.r_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name",
    "j7_map_join": "SELECT c.c_custkey, m.code FROM customer c LEFT JOIN (SELECT * FROM (VALUES ('BUILDING', 1), ('MACHINERY', 2)) AS t(seg, code)) m ON c.c_mktsegment = m.seg",
    "j8_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "j9_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "j10_first_missing": """WITH k AS (SELECT c_custkey AS k FROM customer), a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 300000)
      SELECT CASE WHEN a.k IS NULL THEN 'no_pending' WHEN b.k IS NULL THEN 'no_large' ELSE 'kept' END AS outcome, count(*) AS n FROM k LEFT JOIN a ON k.k = a.k LEFT JOIN b ON k.k = b.k GROUP BY 1""",
    "j11_point_lookup": f"""WITH {CELLS}, g AS (SELECT sample, floor(y / 10) AS iy, floor(x / 10) AS ix, count(*) AS n FROM cells WHERE cell_type = 'error' GROUP BY 1, 2, 3)
      SELECT c.cell_id, coalesce(g.n, 0) AS region_n FROM cells c LEFT JOIN g ON c.sample = g.sample AND floor(c.y / 10) = g.iy AND floor(c.x / 10) = g.ix""",
    "j17_adjacent_keys": "SELECT z, nz FROM (SELECT z, lead(z) OVER (ORDER BY z) AS nz FROM (SELECT DISTINCT CAST(day(ts) AS BIGINT) AS z FROM events) t) u WHERE nz - z <= 3",
    "j20_best_overlap": """WITH m AS (SELECT l_suppkey AS a, l_partkey % 50 AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT a, sum(n) AS size FROM m GROUP BY a), r AS (SELECT m.a, m.b, CAST(m.n AS DOUBLE) / t.size AS frac, row_number() OVER (PARTITION BY m.a ORDER BY m.n DESC, m.b) AS k FROM m JOIN t ON m.a = t.a)
      SELECT a, b, round(frac, 8) AS frac FROM r WHERE k = 1""",
    "j22_ring_neighbours": f"""WITH {CELLS}, t AS (SELECT DISTINCT sample, CAST(floor(y / 10) AS BIGINT) AS iy, CAST(floor(x / 10) AS BIGINT) AS ix FROM cells), o AS (SELECT CAST(a.d AS BIGINT) AS dy, CAST(b.d AS BIGINT) AS dx FROM (VALUES (-2), (-1), (0), (1), (2)) AS a(d) CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) AS b(d) WHERE a.d <> 0 OR b.d <> 0)
      SELECT t.sample, t.iy, t.ix, o.dy, o.dx, coalesce(u.iy * 1000 + u.ix, -1) AS neighbour FROM t CROSS JOIN o LEFT JOIN t u ON u.sample = t.sample AND u.iy = t.iy + o.dy AND u.ix = t.ix + o.dx""",
    # aggregations
    "a1_value_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "a2_composition": f"WITH {CELLS} SELECT sample, count(*) AS n, round(avg(CASE WHEN cell_type = 'click' THEN 1.0 ELSE 0.0 END), 4) AS frac_click, round(avg(CASE WHEN cell_type = 'error' THEN 1.0 ELSE 0.0 END), 4) AS frac_error, round(avg(CASE WHEN cell_type = 'view' THEN 1.0 ELSE 0.0 END), 4) AS frac_view FROM cells GROUP BY sample".replace("1.0 ELSE 0.0", "CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE)"),
    "a3_composition_long": f"WITH {CELLS} SELECT sample, cell_type, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY sample), 8) AS share FROM cells GROUP BY sample, cell_type",
    "a4_distinct_guard": "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1",
    "a5_histogram_2d": f"WITH {CELLS} SELECT sample, CAST(greatest(0, least(14, floor(y / 10))) AS BIGINT) AS iy, CAST(greatest(0, least(49, floor(x / 10))) AS BIGINT) AS ix, count(*) AS n FROM cells GROUP BY 1, 2, 3",
    "a6_segment_mean": "SELECT l_orderkey, round(avg(l_quantity), 8) AS cx, round(avg(l_extendedprice), 6) AS cy FROM lineitem GROUP BY l_orderkey",
    "a7_weak_fraction": "SELECT o_custkey, count(*) AS n, CAST(count_if(o_totalprice < 50000) AS DOUBLE) / count(*) AS weak_frac, CASE WHEN count(*) >= 5 AND CAST(count_if(o_totalprice < 50000) AS DOUBLE) / count(*) > 0.5 THEN 'drop' WHEN count(*) >= 5 THEN 'keep' END AS verdict FROM orders GROUP BY o_custkey",
    "a8_median_mad": f"WITH {CELLS}, m AS (SELECT sample, percentile(x, 0.5) AS mx, percentile(y, 0.5) AS my FROM cells GROUP BY sample) SELECT c.sample, round(hypot(percentile(abs(x - mx), 0.5), percentile(abs(y - my), 0.5)), 6) AS spread FROM cells c JOIN m ON c.sample = m.sample GROUP BY c.sample".replace("hypot(percentile(abs(x - mx), 0.5), percentile(abs(y - my), 0.5))", "sqrt(pow(percentile(abs(x - mx), 0.5), 2) + pow(percentile(abs(y - my), 0.5), 2))"),
    "a10_percentiles": "SELECT o_orderpriority, round(percentile(o_totalprice, 0.01), 4) AS p1, round(percentile(o_totalprice, 0.5), 4) AS p50, round(percentile(o_totalprice, 0.99), 4) AS p99 FROM orders GROUP BY o_orderpriority",
    "a11_least_squares": f"WITH {CELLS}, {PLANE} SELECT v.sample, round(max(ax), 8) AS ax, round(max(ay), 8) AS ay, round(max(c), 6) AS c, count(*) AS n, round(percentile(abs(z - (c + ax * x + ay * y)), 0.9), 6) AS p90 FROM v JOIN plane ON v.sample = plane.sample GROUP BY v.sample",
    "a12_model_choice": f"""WITH {CELLS}, {PLANE}, r AS (SELECT v.sample, count(*) AS n, percentile(abs(z - (c + ax * x + ay * y)), 0.9) AS affine, percentile(abs(z - mz), 0.9) AS constant FROM v JOIN plane ON v.sample = plane.sample GROUP BY v.sample)
      SELECT sample, n, CASE WHEN n < 3 THEN 'none' WHEN affine < 0.98 * constant THEN 'affine' ELSE 'constant' END AS model FROM r""",
    "a13_total_row": "SELECT coalesce(n.n_name, '__TOTAL__') AS name, count(*) AS n, count_if(c.c_acctbal > 0) AS done, round(CAST(count_if(c.c_acctbal > 0) AS DOUBLE) / count(*), 8) AS done_share, round(avg(c.c_acctbal), 6) AS bal FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY GROUPING SETS ((n.n_name), ())",
    "a14_overview": "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders GROUP BY o_orderpriority",
    "a15_confusion": f"WITH {SCORES}, {PRED} SELECT patient, y, yhat, count(*) AS n FROM pred GROUP BY patient, y, yhat",
    "a16_class_f1": f"""WITH {SCORES}, {PRED}, c AS (SELECT count_if(y = 1 AND yhat = 1) AS tp, count_if(y = 0 AND yhat = 1) AS fp, count_if(y = 1 AND yhat = 0) AS fn FROM pred)
      SELECT round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0), 8) AS prec, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 8) AS recall, round(coalesce(2.0 * CAST(tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0), 8) AS f1 FROM c""",
    # a17, a19, w5: counts of equal scores first, then running sums within bins of the score upon the totals of the bins before
    "a16_macro_f1": f"""WITH {CELLS}, c AS (SELECT cell_type AS t, CASE WHEN cell_id % 10 < 7 THEN cell_type WHEN cell_id % 10 < 9 THEN 'click' ELSE 'error' END AS p, count(*) AS n FROM cells GROUP BY 1, 2),
      k AS (SELECT t AS label, CASE WHEN t = p THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN t <> p THEN n ELSE 0 END AS fn FROM c UNION ALL SELECT p, 0, CASE WHEN t <> p THEN n ELSE 0 END, 0 FROM c), f AS (SELECT label, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(fp) AS DOUBLE) AS fp, CAST(sum(fn) AS DOUBLE) AS fn FROM k GROUP BY label),
      m AS (SELECT label, coalesce(tp / nullif(tp + fp, 0), 0) AS prec, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM f)
      SELECT label, round(prec, 8) AS prec, round(recall, 8) AS recall, round(f1, 8) AS f1 FROM m UNION ALL SELECT '__MACRO__', round(avg(prec), 8), round(avg(recall), 8), round(avg(f1), 8) FROM m""",
    "a17_auroc": (
        f"""WITH {SCORES}, {BINNED}, o AS (SELECT bin, sum(neg) OVER (ORDER BY bin) - neg AS below FROM bins), c AS (SELECT g.pos, g.neg, o.below + sum(g.neg) OVER (PARTITION BY g.bin ORDER BY g.p) AS upto FROM g JOIN o ON g.bin = o.bin)
      SELECT round(sum(pos * (upto - CAST(neg AS DOUBLE) / 2)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)), 8) AS auroc FROM c""",
        f"""WITH {SCORES}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM scores)
      SELECT round((CAST(sum(CASE WHEN y = 1 THEN rk ELSE 0 END) AS DOUBLE) - CAST(count_if(y = 1) AS DOUBLE) * (count_if(y = 1) + 1) / 2) / (CAST(count_if(y = 1) AS DOUBLE) * count_if(y = 0)), 8) AS auroc FROM r""",
    ),
    "a18_binned_roc": f"""WITH {SCORES}, b AS (SELECT floor(CAST(p AS DOUBLE) * 100) AS bin, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM scores GROUP BY 1)
      SELECT CAST(bin AS BIGINT) AS bin, CAST(sum(pos) OVER (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp FROM b""",
    "a19_average_precision": (
        f"""WITH {SCORES}, {BINNED}, o AS (SELECT bin, sum(pos) OVER (ORDER BY bin DESC) - pos AS pos, sum(pos + neg) OVER (ORDER BY bin DESC) - pos - neg AS n FROM bins),
      c AS (SELECT g.pos, o.pos + sum(g.pos) OVER (PARTITION BY g.bin ORDER BY g.p DESC) AS tp, o.n + sum(g.pos + g.neg) OVER (PARTITION BY g.bin ORDER BY g.p DESC) AS k FROM g JOIN o ON g.bin = o.bin)
      SELECT round(sum(CAST(pos AS DOUBLE) * tp / k) / sum(pos), 8) AS ap FROM c""",
        f"""WITH {SCORES}, g AS (SELECT p, count(*) AS n, count_if(y = 1) AS pos FROM scores GROUP BY p), c AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS k, sum(pos) OVER () AS total FROM g)
      SELECT round(sum(CAST(pos AS DOUBLE) / total * (CAST(tp AS DOUBLE) / k)), 8) AS ap FROM c""",
    ),
    "a20_dice": f"WITH {SCORES}, {PRED}, c AS (SELECT patient, count_if(y = 1 AND yhat = 1) AS tp, count_if(y = 0 AND yhat = 1) AS fp, count_if(y = 1 AND yhat = 0) AS fn FROM pred GROUP BY patient) SELECT patient, round(2.0 * CAST(tp AS DOUBLE) / greatest(2 * tp + fp + fn, 1), 8) AS dice_zero, CASE WHEN tp + fp + fn = 0 THEN CAST(1 AS DOUBLE) ELSE round(CAST(tp AS DOUBLE) / (tp + fp + fn), 8) END AS iou_one FROM c",
    "a22_patient_equal": f"WITH {SCORES}, {PRED}, c AS (SELECT patient, avg(CASE WHEN y = yhat THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS acc, count(*) AS n FROM pred GROUP BY patient) SELECT round(avg(acc), 8) AS patient_equal, round(sum(acc * n) / sum(n), 8) AS pooled FROM c",
    "a23_composition_error": f"""WITH {SCORES}, {PRED}, m AS (SELECT cancer, avg(CAST(y AS DOUBLE)) AS s, avg(CAST(yhat AS DOUBLE)) AS t FROM pred GROUP BY cancer)
      SELECT cancer, round(abs(ln(t + 0.000001) - ln(s + 0.000001)), 6) AS log_error, round(abs(t - s) + abs((1 - t) - (1 - s)), 8) AS l1 FROM m""",
    "a26_z_score": f"WITH {CELLS}, s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM cells) SELECT cell_id, round((x - m) / (sd + 0.000000001), 6) AS z FROM cells CROSS JOIN s",
    "a28_weighted_available": "SELECT c_custkey, round((CASE WHEN c_acctbal > 0 THEN 0.5 * c_acctbal ELSE 0 END + 0.3 * c_nationkey) / (CASE WHEN c_acctbal > 0 THEN 0.5 ELSE 0 END + 0.3), 6) AS maturity FROM customer",
    "a29_brier": f"WITH {SCORES} SELECT round(avg(pow(CAST(p AS DOUBLE) - y, 2)), 8) AS brier, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM scores",
    "a31_pair_weighted": f"""WITH {SCORES}, r AS (SELECT cancer, y, rank() OVER (PARTITION BY cancer ORDER BY p) + (count(*) OVER (PARTITION BY cancer, p) - 1) / 2.0 AS rk FROM scores), a AS (SELECT cancer, CAST(count_if(y = 1) AS DOUBLE) AS np, CAST(count_if(y = 0) AS DOUBLE) AS nn, CAST(sum(CASE WHEN y = 1 THEN rk ELSE 0 END) AS DOUBLE) AS rs FROM r GROUP BY cancer)
      SELECT round(sum(rs - np * (np + 1) / 2) / sum(np * nn), 8) AS auroc FROM a WHERE np > 0 AND nn > 0""",
    "a32_shape_moments": f"""WITH {CELLS}, g AS (SELECT DISTINCT sample, floor(y / 10) AS iy, floor(x / 10) AS ix FROM cells WHERE cell_type = 'error'), m AS (SELECT sample, count(*) AS area, avg(ix) AS cx, avg(iy) AS cy, var_pop(ix) + 1.0 / 12 AS a, var_pop(iy) + 1.0 / 12 AS c, covar_pop(ix, iy) AS b FROM g GROUP BY sample)
      SELECT sample, area, round(cx, 6) AS cx, round(cy, 6) AS cy, round(4 * sqrt((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b)), 3) AS major, round(4 * sqrt((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b)), 3) AS minor FROM m""",
    "a35_map_sums": ("SELECT e.k AS key, CAST(sum(e.v) AS BIGINT) AS total FROM (SELECT explode(from_json(props, 'map<string, bigint>')) AS (k, v) FROM events) e GROUP BY e.k", "SELECT k AS key, CAST(sum(CAST(json_extract_string(props, '$.' || k) AS BIGINT)) AS BIGINT) AS total FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY k"),
    # windows, order, sets
    "w1_top1_per_group": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) t WHERE k = 1",
    "w2_lowest_hash": "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY sha2(CAST(event_id AS STRING), 256), event_id) AS k FROM events) t WHERE k <= 20",
    "w3_capped_merge": "SELECT o_orderpriority, count(*) AS n, max(o_orderkey) AS edge FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders) t WHERE k <= 1000 GROUP BY o_orderpriority",
    "w4_local_offsets": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS local FROM orders",
    "w5_cumulative_tp": (
        f"""WITH {SCORES}, s AS (SELECT doc_id, y, p, CAST(floor(p * 1024) AS BIGINT) AS bin FROM scores), t AS (SELECT bin, sum(y) AS tp FROM s GROUP BY bin), o AS (SELECT bin, sum(tp) OVER (ORDER BY bin DESC) - tp AS above FROM t)
      SELECT s.doc_id, CAST(o.above + sum(s.y) OVER (PARTITION BY s.bin ORDER BY s.p DESC, s.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp FROM s JOIN o ON s.bin = o.bin""",
        f"WITH {SCORES} SELECT doc_id, CAST(sum(y) OVER (ORDER BY p DESC, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp FROM scores",
    ),
    "w6_tie_rank": "SELECT l_orderkey, l_partkey, l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS tie_rank FROM lineitem".replace("/ 2.0 AS", "/ CAST(2 AS DOUBLE) AS"),
    "w7_serpentine": f"WITH {CELLS}, b AS (SELECT *, CAST(floor(y / 30) AS BIGINT) AS band FROM cells) SELECT cell_id, row_number() OVER (PARTITION BY sample ORDER BY band, CASE WHEN band % 2 = 0 THEN x ELSE -x END, cell_id) AS place FROM b",
    "w8_area_numbering": "SELECT p_type, p_brand, row_number() OVER (ORDER BY CASE WHEN p_type = 'PROMO' THEN 0 ELSE 1 END, n DESC, p_type, p_brand) AS region_id FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY p_type, p_brand) t",
    "w9_quantile_label": "SELECT p_partkey, p_retailprice >= (SELECT percentile(p_retailprice, 0.75) FROM part) AS high FROM part",
    "w10_positive_percentile": f"WITH {CELLS}, q AS (SELECT sample, percentile(x, 0.9) AS t FROM cells WHERE x > 0 GROUP BY sample) SELECT c.cell_id, c.x >= greatest(1, ceil(q.t)) AS flagged FROM cells c JOIN q ON c.sample = q.sample",
    "w11_change_points": "SELECT user_id, count_if(event_type <> prev) AS changes FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) t GROUP BY user_id",
    "w12_summed_area": f"""WITH {CELLS}, g AS (SELECT CAST(floor(y / 10) AS BIGINT) AS iy, CAST(floor(x / 10) AS BIGINT) AS ix, count(*) AS n FROM cells GROUP BY 1, 2), r AS (SELECT iy, ix, sum(n) OVER (PARTITION BY iy ORDER BY ix ROWS UNBOUNDED PRECEDING) AS n FROM g)
      SELECT iy, ix, CAST(n AS BIGINT) AS row_sum FROM r""",
    "w14_bracketing": f"""WITH {CELLS}, m AS (SELECT cell_type, CAST(floor(y / 5) AS BIGINT) AS lane, sample AS z, avg(x) AS cx FROM cells GROUP BY 1, 2, 3 HAVING count(*) >= 3), t AS (SELECT DISTINCT cell_type, lane FROM m), s AS (SELECT DISTINCT sample AS z FROM cells),
      a AS (SELECT t.cell_type, t.lane, s.z, m.z AS mz FROM t CROSS JOIN s LEFT JOIN m ON m.cell_type = t.cell_type AND m.lane = t.lane AND m.z = s.z),
      b AS (SELECT *, max(mz) OVER (PARTITION BY cell_type, lane ORDER BY z ROWS UNBOUNDED PRECEDING) AS lo, min(mz) OVER (PARTITION BY cell_type, lane ORDER BY z DESC ROWS UNBOUNDED PRECEDING) AS hi FROM a)
      SELECT b.cell_type, b.lane, b.z, b.lo, b.hi, round(l.cx + (h.cx - l.cx) * (b.z - b.lo) / (b.hi - b.lo), 6) AS cx, 30 + 2 * (b.hi - b.lo) AS tolerance FROM b JOIN m l ON l.cell_type = b.cell_type AND l.lane = b.lane AND l.z = b.lo JOIN m h ON h.cell_type = b.cell_type AND h.lane = b.lane AND h.z = b.hi WHERE b.mz IS NULL""",
    "w15_pinned_mode": "SELECT c_nationkey, c_mktsegment FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS k FROM customer GROUP BY c_nationkey, c_mktsegment) t WHERE k = 1",
    "o3_nlargest": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "o4_topk_distance": f"WITH {CELLS} SELECT sample, cell_id FROM (SELECT sample, cell_id, row_number() OVER (PARTITION BY sample ORDER BY abs(x - 100), cell_id) AS k FROM cells) t WHERE k <= 5",
    "o6_worst_six": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 6",
    "u1_union_missing": "SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS STRING) AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer",
    "u2_keep_first": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) t WHERE k = 1",
    "u3_intersect_except": "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders EXCEPT SELECT s_suppkey FROM supplier",
    "u4_symmetric_audit": "SELECT coalesce(a.k, b.k) AS k, a.k IS NULL AS missing_left FROM (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 0) a FULL OUTER JOIN (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey > 10) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL",
    "u5_multiple_owners": "SELECT l_partkey, count(DISTINCT l_suppkey) AS owners FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1",
    "u6_explode_list": ("SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, explode(split(text, '\n')) AS line FROM documents) t WHERE line <> '' GROUP BY doc_id", "SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) t WHERE line <> '' GROUP BY doc_id"),
    "u7_collect_list": ("SELECT l_orderkey, array_join(transform(sort_array(collect_list(l_linenumber)), x -> CAST(x AS STRING)), ';') AS members FROM lineitem GROUP BY l_orderkey", "SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ';' ORDER BY l_linenumber) AS members FROM lineitem GROUP BY l_orderkey"),
    # scalars, sampling, expression scores
    "f1_strings": "SELECT p_partkey, upper(p_name) AS u, replace(lower(p_brand), '#', '_') AS b, trim(p_type) AS t, substr(p_name, 1, 3) AS s FROM part",
    "f2_numeric": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(sqrt(l_quantity), 8) AS sq, round(ln(l_extendedprice), 8) AS lg, round(exp(l_discount), 8) AS ex, round(atan2(l_tax, l_quantity), 8) AS at, greatest(1, least(40, l_quantity)) AS clip FROM lineitem",
    "f3_sigmoid": "SELECT s_suppkey, round(1 / (1 + exp(-s_acctbal / 5000)), 8) AS p FROM supplier",
    "f3_softmax": "WITH l AS (SELECT s_suppkey, s_acctbal / 5000 AS a, s_nationkey / CAST(10 AS DOUBLE) AS b, CAST(1 AS DOUBLE) AS c FROM supplier), e AS (SELECT *, greatest(a, b, c) AS top FROM l), s AS (SELECT *, exp(a - top) + exp(b - top) + exp(c - top) AS total FROM e) SELECT s_suppkey, round(exp(a - top) / total, 8) AS p_a, round(exp(b - top) / total, 8) AS p_b, round(exp(c - top) / total, 8) AS p_c, CASE WHEN a = top THEN 0 WHEN b = top THEN 1 ELSE 2 END AS first_best FROM s",
    "f5_shoelace": f"""WITH {CELLS}, v AS (SELECT sample, cell_type, x, y, coalesce(lead(x) OVER (PARTITION BY sample, cell_type ORDER BY cell_id), first_value(x) OVER (PARTITION BY sample, cell_type ORDER BY cell_id)) AS nx, coalesce(lead(y) OVER (PARTITION BY sample, cell_type ORDER BY cell_id), first_value(y) OVER (PARTITION BY sample, cell_type ORDER BY cell_id)) AS ny FROM cells),
      a AS (SELECT sample, cell_type, count(*) AS n, sum(x * ny - nx * y) / 2 AS area, sum((x + nx) * (x * ny - nx * y)) / 6 AS sx, sum((y + ny) * (x * ny - nx * y)) / 6 AS sy FROM v GROUP BY sample, cell_type)
      SELECT sample, cell_type, n, round(abs(area), 3) AS area, CASE WHEN abs(area) > 1 THEN round(sx / area, 3) END AS cx, CASE WHEN abs(area) > 1 THEN round(sy / area, 3) END AS cy FROM a""",
    "f4_hash":"SELECT s_suppkey, sha2(s_name, 256) AS h FROM supplier",
    "m4_nested_split": "SELECT n_nationkey, c_custkey, k <= greatest(1, least(n - 1, CAST(round(n * 0.2) AS BIGINT))) AS inner_val FROM (SELECT c_nationkey AS n_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha2(CAST(c_custkey AS STRING), 256)) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) t",
    "m5_two_caps": "SELECT patient, cell_type, count(*) AS n FROM (SELECT user_id AS patient, event_type AS cell_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY sha2(CAST(event_id AS STRING), 256)) AS k FROM events) t WHERE k <= 5 GROUP BY patient, cell_type",
    "m6_duplicate_content": "SELECT sha2(text, 256) AS h, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY sha2(text, 256) HAVING count(*) > 1",
    "m7_group_weight": (
        "WITH g AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority), t AS (SELECT CAST(sum(n) AS DOUBLE) / count(*) AS fair FROM g) SELECT o.o_orderkey, round(t.fair / g.n, 8) AS w FROM orders o JOIN g ON o.o_orderpriority <=> g.o_orderpriority CROSS JOIN t",
        "SELECT o_orderkey, round(CAST(count(*) OVER () AS DOUBLE) / ((SELECT count(DISTINCT o_orderpriority) FROM orders) * count(*) OVER (PARTITION BY o_orderpriority)), 8) AS w FROM orders",
    ),
    "e1_linear_score": """WITH net AS (SELECT * FROM (VALUES (0), (1), (2)) AS t(gene_set)), s AS (SELECT l.l_suppkey AS cell, n.gene_set, count(*) AS genes, count_if(l.l_partkey % 3 = n.gene_set) AS targets, corr(CAST(l.l_extendedprice AS DOUBLE), CASE WHEN l.l_partkey % 3 = n.gene_set THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS r FROM lineitem l CROSS JOIN net n GROUP BY l.l_suppkey, n.gene_set)
      SELECT cell, gene_set, targets, round(r * sqrt((genes - 2) / ((1 - r) * (1 + r))), 6) AS t FROM s WHERE targets >= 5 AND genes > targets AND genes > 2""",
    "e3_marker_argmax": (
      # decimals, because sums of doubles depend on the order in which tasks deliver them, and equal scores would part
      "SELECT l_orderkey, CASE WHEN total < 10 OR best <= 0 THEN 'Unknown' WHEN a >= b THEN 'A' ELSE 'B' END AS typed FROM (SELECT l_orderkey, sum(l_quantity) AS total, avg(CAST(ln(1 + 100 * CASE WHEN l_linenumber <= 3 THEN l_quantity ELSE 0 END) AS DECIMAL(38, 18))) AS a, avg(CAST(ln(1 + 100 * CASE WHEN l_linenumber > 3 THEN l_quantity ELSE 0 END) AS DECIMAL(38, 18))) AS b, max(l_quantity) AS best FROM lineitem GROUP BY l_orderkey) t",
      "SELECT l_orderkey, CASE WHEN total < 10 OR best <= 0 THEN 'Unknown' WHEN a >= b THEN 'A' ELSE 'B' END AS typed FROM (SELECT l_orderkey, sum(l_quantity) AS total, avg(ln(1 + 100 * CASE WHEN l_linenumber <= 3 THEN l_quantity ELSE 0 END)) AS a, avg(ln(1 + 100 * CASE WHEN l_linenumber > 3 THEN l_quantity ELSE 0 END)) AS b, max(l_quantity) AS best FROM lineitem GROUP BY l_orderkey) t",
    ),
    "e4_method_guard": "SELECT count(DISTINCT l_returnflag) = 1 AS one_method FROM lineitem",
    "e5_maturity_rungs": "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'mature' WHEN p_size >= 20 AND p_retailprice >= 950 THEN 'primary' WHEN p_size >= 20 THEN 'early' ELSE 'none' END AS rung FROM part",
    "r26_tile_fraction": f"""WITH {CELLS}, g AS (SELECT DISTINCT sample, CAST(floor(y / 10) AS BIGINT) AS iy, CAST(floor(x / 10) AS BIGINT) AS ix FROM cells WHERE cell_type = 'error')
      SELECT sample, CAST(floor(iy / 5) AS BIGINT) AS ty, CAST(floor(ix / 5) AS BIGINT) AS tx, count(*) / CAST(25 AS DOUBLE) AS frac FROM g GROUP BY 1, 2, 3""",
}


def plain_counts(sql: str) -> str:
    """count_if(x) as count(CASE WHEN x THEN 1 END): DuckDB's own gives a wider type than Spark's."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + 9 : end - 1]} THEN 1 END){sql[end:]}"
    return sql


def oracle(sql: str | tuple[str, str]) -> str:
    if isinstance(sql, tuple):
        return plain_counts(sql[1])
    import re

    out = re.sub(r"sha2\((.+?), 256\)", r"sha256(\1)", sql.replace("percentile(", "quantile_cont(").replace("AS STRING", "AS VARCHAR").replace("LEFT ANTI JOIN", "ANTI JOIN"))
    return plain_counts(re.sub(r"last_value\((.+? END)\) IGNORE NULLS", r"last_value(\1 IGNORE NULLS)", out))
