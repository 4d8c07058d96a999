"""The plans of relational operators, by survey id, as SQL over the relations of ``relations``. ``queries`` adds those that
are functions."""

from __future__ import annotations

PLANS = {
    # sources and samples
    "S15_tiles": "SELECT img, CAST(floor(x / 4) AS INT) AS tile_col, CAST(floor(y / 4) AS INT) AS tile_row, CAST(floor(x / 4) * 2 + floor(y / 4) AS INT) AS seq_id, count(*) AS n, round(avg(val), 6) AS mean FROM px GROUP BY img, floor(x / 4), floor(y / 4)",
    "S15_windows": "SELECT img, wx, wy, count(*) AS n, round(sum(val), 6) AS total FROM px CROSS JOIN (VALUES (0), (2)) AS a(wx) CROSS JOIN (VALUES (0), (2)) AS b(wy) WHERE x >= wx AND x < wx + 4 AND y >= wy AND y < wy + 4 GROUP BY img, wx, wy",
    # projections and filters
    "P1_project": "SELECT sample_id, name, round(v, 6) AS v FROM long JOIN feat USING (fidx) WHERE fidx IN (3, 1, 40)",
    "P2_keep_groups": "SELECT sample_id, grp, seq, label FROM sample WHERE grp IN (1, 5, 9, 20)",
    "P2_drop_groups": "SELECT sample_id, grp, seq, label FROM sample WHERE grp NOT IN (1, 5, 9, 20)",
    "P3_remove_class": "SELECT sample_id, s.label, class_idx FROM sample s JOIN (SELECT label, CAST(dense_rank() OVER (ORDER BY label) AS INT) AS class_idx FROM (SELECT DISTINCT label FROM sample WHERE label <> 'class_3') c) k ON s.label = k.label",
    "P4_take_tiles": "SELECT sample_id, grp, seq FROM sample WHERE seq IN (0, 2)",
    "P5_mark_unknown": "SELECT sample_id, CASE WHEN s.label = 'class_3' THEN NULL ELSE s.label END AS label, CASE WHEN s.label = 'class_3' THEN 0 WHEN s.label > 'class_3' THEN k - 1 ELSE k END AS class_idx FROM sample s JOIN (SELECT label, CAST(dense_rank() OVER (ORDER BY label) AS INT) AS k FROM (SELECT DISTINCT label FROM sample) c) q ON s.label = q.label",
    "P6_class_floor": "SELECT sample_id, s.label FROM sample s JOIN (SELECT label, n, row_number() OVER (ORDER BY label) AS k FROM (SELECT label, count(*) AS n FROM sample GROUP BY label) c) q ON s.label = q.label WHERE n >= 40 AND k <= 5",
    "P7_family_mask": "SELECT g.family AS masked, fidx, round(CASE WHEN f.family = g.family THEN 0.0 ELSE w END, 6) AS w FROM fisher JOIN feat f USING (fidx) CROSS JOIN (SELECT DISTINCT family FROM feat) g",
    "P8_nonzero": "SELECT fidx, round(w, 6) AS w FROM fisher WHERE w <> 0",
    "P9_slice": "SELECT fidx, round(w, 6) AS w FROM ranked WHERE r > 4 AND r <= 30 AND (r - 5) % 3 = 0",
    "P10_derive": "SELECT sample_id, label, value * 2 AS value, grp, seq, 4 AS downsample FROM sample",
    "P11_supported": "SELECT path, lower(regexp_extract(path, '[.](sig|SIG|tif|TIF|tiff|TIFF|ppm|PPM)$', 1)) AS ext FROM (VALUES ('a/b.sig'), ('a/c.TIF'), ('a/d.jpg'), ('e.tiff'), ('f.ppm.bak')) AS t(path) WHERE regexp_extract(path, '[.](sig|SIG|tif|TIF|tiff|TIFF|ppm|PPM)$', 1) <> ''",
    "P12_continuous": "SELECT sample_id, CAST(regexp_extract(label, '(-?[0-9]*[.]?[0-9]+)', 1) AS DOUBLE) AS value FROM sample",
    # joins
    "J1_distances": "SELECT t, pairs, round(ln(lo), 6) AS nearest, round(ln(hi), 6) AS farthest FROM ranges",
    "J2_collisions": "SELECT t, total - pairs AS collided FROM ranges CROSS JOIN (SELECT count(*) AS total FROM sample) n",
    "J4_interpolate": "SELECT t, round(sum(value / d) / sum(1 / d), 5) AS value FROM near JOIN sample ON sample_id = r WHERE k <= 5 GROUP BY t",
    "J5_label_map": "SELECT s.sample_id, s.label, coalesce(k.idx, 0) AS train_class FROM sample s LEFT JOIN (SELECT label, CAST(row_number() OVER (ORDER BY label) AS INT) AS idx FROM (SELECT DISTINCT label FROM sample WHERE label <> 'class_7') c) k ON s.label = k.label",
    "J6_partial_load": "SELECT sample_id, fidx, round(coalesce(c.v, l.v), 6) AS v, CASE WHEN c.v IS NULL THEN 'loaded' ELSE 'computed' END AS origin FROM (SELECT * FROM long WHERE fidx < 4) l FULL OUTER JOIN (SELECT sample_id, fidx, v * 2 AS v FROM long WHERE fidx >= 2 AND fidx < 6) c USING (sample_id, fidx)",
    "J8_families": "SELECT family, count(*) AS n, round(sum(w), 6) AS total FROM fisher JOIN feat USING (fidx) GROUP BY family",
    "J10_tile_pairs": "SELECT t, rl, round(ln(s), 5) AS log_sim FROM seqsim",
    "J11_similarity_map": "SELECT t, r, round(1 - (d - low) / (high - low), 5) AS similarity FROM pairs CROSS JOIN (SELECT min(lo) AS low, max(hi) AS high FROM ranges) x",
    # aggregations
    "A1_moments2": "SELECT fidx, count(*) AS n, round(min(v), 6) AS mn, round(max(v), 6) AS mx, round(avg(v), 6) AS mean, round(CASE WHEN count(*) <= 2 THEN 0 ELSE stddev_samp(v) END, 6) AS sd FROM long GROUP BY fidx",
    "A2_moments4": "SELECT fidx, round(CASE WHEN n <= 3 THEN 0 ELSE sqrt(n) * m3 / pow(m2, 1.5) END, 6) AS skewness, round(CASE WHEN n <= 4 THEN 0 ELSE n * m4 / (m2 * m2) END, 6) AS kurtosis FROM (SELECT fidx, count(*) AS n, sum(pow(v - mean, 2)) AS m2, sum(pow(v - mean, 3)) AS m3, sum(pow(v - mean, 4)) AS m4 FROM long JOIN mm USING (fidx) GROUP BY fidx) q",
    "A3_min_max": "SELECT fidx, mn, mx FROM mm",
    "A4_mean_std": "SELECT fidx, round(mean, 6) AS mean, round(sd, 6) AS sd FROM mm",
    "A5_fisher": "SELECT fidx, round(w, 6) AS w FROM fisher",
    "A5_fisher_floor": "SELECT fidx, round(sum(pow(m - mu, 2)) / (count(*) - 1) / greatest(avg(CASE WHEN n <= 2 THEN 0 ELSE s END), 1e-6), 6) AS w FROM cs JOIN mu USING (fidx) GROUP BY fidx",
    "A7_abs_corr": "SELECT fidx, round(coalesce(abs(corr(v, value)), 0), 6) AS w FROM norm GROUP BY fidx",
    "A8_family_stats": "SELECT family, count(*) AS n, round(min(w), 6) AS mn, round(max(w), 6) AS mx, round(sum(w), 6) AS total, round(avg(w), 6) AS mean, round(stddev_samp(w), 6) AS sd FROM fisher JOIN feat USING (fidx) GROUP BY family",
    "A9_class_similarity": "SELECT t, rl, round(ln(s), 5) AS log_sim FROM sim",
    "A10_marginal": "SELECT t, rl, round(p, 6) AS p, round(ln(nf), 5) AS log_norm FROM prob",
    "A11_interpolated": "SELECT t, round(pv, 6) AS value FROM pred",
    "A12_tile_average": "SELECT tg AS grp, rl, round(avg(p), 6) AS p, round(coalesce(stddev_pop(p), 0), 6) AS sd FROM prob GROUP BY tg, rl",
    "A13_per_sample": "SELECT t, tl, count(*) AS n_splits, sum(CASE WHEN tl = pl THEN 1 ELSE 0 END) AS n_right FROM cvbest GROUP BY t, tl",
    "A14_confusion": "SELECT tl AS gt, pl AS pred, count(*) AS n FROM pred GROUP BY tl, pl",
    "A15_prob_matrix": "SELECT gt, cls, round(p, 6) AS p FROM mat",
    "A16_similarity_matrix": "SELECT gt, cls, round(s, 6) AS s FROM smat",
    "A17_accuracy": "SELECT gt, n, round(acc, 6) AS accuracy, round(acc - avg(acc) OVER (), 6) AS deviation FROM (SELECT tl AS gt, count(*) AS n, avg(CASE WHEN tl = pl THEN 1e0 ELSE 0e0 END) AS acc FROM pred GROUP BY tl) q",
    "A19_interval": "SELECT round(acc, 6) AS accuracy, round(CASE WHEN n * acc > 5 AND n * (1 - acc) > 5 THEN 1.95996 * sqrt(acc * (1 - acc) / n) ELSE 1.95996 * sqrt(acc * (1 - acc) / n + 1.95996 * 1.95996 / (4e0 * n * n)) / (1 + 1.95996 * 1.95996 / n) END, 6) AS half FROM (SELECT count(*) AS n, avg(CASE WHEN tl = pl THEN 1e0 ELSE 0e0 END) AS acc FROM pred) q",
    "A22_experiment": "SELECT split, count(*) AS n, sum(CASE WHEN tl = pl THEN 1 ELSE 0 END) AS correct, round(avg(CASE WHEN tl = pl THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM cvbest GROUP BY ROLLUP (split)",
    "A22_confusion": "SELECT tl AS gt, pl AS pred, count(*) AS n FROM cvbest GROUP BY tl, pl",
    "A22_prob_matrix": "SELECT gt, cls, round(avg(p), 6) AS p FROM (SELECT split, tl AS gt, rl AS cls, sum(p) / count(DISTINCT t) AS p FROM cvp GROUP BY split, tl, rl) q GROUP BY gt, cls",
    "A23_weight_stats": "SELECT fidx, round(sum(w) / 4, 6) AS mean, count(*) AS n, round(stddev_pop(w), 6) AS sd, round(min(w), 6) AS mn, round(max(w), 6) AS mx FROM cvtop GROUP BY fidx",
    "A24_matrix_interval": "SELECT gt, cls, round(avg(p), 6) AS mean, round(1.95966 * stddev_pop(p) / sqrt(count(*)), 6) AS half FROM (SELECT split, tl AS gt, rl AS cls, sum(p) / count(DISTINCT t) AS p FROM cvp GROUP BY split, tl, rl) q GROUP BY gt, cls",
    "A25_class_distance": "SELECT a.gt AS a, b.gt AS b, round(sum(pow(a.p - b.p, 2)), 6) AS mps, round(sqrt(sum(pow(a.p - b.p, 2))), 6) AS rooted FROM mat a JOIN mat b ON a.cls = b.cls GROUP BY a.gt, b.gt",
    "A25_dissimilarity": "SELECT x.gt AS a, x.cls AS b, round(greatest(1 - x.s, 1 - y.s), 6) AS longest, round((2 - x.s - y.s) / 2, 6) AS mean, round(CASE WHEN x.gt <= x.cls THEN 1 - x.s ELSE 1 - y.s END, 6) AS top, round(CASE WHEN x.gt >= x.cls THEN 1 - x.s ELSE 1 - y.s END, 6) AS bottom, round((x.s + y.s) / 2, 6) AS mean_similarity FROM smat x JOIN smat y ON x.gt = y.cls AND x.cls = y.gt",
    "A26_histogram": "SELECT g.img, g.bin, coalesce(n, 0) AS n FROM (SELECT img, explode(sequence(0, 7)) AS bin FROM pstat) g LEFT JOIN (SELECT img, bin, count(*) AS n FROM (SELECT img, CASE WHEN mx = mn THEN 0 ELSE least(CAST(floor((val - mn) * (8 / (mx - mn))) AS INT), 7) END AS bin FROM px JOIN pstat USING (img)) q GROUP BY img, bin) h ON g.img = h.img AND g.bin = h.bin",
    "A27_median": "SELECT img, round(median(val), 6) AS median FROM px GROUP BY img",
    "A28_upper_median": "SELECT img, val AS upper_median FROM (SELECT img, val, row_number() OVER (PARTITION BY img ORDER BY val) AS r, count(*) OVER (PARTITION BY img) AS n FROM px) q WHERE r = floor(n / 2) + 1",
    "A29_gini": "SELECT img, round(CASE WHEN n <= 1 OR mean <= 0 THEN 0 ELSE num / (mean * n * (n - 1)) END, 6) AS gini FROM (SELECT img, count(*) AS n, avg(val) AS mean, sum((2 * r - n - 1) * val) AS num FROM (SELECT img, val, row_number() OVER (PARTITION BY img ORDER BY val) AS r, count(*) OVER (PARTITION BY img) AS n FROM px WHERE val > 0) q GROUP BY img) p",
    "A30_classes": "SELECT label, count(*) AS n, min(sample_id) AS first_seen FROM sample GROUP BY label",
    "A31_class_summary": "SELECT label, count(*) AS n, min(CASE WHEN regexp_extract(label, '([0-9]+)$', 1) <> '' THEN 1 ELSE 0 END) AS is_numeric FROM sample GROUP BY label",
    # windows
    "W1_sequence": "SELECT sample_id, grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY sample_id) - 1 AS INT) AS seq_id FROM sample",
    "W4_average_ranks": "SELECT fidx, sample_id, rank() OVER (PARTITION BY fidx ORDER BY v) + (count(*) OVER (PARTITION BY fidx, v) - 1) / 2e0 AS avg_rank FROM long",
    "W5_balanced_split": "SELECT split, sample_id, side FROM part WHERE side IS NOT NULL",
    "W6_rank_match": "SELECT t, tl, max(CASE WHEN tl = rl AND k <= 3 THEN 1 ELSE 0 END) AS within_3 FROM (SELECT t, tl, rl, row_number() OVER (PARTITION BY t ORDER BY p DESC, rl) AS k FROM prob) q GROUP BY t, tl",
    "W7_closest_tile": "SELECT tg AS grp, max_by(t, odds) AS tile FROM (SELECT tg, t, max(p) / (1 - max(p)) AS odds FROM prob GROUP BY tg, t) q GROUP BY tg",
    "W8_otsu": "SELECT img, bin AS otsu_bin, round(threshold, 6) AS threshold FROM otsu",
    "W9_integral": "SELECT img, y, x, round(sum(rs) OVER (PARTITION BY img, x ORDER BY y), 6) AS area FROM (SELECT img, y, x, sum(val) OVER (PARTITION BY img, y ORDER BY x) AS rs FROM px) q",
    "W10_cooccurrence": "SELECT img, angle, least(a, b) AS low, greatest(a, b) AS high, count(*) AS n FROM (SELECT img, 0 AS angle, g DIV 64 AS a, lead(g) OVER (PARTITION BY img, y ORDER BY x) DIV 64 AS b FROM gray UNION ALL SELECT img, 90 AS angle, g DIV 64 AS a, lead(g) OVER (PARTITION BY img, x ORDER BY y) DIV 64 AS b FROM gray UNION ALL SELECT img, 135 AS angle, g DIV 64 AS a, lead(g) OVER (PARTITION BY img, y - x ORDER BY x) DIV 64 AS b FROM gray UNION ALL SELECT img, 45 AS angle, g DIV 64 AS a, lead(g) OVER (PARTITION BY img, y + x ORDER BY y) DIV 64 AS b FROM gray) q WHERE b IS NOT NULL GROUP BY img, angle, least(a, b), greatest(a, b)",
    "W11_nearest": "SELECT t, r, CAST(k AS INT) AS k FROM near WHERE k <= 3",
    # sorts, sets, sampling
    "K2_top_features": "SELECT fidx, round(w, 6) AS w FROM topk",
    "K3_cut_value": "SELECT fidx, round(w, 6) AS w FROM fisher WHERE w >= (SELECT w FROM ranked WHERE r = floor(0.15 * 64 + 0.5) + 1)",
    "K4_top_50": "SELECT fidx, round(w, 6) AS w FROM ranked WHERE r <= 50",
    "U2_append": "SELECT sample_id, label FROM sample UNION ALL SELECT -1 AS sample_id, 'new' AS label",
    "U3_columns": "SELECT sample_id, fidx, round(v, 6) AS v FROM long UNION ALL SELECT sample_id, fidx + 64 AS fidx, round(v * v, 6) AS v FROM long",
    "U4_difference": "SELECT name FROM feat WHERE fidx < 20 EXCEPT SELECT name FROM feat WHERE fidx % 2 = 0",
    "R1_split_sizes": "SELECT split, label, side, count(*) AS n FROM part WHERE side IS NOT NULL GROUP BY split, label, side",
    "R2_split_unbalanced": "SELECT split, sample_id, CASE WHEN r <= floor(n * 0.75 + 0.5) THEN 'train' ELSE 'test' END AS side FROM splits",
    "R3_shuffle_split": "SELECT split, tl AS gt, pl AS pred, count(*) AS n FROM cvbest GROUP BY split, tl, pl",
    # scalar functions
    "N1_minmax": "SELECT sample_id, fidx, round(v, 6) AS v FROM norm",
    "N2_minmax_strict": "SELECT sample_id, fidx, round(CASE WHEN mx - mn < 2.2e-16 OR isnan(v) OR v < mn THEN 0 WHEN v > mx THEN 100 ELSE 100 * (v - mn) / (mx - mn) END, 6) AS v FROM long JOIN (SELECT fidx, min(v) AS mn, max(v) AS mx FROM long WHERE seq < 2 GROUP BY fidx) q USING (fidx)",
    "N3_zscore": "SELECT sample_id, fidx, round(CASE WHEN sd = 0 THEN 0 ELSE (v - mean) / sd END, 6) AS v FROM long JOIN mm USING (fidx)",
    "N4_non_real": "WITH q AS (SELECT sample_id AS id, CASE WHEN sample_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN sample_id % 7 = 1 THEN CAST('Infinity' AS DOUBLE) WHEN sample_id % 7 = 2 THEN CAST('-Infinity' AS DOUBLE) ELSE value END AS v FROM sample), b AS (SELECT min(v) AS mn, max(v) AS mx FROM q WHERE abs(v) < 1e300) SELECT id, CASE WHEN isnan(v) THEN 0.0 WHEN v > 1e300 THEN mx WHEN v < -1e300 THEN mn ELSE v END AS v FROM q CROSS JOIN b",
    "N6_linear_vote": "SELECT sample_id, round(sum(w * (v - b) / m), 4) AS value FROM norm JOIN (SELECT fidx, m, b, r * r / sum(r * r) OVER () AS w FROM (SELECT fidx, regr_slope(v, value) AS m, regr_intercept(v, value) AS b, corr(v, value) AS r FROM norm GROUP BY fidx) p) q USING (fidx) GROUP BY sample_id",
    "N11_weight_distance": "SELECT round(sqrt(sum(pow(a.w - b.w, 2))), 6) AS distance, round(sum(greatest(a.w - b.w, 0)), 6) AS left_over FROM fisher a JOIN (SELECT fidx, coalesce(abs(corr(v, value)), 0) AS w FROM norm GROUP BY fidx) b ON a.fidx = b.fidx",
    # planes
    "T4_edge": "SELECT img, y, x, round(greatest(CASE WHEN count(*) OVER u < 3 THEN 0 ELSE greatest(abs(val - lag(val) OVER c), abs(val - lead(val) OVER c)) END, CASE WHEN count(*) OVER v < 3 THEN 0 ELSE greatest(abs(val - lag(val) OVER r), abs(val - lead(val) OVER r)) END), 6) AS val FROM px WINDOW r AS (PARTITION BY img, y ORDER BY x), c AS (PARTITION BY img, x ORDER BY y), v AS (PARTITION BY img, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), u AS (PARTITION BY img, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)",
    "T8_crop": "SELECT img, y - 2 AS y, x - 1 AS x, val FROM px WHERE x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 6",
    "T10_rotate": "SELECT img, x AS y, 7 - y AS x, val, 90 AS turned FROM px UNION ALL SELECT img, 7 - y AS y, 7 - x AS x, val, 180 AS turned FROM px UNION ALL SELECT img, 7 - x AS y, y AS x, val, 270 AS turned FROM px",
    "T10_flip_invert": "SELECT img, y, 7 - x AS x, round(mx - val + mn, 6) AS val FROM px JOIN pstat USING (img)",
    "T11_normalize": "SELECT img, y, x, round(least(greatest(CASE WHEN sd = 0 THEN val - mean + 1 ELSE 1 + (val - mean) * 0.5 / sd END, 0), 255), 6) AS shifted, round(CASE WHEN val < 0.25 THEN 0 WHEN val > 1.5 THEN 200 ELSE 200 / 1.25 * (val - 0.25) END, 6) AS ranged FROM px JOIN pstat USING (img) JOIN (SELECT img, stddev_samp(val) AS sd FROM px GROUP BY img) q USING (img)",
    "T12_to8bits": "SELECT img, y, x, g FROM gray",
    "T14_prewitt": "SELECT img, y, x, round(sqrt(gx * gx + gy * gy), 6) AS magnitude, round(CASE WHEN gy = 0 THEN CASE WHEN gx < 0 THEN 3.1415926 ELSE 0 END ELSE atan2(gy, gx) END, 6) AS direction FROM gradient",
    "T15_mask": "SELECT img, y, x, CASE WHEN val > threshold THEN 1 ELSE 0 END AS mask FROM px JOIN otsu USING (img)",
    # strings
    "G3_file_options": "SELECT path, regexp_extract(path, '-t([0-9]+)(x[0-9]+)?_', 1) AS tile_cols, regexp_extract(path, '_([0-9]+)_([0-9]+)(-|[.])', 1) AS tile_col, CASE WHEN regexp_extract(path, '(-l)[.]', 1) <> '' THEN 1 ELSE 0 END AS is_long FROM (VALUES ('img_E-t6x5_5_4-l.sig'), ('b-t2_1_0.sig'), ('c-l.sig')) AS t(path)",
    "G4_first_number": "SELECT label, regexp_extract(label, '(-?[0-9]*[.]?[0-9]+)', 1) AS number FROM (VALUES ('ones_1.0'), ('FakeClass-100.5'), ('none'), ('7up')) AS t(label)",
    "G5_base_name": "SELECT path, regexp_extract(path, '([^/]*?)([.][^./]*)?$', 1) AS base FROM (VALUES ('a/b/c.tif'), ('d.sig'), ('e')) AS t(path)",
    "G6_versions": "SELECT a, b, CASE WHEN split_part(a, '.', 1) = split_part(b, '.', 1) AND (split_part(a, '.', 2) = split_part(b, '.', 2) OR split_part(a, '.', 2) = '0' OR split_part(b, '.', 2) = '0') THEN 1 ELSE 0 END AS compatible FROM (VALUES ('4.2', '4.2'), ('4.0', '4.2'), ('4.1', '4.2'), ('3.2', '4.2')) AS t(a, b)",
}
