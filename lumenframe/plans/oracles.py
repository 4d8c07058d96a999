"""DuckDB SQL for the registered queries, written from each operator's formula over the driver's tables, apart from the
plans that Spark runs: vectors stay lists where Spark explodes them, variances come from sums of squares, ranks from counts.

``B`` holds relations that several texts start from; ``sql`` puts those before a text that it names.
"""

from __future__ import annotations

import re

from lumenframe.functions.descriptors import DESCRIPTORS
from lumenframe.functions.transforms import SYMLET_LOW
from lumenframe.plans.features import FeaturePlan
from lumenframe.sources.artificial import signals

EPS = "2.220446049250313e-16"

B = {
    # samples as lists, as rows, scaled rows
    "e": "SELECT vec_id AS id, 'class_' || label AS lab, label::DOUBLE AS val, vec_id // 4 AS g, (vec_id % 4)::INT AS sq, embedding::DOUBLE[] AS f FROM embeddings",
    "u": "SELECT id, lab, val, g, sq, (i - 1)::INT AS k, f[i] AS v FROM e, unnest(range(1, len(f) + 1)) AS r(i)",
    "bd": "SELECT k, min(v) AS lo, max(v) AS hi, sum(v) / count(*) AS mu FROM u GROUP BY k",
    "sdv": "SELECT k, mu, sqrt(sum((v - mu) ^ 2) / count(*)) AS sd FROM u JOIN bd USING (k) GROUP BY k, mu",
    "x": "SELECT id, lab, val, g, sq, k, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) * 100 ELSE 0 END AS v FROM u JOIN bd USING (k)",
    "cl": "SELECT k, lab, count(*) AS n, sum(v) / count(*) AS m, (sum(v * v) - sum(v) ^ 2 / count(*)) / (count(*) - 1) AS s2 FROM x GROUP BY k, lab",
    "w": "SELECT k, coalesce(sum(n_free * (m - mu) ^ 2) / nullif(avg(s2), 0), 0) AS w FROM (SELECT k, m, s2, 1.0 / (count(*) OVER (PARTITION BY k) - 1) AS n_free, (SELECT avg(v) FROM x WHERE x.k = cl.k) AS mu FROM cl) GROUP BY k",
    "rk": "SELECT a.k, a.w, 1 + count(b.k) AS r FROM w a LEFT JOIN w b ON b.w > a.w OR (b.w = a.w AND b.k < a.k) GROUP BY a.k, a.w",
    "z": "SELECT id, lab, val, g, sq, list(v * w ORDER BY k) AS z FROM x JOIN rk USING (k) WHERE r <= 9 GROUP BY id, lab, val, g, sq",
    "d": f"SELECT * FROM (SELECT a.id AS t, a.lab AS tl, a.val AS tv, a.g AS tg, a.sq AS ts, b.id AS r, b.lab AS rl, b.val AS rv, b.sq AS rs, list_distance(a.z, b.z) ^ 2 AS d FROM z a, z b) WHERE d > {EPS}",
    "sm": "SELECT t, tl, tv, tg, rl, any_value(rv) AS rv, sum(d ^ -5) / count(*) AS s FROM d GROUP BY t, tl, tv, tg, rl",
    "pr": "SELECT sm.*, total, s / total AS p FROM sm JOIN (SELECT t, sum(s) AS total FROM sm GROUP BY t) USING (t)",
    "pd": "SELECT t, tl, tv, tg, arg_max(rl, p) AS pl, sum(p * rv) AS pv FROM pr GROUP BY t, tl, tv, tg",
    "mt": "SELECT gt, cls, total / (SELECT count(*) FROM e WHERE lab = gt) AS p FROM (SELECT tl AS gt, rl AS cls, sum(p) AS total FROM pr GROUP BY tl, rl)",
    # four shuffled splits
    "so": "SELECT id, lab, split, (SELECT count(*) FROM e b WHERE b.lab = a.lab) AS n, md5(id || '-' || split) AS h FROM e a, range(4) s(split)",
    "ro": "SELECT id, lab, split, n, row_number() OVER (PARTITION BY split, lab ORDER BY h) AS r, min(n) OVER () AS least FROM so",
    "pt": "SELECT split, id, lab, CASE WHEN r <= floor(least * 0.75) THEN 'train' WHEN r <= floor(least * 0.75) + ceil(least * 0.25) THEN 'test' END AS side FROM ro",
    "cb": "SELECT split, k, min(v) AS lo, max(v) AS hi FROM u JOIN pt USING (id) WHERE side = 'train' GROUP BY split, k",
    "cx": "SELECT split, side, u.id, u.lab, k, CASE WHEN hi > lo THEN (greatest(lo, least(hi, v)) - lo) / (hi - lo) * 100 ELSE 0 END AS v FROM u JOIN pt ON pt.id = u.id JOIN cb USING (split, k) WHERE side IS NOT NULL",
    "cc": "SELECT split, k, lab, count(*) AS n, sum(v) / count(*) AS m, (sum(v * v) - sum(v) ^ 2 / count(*)) / (count(*) - 1) AS s2, sum(v) AS total FROM cx WHERE side = 'train' GROUP BY split, k, lab",
    "cw": "SELECT split, k, coalesce(sum((m - mu) ^ 2) / (count(*) - 1) / nullif(avg(s2), 0), 0) AS w FROM cc JOIN (SELECT split, k, sum(total) / sum(n) AS mu FROM cc GROUP BY split, k) USING (split, k) GROUP BY split, k",
    "ck": "SELECT split, k, w, row_number() OVER (PARTITION BY split ORDER BY w DESC, k) AS r FROM cw",
    "cz": "SELECT split, side, id, lab, list(v * w ORDER BY k) AS z FROM cx JOIN ck USING (split, k) WHERE r <= 9 GROUP BY split, side, id, lab",
    "cd": f"SELECT * FROM (SELECT a.split, a.id AS t, a.lab AS tl, b.lab AS rl, list_distance(a.z, b.z) ^ 2 AS d FROM cz a JOIN cz b ON a.split = b.split WHERE a.side = 'test' AND b.side = 'train') WHERE d > {EPS}",
    "cs": "SELECT split, t, tl, rl, sum(d ^ -5) / count(*) AS s FROM cd GROUP BY split, t, tl, rl",
    "cp": "SELECT cs.*, s / total AS p FROM cs JOIN (SELECT split, t, sum(s) AS total FROM cs GROUP BY split, t) USING (split, t)",
    "ct": "SELECT split, t, tl, arg_max(rl, p) AS pl FROM cp GROUP BY split, t, tl",
    "cm": "SELECT split, gt, cls, total / (SELECT count(*) FROM pt WHERE pt.split = q.split AND side = 'test' AND lab = gt) AS p FROM (SELECT split, tl AS gt, rl AS cls, sum(p) AS total FROM cp GROUP BY split, tl, rl) q",
    # planes of eight by eight pixels
    "px": "SELECT id AS img, (i - 1) // 8 AS y, (i - 1) % 8 AS x, f[i] AS v FROM e, unnest(range(1, 65)) AS r(i)",
    "ps": "SELECT id AS img, list_min(f) AS lo, list_max(f) AS hi, list_sum(f) / 64 AS mu FROM e",
    "gy": "SELECT img, y, x, CASE WHEN hi > lo THEN floor((v - lo) * (255.0 / (hi - lo)))::INT ELSE 0 END AS g FROM px JOIN ps USING (img)",
    "gr": "SELECT a.img, a.y, a.x, sum(CASE WHEN b.x = a.x - 1 THEN b.v WHEN b.x = a.x + 1 THEN -b.v ELSE 0 END) AS gx, sum(CASE WHEN b.y = a.y - 1 THEN b.v WHEN b.y = a.y + 1 THEN -b.v ELSE 0 END) AS gy FROM px a JOIN px b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.img, a.y, a.x",
    "pw": "SELECT img, y, x, sqrt(gx * gx + gy * gy) AS mag, CASE WHEN gy <> 0 THEN atan2(gy, gx) WHEN gx < 0 THEN 3.1415926 ELSE 0.0 END AS dir FROM gr",
    "ob": "SELECT img, lo, hi, bin, count(*) AS c FROM (SELECT img, lo, hi, CASE WHEN hi > lo THEN least(floor((v - lo) * (1024 / (hi - lo)))::INT, 1023) ELSE 0 END AS bin FROM px JOIN ps USING (img)) GROUP BY img, lo, hi, bin",
    "os": "SELECT a.img, a.lo, a.hi, a.bin, sum(b.c) FILTER (b.bin <= a.bin) / 64.0 AS om, coalesce(sum(b.c * b.bin) FILTER (b.bin <= a.bin), 0) / 64.0 AS mu, sum(b.c * b.bin) / 64.0 AS mt FROM ob a JOIN ob b ON a.img = b.img GROUP BY a.img, a.lo, a.hi, a.bin",
    "ot": "SELECT img, coalesce(arg_max(bin, s) FILTER (s > 0), 0) AS bin, coalesce(arg_max(bin, s) FILTER (s > 0), 0) / 1023.0 * any_value(hi - lo) + any_value(lo) AS thr FROM (SELECT *, CASE WHEN om >= 1 THEN 0 ELSE (mt * om - mu) ^ 2 / (om * (1 - om)) END AS s FROM os ORDER BY img, bin) GROUP BY img",
    "on_px": "SELECT img, y, x, y * 8 + x AS pos FROM px JOIN ot USING (img) WHERE v > thr",
    "mom": "SELECT img, avg(v) AS mean, median(v) AS med, coalesce(stddev_samp(v), 0) AS sd, min(v) AS lo, max(v) AS hi FROM px GROUP BY img",
    # red, green and blue planes of a group
    "by3": "SELECT id // 4 AS grp, id % 4 AS c, list_transform(f, lambda v: floor((v - list_min(f)) * 255 / (list_max(f) - list_min(f)))) AS b FROM e WHERE id % 4 < 3",
    "rgb": "SELECT r.grp, i - 1 AS pos, r.b[i] AS r, g.b[i] AS g, q.b[i] AS b FROM by3 r JOIN by3 g ON g.grp = r.grp AND g.c = 1 JOIN by3 q ON q.grp = r.grp AND q.c = 2, unnest(range(1, 65)) AS n(i) WHERE r.c = 0",
    "hs0": "SELECT *, greatest(r, g, b) / 255 AS hi, greatest(r, g, b) / 255 - least(r, g, b) / 255 AS gap FROM rgb",
    "hs1": "SELECT *, floor(hi * 240) AS v, CASE WHEN hi > 0 THEN floor(gap / hi * 240) ELSE 0 END AS s, CASE WHEN gap = 0 THEN 0 WHEN r / 255 = hi THEN (g / 255 - b / 255) / gap WHEN g / 255 = hi THEN 2 + (b / 255 - r / 255) / gap ELSE 4 + (r / 255 - g / 255) / gap END * 60 AS deg FROM hs0",
    "hsv": "SELECT grp, pos, r, g, b, 0.2989 * r + 0.587 * g + 0.114 * b AS gray, CASE WHEN s = 0 THEN 0 ELSE floor((CASE WHEN deg < 0 THEN deg + 360 ELSE deg END) * (240::DOUBLE / 360)) END::INT AS h, s::INT AS s, v::INT AS v FROM hs1",
}

NAMES = set(B)


def sql(text: str, recursive: bool = False) -> str:
    """``text`` after the relations that it and they name."""
    out: list[str] = []

    def visit(t: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)|,\s+(?=(?:z|e) [ab]\b)(\w+)", t):
            name = name[0] or name[1]
            if name in NAMES and name not in out:
                visit(B[name])
                if name not in out:
                    out.append(name)

    visit(text)
    parts = ", ".join(f"{n} AS {'MATERIALIZED ' if n in ('d', 'cd', 'x', 'cx') else ''}({B[n]})" for n in out)
    own = text.removeprefix("WITH ")
    if own != text:
        return f"WITH {'RECURSIVE ' if recursive else ''}{parts}, {own}" if parts else f"WITH {'RECURSIVE ' if recursive else ''}{own}"
    return f"WITH {parts} {text}" if parts else text


def histogram(relation: str, bins: int, keys: str = "img") -> str:
    """(keys, idx, n): counts of column c in bins of equal width; empty ones are 0."""
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"a.{k} = b.{k}" for k in ks)
    mine = ", ".join(f"a.{k}" for k in ks)
    return f"SELECT {mine}, i AS idx, count(b.c) AS n FROM (SELECT {keys}, min(c) AS lo, max(c) AS hi FROM {relation} GROUP BY {keys}) a CROSS JOIN range({bins}) q(i) LEFT JOIN {relation} b ON {on} AND (CASE WHEN a.hi > a.lo THEN least(floor((b.c - a.lo) * ({bins} / (a.hi - a.lo))), {bins - 1}) ELSE 0 END) = i GROUP BY {mine}, i"


SQL: dict[str, str] = {}
_plain = {
    "S15_tiles": "SELECT img, (x // 4)::INT AS tile_col, (y // 4)::INT AS tile_row, ((x // 4) * 2 + y // 4)::INT AS seq_id, count(*) AS n, round(sum(v) / 16, 6) AS mean FROM px GROUP BY ALL",
    "S15_windows": "SELECT img, wx::INT AS wx, wy::INT AS wy, 16::BIGINT AS n, round(list_sum(list_transform(range(16), lambda q: f[(wy + q // 4) * 8 + wx + q % 4 + 1])), 6) AS total FROM (SELECT id AS img, f, unnest([0, 0, 2, 2]) AS wx, unnest([0, 2, 0, 2]) AS wy FROM e)",
    "S16_sampling": "SELECT id AS sample_id, r::INT AS rot, c::INT AS tile_col, d::INT AS tile_row, CASE WHEN r > 0 THEN '-R_' || r ELSE '' END || '-t2_' || c || '_' || d AS name FROM e, range(4) q(r), range(2) s(c), range(2) t(d)",
    "S17_missing": "SELECT id AS sample_id, r::INT AS rot, c::INT AS tile_col, d::INT AS tile_row FROM e, range(4) q(r), range(2) s(c), range(2) t(d) WHERE r >= 2 OR (r = 1 AND NOT coalesce(f[1] > 0, false))",
    "P1_project": "SELECT id AS sample_id, 'Embedding () [' || i || ']' AS name, round(f[i + 1], 6) AS v FROM e, unnest([1, 3, 40]) AS r(i)",
    "P2_keep_groups": "SELECT id AS sample_id, g AS grp, sq AS seq, lab AS label FROM e WHERE list_contains([1, 5, 9, 20], g)",
    "P2_drop_groups": "SELECT id AS sample_id, g AS grp, sq AS seq, lab AS label FROM e WHERE NOT list_contains([1, 5, 9, 20], g)",
    "P3_remove_class": "SELECT id AS sample_id, lab AS label, (SELECT count(DISTINCT lab) FROM e b WHERE b.lab <= a.lab AND b.lab <> 'class_3')::INT AS class_idx FROM e a WHERE lab <> 'class_3'",
    "P4_take_tiles": "SELECT id AS sample_id, g AS grp, sq AS seq FROM e WHERE id % 2 = 0",
    "P5_mark_unknown": "SELECT id AS sample_id, nullif(lab, 'class_3') AS label, CASE WHEN lab = 'class_3' THEN 0 ELSE (SELECT count(DISTINCT lab) FROM e b WHERE b.lab <= a.lab AND b.lab <> 'class_3') END::INT AS class_idx FROM e a",
    "P6_class_floor": "SELECT id AS sample_id, lab AS label FROM e WHERE lab IN (SELECT lab FROM (SELECT DISTINCT lab FROM e ORDER BY lab LIMIT 5)) AND lab IN (SELECT lab FROM e GROUP BY lab HAVING count(*) >= 40)",
    "P7_family_mask": "SELECT 'family_' || m AS masked, k AS fidx, CASE WHEN k % 4 = m THEN 0 ELSE round(w, 6) END AS w FROM w, range(4) q(m)",
    "P8_nonzero": "SELECT k AS fidx, round(w, 6) AS w FROM w WHERE NOT w = 0",
    "P9_slice": "SELECT k AS fidx, round(w, 6) AS w FROM rk WHERE list_contains(range(5, 31, 3), r)",
    "P10_derive": "SELECT id AS sample_id, lab AS label, val + val AS value, g AS grp, sq AS seq, 4 AS downsample FROM e",
    "P11_supported": "SELECT path, lower(regexp_extract(path, '[^.]*$')) AS ext FROM (VALUES ('a/b.sig'), ('a/c.TIF'), ('e.tiff')) t(path)",
    "P12_continuous": "SELECT vec_id AS sample_id, label::DOUBLE AS value FROM embeddings",
    "J1_distances": "SELECT t, count(*) AS pairs, round(min(ln(d)), 6) AS nearest, round(max(ln(d)), 6) AS farthest FROM d GROUP BY t",
    "J2_collisions": f"SELECT a.id AS t, count(*) AS collided FROM z a JOIN z b ON NOT list_distance(a.z, b.z) ^ 2 > {EPS} GROUP BY a.id",
    "J3_nearest_label": "WITH zr AS (SELECT id, lab, list(v * sqrt(w) ORDER BY k) AS z FROM x JOIN rk USING (k) WHERE r <= 9 GROUP BY id, lab) SELECT a.id AS t, a.lab AS tl, arg_min(b.lab, list_distance(a.z, b.z)) AS pl FROM zr a JOIN zr b ON a.id <> b.id AND list_distance(a.z, b.z) > 0 GROUP BY a.id, a.lab",
    "J4_interpolate": "SELECT t, round(sum(q.rv / q.d) / sum(1 / q.d), 5) AS value FROM (SELECT t, unnest(list(struct_pack(rv := rv, d := d) ORDER BY d, r)[:5]) AS q FROM d GROUP BY t) GROUP BY t",
    "J5_label_map": "SELECT a.id AS sample_id, lab AS label, CASE WHEN lab = 'class_7' THEN 0 ELSE (SELECT count(DISTINCT b.lab) FROM e b WHERE b.lab <= a.lab AND b.lab <> 'class_7') END::INT AS train_class FROM e a",
    "J6_partial_load": "SELECT id AS sample_id, k AS fidx, round(CASE WHEN k < 2 THEN v ELSE v + v END, 6) AS v, CASE WHEN k < 2 THEN 'loaded' ELSE 'computed' END AS origin FROM u WHERE k < 6",
    "J7_channels": "SELECT g AS grp, n::INT AS columns, (rank * 64 + k)::INT AS wide_idx, 'Embedding (' || rank || ') [' || k || ']' AS name, round(v, 6) AS v FROM (SELECT g, k, v, row_number() OVER (PARTITION BY g, k ORDER BY sq) - 1 AS rank, count(*) OVER (PARTITION BY g, k) AS n FROM u)",
    "J8_families": "SELECT 'family_' || k % 4 AS family, count(*) AS n, round(sum(w), 6) AS total FROM w GROUP BY k % 4",
    "J9_legacy_names": "SELECT i::INT AS fidx, CASE WHEN i % 3 = 0 THEN 'Vector () [' || 63 - i || ']' ELSE 'Embedding () [' || i || ']' END AS name FROM range(64) q(i)",
    "J10_tile_pairs": "SELECT t, rl, round(ln(avg(d ^ -5)), 5) AS log_sim FROM d WHERE ts = rs GROUP BY t, rl",
    "J11_similarity_map": "SELECT t, r, round((hi - d) / (hi - lo), 5) AS similarity FROM d, (SELECT min(d) AS lo, max(d) AS hi FROM d)",
    "A1_moments2": "SELECT k AS fidx, count(*) AS n, round(min(v), 6) AS mn, round(max(v), 6) AS mx, round(any_value(mu), 6) AS mean, round(sqrt(sum((v - mu) ^ 2) / (count(*) - 1)), 6) AS sd FROM u JOIN bd USING (k) GROUP BY k",
    "A2_moments4": "SELECT k AS fidx, round(sum(((v - mu) / sd) ^ 3) / count(*), 6) AS skewness, round(sum(((v - mu) / sd) ^ 4) / count(*), 6) AS kurtosis FROM u JOIN sdv USING (k) GROUP BY k",
    "A3_min_max": "SELECT (i - 1)::INT AS fidx, min(embedding[i])::DOUBLE AS mn, max(embedding[i])::DOUBLE AS mx FROM embeddings, range(1, 65) q(i) GROUP BY i",
    "A4_mean_std": "SELECT k AS fidx, round(mu, 6) AS mean, round(sd, 6) AS sd FROM sdv",
    "A5_fisher": "SELECT k AS fidx, round(w, 6) AS w FROM w",
    "A5_fisher_floor": "SELECT k AS fidx, round(sum((m - mu) ^ 2) / (count(*) - 1) / greatest(avg(CASE WHEN n > 2 THEN s2 ELSE 0 END), 0.000001), 6) AS w FROM cl JOIN (SELECT k, avg(v) AS mu FROM x GROUP BY k) USING (k) GROUP BY k",
    "A6_pearson": "WITH q AS (SELECT id, k, v, val, avg(v) OVER (PARTITION BY k) AS mv, avg(val) OVER (PARTITION BY k) AS mx, count(*) OVER (PARTITION BY k) AS n, rank() OVER (PARTITION BY k ORDER BY v) + (count(*) OVER (PARTITION BY k, v) - 1) / 2 AS rv, rank() OVER (PARTITION BY k ORDER BY val) + (count(*) OVER (PARTITION BY k, val) - 1) / 2 AS rx FROM x), s AS (SELECT k, any_value(n) AS n, any_value(mv) AS mv, any_value(mx) AS mx, sum((v - mv) * (val - mx)) AS sxy, sum((val - mx) ^ 2) AS sxx, sum((v - mv) ^ 2) AS syy, corr(rv, rx) AS rho FROM q GROUP BY k) SELECT k AS fidx, round(sxy / sxx, 6) AS slope, round(mv - sxy / sxx * mx, 6) AS intercept, round(sxy / sqrt(sxx * syy), 6) AS pearson_r, round(sqrt((1 - sxy ^ 2 / (sxx * syy)) * syy / sxx / (n - 2)), 6) AS pearson_se, round(rho, 6) AS spearman_r, round(sxy ^ 2 / (sxx * syy) / (SELECT sum(sxy ^ 2 / (sxx * syy)) FROM s), 6) AS w FROM s",
    "A7_abs_corr": "WITH q AS (SELECT k, (v - avg(v) OVER (PARTITION BY k)) / stddev_pop(v) OVER (PARTITION BY k) * (val - avg(val) OVER (PARTITION BY k)) / stddev_pop(val) OVER (PARTITION BY k) AS zz FROM x) SELECT k AS fidx, round(coalesce(abs(avg(zz)), 0), 6) AS w FROM q GROUP BY k",
    "A8_family_stats": "SELECT 'family_' || k % 4 AS family, count(*) AS n, round(min(w), 6) AS mn, round(max(w), 6) AS mx, round(sum(w), 6) AS total, round(sum(w) / count(*), 6) AS mean, round(sqrt((sum(w * w) - sum(w) ^ 2 / count(*)) / (count(*) - 1)), 6) AS sd FROM w GROUP BY k % 4",
    "A9_class_similarity": "SELECT t, rl, round(ln(s), 5) AS log_sim FROM sm",
    "A10_marginal": "SELECT t, rl, round(p, 6) AS p, round(ln(total), 5) AS log_norm FROM pr",
    "A11_interpolated": "SELECT t, round(pv, 6) AS value FROM pd",
    "A12_tile_average": "SELECT tg AS grp, rl, round(avg(p), 6) AS p, round(coalesce(stddev_pop(p), 0), 6) AS sd FROM pr GROUP BY tg, rl",
    "A13_per_sample": "SELECT t, tl, count(*) AS n_splits, count(*) FILTER (tl = pl) AS n_right FROM ct GROUP BY t, tl",
    "A14_confusion": "SELECT tl AS gt, pl AS pred, count(*) AS n FROM pd GROUP BY ALL",
    "A15_prob_matrix": "SELECT gt, cls, round(p, 6) AS p FROM mt",
    "A16_similarity_matrix": "SELECT a.gt, a.cls, round(a.p / (SELECT p FROM mt b WHERE b.gt = a.gt AND b.cls = a.gt), 6) AS s FROM mt a",
    "A17_accuracy": "WITH q AS (SELECT tl, count(*) AS n, count(*) FILTER (tl = pl) / count(*) AS acc FROM pd GROUP BY tl) SELECT tl AS gt, n, round(acc, 6) AS accuracy, round(acc - (SELECT avg(acc) FROM q), 6) AS deviation FROM q",
    "A18_chance": "WITH q AS (SELECT split, count(*) AS n, count(*) FILTER (tl = pl) AS c, (SELECT count(DISTINCT lab) FROM e) AS k FROM ct GROUP BY split), j AS (SELECT q.*, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(1 / k) + (n - i) * ln(1 - 1 / k) AS l FROM q, unnest(range(c, n + 1)) AS r(i)), m AS (SELECT split, max(l) AS top FROM j GROUP BY split) SELECT split::INT AS split, n, c AS correct, round(any_value(top) + ln(sum(exp(l - top))), 6) AS log_p FROM j JOIN m USING (split) GROUP BY split, n, c",
    "A19_interval": "WITH q AS (SELECT count(*) AS n, count(*) FILTER (tl = pl) AS c, 1.95996 AS z FROM pd) SELECT round(c / n, 6) AS accuracy, round(CASE WHEN c > 5 AND n - c > 5 THEN z * sqrt(c / n * (1 - c / n) / n) ELSE z * sqrt(c / n * (1 - c / n) / n + (z / n) ^ 2 / 4) / (1 + z ^ 2 / n) END, 6) AS half FROM q",
    "A20_regression_error": "WITH q AS (SELECT *, avg(tv) OVER () AS mt, avg(pv) OVER () AS mp, rank() OVER (ORDER BY tv) + (count(*) OVER (PARTITION BY tv) - 1) / 2 AS rt, rank() OVER (ORDER BY pv) + (count(*) OVER (PARTITION BY pv) - 1) / 2 AS rp FROM pd), s AS (SELECT count(*) AS n, sum((tv - pv) ^ 2) AS se, sum(abs(tv - pv)) AS sa, sum((tv - mt) * (pv - mp)) AS sxy, sum((tv - mt) ^ 2) AS sxx, sum((pv - mp) ^ 2) AS syy, corr(rt, rp) AS rho FROM q) SELECT n, round(sqrt(se / n), 6) AS rmse, round(sa / n, 6) AS avg_abs_dif, round(sxy / sqrt(sxx * syy), 6) AS pearson_r, round(sqrt((1 - sxy ^ 2 / (sxx * syy)) * syy / sxx / (n - 2)), 6) AS pearson_se, round(rho, 6) AS spearman_r FROM s",
    "A22_experiment": "SELECT split::INT AS split, n, c AS correct, round(c / n, 6) AS accuracy FROM (SELECT split, count(*) AS n, count(*) FILTER (tl = pl) AS c FROM ct GROUP BY split UNION ALL SELECT NULL, count(*), count(*) FILTER (tl = pl) FROM ct)",
    "A22_confusion": "SELECT tl AS gt, pl AS pred, count(*) AS n FROM ct GROUP BY ALL",
    "A22_prob_matrix": "SELECT gt, cls, round(avg(p), 6) AS p FROM cm GROUP BY gt, cls",
    "A23_weight_stats": "SELECT k AS fidx, round(sum(w) / 4, 6) AS mean, count(*) AS n, round(sqrt(greatest(sum(w * w) / count(*) - (sum(w) / count(*)) ^ 2, 0)), 6) AS sd, round(min(w), 6) AS mn, round(max(w), 6) AS mx FROM ck WHERE r <= 9 GROUP BY k",
    "A24_matrix_interval": "SELECT gt, cls, round(avg(p), 6) AS mean, round(1.95966 * stddev_pop(p) / sqrt(count(*)), 6) AS half FROM cm GROUP BY gt, cls",
    "A25_class_distance": "WITH v AS (SELECT gt, list(p ORDER BY cls) AS l FROM mt GROUP BY gt) SELECT a.gt AS a, b.gt AS b, round(list_distance(a.l, b.l) ^ 2, 6) AS mps, round(list_distance(a.l, b.l), 6) AS rooted FROM v a, v b",
    "A25_dissimilarity": "WITH s AS (SELECT a.gt, a.cls, a.p / (SELECT p FROM mt b WHERE b.gt = a.gt AND b.cls = a.gt) AS s FROM mt a) SELECT i.gt AS a, i.cls AS b, round(1 - least(i.s, j.s), 6) AS longest, round(1 - (i.s + j.s) / 2, 6) AS mean, round(1 - CASE WHEN i.cls >= i.gt THEN i.s ELSE j.s END, 6) AS top, round(1 - CASE WHEN i.cls <= i.gt THEN i.s ELSE j.s END, 6) AS bottom, round((i.s + j.s) / 2, 6) AS mean_similarity FROM s i JOIN s j ON j.gt = i.cls AND j.cls = i.gt",
    "A26_histogram": f"WITH c0 AS (SELECT img, v AS c FROM px), h AS ({histogram('c0', 8)}) SELECT img, idx::INT AS bin, n FROM h",
    "A27_median": "SELECT id AS img, round((list_sort(f)[32] + list_sort(f)[33]) / 2, 6) AS median FROM e",
    "A28_upper_median": "SELECT id AS img, list_sort(f)[33] AS upper_median FROM e",
    "A29_gini": "WITH q AS (SELECT id AS img, list_sort(list_filter(f, lambda v: v > 0)) AS s FROM e WHERE len(list_filter(f, lambda v: v > 0)) > 0) SELECT img, round(CASE WHEN len(s) > 1 THEN list_sum(list_transform(s, lambda v, i: (2 * i - len(s) - 1) * v)) / (list_sum(s) * (len(s) - 1)) ELSE 0 END, 6) AS gini FROM q",
    "A30_classes": "SELECT 'class_' || label AS label, count(*) AS n, min(vec_id) AS first_seen FROM embeddings GROUP BY label",
    "A31_class_summary": "SELECT 'class_' || label AS label, count(*) AS n, 1 AS is_numeric FROM embeddings GROUP BY label",
    "W1_sequence": "SELECT id AS sample_id, g AS grp, (SELECT count(*) FROM e b WHERE b.g = a.g AND b.id < a.id)::INT AS seq_id FROM e a",
    "W2_group_ids": "SELECT id AS sample_id, (dense_rank() OVER (ORDER BY g) - 1)::INT AS group_id FROM e",
    "W3_rank_order": "SELECT t, tl, (row_number() OVER (ORDER BY round(pv, 6), tv, t))::INT AS overall, (row_number() OVER (PARTITION BY tl ORDER BY round(pv, 6), t))::INT AS in_class FROM pd",
    "W4_average_ranks": "SELECT k AS fidx, id AS sample_id, (2 * rank() OVER (PARTITION BY k ORDER BY v) + count(*) OVER (PARTITION BY k, v) - 1) / 2 AS avg_rank FROM u",
    "W5_balanced_split": "SELECT split::INT AS split, id AS sample_id, side FROM pt WHERE side IS NOT NULL",
    "W6_rank_match": "SELECT t, tl, CASE WHEN list_contains(list(rl ORDER BY p DESC, rl)[:3], tl) THEN 1 ELSE 0 END AS within_3 FROM pr GROUP BY t, tl",
    "W7_closest_tile": "SELECT tg AS grp, arg_max(t, top) AS tile FROM (SELECT tg, t, max(p) / (sum(p) - max(p)) AS top FROM pr GROUP BY tg, t) GROUP BY tg",
    "W8_otsu": "SELECT img, bin AS otsu_bin, round(thr, 6) AS threshold FROM ot",
    "W9_integral": "SELECT id AS img, y::INT AS y, x::INT AS x, round(list_sum(list_transform(range(64), lambda q: CASE WHEN q // 8 <= y AND q % 8 <= x THEN f[q + 1] ELSE 0 END)), 6) AS area FROM e, range(8) a(y), range(8) b(x)",
    "W10_cooccurrence": "SELECT a.img, angle::INT AS angle, least(a.g // 64, b.g // 64)::INT AS low, greatest(a.g // 64, b.g // 64)::INT AS high, count(*) AS n FROM gy a CROSS JOIN (VALUES (0, 0, 1), (45, 1, -1), (90, 1, 0), (135, 1, 1)) t(angle, dy, dx) JOIN gy b ON a.img = b.img AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL",
    "W11_nearest": "SELECT t, q AS r, k::INT AS k FROM (SELECT t, unnest(list(r ORDER BY d, r)[:3]) AS q, unnest([1, 2, 3]) AS k FROM d GROUP BY t)",
    "K1_sort": "SELECT id AS sample_id, (1 + (SELECT count(*) FROM e b WHERE b.val < a.val OR (b.val = a.val AND b.id < a.id)))::INT AS position FROM e a",
    "K2_top_features": "SELECT k AS fidx, round(w, 6) AS w FROM w ORDER BY w.w DESC, k LIMIT 9",
    "K3_cut_value": "SELECT k AS fidx, round(w, 6) AS w FROM w WHERE w.w >= (SELECT list(w ORDER BY w DESC)[floor(0.15 * 64 + 0.5)::INT + 1] FROM w)",
    "K4_top_50": "SELECT k AS fidx, round(w, 6) AS w FROM w ORDER BY w.w DESC, k LIMIT 50",
    "U1_union": "WITH q AS (SELECT id, lab, unnest(CASE WHEN sq = 0 THEN ['a', 'b'] ELSE ['a'] END) AS o FROM e) SELECT id AS sample_id, lab AS label, o AS origin, (row_number() OVER (ORDER BY lab, id, o) - 1)::INT AS group_id FROM q",
    "U2_append": "SELECT id AS sample_id, lab AS label FROM e UNION ALL SELECT -1, 'new'",
    "U3_columns": "SELECT id AS sample_id, (k + 64 * p)::INT AS fidx, round(CASE WHEN p = 0 THEN v ELSE v ^ 2 END, 6) AS v FROM u, range(2) q(p)",
    "U4_difference": "SELECT 'Embedding () [' || i || ']' AS name FROM range(1, 20, 2) q(i)",
    "U5_scramble": "SELECT id AS sample_id, lab AS label FROM (SELECT id, row_number() OVER (ORDER BY id) AS k FROM e) JOIN (SELECT lab, row_number() OVER (ORDER BY md5(id || '-scramble')) AS k FROM e) USING (k)",
    "R1_split_sizes": "SELECT split::INT AS split, lab AS label, side, count(*) AS n FROM pt WHERE side IS NOT NULL GROUP BY split, lab, side",
    "R2_split_unbalanced": "SELECT split::INT AS split, id AS sample_id, CASE WHEN r > floor(n * 0.75 + 0.5) THEN 'test' ELSE 'train' END AS side FROM ro",
    "R3_shuffle_split": "SELECT split::INT AS split, tl AS gt, pl AS pred, count(*) AS n FROM ct GROUP BY split, tl, pl",
    "R4_grid": f"WITH gd AS (SELECT DISTINCT round(10 ^ (log10(64) / 20 * i))::INT AS kk FROM range(1, 21) q(i)), zz AS (SELECT split, side, id, lab, list(v * w ORDER BY r) AS z FROM cx JOIN ck USING (split, k) GROUP BY split, side, id, lab), dd AS (SELECT * FROM (SELECT kk, a.split, a.id AS t, a.lab AS tl, b.lab AS rl, list_distance(a.z[:kk], b.z[:kk]) ^ 2 AS d FROM zz a JOIN zz b ON a.split = b.split AND a.side = 'test' AND b.side = 'train' CROSS JOIN gd) WHERE d > {EPS}), ss AS (SELECT kk, split, t, tl, rl, avg(d ^ -5) AS s FROM dd GROUP BY ALL), bb AS (SELECT kk, split, t, tl, arg_max(rl, s) AS pl FROM ss GROUP BY ALL) SELECT kk AS n_features, count(*) AS n, count(*) FILTER (tl = pl) AS correct, round(count(*) FILTER (tl = pl) / count(*), 6) AS accuracy FROM bb GROUP BY kk",
    "N1_minmax": "SELECT id AS sample_id, k AS fidx, round(v, 6) AS v FROM x",
    "N2_minmax_strict": "WITH q AS (SELECT k, min(v) AS lo, max(v) AS hi FROM u WHERE sq IN (0, 1) GROUP BY k) SELECT id AS sample_id, k AS fidx, round(CASE WHEN hi - lo < 2.2e-16 THEN 0 ELSE greatest(0, least(100, (v - lo) / (hi - lo) * 100)) END, 6) AS v FROM u JOIN q USING (k)",
    "N3_zscore": "SELECT id AS sample_id, k AS fidx, round(coalesce((v - mu) / nullif(sd, 0), 0), 6) AS v FROM u JOIN sdv USING (k)",
    "N4_non_real": "WITH q AS (SELECT min(val) AS lo, max(val) AS hi FROM e WHERE id % 7 > 2) SELECT id, CASE id % 7 WHEN 0 THEN 0 WHEN 1 THEN hi WHEN 2 THEN lo ELSE val END AS v FROM e, q",
    "N6_linear_vote": "WITH q AS (SELECT k, covar_pop(v, val) / var_pop(val) AS m, avg(v) - covar_pop(v, val) / var_pop(val) * avg(val) AS b, covar_pop(v, val) ^ 2 / (var_pop(v) * var_pop(val)) AS r2 FROM x GROUP BY k) SELECT id AS sample_id, round(sum(r2 * (v - b) / m) / (SELECT sum(r2) FROM q), 4) AS value FROM x JOIN q USING (k) GROUP BY id",
    "N8_one_sample": f"WITH me AS (SELECT min(id) AS i FROM e), tb AS (SELECT k, min(v) AS lo, max(v) AS hi FROM u, me WHERE id <> i GROUP BY k), ty AS (SELECT id, lab, k, CASE WHEN hi > lo THEN (greatest(lo, least(hi, v)) - lo) / (hi - lo) * 100 ELSE 0 END AS v FROM u JOIN tb USING (k)), tc AS (SELECT k, lab, avg(v) AS m, var_samp(v) AS s2 FROM ty, me WHERE id <> i GROUP BY k, lab), tw AS (SELECT k, sum((m - mu) ^ 2) / (count(*) - 1) / avg(s2) AS w FROM tc JOIN (SELECT k, avg(v) AS mu FROM ty, me WHERE id <> i GROUP BY k) USING (k) GROUP BY k), tz AS (SELECT id, lab, list(v * w ORDER BY k) AS z FROM ty JOIN (SELECT * FROM tw ORDER BY w DESC, k LIMIT 9) USING (k) GROUP BY id, lab), td AS (SELECT * FROM (SELECT a.id AS t, b.lab AS rl, list_distance(a.z, b.z) ^ 2 AS d FROM tz a JOIN me ON a.id = i JOIN tz b ON b.id <> a.id) WHERE d > {EPS}), s AS (SELECT t, rl, avg(d ^ -5) AS s FROM td GROUP BY t, rl) SELECT t, rl, round(s / (SELECT sum(s) FROM s), 6) AS p, round(ln((SELECT sum(s) FROM s)), 5) AS log_norm, (SELECT arg_max(rl, s) FROM s) AS pl FROM s",
    "N9_same_result": f"WITH z8 AS (SELECT id, lab, list(v * w ORDER BY k) AS z FROM x JOIN rk USING (k) WHERE r <= 8 GROUP BY id, lab), s8 AS (SELECT t, rl, avg(d ^ -5) AS s FROM (SELECT a.id AS t, b.lab AS rl, list_distance(a.z, b.z) ^ 2 AS d FROM z8 a, z8 b) WHERE d > {EPS} GROUP BY t, rl), p8 AS (SELECT t, rl, round(s / sum(s) OVER (PARTITION BY t), 6) AS p FROM s8) SELECT t, min(CASE WHEN abs(round(a.p, 6) - b.p) <= 0.005 THEN 1 ELSE 0 END)::INT AS same FROM pr a FULL JOIN p8 b USING (t, rl) GROUP BY t",
    "N11_weight_distance": "WITH q AS (SELECT k, abs(covar_pop(v, val) / (stddev_pop(v) * stddev_pop(val))) AS c FROM x GROUP BY k) SELECT round(list_distance(list(w ORDER BY k), list(c ORDER BY k)), 6) AS distance, round(sum(CASE WHEN w > c THEN w - c ELSE 0 END), 6) AS left_over FROM w JOIN q USING (k)",
    "T4_edge": "SELECT a.img, a.y::INT AS y, a.x::INT AS x, round(greatest(CASE WHEN a.y IN (0, 7) THEN 0 ELSE max(abs(a.v - b.v)) FILTER (b.x = a.x) END, CASE WHEN a.x IN (0, 7) THEN 0 ELSE max(abs(a.v - b.v)) FILTER (b.y = a.y) END), 6) AS val FROM px a JOIN px b ON a.img = b.img AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY a.img, a.y, a.x, a.v",
    "T8_crop": "SELECT id AS img, y::INT AS y, x::INT AS x, f[(y + 2) * 8 + x + 2] AS val FROM e, range(5) a(y), range(5) b(x)",
    "T10_rotate": "SELECT id AS img, y::INT AS y, x::INT AS x, CASE q WHEN 1 THEN f[(7 - x) * 8 + y + 1] WHEN 2 THEN f[(7 - y) * 8 + 7 - x + 1] ELSE f[x * 8 + 7 - y + 1] END AS val, (q * 90)::INT AS turned FROM e, range(8) a(y), range(8) b(x), range(1, 4) c(q)",
    "T10_flip_invert": "SELECT id AS img, y::INT AS y, x::INT AS x, round(list_max(f) + list_min(f) - f[y * 8 + 8 - x], 6) AS val FROM e, range(8) a(y), range(8) b(x)",
    "T11_normalize": "SELECT img, y::INT AS y, x::INT AS x, round(greatest(0, least(255, 1 + (v - mean) / sd / 2)), 6) AS shifted, round(160 * (greatest(0.25, least(1.5, v)) - 0.25), 6) AS ranged FROM px JOIN mom USING (img)",
    "T12_to8bits": "SELECT img, y::INT AS y, x::INT AS x, g FROM gy",
    "T14_prewitt": "SELECT img, y::INT AS y, x::INT AS x, round(mag, 6) AS magnitude, round(dir, 6) AS direction FROM pw",
    "T15_mask": "SELECT img, y::INT AS y, x::INT AS x, CASE WHEN v > thr THEN 1 ELSE 0 END AS mask FROM px JOIN ot USING (img)",
    "G3_file_options": "SELECT * FROM (VALUES ('img_E-t6x5_5_4-l.sig', '6', '5', 1), ('b-t2_1_0.sig', '2', '1', 0), ('c-l.sig', '', '', 1)) t(path, tile_cols, tile_col, is_long)",
    "G4_first_number": "SELECT * FROM (VALUES ('ones_1.0', '1.0'), ('FakeClass-100.5', '-100.5'), ('none', ''), ('7up', '7')) t(label, number)",
    "G5_base_name": "SELECT * FROM (VALUES ('a/b/c.tif', 'c'), ('d.sig', 'd'), ('e', 'e')) t(path, base)",
    "G6_versions": "SELECT * FROM (VALUES ('4.2', '4.2', 1), ('4.0', '4.2', 1), ('4.1', '4.2', 0), ('3.2', '4.2', 0)) t(a, b, compatible)",
    "G2_legacy_names": "SELECT * FROM (VALUES ('Zernike_3', 'Zernike Coefficients () [3]'), ('EdgeArea', 'Edge Features () [0]'), ('Gini Coefficient ()', 'Gini Coefficient () [0]')) t(old, name)",
}
SQL |= {name: sql(text) for name, text in _plain.items()}
SQL["wnd5"] = sql("SELECT t, rl, round(p, 6) AS p, round(ln(total), 5) AS log_norm, first_value(rl) OVER (PARTITION BY t ORDER BY p DESC) AS pl FROM pr")

# --- descriptors of planes of eight by eight pixels

_cheb = "SELECT o, a, cos(o * acos(2 * (a + 1) / 8 - 1)) * (CASE WHEN o = 0 THEN 1 ELSE 2 END) / 16 AS t FROM range(8) q(o), range(8) p(a)"
_coef = f"tt AS ({_cheb}), co AS (SELECT img, i.o AS y, j.o AS x, sum(v * i.t * j.t) AS c FROM px JOIN tt i ON i.a = px.x JOIN tt j ON j.a = px.y GROUP BY img, i.o, j.o)"
_counts = "SELECT img, idx::INT AS idx, n::DOUBLE AS v FROM h"
_dft = "ft AS (SELECT img, ky, kx, sqrt(sum(v * cos(2 * pi() * (ky * y + kx * x) / 8)) ^ 2 + sum(v * sin(2 * pi() * (ky * y + kx * x) / 8)) ^ 2) AS c FROM px, range(8) a(ky), range(8) b(kx) GROUP BY img, ky, kx)"
_disc = "di AS (SELECT img, v, sqrt((x * 2 / 7 - 1) ^ 2 + (y * 2 / 7 - 1) ^ 2) AS r, atan2(y * 2 / 7 - 1, x * 2 / 7 - 1) AS th FROM px), co AS (SELECT img, m, n, sqrt(sum(v * a * t * cos(m * th)) ^ 2 + sum(v * a * t * sin(m * th)) ^ 2) AS c FROM (SELECT img, v, th, m, n, CASE WHEN m = 0 THEN 0.5 ELSE 1 END AS a, CASE WHEN n = 0 THEN 0.5 ELSE cos(n * acos(2 * r - 1)) END AS t FROM di, range(-3, 4) p(m), range(7) q(n) WHERE r < 1) GROUP BY img, m, n)"
_zernike = """WITH ms AS (SELECT img, sum(v) AS mass, sum((x + 1) * v) / sum(v) AS cx, sum((y + 1) * v) / sum(v) AS cy FROM px GROUP BY img),
 pp AS (SELECT img, v / mass AS f, sqrt(((x + 1 - cx) / 8) ^ 2 + ((y + 1 - cy) / 8) ^ 2) AS r, atan2(y + 1 - cy, x + 1 - cx) AS th FROM px JOIN ms USING (img)),
 tm AS (SELECT n, m, n - 2 * s AS pw, (-1) ^ s * factorial((n - s)::INT)::DOUBLE / (factorial(s::INT) * factorial(((n + m) // 2 - s)::INT) * factorial(((n - m) // 2 - s)::INT))::DOUBLE AS c FROM range(16) a(n), range(16) b(m), range(8) d(s) WHERE m <= n AND (n - m) % 2 = 0 AND s <= (n - m) // 2),
 ra AS (SELECT img, n, m, (n + 1) / pi() * sqrt(sum(f * c * r ^ pw * cos(m * th)) ^ 2 + sum(f * c * r ^ pw * sin(m * th)) ^ 2) AS a FROM pp, tm WHERE r >= 2.220446049250313e-16 AND r <= 1 GROUP BY img, n, m),
 ix AS (SELECT n, m, row_number() OVER (ORDER BY n, m) - 1 AS idx FROM (SELECT DISTINCT n, m FROM tm))
 SELECT ps.img, idx::INT AS idx, round(coalesce(a, 0), 6) AS v FROM ps CROSS JOIN ix LEFT JOIN ra ON ra.img = ps.img AND ra.n = ix.n AND ra.m = ix.m"""
_haralick = """WITH tn AS (SELECT img, y, x, g, dense_rank() OVER (PARTITION BY img ORDER BY g) - 1 AS k FROM gy),
 pa AS (SELECT a.img, angle, a.k AS i, b.k AS j FROM tn a CROSS JOIN (VALUES (0, 0, 1), (45, 1, -1), (90, 1, 0), (135, 1, 1)) t(angle, dy, dx) JOIN tn b ON a.img = b.img AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.g > 0 AND b.g > 0),
 sy AS (SELECT img, angle, i, j FROM pa UNION ALL SELECT img, angle, j, i FROM pa),
 pq AS (SELECT img, angle, i, j, count(*) / sum(count(*)) OVER (PARTITION BY img, angle) AS p FROM sy GROUP BY img, angle, i, j),
 mg AS (SELECT img, angle, i, sum(p) AS p FROM pq GROUP BY img, angle, i),
 ms AS (SELECT img, angle, sum(i * p) AS mean, sum(i * i * p) - sum(i * p) ^ 2 AS var, -sum(p * log2(p + 1e-9)) AS hx FROM mg GROUP BY img, angle),
 h2 AS (SELECT a.img, a.angle, -sum(a.p * b.p * log2(a.p * b.p + 1e-9)) AS hxy2 FROM mg a JOIN mg b ON a.img = b.img AND a.angle = b.angle GROUP BY a.img, a.angle),
 sd AS (SELECT img, angle, s, sum(p) AS p FROM (SELECT img, angle, i + j AS s, p FROM pq) GROUP BY img, angle, s),
 df AS (SELECT img, angle, s, sum(p) AS p FROM (SELECT img, angle, abs(i - j) AS s, p FROM pq) GROUP BY img, angle, s),
 se AS (SELECT img, angle, sum(s * p) AS savg, -sum(p * log2(p + 1e-9)) AS sent FROM sd GROUP BY img, angle),
 sv AS (SELECT img, angle, sum((s - sent) ^ 2 * p) AS svar FROM sd JOIN se USING (img, angle) GROUP BY img, angle),
 de AS (SELECT img, angle, sum(s * s * p) AS con, sum(s * s * p) - sum(s * p) ^ 2 AS dvar, -sum(p * log2(p + 1e-9)) AS dent FROM df GROUP BY img, angle),
 ce AS (SELECT pq.img, pq.angle, sum(pq.p ^ 2) AS asm, sum(pq.i * pq.j * pq.p) AS ij, sum(pq.p / (1 + (pq.i - pq.j) ^ 2)) AS idm, -sum(pq.p * log2(pq.p + 1e-9)) AS ent, -sum(pq.p * log2(a.p * b.p + 1e-9)) AS hxy1 FROM pq JOIN mg a ON a.img = pq.img AND a.angle = pq.angle AND a.i = pq.i JOIN mg b ON b.img = pq.img AND b.angle = pq.angle AND b.i = pq.j GROUP BY pq.img, pq.angle),
 al AS (SELECT * FROM ce JOIN ms USING (img, angle) JOIN h2 USING (img, angle) JOIN se USING (img, angle) JOIN sv USING (img, angle) JOIN de USING (img, angle)),
 st AS (SELECT img, unnest([0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12, 13]) AS k, unnest([asm, con, (ij - mean ^ 2) / var, dvar, dent, ent, (ent - hxy1) / hx, idm, sqrt(abs(1 - exp(-2 * (hxy2 - ent)))), savg, sent, svar, var]) AS v FROM al)
 SELECT img, (2 * k)::INT AS idx, floor(avg(v) * 10000 + 0.501) / 10000 AS v FROM st GROUP BY img, k UNION ALL SELECT img, (2 * k + 1)::INT, floor((max(v) - min(v)) * 10000 + 0.501) / 10000 FROM st GROUP BY img, k"""
_comb = f"""WITH ln AS (SELECT img, d, CASE d WHEN 0 THEN 3 - y WHEN 1 THEN 3 - x WHEN 2 THEN x - y ELSE 7 - x - y END AS p, v FROM px, range(4) q(d)),
 m1 AS (SELECT img, d, p, count(*) AS n, avg(v) AS mean FROM ln GROUP BY img, d, p),
 m2 AS (SELECT img, d, p, n, any_value(mean) AS mean, sum((v - mean) ^ 2) AS s2, sum((v - mean) ^ 3) AS s3, sum((v - mean) ^ 4) AS s4 FROM ln JOIN m1 USING (img, d, p) GROUP BY img, d, p, n),
 m3 AS (SELECT img, d, p, CASE WHEN n > 4 THEN n * s4 / s2 ^ 2 ELSE 0 END AS ku, mean, CASE WHEN n > 3 THEN sqrt(n) * s3 / s2 ^ 1.5 ELSE 0 END AS sk, CASE WHEN n > 2 THEN sqrt(s2 / (n - 1)) ELSE 0 END AS sd FROM m2),
 sl AS (SELECT ps.img, d, p, s FROM ps, range(4) a(d), range(4) b(s), (SELECT unnest(list_concat(range(-7, 9), [1000, 1001, 1002, 1003])) AS p)),
 va AS (SELECT sl.img, sl.d, sl.s, coalesce([ku, mean, sk, sd][sl.s + 1], 0) AS c FROM sl LEFT JOIN m3 ON m3.img = sl.img AND m3.d = sl.d AND m3.p = sl.p),
 h AS ({histogram("va", 3, "img, d, s")})
 SELECT img, (d * 12 + s * 3 + idx)::INT AS idx, n::DOUBLE AS v FROM h"""
_radon = f"""WITH qp AS (SELECT img, k, v / 4 AS q, (x + h / 2 - 0.25 - 3) * cos(radians(deg)) + ((7 - y) + g / 2 - 0.25 - 3) * sin(radians(deg)) + 7 AS place FROM px, range(2) a(h), range(2) b(g), (VALUES (0, 0.0), (1, 135.0), (2, 45.0), (3, 90.0)) t(k, deg)),
 sp AS (SELECT img, k, floor(place)::INT AS s, q * (1 - (place - floor(place))) AS q FROM qp UNION ALL SELECT img, k, floor(place)::INT + 1, q * (place - floor(place)) FROM qp),
 tt AS (SELECT img, k, s, sum(q) AS q FROM sp GROUP BY img, k, s),
 al AS (SELECT ps.img, a.k, coalesce(q, 0) AS c FROM ps CROSS JOIN range(4) a(k) CROSS JOIN range(15) b(s) LEFT JOIN tt ON tt.img = ps.img AND tt.k = a.k AND tt.s = b.s),
 h AS ({histogram("al", 3, "img, k")})
 SELECT img, (k * 3 + idx)::INT AS idx, n::DOUBLE AS v FROM h"""
_edges = f"""WITH s AS (SELECT img, avg(mag) AS mm, median(mag) AS md, var_samp(mag) AS mv, avg(dir) AS dm, median(dir) AS dd, var_samp(dir) AS dv FROM pw GROUP BY img),
 ar AS (SELECT img, count(*) FILTER (mag > mm) AS area FROM pw JOIN s USING (img) GROUP BY img),
 c1 AS (SELECT img, dir AS c FROM pw), c2 AS (SELECT img, mag AS c FROM pw),
 hd AS ({histogram("c1", 8)}), hm AS ({histogram("c2", 8)}),
 op AS (SELECT a.img, a.idx, CASE WHEN a.n + b.n > 0 THEN abs(a.n - b.n) / (a.n + b.n) ELSE 0 END AS v FROM hd a JOIN hd b ON a.img = b.img AND b.idx = a.idx + 4)
 SELECT img, 0 AS idx, area::DOUBLE AS v FROM ar UNION ALL SELECT img, (1 + idx)::INT, round(v, 6) FROM op UNION ALL SELECT img, (5 + idx)::INT, n::DOUBLE FROM hd
 UNION ALL SELECT img, 13, round(sum(n) FILTER (idx < 2) / 64, 6) FROM hd GROUP BY img
 UNION ALL SELECT img, unnest([14, 15, 16, 25, 26, 27])::INT, round(unnest([dm, dd, dv, mm, md, mv]), 6) + 0.0 FROM s UNION ALL SELECT img, (17 + idx)::INT, n::DOUBLE FROM hm"""


def objects(inverse: bool) -> str:
    """Connected groups by reachability; the inverted plane has its own threshold."""
    plane = "SELECT img, y, x, lo + hi - v AS v FROM px JOIN ps USING (img)" if inverse else "SELECT img, y, x, v FROM px"
    return f"""WITH pl AS ({plane}), ql AS (SELECT img, min(v) AS lo, max(v) AS hi FROM pl GROUP BY img),
 oc AS (SELECT img, lo, hi, least(floor((v - lo) * (1024 / (hi - lo)))::INT, 1023) AS bin FROM pl JOIN ql USING (img)),
 od AS (SELECT img, lo, hi, bin, count(*) AS c FROM oc GROUP BY ALL),
 oe AS (SELECT a.img, a.lo, a.hi, a.bin, sum(b.c) FILTER (b.bin <= a.bin) / 64.0 AS om, sum(b.c * b.bin) FILTER (b.bin <= a.bin) / 64.0 AS mu, sum(b.c * b.bin) / 64.0 AS mt FROM od a JOIN od b ON a.img = b.img GROUP BY a.img, a.lo, a.hi, a.bin),
 og AS (SELECT img, arg_max(bin, (mt * om - mu) ^ 2 / (om * (1 - om))) / 1023.0 * any_value(hi - lo) + any_value(lo) AS thr FROM oe WHERE om < 1 GROUP BY img),
 mk AS (SELECT img, y, x, y * 8 + x AS pos FROM pl JOIN og USING (img) WHERE v > thr),
 ed AS (SELECT a.img, a.pos AS a, b.pos AS b FROM mk a JOIN mk b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
 rc AS (SELECT img, a, b FROM ed UNION SELECT rc.img, rc.a, ed.b FROM rc JOIN ed ON ed.img = rc.img AND ed.a = rc.b),
 lb AS (SELECT img, a AS pos, min(b) AS l FROM rc GROUP BY img, a)"""


def object_features(inverse: bool) -> str:
    return (
        objects(inverse)
        + f""", gc AS (SELECT img, avg(x) + 1 AS cx, avg(y) + 1 AS cy FROM mk GROUP BY img),
 ar AS (SELECT img, l, count(*)::DOUBLE AS c, sqrt((avg(pos % 8) + 1 - any_value(cx)) ^ 2 + (avg(pos // 8) + 1 - any_value(cy)) ^ 2) AS dd FROM lb JOIN gc USING (img) GROUP BY img, l),
 dr AS (SELECT img, dd AS c FROM ar),
 ha AS ({histogram("ar", 10)}), hb AS ({histogram("dr", 10)}),
 qs AS (SELECT a.img, a.y, a.x, count(b.pos) AS n FROM (SELECT ps.img, y, x FROM ps, range(7) q(y), range(7) r(x)) a LEFT JOIN mk b ON b.img = a.img AND b.x IN (a.x, a.x + 1) AND b.y IN (a.y, a.y + 1) GROUP BY a.img, a.y, a.x),
 eu AS (SELECT img, trunc((count(*) FILTER (n = 1) - count(*) FILTER (n = 3)) / 4) AS e FROM qs GROUP BY img),
 s AS (SELECT img, count(*) AS n, max(c) AS am, avg(c) AS aa, list_sort(list(c))[count(*) // 2 + 1] AS ad, min(c) AS ai, coalesce(var_samp(c), 0) AS av, max(dd) AS dm, avg(dd) AS da, list_sort(list(dd))[count(*) // 2 + 1] AS dx, min(dd) AS di, coalesce(var_samp(dd), 0) AS dv FROM ar GROUP BY img)
 SELECT ha.img, idx::INT AS idx, CASE WHEN am = ai THEN 0 ELSE ha.n END::DOUBLE AS v FROM ha JOIN s USING (img) UNION ALL SELECT img, (18 + idx)::INT, n::DOUBLE FROM hb
 UNION ALL SELECT img, unnest([10, 11, 12, 13, 14, 15, 16, 17, 28, 29, 30, 31, 32, 33])::INT, round(unnest([am, aa, ad, ai, av, cx, cy, n, dm, da, dx, di, dv, e]), 6) + 0.0 FROM s JOIN gc USING (img) JOIN eu USING (img)"""
    )


_rules = """WITH hu(name, s, a, b, t) AS (VALUES ('red', 0, 0, 0, 40), ('yellow', 20, 40, 40, 80), ('light_green', 60, 80, 80, 160), ('blue', 120, 160, 160, 220), ('red', 200, 240, 240, 240)),
 sa(name, s, m, t) AS (VALUES ('grey', -0.1, 0, 40), ('almost_grey', 10, 30, 70), ('tend_grey', 30, 70, 120), ('medium_grey', 60, 120, 180), ('tend_clear', 120, 180, 240), ('clear', 180, 240, 240.1)),
 vl(name, s, m, t) AS (VALUES ('dark', -0.1, 0, 60), ('almost_dark', 0, 60, 120), ('tend_dark', 60, 120, 180), ('tend_light', 120, 180, 240), ('light', 200, 240, 240.1)),
 ru(h, s, v, c) AS (VALUES ('red', 'grey', 'dark', 4), ('red', 'clear', 'light', 5), ('red', 'medium_grey', 'tend_light', 6), ('yellow', 'tend_clear', 'tend_dark', 12), ('yellow', 'clear', 'light', 11), ('light_green', 'tend_clear', 'tend_light', 13), ('light_green', 'medium_grey', 'tend_dark', 14), ('blue', 'tend_clear', 'tend_light', 17), ('blue', 'medium_grey', 'almost_dark', 15), ('blue', 'tend_grey', 'light', 2)),
 mh AS (SELECT h, name, max(CASE WHEN h < s OR h > t THEN 0 WHEN h < a THEN (h - s) / (a - s)::DOUBLE WHEN h > b THEN 1 - (h - b) / (t - b)::DOUBLE ELSE 1 END) AS m FROM (SELECT DISTINCT h FROM hsv), hu GROUP BY h, name),
 ma AS (SELECT q.s, name, CASE WHEN q.s < sa.s OR q.s > t THEN 0 WHEN q.s < m THEN (q.s - sa.s) / (m - sa.s)::DOUBLE ELSE 1 - (q.s - m) / (t - m)::DOUBLE END AS m FROM (SELECT DISTINCT s FROM hsv) q, sa),
 mv AS (SELECT q.v, name, CASE WHEN q.v < vl.s OR q.v > t THEN 0 WHEN q.v < m THEN (q.v - vl.s) / (m - vl.s)::DOUBLE ELSE 1 - (q.v - m) / (t - m)::DOUBLE END AS m FROM (SELECT DISTINCT v FROM hsv) q, vl),
 mb AS (SELECT grp, pos, c, sum(mh.m * ma.m * mv.m) AS m FROM hsv JOIN mh ON mh.h = hsv.h JOIN ru ON ru.h = mh.name JOIN ma ON ma.s = hsv.s AND ma.name = ru.s JOIN mv ON mv.v = hsv.v AND mv.name = ru.v GROUP BY grp, pos, c),
 cq AS (SELECT grp, pos, coalesce((SELECT list(c ORDER BY m DESC, c)[1] FROM mb WHERE mb.grp = hsv.grp AND mb.pos = hsv.pos AND m > 0), 2) AS c FROM hsv)"""


def five(relation: str) -> str:
    """Mean, median, deviation and extremes of column c by image."""
    return f"SELECT img, unnest([0, 1, 2, 3, 4])::INT AS idx, round(unnest([avg(c), median(c), stddev_samp(c), min(c), max(c)]), 6) AS v FROM {relation} GROUP BY img"


_texts = "WITH tx AS (SELECT doc_id AS img, list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c)) AS p FROM documents WHERE length(text) > 0), pl AS (SELECT img, (len(p) + 31) // 32 AS h, list_concat(p, list_resize([]::INT[], (32 - len(p) % 32) % 32, 0)) AS p FROM tx)"
_fractal = _texts + ", kk AS (SELECT img, h, p, k FROM pl, range(1, 6) q(k) WHERE k < least(h, 32) // 5), fr AS (SELECT img, k, (list_sum(list_transform(range(1, len(p) - 32 * k + 1), lambda i: abs(p[i] - p[i + 32 * k]))) + list_sum(list_transform(list_filter(range(1, len(p) + 1), lambda i: (i - 1) % 32 < 32 - k), lambda i: abs(p[i] - p[i + k])))) / (32 * (32 - k) + h * (h - k)) AS v FROM kk) SELECT pl.img, i::INT AS idx, floor(0.5 + 1000000 * coalesce(v, 0)) / 1000000 AS v FROM pl CROSS JOIN range(20) q(i) LEFT JOIN fr ON fr.img = pl.img AND fr.k = i + 1"

_taps = ", ".join(f"({k}, {v!r})" for k, v in enumerate(SYMLET_LOW.tolist()))
_wavelet = f"WITH lo(k, t) AS (VALUES {_taps}), tp AS (SELECT 1 AS low, k, t FROM lo UNION ALL SELECT 0, k, (CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END) * (SELECT t FROM lo b WHERE b.k = 9 - lo.k) FROM lo) SELECT img, (b.low * 8 + j)::INT AS y, (a.low * 8 + i)::INT AS x, round(sum(v * a.t * b.t), 6) + 0.0 AS val FROM px CROSS JOIN range(8) q(j) CROSS JOIN range(8) r(i) JOIN tp a ON a.k = 2 * j + 1 - px.y JOIN tp b ON b.k = 2 * i + 1 - px.x GROUP BY img, a.low, b.low, j, i"

_groups = ", ".join(f"('{g.algorithm}', '{g.group}', '{' < '.join(g.transforms)}', {DESCRIPTORS[g.algorithm].width})" for g in FeaturePlan.long(True).groups)


def artificial(features: int) -> str:
    """Rows (i, x) of relation q as rows by feature."""
    out = []
    duck = {"100D": "100.0", "-100D": "-100.0"}
    for at, formula in enumerate(signals(False).values()):
        f = duck.get(formula, re.sub(r"(\d)D\b", r"\1", formula))
        out.append(f"SELECT i, x, label, name, grp, seq, {at * features} + c AS fidx, ({f})::DOUBLE AS v FROM q, range({features}) s(c)")
    return " UNION ALL ".join(out)


SQL |= {
    "F1_chebyshev_fourier": sql(f"WITH {_disc}, h AS ({histogram('co', 32)}) {_counts}"),
    "F2_chebyshev": sql(f"WITH {_coef}, h AS ({histogram('co', 32)}) {_counts}"),
    "F3_zernike": sql(_zernike),
    "F4_haralick": sql(_haralick),
    "F5_multiscale": sql(f"WITH c0 AS (SELECT img, v AS c FROM px), h AS (" + " UNION ALL ".join(f"SELECT img, idx + {at} AS idx, n FROM ({histogram('c0', n)})" for n, at in ((3, 0), (5, 3), (7, 8), (9, 15))) + ") SELECT img, idx::INT AS idx, round(n / max(n) OVER (PARTITION BY img), 6) AS v FROM h"),
    "F7_comb": sql(_comb),
    "F8_radon": sql(_radon),
    "F9_fractal": _fractal,
    "F10_intensity": sql("WITH c0 AS (SELECT img, v AS c FROM px) " + five("c0")),
    "F10_intensity_texts": _texts + ", c0 AS (SELECT img, unnest(p)::DOUBLE AS c FROM pl) " + five("c0").replace("stddev_samp(c)", "CASE WHEN count(*) > 2 THEN stddev_samp(c) ELSE 0 END").replace("round(unnest([", "floor(0.5 + 1000000 * unnest([").replace(", 6) AS v", ") / 1000000 AS v"),
    "F11_edge": sql(_edges),
    "F12_objects": sql(object_features(False), recursive=True),
    "F13_inverse_objects": sql(object_features(True), recursive=True),
    "F15_gini": sql("SELECT id AS img, 0 AS idx, round(CASE WHEN len(s) > 1 THEN list_sum(list_transform(s, lambda v, i: (2 * i - len(s) - 1) * v)) / (list_sum(s) * (len(s) - 1)) ELSE 0 END, 6) AS v FROM (SELECT id, list_sort(list_filter(f, lambda v: v > 0)) AS s FROM e)"),
    "F16_color_histogram": sql(_rules + " SELECT g.grp AS img, i::INT AS idx, round(count(cq.c) / 64, 6) AS v FROM (SELECT DISTINCT grp FROM hsv) g CROSS JOIN range(20) q(i) LEFT JOIN cq ON cq.grp = g.grp AND cq.c = i GROUP BY g.grp, i"),
    "F_fourier_intensity": sql(f"WITH {_dft} " + five("ft").replace(", 6) AS v", ", 5) AS v")),
    "T1_fourier": sql(f"WITH {_dft} SELECT img, ky::INT AS y, kx::INT AS x, round(c, 6) AS val FROM ft"),
    "T2_chebyshev": sql(f"WITH {_coef} SELECT img, y::INT AS y, x::INT AS x, round(c, 6) + 0.0 AS val FROM co"),
    "T3_wavelet": sql(_wavelet),
    "T5_color": sql(_rules + ", c0 AS (SELECT grp AS img, floor(255 * c / 19) AS c FROM cq) " + five("c0")),
    "T6_hue": sql("WITH c0 AS (SELECT grp AS img, h AS c FROM hsv) " + five("c0")),
    "T7_empty": sql("WITH c0 AS (SELECT img, v AS c FROM px) " + five("c0")),
    "T9_downsample": sql("SELECT img, j::INT AS y, i::INT AS x, round(sum(v * greatest(least((i + 1) / 0.6, px.x + 1) - greatest(i / 0.6, px.x), 0) * 0.6 * greatest(least((j + 1) / 0.4, px.y + 1) - greatest(j / 0.4, px.y), 0) * 0.4), 6) AS val FROM px, range(4) q(i), range(3) r(j) GROUP BY img, j, i"),
    "T13_convolve": sql("SELECT a.img, a.y::INT AS y, a.x::INT AS x, round(sum(b.v * [[0, 1, 0.5], [-1, 2, 0], [0.25, -0.5, 1]][(b.y - a.y + 2)][(b.x - a.x + 2)]), 6) AS val FROM px a JOIN px b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.img, a.y, a.x"),
    "T16_labels": sql(objects(False) + " SELECT p.img, p.y::INT AS y, p.x::INT AS x, coalesce(n, 0)::DOUBLE AS val FROM px p LEFT JOIN (SELECT img, pos, dense_rank() OVER (PARTITION BY img ORDER BY l) AS n FROM lb) q ON q.img = p.img AND q.pos = p.y * 8 + p.x", recursive=True),
    "T17_color_spaces": sql("SELECT grp, pos::INT AS pos, round(gray, 6) AS gray, h, s, v FROM hsv"),
    "T18_color_statistics": sql("SELECT grp, round(avg(h), 6) AS h_mean, round(stddev_samp(h), 6) AS h_std, round(avg(s), 6) AS s_mean, round(stddev_samp(s), 6) AS s_std, round(avg(v), 6) AS v_mean, round(stddev_samp(v), 6) AS v_std FROM hsv GROUP BY grp"),
    "G1_name_parse": f"WITH g(algorithm, grp, transforms, n) AS (VALUES {_groups}) SELECT grp || ' [' || i || ']' AS name, algorithm, transforms, '' AS channel, i::INT AS idx FROM g, unnest(range(n)) AS r(i)",
    "S13_continuous": f"WITH q AS (SELECT i, -100 + i * 200 / 99 AS x, NULL::VARCHAR AS label, printf('FakeContinuousSample%03d', i) AS name, i AS grp, 1 AS seq FROM range(100) r(i)) SELECT i AS sample_id, name, label, round(x, 6) AS value, grp, seq::INT AS seq, fidx::INT AS fidx, round(v, 6) + 0.0 AS v FROM ({artificial(3)})",
    "S14_discrete": f"WITH q AS (SELECT i, -100 + (i // 14) * 200 / 6 AS x, 'FakeClass' || (CASE WHEN i // 14 > 3 THEN '+' ELSE '-' END) || printf('%05.1f', abs(-100 + (i // 14) * 200 / 6)) AS label, 'FakeClass' || (CASE WHEN i // 14 > 3 THEN '+' ELSE '-' END) || printf('%05.1f_%03d', abs(-100 + (i // 14) * 200 / 6), i % 14) AS name, i AS grp, 1 AS seq FROM range(98) r(i)) SELECT i AS sample_id, name, label, round(x, 6) AS value, grp, seq::INT AS seq, fidx::INT AS fidx, round(v, 6) + 0.0 AS v FROM ({artificial(2)})",
}
