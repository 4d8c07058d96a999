"""Canonical relations of a feature space and the declarative plans over them.

A plan is a short SQL text over named relations; ``build`` prefixes it with the fragments it needs, and Catalyst sees
one query. The relations:

* ``long(sample_id, label, value, grp, seq, fidx, v)``: a row per sample and feature; values that aren't finite have none;
* ``sample(sample_id, label, value, grp, seq)``: a row per sample;
* ``feat(fidx, name, family)``: the feature dictionary, a row per feature;
* ``pixel(img, y, x, val)``: a row per pixel of small planes;
* ``sim``, ``near``, ``ranges``, ``pairs`` and ``cvs``: what the pair kernel of ``operators.classify`` keeps of distances.

A relation that is given takes the place of a fragment of its name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lumenframe.plans.tables import table

#: Machine epsilon of doubles: pairs at this squared distance or nearer collide.
EPS = 2.220446049250313e-16
#: Values beyond single precision aren't real.
FLOAT_MAX = 3.4028234663852886e38

FRAGMENTS = {
    "mm": "SELECT fidx, min(v) AS mn, max(v) AS mx, avg(v) AS mean, stddev_pop(v) AS sd FROM long GROUP BY fidx",
    "norm": "SELECT sample_id, label, value, grp, seq, fidx, CASE WHEN mx = mn THEN 0.0 ELSE 100.0 * (v - mn) / (mx - mn) END AS v FROM long JOIN mm USING (fidx)",
    "cs": "SELECT fidx, label, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM norm GROUP BY fidx, label",
    "mu": "SELECT fidx, sum(n * m) / sum(n) AS mu FROM cs GROUP BY fidx",
    "fisher": "SELECT fidx, CASE WHEN coalesce(avg(s), 0.0) = 0.0 THEN 0.0 ELSE sum(pow(m - mu, 2)) / (count(*) - 1) / avg(s) END AS w FROM cs JOIN mu USING (fidx) GROUP BY fidx",
    "ranked": "SELECT fidx, w, row_number() OVER (ORDER BY w DESC, fidx) AS r FROM fisher",
    "topk": "SELECT fidx, w FROM ranked WHERE r <= 9",
    "cv_of": "SELECT label AS cl, max(value) AS rv FROM sample GROUP BY label",
    "prob": "SELECT t, label AS tl, value AS tv, grp AS tg, seq AS ts, rl, rv, s / sum(s) OVER (PARTITION BY t) AS p, sum(s) OVER (PARTITION BY t) AS nf FROM sim JOIN sample ON sample_id = t JOIN cv_of ON cl = rl",
    "pred": "SELECT t, tl, tv, tg, max_by(rl, p) AS pl, sum(p * rv) AS pv, max(nf) AS nf FROM prob GROUP BY t, tl, tv, tg",
    "mat": "SELECT tl AS gt, rl AS cls, sum(p) / count(DISTINCT t) AS p FROM prob GROUP BY tl, rl",
    "smat": "SELECT m.gt, m.cls, m.p / d.p AS s FROM mat m JOIN mat d ON m.gt = d.gt AND d.gt = d.cls",
    "px": "SELECT img, y, x, val FROM pixel",
    "pstat": "SELECT img, min(val) AS mn, max(val) AS mx, avg(val) AS mean, count(*) AS n FROM px GROUP BY img",
    "splits": "SELECT s.sample_id, s.label, k.split, row_number() OVER (PARTITION BY k.split, s.label ORDER BY md5(concat(CAST(s.sample_id AS STRING), '-', CAST(k.split AS STRING)))) AS r, count(*) OVER (PARTITION BY k.split, s.label) AS n FROM sample s CROSS JOIN (VALUES (0), (1), (2), (3)) AS k(split)",
    "sized": "SELECT split, sample_id, label, r, n, least FROM splits JOIN (SELECT split, min(n) AS least FROM splits GROUP BY split) m USING (split)",
    "part": "SELECT split, sample_id, label, CASE WHEN r <= floor(least * 0.75) THEN 'train' WHEN r <= floor(least * 0.75) + ceil(least * 0.25) THEN 'test' END AS side FROM sized",
    "cvv": "SELECT split, fidx, label, CASE WHEN mx = mn THEN 0.0 ELSE 100.0 * (v - mn) / (mx - mn) END AS v FROM long JOIN part USING (sample_id, label) JOIN cvmm USING (split, fidx) WHERE side = 'train'",
    "cvcs": "SELECT split, fidx, label, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM cvv GROUP BY split, fidx, label",
    "cvmu": "SELECT split, fidx, sum(n * m) / sum(n) AS mu FROM cvcs GROUP BY split, fidx",
    "cvw": "SELECT split, fidx, CASE WHEN coalesce(avg(s), 0.0) = 0.0 THEN 0.0 ELSE sum(pow(m - mu, 2)) / (count(*) - 1) / avg(s) END AS w FROM cvcs JOIN cvmu USING (split, fidx) GROUP BY split, fidx",
    "cvranked": "SELECT split, fidx, w, row_number() OVER (PARTITION BY split ORDER BY w DESC, fidx) AS r FROM cvw",
    "cvtop": "SELECT split, fidx, w FROM cvranked WHERE r <= 9",
    "cvmm": "SELECT split, fidx, min(v) AS mn, max(v) AS mx FROM long JOIN part USING (sample_id, label) WHERE side = 'train' GROUP BY split, fidx",
    "cvp": "SELECT split, t, label AS tl, rl, s / sum(s) OVER (PARTITION BY split, t) AS p FROM cvs JOIN sample ON sample_id = t",
    "cvbest": "SELECT split, t, tl, max_by(rl, p) AS pl FROM cvp GROUP BY split, t, tl",
    # sums of three neighbours along each axis, 0 beyond the border
    "prewitt": "SELECT img, y, x, val, sum(val) OVER (PARTITION BY img, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS hsum, sum(val) OVER (PARTITION BY img, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS vsum FROM px",
    "gradient": "SELECT img, y, x, coalesce(lag(vsum) OVER r, 0.0) - coalesce(lead(vsum) OVER r, 0.0) AS gx, coalesce(lag(hsum) OVER c, 0.0) - coalesce(lead(hsum) OVER c, 0.0) AS gy FROM prewitt WINDOW r AS (PARTITION BY img, y ORDER BY x), c AS (PARTITION BY img, x ORDER BY y)",
    "levels": "SELECT img, mn, mx, n AS pixels, CASE WHEN mx = mn THEN 0 ELSE least(CAST(floor((val - mn) * (1024 / (mx - mn))) AS INT), 1023) END AS bin FROM px JOIN pstat USING (img)",
    "cumulated": "SELECT img, mn, mx, bin, sum(c) OVER b / pixels AS om, sum(c * bin) OVER b / pixels AS mu, sum(c * bin) OVER (PARTITION BY img) / pixels AS mt FROM (SELECT img, mn, mx, pixels, bin, count(*) AS c FROM levels GROUP BY img, mn, mx, pixels, bin) h WINDOW b AS (PARTITION BY img ORDER BY bin)",
    "otsu": "SELECT img, bin, bin / 1023e0 * (mx - mn) + mn AS threshold FROM (SELECT img, mn, mx, CASE WHEN s > 0 THEN bin ELSE 0 END AS bin, row_number() OVER (PARTITION BY img ORDER BY s DESC, bin) AS k FROM (SELECT img, mn, mx, bin, CASE WHEN om >= 1 THEN 0 ELSE pow(mt * om - mu, 2) / (om * (1 - om)) END AS s FROM cumulated) q) p WHERE k = 1",
    "gray": "SELECT img, y, x, CAST(CASE WHEN mx = mn THEN 0 ELSE floor((val - mn) * (255.0 / (mx - mn))) END AS INT) AS g FROM px JOIN pstat USING (img)",
}

def needs(text: str, given: tuple[str, ...] = ()) -> list[str]:
    """The fragments that ``text`` names, each after those it names itself; none of those given."""
    out: list[str] = []

    def visit(t: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", t):
            if name in FRAGMENTS and name not in out and name not in given:
                visit(FRAGMENTS[name])
                if name not in out:
                    out.append(name)

    visit(text)
    return out


def build(text: str, given: tuple[str, ...] = ()) -> str:
    """``text`` with the fragments it needs."""
    parts = [f"{n} AS ({FRAGMENTS[n]})" for n in needs(text, given)]
    return f"WITH {', '.join(parts)} {text}" if parts else text


def named(text: str) -> set[str]:
    """Every relation that ``text`` and its fragments read."""
    return set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", build(text)))


def long_form(samples: DataFrame) -> DataFrame:
    """``long`` of sample_id, label, value, grp, seq, features (array)."""
    rows = samples.selectExpr("sample_id", "label", "value", "grp", "seq", "posexplode(features) AS (fidx, v)")
    return rows.where(f"abs(v) <= {FLOAT_MAX}")  # not a number is beyond any


def sample_form(samples: DataFrame) -> DataFrame:
    return samples.select("sample_id", "label", "value", "grp", "seq")


def feature_form(samples: DataFrame) -> DataFrame:
    """The dictionary of unnamed columns, from the widest row."""
    wide = samples.selectExpr("max(size(features)) AS n")
    return wide.selectExpr("explode(sequence(0, n - 1)) AS fidx").selectExpr("fidx", "concat('Embedding () [', CAST(fidx AS STRING), ']') AS name", "concat('family_', CAST(fidx % 4 AS STRING)) AS family")


def embedding_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS sample_id", "concat('class_', CAST(label AS STRING)) AS label", "CAST(label AS DOUBLE) AS value", "vec_id DIV 4 AS grp", "CAST(vec_id % 4 AS INT) AS seq", "transform(embedding, x -> CAST(x AS DOUBLE)) AS features")


def pixel_form(samples: DataFrame, width: int = 8) -> DataFrame:
    return samples.selectExpr("sample_id AS img", "posexplode(features) AS (i, val)").selectExpr("img", f"i DIV {width} AS y", f"i % {width} AS x", "val")


def run_plan(text: str, **relations: DataFrame) -> DataFrame:
    """Runs a plan over DataFrames given by relation name."""
    spark = next(iter(relations.values())).sparkSession
    sql = build(text, tuple(relations))
    for name in relations:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", sql)
    return spark.sql(sql, **{n: d for n, d in relations.items() if f"{{{n}}}" in sql})
