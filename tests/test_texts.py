"""Texts as planes: whole, and never outside the task that describes them."""

import numpy as np
import pytest

from lumenframe.functions.descriptors import DESCRIPTORS, Image
from lumenframe.plans.queries import QUERIES

TEXTS = ["", None, "a", "x" * 32, "line\n" * 4_000, "\U0001f600é" * 333]


@pytest.mark.parametrize("query, name", [("F9_fractal", "Fractal Features"), ("F10_intensity_texts", "Pixel Intensity Statistics")])
def test_text_planes_stay_in_one_task(spark, tmp_path, query, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES[query](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "pix" not in plan
    got = {(r["img"], r["idx"]): r["v"] for r in out.collect()}
    want = {}
    for i, text in enumerate(TEXTS):
        v = [ord(c) for c in text or ""]
        if v:
            p = np.array(v + [0] * (-len(v) % 32), float).reshape(-1, 32)
            want |= {(i, k): x for k, x in enumerate(DESCRIPTORS[name].run(Image(p)))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-6 for k in want)
