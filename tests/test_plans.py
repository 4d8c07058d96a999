import duckdb
import pandas as pd
import pytest

from lumenframe.operators.classify import wnd5
from lumenframe.plans.catalog import PLANS
from lumenframe.plans.queries import ORACLE, QUERIES
from lumenframe.plans.relations import embedding_samples, needs

SF = "/root/testdata/sf0.001"
CHEAP = """A3_min_max A5_fisher A6_pearson A18_chance A20_regression_error A22_experiment A25_dissimilarity A26_histogram N1_minmax N4_non_real N8_one_sample K1_sort K2_top_features
P5_mark_unknown J3_nearest_label J6_partial_load J10_tile_pairs J11_similarity_map U1_union U4_difference U5_scramble W3_rank_order W5_balanced_split W8_otsu W9_integral W10_cooccurrence
T1_fourier T3_wavelet T4_edge T9_downsample T14_prewitt T15_mask T16_labels T17_color_spaces F3_zernike F4_haralick F7_comb F8_radon F9_fractal F11_edge F12_objects F16_color_histogram
G1_name_parse G4_first_number S13_continuous S14_discrete S16_sampling S17_missing""".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("null" if pd.isna(v) else str(float(v)) if not isinstance(v, str) else v for v in r) for r in frame.values.tolist())


@pytest.mark.parametrize("name", CHEAP)
def test_plan_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.sql(ORACLE[name]).df())


def test_every_plan_has_sql():
    assert set(PLANS) <= set(ORACLE) <= set(QUERIES)


def test_oracles_share_no_text_with_plans():
    """What the SQL of a plan says isn't the plan's own text."""
    for name, text in PLANS.items():
        own = ORACLE[name]
        pieces = [text[i : i + 120] for i in range(0, max(len(text) - 120, 1), 20)]
        assert not any(len(p) == 120 and p in own for p in pieces), name


def test_fragments_come_after_those_they_name():
    order = needs("SELECT * FROM ranked JOIN prob")
    assert order.index("mm") < order.index("norm") < order.index("fisher") < order.index("ranked")


def samples(spark, values, labels):
    rows = [(i, lab, float(i), i // 4, i % 4, [float(v) for v in vs]) for i, (vs, lab) in enumerate(zip(values, labels, strict=True))]
    return spark.createDataFrame(rows, "sample_id long, label string, value double, grp long, seq int, features array<double>")


def test_wnd5_finds_separated_classes_and_leaves_collisions_out(spark):
    df = samples(spark, [[0, 5], [1, 5], [0.5, 5], [10, 5], [11, 5], [10.5, 5]], "aaabbb")
    got = wnd5(df, df, top=1).toPandas()
    assert set(got[got.t < 3].pl) == {"a"} and set(got[got.t >= 3].pl) == {"b"}
    assert (got.groupby("t").p.sum() - 1).abs().max() < 1e-5


def test_wnd5_in_chunks_is_the_same(spark, monkeypatch):
    from lumenframe.operators import classify

    df = embedding_samples(spark, SF).where("sample_id < 120")
    whole = wnd5(df, df, top=9).toPandas()
    one, by = classify.one_split(df), classify.model(df, 9)  # one model: sums of doubles differ in their last bits
    near = classify.nearest(one, one, by, 4).toPandas()
    monkeypatch.setattr(classify, "CHUNK_ROWS", 37)
    monkeypatch.setattr(classify, "BLOCK_ROWS", 25)
    parts = wnd5(df, df, top=9).toPandas()
    assert rows(whole) == rows(parts)
    assert rows(near) == rows(classify.nearest(one, one, by, 4).toPandas())


def test_wnd5_takes_null_ragged_and_unreal_features(spark):
    vectors = [[0.0, 5.0], [1.0, None], [0.5], None, [10.0, float("nan")], [11.0, 5.0], [10.5, 4.0]]
    df = spark.createDataFrame([(i, "aaaabbb"[i], float(i), i, 0, v) for i, v in enumerate(vectors)], "sample_id long, label string, value double, grp long, seq int, features array<double>")
    got = wnd5(df, df, top=1).toPandas()
    assert set(got.t) == set(range(7)) and set(got[got.t.isin([0, 1, 2])].pl) == {"a"} and set(got[got.t > 3].pl) == {"b"}
    assert wnd5(df.limit(0), df, top=1).count() == 0


def test_plans_never_join_features_of_all_samples(spark):
    for name in ("A10_marginal", "R3_shuffle_split", "J11_similarity_map"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "posexplode" not in plan, name
