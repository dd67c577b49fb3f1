"""Nothing is dropped or capped by default, and counts of 100 TB do not overflow."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumen.functions import special
from lumen.operators import correlate, distribution, evaluate, filters, prep, split
from lumen.operators.clean import conform
from lumen.schema import OBS_SCHEMA, UVB
from lumen.sources import files


def test_reset_keeps_every_row(spark):
    df = spark.createDataFrame([(1, 3.4), (1, None), (2, 0.5), (None, -1.0)], f"MO int, {UVB} double")
    assert filters.apply_filters(df, filters.FilterSpec.reset()).count() == 4
    assert filters.apply_filters(df, filters.FilterSpec(value_range=(0, 3))).count() == 1


def test_allocation_of_billions(spark):
    counts = spark.createDataFrame([(0, 4 * 10 ** 9), (1, 4 * 10 ** 9 + 1)], "label int, n_c long")
    got = {r["label"]: r["n_train"] for r in split.class_allocation(counts, "label").collect()}
    n = 8 * 10 ** 9 + 1
    assert sum(got.values()) == n - math.ceil(0.2 * n)
    assert all(abs(got[c] - 0.8 * 4 * 10 ** 9) < 2 for c in got)


def test_area_of_billions(spark):
    parts = spark.createDataFrame([(4 * 10 ** 9, 4 * 10 ** 9)], "_P long, _N long")
    assert parts.select(F.col("_P").cast("double") * F.col("_N").cast("double")).first()[0] == 1.6e19
    big = spark.range(1).select(F.lit(1).alias("label"), F.lit(0.5).alias("score"))
    assert evaluate.roc_auc(big.union(big.select(F.lit(0), F.lit(0.1)))).first()["auc"] == 1.0


def test_csv_by_header_name(spark, scratch):
    text = f"extra,{UVB},PS,MO,YEAR,PRECTOTCORR\nq,1.5,90.0,3,2024,0.2\nr,oops,91.0,,2025,\n"
    with open(f"{scratch}/x.csv", "w") as f:
        f.write(text)
    got = files.read_csv(spark, f"{scratch}/x.csv", OBS_SCHEMA)
    assert got.columns == ["YEAR", "MO", UVB, "PRECTOTCORR", "PS"]
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == [(2024, 3, 1.5, 0.2, 90.0), (2025, None, None, None, 91.0)]
    whole = conform(got)
    assert {"DY", "HR"} <= set(whole.columns) and whole.where("HR IS NULL").count() == 2
    assert files.read_csv(spark, f"{scratch}/x.csv", OBS_SCHEMA, keep_extra=True).columns[-1] == "extra"


def test_imputers_keep_fractions_and_nulls(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, 5), (None, None, None)], "a int, b int, c int")
    got = prep.MedianImputer(inputCols=["a", "b"]).fit(df).transform(df)
    assert sorted(r["a"] for r in got.collect()) == [1.0, 1.5, 2.0]
    assert got.where("b IS NOT NULL").count() == 0 and dict(got.dtypes)["a"] == "double"
    mode = prep.ModeImputer(inputCols=["b", "c"]).fit(df).transform(df)
    assert [r["c"] for r in mode.collect()] == [5, 5, 5] and mode.where("b IS NOT NULL").count() == 0
    assert dict(mode.dtypes)["c"] == "int"


def test_many_categories(spark):
    df = spark.range(10_500).select((F.col("id") * 3).alias("x"))
    model = prep.CategoryIndexer(inputCols=["x"]).fit(df)
    got = model.transform(spark.createDataFrame([(0,), (31_497,), (7,), (None,)], "x long"))
    assert {r["x"]: r["x_idx"] for r in got.collect()} == {0: 0.0, 31_497: 10_499.0, 7: 10_500.0, None: 10_500.0}


def test_two_points_correlate(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], f"{UVB} double, PS double")
    r = correlate.pearson_table(df, partners=["PS"]).first()
    assert (round(r["r"], 12), r["n"], r["p"]) == (-1.0, 2, 1.0)
    assert correlate.pearson_table(df, partners=["PS"], min_n=3).first()["r"] is None


def test_p_values_hold_their_digits_at_scale():
    for n in (1e9, 1e12, 1e13):
        assert special.f_sf(1.0, 11.0, n) == pytest.approx(0.443263, abs=2e-6)
        assert special.pearson_p(1 / math.sqrt(n), n) == pytest.approx(0.317311, abs=2e-6)
    assert special.f_sf(4.9646027, 1, 10) == pytest.approx(0.05, abs=1e-8)
    for a, b in ((0.5, 3.0), (12.0, 40.0), (2.0, 500.0), (1e5, 0.5)):
        assert special.log_beta(a, b) == pytest.approx(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b), rel=1e-9)


def test_density_with_one_far_value(spark):
    x = np.concatenate((np.linspace(0, 1, 60), [40.0]))
    df = spark.createDataFrame([(float(v),) for v in x], f"{UVB} double")
    got = [r["density"] for r in distribution.kde(df, [UVB]).orderBy("j").collect()]
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), 200)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(1) * (x.max() - x.min()) / 30 / (h * math.sqrt(2 * math.pi))
    assert np.allclose(got, want, rtol=1e-9, atol=0)
