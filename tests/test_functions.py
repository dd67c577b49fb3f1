"""Scalar expressions and p-value helpers (X1-X4, X7, traps 1, 4, 5, 7, 9, 12)."""

import math

from pyspark.sql import functions as F

from lumen.functions.calendar import (MONTH_LABELS, SEASON_ORDER, derive_timestamp,
                                      month_label, season)
from lumen.functions.numeric import high_label, is_valid, safe_corr
from lumen.functions.special import betainc, f_sf, normal_quantile_sql, pearson_p, shapiro_p


def test_season_null_and_out_of_range_go_to_spring(spark):
    df = spark.createDataFrame([(m,) for m in [1, 2, 3, 5, 6, 8, 9, 11, 12, None, 13]], "MO int")
    got = [r[0] for r in df.select(season("MO")).collect()]
    su, au, wi, sp = SEASON_ORDER
    assert got == [su, su, au, au, wi, wi, sp, sp, su, sp, sp]


def test_month_label_safe_under_ansi(spark):
    df = spark.createDataFrame([(1,), (12,), (13,), (None,)], "MO int")
    assert [r[0] for r in df.select(month_label("MO")).collect()] == \
        [MONTH_LABELS[0], MONTH_LABELS[11], None, None]


def test_timestamp_feb29_is_null_with_base_year_2025(spark):
    df = spark.createDataFrame([(2, 29, 5), (2, 28, 23), (4, 31, 0), (None, 1, 1)], "MO int, DY int, HR int")
    got = [r[0] for r in df.select(derive_timestamp()).collect()]
    assert got[0] is None and got[2] is None and got[3] is None
    assert str(got[1]) == "2025-02-28 23:00:00"


def test_nan_is_not_valid_and_nan_gt_zero_is_true_in_spark(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "x double")
    assert [r[0] for r in df.select(F.col("x") > 0).collect()][0] is True
    assert [r[0] for r in df.select(is_valid("x")).collect()] == [False, False, True]


def test_safe_corr_constant_column_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "x double, y double")
    assert df.agg(safe_corr("x", "y")).first()[0] is None


def test_safe_corr_uses_complete_pairs_only(spark):
    rows = [(1.0, 2.0), (2.0, None), (3.0, 7.0), (4.0, 8.0), (float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = df.agg(safe_corr("x", "y")).first()[0]
    xs, ys = [1.0, 3.0, 4.0], [2.0, 7.0, 8.0]
    mx, my = sum(xs) / 3, sum(ys) / 3
    cov = sum((a - mx) * (b - my) for a, b in zip(xs, ys))
    r = cov / math.sqrt(sum((a - mx) ** 2 for a in xs) * sum((b - my) ** 2 for b in ys))
    assert abs(got - r) < 1e-12


def test_high_label_inclusive(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    assert [r[0] for r in df.select(high_label("x", F.lit(2.0))).collect()] == [0, 1, 1]


def test_bround_half_even(spark):
    df = spark.createDataFrame([(2.5,), (0.125,)], "x double")
    assert [r[0] for r in df.select(F.bround("x", 0)).collect()][0] == 2.0


def test_p_values_known():
    # F(1, 10) upper 5% point is 4.9646
    assert abs(f_sf(4.9646027, 1, 10) - 0.05) < 1e-6
    # r = 0.5, n = 10: t = 1.633, two-sided p = 0.14111
    assert abs(pearson_p(0.5, 10) - 0.1411133) < 1e-6
    assert abs(betainc(2, 3, 0.4) - 0.5248) < 1e-4
    assert pearson_p(1.0, 2) == 1.0 and math.isnan(pearson_p(0.3, 1))


def test_normal_quantile_expression(spark):
    from statistics import NormalDist

    from pyspark.sql import functions as F

    ps = [1e-12, 1e-6, 0.001, 0.024, 0.0749, 0.0751, 0.3, 0.5, 0.6, 0.975, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", F.expr(normal_quantile_sql("p")).alias("z"))
    for r in df.collect():
        assert abs(r["z"] - NormalDist().inv_cdf(r["p"])) < 1e-6 * max(1, abs(r["z"]))


def test_shapiro_p_monotone_and_bounded():
    ps = [shapiro_p(w, 50) for w in (0.80, 0.90, 0.95, 0.99)]
    assert all(0 <= p <= 1 for p in ps) and ps == sorted(ps)


def test_conform_adds_null_calendar_and_rejects_missing_required(spark):
    import pytest

    from lumen.operators.clean import MissingColumnError, conform
    df = spark.createDataFrame([(1.0, 0.5, 3)], "ALLSKY_SFC_UVB double, PRECTOTCORR double, MO int")
    out = conform(df)
    assert [f.name for f in out.schema.fields][-3:] == ["YEAR", "DY", "HR"]
    assert dict(out.dtypes)["YEAR"] == "int" and out.first()["HR"] is None
    with pytest.raises(MissingColumnError):
        conform(df.drop("PRECTOTCORR"))


def test_one_row_std_is_null_and_null_month_group_dropped(spark):
    from lumen.operators.summarize import month_table
    df = spark.createDataFrame([(1, 2.0), (2, 1.0), (2, 3.0), (None, 9.0)],
                               "MO int, ALLSKY_SFC_UVB double")
    got = {r["MO"]: r for r in month_table(df).collect()}
    assert set(got) == {1, 2} and got[1]["std"] is None and got[2]["std"] == 2 ** 0.5


def test_filter_spec_reset_and_validation(spark):
    import pytest

    from lumen.operators.filters import FilterSpec, apply_filters, filter_season, select_variable
    df = spark.createDataFrame([(1, 0.5), (4, 2.9), (7, 3.5), (12, 1.0)], "MO int, ALLSKY_SFC_UVB double")
    assert FilterSpec.reset() == FilterSpec()
    assert apply_filters(df).count() == 4                      # the default sets no range
    spec = FilterSpec(months=(1, 12, 4), value_range=(0.0, 3.0), season="verano")
    assert sorted(r["MO"] for r in apply_filters(df, spec).collect()) == [1, 12]
    with pytest.raises(ValueError):
        filter_season(df, "monsoon")
    with pytest.raises(ValueError):
        select_variable(df, "NOT_A_VARIABLE")
