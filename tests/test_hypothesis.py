"""ANOVA, Levene, Shapiro-Wilk, sample cap (T3-T6) and Pearson."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumen.operators.correlate import corr_matrix, pearson_table
from lumen.operators.hypothesis import anova, levene, sample_cap, shapiro, with_f_pvalue


def _groups():
    rng = np.random.default_rng(2)
    return pd.DataFrame({"MO": np.repeat([1, 2, 3, 4], [30, 40, 1, 25]),
                         "v": np.concatenate([rng.normal(0, 1, 30), rng.normal(0.5, 2, 40),
                                              [3.0], rng.normal(-0.2, 1, 25)])})


def _f(groups):
    allx = np.concatenate(groups)
    k, n, gm = len(groups), len(allx), allx.mean()
    ssb = sum(len(g) * (g.mean() - gm) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    return (ssb / (k - 1)) / (ssw / (n - k))


def test_anova_matches_formula_with_single_member_group(spark):
    pdf = _groups()
    r = anova(spark.createDataFrame(pdf), "MO", "v").first()
    exp = _f([g.v.to_numpy() for _, g in pdf.groupby("MO")])
    assert abs(r["statistic"] - exp) < 1e-9 and r["k"] == 4 and r["N"] == 96


def test_levene_median_centre(spark):
    pdf = _groups()
    r = with_f_pvalue(levene(spark.createDataFrame(pdf), "MO", "v")).first()
    z = [np.abs(g.v.to_numpy() - np.median(g.v.to_numpy())) for _, g in pdf.groupby("MO")]
    assert abs(r["statistic"] - _f(z)) < 1e-9 and 0 <= r["p"] <= 1


def test_sample_cap_takes_exactly_k_smallest_hashes(spark):
    pdf = pd.DataFrame({"id": np.arange(3000), "variable": np.where(np.arange(3000) < 2500, "a", "b"),
                        "value": np.arange(3000) * 1.0})
    df = spark.createDataFrame(pdf)
    s = sample_cap(df, "variable", k=200, seed=42, key_cols=["id"]).toPandas()
    assert s.groupby("variable").size().to_dict() == {"a": 200, "b": 200}
    from pyspark.sql import functions as F
    allh = df.withColumn("_h", F.xxhash64(F.lit(42), F.col("id"))).toPandas()
    for var, sub in allh.groupby("variable"):
        assert set(s[s.variable == var]["id"]) == set(sub.nsmallest(200, "_h")["id"])


def test_shapiro_classic_example_and_normal_sample(spark):
    # Shapiro & Wilk (1965): weights of 11 men, W about 0.79
    w = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"id": np.arange(200), "A": np.r_[w, np.full(189, np.nan)],
                        "B": rng.normal(10, 2, 200)})
    got = {r["variable"]: r for r in shapiro(spark.createDataFrame(pdf), ["A", "B"], key_cols=["id"]).collect()}
    assert got["A"]["n"] == 11 and abs(got["A"]["statistic"] - 0.79) < 0.01 and got["A"]["p"] < 0.01
    assert got["B"]["n"] == 200 and got["B"]["statistic"] > 0.98 and got["B"]["p"] > 0.05


def test_shapiro_uses_all_rows_and_blocks_of_ties(spark):
    from statistics import NormalDist

    x = np.concatenate((np.random.default_rng(3).normal(0, 1, 6000).round(1), np.full(900, 0.5)))
    got = shapiro(spark.createDataFrame(pd.DataFrame({"A": x})), ["A"]).first()
    n, xs = len(x), np.sort(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u = n ** -0.5
    poly = lambda c: sum(k * u ** i for i, k in enumerate(c))
    from lumen.functions.special import SW_C1, SW_C2
    a1, a2 = poly(SW_C1) - m[0] / np.sqrt(m @ m), poly(SW_C2) - m[1] / np.sqrt(m @ m)
    a = m * np.sqrt((1 - 2 * a1 ** 2 - 2 * a2 ** 2) / (m @ m - 2 * m[0] ** 2 - 2 * m[1] ** 2))
    a[[0, 1, -2, -1]] = -a1, -a2, a2, a1
    assert got["n"] == n and abs(got["statistic"] - (a @ xs) ** 2 / ((xs - xs.mean()) ** 2).sum()) < 1e-9
    few = shapiro(spark.createDataFrame(pd.DataFrame({"A": x})), ["A"], sample=500).first()
    assert few["n"] == 500


def test_pearson_and_matrix_properties(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=300)
    pdf = pd.DataFrame({"U": x, "P": 0.5 * x + rng.normal(size=300), "C": np.ones(300)})
    df = spark.createDataFrame(pdf)
    t = {r["variable"]: r for r in pearson_table(df, "U", ["P", "C"]).collect()}
    assert abs(t["P"]["r"] - np.corrcoef(pdf.U, pdf.P)[0, 1]) < 1e-12 and t["P"]["p"] < 1e-10
    assert t["C"]["r"] is None and t["C"]["p"] is None        # constant column
    m = {(r["var_x"], r["var_y"]): r["r"] for r in corr_matrix(df, ["U", "P"]).collect()}
    assert abs(m[("U", "U")] - 1) < 1e-12 and m[("U", "P")] == m[("P", "U")]


def test_pairs_by_null_pattern_equal_numpy(spark):
    rng = np.random.default_rng(17)
    pdf = pd.DataFrame({c: rng.normal(1e6, 3, 500) for c in "abcd"})
    pdf["b"] += pdf.a
    for c in "abc":
        pdf.loc[rng.random(500) < 0.3, c] = np.nan
    pdf["k"] = 0.1
    df = spark.createDataFrame(pdf).withColumn("z", F.lit(None).cast("double"))
    got = {(r["var_x"], r["var_y"]): r["r"] for r in corr_matrix(df, ["a", "b", "c", "d", "k", "z"]).collect()}
    want = pdf[list("abcd")].corr()
    assert len(got) == 36 and all(abs(got[x, y] - want.loc[x, y]) < 1e-9 for x in "abcd" for y in "abcd")
    assert all(got[x, y] is None for x in "abcdkz" for y in "kz")
