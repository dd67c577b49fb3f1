"""Box statistics, histogram, KDE against brute-force NumPy."""

import math

import numpy as np
import pandas as pd

from lumen.operators.distribution import box_stats, histogram, kde


def _box_np(x, whis=1.5):
    x = np.sort(np.asarray(x, float))
    q1, med, q3 = np.percentile(x, [25, 50, 75])
    iqr = q3 - q1
    lo, hi = q1 - whis * iqr, q3 + whis * iqr
    wlo = x[x >= lo]
    whi = x[x <= hi]
    whislo = q1 if len(wlo) == 0 or wlo.min() > q1 else wlo.min()
    whishi = q3 if len(whi) == 0 or whi.max() < q3 else whi.max()
    return dict(q1=q1, med=med, q3=q3, whislo=whislo, whishi=whishi,
                fl=int(((x < whislo) | (x > whishi)).sum()))


def test_box_stats_match_boxplot_rule(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(1, 4, 600),
                        "v": np.concatenate([rng.normal(0, 1, 590), rng.normal(0, 8, 10)])})
    got = {r["g"]: r for r in box_stats(spark.createDataFrame(pdf), "g", "v").collect()}
    for g, sub in pdf.groupby("g"):
        e = _box_np(sub.v)
        r = got[g]
        for k in ("q1", "med", "q3", "whislo", "whishi"):
            assert abs(r[k] - e[k]) < 1e-12, k
        assert r["fliers_low"] + r["fliers_high"] == e["fl"]
        assert r["n"] == len(sub)


def test_histogram_counts_sum_to_n_and_max_in_last_bin(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"A": rng.gamma(2, 1, 500), "B": np.full(500, 7.0)})
    h = histogram(spark.createDataFrame(pdf), ["A", "B"], bins=30).toPandas()
    for var, sub in h.groupby("variable"):
        assert len(sub) == 30 and sub["count"].sum() == 500
    a = h[h.variable == "A"].sort_values("bin")
    counts, _ = np.histogram(pdf.A, bins=30)
    assert a["count"].tolist() == counts.tolist()
    b = h[h.variable == "B"]          # constant column: NumPy's +-0.5 range, middle bin
    assert int(b[b["count"] == 500]["bin"].iloc[0]) == 15


def test_kde_equals_all_pairs_sum(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(1, 2, 400)
    d = kde(spark.createDataFrame(pd.DataFrame({"A": x})), ["A"], gridsize=200, bins=30)
    got = d.toPandas().sort_values("j")
    n, std = len(x), x.std(ddof=1)
    h = std * n ** (-0.2)
    grid = np.linspace(x.min(), x.max(), 200)
    dens = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(1) / (n * h * math.sqrt(2 * math.pi))
    exp = dens * n * (x.max() - x.min()) / 30
    assert np.allclose(got["density"].to_numpy(), exp, rtol=1e-9, atol=1e-12)
    assert np.allclose(got["x"].to_numpy(), grid, rtol=1e-12)


def test_box_stats_and_density_of_many_rows_read_them_twice(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 40_000), "v": np.concatenate((rng.normal(0, 1, 39_000), rng.standard_cauchy(1_000)))})
    df = spark.createDataFrame(pdf)
    for r in box_stats(df, "g", "v").collect():
        sub = pdf[pdf.g == r["g"]].v
        e = _box_np(sub)
        assert all(abs(r[k] - e[k]) < 1e-12 for k in ("q1", "med", "q3", "whislo", "whishi"))
        assert r["fliers_low"] + r["fliers_high"] == e["fl"] and abs(r["mean"] - sub.mean()) < 1e-9
    a, b = (kde(df, ["v"], exact=e).orderBy("j").toPandas()["density"].to_numpy() for e in (False, True))
    assert np.allclose(a, b, rtol=1e-8, atol=1e-12)
