"""Hypothesis tests grouped over variables.

All sums over the data are Spark aggregations with partial (map-side)
combining; group-level tables have one row per month or per variable. Only
the final p-values pass through a small pandas UDF on those result rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumen.functions.numeric import is_valid
from lumen.functions.special import SW_C1, SW_C2, f_pvalue, normal_quantile_sql, poly, shapiro_p
from lumen.operators.distribution import checked_broadcast
from lumen.operators.filters import long_variables
from lumen.operators.ranking import fixed, quantiles, running_totals
from lumen.schema import PHYSICAL, UVB

# Normal scores are summed one by one for this many ranks at either end and in blocks of up to
# SHORT ranks; other blocks take an integral with two correction terms, whose error, from the
# next term of the Euler-Maclaurin series, is under 1e-11 a block this far from the ends.
TAIL, SHORT = 32, 8


SHAPIRO = pa.schema([("test", pa.string()), ("variable", pa.string()), ("statistic", pa.float64()), ("p", pa.float64()), ("n", pa.int64())])


def _anova_from_groups(g: DataFrame, name: str) -> DataFrame:
    """One-way ANOVA from per-group (n_i, mean_i, var_pop_i).

    SSW = sum n_i * var_pop_i (safe for single-member groups), SSB around the
    weighted grand mean; F = (SSB/(k-1)) / (SSW/(N-k)), null when undefined.
    """
    whole = Window.partitionBy(F.lit(0))  # the group table: one row per group
    g2 = g.select("*",
                  (F.sum(F.col("n_i") * F.col("m_i")).over(whole)
                   / F.sum("n_i").over(whole)).alias("_grand"))
    t = g2.agg(F.count(F.lit(1)).alias("k"), F.sum("n_i").alias("N"),
               F.sum(F.col("n_i") * F.pow(F.col("m_i") - F.col("_grand"), 2)).alias("ssb"),
               F.sum(F.col("n_i") * F.col("v_i")).alias("ssw"))
    df1 = (F.col("k") - 1).cast("double")
    df2 = (F.col("N") - F.col("k")).cast("double")
    stat = F.try_divide(F.try_divide(F.col("ssb"), df1), F.try_divide(F.col("ssw"), df2))
    return t.select(F.lit(name).alias("test"), stat.alias("statistic"),
                    F.col("k").cast("long").alias("k"), F.col("N").cast("long").alias("N"))


def anova(df: DataFrame, group: str = "MO", value: str = UVB,
          name: str = "anova_uvb_by_month") -> DataFrame:
    """One-way ANOVA F of ``value`` across ``group`` (null groups left out)."""
    valid = df.where(F.col(group).isNotNull() & is_valid(value))
    g = valid.groupBy(group).agg(F.count(value).alias("n_i"), F.avg(value).alias("m_i"),
                                 F.var_pop(value).alias("v_i"))
    return _anova_from_groups(g, name)


def levene(df: DataFrame, group: str = "MO", value: str = UVB,
           name: str = "levene_uvb_by_month", accuracy: int | None = None) -> DataFrame:
    """T4: Levene's test centred on exact group medians (Brown-Forsythe);
    ``accuracy`` switches the medians to the one-pass sketch."""
    valid = df.where(F.col(group).isNotNull() & is_valid(value)).select(group, value)
    med = quantiles(valid, value, {"med": 0.5}, [group], accuracy=accuracy).select(group, "med")
    z = (valid.join(checked_broadcast(med), group)
              .select(group, F.abs(F.col(value) - F.col("med")).alias("z")))
    g = z.groupBy(group).agg(F.count("z").alias("n_i"), F.avg("z").alias("m_i"),
                             F.var_pop("z").alias("v_i"))
    return _anova_from_groups(g, name)


def with_f_pvalue(test: DataFrame) -> DataFrame:
    """p of an F statistic with (k-1, N-k) degrees of freedom."""
    return test.withColumn("p", f_pvalue(F.col("statistic"),
                                         (F.col("k") - 1).cast("double"),
                                         (F.col("N") - F.col("k")).cast("double")))


def sample_cap(long: DataFrame, group: str, k: int = 5000, seed: int = 42,
               key_cols: list[str] | None = None, margin_sigmas: float = 10.0) -> DataFrame:
    """Per group, the ``k`` rows with the smallest seeded hash of their key.

    Deterministic and independent of partitioning. Candidates are first cut
    by a hash threshold sized for about k + 10 sqrt(k) rows per group; a group
    that falls short is retried with a wider cut, so the result is exactly the
    k smallest hashes and each final ranking window holds a bounded group.
    """
    keys = key_cols or [c for c in long.columns if c != group]
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in keys])
    hashed = long.withColumn("_h", h)
    # hash as a uniform fraction in [0, 1)
    u = (F.col("_h").cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    # one row per group (variables): a bounded table
    sizes = fixed(hashed.groupBy(group).agg(F.count(F.lit(1)).alias("n")))
    want = k + margin_sigmas * math.sqrt(k) + 50
    cuts = fixed(sizes.select(group, "n", F.least(F.lit(1.0), F.lit(want) / F.col("n")).alias("_cut")))
    while True:
        cand = hashed.join(checked_broadcast(cuts.select(group, "_cut")), group).where(u < F.col("_cut")).drop("_cut")
        got = cand.groupBy(group).agg(F.count(F.lit(1)).alias("_got"))
        short = (F.coalesce("_got", F.lit(0)) < F.least(F.lit(k), F.col("n"))) & (F.col("_cut") < 1)
        met = fixed(cuts.join(got, group, "left").select(group, "n", "_cut", short.alias("_short")))
        if met.where("_short").isEmpty():
            break
        cuts = fixed(met.select(group, "n", F.when(F.col("_short"), F.least(F.lit(1.0), F.col("_cut") * 2))
                                .otherwise(F.col("_cut")).alias("_cut")))
    w = Window.partitionBy(group).orderBy("_h", *keys)
    return cand.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def _score_at(df: DataFrame, rank: str, name: str) -> DataFrame:
    """Adds the normal score ``name`` at the (half) rank in column ``rank`` of ``n`` rows, and
    its probability ``<name>_p``."""
    df = df.selectExpr("*", f"({rank} - 0.375D) / (n + 0.25D) AS {name}_p")
    df = df.selectExpr("*", f"{name}_p - 0.5D AS {name}_q", f"sqrt(-ln(least({name}_p, 1 - {name}_p))) AS {name}_t")
    return df.selectExpr("*", f"{normal_quantile_sql(f'{name}_p', f'{name}_q', f'{name}_t')} AS {name}").drop(f"{name}_q", f"{name}_t")


def _between(low: str, high: str) -> str:
    """SQL: the sum of the normal scores of the ranks between two half ranks with scores ``low``
    and ``high``. The scores' integral by rank is -(n + 1/4) times the normal density; the
    correction terms take their first and third derivatives."""
    density = lambda m: f"(exp(-0.5D * {m} * {m}) / {math.sqrt(2 * math.pi)!r}D)"
    slope = lambda m: f"(1 / ((n + 0.25D) * {density(m)}))"
    third = lambda m: f"(pow({slope(m)}, 3) * (1 + 2 * {m} * {m}))"
    return (f"(n + 0.25D) * ({density(low)} - {density(high)}) - ({slope(high)} - {slope(low)}) / 24 "
            f"+ ({third(high)} - {third(low)}) * {7 / 5760!r}D")


def _squares(n: int) -> float:
    """The sum of all squared normal scores of n ranks: the ends one by one, the middle by its
    integral (n + 1/4)(p - m * density) and the same correction terms."""
    score = lambda i: NormalDist().inv_cdf((i - 0.375) / (n + 0.25))
    if n <= 2 * TAIL:
        return math.fsum(score(i) ** 2 for i in range(1, n + 1))

    def parts(i: float) -> tuple[float, float, float]:
        m = score(i)
        d = math.exp(-0.5 * m * m) / math.sqrt(2 * math.pi)
        s1 = 1 / ((n + 0.25) * d)
        s2, s3 = s1 * s1 * m, s1 ** 3 * (1 + 2 * m * m)
        return (n + 0.25) * ((i - 0.375) / (n + 0.25) - m * d), 2 * m * s1, 6 * s1 * s2 + 2 * m * s3

    (a0, a1, a3), (b0, b1, b3) = parts(TAIL + 0.5), parts(n - TAIL + 0.5)
    return 2 * math.fsum(score(i) ** 2 for i in range(1, TAIL + 1)) + (b0 - a0) - (b1 - a1) / 24 + (b3 - a3) * 7 / 5760


def _shapiro_w(r: dict) -> float | None:
    """W from a variable's sums; corrected weights at either end by Royston's polynomials."""
    n = r["n"]
    if n < 3 or not r["ssx"] > 0:
        return None
    mm, rsn = _squares(n), 1 / math.sqrt(n)
    m1, m2 = (NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in (1, 2))
    ends1, ends2 = r["y1"] - r["x1"], r["y2"] - r["x2"]
    if n == 3:
        total = math.sqrt(0.5) * ends1
    else:
        a1 = poly(SW_C1, rsn) - m1 / math.sqrt(mm)
        a2, k2 = (poly(SW_C2, rsn) - m2 / math.sqrt(mm), m2) if n > 5 else (0.0, 0.0)
        scale = math.sqrt((1 - 2 * a1 ** 2 - 2 * a2 ** 2) / (mm - 2 * m1 ** 2 - 2 * k2 ** 2))
        total = scale * (r["mx"] + m1 * ends1 + k2 * ends2) + a1 * ends1 + a2 * ends2
    return min(1.0, total * total / r["ssx"])


def shapiro(df: DataFrame, columns: list[str] = PHYSICAL, sample: int | None = None, seed: int = 42,
            key_cols: list[str] | None = None) -> DataFrame:
    """T5: Shapiro-Wilk W and p per variable, over all rows unless ``sample`` asks for that
    many (seeded) rows of each.

    Weights follow Royston's AS R94: the normal scores M_i of the ranks, scaled, with two
    corrected weights at either end. Rows of equal value share a block of ranks (distributed
    running totals); the sum of a block's scores costs the same however many ranks it holds
    (``_between``), and the sum of all squared scores follows from n. The p-value's published
    range ends at 5,000 rows; beyond, it continues the same formula. Fewer than 3 rows, or no
    spread, give null.
    """
    long = long_variables(df, columns, keep=key_cols or []).where(is_valid("value"))
    if sample:
        long = sample_cap(long, "variable", sample, seed, key_cols=key_cols)
    counts = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("c"))
    held: list[DataFrame] = []
    blocks, _ = running_totals(counts, ["value"], ["c"], ["variable"], held=held)
    whole = fixed(long.groupBy("variable").agg(F.count("value").alias("n"), F.avg("value").alias("mean"),
                                               (F.var_pop("value") * F.count("value")).alias("ssx")))
    n, first, last = F.col("n"), F.col("cum_c") - F.col("c") + 1, F.col("cum_c")
    nothing = F.array().cast("array<bigint>")
    upto = lambda a, b: F.when(a <= b, F.sequence(a, F.greatest(a, b))).otherwise(nothing)
    lo, hi = F.greatest(first, F.lit(TAIL + 1).cast("long")), F.least(last, n - TAIL)
    block = hi - lo >= SHORT
    ranks = F.concat(upto(first, F.least(last, F.lit(TAIL).cast("long"))),
                     F.when(block, F.array(F.lit(0).cast("long"))).otherwise(upto(lo, hi)),
                     upto(F.greatest(first, n - (TAIL - 1), F.lit(TAIL + 1).cast("long")), last))
    rows = (blocks.join(F.broadcast(whole), "variable")      # one row per variable
            .select("variable", "n", (F.col("value") - F.col("mean")).alias("dx"), (lo - 0.5).alias("lo"), (hi + 0.5).alias("hi"),
                    F.explode(ranks).alias("i")))
    one = _score_at(rows.where("i > 0"), "i", "m").select("variable", "n", "i", "dx", "m")
    many = _score_at(_score_at(rows.where("i = 0"), "lo", "a"), "hi", "b").selectExpr("variable", "n", "i", "dx", f"{_between('a', 'b')} AS m")
    sums = one.union(many).groupBy("variable", "n").agg(F.expr("sum(m * dx) AS mx"), *[
        F.expr(f"max(CASE WHEN i = {at} THEN dx END) AS {name}") for at, name in (("1", "x1"), ("2", "x2"), ("n - 1", "y2"), ("n", "y1"))])
    found = [r.asDict() for r in sums.join(F.broadcast(whole.select("variable", "ssx")), "variable").collect()]  # one row per variable
    for d in held:
        d.unpersist()
    out = [(f"shapiro_{r['variable']}", r["variable"], w, None if w is None else shapiro_p(w, r["n"]), r["n"])
           for r in found for w in [_shapiro_w(r)]]
    return df.sparkSession.createDataFrame(pa.Table.from_pylist(
        [dict(zip(SHAPIRO.names, row)) for row in out], SHAPIRO))
