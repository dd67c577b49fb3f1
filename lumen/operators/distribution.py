"""Distributions: box statistics, outliers, histogram, kernel density."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.functions.numeric import is_valid
from lumen.operators.filters import long_variables
from lumen.operators.ranking import fixed, quantiles, rank_table
from lumen.schema import PHYSICAL

# Broadcast only what is proven small: per-group tables of low-cardinality keys.
MAX_BROADCAST_ROWS = 100_000
# exp(-z^2 / 2) is exactly 0 in double precision beyond this z.
ZERO_TERM = 39.0
# Moments of a box in the fast Gauss transform.
TERMS = 24


def checked_broadcast(small: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``small`` only after counting it; else let Spark shuffle-join."""
    return F.broadcast(small) if small.count() <= limit else small


def box_stats(df: DataFrame, group: str, value: str, whis: float = 1.5,
              accuracy: int | None = None) -> DataFrame:
    """Quartiles, whiskers at the last datum within ``whis`` IQR, flier counts.

    Whiskers follow the usual box-plot rule: the lowest datum >= q1 - whis*IQR
    (q1 if that lies above q1), the highest datum <= q3 + whis*IQR (q3 if below
    q3). Fliers are the data outside the whiskers, i.e. outside the fences.
    Quartiles are exact unless ``accuracy`` asks for the one-pass sketch.
    """
    valid = df.where(F.col(group).isNotNull() & is_valid(value)).select(group, value)
    probs = {"q1": 0.25, "med": 0.5, "q3": 0.75}
    if accuracy is None:
        q, ranks = rank_table(valid, value, probs, [group], whis=whis)
        cells = ranks.table
    else:
        q, ranks = fixed(quantiles(valid, value, probs, [group], accuracy=accuracy)), None
        x = F.col(value)
        cells = valid.select(group, F.lit(1).cast("long").alias("cnt"), x.alias("a"), x.alias("z"), x.alias("total"))
    lo = F.col("q1") - F.lit(whis) * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + F.lit(whis) * (F.col("q3") - F.col("q1"))
    fences = q.select(group, lo.alias("_lo"), hi.alias("_hi"))
    # every cell lies on one side of both fences, or is a single value
    per_group = (cells.join(checked_broadcast(fences), group)
                 .groupBy(group)
                 .agg((F.sum("total") / F.sum("cnt")).alias("mean"),
                      F.min(F.when(F.col("a") >= F.col("_lo"), F.col("a"))).alias("_wlo"),
                      F.max(F.when(F.col("z") <= F.col("_hi"), F.col("z"))).alias("_whi"),
                      F.sum(F.when(F.col("z") < F.col("_lo"), F.col("cnt")).otherwise(0)).alias("fliers_low"),
                      F.sum(F.when(F.col("a") > F.col("_hi"), F.col("cnt")).otherwise(0)).alias("fliers_high")))
    out = fixed(q.join(per_group, group).select(
        group, "n", "mean", "q1", "med", "q3", (F.col("q3") - F.col("q1")).alias("iqr"),
        F.when(F.col("_wlo").isNull() | (F.col("_wlo") > F.col("q1")), F.col("q1"))
         .otherwise(F.col("_wlo")).alias("whislo"),
        F.when(F.col("_whi").isNull() | (F.col("_whi") < F.col("q3")), F.col("q3"))
         .otherwise(F.col("_whi")).alias("whishi"),
        "fliers_low", "fliers_high"))
    if ranks is not None:
        ranks.release()
    return out


def box_outliers(df: DataFrame, group: str, value: str, keep: list[str],
                 whis: float = 1.5, accuracy: int | None = None) -> DataFrame:
    """The flier rows themselves (group, kept columns, value, side)."""
    valid = df.where(F.col(group).isNotNull() & is_valid(value))
    q = quantiles(valid.select(group, value), value, {"q1": 0.25, "q3": 0.75}, [group],
                  accuracy=accuracy)
    fences = q.select(group,
                      (F.col("q1") - F.lit(whis) * (F.col("q3") - F.col("q1"))).alias("_lo"),
                      (F.col("q3") + F.lit(whis) * (F.col("q3") - F.col("q1"))).alias("_hi"))
    x = F.col(value)
    return (valid.join(checked_broadcast(fences), group)
                 .where((x < F.col("_lo")) | (x > F.col("_hi")))
                 .select(group, *keep, value,
                         F.when(x < F.col("_lo"), F.lit("low")).otherwise(F.lit("high")).alias("side")))


def _edges(long: DataFrame) -> DataFrame:
    """Per-variable n, mean, std and histogram range (NumPy widens a zero range by 0.5)."""
    s = long.groupBy("variable").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    same = F.col("vmin") == F.col("vmax")
    return s.select("*",
                    F.when(same, F.col("vmin") - 0.5).otherwise(F.col("vmin")).alias("lo"),
                    F.when(same, F.col("vmax") + 0.5).otherwise(F.col("vmax")).alias("hi"))


def histogram(df: DataFrame, columns: list[str] = PHYSICAL, bins: int = 30) -> DataFrame:
    """Equal-width bins from min to max, last bin closed; all bins listed.

    One pass for all variables: ``unpivot`` to (variable, value), one
    partial aggregation on (variable, bin). The per-variable range table has
    one row per variable.
    """
    long = long_variables(df, columns).where(is_valid("value"))
    edges = _edges(long)
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    b = F.least(F.lit(bins - 1),
                F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(bins))
                ).cast("int")
    counts = (long.join(F.broadcast(edges.select("variable", "lo", "hi")), "variable")
                  .groupBy("variable", b.alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    axis = edges.select("variable", "lo", "hi",
                        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (axis.join(counts, ["variable", "bin"], "left")
                .select("variable", "bin",
                        (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                        F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def _powers(df: DataFrame, keys: list[str], last: int) -> DataFrame:
    """Adds ``t2`` .. ``t<last>``: powers of column ``t1``, each one product of two lower ones."""
    have = 1
    while have < last:
        top = min(2 * have, last)
        df = df.selectExpr(*keys, *[f"t{k}" for k in range(1, have + 1)], *[f"t{have} * t{k - have} AS t{k}" for k in range(have + 1, top + 1)])
        have = top
    return df


def kde(df: DataFrame, columns: list[str] = PHYSICAL, gridsize: int = 200, bins: int = 30,
        exact: bool = False) -> DataFrame:
    """Gaussian KDE on ``gridsize`` points from min to max, Scott bandwidth
    ``std * n^(-1/5)``, scaled to counts (x n x histogram bin width).

    A fast Gauss transform: values are summed, by partial aggregation, into boxes half a
    bandwidth wide as moments of their distance from the box's centre, and every grid point adds
    the boxes' Hermite series. With ``TERMS`` moments a value's term is wrong by less than
    1e-24 * exp(-z^2 / 4), z its distance in bandwidths, beside rounding. No row is shuffled.
    ``exact`` adds the terms of all distinct values instead (only those that are exactly 0 in
    double precision, beyond ZERO_TERM bandwidths, are not evaluated).
    Variables with zero spread have no density and no rows.
    """
    long = long_variables(df, columns).where(is_valid("value"))
    e = fixed(_edges(long).select(
        "variable", "n", "vmin", "vmax",
        (F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"),
        ((F.col("vmax") - F.col("vmin")) / F.lit(gridsize - 1)).alias("step"),
        ((F.col("vmax") - F.col("vmin")) / F.lit(bins)).alias("binw"),
    ).where((F.col("h") > 0) & (F.col("vmax") > F.col("vmin"))))
    h, step, lo = F.col("h"), F.col("step"), F.col("vmin")
    if exact:
        boxes = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("_w")).join(F.broadcast(e), "variable")
        boxes = boxes.withColumn("c", F.col("value"))
    else:
        placed = long.join(F.broadcast(e), "variable").withColumn("box", F.floor((F.col("value") - lo) / (h / 2)))
        centre = lo + (F.col("box") + 0.5) * (h / 2)
        moved = _powers(placed.select("variable", "box", ((F.col("value") - centre) / (h * math.sqrt(2.0))).alias("t1")),
                        ["variable", "box"], TERMS - 1)
        moments = ", ".join(["double(count(1))"] + [f"sum(t{k}) / {float(math.factorial(k))!r}D" for k in range(1, TERMS)])
        boxes = moved.groupBy("variable", "box").agg(F.expr(f"array({moments}) AS _w")).join(F.broadcast(e), "variable").withColumn("c", centre)
    reach = ZERO_TERM + (0.0 if exact else 0.25)
    j_lo = F.greatest(F.lit(0), F.ceil((F.col("c") - F.lit(reach) * h - lo) / step)).cast("int")
    j_hi = F.least(F.lit(gridsize - 1), F.floor((F.col("c") + F.lit(reach) * h - lo) / step)).cast("int")
    met = (boxes.where(j_lo <= j_hi).select("variable", "_w", "h", "step", "vmin", "c", F.explode(F.sequence(j_lo, j_hi)).alias("j"))
           .withColumn("z", (F.col("j") * step + lo - F.col("c")) / h))
    if exact:
        term = F.col("_w") * F.exp(F.lit(-0.5) * F.col("z") * F.col("z"))
    else:
        u = F.col("z") / math.sqrt(2.0)
        # Hermite functions by their recurrence: (k, function k - 1, function k, sum so far)
        state = F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("a"), F.exp(-u * u).alias("b"), F.lit(0.0).alias("s"))
        term = F.aggregate("_w", state, lambda acc, m: F.struct(
            (acc["k"] + 1).alias("k"), acc["b"].alias("a"), (2 * u * acc["b"] - 2 * acc["k"] * acc["a"]).alias("b"),
            (acc["s"] + m * acc["b"]).alias("s")), lambda acc: acc["s"])
    contrib = met.withColumn("_t", term).groupBy("variable", "j").agg(F.sum("_t").alias("_s"))
    axis = e.select("variable", "h", "step", "vmin", "binw",
                    F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("j"))
    scale = F.col("binw") / (F.col("h") * F.lit(math.sqrt(2.0 * math.pi)))
    return (axis.join(contrib, ["variable", "j"], "left")
                .select("variable", "j", (F.col("j") * F.col("step") + F.col("vmin")).alias("x"),
                        (scale * F.coalesce("_s", F.lit(0.0))).alias("density")))
