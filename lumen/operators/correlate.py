"""Correlation matrices and Pearson tests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumen.functions.special import pearson_pvalue
from lumen.operators.filters import existing
from lumen.schema import CORR_PARTNERS, EXTENDED, PHYSICAL, UVB

# Rows looked at for a value of each column to subtract (any value serves; one of the data's
# own keeps the sums of squares from cancelling).
LOOK = 1000


def pair_stats(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pair index ``_p``, r, n) for each column pair over its complete rows, in one pass.

    Rows are grouped by which of the columns they lack (at most 2^columns groups), with the
    count and the Gram sums of the others; a pair adds up the groups that lack neither side. The
    plan is the same for any number of pairs and no row is expanded. NaN counts as missing.
    """
    cols = list(dict.fromkeys(c for p in pairs for c in p))
    k, at = len(cols), {c: i for i, c in enumerate(cols)}
    rows = df.selectExpr(*[f"CASE WHEN NOT isnan(double(`{c}`)) THEN double(`{c}`) END AS v{i}" for i, c in enumerate(cols)])
    seen = rows.limit(LOOK).selectExpr(*[f"first(v{i}, true) AS v{i}" for i in range(k)]).first()
    rows = rows.selectExpr("concat(" + ", ".join(f"int(v{i} IS NULL)" for i in range(k)) + ") AS lack",
                           *[f"coalesce(v{i} - {'0D' if s is None else repr(float(s)) + 'D'}, 0D) AS v{i}" for i, s in enumerate(seen)])
    inner = [(i, j) for i in range(k) for j in range(i, k)]
    listed = lambda parts: "array(" + ", ".join(parts) + ")"
    groups = rows.groupBy("lack").agg(
        F.count(F.lit(1)).alias("n"), F.expr(listed(f"sum(v{i})" for i in range(k)) + " AS s"),
        F.expr(listed(f"min(v{i})" for i in range(k)) + " AS lo"), F.expr(listed(f"max(v{i})" for i in range(k)) + " AS hi"),
        F.expr(listed(f"sum(v{i} * v{j})" for i, j in inner) + " AS q"))
    place = {p: n for n, p in enumerate(inner)}
    wanted = [[p, i, j, place[i, i], place[j, j], place[min(i, j), max(i, j)]] for p, (i, j) in enumerate((at[a], at[b]) for a, b in pairs)]
    cells = groups.withColumn("w", F.explode(F.lit(wanted))).where("substr(lack, w[1] + 1, 1) = '0' AND substr(lack, w[2] + 1, 1) = '0'")
    total = cells.groupBy(F.expr("w[0]").alias("_p")).agg(
        F.sum("n").alias("n"), *[F.expr(f"{f}({a}[w[{i}]]) AS {name}") for name, f, a, i in (
            ("sx", "sum", "s", 1), ("sy", "sum", "s", 2), ("xx", "sum", "q", 3), ("yy", "sum", "q", 4), ("xy", "sum", "q", 5),
            ("lx", "min", "lo", 1), ("ly", "min", "lo", 2), ("hx", "max", "hi", 1), ("hy", "max", "hi", 2))])
    r = total.selectExpr("_p", "n", "lx < hx AND ly < hy AS varies", "xx - sx * sx / n AS dx", "yy - sy * sy / n AS dy", "xy - sx * sy / n AS dxy")
    r = r.selectExpr("_p", "n", "CASE WHEN varies AND dx > 0 AND dy > 0 THEN greatest(-1D, least(1D, dxy / (sqrt(dx) * sqrt(dy)))) END AS r")
    none = df.sparkSession.createDataFrame(pa.table({"_p": pa.array(range(len(pairs)), pa.int32())}))
    return none.join(r, "_p", "left").select("_p", "r", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _names(idx: str, names: list[str]):
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col(idx) + 1)


def corr_matrix(df: DataFrame, columns: list[str] = PHYSICAL,
                digits: int | None = None, min_columns: int = 2) -> DataFrame:
    """Pairwise-complete Pearson matrix in long form (var_x, var_y, r)."""
    cols = existing(df, columns)
    if len(cols) < min_columns:
        raise ValueError(f"need at least {min_columns} of {columns}, found {cols}")
    upper = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    stats = pair_stats(df, [(cols[i], cols[j]) for i, j in upper])
    ij = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in upper])
    both = stats.select("r", F.element_at(ij, F.col("_p") + 1).alias("c")).select(
        "r", F.explode(F.array_distinct(F.array(
            F.struct(F.col("c.i").alias("a"), F.col("c.j").alias("b")),
            F.struct(F.col("c.j").alias("a"), F.col("c.i").alias("b"))))).alias("m"))
    out = both.select(_names("m.a", cols).alias("var_x"), _names("m.b", cols).alias("var_y"), "r")
    if digits is not None:
        out = out.withColumn("r", F.bround("r", digits))
    return out


def corr_extended(df: DataFrame, digits: int = 2) -> DataFrame:
    """The matrix over the six extended variables, two decimals."""
    return corr_matrix(df, EXTENDED, digits=digits)


def pearson_table(df: DataFrame, target: str = UVB, partners: list[str] = CORR_PARTNERS,
                  with_p: bool = True, min_n: int = 2) -> DataFrame:
    """R, complete-pair n and two-sided p of ``target`` with each partner.

    The sums are one pass (``pair_stats``); the p-value is evaluated on the
    result rows only. Fewer than ``min_n`` pairs (T2 asks for 3), or a constant column,
    give null; two pairs give r = 1 or -1 and p = 1.
    """
    cols = existing(df, partners)
    stats = pair_stats(df, [(target, v) for v in cols])
    out = stats.select(_names("_p", cols).alias("variable"),
                       F.when(F.col("n") >= min_n, F.col("r")).alias("r"), "n")
    if with_p:
        out = out.withColumn("p", pearson_pvalue(F.col("r"), F.col("n").cast("double")))
    return out
