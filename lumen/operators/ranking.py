"""Distributed order statistics, exact quantiles, running totals and numbering.

Exact ranks are needed by the median (A8, M1, M4), box statistics (A9-A11), Levene's test (T4),
the stratified split and folds (M2, M3) and the ROC figures (E3, E4). None of them may put a
whole group into one task: a month, a class or the whole table can hold a third of all rows.

Order statistics (``RankTable``, ``quantiles``) read the rows twice, whatever the groups:

1. a mergeable quantile sketch per group (KLL, partial aggregation) gives for every wanted rank
   an interval of values that holds it;
2. values inside an interval are counted one by one (ties collapse before the shuffle), all
   others only as the parts between the intervals: one aggregation gives a table of a few rows
   per group and the values of narrow intervals, with counts, sums and borders.

Ranks, means, whiskers and outlier counts are read from that table. An interval that missed
its rank (the sketch's bound holds with 99 %) is found out and widened. Values spread evenly
by construction (a seeded hash) need no sketch: the interval follows from the rank.

Running totals (``running_totals``): cells cut at approximate quantiles, totals per cell, their
prefix sums, and a window partitioned by cell for the sums (and successor values) inside it.
Spark's own ``percentile`` keeps a value->count map per group in one task and an un-partitioned
window moves all rows to one task; neither is used.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumen.functions.numeric import is_valid
from lumen.sources.files import shared_path

_ALL = "_all"
_BUCKET = "_bkt"


def _partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _cut_points(df: DataFrame, column: str, parts: int) -> list[float]:
    """``parts - 1`` increasing cut points at approximate quantiles of ``column``."""
    if parts <= 1:
        return []
    probs = [i / parts for i in range(1, parts)]
    raw = df.select(F.col(column).cast("double").alias(column)).approxQuantile(
        column, probs, 1.0 / (4 * parts))
    cuts = sorted({float(c) for c in raw if c == c and abs(c) != float("inf")})
    return cuts


# Rows of a small table (cells, requested ranks) that may reach the driver or be broadcast;
# larger ones are checkpointed and joined by shuffle.
MAX_SMALL_ROWS = 100_000
# Distinct values one task may order inside a cell; more cells are cut beyond it.
MAX_CELL_VALUES = 2_000_000


def bucketize(df: DataFrame, value_col: str, cuts: list[float]) -> DataFrame:
    """Adds ``_bkt``: the number of cut points <= value (monotone in value)."""
    if not cuts:
        return df.withColumn(_BUCKET, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    tmp = f"_{value_col}_d"
    return (Bucketizer(splits=splits, inputCol=tmp, outputCol=_BUCKET)
            .transform(df.withColumn(tmp, F.col(value_col).cast("double")))
            .drop(tmp).withColumn(_BUCKET, F.col(_BUCKET).cast("int")))


def running_totals(df: DataFrame, order_cols: Sequence[str], sum_cols: Sequence[str],
                   group_cols: Sequence[str] = (), descending: bool = False,
                   num_partitions: int | None = None, prefix: str = "cum_",
                   next_cols: Sequence[str] = (),
                   held: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Inclusive running sums of ``sum_cols`` within each group, in order of
    one numeric ``order_cols`` column; for ``next_cols`` also the value in the
    following row of the group (``next_<c>``, null on the last row).

    Rows must be unique on ``group_cols + order_cols`` and the sum columns
    non-null. Returns ``(rows with cum_* columns, per-group totals)``. The
    input and the cell totals are cached for the passes; pass ``held`` to get
    them back and unpersist them once the results are materialised.
    """
    (key,) = list(order_cols)
    sum_cols = list(sum_cols)
    g = list(group_cols) or [_ALL]
    base = df if group_cols else df.withColumn(_ALL, F.lit(0))
    base = base.persist(StorageLevel.MEMORY_AND_DISK)  # read by three passes; recomputable
    parts = _partitions(df, num_partitions)
    cuts: list[float] | None = None
    while True:  # rows are unique per (group, key): a cell's count is its width
        coarser, cuts = cuts, _cut_points(base, key, parts)
        bucketed = bucketize(base, key, cuts)
        if descending:
            bucketed = bucketed.withColumn(_BUCKET, F.lit(len(cuts)) - F.col(_BUCKET))
        # groups x cells rows: small, kept for the width check and the offsets
        pick = F.max_by if descending else F.min_by  # the cell's first row in the order
        totals = bucketed.groupBy(*g, _BUCKET).agg(
            *[F.sum(c).alias(c) for c in sum_cols], F.count(F.lit(1)).alias("_rows"),
            *[pick(c, key).alias(f"_first_{c}") for c in next_cols]
        ).persist(StorageLevel.MEMORY_AND_DISK)
        widest, cells = totals.agg(F.max("_rows"), F.count(F.lit(1))).first()
        widest = widest or 0
        # finer cuts until every cell fits, or until no two values are left to cut between
        if widest <= MAX_CELL_VALUES or not cuts or cuts == coarser:
            break
        totals.unpersist()
        parts = parts * (int(widest // MAX_CELL_VALUES) + 2)
    if held is not None:
        held += [base, totals]

    before = Window.partitionBy(*g).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    following = Window.partitionBy(*g).orderBy(_BUCKET)
    offsets = totals.select(
        *g, _BUCKET,
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_off_{c}") for c in sum_cols],
        *[F.lead(f"_first_{c}").over(following).alias(f"_nxc_{c}") for c in next_cols])
    order = F.col(key).desc() if descending else F.col(key).asc()
    cell = Window.partitionBy(*g, _BUCKET).orderBy(order)
    within = cell.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = bucketed.withColumns({
        **{f"_loc_{c}": F.sum(c).over(within) for c in sum_cols},
        **{f"_nx_{c}": F.lead(c).over(cell) for c in next_cols},
        "_last": F.lead(F.lit(1)).over(cell).isNull()})
    result = (local.join(F.broadcast(offsets) if cells <= MAX_SMALL_ROWS else offsets, [*g, _BUCKET])
                   .withColumns({
                       **{f"{prefix}{c}": F.col(f"_loc_{c}") + F.col(f"_off_{c}") for c in sum_cols},
                       **{f"next_{c}": F.when(F.col("_last"), F.col(f"_nxc_{c}"))
                                        .otherwise(F.col(f"_nx_{c}")) for c in next_cols}})
                   .drop(*[f"_loc_{c}" for c in sum_cols], *[f"_off_{c}" for c in sum_cols],
                         *[f"_nx_{c}" for c in next_cols], *[f"_nxc_{c}" for c in next_cols],
                         "_last", _BUCKET))
    group_totals = totals.groupBy(*g).agg(*[F.sum(c).alias(c) for c in sum_cols])
    if not group_cols:
        result = result.drop(_ALL)
        group_totals = group_totals.drop(_ALL)
    return result, group_totals


#: Size of a group's sketch and the rank error that it keeps with 99 %.
SKETCH, RANK_ERROR = 4096, 0.0015


def _local(df: DataFrame) -> pa.Table | None:
    """The rows of ``df`` if they are at most ``MAX_SMALL_ROWS``."""
    some = df.limit(MAX_SMALL_ROWS + 1).toArrow()
    return some if some.num_rows <= MAX_SMALL_ROWS else None


def fixed(df: DataFrame) -> DataFrame:
    """A table of results, computed now: a local relation while it is small (its size is then
    known to the planner), else a checkpoint. Nothing stays cached."""
    some = _local(df)
    return df.checkpoint() if some is None else df.sparkSession.createDataFrame(some, df.schema)


class RankTable:
    """Counts by value inside the given intervals, and by part between them.

    ``bounds`` has one row per group: the group columns and, for each of ``names``, an interval
    ``<name>_lo``, ``<name>_hi`` (null: none) of the values' type. ``table`` has one row per
    part between intervals and one per distinct value inside: ``cnt``, ``a`` and ``z`` (its
    smallest and largest value) and ``total``; for values that are no ``numbers`` a and z are
    the value, null between intervals. A small table is held here, a larger one stays in Spark.
    """

    def __init__(self, valid: DataFrame, value: str, group_cols: Sequence[str], bounds: DataFrame,
                 names: Sequence[str], numbers: bool = True) -> None:
        g = self.g = list(group_cols)
        self.numbers, self.held = numbers, []
        passed = " + ".join(f"coalesce(int({value} >= {k}_lo), 0)" for k in names)
        left = " + ".join(f"coalesce(int({value} > {k}_hi), 0)" for k in names)
        rows = valid.join(bounds.select(*g, *[f"{k}_{end}" for k in names for end in ("lo", "hi")]), g)
        rows = rows.selectExpr(*[f"`{c}`" for c in g], f"{value} AS _v", f"{passed} AS _above", f"{left} AS _beyond")
        cells = rows.selectExpr(*[f"`{c}`" for c in g], "_v", "_above + _beyond AS _part", "CASE WHEN _above > _beyond THEN _v END AS _val")
        grouped = cells.groupBy(*g, "_part", "_val")
        if numbers:
            table = grouped.agg(F.count(F.lit(1)).alias("cnt"), F.min("_v").alias("a"), F.max("_v").alias("z"), F.sum("_v").alias("total"))
        else:
            table = grouped.agg(F.count(F.lit(1)).alias("cnt")).select("*", F.col("_val").alias("a"), F.col("_val").alias("z"))
        table = table.persist(StorageLevel.MEMORY_AND_DISK)
        self.local = _local(table)
        if self.local is None:
            self.held.append(table)
            self.table = table
        else:
            table.unpersist()
            self.table = valid.sparkSession.createDataFrame(self.local, table.schema)

    def cumulated(self) -> DataFrame:
        """``table`` with ``start``, the rows of the group before it. The parts' offsets come from
        a table of a few rows per group; inside a part values are summed in order, in one task
        while they are few."""
        g = self.g
        parts = self.table.groupBy(*g, "_part").agg(F.sum("cnt").alias("_n"), F.count(F.lit(1)).alias("_rows"))
        before = Window.partitionBy(*g).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        if self.numbers and (parts.agg(F.max("_rows")).first()[0] or 0) > MAX_CELL_VALUES:
            cum, _ = running_totals(self.table.select(*g, "a", "z", "cnt"), ["a"], ["cnt"], g, held=self.held)
            return cum.withColumn("start", F.col("cum_cnt") - F.col("cnt")).drop("cum_cnt")
        offsets = parts.select(*g, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
        within = Window.partitionBy(*g, "_part").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
        placed = self.table.withColumn("_loc", F.coalesce(F.sum("cnt").over(within), F.lit(0)))
        return placed.join(offsets, [*g, "_part"]).withColumn("start", F.col("_off") + F.col("_loc")).drop("_off", "_loc")

    def at(self, ranks: DataFrame, names: Sequence[str]) -> DataFrame:
        """Per group, for each name, the value at 0-based rank ``<name>_rank`` of ``ranks`` (null:
        none), and ``missed``: whether some rank fell between the intervals."""
        ranks = ranks.select(*self.g, *[f"{k}_rank" for k in names])
        wanted = _local(ranks) if self.local is not None else None
        if wanted is not None:
            return self._at_here(wanted, names)
        inside = {k: f"start <= {k}_rank AND {k}_rank < start + cnt" for k in names}
        hit = self.cumulated().join(ranks, self.g)
        missed = " OR ".join(f"coalesce({c} AND (a IS NULL OR a <> z), false)" for c in inside.values())
        return hit.groupBy(*self.g).agg(*[F.expr(f"max(CASE WHEN {c} THEN a END) AS {k}") for k, c in inside.items()],
                                        F.expr(f"bool_or({missed}) AS missed"))

    def _at_here(self, ranks: pa.Table, names: Sequence[str]) -> DataFrame:
        """``at`` over the table held here."""
        order = [(c, "ascending") for c in [*self.g, "_part", "_val"]]
        table = self.local.sort_by(order)
        group = np.array(list(zip(*[table.column(c).to_pylist() for c in self.g])), dtype=object)
        rows: dict[tuple, list[int]] = {}
        for i, key in enumerate(map(tuple, group)):
            rows.setdefault(key, []).append(i)
        count, a, z = table.column("cnt").to_numpy(), table.column("a").to_pylist(), table.column("z").to_pylist()
        ends = {key: (at[0], np.cumsum(count[at[0]:at[-1] + 1])) for key, at in rows.items()}
        out: dict[str, list] = {k: [] for k in [*self.g, *names, "missed"]}
        for row in ranks.to_pylist():
            key = tuple(row[c] for c in self.g)
            first, end = ends.get(key, (0, np.zeros(0)))
            missed = False
            for k in names:
                r = row[f"{k}_rank"]
                i = first + int(np.searchsorted(end, r, side="right")) if r is not None and len(end) and r < end[-1] else None
                out[k].append(None if i is None else a[i])
                missed |= i is not None and (a[i] is None or a[i] != z[i])
            for c in self.g:
                out[c].append(row[c])
            out["missed"].append(missed)
        kinds = {**{c: ranks.schema.field(c).type for c in self.g}, **{k: table.schema.field("a").type for k in names}, "missed": pa.bool_()}
        return self.table.sparkSession.createDataFrame(pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()}))

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def _sketched(valid: DataFrame, value: str, g: list[str], probs: Mapping[str, float], error: float) -> DataFrame:
    """Per group: n, and for each prob its interval and the two ranks it is interpolated between."""
    sketch = valid.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value), F.lit(SKETCH)).alias("s"))
    e = error + 2 / SKETCH
    at = lambda r: F.kll_sketch_get_quantile_double(F.col("s"), F.lit(max(0.0, min(1.0, r))))
    # a small group's values are all counted one by one
    end = lambda r, small: F.when(F.col("n") <= SKETCH, at(small)).otherwise(at(r))
    cols = []
    for k, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n") - 1)
        cols += [end(p - e, 0.0).alias(f"{k}_lo"), end(p + e, 1.0).alias(f"{k}_hi"),
                 pos.alias(f"{k}_pos"), F.floor(pos).cast("long").alias(f"{k}_floor_rank"), F.ceil(pos).cast("long").alias(f"{k}_ceil_rank")]
    return fixed(sketch.select(*g, "n", *cols))


def rank_table(df: DataFrame, value_col: str, probs: Mapping[str, float], group_cols: Sequence[str],
               whis: float | None = None) -> tuple[DataFrame, RankTable]:
    """(group columns, n, exact quantiles) and the table they were read from. With ``whis`` and
    probs q1 and q3, the table also lists the values around both fences q1 - whis * IQR and
    q3 + whis * IQR one by one, so nothing that depends on a fence needs the rows again."""
    g = list(group_cols)
    valid = df.where(is_valid(value_col)).select(*g, F.col(value_col).cast("double").alias(value_col))
    error = RANK_ERROR
    while True:
        bounds = _sketched(valid, value_col, g, probs, error)
        names = list(probs)
        if whis is not None:
            l1, h1, l3, h3 = (F.col(c) for c in ("q1_lo", "q1_hi", "q3_lo", "q3_hi"))
            slack = (F.abs(l1) + F.abs(h3)) * 1e-9
            bounds = bounds.withColumns({
                "below_lo": l1 * (1 + whis) - h3 * whis - slack, "below_hi": h1 * (1 + whis) - l3 * whis + slack,
                "above_lo": l3 * (1 + whis) - h1 * whis - slack, "above_hi": h3 * (1 + whis) - l1 * whis + slack})
            names += ["below", "above"]
        table = RankTable(valid, value_col, g, bounds, names)
        ends = [f"{k}_{end}" for k in probs for end in ("floor", "ceil")]
        hits = table.at(bounds.select(*g, *[f"{e}_rank" for e in ends]), ends)
        found = fixed(hits.join(bounds.select(*g, "n", *[f"{k}_pos" for k in probs]), g).select(*g, "n", *[
            (F.col(f"{k}_floor") + (F.col(f"{k}_pos") - F.floor(f"{k}_pos")) * (F.col(f"{k}_ceil") - F.col(f"{k}_floor"))).alias(k)
            for k in probs], "missed"))
        if found.where("missed").isEmpty():
            return found.drop("missed"), table
        table.release()
        error *= 8


def quantiles(df: DataFrame, value_col: str, probs: Mapping[str, float],
              group_cols: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (NumPy/pandas default).

    Output: group columns, ``n`` and one column per entry of ``probs``.
    Groups with no valid value are absent. With ``accuracy`` the quantiles are
    approximate instead (``percentile_approx``: one pass, a sketch of bounded
    size per group, rank error about n / accuracy, values taken from the data).
    """
    g = list(group_cols)
    names = list(probs)
    if accuracy is not None:
        valid = df.where(is_valid(value_col))
        arr = F.percentile_approx(value_col, [float(probs[k]) for k in names], accuracy)
        out = valid.groupBy(*g).agg(F.count(F.lit(1)).alias("n"), arr.alias("_q"))
        return out.select(*g, "n", *[F.col("_q")[i].alias(k) for i, k in enumerate(names)])
    base = df if g else df.withColumn(_ALL, F.lit(0))
    found, table = rank_table(base, value_col, probs, g or [_ALL])
    table.release()
    return found if g else found.drop(_ALL)


def sorted_numbers(df: DataFrame, group_cols: Sequence[str], value_col: str, name: str) -> DataFrame:
    """Adds ``name``: each row's 0-based place in its group by ``value_col`` (rows unique on both).

    A range sort deals the rows, places are counted inside the tasks, and a table of one row per
    (group, task) gives each task's offset; no task holds a group. The sorted rows are written
    to the shared folder first, since a range sort may be cut elsewhere when it runs again."""
    spark, g = df.sparkSession, list(group_cols)
    path = shared_path(spark, "sorted")
    order = [*g, value_col]
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
       .withColumn("_id", F.monotonically_increasing_id()).write.parquet(path))
    rows = spark.read.parquet(path).withColumn("_task", F.shiftright("_id", 33))
    runs = rows.groupBy(*g, "_task").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy(*g).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*g, "_task", "_first", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_off"))
    return rows.join(runs, [*g, "_task"]).withColumn(name, F.col("_id") - F.col("_first") + F.col("_off")).drop(
        "_id", "_task", "_first", "_off")
