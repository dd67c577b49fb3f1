"""Mixing sources to target weights, in DataFrame operations only.

Tokens are summed per source, the targets are levelled under their caps, and each
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose
probability is the fraction of its source's rate. Only the table of sources (one
row each) is joined back; it is broadcast if it is counted small, else shuffled,
where a hot source is split by adaptive skew handling.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumen.llm.common import WORD, materialize, read_table, unit_hash

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: A table of sources is broadcast up to this many rows.
BROADCAST_ROWS = 50_000
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered_sources(sources: DataFrame) -> DataFrame:
    """Sources with ``place``, their rank by code point from 0, null last. A range
    sort fixes the order; ranks are positions in the partition plus the sizes of
    the partitions before, so no task holds all sources."""
    placed = materialize(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = (placed.groupBy("part").agg(F.count("*").alias("n"))       # one row per partition
              .select("part", F.coalesce(F.sum("n").over(
                  Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return (placed.withColumn("rank", rank).join(F.broadcast(before), "part")
            .withColumn("place", F.col("before") + F.col("rank") - 1).drop("part", "rank", "before"))


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size).

    All sources together keep their total. Weights repeat along the sources by
    code point, null last. A target stops at ``max_repeats`` times its source's
    size and the excess goes to the others by weight, until none is above: each
    round is one distributed sum over the table of sources, and rounds end when
    no further source reaches its cap.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = materialize(numbered_sources(sources).withColumn("weight", weight.cast("long")).drop("place"))
    cap = F.col("source_size") * max_repeats
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped_before = None, -1
    while True:
        below = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        row = table.agg(F.sum(F.when(below, cap).otherwise(0)).alias("fixed"),
                        F.sum(F.when(below, 0).otherwise(F.col("weight"))).alias("open"),
                        F.count(F.when(below, 1)).alias("capped")).first()
        if not row["open"] or row["capped"] == capped_before:
            break
        level, capped_before = (total - row["fixed"]) / row["open"], row["capped"]
    share = F.col("weight") * F.lit(float(level or 0.0))
    target = F.when(cap <= share, cap.cast("double")).otherwise(share.cast("double"))
    return table.select("source", "source_size", target.alias("target"),
                        F.coalesce(F.try_divide(target, F.col("source_size")), F.lit(0.0)).alias("rate"))


def copies(rate: Column, draw: Column) -> Column:
    """floor(rate), and one more where the draw in [0, 1) is under the fraction."""
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Join the table of sources to ``rows`` on ``source``, null to null."""
    named = targets.select(F.col("source").alias("__source"), "source_size", "target", "rate")
    if named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    return rows.join(named, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def row_draw(seed: str = SEED) -> Column:
    return unit_hash(F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), seed=seed)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS,
        seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source and any other columns) with each row emitted
    as often as the mix takes it; columns stay as they are.

    Null text has size 0; null sources are one source, placed last. A source
    without words has rate 0, so its documents (which have no word) are not
    emitted. Repeated rows get equal draws. An empty table gives an empty mix.
    """
    own = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns)]
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    targets = source_targets(sized, weights, max_repeats)
    taken = with_targets(docs.select("source", row_draw(seed).alias("draw"), *own), targets)
    n = copies(F.col("rate"), F.col("draw")).cast("int")
    return (taken.withColumn("__n", n).where(F.col("__n") > 0)
            .withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__n"))))
            .select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)]))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    thin = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                                   row_draw().alias("draw")))
    n = copies(F.col("rate"), F.col("draw"))
    return (with_targets(thin, source_targets(thin))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * n).alias("taken"),
                    n.alias("copies")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mixed documents, copies included, same columns."""
    return mix(docs)


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, text,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size,
         CAST('0x' || substr(md5('{SEED}' || '|' || coalesce(CAST(doc_id AS VARCHAR), '\\N') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT)
           / 4503599627370496.0::DOUBLE AS draw
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source),
ord AS (
  SELECT *, sum(w) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) - w AS w_before,
         sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING) - 3 * source_size AS cap_before
  FROM src),
lev AS (
  SELECT *, (((SELECT sum(source_size) FROM src) - cap_before)::DOUBLE / ((SELECT sum(w) FROM src) - w_before)::DOUBLE) AS lam FROM ord),
cut AS (SELECT min(lam) FILTER (WHERE 3 * source_size > w * lam) AS lam FROM
        (SELECT * FROM lev WHERE 3 * source_size > w * lam ORDER BY 3.0 * source_size / w, source NULLS LAST LIMIT 1)),
tgt AS (
  SELECT source, source_size,
         CASE WHEN 3 * source_size <= w * coalesce((SELECT lam FROM cut), 1e300) THEN (3 * source_size)::DOUBLE
              ELSE w * (SELECT lam FROM cut) END AS target FROM src),
rated AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / source_size::DOUBLE END AS rate FROM tgt)
SELECT d.doc_id, d.size::BIGINT AS size, r.source_size, r.target,
       (d.size * (floor(r.rate)::BIGINT + CASE WHEN d.draw < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken,
       (floor(r.rate)::BIGINT + CASE WHEN d.draw < r.rate - floor(r.rate) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
"""
