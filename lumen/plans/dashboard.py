"""The analysis behind the dashboard, end to end, as Spark result frames.

Load (database, else CSV) -> conform -> clean once (persisted) -> every
summary, distribution, correlation, test and, optionally, the model run.
Each value of the returned dict is an independent lazy DataFrame; nothing is
computed on the driver. ``python -m lumen.plans.dashboard`` writes them all
as Parquet below an output folder.
"""

from __future__ import annotations

import argparse

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from lumen.operators import correlate, distribution, hypothesis, ordering, summarize
from lumen.operators.clean import clean_positive, conform
from lumen.plans import report
from lumen.schema import PHYSICAL, PRECIP, PS, UVB


def analyse(spark: SparkSession, observations: DataFrame,
            key_cols: list[str] | None = None) -> dict[str, DataFrame]:
    conformed = conform(observations)
    clean = clean_positive(conformed).persist(StorageLevel.MEMORY_AND_DISK)
    timed = ordering.with_time(clean)
    window = ordering.first_days(timed, "fecha_hora", UVB, days=7)
    out = {
        # SQL report on the stored table, as loaded (A1-A3)
        **{f"report_{k}": v for k, v in report.report(spark, conformed).items()},
        "kpis": summarize.kpis(clean),
        "month_table": summarize.month_table(clean),
        "season_table": summarize.season_table(clean),
        "month_dense": summarize.month_dense(clean),
        "season_order": summarize.season_order(clean),
        "box_month": distribution.box_stats(clean, "MO", UVB),
        "box_season": distribution.box_stats(summarize.with_season(clean), "Estacion", UVB),
        "histogram": distribution.histogram(clean, PHYSICAL),
        "kde": distribution.kde(clean, PHYSICAL),
        "corr_matrix": correlate.corr_matrix(clean, PHYSICAL),
        "corr_extended": correlate.corr_extended(clean),
        "pearson": correlate.pearson_table(clean),
        "scatter_precip": clean.select(PRECIP, UVB, "MO"),
        "scatter_ps": clean.select(PS, UVB, "MO"),
        "anova": hypothesis.with_f_pvalue(hypothesis.anova(clean)),
        "levene": hypothesis.with_f_pvalue(hypothesis.levene(clean)),
        "shapiro": hypothesis.shapiro(clean, PHYSICAL),
        "series_first_days": window,
        "series_bound": ordering.series_bound(window),
    }
    return out


def main() -> None:
    from lumen.session import get_session
    from lumen.sources import fixtures
    from lumen.schema import ROW_KEY

    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--sf", default="/root/testdata/sf0.01", help="folder of the driver tables")
    ap.add_argument("--out", required=True, help="output folder (shared storage on a cluster)")
    args = ap.parse_args()
    spark = get_session()
    results = analyse(spark, fixtures.obs(spark, args.sf), key_cols=ROW_KEY)
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{name}")
        print(name)


if __name__ == "__main__":
    main()
