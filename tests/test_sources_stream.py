"""Sources, sinks, fallback (S1-S7) and the streaming key figures."""

import os

import pytest
from pyspark.sql import functions as F

from lumen.schema import OBS_SCHEMA
from lumen.sources import fallback, files, jdbc, sinks
from lumen.streaming import kpis as sk
from lumen.operators.summarize import kpis


def _obs(spark):
    from lumen.sources.fixtures import obs
    return obs(spark, "/root/testdata/sf0.001").select(*[f.name for f in OBS_SCHEMA.fields])


def test_csv_roundtrip_and_partitioned_sink(spark, scratch):
    o = _obs(spark)
    files.write_csv(o, f"{scratch}/csv")
    back = files.read_csv(spark, f"{scratch}/csv")
    assert back.exceptAll(o).count() == 0 and o.exceptAll(back).count() == 0
    sinks.write_table(o, f"{scratch}/t")
    assert any(d.startswith("YEAR=") for d in os.listdir(f"{scratch}/t"))
    assert sinks.load_count(spark, f"{scratch}/t").first()[0] == o.count()
    pruned = spark.read.parquet(f"{scratch}/t").where(F.col("MO") == 3)
    assert "PartitionFilters: [isnotnull(MO" in pruned._jdf.queryExecution().executedPlan().toString()


def test_profile_from_env_and_options():
    assert jdbc.profile_from_env(env={}) is None
    p = jdbc.profile_from_env(env={"LUMEN_DB_URL": "jdbc:postgresql://h/db", "LUMEN_DB_USER": "u",
                                   "LUMEN_DB_PASSWORD": "pw-9f2"})
    assert "pw-9f2" not in repr(p)
    o = jdbc.jdbc_options(p, "datos_uvb")
    assert o == {"url": "jdbc:postgresql://h/db", "dbtable": "datos_uvb", "user": "u", "password": "pw-9f2"}


def test_fallback_database_then_csv_then_error(spark, scratch):
    bad = jdbc.ConnectionProfile(url="jdbc:unknown://nowhere/db")
    files.write_csv(_obs(spark), f"{scratch}/c")
    df, used = fallback.load_observations(spark, bad, csv_path=f"{scratch}/c")
    assert used == "csv" and df.count() > 0
    with pytest.raises(fallback.NoSourceError):
        fallback.load_observations(spark, bad, csv_path=f"{scratch}/missing")


def test_stream_kpis_equal_batch(spark, scratch):
    o = _obs(spark)
    o.repartition(3).write.parquet(f"{scratch}/landing")
    st = sk.observation_stream(spark, f"{scratch}/landing", OBS_SCHEMA, files_per_trigger=1)
    got = sk.run_available(sk.running_kpis(st), f"{scratch}/kpis", f"{scratch}/ck").first()
    exp = kpis(__import__("lumen.operators.clean", fromlist=["x"]).clean_positive(o)).first()
    assert got["total_registros"] == exp["total_registros"]
    assert abs(got["uvb_promedio"] - exp["uvb_promedio"]) < 1e-12
    daily = sk.run_available(sk.daily_kpis(sk.observation_stream(spark, f"{scratch}/landing", OBS_SCHEMA)),
                             f"{scratch}/daily", f"{scratch}/ck2", mode="append")
    assert daily.count() > 0


def test_jdbc_partition_options():
    o = jdbc.partition_options("id", 1, 1_000_000, 16)
    assert o == {"partitionColumn": "id", "lowerBound": "1", "upperBound": "1000000",
                 "numPartitions": "16"}
    assert jdbc.partition_options("id", 5, 5, 16) == {}
    assert jdbc.partition_options(None, 1, 9, 16) == {}
    assert jdbc.partition_options("id", 1, 9, 1) == {}


def test_a_failing_write_leaves_the_old_table(spark, scratch):
    path = f"{scratch}/t"
    with pytest.raises(FileNotFoundError):
        sinks.open_table(spark, path)
    o = _obs(spark)
    sinks.replace_table(o, path)
    bad = o.withColumn("PS", F.when(F.col("MO") == 7, F.raise_error(F.lit("stop"))).otherwise(F.col("PS")))
    with pytest.raises(Exception, match="stop"):
        sinks.replace_table(bad, path)
    assert sinks.open_table(spark, path).count() == o.count()
    check = sinks.load_check(spark, path).first()
    assert check["complete"] and check["total"] == check["expected"] == o.count()
    sinks.replace_table(sinks.open_table(spark, path).where("MO = 3"), path)        # reads what it replaces
    assert sinks.open_table(spark, path).count() == o.where("MO = 3").count()
    assert sinks.open_table(spark, path, number=1).count() == o.count()
    plan = sinks.open_table(spark, path).where("MO = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(MO" in plan
    assert sinks.forget_versions(spark, path, keep=1) == 1 and sinks.forget_versions(spark, path, keep=1) == 0
    assert [r["number"] for r in sinks.manifest(spark, path).collect()] == [2, 1]


def test_a_lost_file_shows_in_the_check(spark, scratch):
    path = f"{scratch}/t"
    sinks.replace_table(_obs(spark).where("MO < 4"), path)
    lost = sinks.open_table(spark, path).inputFiles()[0].removeprefix("file://")
    os.remove(lost)
    check = sinks.load_check(spark, path).first()
    assert not check["complete"] and check["total"] < check["expected"]


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_and_bounds_come_from_footers(spark, scratch):
    from lumen.plans import catalog
    from lumen.sources.footers import bounds

    count = catalog.QUERIES["sql_count"](spark, "/root/testdata/sf0.001")
    assert "PushedAggregation: [COUNT(*)]" in _plan(count) and count.first()[0] == _obs(spark).count()
    sinks.write_table(_obs(spark), f"{scratch}/t", ("MO",))
    got = bounds(spark, f"{scratch}/t", ["DY", "PS"], ["MO"])
    assert "PushedAggregation: [COUNT(*), MIN(DY), MAX(DY), MIN(PS), MAX(PS)]" in _plan(got)
    want = _obs(spark).groupBy("MO").agg(F.count("*"), F.min("DY"), F.max("DY"), F.min("PS"), F.max("PS"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    whole = bounds(spark, f"{scratch}/t", ["HR"]).first()
    assert (whole["HR_min"], whole["HR_max"]) == (0, 23)
    # the caller's session reads as before
    assert "PushedAggregation" not in _plan(spark.read.parquet(f"{scratch}/t").agg(F.count("*")))


def test_landing_files_grow_in_number_not_in_rows(spark, scratch, monkeypatch):
    """Each file is written from one task's share, which must not follow the input."""
    monkeypatch.setattr(sk, "LANDING_ROWS", 50)
    rows = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert sk.land(rows, f"{scratch}/landing") == 5
    sizes = [r["count"] for r in spark.read.parquet(f"{scratch}/landing").groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 20 and max(sizes) <= 60
    assert sk.land(rows.limit(10), f"{scratch}/few") == 1
