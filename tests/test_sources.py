import pytest

from cohortspan.session import adapt, durable
from cohortspan.sources import lookups, tables


def test_parquet_round_trip_with_fill_and_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "gp", None), (2, "ae", 3.0)], "id int, metric string, v double")
    tables.write_result(df, path, ["metric"])
    tables.write_result(df.limit(2), path, ["metric"])
    back = tables.read_parquet(spark, path, fill=0)
    assert sorted((r["id"], r["v"]) for r in back.collect()) == [(1, 0.0), (2, 3.0)]
    plan = back.filter("metric = 'gp'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(metric" in plan


def test_csv_with_declared_schema(spark, tmp_path):
    path = str(tmp_path / "c")
    tables.write_csv(spark.createDataFrame([(1, "2022-01-01")], "id int, d string"), path)
    back = tables.read_csv(spark, path, "id int, d date")
    assert back.first()["d"].isoformat() == "2022-01-01"
    with pytest.raises(Exception, match="MALFORMED|parse|cast"):
        tables.read_csv(spark, path, "id date, d date").collect()


def test_columns_view_and_rounding(spark):
    df = spark.createDataFrame([(1, 2.345)], "Id int, V double")
    tables.require_columns(df, ["id", "v"])
    with pytest.raises(ValueError, match="missing"):
        tables.require_columns(df, ["w"])
    tables.as_view(df, "temp_table")
    assert spark.sql("select id from temp_table").first()[0] == 1
    assert tables.round_numbers(df, 1).first()["V"] == 2.3


def test_lookup_is_whole_and_null_code_never_joins(spark):
    frame = lookups.specialty_lookup(spark)
    assert frame.count() == 137
    codes = spark.createDataFrame([(110,), (None,), (1,)], "tfc bigint")
    assert [r["specialty"] for r in codes.join(frame, "tfc").collect()] == ["Trauma and Orthopaedic"]


def test_durable_cuts_lineage(spark):
    df = durable(spark.range(5).selectExpr("id * 2 as x"))
    assert "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
    assert df.agg({"x": "sum"}).first()[0] == 20


def test_checkpoints_go_with_the_application(spark):
    durable(spark.range(3))
    assert spark.sparkContext._cohortspan_cleans == spark.sparkContext.getCheckpointDir()


def test_adapt_sets_skew_handling(spark):
    key = "spark.sql.adaptive.forceOptimizeSkewedJoin"
    spark.conf.set(key, "false")
    assert adapt(spark).conf.get(key) == "true"
