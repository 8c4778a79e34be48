from pyspark.sql import functions as F

from segrules.session import checkpoint_root, cut_lineage, shared_path
from segrules.sources.tables import empty_frame, read_csv, read_table, replace_table, write_csv

from conftest import SF_SMALL


def test_shared_paths_live_under_checkpoint_dir(spark):
    root = checkpoint_root(spark)
    assert root == (spark.conf.get("spark.checkpoint.dir") or "").rstrip("/")
    a, b = shared_path(spark, "x"), shared_path(spark, "x")
    assert a != b and a.startswith(root + "/")


def test_cut_lineage_is_a_parquet_scan(spark):
    df = spark.range(100).withColumn("s", F.col("id").cast("string"))
    cut = cut_lineage(df)
    assert sorted(cut.collect()) == sorted(df.collect())
    plan = cut.select("s").where("id > 5")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "PushedFilters: [IsNotNull(id), GreaterThan(id,5)]" in plan


def test_csv_round_trip_with_separator_and_quotes(spark):
    df = spark.createDataFrame([(1, 'a;"b",c', 1.5), (2, "", None), (3, None, 0.1)], "k int, s string, d double")
    path = shared_path(spark, "csv")
    write_csv(df, path, sep=";")
    back = read_csv(spark, path, schema=df.schema, sep=";")
    assert sorted(back.collect(), key=lambda r: r["k"]) == sorted(df.collect(), key=lambda r: r["k"])


def test_replace_table_overwrites(spark):
    nation = read_table(spark, SF_SMALL, "nation")
    path = shared_path(spark, "tbl")
    assert replace_table(nation.limit(3), path).count() == 3
    assert replace_table(nation, path).count() == nation.count()


def test_empty_frame_keeps_schema(spark):
    df = empty_frame(spark, "node int, rules string")
    assert df.count() == 0 and df.columns == ["node", "rules"]


def test_read_table_projects(spark):
    df = read_table(spark, SF_SMALL, "lineitem", ["l_orderkey", "l_quantity"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_replace_catalog_table(spark):
    nation = read_table(spark, SF_SMALL, "nation")
    import uuid

    name = f"segrules_replace_probe_{uuid.uuid4().hex[:8]}"  # the in-memory catalog does not outlive the session
    assert replace_table(nation.where("n_regionkey = 1"), name).count() == nation.where("n_regionkey = 1").count()
    assert replace_table(nation, name).count() == nation.count()
    assert spark.table(name).count() == nation.count()
