"""Table access: parquet scans, the funnel view, quoted projections, CSV and sinks.

Everything here is lazy except the sinks.  Projections are applied before
joins so the parquet scans read only the columns a plan needs (``ReadSchema``)
and filters written on the result reach the scan (``PushedFilters``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def quote_name(name: str) -> str:
    """Backtick-quote a column name so names with ``-``, spaces or dots resolve."""
    return "`" + name.replace("`", "``") + "`"


def project_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Select a run-time list of column names, each quoted."""
    return df.select(*[F.col(quote_name(c)) for c in columns])


def converted_flag(orderkey: Column, quantity: Column, priority: Column, p_type: Column, discount: Column) -> Column:
    """Binary response of the funnel view (FIXTURES.md section 4)."""
    return (
        F.when(orderkey % 10 == 0, F.when(quantity > 25, 1).otherwise(0))
        .when(priority.isin("1-URGENT", "2-HIGH") & (quantity > 30), 1)
        .when((p_type == "PROMO") & (discount > F.lit(0.055)), 1)
        .otherwise(0)
    )


def funnel_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clickstream-funnel stand-in built from the star schema.

    One row per line item with category-like columns (``p_type``, ``p_brand``,
    ``segment``, ``nation``, ``priority``), two numerics (``quantity``,
    ``discount``), two path strings (``first_page`` with ``|`` levels, ``path``
    with ``->`` steps) and the 0/1 response ``converted``.

    Join order: orders are joined to customer and nation first (an
    orders-sized intermediate), so the line items are shuffled only twice at
    scale - once on the order key, once on the part key - instead of three
    times.  Which joins broadcast is left to Spark's size check
    (``autoBroadcastJoinThreshold`` and AQE's runtime statistics); a hot key
    in a shuffled join is split by AQE's skew-join handling.
    """
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_type", "p_brand", "p_name"])

    cust = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    order_side = orders.join(cust, orders.o_custkey == cust.c_custkey)
    joined = li.join(order_side, li.l_orderkey == order_side.o_orderkey).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    return joined.select(
        "l_orderkey",
        "l_linenumber",
        "p_type",
        "p_brand",
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"),
        F.col("o_orderpriority").alias("priority"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.concat("p_type", F.lit("|"), "p_brand", F.lit("|"), "p_name").alias("first_page"),
        F.when(F.col("l_linenumber") == 7, F.lit(""))
        .otherwise(F.concat(F.lit("->"), "p_type", F.lit("//"), "p_name", F.lit("->"), "c_mktsegment"))
        .alias("path"),
        converted_flag(
            F.col("l_orderkey"), F.col("l_quantity"), F.col("o_orderpriority"), F.col("p_type"), F.col("l_discount")
        ).alias("converted"),
    )


# Null marker in CSV files: with the default (empty) marker an empty string
# and a null both read back as null.
CSV_NULL = "\\N"


def write_csv(df: DataFrame, path: str, sep: str = ",", null_value: str = CSV_NULL) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("nullValue", null_value).csv(path)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    sep: str = ",",
    null_value: str = CSV_NULL,
) -> DataFrame:
    """CSV with a header row.  Pass a schema in production; inference costs a pass."""
    reader = spark.read.option("header", True).option("sep", sep).option("nullValue", null_value)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def sql_rows(spark: SparkSession, text: str, **parameters: object) -> DataFrame:
    """Rows of an SQL text with named parameters: ``:name`` for values, ``IDENTIFIER(:name)`` for tables and columns.

    Parameters are bound, never pasted: a value is a literal whatever it holds, an identifier one name.
    The result is a plan like any other, so later filters and projections reach its scans.
    """
    return spark.sql(text, args=parameters)


def scan_table(
    spark: SparkSession, table: str, columns: Sequence[str] | None = None, where: str | None = None, **parameters: object
) -> DataFrame:
    """A table of the session's catalog (``name`` or ``database.name``), a run-time list of its columns and a condition with
    named parameters.  Columns the condition needs are read, those that neither asks for are not."""
    rows = sql_rows(spark, f"SELECT * FROM IDENTIFIER(:__table) WHERE {where or 'true'}", __table=table, **parameters)
    return project_columns(rows, columns) if columns else rows


def save_table(df: DataFrame, table: str, partition_by: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """Replace a catalog table; ``path`` puts its files outside the warehouse, ``partition_by`` lets scans prune."""
    writer = df.write.mode("overwrite").format("parquet")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def replace_table(df: DataFrame, target: str, fmt: str = "parquet") -> DataFrame:
    """Drop-then-save as one overwrite; returns a scan of what was written.

    ``target`` is a path (contains ``/``) or a catalog table name.
    """
    spark = df.sparkSession
    if "/" in target:
        df.write.mode("overwrite").format(fmt).save(target)
        return spark.read.format(fmt).load(target)
    df.write.mode("overwrite").format(fmt).saveAsTable(target)
    return spark.table(target)


def empty_frame(spark: SparkSession, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)
