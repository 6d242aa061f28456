"""Canonical frames over the input tables, and the same as SQL for the oracle.

Every reader selects the columns that it needs, so Parquet reads no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as securities: cohort (nation), parent (region), filer profile."""
    n = read(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    r = read(spark, sf_dir, "region", "r_regionkey", "r_name")
    s = read(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return (
        s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("security_id"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("cohort"),
            F.col("r_name").alias("parent"),
            F.when(F.col("r_name") == "EUROPE", "FPI").otherwise("DOMESTIC").alias("profile"),
            F.col("s_acctbal").alias("balance"),
        )
    )


SECURITIES = """
sec AS (
  SELECT s_suppkey AS security_id, s_name AS name, n_name AS cohort, r_name AS parent,
         CASE WHEN r_name = 'EUROPE' THEN 'FPI' ELSE 'DOMESTIC' END AS profile, s_acctbal AS balance
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def month_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly price bars of each supplier: one aggregation, combined before the shuffle."""
    x = read(
        spark, sf_dir, "lineitem",
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
    ).filter("l_quantity > 0")
    x = x.select(
        F.col("l_suppkey").alias("security_id"),
        F.trunc(F.to_date("l_shipdate"), "month").alias("session_date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        "l_quantity",
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("at"),
    )
    return x.groupBy("security_id", "session_date").agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"),
    )


BARS = """
bars AS (
  SELECT l_suppkey AS security_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS session_date,
         first(l_extendedprice / l_quantity
               ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS open,
         max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low,
         last(l_extendedprice / l_quantity
               ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS close,
         CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2)"""


def raw_legs(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """Six raw signals of each supplier, wide; null where they can't be computed.

    ``in_order`` adds up each supplier's rows as the files hold them. Sums of doubles
    depend on the order in their last bits; so equal suppliers tie, however files are split.
    """
    names = ("l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    place = ("_metadata.file_path", "_metadata.row_index") if in_order else ()
    x = read(spark, sf_dir, "lineitem", *names, *place)
    if in_order:
        x = x.repartition("l_suppkey").sortWithinPartitions("l_suppkey", "file_path", "row_index").drop("file_path", "row_index")
    late = F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp")
    flag = F.col("l_returnflag")
    agg = x.groupBy(F.col("l_suppkey").alias("security_id")).agg(
        F.avg("l_discount").alias("thesis_linkage"),
        F.ln((F.sum(late.cast("int")) + 1) / (F.sum((~late).cast("int")) + 1)).alias("attention"),
        F.avg("l_tax").alias("narrative"),
        (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_quantity")).alias("health"),
        (F.sum(F.when(flag == "A", F.col("l_quantity")).when(flag == "R", -F.col("l_quantity")).otherwise(0.0))).alias("flow"),
        F.sum("l_extendedprice").alias("revenue"),
    )
    sec = securities(spark, sf_dir)
    bal = F.col("balance")
    return sec.join(agg, "security_id", "left").select(
        "security_id", "cohort", "parent", "profile",
        "thesis_linkage", "attention", "narrative", "health",
        F.when(bal > 0, F.col("flow") / bal).alias("smart_money"),
        F.when(F.col("revenue") > 0, F.when(bal > 1000, bal / F.col("revenue"))).alias("valuation"),
    )


LEGS = ("thesis_linkage", "attention", "narrative", "health", "smart_money", "valuation")
RAW = (
    SECURITIES
    + """,
agg AS (
  SELECT l_suppkey AS security_id, avg(l_discount) AS thesis_linkage,
         ln((count(*) FILTER (l_shipdate >= TIMESTAMP '1998-01-01') + 1.0)
            / (count(*) FILTER (l_shipdate < TIMESTAMP '1998-01-01') + 1.0)) AS attention,
         avg(l_tax) AS narrative, sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) AS health,
         sum(CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'R' THEN -l_quantity ELSE 0.0 END) AS flow,
         sum(l_extendedprice) AS revenue
  FROM lineitem GROUP BY 1),
raw AS (
  SELECT security_id, cohort, parent, profile, thesis_linkage, attention, narrative, health,
         CASE WHEN balance > 0 THEN flow / balance END AS smart_money,
         CASE WHEN revenue > 0 AND balance > 1000 THEN balance / revenue END AS valuation
  FROM sec LEFT JOIN agg USING (security_id)),
long AS (
  SELECT security_id, cohort, parent, profile, leg, x
  FROM (SELECT security_id, cohort, parent, profile,
               unnest(['thesis_linkage', 'attention', 'narrative', 'health', 'smart_money', 'valuation']) AS leg,
               unnest([thesis_linkage, attention, narrative, health, smart_money, valuation]) AS x FROM raw))"""
)


def legs_long(spark: SparkSession, sf_dir: str, in_order: bool = False) -> DataFrame:
    """One row for each security and leg: x is the raw signal."""
    return raw_legs(spark, sf_dir, in_order).unpivot(
        ["security_id", "cohort", "parent", "profile"], list(LEGS), "leg", "x"
    )
