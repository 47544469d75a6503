"""A ternary-coded, labelled table derived from the orders and lineitem tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwright.constants import LABEL, ROW, TARGET
from foldwright.functions.columns import label_from_target

# Feature order (the group key depends on it) and the registry of this table.
FEATURES = ["f_lines", "f_maxprice", "f_maxqty", "f_status", "f_anyret", "f_anyf", "f_prio", "f_gross"]
LEAKY = [("f_gross", "label-source leakage", "built from the line sums that define the label")]
PAGE = ["f_maxprice", "f_maxqty"]
KEPT = [f for f in FEATURES if f != "f_gross"]


# The columns that are read; a given schema also saves the footer pass that infers one.
ORDERS = "o_orderkey bigint, o_orderstatus string, o_orderpriority string"
LINEITEM = ("l_orderkey bigint, l_quantity double, l_extendedprice double, l_discount double, "
            "l_returnflag string, l_linestatus string")


def _three(c, low, high):
    return F.when(c <= low, -1).when(c <= high, 0).otherwise(1)


def ternary_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: row number, eight ternary features and the target code.

    Lines are aggregated on the order key before the join, so both sides of the join are
    already partitioned or small, and a busy order shuffles as one row per map task.
    """
    orders = spark.read.schema(ORDERS).parquet(f"{sf_dir}/orders.parquet")
    items = spark.read.schema(LINEITEM).parquet(f"{sf_dir}/lineitem.parquet")
    lines = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.sum("l_extendedprice"), 2).alias("gross"),
        F.max("l_extendedprice").alias("price"),
        F.max("l_quantity").alias("quantity"),
        F.bool_or(F.col("l_returnflag") == "R").alias("returned"),
        F.bool_or(F.col("l_linestatus") == "F").alias("finished"),
    )
    j = orders.join(lines, "o_orderkey", "left").fillna(
        {"n": 0, "revenue": 0.0, "gross": 0.0, "price": 0.0, "quantity": 0.0, "returned": False, "finished": False})
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    rules = {
        "f_lines": _three(F.col("n"), 3, 4),
        "f_maxprice": _three(F.col("price"), 80000, 93000),
        "f_maxqty": _three(F.col("quantity"), 39, 46),
        "f_status": F.when(status == "F", -1).when(status == "O", 0).otherwise(1),
        "f_anyret": F.when(F.col("returned"), -1).otherwise(1),
        "f_anyf": F.when(F.col("finished"), -1).otherwise(1),
        "f_prio": F.when(priority.isin("1-URGENT", "2-HIGH"), -1).when(priority == "3-MEDIUM", 0).otherwise(1),
        "f_gross": _three(F.col("gross"), 190000, 230000),
    }
    return j.select(F.col("o_orderkey").alias(ROW), *[rules[f].cast("tinyint").alias(f) for f in FEATURES],
                    F.when(F.col("revenue") > 200000, -1).otherwise(1).cast("tinyint").alias(TARGET))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ternary_features(spark, sf_dir).withColumn(LABEL, label_from_target()).drop(TARGET)
