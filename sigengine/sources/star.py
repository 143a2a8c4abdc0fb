"""Facts and reference pairs from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fact_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a report, brand/size the drug, part type and customer segment the reaction.

    Lines are grouped by order and part attributes, with whole numbers only in the aggregation, before the order's own
    attributes are joined: one shuffle by order serves the grouping and the join.
    """
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    returned, shipped = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    lines = t("lineitem").join(t("part").select("p_partkey", "p_brand", "p_size", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.groupBy("l_orderkey", "p_brand", "p_size", "p_type").agg(
        F.min(F.when(F.col("l_linenumber") % 4 == 0, 2).when(F.col("l_linenumber") % 5 == 0, None).otherwise(1)).alias("role"),
        F.max(F.when(returned, 1).otherwise(0)).alias("serious_int"),
        F.max(F.when(returned & shipped, 1).otherwise(0)).alias("death_int"),
        F.max(F.when(shipped, 1).otherwise(0)).alias("hosp_int"),
    )
    people = t("customer").join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name")
    d = lines.join(t("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day")), F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    return d.select(
        F.col("l_orderkey").cast("string").alias("safetyreportid"),
        F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("drug_name"),
        F.concat("p_type", F.lit("-"), "c_mktsegment").alias("reaction_term"),
        F.col("role").cast("string").alias("drug_role"),
        "serious_int",
        "death_int",
        "hosp_int",
        (F.col("c_custkey") % 3).cast("int").alias("patient_sex_int"),
        ((F.col("c_custkey") * 7) % 135).cast("double").alias("age_years"),
        F.col("n_name").alias("country"),
        F.col("day").alias("report_date"),
        F.year("day").alias("report_year"),
        F.quarter("day").alias("report_quarter"),
    )


def warnings_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dated pair for every 37th part."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey % 37 = 0")
    segment = F.element_at(F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))), (F.floor(F.col("p_partkey") / 37) % 5 + 1).cast("int"))
    return p.groupBy(F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")).alias("drug_name"), F.concat("p_type", F.lit("-"), segment).alias("reaction_term")).agg(
        F.min(F.date_add(F.lit("1997-06-30").cast("date"), ((F.col("p_partkey") * 17) % 1500).cast("int"))).alias("warning_date")
    )
