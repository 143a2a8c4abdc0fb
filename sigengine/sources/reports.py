"""Reading of nested report documents and reference lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _S) for n in names])


#: Fixed layout of a report document; every leaf is text.
REPORTS = T.StructType(
    [
        T.StructField(
            "results",
            T.ArrayType(
                T.StructType(
                    [
                        *_struct("safetyreportid", "serious", "seriousnessdeath", "seriousnesshospitalization", "receivedate", "receiptdate", "occurcountry", "primarysourcecountry"),
                        T.StructField(
                            "patient",
                            T.StructType(
                                [
                                    *_struct("patientsex", "patientonsetage", "patientonsetageunit"),
                                    T.StructField("drug", T.ArrayType(_struct("medicinalproduct", "drugcharacterization", "drugindication"))),
                                    T.StructField("reaction", T.ArrayType(_struct("reactionmeddrapt", "reactionoutcome"))),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORTS).option("multiLine", True).json(path).withColumn("__file", F.col("_metadata.file_path"))


def flatten(documents: DataFrame) -> DataFrame:
    """One row for each report, drug and reaction; rows without a drug or a reaction go."""
    r = documents.select(*[c for c in ("__file",) if c in documents.columns], F.explode("results").alias("r")).select("*", "r.*").drop("r")
    r = r.select("*", F.explode("patient.drug").alias("d")).filter("d.medicinalproduct IS NOT NULL")
    r = r.select("*", F.explode("patient.reaction").alias("x")).filter("x.reactionmeddrapt IS NOT NULL")
    flag = lambda c: F.when(F.col(c) == "1", 1).otherwise(0)
    day = F.try_to_date("receivedate", "yyyyMMdd")
    out = r.select(
        "safetyreportid",
        F.upper(F.trim("d.medicinalproduct")).alias("drug_name"),
        F.col("d.drugcharacterization").alias("drug_role"),
        F.upper(F.trim("x.reactionmeddrapt")).alias("reaction_term"),
        F.col("x.reactionoutcome").alias("reaction_outcome"),
        flag("serious").alias("serious_int"),
        flag("seriousnessdeath").alias("death_int"),
        flag("seriousnesshospitalization").alias("hosp_int"),
        F.when(F.col("patient.patientsex") == "1", 1).when(F.col("patient.patientsex") == "2", 2).otherwise(0).alias("patient_sex_int"),
        F.col("patient.patientonsetage").try_cast("double").alias("age_years"),
        F.coalesce("occurcountry", "primarysourcecountry").alias("country"),
        day.alias("report_date"),
        *([F.regexp_extract("__file", r"(\d{4})q([1-4])", 1).try_cast("int").alias("file_year"), F.regexp_extract("__file", r"(\d{4})q([1-4])", 2).try_cast("int").alias("file_quarter")] if "__file" in r.columns else []),
    )
    if "file_year" in out.columns:
        return out.withColumns({"report_year": F.coalesce("file_year", F.year("report_date")), "report_quarter": F.coalesce("file_quarter", F.quarter("report_date"))}).drop("file_year", "file_quarter")
    return out.withColumns({"report_year": F.year("report_date"), "report_quarter": F.quarter("report_date")})


def read_pairs(spark: SparkSession, path: str, date_col: str = "warning_date") -> DataFrame:
    """A CSV list of dated pairs with upper-cased, trimmed keys; the earliest date of a pair counts."""
    d = spark.read.option("header", True).csv(path)
    return d.groupBy(F.upper(F.trim("drug_name")).alias("drug_name"), F.upper(F.trim("reaction_term")).alias("reaction_term")).agg(F.min(F.expr(f"try_cast({date_col} AS date)")).alias(date_col))


def write_quarters(facts: DataFrame, path: str) -> None:
    """Replace the quarters that ``facts`` holds and leave the others: running again changes nothing."""
    facts.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("report_year", "report_quarter").parquet(path)


def read_quarters(spark: SparkSession, path: str, year: int | None = None, quarter: int | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    d = d.filter(F.col("report_year") == year) if year is not None else d
    return d.filter(F.col("report_quarter") == quarter) if quarter is not None else d
