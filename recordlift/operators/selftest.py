"""Runs the cases that a configuration carries: all inputs are parsed in one plan and compared with what is expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlift.plans.config import Spec
from recordlift.plans.parse import parse


CASES = "nth long, description string, text string, expect map<string,string>, record int"


def run_tests(spark: SparkSession, spec: Spec) -> DataFrame:
    """nth, description, status (pass or fail), details: array of field, expected, got, ok, for the configuration's own
    cases."""
    cases = [(k, str(t.get("description", f"Test #{k + 1}")), str(t.get("input", "")), {f: str(v) for f, v in t.get("expect", {}).items()}, int(t.get("expect_record", 0))) for k, t in enumerate(spec.tests)]
    return run_cases(spark.createDataFrame(cases, CASES), spec)


def run_cases(table: DataFrame, spec: Spec) -> DataFrame:
    """The same for a table of cases with the columns of CASES, of any size. A case whose record is missing fails; a
    negative record number counts from the end; a null text is empty, and a case that expects nothing of a record passes
    if there is one. nth tells cases apart."""
    got = F.array(*(F.struct(F.lit(c).alias("key"), F.coalesce(F.col(f"`{c}`"), F.lit("")).alias("value")) for c in spec.output))
    parsed = parse(table.select(F.col("nth").alias("doc_id"), "text"), spec).select("doc_id", "rec_idx", got.alias("got"))
    # a case's input is a short text, so its records are few
    whole = parsed.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rec_idx", "got"))), lambda r: F.map_from_entries(r["got"])).alias("records"))
    rows = table.join(whole, table.nth == whole.doc_id, "left").withColumn("records", F.coalesce("records", F.array().cast("array<map<string,string>>")))
    record = F.try_element_at("records", F.when(F.col("record") >= 0, F.col("record") + 1).otherwise(F.col("record")))
    rows = rows.withColumn("rec", record)

    def compared(field, expected):
        value = F.coalesce(F.element_at("rec", field), F.lit(""))
        return F.struct(field.alias("field"), expected.alias("expected"), value.alias("got"), (value == expected).alias("ok"))

    missing = F.array(F.struct(F.lit("(records)").alias("field"), F.concat(F.lit(">= "), (F.col("record") + 1).cast("string")).alias("expected"), F.size("records").cast("string").alias("got"), F.lit(False).alias("ok")))
    details = F.when(F.col("rec").isNull(), missing).otherwise(F.transform(F.map_entries("expect"), lambda e: compared(e["key"], e["value"])))
    done = rows.withColumn("details", details)
    return done.select("nth", "description", F.when(F.forall("details", lambda d: d["ok"]), "pass").otherwise("fail").alias("status"), "details")


def test_totals(results: DataFrame) -> DataFrame:
    """One row: total, passed, failed."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("failed"))
