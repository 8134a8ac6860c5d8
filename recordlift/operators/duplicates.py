"""Marks records whose key occurred earlier in the same document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlift.functions.text import strip
from recordlift.plans.config import Spec


def _quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def with_code(err: Column, code: str) -> Column:
    """The error text with one more code, sorted."""
    codes = F.filter(F.transform(F.split(F.coalesce(err, F.lit("")), ";"), strip), lambda c: c != "")
    return F.array_join(F.array_sort(F.array_distinct(F.concat(codes, F.array(F.lit(code))))), "; ")


def free_name(name: str, taken: list[str]) -> str:
    """The name, longer until no column has it."""
    while name in taken:
        name += "_"
    return name


def mark_duplicates(records: DataFrame, spec: Spec) -> DataFrame:
    """All but the first record of a key in a document get the code; records with a blank key are exempt. These are
    dealt by their number, so that a column that is mostly blank makes no large group."""
    if spec.dedup_key is None:
        return records
    value = strip(F.coalesce(_quoted(spec.dedup_key), F.lit("")))
    key, alone, again = (free_name(c, records.columns) for c in ("dup_key", "dup_alone", "dup_again"))
    rows = records.withColumn(key, value if spec.dedup_case else F.lower(value))
    rows = rows.withColumn(alone, F.when(F.col(key) == "", F.col("rec_idx")))
    document = [c for c in ("doc_seq", "doc_id") if c in records.columns]
    earlier = F.row_number().over(Window.partitionBy(*document, key, alone).orderBy("rec_idx")) > 1
    marked = rows.withColumn(again, earlier & (F.col(key) != ""))
    # plain columns, so that those that nobody asks for are never computed
    err = F.when(F.col(again), with_code(F.col("err"), spec.dedup_code)).otherwise(F.col("err")).alias("err")
    return marked.select(*(err if c == "err" else _quoted(c) for c in records.columns))


def count_duplicates(records: DataFrame, spec: Spec) -> DataFrame:
    """One row: the number of records with the duplicate code."""
    return records.agg(F.count_if(F.array_contains(F.split(F.coalesce("err", F.lit("")), "; "), spec.dedup_code)).alias("duplicates"))
