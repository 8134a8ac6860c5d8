"""Statistics of a table of records: totals, error codes, fill, repeated values, lost tokens.

All are partial aggregates; ranks come from window limits that keep a few rows in each task before the shuffle.
"First seen" is the order of doc_seq where records have it, then of doc_id, then of the record in its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlift.functions.text import strip
from recordlift.operators.duplicates import free_name
from recordlift.plans.config import Spec
from recordlift.sources.shared import stored

TOP_ERRORS, TOP_VALUES, TOP_LOST, PREVIEW = 10, 8, 50, 50


def _text(name: str) -> Column:
    return strip(F.coalesce(F.col(f"`{name}`"), F.lit("")))


def _has_error() -> Column:
    return F.coalesce(F.col("err"), F.lit("")) != ""


def place(records: DataFrame) -> list[str]:
    """The columns that order records."""
    return [c for c in ("doc_seq", "doc_id", "rec_idx") if c in records.columns]


def summary(records: DataFrame) -> DataFrame:
    """One row: total, clean, with_errors, error_rate (percent, one place, ties to even), duplicates (errDUP in err)."""
    one = records.agg(F.count("*").alias("total"), F.count_if(_has_error()).alias("with_errors"), F.count_if(F.contains(F.coalesce("err", F.lit("")), F.lit("errDUP"))).alias("duplicates"))
    rate = F.when(F.col("total") == 0, 0.0).otherwise(F.bround(F.col("with_errors") / F.col("total") * 100, 1))
    return one.select("total", (F.col("total") - F.col("with_errors")).alias("clean"), "with_errors", rate.alias("error_rate"), "duplicates")


def top_errors(records: DataFrame, most: int = TOP_ERRORS) -> DataFrame:
    """code, cnt: the most frequent error codes, the earlier seen first among equals."""
    codes = records.where(_has_error()).select(*place(records), F.posexplode(F.transform(F.split("err", ";"), strip)).alias("at", "code")).where("code <> ''")
    counted = codes.groupBy("code").agg(F.count("*").alias("cnt"), F.min(F.struct(*place(records), "at")).alias("seen"))
    return counted.orderBy(F.desc("cnt"), "seen").limit(most).select("code", "cnt")


def field_fill(records: DataFrame, spec: Spec) -> DataFrame:
    """field, filled, percent for each declared column: one pass over the records."""
    total = F.count("*").alias("total")
    counts = records.agg(total, *(F.count_if(_text(c) != "").alias(f"c{k}") for k, c in enumerate(spec.columns)))
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"c{k}").alias("filled")) for k, c in enumerate(spec.columns)))
    return counts.select("total", F.explode(rows).alias("r")).select("r.field", "r.filled", F.when(F.col("total") > 0, F.bround(100 * F.col("r.filled") / F.col("total")).cast("long")).otherwise(0).alias("percent"))


def value_counts(records: DataFrame, spec: Spec) -> DataFrame:
    """field, value, cnt, seen: how often each value stands in each declared column."""
    cells = F.array(*(F.struct(F.lit(c).alias("field"), _text(c).alias("value")) for c in spec.columns))
    order = place(records)
    rows = records.select(*order, F.explode(cells).alias("c")).select(*order, "c.*").where("value <> ''")
    return rows.groupBy("field", "value").agg(F.count("*").alias("cnt"), F.min(F.struct(*order)).alias("seen"))


def value_distribution(records: DataFrame, spec: Spec, most: int = TOP_VALUES) -> DataFrame:
    """field, unique, filled, repeated_total, repeated (array of value, cnt; at most `most`) for each declared column."""
    return distribution(value_counts(records, spec), spec, most)


def distribution(counts: DataFrame, spec: Spec, most: int = TOP_VALUES) -> DataFrame:
    """The same from counts of values: field, value, cnt, seen. They are written, since totals and ranks both read them."""
    counts = stored(counts, "value-counts")
    totals = counts.groupBy("field").agg(F.count("*").alias("unique"), F.sum("cnt").alias("filled"), F.count_if(F.col("cnt") > 1).alias("repeated_total"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("cnt"), "seen"))
    few = counts.where("cnt > 1").withColumn("rank", rank).where(F.col("rank") <= most)
    listed = few.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "cnt"))).alias("rows"))
    listed = listed.select("field", F.transform("rows", lambda r: F.struct(r["value"].alias("value"), r["cnt"].alias("cnt"))).alias("repeated"))
    every = counts.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(spec.columns)], "field string")
    out = every.join(totals, "field", "left").join(listed, "field", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("field", zero("unique"), zero("filled"), zero("repeated_total"), F.coalesce("repeated", F.array().cast("array<struct<value: string, cnt: bigint>>")).alias("repeated"))


def lost_tokens(records: DataFrame, most: int | None = TOP_LOST) -> DataFrame:
    """token, cnt: the tokens of the column lost, the most frequent first; None gives all."""
    rows = records.select(*place(records), F.posexplode("lost").alias("at", "token"))
    counted = rows.groupBy("token").agg(F.count("*").alias("cnt"), F.min(F.struct(*place(records), "at")).alias("seen"))
    return counted.select("token", "cnt") if most is None else counted.orderBy(F.desc("cnt"), "seen").limit(most).select("token", "cnt")


def lost_summary(records: DataFrame) -> DataFrame:
    """One row: unique and total of the lost tokens."""
    return lost_tokens(records, None).agg(F.count("*").alias("unique"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))


def preview(records: DataFrame, most: int = PREVIEW) -> DataFrame:
    """The first records, as they would be shown."""
    return records.orderBy(*place(records)).limit(most)


def numbered(records: DataFrame, ranges: int | None = None, name: str = "record_no") -> DataFrame:
    """The records with a number in their order, from 0 without gaps, at any size: ranges of the order are sorted each
    by itself and written; the counts of the ranges before one are its offset. A range may begin within a document."""
    order = place(records)
    dealt = records.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    # an id has the partition in its upper bits and the row's place in the 33 lower ones
    number = F.monotonically_increasing_id()
    part, nth = (free_name(c, records.columns) for c in ("range_no", "range_nth"))
    rows = stored(dealt.withColumn(part, F.shiftright(number, 33)).withColumn(nth, number.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    counts = rows.groupBy(part).agg(F.count("*").alias("range_n"))
    offsets = counts.select(part, (F.sum("range_n").over(Window.orderBy(part)) - F.col("range_n")).alias("range_offset"))  # a row for each range
    return rows.join(F.broadcast(offsets), part).withColumn(name, F.col("range_offset") + F.col(nth)).drop(part, nth, "range_offset")
