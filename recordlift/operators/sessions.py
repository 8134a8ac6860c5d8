"""Windows over events: sessions by gaps, and windows of fixed length.

Defined results: events with a null time belong to no window; a null key is a key like others; events of one time belong
to one session; a session ends with its last event (windows of streams end a gap later, see streaming/windows.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: length of the ranges that are looked through each by itself, as a multiple of the gap
RANGE = 64


def _islands(rows: DataFrame, by: list[str], gap: int) -> DataFrame:
    """Rows (start, end, further columns) with the number of their island among those of `by`."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = before.isNull() | (F.col("start") - before > gap)
    return rows.withColumn("begins", begins.cast("int")).withColumn("island", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def sessions(events: DataFrame, key: str, time: str, gap_micros: int, value: str | None = None) -> DataFrame:
    """key, session_start, session_end, n_events, total: runs of a key's events no further apart than the gap.

    Two rounds of gaps and islands: within ranges of time first, so that a frequent key has many tasks; then over the
    first and last run of each range, the only ones that can go on in another range."""
    at = F.unix_micros(F.col(f"`{time}`").cast("timestamp"))
    amount = F.col(f"`{value}`").cast("double") if value else F.lit(None).cast("double")
    rows = events.where(F.col(f"`{time}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), at.alias("start"), at.alias("end"), amount.alias("total"))
    rows = rows.withColumn("part", F.floor(F.col("start") / (RANGE * gap_micros)))
    sums = [F.min("start").alias("start"), F.max("end").alias("end")]
    local = _islands(rows, ["key", "part"], gap_micros).groupBy("key", "part", "island").agg(*sums, F.count("*").alias("n"), F.sum("total").alias("total"))
    edge = Window.partitionBy("key", "part")
    at_edge = (F.col("island") == 1) | (F.col("island") == F.max("island").over(edge))
    local = local.withColumn("open", at_edge)
    closed = local.where(~F.col("open")).select("key", "start", "end", "n", "total")
    joined = _islands(local.where("open").select("key", "start", "end", "n", "total"), ["key"], gap_micros).groupBy("key", "island").agg(*sums, F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = closed.unionByName(joined.select("key", "start", "end", "n", "total"))
    moment = lambda c: F.timestamp_micros(c).cast(dict(events.dtypes)[time])
    return out.select(F.col("key").alias(key), moment("start").alias("session_start"), moment("end").alias("session_end"), F.col("n").alias("n_events"), "total")


def windowed(events: DataFrame, time: str, length: str, slide: str | None = None, by: list[str] | None = None, value: str | None = None) -> DataFrame:
    """The columns of `by`, window_start, window_end, n_events, total: tumbling windows, or sliding ones of which each
    event belongs to several. Counts are summed up in each task first."""
    total: Column = F.sum(F.col(f"`{value}`")) if value else F.lit(None).cast("double")
    rows = events.groupBy(F.window(F.col(f"`{time}`"), length, slide).alias("w"), *(F.col(f"`{c}`") for c in by or []))
    return rows.agg(F.count("*").alias("n_events"), total.alias("total")).select(*(f"`{c}`" for c in by or []), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_events", "total")
