"""Events that arrive as a stream: sessions and duplicates with state, bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, key: str, time: str, gap: str, lateness: str, value: str) -> DataFrame:
    """key, session_start, session_end (a gap behind the last event), n_events, total: a session is given out once the
    watermark has passed its end, so events may come `lateness` late; later ones are dropped. For append mode."""
    rows = events.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("w"), F.col(key))
    return rows.agg(F.count("*").alias("n_events"), F.sum(value).alias("total")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "total")


def stream_firsts(events: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """The first event to arrive of each key; further ones are dropped while the state remembers the key, which is
    until the watermark has passed its time by `lateness`. The state so holds the keys of that span only."""
    return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)

