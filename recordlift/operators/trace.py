"""What happened to each token of a record, as rows: a diagnostic view of the state machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlift.operators.assign import COLLECTING, GUESSED, _bit, assigned
from recordlift.operators.segment import segmented
from recordlift.plans.config import Spec
from recordlift.plans.parse import tokens_of

MOST = 20_000


def trace(docs: DataFrame, spec: Spec, most: int = MOST) -> DataFrame:
    """doc_id, rec_idx, tok_idx, token, event, field, dropped: at most `most` events of a document; dropped says on
    each row how many more there were. Each token is one event, so its place in the document is its event's number, and
    nothing is shuffled or sorted; a document is a row, also where several have one doc_id.

    Events: TRIGGER a keyword; HEUR recognised by a heuristic; COLLECT taken by a collector; ADD taken by an open
    field; STOP a stop word; LOST taken by no field.
    """
    tokens = tokens_of(docs, spec)
    rows = assigned(segmented(tokens.withColumn("n_all", F.size("toks").cast("long")), spec), spec)
    owner = F.get(F.filter("fields", lambda o: (F.col("t.i") >= o["start"]) & (F.col("t.i") < o["end"])), F.lit(0))
    each = rows.select("doc_id", "rec_idx", "n_all", "fields", F.posexplode("toks").alias("tok_idx", "t")).where(F.col("t.i") < most).withColumn("o", owner)
    stop = F.col("t.gstop") | F.coalesce(_bit(F.col("t.stop"), F.col("o.field")), F.lit(False))
    first = F.col("t.i") == F.col("o.start")
    event = (
        F.when(F.col("o").isNull(), F.when(F.col("t.trig") >= 0, "TRIGGER").when(F.col("t.gstop"), "STOP").otherwise("LOST"))
        .when((F.col("o.kind") >= GUESSED) & first, "HEUR").when(F.col("o.kind") == COLLECTING, "COLLECT").when(stop, "STOP").otherwise("ADD")
    )
    names = F.array(*(F.lit(t.name) for t in spec.triggers))
    index = F.when(event == "TRIGGER", F.col("t.trig")).otherwise(F.col("o.field"))
    return each.select("doc_id", "rec_idx", "tok_idx", F.col("t.tok").alias("token"), event.alias("event"), F.get(names, index).alias("field"), F.greatest(F.col("n_all") - most, F.lit(0)).alias("dropped"))


def event_counts(traced: DataFrame) -> DataFrame:
    """doc_id, rec_idx, event, cnt."""
    return traced.groupBy("doc_id", "rec_idx", "event").agg(F.count("*").alias("cnt"))
