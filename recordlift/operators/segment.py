"""Documents to records: a record starts at every token that is the record trigger, and at the first token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlift.plans.config import Spec


def between(values: Column, start: Column, end: Column) -> Column:
    """values[start:end]. Inside a lambda function slice() would read the whole array each time."""
    return F.when(end > start, F.transform(F.sequence(start, end - 1), lambda k: F.get(values, k))).otherwise(F.slice(values, F.lit(1), F.lit(0)))


def slices(toks: Column, start_at: Column) -> Column:
    """The token array cut at the places given."""
    return F.transform(start_at, lambda s, k: F.slice(toks, s + 1, F.coalesce(F.get(start_at, k + 1), F.size(toks)) - s))


def cut(docs: DataFrame, spec: Spec) -> DataFrame:
    """(doc_id, further columns, words, notes) -> a row for each record as segmented() has them: these, rec_idx, base (the
    place of its first token). Each piece is read by its own places, so a long document's arrays are passed through once."""
    own = [c for c in docs.columns if c not in ("words", "notes")]
    if spec.record_trigger is None:
        return docs.select(*own, F.lit(0).alias("rec_idx"), F.lit(0).alias("base"), "words", "notes")
    names = [t.name for t in spec.triggers]
    wanted = names.index(spec.record_trigger) if spec.record_trigger in names else -2
    # where records begin, in the words and in the notes
    begin = F.filter(F.transform("notes", lambda t, k: F.struct(F.when((t["trig"] == wanted) & (t["i"] > 0), t["i"]).alias("i"), k.cast("int").alias("k"))), lambda x: x["i"].isNotNull())
    zero = F.lit(0)
    start_at = F.when(F.size("words") > 0, F.concat(F.array(F.struct(zero.alias("i"), zero.alias("k"))), begin)).otherwise(F.array().cast("array<struct<i: int, k: int>>"))
    placed = docs.select(*own, "words", "notes", start_at.alias("start_at"))

    def piece(s: Column, n: Column) -> Column:
        following = F.get(F.col("start_at"), n + 1)
        part = lambda name, at: between(F.col(name), s[at], F.coalesce(following[at], F.size(name))).alias(name)
        return F.struct(s["i"].alias("base"), part("words", "i"), part("notes", "k"))

    pieces = placed.select(*own, F.posexplode(F.transform("start_at", piece)).alias("rec_idx", "piece"))
    return pieces.select(*own, "rec_idx", "piece.base", "piece.words", "piece.notes")


def segmented(docs: DataFrame, spec: Spec) -> DataFrame:
    """(doc_id, further columns, toks) -> a row for each record: these, rec_idx, toks. Without record detection a document is one
    record, even an empty one; with it an empty document has none."""
    own = [c for c in docs.columns if c != "toks"]
    if spec.record_trigger is None:
        return docs.select(*own, F.lit(0).alias("rec_idx"), "toks")
    names = [t.name for t in spec.triggers]
    wanted = names.index(spec.record_trigger) if spec.record_trigger in names else -2
    begin = F.transform(F.filter("toks", lambda t: t["trig"] == wanted), lambda t: t["i"])
    start_at = F.when(F.size("toks") > 0, F.array_distinct(F.concat(F.array(F.lit(0)), begin))).otherwise(F.array().cast("array<int>"))
    placed = docs.select(*own, "toks", start_at.alias("start_at"))
    return placed.select(*own, F.posexplode(slices(F.col("toks"), F.col("start_at"))).alias("rec_idx", "toks"))
