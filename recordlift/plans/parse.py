"""The plan from documents to records: clean, tokenise, classify, cut, assign, normalise, validate, mark duplicates.

Up to the marking of duplicates every step is a function of one document, so it needs no shuffle and runs on streams.
A configuration with many aliases is the exception: its keywords are looked up in a join (operators/alias_index.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlift.functions.text import clean_text, letters_spaced, spaced, split_spaced
from recordlift.operators.alias_index import many_aliases, with_triggers
from recordlift.operators.assign import Compiled, assigned
from recordlift.operators.duplicates import mark_duplicates
from recordlift.operators.records import with_columns
from recordlift.operators.segment import cut
from recordlift.operators.tokens import annotated, noted, splitting
from recordlift.plans.config import Spec
from recordlift.sources.shared import stored


def identity(docs: DataFrame, spec: Spec) -> list[str]:
    """The columns that tell documents apart and order them: doc_seq too where it is given and no field of records."""
    return ["doc_seq", "doc_id"] if "doc_seq" in docs.columns and "doc_seq" not in spec.output else ["doc_id"]


def notes_of(docs: DataFrame, spec: Spec, aliases: DataFrame | None = None) -> DataFrame:
    """As tokens_of(), with words (the tokens' text) and notes (what the state machine needs) in place of tokens."""
    own, rules = identity(docs, spec), Compiled(spec)
    cleaned = _cleaned(docs, spec)
    looked_up = aliases is not None or many_aliases(spec)
    known = with_triggers(cleaned, spec, splitting(spec), aliases) if looked_up else cleaned.withColumn("trigs", F.lit(None))
    lined = known.select(*own, spaced(F.col("text"), splitting(spec)).alias("text"), "trigs")
    split = lined.select(*own, split_spaced(F.col("text")).alias("words"), letters_spaced(F.col("text")).alias("clean"), "trigs")
    return split.select(*own, "words", noted(F.col("words"), F.col("clean"), spec, rules, F.col("trigs") if looked_up else None).alias("notes"))


def _cleaned(docs: DataFrame, spec: Spec) -> DataFrame:
    text: Column = clean_text(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(*identity(docs, spec), text.alias("text"))


def tokens_of(docs: DataFrame, spec: Spec) -> DataFrame:
    """(doc_seq if given, doc_id, text) -> these without text, and annotated tokens; a null text is empty."""
    own = identity(docs, spec)
    cleaned = _cleaned(docs, spec)
    if not many_aliases(spec):
        return cleaned.select(*own, annotated(F.col("text"), spec).alias("toks"))
    known = with_triggers(cleaned, spec, splitting(spec))
    return known.select(*own, annotated(F.col("text"), spec, F.col("trigs")).alias("toks"))


def raw_records(docs: DataFrame, spec: Spec, lost: bool = False, aliases: DataFrame | None = None) -> DataFrame:
    """Records before duplicates are marked: doc_id, rec_idx, columns, err. No shuffle, unless aliases are looked up."""
    return with_columns(assigned(cut(notes_of(docs, spec, aliases), spec), spec), spec, lost)


def parse(docs: DataFrame, spec: Spec, lost: bool = False, aliases: DataFrame | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, rec_idx, the declared columns and err; null stands for an absent field. Documents with
    doc_seq (read_files() gives it) keep it in front, and "doc_seq, doc_id, rec_idx" is the order of the records.

    lost adds the array of tokens that no field took, kept only if the configuration has log_suspicious. aliases (trigger,
    alias) are further ones of the configuration's exact and fuzzy triggers, in a table of any size.
    """
    rows = mark_duplicates(raw_records(docs, spec, lost, aliases), spec)
    return rows.withColumn("lost", F.col("lost") if spec.keep_lost else F.array().cast("array<string>")) if lost else rows


def first_records(docs: DataFrame, spec: Spec, most: int) -> DataFrame:
    """The first `most` records in the order of their documents: only as many of the first documents are parsed as it
    takes, twice as many each time they gave too few. Documents that tie with the last one are parsed with it."""
    own, n = identity(docs, spec), most
    while True:
        last = docs.select(F.struct(*own).alias("at")).orderBy("at").limit(n).agg(F.count("*").alias("n"), F.max("at").alias("at"))
        last = stored(last, "first-documents")  # one row
        first = docs.join(F.broadcast(last.select("at")), F.struct(*own) <= F.col("at")).drop("at")
        rows = stored(parse(first, spec).orderBy(*own, "rec_idx").limit(most), "first-records")
        if rows.count() == most or last.first().n < n:
            return rows.orderBy(*own, "rec_idx")
        n *= 2
