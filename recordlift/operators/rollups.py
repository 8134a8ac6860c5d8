"""The error profile by groups of documents, columns and codes, with all their subtotals."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlift.functions.text import strip
from recordlift.plans.config import Spec


def column_of_code(spec: Spec) -> Column:
    """The column that an error code belongs to, as a map; the code of duplicates belongs to their key."""
    found: dict[str, str] = {}
    for t in spec.triggers:
        for code in (t.missing_code, t.valid_code if t.valid is not None else None, t.stop_code if t.stop else None):
            if code:
                found.setdefault(code, t.column)
    if spec.dedup_key is not None:
        found.setdefault(spec.dedup_code, spec.dedup_key)
    return F.create_map(*(F.lit(x) for pair in found.items() for x in pair)) if found else F.create_map().cast("map<string,string>")


def error_facts(records: DataFrame, spec: Spec, group: Column) -> DataFrame:
    """grp, field, code, doc_id: a row for each code of each record; codes of no column have a null field."""
    codes = F.filter(F.transform(F.split(F.coalesce("err", F.lit("")), ";"), strip), lambda c: c != "")
    rows = records.select(group.cast("string").alias("grp"), "doc_id", F.explode(codes).alias("code"))
    return rows.select("grp", F.try_element_at(column_of_code(spec), F.col("code")).alias("field"), "code", "doc_id")


def rollup_sets(columns: list[str]) -> list[tuple[str, ...]]:
    """All columns, then one less from the end each time, down to none."""
    return [tuple(columns[:k]) for k in range(len(columns), -1, -1)]


def cube_sets(columns: list[str]) -> list[tuple[str, ...]]:
    return [c for k in range(len(columns), -1, -1) for c in combinations(columns, k)]


def subtotals(facts: DataFrame, columns: list[str], distinct: str, sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """The columns (null where summed up), grouping_id, cnt, distinct_<name>: rows, and exactly how many different
    values of `distinct`, for each set of columns; a rollup if no sets are given.

    grouping_id has a bit for each column that is summed up, the first column's the highest, which tells a null of the
    data from one of a subtotal. Two stages: rows are counted for all columns and the distinct value first, and only
    these counts are expanded to the sets; so a row is shuffled once, however many sets there are, and no group's
    different values ever stand in one task."""
    sets = rollup_sets(columns) if sets is None else sets
    quoted = lambda c: F.col(f"`{c}`")
    counted = facts.groupBy(*map(quoted, columns), quoted(distinct)).agg(F.count("*").alias("cnt"))

    def expanded(chosen: tuple[str, ...]) -> Column:
        bits = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in chosen)
        kinds = dict(facts.dtypes)
        return F.struct(F.lit(bits).alias("grouping_id"), *((quoted(c) if c in chosen else F.lit(None).cast(kinds[c])).alias(c) for c in columns))

    each = counted.select(F.explode(F.array(*map(expanded, sets))).alias("g"), quoted(distinct).alias("of"), "cnt")
    once = each.groupBy("g", "of").agg(F.sum("cnt").alias("cnt"))
    out = once.groupBy("g").agg(F.sum("cnt").alias("cnt"), F.count("of").alias(f"distinct_{distinct}"))
    return out.select(*(F.col("g")[c].alias(c) for c in columns), "g.grouping_id", "cnt", f"distinct_{distinct}")
