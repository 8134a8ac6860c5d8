"""What differs between two tables of records, such as two configurations' results over the same documents.

Both are one table with a sign for a row, so equal rows cancel out in partial sums before they are shuffled, nulls equal
nulls, and rows that stand several times count as often as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _row(df: DataFrame, columns: list[str]) -> Column:
    return F.struct(*(_column(c).alias(c) for c in columns))


def multiset_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """row (a struct of the columns of `before`), n: how many more times the row stands in `after`, less than 0 for
    fewer; rows that both hold equally often are left out. The columns of `after` are taken by name."""
    columns = before.columns
    signed = lambda df, sign: df.select(_row(df, columns).alias("row"), F.lit(sign).cast("long").alias("sign"))
    both = signed(before, -1).unionByName(signed(after, 1))
    return both.groupBy("row").agg(F.sum("sign").alias("n")).where(F.col("n") != 0)


def changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys (a struct), nth, change (added, removed, changed), field, before, after (text): a row for each field whose
    value differs, and one with a null field for a row that only one side has.

    Rows with equal keys are matched by their order among the rows that differ: the nth of one side is the nth of the
    other. Only rows that differ take part in that, so a key that both sides hold alike costs nothing."""
    fields = [c for c in before.columns if c not in keys]
    different = multiset_difference(before, after)
    rows = different.select(F.struct(*(F.col("row")[k].alias(k) for k in keys)).alias("keys"), F.col("row"), "n", (F.col("n") > 0).alias("new"))
    # as many rows as a row stands more often on its side
    each = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.abs("n")))).drop("n", "copy")
    side = lambda held: F.sort_array(F.collect_list(F.when(held, F.col("row"))))
    met = each.groupBy("keys").agg(side(~F.col("new")).alias("old"), side(F.col("new")).alias("fresh"))
    pairs = F.arrays_zip("old", "fresh")
    paired = met.select("keys", F.posexplode(pairs).alias("nth", "p"))
    old, fresh = F.col("p.old"), F.col("p.fresh")
    text = lambda side, c: side[c].cast("string")
    kinds = [F.struct(F.lit(c).alias("field"), text(old, c).alias("before"), text(fresh, c).alias("after"), (~old[c].eqNullSafe(fresh[c])).alias("differs")) for c in fields]
    lone = F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"), F.lit(True).alias("differs"))
    both = old.isNotNull() & fresh.isNotNull()
    listed = F.when(both, F.filter(F.array(*kinds), lambda x: x["differs"]) if kinds else F.array().cast("array<struct<field: string, before: string, after: string, differs: boolean>>")).otherwise(F.array(lone))
    kind = F.when(both, "changed").when(old.isNull(), "added").otherwise("removed")
    return paired.select("keys", "nth", kind.alias("change"), F.explode(listed).alias("x")).select("keys", "nth", "change", "x.field", "x.before", "x.after")
