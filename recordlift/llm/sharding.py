"""Minimax contiguous partition of atomic groups into a fixed number of shards.

Groups (equal texts) stand in the order of their smallest doc_id. The capacity sought is the smallest for which a
greedy walk, which fills each shard as far as it goes, needs no more shards than allowed. The walk only asks for
the largest running total not above some bound, so the running totals stay distributed: the driver holds a sorted
sample of them, knows how many lie unseen between two, and gives lower and upper bounds for every cut. Capacities
that both bounds agree on are settled; where they differ, only the totals in doubt are sampled more finely. The
sample is bounded by `detail` whatever the number of groups, and the answer is exact.

Defined results: a null text has no bytes and belongs to the empty texts' group; a null doc_id stands first;
repeated rows are members of one group and get slots of their own; an empty table gives an empty result; further
columns are ignored. A group larger than the even share makes its shard larger: groups are never cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlift.llm.common import documents, stored

SHARDS = 24
#: rows of a range that one task sums
RANGE = 2_000_000


def with_running_totals(df: DataFrame, order: list[str], sums: dict[str, str], name: str, rows: int = 0) -> DataFrame:
    """Adds totals over all rows up to and including each, in the order given. Rows are dealt by range; only a
    row for each range comes to the driver, and no range is summed in one task with another. There are as many ranges
    as the session has shuffle partitions, or more, so that each has at most RANGE of the rows given."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // RANGE + 1)
    dealt = stored(df.repartitionByRange(parts, *(F.asc_nulls_first(c) for c in order)).withColumn("_range", F.spark_partition_id()), name)
    totals = sorted(dealt.groupBy("_range").agg(*(F.sum(c).alias(out) for out, c in sums.items())).collect(), key=lambda r: r["_range"])
    before, offsets = dict.fromkeys(sums, 0), []
    for r in totals:
        offsets.append((r["_range"], *(before[o] for o in sums)))
        before = {o: before[o] + r[o] for o in sums}
    table = F.broadcast(spark.createDataFrame(offsets, "_range int, " + ", ".join(f"_{o} long" for o in sums)))
    within = Window.partitionBy("_range").orderBy(*(F.asc_nulls_first(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.select("*", *(F.sum(c).over(within).alias(o) for o, c in sums.items())).join(table, "_range")
    return summed.select(*df.columns, *((F.col(o) + F.col(f"_{o}")).alias(o) for o in sums))


class Totals:
    """Known running totals; dark[i] says that others, not yet seen, may lie between known[i] and known[i + 1]."""

    def __init__(self, groups: DataFrame, total: int, detail: int):
        self.groups, self.detail = groups, detail
        self.known, self.dark = np.array([0, total], np.int64), np.array([True])
        self.refine([(0, total)])

    def refine(self, zones: list[tuple[int, int]]) -> None:
        """Looks closer at the zones: the smallest and largest total, and how many there are, in each of `detail` steps."""
        merged: list[list[int]] = []
        for a, b in sorted(zones):
            a = int(self.known[np.searchsorted(self.known, a, side="right") - 1])
            b = int(self.known[np.searchsorted(self.known, b, side="left")])
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        step = max(1, sum(b - a for a, b in merged) // self.detail)
        place = F.lit(None).cast("string")
        for i, (a, b) in enumerate(merged):
            place = F.when((F.col("upto") > a) & (F.col("upto") <= b), F.concat(F.lit(f"{i}:"), F.floor((F.col("upto") - a - 1) / step).cast("string"))).otherwise(place)
        rows = self.groups.select("upto", place.alias("p")).where("p is not null").groupBy("p").agg(F.min("upto").alias("low"), F.max("upto").alias("top"), F.count("*").alias("n")).collect()
        still = {(r.low, r.top) for r in rows if r.n > 2}
        before = dict(zip(self.known[:-1].tolist(), self.dark.tolist(), strict=True))
        points = sorted({*self.known.tolist(), *(r.low for r in rows), *(r.top for r in rows)})
        within = lambda p, q: any(a <= p and q <= b for a, b in merged)
        self.dark = np.array([(p, q) in still if within(p, q) else before[p] for p, q in zip(points[:-1], points[1:], strict=True)], bool)
        self.known = np.array(points, np.int64)

    def below(self, bound: int) -> tuple[int, int]:
        """The largest running total not above the bound lies between these two."""
        i = int(np.searchsorted(self.known, bound, side="right")) - 1
        low = int(self.known[i])
        dark = i < len(self.dark) and self.dark[i]
        return low, min(bound, int(self.known[i + 1]) - 1) if dark else low

    def walk(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        cuts, low, high = [], 0, 0
        for _ in range(shards):
            low, high = self.below(low + capacity)[0], self.below(high + capacity)[1]
            cuts.append((low, high))
        return cuts


def minimax_cuts(groups: DataFrame, total: int, largest: int, shards: int = SHARDS, detail: int = 8192) -> list[int]:
    """The running totals at which the shards end, for the smallest feasible capacity. groups: column upto, unique."""
    if not total:
        return [0] * shards
    totals = Totals(groups, total, detail)
    low, high = max(largest, -(-total // shards)), total
    while True:
        # certainly infeasible below `low`, certainly feasible at `high`
        sure, a, b = high, low, high
        while a < b:
            mid = (a + b) // 2
            if totals.walk(mid, shards)[-1][0] >= total:
                b = mid
            else:
                a = mid + 1
        sure = b
        a, b = low, sure
        while a < b:
            mid = (a + b) // 2
            if totals.walk(mid, shards)[-1][1] >= total:
                b = mid
            else:
                a = mid + 1
        low, high = a, sure
        cuts = totals.walk(high, shards)
        if low == high and all(x == y for x, y in cuts):
            return [x for x, _ in cuts]
        zones = [(x[0], y[1]) for x, y in zip(totals.walk(low, shards), cuts, strict=True) if x[0] < y[1]]
        totals.refine(zones)


def shard(docs: DataFrame, shards: int = SHARDS, detail: int = 8192) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: a row for each document."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key")),
        "shard-rows",
    )
    n = rows.count()
    groups = rows.groupBy("key").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first"), F.sum("size").alias("weight"), F.count("*").alias("n"))
    groups = stored(with_running_totals(groups, ["first", "key"], {"upto": "weight", "rows": "n"}, "shard-groups", n), "shard-totals")
    head = groups.agg(F.max("upto"), F.max("weight")).first()
    cuts = minimax_cuts(groups, head[0] or 0, head[1] or 0, shards, detail)
    at = F.lit(shards - 1)
    for k in reversed(range(shards - 1)):
        at = F.when(F.col("upto") <= cuts[k], k).otherwise(at)
    placed = groups.select("key", "first", "upto", (F.col("rows") - F.col("n")).alias("start"), at.cast("int").alias("shard"))
    starts = {r.shard: r.start for r in placed.groupBy("shard").agg(F.min("start").alias("start")).collect()}
    begin = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k in range(shards) for x in (k, starts.get(k, 0)))), F.col("shard")), F.lit(0))
    # the order of groups, then of members, is the order of all rows, so a row's rank is its place among all
    members = rows.join(placed.select("key", "first", "shard"), "key").withColumn("one", F.lit(1))
    ranked = with_running_totals(members, ["first", "key", "doc_id"], {"place": "one"}, "shard-members", n)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - 1 - begin).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))

