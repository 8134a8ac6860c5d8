"""The profile of a growing set of documents: partial counts of each document are kept in a table, and a run parses only
documents that are new or have another version.

A run writes one folder of partial counts; it counts once it is whole (Spark's _SUCCESS file), so a run that failed has
no effect and can be repeated. A document's latest run holds for it; adding what is known already changes nothing.
Partial counts add up: totals and counts by sum, "first seen" by minimum, so the profile of the table is that of all the
documents' latest versions parsed at once.

Defined results: a version is the one given, else a digest of the text; of several versions of a document in one run the
greatest holds; null texts are empty and null ids are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlift.operators import profile
from recordlift.plans.config import Spec
from recordlift.plans.parse import parse
from recordlift.sources.shared import stored

#: what a row counts: the document itself, its records, records with an error, with the duplicate code, error codes,
#: values of a field, lost tokens
DOCUMENT, TOTAL, FAULTY, DUPLICATES, CODE, VALUE, LOST = "document", "total", "faulty", "duplicates", "code", "value", "lost"


class ProfileTable:
    """Partial counts under a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str, spec: Spec):
        self.spark, self.path, self.spec = spark, path.rstrip("/"), spec

    def _runs(self) -> list[int]:
        """The numbers of the runs that were written whole."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run-*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return sorted(int(f.getPath().getParent().getName().removeprefix("run-")) for f in found)

    def _all(self) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.path}/run-{n:06d}").withColumn("run", F.lit(n)) for n in self._runs()]
        out = parts[0] if parts else None
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def documents(self) -> DataFrame | None:
        """doc_id, version, run: the latest run of each document."""
        rows = self._all()
        return None if rows is None else rows.where(F.col("kind") == DOCUMENT).groupBy("doc_id").agg(F.max_by("value", "run").alias("version"), F.max("run").alias("run"))

    def add(self, docs: DataFrame) -> int:
        """Parses what is new of (doc_id, text, version if there is one) and keeps its counts; how many documents it was."""
        version = F.col("version").cast("string") if "version" in docs.columns else F.sha2(F.coalesce("text", F.lit("")), 256)
        rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(version, F.lit("")).alias("version"))
        known = self.documents()
        if known is not None:
            k = known.select(F.col("doc_id").alias("known_id"), F.col("version").alias("known_version"))
            rows = rows.join(k, F.col("doc_id").eqNullSafe(F.col("known_id")) & (F.col("version") == F.col("known_version")), "left_anti")
        rows = stored(rows.groupBy("doc_id").agg(F.max_by("text", F.struct("version", "text")).alias("text"), F.max("version").alias("version")), "profile-new")
        n = rows.count()
        if n:
            run = (self._runs() or [-1])[-1] + 1
            self._partial(rows).write.mode("overwrite").parquet(f"{self.path}/run-{run:06d}")
        return n

    def _partial(self, rows: DataFrame) -> DataFrame:
        """doc_id, kind, field, value, cnt, rec_idx, place (the first of its occurrences)."""
        records = stored(parse(rows, self.spec, lost=True), "profile-records")
        err = F.coalesce("err", F.lit(""))
        document = rows.select("doc_id", F.lit(DOCUMENT).alias("kind"), F.lit("").alias("field"), F.col("version").alias("value"), F.lit(0).alias("rec_idx"), F.lit(0).alias("place"))
        fact = lambda kind, field, value, place: F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), value.alias("value"), place.cast("int").alias("place"))
        none, zero = F.lit(""), F.lit(0)
        # what a record does not have is null here and left out below; lists are only made where there is something to list
        facts = [fact(TOTAL, "", none, zero), F.when(err != "", fact(FAULTY, "", none, zero)), F.when(F.contains(err, F.lit("errDUP")), fact(DUPLICATES, "", none, zero))]
        facts += [F.when(profile._text(c) != "", fact(VALUE, c, profile._text(c), zero)) for c in dict.fromkeys(self.spec.columns)]
        codes = F.when(err != "", F.transform(F.split(err, ";"), lambda c, i: fact(CODE, "", profile.strip(c), i)))
        lost = F.when(F.size("lost") > 0, F.transform("lost", lambda t, i: fact(LOST, "", t, i)))
        listed = F.array().cast("array<struct<kind: string, field: string, value: string, place: int>>")
        found = F.explode(F.concat(F.array(*facts), F.coalesce(codes, listed), F.coalesce(lost, listed))).alias("f")
        each = records.select("doc_id", "rec_idx", found).where(F.col("f").isNotNull() & ((F.col("f.kind") != CODE) | (F.col("f.value") != "")))
        each = each.select("doc_id", "f.kind", "f.field", "f.value", "rec_idx", "f.place")
        # both in one number, so that rows are counted by hash and not sorted
        first = F.min(F.shiftleft(F.col("rec_idx").cast("long"), 32) + F.col("place")).alias("first")
        counted = each.unionByName(document.select(*each.columns)).groupBy("doc_id", "kind", "field", "value").agg(F.count("*").alias("cnt"), first)
        low = F.col("first").bitwiseAND(F.lit((1 << 32) - 1))
        return counted.select("doc_id", "kind", "field", "value", "cnt", F.shiftright("first", 32).cast("int").alias("rec_idx"), low.cast("int").alias("place"))

    def _current(self, kind: str) -> DataFrame:
        """The partial counts that hold."""
        rows = self._all()
        if rows is None:
            return self.spark.createDataFrame([], "doc_id string, kind string, field string, value string, cnt long, rec_idx int, place int")
        latest = self.documents().select(F.col("doc_id").alias("of"), F.col("run").alias("latest"))
        return rows.where(F.col("kind") == kind).join(latest, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("run") == F.col("latest")), "left_semi")

    def _sum(self, kind: str) -> DataFrame:
        return self._current(kind).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias(kind))

    def summary(self) -> DataFrame:
        """As profile.summary()."""
        one = self._sum(TOTAL).crossJoin(self._sum(FAULTY)).crossJoin(self._sum(DUPLICATES))  # one row each
        rate = F.when(F.col(TOTAL) == 0, 0.0).otherwise(F.bround(F.col(FAULTY) / F.col(TOTAL) * 100, 1))
        return one.select("total", (F.col(TOTAL) - F.col(FAULTY)).alias("clean"), F.col(FAULTY).alias("with_errors"), rate.alias("error_rate"), "duplicates")

    def _top(self, kind: str, name: str, most: int | None) -> DataFrame:
        counted = self._current(kind).groupBy(F.col("value").alias(name)).agg(F.sum("cnt").alias("cnt"), F.min(F.struct("doc_id", "rec_idx", "place")).alias("seen"))
        return counted.select(name, "cnt") if most is None else counted.orderBy(F.desc("cnt"), "seen").limit(most).select(name, "cnt")

    def top_errors(self, most: int = profile.TOP_ERRORS) -> DataFrame:
        return self._top(CODE, "code", most)

    def lost_tokens(self, most: int | None = profile.TOP_LOST) -> DataFrame:
        return self._top(LOST, "token", most)

    def value_distribution(self, most: int = profile.TOP_VALUES) -> DataFrame:
        counts = self._current(VALUE).groupBy("field", "value").agg(F.sum("cnt").alias("cnt"), F.min(F.struct("doc_id", "rec_idx")).alias("seen"))
        return profile.distribution(counts, self.spec, most)

    def compact(self) -> None:
        """The counts that hold as one run of their own; earlier folders are left to whoever clears the path."""
        rows = self._all()
        if rows is None:
            return
        latest = self.documents().select(F.col("doc_id").alias("of"), F.col("run").alias("latest"))
        kept = rows.join(latest, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("run") == F.col("latest")), "left_semi").drop("run")
        kept.write.mode("overwrite").parquet(f"{self.path}/run-{self._runs()[-1] + 1:06d}")
