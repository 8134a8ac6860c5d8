"""Secret scans over an incremental ledger of content-addressed blobs, in DataFrame functions only.

A version is a (path, text) row. Its text is addressed by SHA-256, so equal texts are one blob whatever their paths.
The ledger is a Parquet table of (blob, rule, version, spans): the pairs that were scanned, with or without a
finding. A scan takes the blobs of a batch of versions, subtracts the pairs that the ledger has, runs the rules
that are left, appends the new pairs, and joins the ledger's spans back to every path. Scanning the same table
again, or a table that shares blobs with it, runs no rule on what was seen; a rule with a new version runs alone.
The ledger is asked by address before any text moves: if it knows all, no text is read a second time, and up to
`MOST_SENT` unknown addresses are sent to the texts instead of dealing all texts by address.

Base rules are assign, access and hex; pem and jwt are the method's own. A private key is found with its body, up to
its END line or, where that is missing, as far as its letters go. Positions are code points, end exclusive.

Defined results: a null text is the empty text; a null doc_id is a path like any other; repeated rows each get
their row; an empty table gives an empty result; further columns are ignored by the scan and kept by redact().
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlift.llm.common import documents, fresh_path, stored


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    #: group whose length is tested, and the least length
    group: int
    least: int
    #: a pattern that every text with a finding matches: most texts need only this test
    gate: str


_KEY = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?"
RULES = (
    Rule("assign", 1, _KEY + "([A-Za-z0-9+/_.=-]+)", 2, 6, _KEY + "[A-Za-z0-9+/_.=-]{6}"),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 20, "AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, "[0-9a-f]+", 0, 24, "[0-9a-f]{24}"),
    Rule("pem", 2, "-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:, \\t\\r\\n-]*?-----END [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/=\\r\\n]*)", 0, 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 0, 1, "eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\."),
)
#: addresses up to which they are sent to all tasks (40 bytes each)
MOST_SENT = 500_000
BASE = ("assign", "access", "hex")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
LEDGER = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("rule", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("spans", SPANS)])


def spans_of(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches with their places: between two matches stands one part of split()."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["key"]) >= rule.least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    parts = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("hit"), tested.alias("key"))
    found = F.aggregate(parts, start, step)["spans"]
    return F.when(F.rlike(text, F.lit(rule.gate)), found).otherwise(F.array().cast(SPANS))


def _addressed(versions: DataFrame, path: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return versions.select(F.col(path).alias("path"), F.sha2(text, 256).alias("hex"), text.alias("text")).select("path", F.unhex("hex").alias("blob"), "text")


class Ledger:
    """Scanned (blob, rule, version) pairs under a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path or fresh_path(spark, "blob-ledger"), rules

    def table(self) -> DataFrame:
        """What was scanned with the rules' present versions; each pair once, even if a batch was written twice."""
        return self.spark.createDataFrame([], LEDGER) if (seen := self._all()) is None else seen.join(F.broadcast(self._rules()), ["rule", "version"], "left_semi").dropDuplicates(["blob", "rule", "version"])

    def _all(self) -> DataFrame | None:
        """What was ever scanned; None if nothing was."""
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _rules(self) -> DataFrame:
        return self.spark.createDataFrame([(r.kind, r.version) for r in self.rules], "rule string, version int")

    def scan(self, versions: DataFrame, path: str = "doc_id") -> DataFrame:
        """Appends the pairs of these versions that were unseen, and returns (blob, findings map by rule) of the ledger."""
        texts = _addressed(versions, path).select("blob", "text")
        one = F.first("text").alias("text")
        if (known := self._all()) is None:
            unseen = texts.groupBy("blob").agg(one).withColumn("seen", F.array().cast("array<string>"))
        else:
            seen = known.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("seen"))
            wanted = F.array(*(F.lit(f"{r.kind}:{r.version}") for r in self.rules))
            asked = texts.select("blob").distinct().join(seen, "blob", "left").select("blob", F.coalesce("seen", F.array().cast("array<string>")).alias("seen"))
            todo = stored(asked.where(F.size(F.array_except(wanted, "seen")) > 0), "unseen-blobs")
            if not (n := todo.count()):
                return self.findings()
            if n <= MOST_SENT:
                unseen = texts.join(F.broadcast(todo), "blob").groupBy("blob").agg(one, F.first("seen").alias("seen"))
            else:
                unseen = texts.groupBy("blob").agg(one).join(todo, "blob")
        pairs = F.array(
            *(
                F.when(F.array_contains("seen", f"{r.kind}:{r.version}"), F.lit(None)).otherwise(
                    F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r).alias("spans"))
                )
                for r in self.rules
            )
        )
        new = unseen.select("blob", F.explode(pairs).alias("p")).where("p is not null").select("blob", "p.*")
        new.write.mode("append").option("compression", "zstd").parquet(self.path)
        return self.findings()

    def findings(self) -> DataFrame:
        """blob and its spans, of blobs that have any."""
        found = self.table().where(F.size("spans") > 0)
        return found.groupBy("blob").agg(F.collect_list(F.struct("rule", "spans")).alias("found"))

    def by_path(self, versions: DataFrame, path: str = "doc_id") -> DataFrame:
        """path and spans (array of start, nth, kind, end in order) for every version, those without findings too."""
        rows = _addressed(versions, path).select("path", "blob")
        order = F.create_map(*(F.lit(x) for i, r in enumerate(self.rules) for x in (r.kind, i)))
        flat = F.flatten(F.transform("found", lambda f: F.transform(f["spans"], lambda s: F.struct(s["start"].alias("start"), order[f["rule"]].alias("nth"), f["rule"].alias("kind"), s["end"].alias("end")))))
        spans = self.findings().select("blob", F.array_sort(flat).alias("spans"))
        return rows.join(spans, "blob", "left").select("path", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: a row for each document."""
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.scan(docs)
    rows = ledger.by_path(docs)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(F.col("path").cast("long").alias("doc_id"), *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with its spans, in order and perhaps overlapping, replaced by the mask."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    last = lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, last)).otherwise(text)


def redact(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """The documents, every row and column kept, with secrets masked in text; n_chars, if there, counts anew."""
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.scan(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2(text, 256)).alias("blob"))
    flat = F.flatten(F.transform("found", lambda f: f["spans"]))
    marked = rows.join(ledger.findings().select("blob", F.array_sort(flat).alias("spans")), "blob", "left")
    found = F.size("spans") > 0
    row = F.col("row").withField("text", F.when(found, masked(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        # the struct is taken apart as a whole, so no column name can clash with those used here
        row = row.withField("n_chars", F.when(found, F.length(masked(F.col("row.text"), F.col("spans")))).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType))
    return marked.select(row.alias("row")).select("row.*")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def _sql_rule(kind: str, pattern: str, group: int, least: int, order: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
s_{kind} AS (
  SELECT doc_id, h, k, g, sum(length(h)) OVER w + sum(length(g)) OVER w - length(h) AS start
  FROM (SELECT doc_id, text, generate_subscripts(hs, 1) AS i, unnest(hs) AS h, unnest(ks) AS k, unnest(gs[1:len(hs)]) AS g
        FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS hs, regexp_extract_all(text, '{p}', {group}) AS ks, regexp_split_to_array(text, '{p}') AS gs FROM t)
        WHERE len(hs) > 0)
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f_{kind} AS (SELECT doc_id, '{kind}' AS kind, {order} AS nth, start, start + length(h) AS stop FROM s_{kind} WHERE length(k) >= {least})"""


OP4_SQL = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),"
    + ",".join(_sql_rule(r.kind, r.pattern, r.group, r.least, i) for i, r in enumerate(RULES))
    + ", f AS ("
    + " UNION ALL ".join(f"SELECT * FROM f_{r.kind}" for r in RULES)
    + """),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(concat(kind, ':', CAST(start AS BIGINT), ':', CAST(stop AS BIGINT)), ',' ORDER BY start, nth) FILTER (nth < 3) AS base,
      string_agg(concat(kind, ':', CAST(start AS BIGINT), ':', CAST(stop AS BIGINT)), ',' ORDER BY start, nth) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN a USING (doc_id)
"""
)
