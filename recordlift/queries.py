"""Queries over the driver's tables and the same in DuckDB's SQL.

Extraction is tested by round trips: registry text is made of columns, parsed again, and the SQL names the columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlift.functions.predicates import predicate
from recordlift.functions.rules import rule
from recordlift.functions.steps import step
from recordlift.functions.text import clean_text, letters, strip, tokenize, words
from recordlift.operators import profile
from recordlift.operators.alias_index import nearest
from recordlift.operators.compare import changes, multiset_difference
from recordlift.operators.duplicates import mark_duplicates
from recordlift.operators.incremental import ProfileTable
from recordlift.operators.ordered_joins import asof_join, overlaps
from recordlift.operators.rollups import cube_sets, error_facts, subtotals
from recordlift.operators.selftest import run_cases
from recordlift.operators.sessions import sessions, windowed
from recordlift.operators.tokens import classified
from recordlift.operators.trace import trace
from recordlift.plans.config import NAME_KEY, Spec, compile_config
from recordlift.plans.many import config_table, parse_many, problems_of
from recordlift.plans.parse import first_records, parse, tokens_of
from recordlift.sources.encodings import encoded
from recordlift.sources.exports import csv_escaped, digest_of, write_csv, write_json_array, write_one_csv, write_one_json, write_parquet
from recordlift.sources.files import decode_files, read_files
from recordlift.sources.shared import fresh_path, stored
from recordlift.streaming.windows import stream_firsts, stream_sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return keep


# --- registry text of the orders table ---------------------------------------------------------------------------

BASE = {
    NAME_KEY: "orders",
    "csv_columns": ["cell", "prio", "price", "stat"],
    "record_detection": {"trigger": "cell"},
    "triggers": {
        "cell": {"aliases": ["cell"], "search_mode": "fuzzy", "normalization": {"pipeline": ["strip", "digits_only"]}},
        "prio": {"aliases": ["prio"], "search_mode": "fuzzy"},
        "price": {"aliases": ["price"], "search_mode": "fuzzy", "normalization": {"pipeline": ["strip", "remove_spaces"]}},
        "stat": {"aliases": ["stat"], "search_mode": "fuzzy"},
    },
}


def spec(**triggers: dict) -> Spec:
    """The base configuration with changes to triggers; keys that are no trigger replace top-level keys."""
    raw = BASE | {k: v for k, v in triggers.items() if not isinstance(v, dict) or k in ("dedup", "tokenizer", "record_detection")}
    more = {k: v for k, v in triggers.items() if k not in raw or k in BASE["triggers"]}
    raw["triggers"] = {k: BASE["triggers"].get(k, {}) | more.get(k, {}) for k in [*BASE["triggers"], *(k for k in more if k not in BASE["triggers"])]}
    return compile_config(raw)


PRICE = "cast(cast(o_totalprice as decimal(15,2)) as string)"
PRICE_SQL = "CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS VARCHAR)"


def registry(spark: SparkSession, sf_dir: str, record: str) -> DataFrame:
    """A document for each customer: its orders' records, written by the expression, in the order of their keys."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.struct("o_orderkey", F.expr(record).alias("record")).alias("r"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["record"]), " ").alias("text"))


def _record(prio: str = "concat('prio ', o_orderpriority)", price: str = f"concat('price ', {PRICE})", stat: str = "concat('stat ', o_orderstatus)", cell: str = "concat('cell ', o_orderkey, '.')") -> str:
    return f"concat_ws(' ', {cell}, {prio}, {price}, {stat})"


def _fields(df: DataFrame, *more: str) -> DataFrame:
    return df.select("cell", "prio", "price", "stat", "err", *more)


def fields_sql(cell: str = "CAST(o_orderkey AS VARCHAR)", prio: str = "o_orderpriority", price: str = PRICE_SQL, stat: str = "o_orderstatus", err: str = "CAST(NULL AS VARCHAR)", more: str = "", source: str = "orders") -> str:
    return f"SELECT {cell} AS cell, {prio} AS prio, {price} AS price, {stat} AS stat, {err} AS err{more} FROM {source}"


@query(fields_sql(more=", o_custkey AS doc_id"))
def extract_orders(spark, sf_dir):
    return _fields(parse(registry(spark, sf_dir, _record()), spec()), "doc_id")


@query(fields_sql(more=", o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS rec_idx"))
def segment_records(spark, sf_dir):
    return _fields(parse(registry(spark, sf_dir, _record()), spec()), "doc_id", "rec_idx")


@query(fields_sql(more=", o_orderkey AS doc_id"))
def extract_single_records(spark, sf_dir):
    """A document for each order, without record detection."""
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(_record()).alias("text"))
    whole = compile_config({k: v for k, v in BASE.items() if k != "record_detection"})
    return _fields(parse(docs, whole), "doc_id")


GUESS = {"heuristics": {"if_missing_after": "cell", "detect_by": "regex:^[0-9]-", "priority": 5}}
MAYBE_PRIO = "if(o_orderkey % 7 = 0, o_orderpriority, concat('prio ', o_orderpriority))"


@query(fields_sql(err="CASE WHEN o_orderkey % 7 = 0 THEN 'errPRIO' END"))
def extract_missing_trigger(spark, sf_dir):
    return _fields(parse(registry(spark, sf_dir, _record(prio=MAYBE_PRIO)), spec(prio=GUESS)))


@query(fields_sql())
def extract_typos(spark, sf_dir):
    typos = "concat(if(o_orderkey % 5 = 0, 'prxo ', if(o_orderkey % 5 = 1, 'PRI. ', 'Prio: ')), o_orderpriority)"
    return _fields(parse(registry(spark, sf_dir, _record(prio=typos)), spec()))


@query(fields_sql())
def extract_regex_trigger(spark, sf_dir):
    """A keyword given by a regular expression, which the whole token must match in any case."""
    keyword = "concat(if(o_orderkey % 2 = 0, 'PR-', 'p-'), o_orderkey, ' ', o_orderpriority)"
    return _fields(parse(registry(spark, sf_dir, _record(prio=keyword)), spec(prio={"aliases": ["pr?-[0-9]+"], "search_mode": "regex"})))


@query(fields_sql(prio="CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END"))
def extract_two_triggers_one_column(spark, sf_dir):
    kinds = "concat(if(o_orderkey % 2 = 0, 'firm ', 'human '), o_orderpriority)"
    made = spec(firm={"aliases": ["firm"], "search_mode": "exact", "csv_column": "prio", "normalization": {"pipeline": ["uppercase"]}}, human={"aliases": ["human"], "search_mode": "exact", "csv_column": "prio", "normalization": {"pipeline": ["lowercase"]}})
    return _fields(parse(registry(spark, sf_dir, _record(prio=kinds)), made))


@query(fields_sql(err="CASE WHEN o_orderkey % 3 = 0 THEN 'errSTOP' WHEN o_orderkey % 3 = 1 THEN 'errST' END"))
def extract_stopwords(spark, sf_dir):
    prio = "concat('prio ', if(o_orderkey % 3 = 0, 'junk ', ''), o_orderpriority)"
    stat = "concat('stat ', o_orderstatus, if(o_orderkey % 3 = 1, ' void', ''))"
    return _fields(parse(registry(spark, sf_dir, _record(prio=prio, stat=stat)), spec(stop_words=["junk"], stat={"stop_words": ["void"], "stop_word_error": "errST"})))


@query(fields_sql(price=f"replace({PRICE_SQL}, '.', '.')"))
def extract_multitoken(spark, sf_dir):
    """The price stands in two tokens, and a token that does not fit ends the field."""
    price = f"concat('price ', replace({PRICE}, '.', '. '), ' pieces')"
    return _fields(parse(registry(spark, sf_dir, _record(price=price)), spec(price={"multi_token": {"enabled": True, "token_rule": "is_part_of_number_colon_dot"}})))


@query(fields_sql(prio="string_split(o_orderpriority || ' x', ' ')[1] || ' ' || string_split(o_orderpriority || ' x', ' ')[2]", err="'errPRIO'"))
def extract_collector(spark, sf_dir):
    guess = GUESS | {"collector": {"token_rule": "any", "max_tokens": 2}}
    return _fields(parse(registry(spark, sf_dir, _record(prio="concat(o_orderpriority, ' x y')")), spec(prio=guess)))


@query(fields_sql(err=f"CASE WHEN NOT regexp_full_match({PRICE_SQL}, '[0-9]+[.][0-4][0-9]') THEN 'errPRICE' END"))
def extract_validation(spark, sf_dir):
    return _fields(parse(registry(spark, sf_dir, _record()), spec(price={"validation": {"rule": "regex:[0-9]+[.][0-4][0-9]", "error_code": "errPRICE"}})))


@query(fields_sql(err="CASE WHEN o_orderpriority LIKE '% %' THEN 'errW' END"))
def extract_word_count(spark, sf_dir):
    return _fields(parse(registry(spark, sf_dir, _record()), spec(prio={"validation": {"rule": "word_count:1,1", "error_code": "errW"}})))


@query(fields_sql(prio="o_orderpriority || ' ,'"))
def extract_punctuation(spark, sf_dir):
    return _fields(parse(registry(spark, sf_dir, _record(prio="concat('prio ', o_orderpriority, ',')")), spec(tokenizer={"split_by": "whitespace_and_punctuation"})))


@query(fields_sql(stat="o_orderstatus || ' ' || o_orderstatus"))
def extract_repeated_field(spark, sf_dir):
    return _fields(parse(registry(spark, sf_dir, _record(stat="concat('stat ', o_orderstatus, ' stat ', o_orderstatus)")), spec()))


# --- duplicates and statistics -----------------------------------------------------------------------------------

_DUP = "CASE WHEN row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) > 1 THEN 'errDUP' END"


@query(fields_sql(err=_DUP))
def dedup_mark(spark, sf_dir):
    return _fields(parse(registry(spark, sf_dir, _record()), spec(dedup={"key": "prio"})))


@query(fields_sql(prio="CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END", err="CASE WHEN row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderkey % 2 ORDER BY o_orderkey) > 1 THEN 'twice' END"))
def dedup_case_sensitive(spark, sf_dir):
    prio = "concat('prio ', if(o_orderkey % 2 = 0, lower(o_orderpriority), o_orderpriority))"
    return _fields(parse(registry(spark, sf_dir, _record(prio=prio)), spec(dedup={"key": "prio", "case_sensitive": True, "error_code": "twice"})))


def mixed_text(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Spec]:
    """Text of records with errors of several kinds: a missing keyword, a stop word, a broken rule, duplicates."""
    record = _record(prio=MAYBE_PRIO, stat="concat('stat ', o_orderstatus, if(o_orderkey % 3 = 0, ' void', ''))")
    made = spec(prio=GUESS, stat={"stop_words": ["void"]}, price={"validation": {"rule": "regex:[0-9]+[.][0-4][0-9]", "error_code": "errPRICE"}}, dedup={"key": "prio"})
    return registry(spark, sf_dir, record), made


def mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Spec]:
    docs, made = mixed_text(spark, sf_dir)
    return parse(docs, made), made


MIXED_SQL = f"""m AS (SELECT o_custkey AS doc_id, o_orderkey, CAST(o_orderkey AS VARCHAR) AS cell, o_orderpriority AS prio, {PRICE_SQL} AS price, o_orderstatus AS stat,
  concat_ws('; ', {_DUP}, CASE WHEN NOT regexp_full_match({PRICE_SQL}, '[0-9]+[.][0-4][0-9]') THEN 'errPRICE' END, CASE WHEN o_orderkey % 7 = 0 THEN 'errPRIO' END, CASE WHEN o_orderkey % 3 = 0 THEN 'errSTOP' END) AS err
  FROM orders)"""
CELLS_SQL = "v AS (UNPIVOT (SELECT doc_id, o_orderkey, cell, prio, price, stat FROM m) ON cell, prio, price, stat INTO NAME field VALUE value)"


@query(f"WITH {MIXED_SQL} SELECT cell, prio, price, stat, nullif(err, '') AS err FROM m")
def extract_mixed(spark, sf_dir):
    return _fields(mixed(spark, sf_dir)[0])


@query(f"WITH {MIXED_SQL} SELECT count(*) AS total, count_if(err = '') AS clean, count_if(err <> '') AS with_errors, round_even(100.0 * count_if(err <> '') / count(*), 1) AS error_rate, count_if(contains(err, 'errDUP')) AS duplicates FROM m".replace("count_if(", "count(*) FILTER ("))
def stats_summary(spark, sf_dir):
    return profile.summary(mixed(spark, sf_dir)[0])


@query(f"WITH {MIXED_SQL} SELECT code, count(*) AS cnt FROM (SELECT unnest(string_split(err, '; ')) AS code FROM m WHERE err <> '') GROUP BY code")
def top_errors(spark, sf_dir):
    return profile.top_errors(mixed(spark, sf_dir)[0])


@query(f"WITH {MIXED_SQL}, {CELLS_SQL} SELECT field, count(*) AS filled, CAST(100 AS BIGINT) AS percent FROM v GROUP BY field")
def field_fill(spark, sf_dir):
    return profile.field_fill(*mixed(spark, sf_dir))


@query(
    """WITH f AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 3 > 0) AS prio, count(*) FILTER (o_orderkey % 8 = 0) AS price FROM orders)
    SELECT field, filled, CAST(round_even(100.0 * filled / n, 0) AS BIGINT) AS percent FROM (SELECT n, unnest(['cell', 'prio', 'price', 'stat']) AS field, unnest([n, prio, price, 0]) AS filled FROM f)"""
)
def field_fill_partly(spark, sf_dir):
    """Columns that many records lack, one of them everywhere."""
    record = _record(prio="if(o_orderkey % 3 > 0, concat('prio ', o_orderpriority), null)", price=f"if(o_orderkey % 8 = 0, concat('price ', {PRICE}), null)", stat="'stat'")
    return profile.field_fill(parse(registry(spark, sf_dir, record), spec()), spec())


@query(
    f"""WITH {MIXED_SQL}, {CELLS_SQL}, c AS (SELECT field, value, count(*) AS cnt, min({{'d': doc_id, 'o': o_orderkey}}) AS seen FROM v GROUP BY field, value),
    r AS (SELECT field, string_agg(value || '=' || cnt, ',' ORDER BY n) AS repeated FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY cnt DESC, seen) AS n FROM c WHERE cnt > 1) WHERE n <= 8 GROUP BY field)
    SELECT field, count(*) AS "unique", CAST(sum(cnt) AS BIGINT) AS filled, count(*) FILTER (cnt > 1) AS repeated_total, coalesce(any_value(repeated), '') AS repeated FROM c LEFT JOIN r USING (field) GROUP BY field"""
)
def value_distribution(spark, sf_dir):
    rows = profile.value_distribution(*mixed(spark, sf_dir))
    return rows.withColumn("repeated", F.array_join(F.transform("repeated", lambda r: F.concat_ws("=", r["value"], r["cnt"].cast("string"))), ","))


@query(f"WITH {MIXED_SQL} SELECT doc_id, cell, err FROM (SELECT doc_id, cell, nullif(err, '') AS err, row_number() OVER (ORDER BY doc_id, o_orderkey) AS n FROM m) WHERE n <= 50")
def preview(spark, sf_dir):
    docs, made = mixed_text(spark, sf_dir)
    return first_records(docs, made, profile.PREVIEW).select("doc_id", "cell", "err")


def kept_profile(spark: SparkSession, sf_dir: str) -> tuple[ProfileTable, list[int]]:
    """The profile of the mixed texts after two runs: half of the customers in an older version first, then all as they
    are; and how many texts each run parsed."""
    docs, made = mixed_text(spark, sf_dir)
    docs, kept = stored(docs, "texts"), ProfileTable(spark, fresh_path(spark, "profile"), made)
    older = docs.where("doc_id % 2 = 0").withColumn("text", F.expr("if(doc_id % 3 = 0, concat(text, ' cell 0 void zz'), text)"))
    return kept, [kept.add(older), kept.add(docs)]


@query(
    f"""WITH {MIXED_SQL}, d AS (SELECT count(DISTINCT doc_id) FILTER (doc_id % 2 = 0) AS first_run, count(DISTINCT doc_id) FILTER (doc_id % 2 = 1 OR doc_id % 3 = 0) AS second_run FROM m)
    SELECT count(*) AS total, count_if(err = '') AS clean, count_if(err <> '') AS with_errors, round_even(100.0 * count_if(err <> '') / count(*), 1) AS error_rate, count_if(contains(err, 'errDUP')) AS duplicates,
    any_value(first_run) AS first_run, any_value(second_run) AS second_run FROM m, d"""
)
def profile_incremental(spark, sf_dir):
    """The totals of a profile that was brought up to date, and how many texts each run had to parse."""
    kept, runs = kept_profile(spark, sf_dir)
    return kept.summary().select("*", F.lit(runs[0]).cast("long").alias("first_run"), F.lit(runs[1]).cast("long").alias("second_run"))


@query(SQL["value_distribution"])
def profile_incremental_values(spark, sf_dir):
    rows = kept_profile(spark, sf_dir)[0].value_distribution()
    return rows.withColumn("repeated", F.array_join(F.transform("repeated", lambda r: F.concat_ws("=", r["value"], r["cnt"].cast("string"))), ","))


@query(SQL["top_errors"])
def profile_incremental_errors(spark, sf_dir):
    return kept_profile(spark, sf_dir)[0].top_errors()


def unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of customers, each behind tokens that no field takes."""
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.concat_ws(" ", "c_mktsegment", F.concat(F.lit("Nation"), F.col("c_nationkey").cast("string")), F.lit("cell"), F.col("c_custkey").cast("string")).alias("text"))
    return parse(docs, spec(log_suspicious=True), lost=True)


LOST_SQL = "l AS (SELECT c_mktsegment AS token, c_custkey, 0 AS pos FROM customer UNION ALL SELECT 'Nation' || c_nationkey, c_custkey, 1 FROM customer)"


@query(f"WITH {LOST_SQL}, c AS (SELECT token, count(*) AS cnt, min({{'c': c_custkey, 'a': pos}}) AS seen FROM l GROUP BY token) SELECT token, cnt FROM c ORDER BY cnt DESC, seen LIMIT 50")
def lost_tokens(spark, sf_dir):
    return profile.lost_tokens(unplaced(spark, sf_dir))


@query(f'WITH {LOST_SQL} SELECT count(DISTINCT token) AS "unique", count(*) AS total FROM l')
def lost_summary(spark, sf_dir):
    return profile.lost_summary(unplaced(spark, sf_dir))


@query("""SELECT event, field, CAST(sum(n) AS BIGINT) AS cnt FROM (
    SELECT 'TRIGGER' AS event, unnest(['cell', 'price', 'stat']) AS field, 1 AS n FROM orders UNION ALL SELECT 'TRIGGER', 'prio', 1 FROM orders WHERE o_orderkey % 7 <> 0
    UNION ALL SELECT 'HEUR', 'prio', 1 FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT 'STOP', 'stat', 1 FROM orders WHERE o_orderkey % 3 = 0
    UNION ALL SELECT 'ADD', unnest(['cell', 'price', 'stat']), 1 FROM orders UNION ALL SELECT 'ADD', 'prio', len(string_split(o_orderpriority, ' ')) - CAST(o_orderkey % 7 = 0 AS INTEGER) FROM orders) WHERE n > 0 GROUP BY event, field""")
def trace_events(spark, sf_dir):
    record = _record(prio=MAYBE_PRIO, stat="concat('stat ', o_orderstatus, if(o_orderkey % 3 = 0, ' void', ''))")
    events = trace(registry(spark, sf_dir, record), spec(prio=GUESS, stat={"stop_words": ["void"]}))
    return events.groupBy("event", "field").agg(F.count("*").alias("cnt"))


@query(
    """SELECT doc_id, least(n, 9) AS n_events, greatest(n - 9, 0) AS dropped FROM (SELECT o_custkey AS doc_id, CAST(sum(7 + len(string_split(o_orderpriority, ' '))) AS BIGINT) AS n FROM orders GROUP BY o_custkey)"""
)
def trace_capped(spark, sf_dir):
    """At most nine events of a text, and how many more there were."""
    events = trace(registry(spark, sf_dir, _record()), spec(), most=9)
    return events.groupBy("doc_id").agg(F.count("*").alias("n_events"), F.max("dropped").alias("dropped"))


@query(
    """SELECT o_orderkey AS nth, CASE WHEN o_orderkey % 5 IN (0, 3) THEN 'fail' ELSE 'pass' END AS status,
    CASE o_orderkey % 5 WHEN 0 THEN 'stat' WHEN 3 THEN '(records)' END AS failed FROM orders"""
)
def self_test(spark, sf_dir):
    """A case for each order: what its text must give, what it cannot give, and a record that there isn't."""
    kind = F.pmod("o_orderkey", F.lit(5))
    expected = {"cell": F.col("o_orderkey").cast("string"), "prio": F.col("o_orderpriority"), "stat": F.when(kind == 0, F.concat("o_orderstatus", F.lit("?"))).otherwise(F.col("o_orderstatus")), "err": F.lit("")}
    cases = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("nth"), F.lit("order").alias("description"), F.concat(F.lit("cell 7 prio x "), F.expr(_record())).alias("text"), F.create_map(*(x for k, v in expected.items() for x in (F.lit(k), v))).alias("expect"),
        F.when(kind == 3, 2).when(kind == 4, -1).otherwise(1).alias("record"),
    )
    results = run_cases(cases, spec())
    failed = F.array_join(F.transform(F.filter("details", lambda d: ~d["ok"]), lambda d: d["field"]), ",")
    return results.select("nth", "status", F.nullif(failed, F.lit("")).alias("failed"))


# --- comparing and summing up results ---------------------------------------------------------------------------


def two_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The orders under two configurations; either lacks some orders."""
    docs = lambda n: registry(spark, sf_dir, f"if(o_orderkey % {n} = 0, null, {_record()})")
    after = spec(prio={"normalization": {"pipeline": ["lowercase"]}}, price={"validation": {"rule": "regex:[0-9]+[.][0-4][0-9]", "error_code": "errPRICE"}})
    return _fields(parse(docs(13), spec()), "doc_id"), _fields(parse(docs(11), after), "doc_id")


TWO_SQL = f"""b AS (SELECT o_custkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS cell, o_orderpriority AS prio, {PRICE_SQL} AS price, o_orderstatus AS stat, CAST(NULL AS VARCHAR) AS err FROM orders WHERE o_orderkey % 13 <> 0),
    a AS (SELECT o_custkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS cell, lower(o_orderpriority) AS prio, {PRICE_SQL} AS price, o_orderstatus AS stat, CASE WHEN NOT regexp_full_match({PRICE_SQL}, '[0-9]+[.][0-4][0-9]') THEN 'errPRICE' END AS err FROM orders WHERE o_orderkey % 11 <> 0)"""


@query(
    f"""WITH {TWO_SQL} SELECT doc_id, cell, 'changed' AS change, 'prio' AS field, b.prio AS before, a.prio AS after FROM a JOIN b USING (doc_id, cell) WHERE a.prio <> b.prio
    UNION ALL SELECT doc_id, cell, 'changed', 'err', NULL, a.err FROM a JOIN b USING (doc_id, cell) WHERE a.err IS NOT NULL
    UNION ALL SELECT doc_id, cell, 'removed', NULL, NULL, NULL FROM b ANTI JOIN a USING (doc_id, cell) UNION ALL SELECT doc_id, cell, 'added', NULL, NULL, NULL FROM a ANTI JOIN b USING (doc_id, cell)"""
)
def compare_configurations(spark, sf_dir):
    """What another configuration changes, field by field."""
    return changes(*two_results(spark, sf_dir), ["doc_id", "cell"]).select("keys.doc_id", "keys.cell", "change", "field", "before", "after")


@query(f"WITH {TWO_SQL} SELECT prio, stat, err, CAST(sum(n) AS BIGINT) AS n FROM (SELECT prio, stat, err, -1 AS n FROM b UNION ALL SELECT prio, stat, err, 1 FROM a) GROUP BY prio, stat, err HAVING sum(n) <> 0")
def compare_counts(spark, sf_dir):
    """Rows as often as one result has more of them than the other."""
    before, after = (df.select("prio", "stat", "err") for df in two_results(spark, sf_dir))
    return multiset_difference(before, after).select("row.*", "n")


FACTS_SQL = f"""{MIXED_SQL}, f AS (SELECT CAST(doc_id % 10 AS VARCHAR) AS grp, code, CASE code WHEN 'errPRICE' THEN 'price' WHEN 'errSTOP' THEN 'stat' ELSE 'prio' END AS field, doc_id
    FROM (SELECT doc_id, unnest(string_split(err, '; ')) AS code FROM m WHERE err <> ''))"""
TOTALS_SQL = "CAST(grouping(grp, field, code) AS INTEGER) AS grouping_id, count(*) AS cnt, count(DISTINCT doc_id) AS distinct_doc_id"


@query(f"WITH {FACTS_SQL} SELECT grp, field, code, {TOTALS_SQL} FROM f GROUP BY ROLLUP (grp, field, code)")
def error_rollup(spark, sf_dir):
    """Error codes by group of documents and column, with subtotals and exact numbers of documents."""
    records, made = mixed(spark, sf_dir)
    return subtotals(error_facts(records, made, F.pmod("doc_id", F.lit(10))), ["grp", "field", "code"], "doc_id")


@query(f"WITH {FACTS_SQL} SELECT grp, field, code, {TOTALS_SQL} FROM f GROUP BY CUBE (grp, field, code)")
def error_cube(spark, sf_dir):
    records, made = mixed(spark, sf_dir)
    columns = ["grp", "field", "code"]
    return subtotals(error_facts(records, made, F.pmod("doc_id", F.lit(10))), columns, "doc_id", cube_sets(columns))


# --- events ------------------------------------------------------------------------------------------------------


@query(
    """SELECT p.event_id, c.event_id AS click_id, c.value AS click_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts"""
)
def asof_clicks(spark, sf_dir):
    """Each purchase with the user's last click before it."""
    events = table(spark, sf_dir, "events")
    found = asof_join(events.where("event_type = 'purchase'"), events.where("event_type = 'click'"), ["user_id"], "ts", per_range=1000)
    return found.select("event_id", F.col("matched.event_id").alias("click_id"), F.col("matched.value").alias("click_value"))


SPAN_SQL = "epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 60000000) AS BIGINT) AS e"


@query(
    f"""WITH x AS (SELECT event_id, event_type, {SPAN_SQL} FROM events) SELECT a.event_id AS error_id, b.event_id AS signup_id FROM x a JOIN x b ON a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e
    WHERE a.event_type = 'error' AND b.event_type = 'signup'"""
)
def overlapping_events(spark, sf_dir):
    """Errors and sign-ups whose spans of `value` minutes overlap, of all users."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = table(spark, sf_dir, "events").select("event_id", "event_type", start.alias("s"), (start + F.floor(F.col("value") * 60000000)).alias("e"))
    pairs = overlaps(spans.where("event_type = 'error'"), spans.where("event_type = 'signup'"), ("s", "e"), ("s", "e"), per_bin=50)
    return pairs.select(F.col("a.event_id").alias("error_id"), F.col("b.event_id").alias("signup_id"))


SESSIONS_SQL = """s AS (SELECT user_id, ts, value, sum(CASE WHEN ts - before <= INTERVAL 6 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS nth
    FROM (SELECT user_id, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)),
    z AS (SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events, round(sum(value), 4) AS total FROM s GROUP BY user_id, nth)"""
SIX_HOURS = 6 * 3600 * 1_000_000


@query(f"WITH {SESSIONS_SQL} SELECT * FROM z")
def event_sessions(spark, sf_dir):
    """Runs of a user's events without a gap of over six hours."""
    rows = sessions(table(spark, sf_dir, "events"), "user_id", "ts", SIX_HOURS, "value")
    return rows.withColumn("total", F.round("total", 4))


def arriving(spark: SparkSession, events: DataFrame, files: int) -> DataFrame:
    """The events as a stream: files in the order of time, and behind them one far ahead that lets all windows end."""
    path = fresh_path(spark, "arriving")
    columns = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    low, high = columns.agg(F.min("ts"), F.max("ts")).first()
    for k in range(files):
        begin, end = low + (high - low) * k / files, low + (high - low) * (k + 1) / files
        inside = (F.col("ts") >= F.lit(begin)) & ((F.col("ts") < F.lit(end)) if k < files - 1 else F.lit(True))
        columns.where(inside).coalesce(1).write.parquet(f"{path}/{k:04d}")
    columns.limit(1).select(F.lit(-1).cast("long").alias("user_id"), (F.lit(high) + F.expr("interval 1000 days")).alias("ts"), "event_type", "value").write.parquet(f"{path}/{files:04d}")
    return spark.readStream.schema(columns.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*").where("ts is not null")


def appended(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """All that a stream gives out until its input ends."""
    path = fresh_path(spark, "appended")
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", fresh_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


@query(f"WITH {SESSIONS_SQL} SELECT user_id, session_start, session_end + INTERVAL 6 HOUR AS session_end, n_events, total FROM z")
def stream_event_sessions(spark, sf_dir):
    """The same sessions from a stream with a watermark, each given out once."""
    rows = appended(spark, stream_sessions(arriving(spark, table(spark, sf_dir, "events"), 3), "user_id", "ts", "6 hours", "1 hour", "value"))
    ends = {c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")}
    return rows.withColumns(ends).withColumn("total", F.round("total", 4))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_events(spark, sf_dir):
    """One event of each user and type from a stream that remembers them for longer than it lasts."""
    return appended(spark, stream_firsts(arriving(spark, table(spark, sf_dir, "events"), 3), ["user_id", "event_type"], "ts", "60 days")).where("user_id >= 0").select("user_id", "event_type")


@query("SELECT event_type, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    return windowed(table(spark, sf_dir, "events"), "ts", "1 day", by=["event_type"], value="value").withColumn("total", F.round("total", 4))


@query(
    """SELECT w AS window_start, w + INTERVAL 2 HOUR AS window_end, count(*) AS n_events, round(sum(value), 4) AS total
    FROM (SELECT value, unnest([time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k FOR k IN range(4)]) AS w FROM events) GROUP BY w"""
)
def sliding_windows(spark, sf_dir):
    """Windows of two hours that begin every half hour."""
    return windowed(table(spark, sf_dir, "events"), "ts", "2 hours", "30 minutes", value="value").withColumn("total", F.round("total", 4))


# --- text --------------------------------------------------------------------------------------------------------

WS_SQL = r"[\x1c-\x20\x09-\x0d\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKENS_SQL = f"list_filter(string_split_regex(text, '{WS_SQL}+'), lambda x: x <> '')"
CLEAN_SQL = "text"
for _ in range(3):
    CLEAN_SQL = f"regexp_replace({CLEAN_SQL}, '\\[[^\\[\\]]*\\]', ' ', 'g')"
CLEAN_SQL = f"regexp_replace(regexp_replace({CLEAN_SQL}, '[\\x{{feff}}\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{ad}}]', '', 'g'), '[\\x{{a0}}\\x{{2009}}\\x{{202f}}\\x{{2002}}\\x{{2003}}\\x{{2007}}\\x{{2008}}\\t\\r\\n]+', ' ', 'g')"
CLEAN_SQL = f"regexp_replace(regexp_replace({CLEAN_SQL}, ' {{2,}}', ' ', 'g'), '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"


@query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {TOKENS_SQL} AS w FROM documents)")
def tokenize_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", tokenize(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {TOKENS_SQL.replace('(text,', '(' + chr(32) + 'regexp_replace(text, ' + chr(39) + '([^' + WS_SQL[1:-1] + ']),' + chr(39) + ', ' + chr(39) + chr(92) + '1 , ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '),')} AS w FROM (SELECT doc_id, regexp_replace(text, ',,+', ',', 'g') AS text FROM documents))")
def tokenize_punctuation(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", tokenize(F.regexp_replace("text", ",,+", ","), "whitespace_and_punctuation").alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("digest"))


# a comma at the start or behind white space stays with what follows; every other one stands alone
COMMAS_SQL = f"regexp_replace(replace(text, '. ', ',,'), '(^|{WS_SQL}),', '\\1' || chr(2), 'g')"
COMMAS_SQL = f"replace(replace({COMMAS_SQL}, ',', ' , '), chr(2), ',')"


@query(f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {TOKENS_SQL.replace('(text,', '(' + COMMAS_SQL + ',')} AS w FROM documents)")
def tokenize_commas(spark, sf_dir):
    """Commas one behind another."""
    rows = table(spark, sf_dir, "documents").select("doc_id", tokenize(F.replace("text", F.lit(". "), F.lit(",,")), "whitespace_and_punctuation").alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(f"SELECT doc_id, length(c) AS n_chars, md5(c) AS digest FROM (SELECT doc_id, {CLEAN_SQL} AS c FROM (SELECT doc_id, concat('[a [b]] ', chr(65279), text, chr(160), ' [c') AS text FROM documents))")
def clean_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", clean_text(F.concat(F.lit("[a [b]] \ufeff"), F.col("text"), F.lit("\u00a0 [c"))).alias("c"))
    return rows.select("doc_id", F.length("c").cast("long").alias("n_chars"), F.md5("c").alias("digest"))


@query(f"SELECT token, count(*) AS cnt FROM (SELECT unnest({TOKENS_SQL}) AS token FROM documents) GROUP BY token")
def token_frequency(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.explode(tokenize(F.col("text"))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("cnt"))


@query("SELECT doc_id, text, encoding, encoding <> 'utf-8-sig' AS odd_encoding FROM (SELECT doc_id, text, 'utf-8-sig' AS encoding FROM documents UNION ALL SELECT -1 - c_custkey, c_name || ' Ёж', 'cp1251' FROM customer)")
def decode_bytes(spark, sf_dir):
    """Texts as UTF-8 bytes with a byte-order mark, and names as cp1251 bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(b"\xef\xbb\xbf"), F.col("text").cast("binary")).alias("content"))
    names = table(spark, sf_dir, "customer").select((-1 - F.col("c_custkey")).alias("doc_id"), F.concat(F.col("c_name").cast("binary"), F.lit(" Ёж".encode("cp1251"))).alias("content"))
    return decode_files(docs.unionByName(names)).select("doc_id", "text", "encoding", "odd_encoding")


RUSSIAN = "в начале года город строит новую дорогу и мост через реку жители ждут открытия Весной Москва Пётр сказал что это хорошо".split()
WESTERN = "forêt déjà très où élèves français für größere Bäume später señor años corazón também não está".split()
ENCODINGS = ("utf-8-sig", "cp1251", "koi8-r", "cp866", "iso8859-5", "latin-1", "utf-16-le", "utf-16-be")


@query(
    f"""WITH w AS (SELECT c_custkey, CASE WHEN c_custkey % 8 = 5 THEN {WESTERN!r} ELSE {RUSSIAN!r} END AS words FROM customer)
    SELECT c_custkey AS doc_id, array_to_string(list_transform(range(1, 13), lambda k: words[1 + (c_custkey * k + k * k) % len(words)]), ' ') || ' ' || c_custkey AS text,
    {list(ENCODINGS)!r}[1 + c_custkey % 8] AS encoding, c_custkey % 8 > 0 AS odd_encoding FROM w"""
)
def detect_encodings(spark, sf_dir):
    """Texts of words that the customers' keys choose, written in eight encodings that statistics have to tell apart."""
    key, place = F.col("c_custkey"), F.pmod(F.col("c_custkey"), F.lit(8))

    def text(words: list[str]) -> Column:
        listed = F.array(*(F.lit(w) for w in words))
        chosen = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.get(listed, F.pmod(key * k + k * k, F.lit(len(words))).cast("int")))
        return F.concat(F.array_join(chosen, " "), F.lit(" "), key.cast("string"))

    content = F.when(place == 0, text(RUSSIAN).cast("binary"))
    for k, name in enumerate(ENCODINGS[1:], 1):
        content = content.when(place == k, encoded(text(WESTERN), name) if name == "latin-1" else encoded(text(RUSSIAN), name))
    files = table(spark, sf_dir, "customer").select(key.alias("doc_id"), content.alias("content"))
    return decode_files(files, guess=True).select("doc_id", "text", "encoding", "odd_encoding")


# --- predicates and rules ----------------------------------------------------------------------------------------

_BARE = "trim(t, '.,;:!?()[]{}')"
PREDICATES = {
    "starts_upper": rf"regexp_matches({_BARE}, '^\p{{Lu}}') AND NOT regexp_matches({_BARE}, '[\p{{Nd}}²³¹⁰-₉]')",
    "has_letter": r"regexp_matches(t, '\p{L}')",
    "looks_like_number_colon_dot": "regexp_full_match(t, '[0-9А-ЯЁ.:]+')",
    "is_part_of_number_colon_dot": "regexp_full_match(t, '[0-9А-ЯЁ.:]+') AND regexp_matches(t, '[0-9.:]')",
    "any": "true",
    "regex:^[a-m]+": "regexp_matches(t, '^[a-m]+')",
    "has_letter | regex:[0-9]$": r"regexp_matches(t, '\p{L}|[0-9]$')",
}
PREDICATE_NAMES = dict(zip(PREDICATES, ("pred_starts_upper", "pred_has_letter", "pred_number_colon_dot", "pred_part_of_number", "pred_any", "pred_regex", "pred_either"), strict=True))


def _predicate_query(expression: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        return docs.select("doc_id", F.size(F.filter(tokenize(F.col("text")), predicate(expression))).cast("long").alias("n"))

    return run


for _expression, _test in PREDICATES.items():
    query(f"SELECT doc_id, CAST(len(list_filter({TOKENS_SQL}, lambda t: {_test})) AS BIGINT) AS n FROM documents", PREDICATE_NAMES[_expression])(_predicate_query(_expression))

RULES = {
    "rule_not_empty": ("not_empty", "true"),
    "rule_regex": ("regex:[a-z]+ [bg][a-z]+", "regexp_full_match(p_name, '[a-z]+ [bg][a-z]+')"),
    "rule_word_count": ("word_count:1,1", "len(string_split(p_name, ' ')) = 1"),
    "rule_unknown": ("no such rule", "true"),
}


def _rule_query(text: str) -> Query:
    return lambda spark, sf_dir: table(spark, sf_dir, "part").select("p_partkey", rule(text)(F.col("p_name")).alias("ok"))


for _name, (_text, _sql) in RULES.items():
    query(f"SELECT p_partkey, {_sql} AS ok FROM part", _name)(_rule_query(_text))

# --- normalisation steps: name -> step, table's key, input in Spark, result in SQL ---------------------------------

_P = "cast(cast(o_totalprice as decimal(15,2)) as string)"
STEPS: dict[str, tuple[str, str, str, str]] = {
    "step_strip": ("strip", "part", "concat('\u00a0 ', p_name, '\t')", "p_name"),
    "step_remove_trailing_dot": ("remove_trailing_dot", "part", "concat(p_name, '..')", "p_name"),
    "step_remove_dots": ("remove_dots", "orders", _P, f"replace({PRICE_SQL}, '.', '')"),
    "step_remove_spaces": ("remove_spaces", "part", "p_name", "replace(p_name, ' ', '')"),
    "step_collapse_spaces": ("collapse_spaces", "part", "concat(' ', replace(p_name, ' ', '  \n'))", "p_name"),
    "step_uppercase": ("uppercase", "part", "p_name", "upper(p_name)"),
    "step_lowercase": ("lowercase", "customer", "c_name", "lower(c_name)"),
    "step_digits_only": ("digits_only", "customer", "c_name", "regexp_replace(c_name, '[^0-9]', '', 'g')"),
    "step_replace_char": ("replace_char:#->/", "customer", "c_name", "replace(c_name, '#', '/')"),
    "step_replace_char_internal": ("replace_char:internal:-->_", "orders", "concat('-', o_orderpriority, '-')", "'-' || replace(o_orderpriority, '-', '_') || '-'"),
    "step_replace_char_no_arrow": ("replace_char:internal:.>/", "orders", _P, PRICE_SQL),
    "step_apply_replacements": ("apply_replacements", "part", "p_name", "replace(replace(p_name, 'red', 'blue'), 'blue', 'green')"),
    "step_dot_before_keywords": ("replace_dot_before_keywords:city,street", "part", "concat(p_name, '. City. x. streets')", "p_name || ', City. x. streets'"),
    "step_dot_after_keywords": ("replace_dot_after_keywords:city,street", "part", "concat('City. ', p_name, ' street.')", "'City ' || p_name || ' street'"),
    "step_space_before_keywords": ("replace_space_before_keywords:city,street", "part", "concat(p_name, ' city x,  y street')", "p_name || ', City x, Y, Street'"),
    "step_regex_sub": ("regex_sub:([a-z]+)#(?P<n>[0-9]+) -> \\g<n>-\\1$", "customer", "c_name", "regexp_replace(c_name, '([a-z]+)#([0-9]+)', '\\2-\\1$')"),
    "step_normalize_number": ("normalize_number", "orders", f"concat('1 ', replace({_P}, '.', ','))", f"'1' || {PRICE_SQL}"),
    "step_normalize_number_arguments": ("normalize_number:;:.", "orders", f"replace(concat('1.', {_P}), '.', if(o_orderkey % 2 = 0, '.', ';'))", f"CASE WHEN o_orderkey % 2 = 0 THEN replace('1.' || {PRICE_SQL}, '.', '') ELSE '1.' || {PRICE_SQL} END"),
    "step_to_int": ("to_int", "orders", f"replace({_P}, '.', ',')", "CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR)"),
    "step_to_float": ("to_float:1", "orders", "cast(o_totalprice as string)", "printf('%.1f', o_totalprice)"),
    "step_to_float_whole": ("to_float:0", "orders", f"{_P}", "printf('%.0f', o_totalprice)"),
    "step_pad_left": ("pad_left:12", "part", "p_name", "CASE WHEN length(p_name) < 12 THEN lpad(p_name, 12, '0') ELSE p_name END"),
    "step_pad_right": ("pad_right:12:x", "part", "p_name", "CASE WHEN length(p_name) < 12 THEN rpad(p_name, 12, 'x') ELSE p_name END"),
    "step_unknown": ("dots_to_colons", "orders", _P, PRICE_SQL),
}
_KEYS = {"part": "p_partkey", "orders": "o_orderkey", "customer": "c_custkey"}


def _step_query(name: str, source: str, text: str) -> Query:
    made = step(name, [("red", "blue"), ("blue", "green")])
    return lambda spark, sf_dir: table(spark, sf_dir, source).select(_KEYS[source], F.expr(text).alias("v")).select(_KEYS[source], made(F.col("v")).alias("value"))


for _name, (_step, _source, _text, _sql) in STEPS.items():
    query(f"SELECT {_KEYS[_source]}, {_sql} AS value FROM {_source}", _name)(_step_query(_step, _source, _text))


# --- classification, output --------------------------------------------------------------------------------------

LEV = compile_config({
    NAME_KEY: "parts", "csv_columns": ["size", "color", "thing", "old"], "stop_words": ["hot"],
    "triggers": {"size": {"aliases": ["smell", "large"], "search_mode": "fuzzy"}, "color": {"aliases": ["rad", "blue"], "search_mode": "fuzzy"}, "thing": {"aliases": ["rings", "bolts", "gear"], "search_mode": "fuzzy"}, "old": {"aliases": ["old"], "search_mode": "exact"}},
})
ALIASES_SQL = "a(pos, name, alias) AS (VALUES (0, 'size', 'smell'), (0, 'size', 'large'), (1, 'color', 'rad'), (1, 'color', 'blue'), (2, 'thing', 'rings'), (2, 'thing', 'bolts'), (2, 'thing', 'gear'))"


@query(
    f"""WITH {ALIASES_SQL}, w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part),
    b AS (SELECT word, name, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, alias), pos) AS n FROM (SELECT DISTINCT word FROM w) JOIN a ON word[1] = alias[1] AND levenshtein(word, alias) <= 1)
    SELECT p_partkey, word, CASE WHEN word = 'hot' THEN NULL WHEN word = 'old' THEN 'old' ELSE b.name END AS name FROM w LEFT JOIN b USING (word) WHERE b.n = 1 OR b.n IS NULL"""
)
def lev_match(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(words(F.col("p_name"))).alias("word"))
    names = F.array(*(F.lit(t.name) for t in LEV.triggers))
    return rows.select("p_partkey", "word", F.get(names, F.nullif(classified(F.col("word"), letters(F.col("word")), LEV), F.lit(-1))).alias("name"))


@query("SELECT name, count(*) AS cnt FROM (SELECT unnest(string_split(p_name, ' ')) AS word, CASE WHEN word = 'small' THEN 'size' WHEN word = 'large' THEN 'size' WHEN word IN ('red', 'rod', 'blue') THEN 'color' WHEN word IN ('ring', 'bolt', 'gear') THEN 'thing' WHEN word = 'old' THEN 'old' END AS name FROM part) GROUP BY name")
def classify_frequency(spark, sf_dir):
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    names = F.array(*(F.lit(t.name) for t in LEV.triggers))
    rows = tokens_of(docs, LEV).select(F.explode("toks").alias("t")).select(F.get(names, F.nullif("t.trig", F.lit(-1))).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("cnt"))


_ASCII_WORDS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+'))"


@query(
    f"""WITH v AS (SELECT DISTINCT {_ASCII_WORDS} AS word FROM documents),
    b AS (SELECT item_id AS trig, unnest(w) AS own, unnest(range(len(w))) AS nth FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+') AS w FROM benchmark)),
    f AS (SELECT own, min({{'trig': trig, 'nth': nth}}) AS first FROM b GROUP BY own),
    m AS (SELECT word, min({{'distance': levenshtein(word, own), 'first': first}}) AS best FROM v JOIN f ON word[1] = own[1] AND abs(len(word) - len(own)) <= 1 AND levenshtein(word, own) <= 1 GROUP BY word)
    SELECT word, CAST(best.distance AS INTEGER) AS distance, CAST(best.first.trig AS INTEGER) AS trig, CAST(best.first.nth AS INTEGER) AS nth FROM m"""
)
def alias_index(spark, sf_dir):
    """All words of the benchmark's items as aliases, looked up for all words of the documents."""
    found = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("([a-z]+)"))
    words = table(spark, sf_dir, "documents").select(F.explode(found).alias("word")).distinct()
    aliases = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("trig"), F.posexplode(found).alias("nth", "alias"))
    return nearest(words, aliases)


@query(fields_sql())
def extract_many_aliases(spark, sf_dir):
    """Each customer's text has keywords of its own, every third one with a letter left out: thousands of aliases."""
    n = table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]
    codes = spark.range(n + 1).select(F.explode(F.array(F.lit("cell"), F.lit("prio"))).alias("trigger"), F.expr("translate(cast(id as string), '0123456789', 'bcdfghjkmn')").alias("code"))
    aliases = codes.select("trigger", F.concat("trigger", "code").alias("alias"))
    own = "translate(cast(o_custkey as string), '0123456789', 'bcdfghjkmn')"
    keyword = lambda name: f"concat('{name}', if(o_orderkey % 3 = 0, substring({own}, 2), {own}))"
    record = _record(cell=f"concat({keyword('cell')}, ' ', o_orderkey, '.')", prio=f"concat({keyword('prio')}, ' ', o_orderpriority)")
    return _fields(parse(registry(spark, sf_dir, record), spec(), aliases=aliases))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN '''' ELSE '' END || substr('=+-@x', CAST(o_orderkey % 5 + 1 AS BIGINT), 1) || o_orderstatus AS value FROM orders")
def csv_escape(spark, sf_dir):
    value = F.expr("concat(substr('=+-@x', cast(o_orderkey % 5 + 1 as int), 1), o_orderstatus)")
    return table(spark, sf_dir, "orders").select("o_orderkey", csv_escaped(value).alias("value"))


SHOWN = ("cell", "prio", "price", "stat", "err")


def risky(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Spec]:
    """Records of which some columns are absent and some values look like formulas or need quotation marks."""
    record = _record(prio="if(o_orderkey % 3 = 0, null, concat('prio =', o_orderpriority))", stat="concat('stat \"', o_orderstatus, ',Ж\"')")
    return parse(registry(spark, sf_dir, record), spec()), spec()


def _written(rows: DataFrame, made: Spec, write: Callable[[DataFrame, str, Spec], None]) -> str:
    path = fresh_path(rows.sparkSession, "export")
    write(rows, path, made)
    return path


RISKY_STAT = "'\"' || o_orderstatus || ',Ж\"'"
RISKY_SQL = f"SELECT CAST(o_orderkey AS VARCHAR) AS cell, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE PRIO END AS prio, {PRICE_SQL} AS price, {RISKY_STAT} AS stat, '' AS err FROM orders"


@query(RISKY_SQL.replace("PRIO", "chr(39) || '=' || o_orderpriority"))
def sink_csv(spark, sf_dir):
    """Records written as CSV and read again; what a spreadsheet would take for a formula has its quotation mark."""
    path = _written(*risky(spark, sf_dir), write_csv)
    rows = spark.read.option("header", True).option("escape", '"').csv(path).toDF(*SHOWN)
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in SHOWN))


@query("SELECT count(*) AS lines, true AS marked, true AS ended FROM orders")
def sink_csv_bytes(spark, sf_dir):
    """Every file begins with a byte-order mark and the header, and every line ends with CRLF."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(_written(*risky(spark, sf_dir), write_csv))
    text = F.col("content").cast("string")
    counts = files.select((F.size(F.split(text, "\r\n", -1)) - 2).alias("n"), F.startswith(text, F.lit("﻿" + ",".join(SHOWN) + "\r\n")).alias("marked"), F.endswith(text, F.lit("\r\n")).alias("ended"))
    return counts.agg(F.sum("n").alias("lines"), F.bool_and("marked").alias("marked"), F.bool_and("ended").alias("ended"))


@query(RISKY_SQL.replace("PRIO", "'=' || o_orderpriority"))
def sink_json_array(spark, sf_dir):
    """Records written as arrays of objects and read again."""
    path = _written(*risky(spark, sf_dir), write_json_array)
    return spark.read.schema(", ".join(f"{c} string" for c in SHOWN)).option("multiLine", True).json(path).select(*SHOWN)


@query(fields_sql(prio="CASE WHEN o_orderkey % 3 > 0 THEN '=' || o_orderpriority END", stat=RISKY_STAT, more=", o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS rec_idx"))
def sink_parquet(spark, sf_dir):
    return spark.read.parquet(_written(*risky(spark, sf_dir), write_parquet)).select(*SHOWN, "doc_id", "rec_idx")


@query(
    """SELECT 1 AS doc_seq, 'utf-8-sig' AS encoding, string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10) AS text FROM customer GROUP BY c_nationkey
    UNION ALL SELECT 0, 'utf-8-sig', string_agg(s_name || ' Ж', chr(10) ORDER BY s_suppkey) || chr(10) FROM supplier GROUP BY s_nationkey"""
)
def scan_folders(spark, sf_dir):
    """A file for each nation in two folders, read in the order of the folders."""
    folders = []
    for name, key, nation, text in (("supplier", "s_suppkey", "s_nationkey", F.concat("s_name", F.lit(" Ж"))), ("customer", "c_custkey", "c_nationkey", F.col("c_name"))):
        lines = table(spark, sf_dir, name).repartition(F.col(nation)).sortWithinPartitions(nation, key).select(text.alias("value"), F.col(nation).alias("nation"))
        folders.append(path := fresh_path(spark, f"texts-{name}"))
        lines.write.partitionBy("nation").text(path)
    return read_files(spark, folders, glob="part-*").select("doc_seq", "encoding", "text")


def _one_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([digest_of(spark, path)], "length long, digest string")


ONE_CSV_SQL = f"""chr(65279) || 'cell,prio,price,stat,err' || chr(13) || chr(10) || string_agg(CAST(o_orderkey AS VARCHAR) || ',' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE chr(39) || '=' || o_orderpriority END
    || ',' || {PRICE_SQL} || ',' || repeat(chr(34), 3) || o_orderstatus || ',Ж' || repeat(chr(34), 3) || ',' || chr(13) || chr(10), '' ORDER BY o_custkey, o_orderkey)"""
MEMBER_SQL = lambda name, value: f"""'    "{name}": "' || {value} || '"'"""
ONE_JSON_SQL = "'[' || chr(10) || string_agg('  {' || chr(10) || " + " || ',' || chr(10) || ".join(
    MEMBER_SQL(n, v) for n, v in (("cell", "CAST(o_orderkey AS VARCHAR)"), ("prio", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '=' || o_orderpriority END"), ("price", PRICE_SQL), ("stat", "chr(92) || chr(34) || o_orderstatus || ',Ж' || chr(92) || chr(34)"), ("err", "''"))
) + " || chr(10) || '  }', ',' || chr(10) ORDER BY o_custkey, o_orderkey) || chr(10) || ']'"


@query(f"SELECT CAST(strlen(t) AS BIGINT) AS length, sha256(t) AS digest FROM (SELECT {ONE_CSV_SQL} AS t FROM orders)")
def sink_one_csv(spark, sf_dir):
    """All records as one file in their order, byte by byte."""
    return _one_file(spark, _written(*risky(spark, sf_dir), write_one_csv))


@query(f"SELECT CAST(strlen(t) AS BIGINT) AS length, sha256(t) AS digest FROM (SELECT {ONE_JSON_SQL} AS t FROM orders)")
def sink_one_json(spark, sf_dir):
    return _one_file(spark, _written(*risky(spark, sf_dir), write_one_json))


def ordered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of records for each nation in two folders: the list of folders has another order than their paths."""
    folders = []
    for name, key, nation in (("supplier", "s_suppkey", "s_nationkey"), ("customer", "c_custkey", "c_nationkey")):
        lines = table(spark, sf_dir, name).repartition(F.col(nation)).sortWithinPartitions(nation, key)
        folders.append(path := fresh_path(spark, f"ordered-{name}"))
        lines.select(F.concat(F.lit("cell "), F.col(key), F.lit(f" stat {name} prio "), F.pmod(F.col(key), F.lit(5)), F.lit(" zz")).alias("value"), F.format_string("%03d", nation).alias("nation")).write.partitionBy("nation").text(path)
    return read_files(spark, folders, glob="part-*")


ORDERED_SQL = """o AS (SELECT *, row_number() OVER (ORDER BY doc_seq, nation, key) - 1 AS record_no FROM (
    SELECT 0 AS doc_seq, s_nationkey AS nation, s_suppkey AS key, 'supplier' AS kind FROM supplier UNION ALL SELECT 1, c_nationkey, c_custkey, 'customer' FROM customer))"""


@query(f"WITH {ORDERED_SQL} SELECT doc_seq, record_no, CAST(key AS VARCHAR) AS cell, kind AS stat FROM o")
def record_numbers(spark, sf_dir):
    """Numbers without gaps in the order of the list of folders, their files, and the records in a file."""
    rows = profile.numbered(parse(ordered_files(spark, sf_dir), spec(stat={"multi_token": {"enabled": True, "token_rule": "regex:^[a-y]"}})))
    return rows.select("doc_seq", "record_no", "cell", "stat")


@query(f"WITH {ORDERED_SQL} SELECT CAST(key AS VARCHAR) AS cell, kind AS stat FROM o ORDER BY record_no LIMIT 50")
def preview_of_files(spark, sf_dir):
    """The first records in the order of the list, not of the paths."""
    made = spec(stat={"multi_token": {"enabled": True, "token_rule": "regex:^[a-y]"}})
    return first_records(ordered_files(spark, sf_dir), made, profile.PREVIEW).select("cell", "stat")


@query(f"WITH {ORDERED_SQL} SELECT 'p' || key % 5 AS value, count(*) AS cnt, CAST(min(record_no) AS BIGINT) AS first_no FROM o GROUP BY 1")
def first_seen_in_files(spark, sf_dir):
    """How often each value stands, and the number of the record that it is first seen in."""
    rows = profile.numbered(parse(ordered_files(spark, sf_dir), spec(stat={"multi_token": {"enabled": True, "token_rule": "regex:^[a-y]"}}, prio={"normalization": {"pipeline": ["digits_only", "regex_sub:^ -> p"]}})))
    seen = rows.select("doc_seq", "doc_id", "rec_idx", F.col("record_no").alias("first_no"))
    counts = profile.value_counts(rows.drop("record_no"), spec()).where("field = 'prio'").select("value", "cnt", "seen.*")
    return counts.join(seen, ["doc_seq", "doc_id", "rec_idx"]).select("value", "cnt", "first_no")


DEFECTS = {
    1: ("'{}'", ["missing key: \'parser_name\'", "missing key: \'csv_columns\'", "missing key: \'triggers\'"]),
    2: ("""'{"NAME":"p","csv_columns":["a"],"triggers":{"T":{"aliases":[],"search_mode":"none"}}}'""", ["trigger \'T\': aliases must be a list that is not empty", "trigger \'T\': search_mode must be one of exact, fuzzy, regex"]),
    3: ("""'{"NAME":"p","csv_columns":["a"],"dedup":{"key":"T"},"max_distance":"1","triggers":{"a":{"aliases":["a"],"search_mode":"exact"}}}'""", ["dedup.key \'T\' is not in csv_columns", "max_distance must be a whole number"]),
    4: ("'no JSON T'", ["the configuration is no JSON"]),
}
DEFECTS = {k: (text.replace("NAME", NAME_KEY), [p.replace("parser_name", NAME_KEY) for p in found]) for k, (text, found) in DEFECTS.items()}
_DEFECT_ROWS = ", ".join(f"({k}, {i}, '{p.replace(chr(39), 2 * chr(39))}')" for k, (_, found) in DEFECTS.items() for i, p in enumerate(found))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS config_id, nth, replace(problem, 'T', o_orderstatus || o_orderkey) AS problem FROM orders JOIN (VALUES {_DEFECT_ROWS}) v(kind, nth, problem) ON o_orderkey % 5 = kind")
def config_problems(spark, sf_dir):
    """All problems of configurations that the orders' keys make, a fifth of them without any."""
    good = json.dumps(BASE).replace("'", "")
    text = F.lit(good)
    for k, (defect, _) in DEFECTS.items():
        text = F.when(F.pmod("o_orderkey", F.lit(5)) == k, F.replace(F.expr(defect), F.lit("T"), F.concat("o_orderstatus", F.col("o_orderkey").cast("string")))).otherwise(text)
    return problems_of(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("config_id"), text.alias("config")))


@query("SELECT c_custkey, c_mktsegment AS value, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) > 1 AS again FROM customer")
def normalize_key(spark, sf_dir):
    """Keys of duplicates are compared without case and outer white space."""
    rows = table(spark, sf_dir, "customer").select(F.lit(0).alias("doc_id"), F.col("c_custkey").cast("int").alias("rec_idx"), F.concat(F.lit(" "), F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")), F.lit("\u00a0")).alias("prio"), F.lit(None).cast("string").alias("err"))
    marked = mark_duplicates(rows, spec(dedup={"key": "prio"}))
    return marked.select(F.col("rec_idx").cast("long").alias("c_custkey"), F.upper(strip(F.col("prio"))).alias("value"), (F.coalesce("err", F.lit("")) == "errDUP").alias("again"))
