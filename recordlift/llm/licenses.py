"""License scans by an exact set-similarity join of text blocks and license templates, in DataFrame functions only.

A template of m words is looked for in blocks of 2 * w consecutive words that begin at every w-th word, w being 1.25 * m
rounded up: whatever stands within w words, over any lines and sentences, is whole in a block. Templates and blocks
are sets of words, ordered by how often the word occurs in the whole corpus, rarest first (ties by the word). A
template of k different words is found in a block that holds at least need = ceil(threshold * k) of them - all of them if k is
under WHOLE, since among few words the missing one may be the one that tells licenses apart - and none of the words by
which another license of the family differs (BARRED). Such a block
must hold one of the template's k - need + 1 rarest words (prefix filter), must have `need` words (length filter), and
after the first shared word both sides must have need - 1 words left (positional filter). Texts without any of these
rarest words are left out first. Only words of templates are counted and kept in blocks, so the counted vocabulary and
every block are as large as the templates at most; the templates are measured before they are broadcast.

Base labels come from phrases whose words stand consecutively anywhere in the document.

Defined results: a null or empty text has no words, no labels and score 0; each row is judged by itself, so ties
and repeated rows each get their row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlift.llm.common import documents, stored
from recordlift.llm.license_texts import BODIES, HEADERS, NOTICES

# fixed values: phrases and their labels
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = NOTICES | HEADERS | BODIES
THRESHOLD = 0.8
#: different words under which a template must stand whole
WHOLE = 10
# fixed values: words that make another license of a notice or header
BARRED = {"gpl-3-notice": ("affero", "lesser"), "gpl-header": ("affero", "lesser")}
#: bytes of templates that are sent to all tasks
MOST_BYTES = 4 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def folded(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def word_line(text: Column) -> Column:
    """The words of a text with one space between them."""
    return F.btrim(F.regexp_replace(folded(text), _GAP, " "), F.lit(" "))


def template_words(text: str) -> list[str]:
    return [w for w in re.split(_GAP, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def step_of(n_words: int) -> int:
    """w for a template of so many words."""
    return -(-5 * n_words // 4)


def needed(k: int, threshold: float) -> int:
    """How many of a template's k different words a block must hold."""
    return k if k < WHOLE else math.ceil(threshold * k - 1e-9)


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def phrase_places(line: Column, phrase: str) -> Column:
    """How often the phrase stands in the padded line, and the first and last word it starts at."""
    parts = F.split(line, f"(?<= ){phrase}(?= )", -1)
    n_words = phrase.count(" ") + 1
    first = _spaces(F.element_at(parts, 1)) - 1
    last = _spaces(line) - 1 - (_spaces(F.element_at(parts, -1)) - 1) - n_words
    got = F.struct((F.size(parts) - 1).cast("long").alias("n"), first.cast("long").alias("first"), last.cast("long").alias("last"))
    return F.when(F.contains(line, F.lit(f" {phrase} ")), got)


def word_ranks(lines: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest in the corpus first. As many rows as the vocabulary has words come to the driver."""
    words = lines.select(F.explode(F.split("line", " ")).alias("w")).where(F.col("w").isin(*vocabulary))
    counts = {r.w: r.n for r in words.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _one_of(words: set[str]) -> str:
    """A pattern of the words in which each first letter is tried once."""
    letters = {w[0] for w in words}
    return "|".join(f"{c}(?:{'|'.join(w[1:] for w in sorted(words) if w[0] == c)})" for c in sorted(letters))


def find_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: a row for each document."""
    spark = docs.sparkSession
    if (size := sum(len(t.encode()) for t in templates.values())) > MOST_BYTES:
        raise ValueError(f"templates of {size} bytes are not broadcast")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = {name: template_words(t) for name, t in templates.items()}
    order = word_ranks(source.select(word_line(F.col("text")).alias("line")), sorted({w for words in (*split.values(), *BARRED.values()) for w in words}))
    rank = {w: i for i, w in enumerate(order)}
    index, openers = [], set()
    for name, words in split.items():
        ranks = sorted({rank[w] for w in words})
        need, barred = needed(len(ranks), threshold), [rank[w] for w in BARRED.get(name, ())]
        for at, r in enumerate(ranks[: len(ranks) - need + 1] if ranks else []):
            index.append((step_of(len(words)), r, name, at, need, len(ranks), ranks, barred))
            openers.add(order[r])

    # one pass over the texts: counts, base places, and the words of texts that hold an opener
    base = F.struct(*(phrase_places(F.col("line"), p).alias(f"p{i}") for i, p in enumerate(phrases)))
    gate = F.rlike("line", F.lit(f" (?:{_one_of(openers)}) ")) if openers else F.lit(False)
    rows = stored(
        source.withColumn("line", F.concat(F.lit(" "), word_line(F.col("text")), F.lit(" "))).select(
            "doc_id", F.when(F.col("line") == "  ", 0).otherwise(_spaces(F.col("line")) - 1).cast("long").alias("n_words"), base.alias("base"),
            F.when(gate, F.btrim("line", F.lit(" "))).alias("line"), F.monotonically_increasing_id().alias("row"),
        ),
        "license-rows",
    )

    vocabulary = F.broadcast(spark.createDataFrame(list(rank.items()), "word string, r int"))
    templates_index = F.broadcast(spark.createDataFrame(index, "w int, r int, name string, at int, need int, k int, ranks array<int>, barred array<int>"))
    hits = rows.where("line is not null").select("row", F.posexplode(F.split("line", " ")).alias("place", "word")).join(vocabulary, "word")
    # each word stands in two blocks of each size
    sizes = F.array(*(F.lit(w) for w in sorted({i[0] for i in index}))).cast("array<int>")
    halves = hits.select("row", "place", "r", F.explode(sizes).alias("w")).select("row", "r", "w", F.expr("explode(filter(array(place div w, place div w - 1), b -> b >= 0))").alias("block"))
    blocks = halves.groupBy("row", "w", "block").agg(F.array_sort(F.collect_set("r")).alias("set"))
    words = blocks.select("row", "w", "set", F.posexplode("set").alias("pos", "r"))
    shared = words.join(templates_index, ["w", "r"]).where("size(set) >= need and size(set) - pos >= need - at and k - at >= need - pos")
    overlap = F.size(F.array_intersect("set", "ranks"))
    found = shared.where((overlap >= F.col("need")) & ~F.arrays_overlap("set", "barred")).groupBy("row").agg(F.collect_set("name").alias("names"), F.max(overlap / F.col("k")).alias("share"))
    joined = rows.drop("line").join(found, "row", "left")

    places = F.filter(F.array(*(F.col(f"base.p{i}") for i in range(len(phrases)))), lambda p: p.isNotNull())
    labels = F.array_compact(F.array(*(F.when(F.col(f"base.p{i}").isNotNull(), F.lit(label)) for i, label in enumerate(phrases.values()))))
    out = joined.withColumn("places", places).withColumn("own", labels)
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.select(
        "doc_id", "n_words",
        F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["last"])).alias("last_word"),
        listed(F.col("own")).alias("base_labels"),
        listed(F.concat("own", F.coalesce("names", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("own") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(documents(spark, sf_dir))


def _sql_values() -> str:
    split = {name: template_words(t) for name, t in TEMPLATES.items()}
    return ", ".join(f"('{name}', {step_of(len(words))}, {sorted(set(words))!r}::VARCHAR[], {needed(len(set(words)), THRESHOLD)}, {list(BARRED.get(name, ()))!r}::VARCHAR[])" for name, words in split.items())


OP6_SQL = (
    r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
p AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: array_to_string(w[i + 1:i + n], ' ') = phrase)) AS place
      FROM (SELECT doc_id, w, phrase, label, len(string_split(phrase, ' ')) AS n FROM w, (VALUES PHRASES) v(phrase, label) WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || phrase || ' '))),
o AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS own FROM p GROUP BY doc_id),
v AS (SELECT * FROM (VALUES TEMPLATES) v(name, w, words, need, barred)),
s AS (SELECT doc_id, size, list_distinct(w[nth * size + 1:nth * size + 2 * size]) AS s
      FROM (SELECT doc_id, w.w, size, unnest(range(0, (len(w.w) - 1) // size + 1)) AS nth FROM w, (SELECT DISTINCT w AS size FROM v) WHERE len(w.w) > 0)),
m AS (SELECT doc_id, name, len(list_intersect(s, words)) / len(words) AS share FROM s JOIN v ON v.w = size WHERE len(list_intersect(s, words)) >= need AND NOT list_has_any(s, barred)),
n AS (SELECT doc_id, list(DISTINCT name) AS names, max(share) AS share FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(own, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(names, [])))), ',') AS labels, CASE WHEN own IS NOT NULL THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM w LEFT JOIN o USING (doc_id) LEFT JOIN n USING (doc_id)
"""
    .replace("PHRASES", ", ".join(map(str, PHRASES.items())))
    .replace("TEMPLATES", _sql_values())
)
