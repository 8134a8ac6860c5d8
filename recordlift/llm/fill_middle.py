"""Fill-in-the-middle transformation: whole texts cut at two line borders and written in another order.

A unit is a line with its end. Whether a unit begins at a place is told by the character before it, so a text can be
taken apart into chunks that each carry one character of the chunk before: every chunk counts its units by itself,
prefix sums of these counts say in which chunk the two cuts lie, and only these chunks are looked through for the place.

Texts of up to LONG bytes are done where they are read: the chunks are ranges of a batch's bytes, nothing is shuffled.
The chunks of a longer text become rows: they are counted in parallel, the counts alone are summed by text, each chunk
is split by the cuts it owns, and its pieces meet again in the output's order. One text can so be as long as a row can;
only the output itself stands in one place.

Both ways give the same rows. The form (psm, spm or plain) and the ranks of the cuts follow from a hash of the seed and
the doc_id, whatever the partitioning.

Defined results: a null text is empty; an empty text, and one that holds a mark, stays as it is (plain). A null doc_id
is hashed as empty text. Rows that share a doc_id or are equal each give their row; only doc_id and text are read, so
further columns of any name do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlift.llm.common import bytes_of, documents, id_and_bytes, sha256_hex, sliced, stored

# fixed values: the marks of prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_P, _S, _M = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
#: bytes of a chunk, and of a text from which its chunks are dealt over tasks
CHUNK = 16 << 10
LONG = 64 << 10
_NEWLINE = 10

OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output binary"
_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string()), ("output", pa.binary())])


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits: two for the cuts, one for the rate, one for the order of the parts."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def unit_starts(data: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where a unit begins: at a text's first byte and behind every line's end."""
    begins = np.zeros(len(data), bool)
    begins[1:] = data[:-1] == _NEWLINE
    begins[doc_starts] = True
    return begins


def cut_places(texts: list[bytes], ranks, chunk: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The number of units of each text, and the bytes at which the cuts of ranks(text, units) lie."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    n_chunks = -(-sizes // chunk)
    owner = np.concatenate(([0], np.cumsum(n_chunks)))
    # chunks begin at multiples of their size in each text; the byte before one is looked at through the whole buffer
    nth = np.arange(owner[-1]) - np.repeat(owner[:-1], n_chunks)
    at = np.repeat(first[:-1], n_chunks) + nth * chunk
    begins = unit_starts(data, first[:-1][sizes > 0])
    counts = np.add.reduceat(begins.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    before = np.concatenate(([0], np.cumsum(counts)))  # units before each chunk
    units = before[owner[1:]] - before[owner[:-1]]
    ends = np.append(at[1:], len(data))

    def place(k: int, rank: int) -> int:
        if rank == units[k]:
            return int(sizes[k])
        wanted = before[owner[k]] + rank
        c = int(np.searchsorted(before, wanted, side="right")) - 1
        return int(at[c] + np.flatnonzero(begins[at[c] : ends[c]])[wanted - before[c]] - first[k])

    return units, [tuple(place(k, r) for r in ranks(k, int(units[k]))) for k in range(len(texts))]


def written(text: bytes, a: int, b: int, form: str) -> bytes:
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    return text if form == PLAIN else _P + prefix + _S + suffix + _M + middle if form == PSM else _S + suffix + _P + prefix + _M + middle


def restored_bytes(output: bytes, form: str) -> bytes:
    """The text that an output of this form was made from."""
    if form == PLAIN:
        return output
    head, mark = (_P, _S) if form == PSM else (_S, _P)
    first, _, rest = output[len(head) :].partition(mark)
    second, _, middle = rest.partition(_M)
    return first + middle + second if form == PSM else second + middle + first


def restored(output: Column, form: Column) -> Column:
    """The same for columns."""

    def halves(mark: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(PREFIX) + 1, 2**31 - 1)
        first = F.substring_index(body, mark, 1)
        rest = F.substr(body, F.length(first) + len(mark) + 1)
        second = F.substring_index(rest, MIDDLE, 1)
        return first, second, F.substr(rest, F.length(second) + len(MIDDLE) + 1)

    prefix, suffix, middle = halves(SUFFIX)
    last, front, between = halves(PREFIX)
    return F.when(form == PSM, F.concat(prefix, middle, suffix)).when(form == SPM, F.concat(front, between, last)).otherwise(output)


def _chars(data: bytes) -> int:
    return len(data.decode("utf-8", "replace"))


def _in_place(seed: int, rate: int, spm: int, chunk: int, outputs: bool):
    """Rows of (doc_id, text) -> rows of OUT."""

    def done(batch: pa.RecordBatch) -> list[tuple]:
        ids, texts = batch.column(0).to_pylist(), bytes_of(batch.column(1))
        drawn = [draws(d, seed) for d in ids]
        units, cuts = cut_places(texts, lambda k, n: sorted(h % (n + 1) for h in drawn[k][:2]), chunk)
        rows = []
        for doc_id, text, h, n, (a, b) in zip(ids, texts, drawn, units.tolist(), cuts, strict=True):
            plain = not text or _P in text or _S in text or _M in text or h[2] % 100 >= rate
            form = PLAIN if plain else SPM if h[3] % 100 < spm else PSM
            output = written(text, a, b, form)
            sizes = (None, None) if plain else (_chars(text[:a]), _chars(text[a:b]))
            rows.append((doc_id, n, form, *sizes, sha256_hex(output), sha256_hex(restored_bytes(output, form)), output if outputs else None))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done(batch), strict=True), _OUT, strict=True)], schema=_OUT)

    return run


_CHUNKS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int64()), ("before", pa.string()), ("body", pa.string()), ("marks", pa.bool_())])
CHUNKS = "row long, doc_id long, chunk long, before string, body string, marks boolean"


def _chunked(chunk: int):
    """Rows of (row, doc_id, text) -> a row for each chunk of a text, with the character before it, and whether a mark
    begins in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, 1):
                row, doc_id, text = batch.column(0)[0].as_py(), batch.column(1)[0].as_py(), bytes_of(batch.column(2))[0].decode("utf-8", "replace")
                for first in range(0, len(text), chunk << 6):
                    rows = []
                    for a in range(first, min(first + (chunk << 6), len(text)), chunk):
                        body = text[a : a + chunk]
                        seam = body + text[a + chunk : a + chunk + len(PREFIX) - 1]
                        rows.append((row, doc_id, a // chunk, text[max(0, a - 1) : a], body, any(m in seam for m in (PREFIX, SUFFIX, MIDDLE))))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CHUNKS, strict=True)], schema=_CHUNKS)

    return run


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _over_tasks(docs: DataFrame, seed: int, rate: int, spm: int, chunk: int) -> DataFrame:
    """The same rows for texts whose chunks are dealt over tasks."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    # written, so that the numbers of rows are the same in all that follows
    chunks = stored(numbered.mapInArrow(_chunked(chunk), CHUNKS), "middle-chunks")
    seen = F.concat("before", "body")  # what the chunk's predicates look at
    starts = _newlines(seen) - F.endswith("body", F.lit("\n")).cast("int") + (F.col("chunk") == 0).cast("int")
    counts = chunks.select("row", "doc_id", "chunk", "marks", starts.cast("long").alias("units"))
    whole, sofar = Window.partitionBy("row"), Window.partitionBy("row").orderBy("chunk")
    summed = counts.select("row", "doc_id", "chunk", "units", (F.sum("units").over(sofar) - F.col("units")).alias("passed"), F.sum("units").over(whole).alias("n"), F.bool_or("marks").over(whole).alias("marked"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    ranks = [h[k] % (F.col("n") + 1) for k in (0, 1)]
    form = F.when(F.col("marked") | (h[2] % 100 >= rate), PLAIN).when(h[3] % 100 < spm, SPM).otherwise(PSM)
    routed = summed.select("row", "chunk", "units", "passed", "n", form.alias("form"), F.least(*ranks).alias("low"), F.greatest(*ranks).alias("high"))

    def place(rank: Column) -> Column:
        """How many characters of the chunk lie before the cut: all, none, or as many as looking it through tells."""
        nth = rank - F.col("passed")
        line_ends = F.when(F.col("chunk") == 0, nth).otherwise(nth + 1).cast("int")
        found = F.when((F.col("chunk") == 0) & (nth == 0), 0).otherwise(F.length(F.call_function("substring_index", seen, F.lit("\n"), line_ends)) + 1 - F.length("before"))
        return F.when(nth < 0, 0).when(nth >= F.col("units"), F.length("body")).otherwise(found)

    cut = chunks.select("row", "doc_id", "chunk", "before", "body").join(routed, ["row", "chunk"]).select("row", "doc_id", "chunk", "n", "form", "body", place(F.col("low")).alias("a"), place(F.col("high")).alias("b"))
    part = lambda start, end, psm, spm: F.struct(F.when(F.col("form") == PSM, psm).when(F.col("form") == SPM, spm).otherwise(0).alias("nth"), F.col("chunk"), F.substr("body", start + 1, end - start).alias("piece"))
    parts = F.array(part(F.lit(0), F.col("a"), 1, 2), part(F.col("b"), F.length("body"), 2, 1), part(F.col("a"), F.col("b"), 3, 3))
    plain = F.array(part(F.lit(0), F.length("body"), 0, 0))
    pieces = cut.select("row", "doc_id", "n", "form", F.col("a").alias("p"), (F.col("b") - F.col("a")).alias("m"), F.when(F.col("form") == PLAIN, plain).otherwise(parts).alias("parts"))
    met = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("form").alias("form"), F.sum("p").alias("p"), F.sum("m").alias("m"), F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts"))

    def joined(nth: int) -> Column:
        return F.array_join(F.transform(F.filter("parts", lambda x: x["nth"] == nth), lambda x: x["piece"]), "")

    marks = F.when(F.col("form") == PSM, F.array(F.lit(PREFIX), F.lit(SUFFIX))).otherwise(F.array(F.lit(SUFFIX), F.lit(PREFIX)))
    output = F.when(F.col("form") == PLAIN, joined(0)).otherwise(F.concat(marks[0], joined(1), marks[1], joined(2), F.lit(MIDDLE), joined(3)))
    out = met.select("doc_id", "n", "form", "p", "m", output.alias("output"))
    moved = F.col("form") != PLAIN
    return out.select(
        "doc_id", "n", "form", F.when(moved, F.col("p")).cast("long").alias("prefix_chars"), F.when(moved, F.col("m")).cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"), F.col("output").cast("binary").alias("output"),
    )


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, chunk: int = CHUNK, long: int = LONG, outputs: bool = True) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, if asked for, output.

    rate is the percentage of texts that are transformed, spm that of the transformed ones whose suffix comes first."""
    rows = id_and_bytes(docs)
    size = F.octet_length("text")
    short = rows.where(size <= long).mapInArrow(_in_place(seed, rate, spm, chunk, outputs), OUT)
    both = short.unionByName(_over_tasks(rows.where(size > long), seed, rate, spm, chunk))
    return both.withColumn("output", F.col("output").cast("string")) if outputs else both.drop("output")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(documents(spark, sf_dir), outputs=False)


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
u AS (SELECT *, CAST(len(t) - len(replace(t, chr(10), '')) + CASE WHEN t <> '' AND right(t, 1) <> chr(10) THEN 1 ELSE 0 END AS BIGINT) AS n,
  list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS r FROM d),
k AS (SELECT doc_id, t, n, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b, string_split(t, chr(10)) AS l,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT doc_id, t, n, form, CASE WHEN a = n THEN t WHEN a = 0 THEN '' ELSE array_to_string(l[1:a], chr(10)) || chr(10) END AS p,
  CASE WHEN b = n THEN t WHEN b = 0 THEN '' ELSE array_to_string(l[1:b], chr(10)) || chr(10) END AS q FROM k),
s AS (SELECT doc_id, t, n, form, p, substr(q, len(p) + 1) AS m, substr(t, len(q) + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(len(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(len(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM s
"""
