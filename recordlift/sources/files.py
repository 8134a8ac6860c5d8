"""Files as documents: bytes are decoded inside Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlift.functions.text import let
from recordlift.sources.encodings import CONFIDENCE, SINGLE_BYTE, guessed, single_byte, utf_16

_HIGH = bytes(b for b in range(0x80, 0x100) if b != 0x98)
_LATIN, _CYRILLIC = _HIGH.decode("latin-1"), _HIGH.decode("cp1251")


def encoding_of(content: Column) -> Column:
    """utf-8-sig for valid UTF-8, else cp1251, or latin-1 if the one byte that cp1251 lacks is there."""
    return F.when(F.is_valid_utf8(content.cast("string")), "utf-8-sig").when(F.contains(content, F.lit(b"\x98")), "latin-1").otherwise("cp1251")


def decoded(content: Column) -> Column:
    latin = F.decode(content, "iso-8859-1")
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).when(F.contains(content, F.lit(b"\x98")), latin).otherwise(F.translate(latin, _LATIN, _CYRILLIC))
    return F.regexp_replace(text, "^\ufeff", "")


def guessed_encoding(content: Column, confidence: float = CONFIDENCE) -> Column:
    """The encoding by statistics where they are confident, else by the rules of encoding_of()."""
    by_rule = encoding_of(content)
    by_bytes = F.when(by_rule != "utf-8-sig", guessed(content))
    return F.coalesce(utf_16(content), let(by_bytes, lambda b: F.when(b["confidence"] >= confidence, b["encoding"])), by_rule)


def decoded_as(content: Column, encoding: Column) -> Column:
    """The text of content in the encoding that a column names."""
    chosen = F.when(encoding == "utf-8-sig", content.cast("string"))
    for name in SINGLE_BYTE:
        chosen = chosen.when(encoding == name, single_byte(content, name))
    chosen = chosen.when(encoding == "utf-16-le", F.decode(content, "UTF-16LE")).when(encoding == "utf-16-be", F.decode(content, "UTF-16BE"))
    return F.regexp_replace(chosen, "^\ufeff", "")


def read_files(spark: SparkSession, path: str | list[str], max_bytes: int | None = None, glob: str = "*", guess: bool = False) -> DataFrame:
    """doc_id (the path), doc_seq, text, encoding, odd_encoding for every file that is not empty.

    A list of paths is read in its order: doc_seq is the place of the file's path, or of the folder that holds it, in
    the list, so that "doc_seq, doc_id" is the order of the files. Files of any size are read; only if max_bytes is
    given are files left out that are larger by their listed size. With guess, statistics of a file's bytes tell its
    encoding where they are confident."""
    paths = [path] if isinstance(path, str) else path
    each = [spark.read.format("binaryFile").option("pathGlobFilter", glob).load(p).where(F.col("length") > 0).withColumn("doc_seq", F.lit(i)) for i, p in enumerate(paths)]
    files = reduce(DataFrame.unionByName, each)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    return decode_files(files.select(F.col("path").alias("doc_id"), "doc_seq", "content"), guess)


def decode_files(files: DataFrame, guess: bool = False) -> DataFrame:
    """(content and further columns) -> the further columns, text, encoding, odd_encoding."""
    if guess:
        more = [F.col(f"`{c}`") for c in files.columns if c != "content"]
        # through a generator, so that the statistics are taken once
        named = files.select(*more, "content", F.explode(F.array(guessed_encoding(F.col("content")))).alias("encoding"))
        return named.select(*more, decoded_as(F.col("content"), F.col("encoding")).alias("text"), "encoding", (F.col("encoding") != "utf-8-sig").alias("odd_encoding"))
    encoding = encoding_of(F.col("content"))
    return files.select(*(c for c in files.columns if c != "content"), decoded(F.col("content")).alias("text"), encoding.alias("encoding"), (encoding != "utf-8-sig").alias("odd_encoding"))
