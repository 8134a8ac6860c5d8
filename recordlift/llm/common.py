"""Helpers shared by the corpus operators: tables in the shared folder, word splitting, Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlift.sources.shared import fresh_path

#: Bytes that separate words once case is folded: everything in ASCII but digits and letters.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again, which cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_bytes(docs: DataFrame) -> DataFrame:
    """doc_id and the text's UTF-8 bytes (null: none); all other columns are left out, so none can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def plainly_named(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with their columns named c0, c1, ..., and the name that the text has then: so columns of any name, with
    dots or twice the same, can pass through a function on Arrow batches. toDF(*docs.columns) gives them back."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names[docs.columns.index("text")]


def folded_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z."""
    return text.translate(_FOLD).split()


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


class Table(dict):
    """A table that a task fills as it goes, of `room` bytes in two halves: when the young half, the dict itself, is
    full, it becomes the old one. recall() takes an entry from the old half into the young one."""

    def __init__(self, room: int = 24 << 20):
        super().__init__()
        self.room, self.left, self.old = room, room // 2, {}

    def keep(self, key, value, size: int):
        """Adds an entry of about `size` bytes besides the table's own share of it."""
        self.left -= size + 200
        if self.left < 0:
            self.old = self.retired()
            self.clear()
            self.left = self.room // 2
        self[key] = value
        return value

    def retired(self) -> dict:
        return dict(self)

    def recall(self, key, size: int):
        """The value that the old half has; None if it has none."""
        value = self.old.get(key)
        return None if value is None else self.keep(key, value, size)

    def release(self) -> None:
        self.clear()
        self.left, self.old = self.room // 2, {}


class WordHashes(Table):
    """64-bit hashes of words."""

    def __init__(self, seed: int = 0, room: int = 48 << 20):
        super().__init__(room)
        self.seed = seed

    def retired(self) -> dict:
        return {}  # to hash a word again costs no more than to look it up

    def __missing__(self, word: bytes) -> int:
        return self.keep(word, xxhash.xxh64_intdigest(word, self.seed), len(word))

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def sliced(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `size` bytes or of one row, so that only few of its rows stand as Python objects."""
    if batch.num_rows > 1 and batch.nbytes > size:
        half = batch.num_rows // 2
        yield from sliced(batch.slice(0, half), size)
        yield from sliced(batch.slice(half), size)
    elif batch.num_rows:
        yield batch


def bytes_of(column: pa.Array) -> list[bytes]:
    """The texts of a string column as bytes, whether they are UTF-8 or not; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def texts_of(column: pa.Array) -> list[str]:
    return [t.decode("utf-8", "replace") for t in bytes_of(column)]


def released(*tables: Table) -> None:
    """Frees what a task needed no longer than itself: its worker lives on and serves other operators."""
    for table in tables:
        table.release()
    pa.default_memory_pool().release_unused()


def row_map(each: Callable[..., tuple | None], out: pa.Schema, setup: Callable[[], object] | None = None, tables: Callable[[], list[Table]] = list) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: each(row values..., state) gives a row or None. The tables, which a worker keeps
    from batch to batch, are released when the task's rows are done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        try:
            for whole in batches:
                for batch in sliced(whole):
                    rows = [r for r in (each(*x, *state) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)) if r is not None]
                    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in out]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)
        finally:
            released(*tables())

    return run
