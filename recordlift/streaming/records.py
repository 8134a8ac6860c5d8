"""The same plan on streams of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordlift.operators.duplicates import mark_duplicates
from recordlift.plans.config import Spec
from recordlift.plans.parse import raw_records
from recordlift.sources.files import decode_files


def stream_files(spark: SparkSession, path: str, glob: str = "*", guess: bool = False) -> DataFrame:
    """A stream of (doc_id, text, encoding, odd_encoding) from files that arrive in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path)
    return decode_files(files.where("length > 0").select(F.col("path").alias("doc_id"), "content"), guess)


def stream_records(docs: DataFrame, spec: Spec, lost: bool = False) -> DataFrame:
    """A stream of records; stateless, so no watermark is needed. Duplicates are marked by write_records()."""
    return raw_records(docs, spec, lost)


def write_records(records: DataFrame, spec: Spec, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Hands each micro-batch to the sink. A document arrives whole in one batch, so its duplicates can be marked there."""

    def each(batch: DataFrame, number: int) -> None:
        sink(mark_duplicates(batch, spec), number)

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_errors(records: DataFrame) -> DataFrame:
    """code, cnt over all records so far; write it in complete or update mode."""
    codes = records.where("err is not null").select(F.explode(F.split("err", "; ")).alias("code"))
    return codes.groupBy("code").agg(F.count("*").alias("cnt"))
