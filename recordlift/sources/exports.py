"""Records to CSV, JSON and, where openpyxl is installed, XLSX: as part files, or as one file in the records' order."""

from __future__ import annotations

import csv
import io
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlift.operators.profile import place
from recordlift.plans.config import Spec
from recordlift.sources.shared import fresh_path, stored

BOM = "\ufeff"
#: rows of a sheet; a larger table is refused, not cut
SHEET_ROWS = 1_048_575


def csv_escaped(v: Column) -> Column:
    """A value that a spreadsheet would take for a formula gets a quotation mark in front."""
    return F.when(F.rlike(v, F.lit(r"^[=+\-@\t\r]")), F.concat(F.lit("'"), v)).otherwise(v)


def shown(records: DataFrame, spec: Spec) -> DataFrame:
    """The output columns, empty text where a field is absent."""
    return records.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in spec.output))


def write_csv(records: DataFrame, path: str, spec: Spec, mode: str = "error") -> None:
    """Part files with a byte-order mark, header, CRLF and doubled quotation marks. Parts follow the records' order."""
    rows = shown(records, spec)
    cells = rows.select(*(csv_escaped(F.col(f"`{c}`")).alias(BOM + c if k == 0 else c) for k, c in enumerate(spec.output)))
    cells.write.mode(mode).option("header", True).option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def joined(spark: SparkSession, folder: str, path: str, head: bytes = b"", tail: bytes = b"", cut: int = 0) -> None:
    """Part files, in the order of their numbers, as one file: head, the parts' bytes less the last `cut` ones of all,
    tail. The bytes are copied from stream to stream by the Hadoop file system of either path; the file appears under
    its name once it is whole. ValueError if there is one already."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = (jvm.org.apache.hadoop.fs.Path(x) for x in (folder, path))
    store, out_store = source.getFileSystem(conf), target.getFileSystem(conf)
    if out_store.exists(target):
        raise ValueError(f"{path} exists")
    listed = [f for f in store.listStatus(source) if f.getPath().getName().startswith("part-") and f.getLen() > 0]
    parts = sorted(listed, key=lambda f: (int(re.match(r"part-(\d+)", f.getPath().getName())[1]), f.getPath().getName()))
    unfinished = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.unfinished")
    out = out_store.create(unfinished, True)
    try:
        out.write(head)
        left = sum(f.getLen() for f in parts) - cut
        for f in parts:
            n = min(f.getLen(), left)
            stream = jvm.org.apache.commons.io.input.BoundedInputStream(store.open(f.getPath()), n)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            finally:
                stream.close()
            left -= n
        out.write(tail)
    finally:
        out.close()
    if not out_store.rename(unfinished, target):
        raise OSError(f"{path} could not be named")


def digest_of(spark: SparkSession, path: str) -> tuple[int, str]:
    """Length and sha256 of one file of any size. A digest of one file is serial; its bytes pass through a small buffer
    of the Hadoop file system's stream, so no row or task has to hold the file."""
    jvm = spark._jvm
    source = jvm.org.apache.hadoop.fs.Path(path)
    store = source.getFileSystem(spark._jsc.hadoopConfiguration())
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    stream = jvm.java.security.DigestInputStream(store.open(source), digest)
    try:
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, jvm.java.io.OutputStream.nullOutputStream(), 1 << 16, False)
    finally:
        stream.close()
    return store.getFileStatus(source).getLen(), bytes(digest.digest()).hex()


def write_one_csv(records: DataFrame, path: str, spec: Spec) -> None:
    """One CSV file in the records' order: a byte-order mark, the header, CRLF, doubled quotation marks."""
    # written, since sorting reads its input twice
    rows = shown(stored(records, "records").orderBy(*place(records)), spec)
    folder = fresh_path(records.sparkSession, "csv-parts")
    cells = rows.select(*(csv_escaped(F.col(f"`{c}`")).alias(c) for c in spec.output))
    cells.write.option("escape", '"').option("lineSep", "\r\n").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    header = io.StringIO()
    csv.writer(header).writerow(spec.output)
    joined(records.sparkSession, folder, path, (BOM + header.getvalue()).encode())


def write_one_json(records: DataFrame, path: str, spec: Spec) -> None:
    """One array of objects in the records' order, indented by two spaces."""
    # written, since sorting reads its input twice
    rows = shown(stored(records, "records").orderBy(*place(records)), spec)
    folder = fresh_path(records.sparkSession, "json-parts")
    rows.select(json_object(spec).alias("value")).write.option("lineSep", ",\n").text(folder)
    none = rows.isEmpty()
    joined(records.sparkSession, folder, path, b"[" if none else b"[\n", b"]" if none else b"\n]", 0 if none else 2)


def write_json(records: DataFrame, path: str, spec: Spec, mode: str = "error") -> None:
    """Part files with one object a line."""
    shown(records, spec).write.mode(mode).json(path)


def _json_text(v: Column) -> Column:
    """The value as a string of JSON: an array of it without its brackets."""
    array = F.to_json(F.array(v))
    return F.substr(array, F.lit(2), F.length(array) - 2)


def json_object(spec: Spec) -> Column:
    """The output columns as one object of an array, indented by two spaces; characters beyond ASCII stay."""
    member = lambda c: F.concat(F.lit("    " + json.dumps(c, ensure_ascii=False) + ": "), _json_text(F.col(f"`{c}`")))
    return F.concat(F.lit("  {\n"), F.concat_ws(",\n", *(member(c) for c in spec.output)), F.lit("\n  }"))


def write_json_array(records: DataFrame, path: str, spec: Spec, mode: str = "error") -> None:
    """Part files that are one array of objects each, in the records' order. A task holds two thousand of them at a time."""

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda value: pa.RecordBatch.from_pydict({"value": [value]})
        yield line("[")
        held = None
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                if held is not None:
                    yield line(held + ",")
                held = ",\n".join(batch.column(0).slice(k, 1000).to_pylist())
        if held is not None:
            yield line(held)
        yield line("]")

    objects = shown(records, spec).select(json_object(spec).alias("value"))
    objects.mapInArrow(bracketed, "value string").write.mode(mode).text(path)


def write_parquet(records: DataFrame, path: str, spec: Spec, mode: str = "error") -> None:
    records.select(*place(records), *(F.col(f"`{c}`") for c in spec.output)).write.mode(mode).parquet(path)


def write_xlsx(records: DataFrame, path: str, spec: Spec) -> bool:
    """One sheet, rows with errors shaded; False without openpyxl. Rows come to the driver a partition at a time;
    more rows than a sheet holds are refused."""
    try:
        from openpyxl import Workbook
        from openpyxl.cell import WriteOnlyCell
        from openpyxl.styles import Font, PatternFill
    except ImportError:
        return False
    rows = shown(records.orderBy(*place(records)), spec)
    if rows.limit(SHEET_ROWS + 1).count() > SHEET_ROWS:
        raise ValueError(f"a sheet holds {SHEET_ROWS} records")
    book = Workbook(write_only=True)
    sheet = book.create_sheet("records")

    def cells(values, **style):
        made = [WriteOnlyCell(sheet, value=v) for v in values]
        for cell in made:
            for k, v in style.items():
                setattr(cell, k, v)
        return made

    sheet.append(cells(spec.output, font=Font(bold=True)))
    pink = PatternFill("solid", fgColor="FFF0F0")
    for r in rows.toLocalIterator():
        sheet.append(cells(r, **({"fill": pink} if r["err"] else {})))
    book.save(path)
    return True
