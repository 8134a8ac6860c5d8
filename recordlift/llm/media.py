"""Interleaved document sequences: text and media references in order, media resolved by digest.

interleave() parses HTML into an ordered array of structs: a text run, or a reference to a medium with its caption
(its figure's figcaption, before or behind it, else alt). All text stays, in its place: a caption is a text run where
its figure has no medium or there is no figure, and what is still open at the page's end counts as closed there. Only
script, style and template elements are left out. resolve() joins the references with a media table by digest: features
are taken where the medium is read, and only those narrow rows travel, reduced to one for each digest before the join,
so neither a medium nor its payload is ever shuffled. Text runs take no part in the join. Positions and captions stay
with their reference; a reference without a medium stays, unresolved.

A payload is stored as an 8-bit grey picture (PGM) 64 samples wide. The stored bytes are read back: features come
from the samples in the file, not from the text they were made of.

Defined results: a null text or html is empty; an empty payload is one row of zeros; a null doc_id is a page like
any other; repeated rows each get their rows; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html.parser
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlift.llm.common import documents, row_map

WIDTH = 64
PARTS = "array<struct<position: int, kind: string, text: string, ref: string, caption: string>>"
_PARTS = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
_MEDIA = ("img", "audio", "video", "source", "embed")
_SILENT = ("script", "style", "template")


class _Sequence(html.parser.HTMLParser):
    """A page's parts in order. A figure on the stack is the place of its first part and its captions with their places."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.silent: list[str] = []
        self.figures: list[tuple[int, list[tuple[int, str]]]] = []
        self.caption: list[str] | None = None

    def _add(self, kind: str, text: str | None = None, ref: str | None = None, caption: str | None = None) -> None:
        self.parts.append({"kind": kind, "text": text, "ref": ref, "caption": caption, "own": False})

    def handle_starttag(self, tag, attrs):
        if self.silent:
            self.silent += [tag] if tag in _SILENT else []
            return
        if tag in _SILENT:
            self.silent.append(tag)
        elif tag == "figure":
            self._end_caption()
            self.figures.append((len(self.parts), []))
        elif tag == "figcaption":
            self._end_caption()
            self.caption = []
        elif tag in _MEDIA and (a := dict(attrs)).get("src"):
            self._add("media", ref=a["src"], caption=a.get("alt"))

    def handle_startendtag(self, tag, attrs):
        if tag not in _SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.silent:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
        elif tag == "figcaption":
            self._end_caption()
        elif tag == "figure":
            self._end_caption()
            self._end_figure()

    def _end_caption(self) -> None:
        if self.caption is None:
            return
        said, self.caption = " ".join(" ".join(self.caption).split()), None
        if said and self.figures:
            self.figures[-1][1].append((len(self.parts), said))
        elif said:
            self._add("text", text=said)

    def _end_figure(self) -> None:
        if not self.figures:
            return
        begin, captions = self.figures.pop()
        media = [p for p in self.parts[begin:] if p["kind"] == "media" and not p["own"]]
        for part in media if captions else ():
            part.update(caption=" ".join(said for _, said in captions), own=True)
        for at, said in () if media else captions[::-1]:
            self._add("text", text=said)
            self.parts.insert(at, self.parts.pop())

    def handle_data(self, data):
        if self.silent:
            return
        if self.caption is not None:
            self.caption.append(data)
        elif text := " ".join(data.split()):
            self._add("text", text=text)

    def whole(self) -> list[dict]:
        self.close()
        self._end_caption()
        while self.figures:
            self._end_figure()
        return [{"position": k} | {x: part[x] for x in ("kind", "text", "ref", "caption")} for k, part in enumerate(self.parts)]


def _parsed(page_id: int, page: bytes | None) -> tuple:
    sequence = _Sequence()
    sequence.feed((page or b"").decode("utf-8", "replace"))
    return page_id, sequence.whole()


def interleave(pages: DataFrame) -> DataFrame:
    """(id, html) -> id and parts: the page's texts and media references in order."""
    return pages.select("id", F.col("html").cast("binary").alias("html")).mapInArrow(row_map(_parsed, pa.schema([("id", pa.int64()), ("parts", _PARTS)])), f"id long, parts {PARTS}")


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % WIDTH if payload else WIDTH)


def to_picture(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def samples(picture: bytes) -> np.ndarray:
    """The samples of a stored picture, rows by columns."""
    kind, size, depth, body = picture.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(body) != width * height:
        raise ValueError("no 8-bit grey picture")
    return np.frombuffer(body, np.uint8).reshape(height, width)


_FEATURES = pa.schema([("digest", pa.binary()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
FEATURES = "digest binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(digest: bytes, n_bytes: int, media: bytes) -> tuple:
    grid = samples(media)
    payload = grid.tobytes()
    counts = np.bincount(grid.ravel() >> 4, minlength=16)
    rise = int(np.abs(np.diff(grid.astype(np.int16), axis=1)).sum())
    feature = f"mean={grid.mean():.4f};std={grid.std():.4f};step={rise / max(1, grid.size):.4f};hist={'/'.join(map(str, counts))}"
    return digest, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_features(media: DataFrame) -> DataFrame:
    """(digest, n_bytes, media) -> a row of features for each digest."""
    rows = media.select("digest", "n_bytes", "media").mapInArrow(row_map(_features, _FEATURES), FEATURES)
    names = [f.name for f in _FEATURES][1:]
    return rows.groupBy("digest").agg(F.first(F.struct(*names)).alias("f")).select("digest", "f.*")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """id, position, kind, text, ref, caption, digest and the features of the medium referred to; ref is sha256:<hex>."""
    rows = sequences.select("id", F.explode("parts").alias("p")).select("id", "p.*")
    digest = F.when(F.startswith("ref", F.lit("sha256:")), F.expr("try_to_binary(substring(ref, 8), 'hex')"))
    rows = rows.withColumn("digest", digest)
    found = rows.where("digest is not null").join(media_features(media), "digest", "left")
    return found.unionByName(rows.where("digest is null"), allowMissingColumns=True)


def text_media(docs: DataFrame) -> DataFrame:
    """(digest, n_bytes, media): each text's bytes, padded with zeros to whole rows, as a picture."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    size = F.octet_length(text)
    height = F.greatest(F.lit(1), F.ceil(size / WIDTH)).cast("int")
    header = F.concat(F.lit(f"P5\n{WIDTH} "), height.cast("string"), F.lit("\n255\n")).cast("binary")
    fill = F.substring(F.lit(bytes(WIDTH)), F.lit(1), height * WIDTH - size)
    return docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), size.cast("long").alias("n_bytes"), F.concat(header, text, fill).alias("media"))


def figure_pages(docs: DataFrame) -> DataFrame:
    """(id, html): a page for each document that shows its text's picture, captioned with the number of bytes."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    page = F.concat(F.lit('<article><p>Text as samples</p><figure><img alt="" src="sha256:'), F.sha2(text, 256), F.lit('"><figcaption>'), F.octet_length(text).cast("string"), F.lit(" bytes</figcaption></figure></article>"))
    return docs.select(F.col("doc_id").cast("long").alias("id"), page.alias("html"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    shown = resolve(interleave(figure_pages(docs)), text_media(docs)).where("kind = 'media'")
    return shown.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def interleave_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of whole web pages, behind each article the picture of the document of the page's number, if any."""
    docs = documents(spark, sf_dir)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long").alias("id"), "html")
    shown = docs.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256)).alias("sha"))
    figure = F.concat(F.lit('</article><figure><figcaption>Document '), F.col("id").cast("string"), F.lit('</figcaption><img src="sha256:'), "sha", F.lit('"></figure>'))
    page = F.when(F.col("sha").isNull(), F.col("html")).otherwise(F.replace("html", F.lit("</article>"), figure))
    parts = resolve(interleave(pages.join(shown, "id", "left").select("id", page.alias("html"))), text_media(docs))
    return parts.select(F.col("id").alias("page_id"), "position", "kind", "text", "caption", "n_bytes", "media_sha256")
