"""Interleaved sequences of text and media.

Pages are parsed into ordered items: text paragraphs, and media references with the caption that stands
with them. Media are kept once written, by the digest of their samples, as PNG files of 8-bit RGB; items find
their payload by a join on the digest and keep page and position, so the order of a page is never lost.

Edge cases: a null page or one without content has no items; a reference that no medium has keeps null
columns; media of one digest are one medium; a very long page or text is one row, whole; a null text is the empty text (192 blanks as payload); repeated
rows give repeated rows; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormshift.llm._shared import utf8, written

ITEMS = "page_id long, position int, kind string, text string, media string, caption string"
#: Tags that end a paragraph, tags whose content is not text, tags that show media.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
SILENT = frozenset("head noscript script style template".split())
MEDIA = frozenset("audio embed img source video".split())


class _Items(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.text, self.silent, self.captioned, self.figure = [], [], 0, None, None

    def flush(self) -> None:
        text = "".join(self.text).strip()
        self.text = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attributes):
        if tag in SILENT:
            self.silent += 1
        if tag == "figcaption":
            self.flush()
            self.captioned = []
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = len(self.items)
        if tag in MEDIA and (source := dict(attributes).get("src")):
            self.flush()
            self.items.append(["media", None, source.removeprefix("sha256:"), dict(attributes).get("alt") or None])

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        if tag == "figcaption" and self.captioned is not None:
            caption, self.captioned = "".join(self.captioned).strip(), None
            for item in self.items[self.figure or 0 :]:
                if item[0] == "media":
                    item[3] = caption or item[3]
        elif tag in BLOCKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if self.captioned is not None:
            self.captioned.append(data)
        elif not self.silent:
            self.text.append(data)


def page_items(html: str | None) -> list[list]:
    """[kind, text, media, caption] in the order of the page."""
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.items


def interleave(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """A row per item of every page: see ITEMS; media holds the reference, a digest if it was written `sha256:...`."""

    def parse(batches):
        for batch in batches:
            rows = [(page, i, *item) for page, html in zip(*(c.to_pylist() for c in batch.columns)) for i, item in enumerate(page_items(html))]
            kinds = [pa.int64(), pa.int32(), *[pa.string()] * 4]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=["page_id", "position", "kind", "text", "media", "caption"])

    return pages.select(F.col(id_column).cast("long"), F.col(html_column)).mapInArrow(parse, ITEMS)


def resolve(items: DataFrame, media: DataFrame) -> DataFrame:
    """items with the columns of media(digest, ...), a written table with one row per digest.

    Nothing else stands in the join's stage, so that AQE can split a hot digest.
    """
    return items.join(media.withColumnRenamed("digest", "media"), "media", "left")


def encode_png(payload: bytes, width: int = 64) -> bytes:
    """Samples of 8-bit RGB, `width` pixels a row, without loss."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, 3 * width)
    lines = np.zeros((len(rows), 1 + 3 * width), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def decode_png(image: bytes) -> np.ndarray:
    """rows x width x 3 samples of a file of encode_png."""
    at, data, width, height = 8, b"", 0, 0
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError("damaged image")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + 3 * width)
    if lines[:, 0].any():
        raise ValueError("only filter 0 is read")
    return lines[:, 1:].reshape(height, width, 3)


def text_payload(text: Column) -> Column:
    """Bytes with blanks up to a positive multiple of 192."""
    n = F.octet_length(text)
    blanks = F.greatest(F.lit(192), F.ceil(n / 192) * 192) - n
    return F.concat(text, F.repeat(F.lit(" "), blanks.cast("int")).cast("binary"))


def store_media(payloads: DataFrame) -> DataFrame:
    """payloads(digest, payload) as a written table of (digest, media); copies within a task are stored once."""

    def encode(batches):
        seen: set[str] = set()
        for batch in batches:
            rows = []
            for digest, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if digest not in seen:
                    seen.add(digest)
                    rows.append((digest, encode_png(payload)))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [(), ()], (pa.string(), pa.binary()))], names=["digest", "media"])

    return written(payloads.select("digest", "payload").mapInArrow(encode, "digest string, media binary"), "media", "none")


FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """One row per digest, from the stored bytes alone."""

    def read(batches):
        for batch in batches:
            rows = []
            for digest, image in zip(*(c.to_pylist() for c in batch.columns)):
                samples = decode_png(image)
                payload, (r, g, b) = samples.tobytes(), samples.reshape(-1, 3).mean(0)
                feature = f"rgb8 {samples.shape[1]}x{samples.shape[0]} mean {r:.4f} {g:.4f} {b:.4f}"
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return media.select("digest", "media").mapInArrow(read, FEATURES).dropDuplicates(["digest"])


def illustrated_pages(docs: DataFrame) -> DataFrame:
    """Documents as pages: the text, then a figure that refers to the text's own payload by digest, with a caption."""
    safe = F.coalesce("text", F.lit(""))
    for raw, mark in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(raw), F.lit(mark))
    figure = F.concat(F.lit('<figure><img src="sha256:'), F.col("digest"), F.lit('"><figcaption>'), F.octet_length(utf8()).cast("string"), F.lit(" bytes</figcaption></figure>"))
    return docs.select("doc_id", F.concat(F.lit("<article><p>"), safe, F.lit("</p>"), figure, F.lit("</article>")).alias("html"))


def op3_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("payload", text_payload(utf8())).withColumn("digest", F.sha2("payload", 256))
    media = store_media(docs)
    items = interleave(illustrated_pages(docs), "doc_id").where("kind = 'media'")
    found = resolve(items.select("page_id", "position", "media", "caption"), written(media_features(media), "features"))
    return found.select(F.col("page_id").alias("doc_id"), F.substring_index("caption", " ", 1).cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position")
