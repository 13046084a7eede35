"""Media columns: interleaved document sequences.

HTML is parsed into one ordered array of structs per document: text, and references to media by the digest of their content, each with
its position and caption.  A digest join resolves references to rows of a media table; positions and captions come along, so
the resolved media stay aligned with the text.  Payloads are stored losslessly as 8-bit grey images (PGM) of a fixed width.

Defined cases: null HTML gives an empty sequence; a reference whose digest is unknown stays, unresolved, with nulls; a digest that occurs in several rows of the
media table resolves to one of them (equal digests have equal content); empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 192
SCHEME = "sha256:"
ELEMENT = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("caption", T.StringType())])
STORED = T.StructType(
    [T.StructField("digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
)


class _Sequence(HTMLParser):
    """Text blocks and media references in document order; a figure's caption belongs to its media."""

    _BLOCKS = frozenset(("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "article", "section", "br", "pre", "blockquote", "figure"))
    _HIDDEN = frozenset(("script", "style", "template"))
    _MEDIA = frozenset(("img", "audio", "video", "source"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self._text: list[str] = []
        self._hidden = 0
        self._caption: list[str] | None = None
        self._figure: list[int] = []

    def _flush(self) -> None:
        text, self._text = "".join(self._text), []
        if text.strip():
            self._add("text", text=text)

    def _add(self, kind: str, **more: str | None) -> None:
        self.items.append({"pos": len(self.items), "kind": kind, "text": None, "digest": None, "caption": None} | more)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self._HIDDEN:
            self._hidden += 1
        elif tag in self._MEDIA:
            given = dict(attrs)
            source = given.get("src") or ""
            if source.startswith(SCHEME):
                self._flush()
                self._add("media", digest=source.removeprefix(SCHEME), caption=given.get("alt"))
        elif tag == "figcaption":
            self._flush()
            self._caption = []
        elif tag in self._BLOCKS:
            self._flush()
            if tag == "figure":
                self._figure.append(len(self.items))

    def handle_endtag(self, tag: str) -> None:
        if tag in self._HIDDEN:
            self._hidden = max(0, self._hidden - 1)
        elif tag == "figcaption" and self._caption is not None:
            caption, self._caption = "".join(self._caption), None
            for item in self.items[self._figure[-1] if self._figure else 0 :]:
                if item["kind"] == "media":
                    item["caption"] = caption
        elif tag in self._BLOCKS:
            self._flush()
            if tag == "figure" and self._figure:
                self._figure.pop()

    def handle_data(self, data: str) -> None:
        if not self._hidden:
            (self._text if self._caption is None else self._caption).append(data)

    def result(self, html: str) -> list[dict]:
        self.feed(html)
        self.close()
        self._flush()
        return self.items


def parse_sequence(html: str | None) -> list[dict]:
    return _Sequence().result(html) if html else []


def sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id and ``sequence``: the ordered text and media-reference structs of every page."""
    kind = pages.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("sequence", T.ArrayType(ELEMENT))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "sequence": [parse_sequence(h) for h in pdf["html"]]})

    return pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").alias("html")).mapInPandas(run, schema)


def references(sequenced: DataFrame) -> DataFrame:
    """id, pos, digest, caption of every media reference."""
    return sequenced.select("id", F.explode(F.filter("sequence", lambda e: e["kind"] == "media")).alias("e")).select("id", "e.pos", "e.digest", "e.caption")


def resolved(refs: DataFrame, media: DataFrame) -> DataFrame:
    """``refs`` with the columns of the media row that has their digest; the media table may repeat a digest.

    The media are grouped by one key more, so that they have an exchange of their own before the join and Spark may split the references to one digest
    among several tasks.
    """
    rest = [c for c in media.columns if c != "digest"]
    once = media.groupBy("digest", F.xxhash64("digest").alias("_h")).agg(F.min(F.struct(*rest)).alias("media")).drop("_h")
    return refs.join(once, "digest", "left").select("id", "pos", "digest", "caption", "media.*")


def payload(text: Column) -> Column:
    """UTF-8 of the text (null: empty) with spaces up to a positive multiple of the width."""
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / WIDTH)) * WIDTH
    return F.rpad(raw, size.cast("int"), F.lit(b" "))


def encode_image(samples: bytes) -> bytes:
    """PGM: a short header and one byte for each sample."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(samples) // WIDTH) + samples


def decode_image(stored: bytes) -> np.ndarray:
    magic, shape, top, samples = stored.split(b"\n", 3)
    width, height = map(int, shape.split())
    if magic != b"P5" or top != b"255" or len(samples) != width * height:
        raise ValueError("not an 8-bit grey image of the stated size")
    return np.frombuffer(samples, dtype=np.uint8).reshape(height, width)


def image_feature(image: np.ndarray) -> str:
    """Mean and deviation of the samples, and a hash of which of 64 areas are lighter than the mean."""
    columns = image.sum(axis=0, dtype=np.int64).reshape(8, -1).sum(axis=1)
    rows = image.sum(axis=1, dtype=np.int64)
    mean = rows.sum() / image.size
    square = np.einsum("ij,ij->", image, image, dtype=np.int64) / image.size
    edges = np.arange(8) * len(rows) // 8
    bands = np.array([rows[a : max(a + 1, z)].mean() for a, z in zip(edges, [*edges[1:], len(rows)], strict=True)]) / image.shape[1]
    bits = "".join("1" if b + c / (len(rows) * image.shape[1] / 8) > 2 * mean else "0" for b in bands for c in columns)
    return f"{mean:.4f}:{max(0.0, square - mean * mean) ** 0.5:.4f}:{int(bits, 2):016x}"


def stored_media(media: DataFrame, payload_col: str = "payload") -> DataFrame:
    """One row for each payload: what is found when its stored image is read back, by digest of the payload given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for given in pdf["payload"]:
                stored = encode_image(bytes(given))
                image = decode_image(stored)
                back = image.tobytes()
                rows.append((hashlib.sha256(given).hexdigest(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), image_feature(image)))
            yield pd.DataFrame(rows, columns=STORED.names)

    return media.select(F.col(f"`{payload_col}`").alias("payload")).mapInPandas(run, STORED)


def as_page(text: Column, digest: Column) -> Column:
    """HTML of a document: its text, then a figure that refers to the digest; the caption has the text's size in bytes."""
    escaped = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("string")
    return F.concat(F.lit("<article><p>"), escaped, F.lit('</p><figure><img src="' + SCHEME), digest, F.lit('"><figcaption>'), size, F.lit("</figcaption></figure></article>"))
