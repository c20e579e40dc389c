"""Media columns as interleaved document sequences (operator 4).

parse_sequences() turns an HTML page into an ordered array of structs, each a text or a reference to media with its caption. Media
lie in a table of their own, by SHA-256 of their payload. resolve() joins references and media on that digest and puts the
results back at their positions, so order and captions stay aligned whatever the join does. A reference that no media row
answers keeps its place with null media columns.

Payloads are stored without loss as PNG images of one 8-bit sample a pixel, WIDTH pixels a row.

Cases: a null or empty page has an empty sequence; malformed declarations are dropped; a null or empty text has the payload of WIDTH zero bytes; rows that repeat a
digest count once; null ids, repeated rows and other columns pass through or aren't read; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, table

WIDTH = 64
# The signature of a PNG file, and its media type prefix in references.
SIGNATURE, PREFIX = b"\x89PNG\r\n\x1a\n", "sha256:"
# Elements that end a text.
BREAKS = frozenset("address article aside blockquote body caption dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
HIDDEN = frozenset(("script", "style", "template", "noscript", "title"))
MEDIA = frozenset(("img", "video", "audio", "source", "embed"))


def pad(raw: bytes, width: int = WIDTH) -> bytes:
    """Zero bytes up to a positive multiple of width."""
    return raw + bytes((-len(raw)) % width if raw else width)


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # each row begins with its filter, 0
    lines[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """Samples of an image that to_png() wrote, as (rows, width)."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, width, height = 8, [], 0, 0
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a damaged PNG file")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", data[:8])
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """A perceptual hash: of 64 parts of equal size, whether each is brighter than the mean of all; with mean and deviation."""
    flat = samples.reshape(-1)
    edges = np.arange(65) * len(flat) // 64
    sums = np.diff(np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])[edges])
    bits = sums * 64 > int(flat.sum(dtype=np.int64)) * (np.diff(edges) * 64 / len(flat))
    return f"{int(np.packbits(bits).view('>u8')[0]):016x}:{flat.mean():.3f}:{flat.std():.3f}"


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.caption: list[str] | None = None
        self.figure = -1

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BREAKS:
            self.flush()
        if tag == "figure":
            self.figure = len(self.items)
        if tag == "figcaption":
            self.flush()
            self.caption = []
        a = dict(attrs)
        if tag in MEDIA and a.get("src"):
            self.flush()
            self.items.append({"position": len(self.items), "kind": "media", "text": None, "ref": a["src"], "caption": a.get("alt") or None})

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for item in self.items[max(self.figure, 0):]:  # a caption belongs to the media of its figure
                if item["kind"] == "media" and text:
                    item["caption"] = text
            self.caption = None
        if tag == "figure":
            self.flush()
            self.figure = -1
        if tag in BREAKS:
            self.flush()

    def parse_marked_section(self, i, report=1):
        """Declarations that HTML doesn't know end at the next > like a comment, character data at its own mark, or both with the page; the parser's own way fails on some."""
        mark = "]]>" if self.rawdata.startswith("<![CDATA[", i) else ">"
        end = self.rawdata.find(mark, i + 3)
        return end + len(mark) if end >= 0 else len(self.rawdata)

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


ITEM = "struct<position:int,kind:string,text:string,ref:string,caption:string>"
_ITEMS = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))


def sequence(html: str | None) -> list[dict]:
    p = _Sequence()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.items


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        items = [sequence(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(items, _ITEMS)], names=["id", "items"])


def parse_sequences(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """pages with a key and html to (id, items): texts and media references in page order."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(key).alias("id"), "html")
    return rows.mapInArrow(_parse, f"id {rows.schema['id'].dataType.simpleString()}, items array<{ITEM}>")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """(id, items) and media with a digest and more columns to (id, position, kind, text, ref, caption, media): one row an item.

    Only rows with references take part in the join; media is a struct of media's columns. Digests are unique after this call's own
    reduction, so an item keeps exactly one row however often its digest is stored or referred to.
    """
    each = sequences.select("id", F.explode("items").alias("i")).select("id", "i.*")
    store = media.dropDuplicates(["digest"])
    store = store.select(F.col("digest").alias("__digest"), F.struct(*[F.col(c) for c in media.columns]).alias("media"))
    refs = each.where("kind = 'media'").join(store, F.expr(f"substring(ref, {len(PREFIX) + 1})") == F.col("__digest"), "left").drop("__digest")
    kind = refs.schema["media"].dataType
    return refs.unionByName(each.where("kind <> 'media'").withColumn("media", F.lit(None).cast(kind)))


def gather(items: DataFrame) -> DataFrame:
    """Resolved items back to one row a page, in order: (id, items)."""
    return items.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("position", "kind", "text", "ref", "caption", "media"))).alias("items"))


def _page(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text as a page that refers to its payload, and the payload as media."""
    for batch in batches:
        html, digest, media, sizes = [], [], [], []
        for t in batch.column("text").to_pylist():
            raw = (t or "").encode()
            payload = pad(raw)
            d = hashlib.sha256(payload).hexdigest()
            sizes.append(len(raw))
            digest.append(d)
            media.append(to_png(payload))
            html.append(f'<figure><img src="{PREFIX}{d}" alt=""><figcaption>{len(raw)} bytes</figcaption></figure>')
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(html, pa.string()), pa.array(digest, pa.string()), pa.array(media, pa.binary())], names=["id", "html", "digest", "media"])


_DESCRIBED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for d, m in zip(batch.column("digest").to_pylist(), batch.column("media"), strict=True):
            stored = m.as_py()
            samples = from_png(stored)
            raw = samples.tobytes()
            rows.append((d, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in _DESCRIBED.split(", ")])


def describe(media: DataFrame) -> DataFrame:
    """(digest, media) to what is read back from the stored bytes, without the bytes."""
    ship(media.sparkSession)
    return media.select("digest", "media").mapInArrow(_describe, _DESCRIBED)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    stored = cut(docs.mapInArrow(_page, "id long, html string, digest string, media binary"))  # the media table, on shared storage
    items = resolve(parse_sequences(stored, "id"), describe(stored))
    n_bytes = F.regexp_extract("caption", r"^(\d+) bytes$", 1).cast("long")
    return items.where("kind = 'media'").select(
        F.col("id").alias("doc_id"), n_bytes.alias("n_bytes"), "media.payload_bytes", "media.payload_sha256", "media.tail_crc32", "media.media_bytes", "media.media_sha256", "media.feature")
