"""Token ids in flat binary files with document offsets (operator 11).

A folder of token files holds shards in ascending document order, each of three flat little-endian files without a header:

    NAME.bin   token ids of all documents of the shard, one after another, unsigned 16 bits each (32 where an id needs them)
    NAME.idx   n + 1 unsigned 64-bit offsets into NAME.bin, counted in ids
    NAME.doc   n signed 64-bit document ids (0 where the id is null; null ids come first, and the manifest counts them)

and `manifest`, a Parquet table with a row for each shard: shard, name, width (bytes of an id), n_docs, n_null, n_tokens, and first_doc and first_token,
the documents and ids of all shards before it. Those bases are prefix sums over the shards, so a document's global start is first_token + its offset.

Writing: documents are dealt by ranges of (doc_id, hash of text) and sorted; each task encodes its range text by text and appends to files of its own
name. Only the names that successful tasks return enter the manifest, which Spark commits as a whole, so a lost executor or a task that ran twice leaves
at most files that nothing names. Reading: each shard is read in ranges of documents through memory maps (through range reads where the folder
isn't mounted).

Encoding: the library encodes each distinct piece once while a worker's cache holds it. A text is cut before a U+0020 that has something visible on both
sides and between a letter and a full stop or comma. Both are boundaries of the byte-level pattern wherever they stand: no slice goes on with a space after
something visible, or with a mark after a letter. So the pieces' ids are the text's.

Cases: null and empty texts hold the end id only. Null doc_ids come first. Rows that repeat an id are documents of their own, in the order of their texts'
hashes (rows equal in both are interchangeable). Texts of any length are encoded whole; a piece of more than LONG bytes isn't cached. An empty table gives an empty
manifest and no documents. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from . import bytesops as B
from .common import cut, shared_dir, table

#: The id that ends a document.
END = 2
#: Pieces that a worker keeps the ids of, and the longest of them in bytes.
MOST, LONG = 1 << 20, 128
#: Ids that a reading task handles: a shard is read in ranges of whole documents of about that many.
RANGE = 1 << 23
SHARDS = "shard int, name string, width int, n_docs long, n_null long, n_tokens long"

# Bytes that a cut may follow or come before: visible ASCII, and characters of two bytes from U+00C0 on, of which none is white space.
_VISIBLE, _LEAD, _LETTER, _STOP = (np.zeros(256, bool) for _ in range(4))
_VISIBLE[0x21:0x7F] = True
_LEAD[0xC3:0xE0] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP[[0x2C, 0x2E]] = True


class Pieces(dict):
    """Numbers of pieces whose ids are known; the ids lie one after another in `flat`."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        level = said.get("pre_tokenizer") or {}
        # texts of another kind of tokenizer are encoded whole
        self.cuts = said.get("normalizer") is None and level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space")
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.n, self.end, self.new = 0, 0, []
        self.flat, self.first = np.zeros(1 << 16, self.kind), np.zeros(1 << 14, np.int64)

    def __missing__(self, piece: bytes) -> int:
        """A new piece gets the next number; its ids follow with the others that are new."""
        k = self.n + len(self.new)
        self.new.append(piece)
        self[piece] = k
        return k

    def add(self) -> None:
        """Encodes the new pieces, each as a text of its own.

        A space and ASCII letters are one slice, which the library's model takes as it is; all others go through its whole pipeline.
        """
        tokenize = self.tokenizer.model.tokenize
        got = [[t.id for t in tokenize("\u0120" + p.decode())] if p.isalpha() else None for p in self.new]
        rest = [k for k, ids in enumerate(got) if ids is None]
        texts = [(p[1:] if p[:1] == b"\xfe" else b" " + p).decode("utf-8", "replace") for p in map(self.new.__getitem__, rest)]
        for k, x in zip(rest, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            got[k] = x.ids
        size = np.fromiter(map(len, got), np.int64, len(got))
        n, end = self.n + len(got), self.end + int(size.sum())
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n >= len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
        self.flat[self.end : end] = np.fromiter(chain.from_iterable(got), self.kind, end - self.end)
        self.first[self.n + 1 : n + 1] = self.end + np.cumsum(size)
        for p in self.new:
            if len(p) > LONG:
                del self[p]
        self.n, self.end, self.new = n, end, []

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        if self.n > MOST or self.end > 8 * MOST:
            self.empty()
        cut, start = cut_pieces(texts) if self.cuts else ([b"\xfe" + t for t in texts], np.arange(len(texts)))
        number = np.fromiter(map(self.__getitem__, cut), np.int64, len(cut))
        if self.new:
            self.add()
        size = self.first[number + 1] - self.first[number]
        offs = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.first[number] - offs[:-1], size) + np.arange(offs[-1])]
        return ids, np.diff(np.append(offs[start], offs[-1]))


def cut_pieces(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Pieces of texts, and the number of each text's first one. A piece that begins with FE is what follows that byte; the others follow a space.

    FE and FF are no part of UTF-8, so they can stand for boundaries: FF between pieces, FE FE where a text begins.
    """
    data = np.frombuffer(bytearray(b"".join(b"\xff\xfe\xfe" + t for t in texts)), np.uint8)
    space = np.flatnonzero(data[:-1] == 32)
    before, after = data[space - 1], data[space + 1]
    data[space[(_VISIBLE[before] | (before >= 0x80) & _LEAD[data[space - 2]]) & (_VISIBLE[after] | _LEAD[after])]] = 0xFF
    stop = np.flatnonzero(_STOP[data])
    before = data[stop - 1]
    stop = stop[_LETTER[before] | (data[stop - 2] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)]
    if len(stop):
        data = np.insert(data, np.repeat(stop, 2), np.tile(np.array([0xFF, 0xFE], np.uint8), len(stop)))
    at = np.flatnonzero(data == 0xFF)
    start = np.flatnonzero((data[at + 1] == 0xFE) & (data[np.minimum(at + 2, len(data) - 1)] == 0xFE))
    pieces = data.tobytes().split(b"\xff")[1:]
    for k in start.tolist():
        pieces[k] = pieces[k][1:]
    return pieces, start


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _with_end(ids: np.ndarray, count: np.ndarray, end: int) -> np.ndarray:
    out = np.full(len(ids) + len(count), end, ids.dtype)
    own = np.ones(len(out), bool)
    own[np.cumsum(count + 1) - 1] = False
    out[own] = ids
    return out


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and the folder there. A path without a scheme is local, which on a cluster must be a shared mount."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:", "file://", 1))


def _writer(path: str, folder: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        shard = TaskContext.get().partitionId()
        name = f"{shard:06d}-{uuid.uuid4().hex}"  # a task that runs again writes files of another name
        own = pieces(path)
        n_docs = n_null = n_tokens = 0
        files = []
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if not files:
                    files = [fs.open_output_stream(f"{root}/{name}.{x}") for x in ("bin", "idx", "doc")]
                    files[1].write(np.zeros(1, "<u8").tobytes())
                data, offs = B.texts(batch.column(1))
                for i, j in B.slices(offs):
                    at = offs[i : j + 1].tolist()
                    ids, count = own.encode([data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)])
                    files[0].write(_with_end(ids, count, end).tobytes())
                    ends = n_tokens + np.cumsum(count + 1)
                    files[1].write(ends.astype("<u8").tobytes())
                    n_tokens = int(ends[-1])
                doc = batch.column(0)
                n_docs, n_null = n_docs + len(doc), n_null + doc.null_count
                files[2].write(doc.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        finally:
            for f in files:
                f.close()
        if files:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (name, pa.string()), (own.width, pa.int32()), (n_docs, pa.int64()), (n_null, pa.int64()), (n_tokens, pa.int64()))],
                                             names=["shard", "name", "width", "n_docs", "n_null", "n_tokens"])
    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = END) -> DataFrame:
    """Writes docs (doc_id, text) as token files into a new folder that all executors share; gives the manifest."""
    spark = ship(docs.sparkSession)
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    # the last key tells rows that repeat an id and a text, so that a document that makes up a third of the table isn't one range
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("__n")]
    dealt = rows.withColumn("__n", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    shards = cut(dealt.mapInArrow(_writer(tokenizer, folder, end), SHARDS))
    # one row a shard: a few rows for the whole corpus
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = [F.coalesce(F.sum(f"n_{x}s").over(before), F.lit(0)).alias(f"first_{x}") for x in ("doc", "token")]
    shards.select("*", *bases).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest")


class Shard:
    """One shard's files, memory-mapped where the folder is mounted."""

    def __init__(self, folder: str, name: str, width: int):
        self.fs, root = filesystem(folder)
        self.at, self.kind = f"{root}/{name}", np.dtype(f"<u{width}")
        self.local = isinstance(self.fs, pafs.LocalFileSystem)
        self.maps: dict[str, np.ndarray] = {}

    def part(self, end: str, kind: np.dtype | str, first: int, n: int) -> np.ndarray:
        """n numbers of a file from number first on."""
        kind = np.dtype(kind)
        if not self.local:
            with self.fs.open_input_file(f"{self.at}.{end}") as f:
                return np.frombuffer(f.read_at(n * kind.itemsize, first * kind.itemsize), kind)
        if end not in self.maps:
            self.maps[end] = np.memmap(f"{self.at}.{end}", kind, "r")
        return self.maps[end][first : first + n]

    def offsets(self, doc: int, n: int) -> np.ndarray:
        return self.part("idx", "<u8", doc, n + 1).astype(np.int64)

    def ids(self, first: int, n: int) -> np.ndarray:
        return self.part("bin", self.kind, first, n)


def _ranges(shards: DataFrame) -> DataFrame:
    """Ranges of documents, about RANGE ids each, spread over the tasks."""
    each = F.greatest(F.lit(1), (F.col("n_docs") * F.lit(RANGE) / F.greatest("n_tokens", F.lit(1))).cast("long"))
    return (shards.withColumn("__each", each).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.col("__each"))))
            .select("name", "width", "first", F.least("__each", F.col("n_docs") - F.col("first")).alias("n"), "n_null", "first_token").repartition("name", "first"))


def _reader(folder: str, what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                shard = Shard(folder, r["name"], r["width"])
                # a few documents at a time: the arrays that leave are as large as these, not as the range
                offs = shard.offsets(r["first"], r["n"])
                for i, j in B.slices(offs, B.CHUNK):
                    at = offs[i : j + 1]
                    no = np.arange(r["first"] + i, r["first"] + j)
                    doc = pa.array(shard.part("doc", "<i8", r["first"] + i, j - i).astype(np.int64), mask=no < r["n_null"])
                    ids = shard.ids(int(at[0]), int(at[-1] - at[0])).astype("<u4")
                    cuts = at - at[0]
                    if what == "ids":
                        last = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    else:
                        raw = memoryview(ids).cast("B")
                        last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.int64())
                    yield pa.RecordBatch.from_arrays([doc, pa.array(r["first_token"] + at[:-1]), pa.array(np.diff(at)), last], names=["doc_id", "start", "n_tokens", what])
    return run


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of a folder: (doc_id, start, n_tokens, ids array<int>)."""
    return _ranges(read_manifest(ship(spark), folder)).mapInArrow(_reader(folder, "ids"), "doc_id long, start long, n_tokens long, ids array<int>")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the checksum is that of the ids as little-endian unsigned 32-bit integers."""
    return _ranges(read_manifest(ship(spark), folder)).mapInArrow(_reader(folder, "ids_crc32"), "doc_id long, start long, n_tokens long, ids_crc32 long")


class Corpus:
    """Random access for a training loop: the ids from any global position on, over shards, through memory maps."""

    def __init__(self, spark: SparkSession, folder: str):
        rows = read_manifest(spark, folder).orderBy("shard").collect()  # a row for each shard
        self.first = np.array([r["first_token"] for r in rows], np.int64)
        self.size = sum(r["n_tokens"] for r in rows)
        self.shards = [Shard(folder, r["name"], r["width"]) for r in rows]

    def window(self, start: int, n: int) -> np.ndarray:
        out, end = [], min(start + n, self.size)
        while start < end:
            k = int(np.searchsorted(self.first, start, "right")) - 1
            stop = min(end, int(self.first[k + 1]) if k + 1 < len(self.first) else self.size)
            out.append(self.shards[k].ids(start - int(self.first[k]), stop - start))
            start = stop
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op11_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder, default_path())
    return read_digests(spark, folder)
