"""Byte-level BPE encoding and decoding (operator 6).

Pre-tokenisation uses no regular expression. Each code point has a class: letter, number, white space, other. The slices that the
pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ matches begin where the class changes, with two
corrections that look at neighbours only: the last white space before a visible run stands apart (and, if it is U+0020, begins that run's
slice), and a contraction ends after its letters. A code point acts on the state "where did the current run begin"
as a function: it keeps the state or sets it to itself. Composing such functions is associative (the later setter wins), so
all states follow from one scan, numpy's maximum.accumulate.

Equal slices are encoded once: a batch is reduced to its distinct slices by rolling hashes, and those not in the worker's cache are merged
together: in each step, every slice merges its pair of lowest rank (the leftmost one), as one vectorised lookup over all slices. A slice of more than
LONG bytes is merged by itself, with a heap of pairs. Offsets into a flat id array are kept for each text, so decoding is one gather of token bytes;
the decoded bytes are compared with the text, and where a hash took one slice for another, slices are told by their bytes instead.

Cases: null and empty texts have no tokens. Other columns aren't read; rows that repeat an id are rows of their own.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import bytesops as B
from .common import table

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Slices that a worker keeps the ids of.
CACHE = 400_000
#: Slices of more bytes are merged one by one with a heap; the ids are the same.
LONG = 512
# Code points with the property White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters of contractions after an apostrophe.
SINGLE, DOUBLE = "stmd", ("re", "ve", "ll")


@cache
def point_classes() -> np.ndarray:
    t = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            t[c] = LETTER
        elif k == "N":
            t[c] = NUMBER
    t[WHITE] = SPACE
    return t


def slice_starts(points: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Code points of texts one after another, and the texts' offsets (n + 1): where slices begin."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = point_classes()[points]
    head = np.zeros(n + 1, bool)
    head[offs] = True
    tail = head[1:]  # last code point of a text
    head = head[:n]
    run = head.copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # a white space before something visible in the same text stands apart from the run before it
    visible = np.zeros(n, bool)
    visible[:-1] = ~space[1:] & ~tail[:-1]
    lead = space & visible
    begin = run | lead
    # U+0020 there begins the slice of what follows
    joined = np.zeros(n, bool)
    joined[1:] = (lead & (points == 32))[:-1]
    begin &= ~joined | head
    # contractions: an apostrophe that begins a slice, and the letters after it
    at = np.flatnonzero((points == 39) & begin)
    if len(at):
        far = np.append(points, [0, 0, 0])
        left = np.append(np.flatnonzero(head), n)
        end = left[np.searchsorted(left, at, "right")] - at  # code points up to the end of the text
        one = np.isin(far[at + 1], [ord(c) for c in SINGLE]) & (end > 1)
        two = np.zeros(len(at), bool)
        for a, b in DOUBLE:
            two |= (far[at + 1] == ord(a)) & (far[at + 2] == ord(b)) & (end > 2)
        for hit, size in ((one, 2), (two, 3)):
            begin[at[hit] + 1] = False
            rest = at[hit] + size
            rest = rest[rest < n]
            # what follows begins anew unless a space already leads it
            begin[rest] = True
    # the scan: each code point's slice is the last beginning at or before it
    state = np.maximum.accumulate(np.where(begin, np.arange(n), 0))
    return np.flatnonzero(state == np.arange(n))


class Vocabulary:
    """Ranks of byte strings, the table of mergeable pairs, and the ids of slices met lately."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.single = np.array([rank[bytes([b])] for b in range(256)], np.int64)
        top = max(rank.values()) + 1
        tokens = [b""] * top
        for t, r in rank.items():
            tokens[r] = t
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        keys, to = [], []
        for t, r in rank.items():
            for i in range(1, len(t)):
                a, b = rank.get(t[:i]), rank.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    to.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.pair, self.to = np.array(keys, np.int64)[order], np.array(to, np.int64)[order]
        self.cache: dict[tuple[int, int] | bytes, np.ndarray] = {}
        self.pairs: dict[int, int] | None = None

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a << 32 | b
        i = np.minimum(np.searchsorted(self.pair, k), len(self.pair) - 1)
        return np.where(self.pair[i] == k, self.to[i], np.int64(1) << 40)

    def merge_long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one slice: its pairs in a heap by rank and place, its symbols in a linked list; n log n for any length."""
        if self.pairs is None:
            self.pairs = dict(zip(self.pair.tolist(), self.to.tolist(), strict=True))
        pairs, ids = self.pairs, self.single[data].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] << 32 | ids[j]) != r:
                continue  # one of the two was merged since
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (x := pairs.get(r << 32 | ids[k])) is not None:
                    heappush(heap, (x, i))
            h = before[i]
            if h >= 0 and (x := pairs.get(ids[h] << 32 | r)) is not None:
                heappush(heap, (x, h))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def merge(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """Ids of each slice of bytes: short ones all at once, a merge in each of them a step."""
        size = np.diff(offs)
        long = size > LONG
        if not long.any():
            return self.merge_short(data, offs)
        short = self.merge_short(data[np.repeat(~long, size)], np.concatenate([[0], np.cumsum(size[~long])]))
        others = iter(short)
        return [self.merge_long(data[a:b]) if x else next(others) for x, a, b in zip(long.tolist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True)]

    def merge_short(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        n = len(offs) - 1
        out: list[np.ndarray] = [None] * n
        ids, owner = self.single[data], np.repeat(np.arange(n), np.diff(offs))
        none = np.int64(1) << 40
        rank = np.full(len(ids), none)
        same = owner[1:] == owner[:-1]
        rank[:-1][same] = self.pair_rank(ids[:-1][same], ids[1:][same])
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.append(first, len(ids)))
            best = np.minimum.reduceat(rank, first)
            over = best == none
            if over.any():
                for f, s in zip(first[over].tolist(), size[over].tolist(), strict=True):
                    out[owner[f]] = ids[f : f + s].astype(np.uint32)
                stay = np.repeat(~over, size)
                ids, owner, rank = ids[stay], owner[stay], rank[stay]
                if not len(ids):
                    break
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                size = np.diff(np.append(first, len(ids)))
                best = best[~over]
            # the leftmost pair of lowest rank in each slice
            hit = np.flatnonzero(rank == np.repeat(best, size))
            hit = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])]
            ids[hit] = rank[hit]
            gone = np.ones(len(ids), bool)
            gone[hit + 1] = False
            at = hit - np.arange(len(hit))
            ids, owner, rank = ids[gone], owner[gone], rank[gone]
            for left in (at - 1, at):
                left = left[left >= 0]
                right = np.minimum(left + 1, len(ids) - 1)
                ok = (left + 1 < len(ids)) & (owner[left] == owner[right])
                rank[left] = np.where(ok, self.pair_rank(ids[left], ids[right]), none)
        return [x if x is not None else np.zeros(0, np.uint32) for x in out]

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of consecutive slices that make up data, flat, how many each slice has, and the decoded bytes.

        Equal slices are told by rolling hashes. A wrong match would decode to other bytes, so the decoded bytes show it, and then slices are told by
        their bytes.
        """
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), data
        roll = B.Rolling(data)
        h = roll.of(starts, ends)
        mid = (starts + ends + 1) // 2
        two = B.mix(roll.of(starts, mid) * B.U(3) + roll.of(mid, ends))
        _, where, inverse = np.unique(h ^ B.mix(two), return_index=True, return_inverse=True)
        ids, count = self._encode(data, starts, ends, list(zip(h[where].tolist(), two[where].tolist(), strict=True)), where, inverse)
        back = self.decode(ids)
        if not np.array_equal(back, data):
            raw = data.tobytes()
            slices = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            number: dict[bytes, int] = {}
            inverse = np.array([number.setdefault(x, len(number)) for x in slices], np.int64)
            where = np.unique(inverse, return_index=True)[1]
            ids, count = self._encode(data, starts, ends, list(number), where, inverse)
            back = self.decode(ids)
        return ids, count, back

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: list, where: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = [i for i, k in enumerate(keys) if k not in self.cache]
        if new:
            if len(self.cache) + len(new) > CACHE:
                self.cache = {k: self.cache[k] for k in keys if k in self.cache}
            a, b = starts[where[new]], ends[where[new]]
            size = b - a
            offs = np.concatenate([[0], np.cumsum(size)])
            flat = data[np.repeat(a - offs[:-1], size) + np.arange(offs[-1])]
            for i, got in zip(new, self.merge(flat, offs), strict=True):
                self.cache[keys[i]] = got
        parts = [self.cache[k] for k in keys]
        size = np.array([len(p) for p in parts], np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        flat = np.concatenate(parts)
        count = size[inverse]
        offs = np.concatenate([[0], np.cumsum(count)])
        return flat[np.repeat(first[inverse] - offs[:-1], count) + np.arange(offs[-1])], count

    def decode(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        offs = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[np.repeat(self.first[ids] - offs[:-1], size) + np.arange(offs[-1])]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def point_starts(data: np.ndarray) -> np.ndarray:
    """Bytes of valid UTF-8 that begin a code point."""
    return np.flatnonzero((data & 0xC0) != 0x80)


def encode_texts(column, vocab: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, first id of each text, decoded bytes, first byte of each text), for a few texts at a time."""
    data, offs = B.texts(column)
    for i, j in B.slices(offs):
        part, own = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        points = np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32)
        byte_of = np.append(point_starts(part), len(part))
        texts_at = np.searchsorted(byte_of, own)
        starts = byte_of[slice_starts(points, texts_at)]
        ends = np.append(starts[1:], len(part))
        ids, count, back = vocab.encode(part, starts, ends)
        total = np.concatenate([[0], np.cumsum(count)])
        first = total[np.searchsorted(starts, own)]
        yield ids, first, back, own


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            n, one, two = [], [], []
            for ids, first, back, own in encode_texts(batch.column("text"), vocab):
                raw, plain = ids.astype("<u4").tobytes(), back.tobytes()
                for a, b, c, d in zip(first[:-1].tolist(), first[1:].tolist(), own[:-1].tolist(), own[1:].tolist(), strict=True):
                    n.append(b - a)
                    one.append(hashlib.sha256(raw[4 * a : 4 * b]).hexdigest())
                    two.append(hashlib.sha256(plain[c:d]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            parts, sizes = [], []
            for ids, first, _, _ in encode_texts(batch.column("text"), vocab):
                parts.append(ids.astype(np.int32))
                sizes.append(np.diff(first))
            offs = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat))], names=[*batch.schema.names, "ids"])
    return run


def _bytes(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            out = [vocab.decode(np.array(x, np.int64)).tobytes() if x is not None else None for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])
    return run


def _with(rows: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField(name, kind)])


def encode(rows: DataFrame, path: str) -> DataFrame:
    """(id columns, text) to the same with ids array<int>."""
    ship(rows.sparkSession)
    return rows.mapInArrow(_ids(path), _with(rows, "ids", T.ArrayType(T.IntegerType())))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(id columns, ids array<int>) to the same with decoded binary."""
    ship(rows.sparkSession)
    return rows.mapInArrow(_bytes(path), _with(rows, "decoded", T.BinaryType()))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for docs with doc_id and text."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id"), "text").mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_path())
