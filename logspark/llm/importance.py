"""Importance resampling towards a target distribution (operator 13).

Features are runs of 1 to 2 consecutive words, hashed into BUCKETS buckets by CRC-32. Two arrays of BUCKETS counts, of the corpus and of the target texts, give
an array of gains, and a document's weight is the floored mean of its features' gains. Each task counts its own texts into one array and sends that; the gains
(BUCKETS numbers, whatever the input) go to all tasks. A document's score is its weight plus a keyed Gumbel noise, and the highest scores are drawn.

Scores are ranked by parallel sorting by regular sampling. Tasks sort their rows into runs; every run gives the keys at regular places as samples
(at most SAMPLES for all runs together); regular places of the sorted samples are the splitters; rows are exchanged by splitter, segments are sorted (merged) in their
tasks, and prefix counts over segments give each row its exact rank. Splitters only balance the load: ranks don't depend on them.

CRC-32 of two words joined by a space follows from the words' own: the checksum's register is linear, so moving the first checksum over the bytes of
the second word is four table lookups for each word length, done for all pairs of a slice at once.

Cases: null and empty texts have no words, no features and weight 0. Rows without doc_id have no score and take no part in the draw, nor in N. Fewer than LEAST
words: a score, but no part in the draw. Ties go to the smaller doc_id; rows that repeat an id with equal score may change places. Words of any length count whole,
and a long text is counted in slices of CHUNK words. An empty table gives an empty result, and empty target texts a gain for every bucket all the same. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import bytesops as B
from .common import cut, table
from .ranks import placed

BUCKETS = 10_000
#: Words that a document must have to be drawn, and the share that is drawn, in percent.
LEAST, PERCENT = 20, 25
#: Keys that all runs give as samples, together.
SAMPLES = 100_000
#: Words handled at a time, and the longest word whose checksum is taken along with the others.
CHUNK, LONG = 1 << 18, 32

_WORD = np.ones(256, bool)
_WORD[:0x30] = False
_WORD[0x3A:0x61] = False
_WORD[0x7B:0x80] = False


@cache
def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


@lru_cache(4096)
def _shift(n: int) -> np.ndarray:
    """What n zero bytes make of a register, as four tables for its four bytes."""
    t = crc_table()
    if n == 0:
        out = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        return out
    if n == 1:
        r = _shift(0)
        return t[r & 0xFF] ^ (r >> np.uint32(8))
    return _moved(_shift(n - n // 2), n // 2)


def _moved(r: np.ndarray, n: int) -> np.ndarray:
    t = _shift(n)
    return t[0][r & 0xFF] ^ t[1][(r >> np.uint32(8)) & 0xFF] ^ t[2][(r >> np.uint32(16)) & 0xFF] ^ t[3][r >> np.uint32(24)]


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each slice, byte by byte for all of them at once; long ones by themselves."""
    size, t = ends - starts, crc_table()
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    n_long = int(np.count_nonzero(size > LONG))
    rest = order[n_long:]
    at, sizes = starts[rest], -size[rest]
    c = out[rest]
    for j in range(LONG):
        n = int(np.searchsorted(sizes, -j, "left"))  # those longer than j
        if not n:
            break
        c[:n] = t[(c[:n] ^ data[at[:n] + j]) & 0xFF] ^ (c[:n] >> np.uint32(8))
    out[rest] = ~c
    for k in order[:n_long].tolist():
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes())
    return out


def pair_crcs(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each word but the last, a space and the next word."""
    if len(crc) < 2:
        return crc[:0]
    t = crc_table()
    r = ~crc[:-1]
    first = ~(t[(r ^ np.uint32(32)) & 0xFF] ^ (r >> np.uint32(8)))
    out = np.empty(len(first), np.uint32)
    order = np.argsort(size[1:], kind="stable")
    sizes = size[1:][order]
    cuts = np.flatnonzero(np.concatenate([[True], sizes[1:] != sizes[:-1]]))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sizes)], strict=True):
        k = order[a:b]
        out[k] = _moved(first[k], int(sizes[a])) ^ crc[k + 1]
    return out


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, number of words of each text, buckets, text of each bucket's feature), for a few texts at a time; a long text comes in several slices.

    The words of a text are counted in the slice that begins it.
    """
    data, offs = B.texts(column)
    for i, j in B.slices(offs):
        part, own = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        low = part + (((part >= 65) & (part <= 90)).astype(np.uint8) << 5)
        inside = _WORD[low]
        first, last = inside.copy(), inside.copy()
        if len(low):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = own[1:-1]
            edge = edge[(edge > 0) & (edge < len(low))]
            first[edge], last[edge - 1] = inside[edge], inside[edge - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        text = np.searchsorted(own, starts, "right") - 1
        n_words = np.bincount(text, minlength=j - i)
        for a in range(0, max(len(starts), 1), CHUNK):
            # one word more than the slice's, for the pair across its end
            x, y, of = starts[a : a + CHUNK + 1], ends[a : a + CHUNK + 1], text[a : a + CHUNK + 1]
            crc = word_crcs(low, x, y)
            both = of[1:] == of[:-1]
            pair = pair_crcs(crc, y - x)[both]
            n = min(len(x), CHUNK)
            yield i, n_words if a == 0 else np.zeros(j - i, np.int64), np.concatenate([crc[:n], pair]) % np.uint32(BUCKETS), np.concatenate([of[:n], of[:-1][both]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, bucket, _ in features(batch.column(0)):
            total += np.bincount(bucket, minlength=BUCKETS)
    k = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features in each bucket over all rows of texts (text): BUCKETS numbers, summed over the tasks' own."""
    rows = texts.select("text").mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS at most
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def _weigh(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, words, bucket, of in features(batch.column(1)):
                m = len(words)
                n_words[i : i + m] += words
                n[i : i + m] += np.bincount(of, minlength=m)
                # sums of integers below 2**53: exact as doubles
                total[i : i + m] += np.bincount(of, gain[bucket], minlength=m).astype(np.int64)
            weight = np.floor_divide(total, np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])
    return run


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_weigh(gain), "doc_id long, n_words long, n_features long, weight long")


def scored(rows: DataFrame, key: str = "7") -> DataFrame:
    """rows (doc_id, weight) with score: the weight and a Gumbel noise that the key and the id fix."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))))


def _segment(splitters: np.ndarray):
    """The number of splitters that come before a row, in the order of falling score and rising id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(splitters)
        for batch in batches:
            score, doc = batch.column("score").to_numpy(), batch.column("doc_id").to_numpy()
            order = np.lexsort((np.concatenate([splitters[:, 1], doc]), -np.concatenate([splitters[:, 0], score])))
            before = np.empty(len(order), np.int64)
            before[order] = np.cumsum(order < k) - (order < k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before[k:].astype(np.int32))], names=[*batch.schema.names, "__segment"])
    return run


def sort_ranks(rows: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """rows (doc_id, score, more; neither null) with `rank` from 1 by falling score, then rising doc_id."""
    spark = ship(rows.sparkSession)
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    runs = cut(placed(rows.sortWithinPartitions(*order)))
    sizes = runs.groupBy("__part").agg(F.count("*").alias("__size"))
    n_runs = sizes.count()
    columns = [F.col(f"`{c}`") for c in rows.columns]
    if not n_runs:
        return runs.select(*columns, F.lit(0).cast("long").alias("rank"))
    # regular places of each run: `samples` keys from all of them, or one from each if there are more runs than that
    step = F.ceil(F.col("__size") / max(1, samples // n_runs))
    # sizes has a row for each partition
    chosen = runs.join(F.broadcast(sizes), "__part").where((F.col("__place") % step) == F.floor(step / 2)).select("score", "doc_id").collect()
    keys = np.array(sorted((tuple(r) for r in chosen), key=lambda r: (-r[0], r[1])), np.int64).reshape(-1, 2)
    segments = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = np.unique(np.arange(1, segments) * len(keys) // segments)
    splitters = keys[at]
    dealt = runs.select(*columns).mapInArrow(_segment(splitters), T.StructType([*rows.schema.fields, T.StructField("__segment", T.IntegerType())]))
    dealt = dealt.repartitionById(len(splitters) + 1, F.col("__segment")).sortWithinPartitions(*order)
    merged = cut(placed(dealt).drop("__part"))
    counts = merged.groupBy("__segment").agg(F.count("*"), F.min("__place")).orderBy("__segment").collect()  # a row for each segment
    size = np.cumsum([0, *(n for _, n, _ in counts)])
    base = spark.createDataFrame([(k, int(b - low + 1)) for (k, _, low), b in zip(counts, size[:-1], strict=True)], "__of int, __base long")
    return merged.join(F.broadcast(base), F.col("__segment") == F.col("__of")).select(*columns, (F.col("__place") + F.col("__base")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, key: str = "7") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs (doc_id, text); rank is null for rows that aren't drawn."""
    ship(docs.sparkSession)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    rows = cut(scored(weighed(docs, gain), key))
    able = (F.col("n_words") >= least) & F.col("doc_id").isNotNull()
    there = rows.where(able)
    drawn = there.count() * percent // 100
    ranks = sort_ranks(there.select("doc_id", "score", "n_features", "weight"))
    ranks = ranks.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(~able).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranks.select(names).unionByName(rest.select(names))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
