"""Approximate nearest neighbours by multi-index hashing (operator 1).

A rotation is learned on a sample of at most SAMPLE vectors: principal axes, then iterative quantisation, so that signs along the axes are
BITS-bit codes that keep angles. Inner products of any vectors are angles after one more component, which brings all vectors to
one norm. Codes are cut into PARTS substrings. An index block holds a table of each substring's values and its rows; by the pigeonhole
principle, a code within Hamming distance r of a query agrees with it in some substring up to r // PARTS bits, so probing each
table within that distance finds all codes within r; they are reranked by the inner product of the vectors.

The radius is learned on the sample too: the distance within which RECALL of true neighbours lie, at the sample's density. A
query that finds too few candidates widens its own radius, so it always gets k neighbours if there are that many.

Vectors are dealt to blocks of about BLOCK by a hash of their id, queries to blocks of QUERIES; each pair of blocks is one task's
work of bounded size, and gives k rows for each of its queries. The rotation and radius are all that goes through the driver.

Cases: vectors that are null, zero, of another length than the sample's usual one, or hold null or non-finite components take no
part; fewer candidates than k give all of them; equal scores are ordered by id; rows with the query's own id are not its neighbours; of query rows that repeat an id, one is asked; null ids take no
part; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import cut, table

SAMPLE, ROUNDS, BITS, PARTS, RECALL = 8192, 30, 64, 4, 0.97
BLOCK, QUERIES = 16384, 2048


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull()).where(fine)


class Codes:
    """A learned rotation: vectors to codes of up to 64 bits."""

    def __init__(self, sample: np.ndarray, norm: float, total: int, k: int, seed: int = 5):
        self.norm = norm
        x = self.lift(sample)
        self.mean = x.mean(0)
        x = x - self.mean
        values, axes = np.linalg.eigh(x.T @ x)
        self.bits = min(BITS, x.shape[1])
        axes = axes[:, np.argsort(-values, kind="stable")[: self.bits]]
        y = x @ axes
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.bits, self.bits)))[0]
        for _ in range(ROUNDS):  # signs of the rotated sample, then the rotation that fits them best
            u, _, v = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
            turn = (u @ v).T
        self.axes = axes @ turn
        self.radius = self._radius(sample, total, k)

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm  # before squaring: components may be as large as doubles are
        rest = np.maximum(0.0, 1 - np.einsum("ij,ij->i", x, x))
        return np.concatenate([x, np.sqrt(rest)[:, None]], 1)

    def of(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        if query:
            x = x / np.abs(x).max(1, keepdims=True)
            y = np.concatenate([x / np.linalg.norm(x, axis=1)[:, None], np.zeros((len(x), 1))], 1)
        else:
            y = self.lift(x)
        bits = ((y - self.mean) @ self.axes > 0).astype(np.uint8)
        full = np.zeros((len(x), 64), np.uint8)
        full[:, : self.bits] = bits
        return np.ascontiguousarray(np.packbits(full, axis=1)).view(np.uint64).ravel()

    def _radius(self, sample: np.ndarray, total: int, k: int) -> int:
        n = len(sample)
        if n < 3:
            return self.bits
        near = min(n - 1, max(3, -(-k * n // max(total, 1))))
        some = np.arange(min(n, 512))
        small = sample / self.norm
        score = small[some] @ small.T
        score[some, some] = -np.inf
        best = np.argpartition(-score, near - 1, axis=1)[:, :near]
        code, ask = self.of(sample), self.of(sample[some], True)
        distance = np.bitwise_count(code[best] ^ ask[:, None])
        return int(np.quantile(distance, RECALL, method="higher"))


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of width bits with at most radius set."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.uint64)


class Tables:
    """Substring tables of a block of codes."""

    def __init__(self, codes: np.ndarray, parts: int = PARTS):
        self.codes, self.parts, self.width = codes, parts, 64 // parts
        self.balls: dict[int, np.ndarray] = {}
        self.index = []
        for p in range(parts):
            sub = self.sub(codes, p)
            order = np.argsort(sub, kind="stable")
            values, first = np.unique(sub[order], return_index=True)
            self.index.append((values, np.append(first, len(codes)), order))

    def sub(self, codes: np.ndarray, p: int) -> np.ndarray:
        return codes >> np.uint64(p * self.width) & np.uint64((1 << self.width) - 1)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows with codes within the radius, by probing."""
        if radius not in self.balls:
            small = radius // self.parts
            size = 1
            c = 1
            for i in range(small):
                c = c * (self.width - i) // (i + 1)
                size += c
            # few masks: look each one up; more masks than values: compare the values
            self.balls[radius] = ball(self.width, small) if size < 512 else np.zeros(0, np.uint64)
        masks, hit = self.balls[radius], np.zeros(len(self.codes), bool)
        for p, (values, first, order) in enumerate(self.index):
            own = code >> np.uint64(p * self.width) & np.uint64((1 << self.width) - 1)
            if len(masks):
                at = np.searchsorted(values, masks ^ own)
                at = at[at < len(values)]
                at = at[np.isin(values[at], masks ^ own)]
            else:
                at = np.flatnonzero(np.bitwise_count(values ^ own) <= radius // self.parts)
            size = first[at + 1] - first[at]
            offs = np.concatenate([[0], np.cumsum(size)])
            hit[order[np.repeat(first[at] - offs[:-1], size) + np.arange(offs[-1])]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


_OUT = "query_id long, vec_id long, score double"


def _search(codes: Codes, k: int):
    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        ask, who, out = [], [], []
        if len(queries) and len(block):
            qid, bid = np.asarray(queries.column("id")), np.asarray(block.column("id"))
            q, x = _matrix(queries.column("v")), _matrix(block.column("v"))
            tables, codes_q = Tables(codes.of(x)), codes.of(q, True)
            for i in range(len(qid)):
                radius = codes.radius
                rows = tables.within(codes_q[i], radius)
                want = min(k, int((bid != qid[i]).sum()))
                while (bid[rows] != qid[i]).sum() < want:
                    radius += 4
                    rows = tables.within(codes_q[i], min(radius, 64))
                rows = rows[bid[rows] != qid[i]]
                score = (x[rows] * q[i]).sum(1)
                best = rows[np.lexsort((bid[rows], -score))[:k]]
                ask += [qid[i]] * len(best)
                who += bid[best].tolist()
                out += (x[best] * q[i]).sum(1).tolist()
        return pa.table({"query_id": pa.array(ask, pa.int64()), "vec_id": pa.array(who, pa.int64()), "score": pa.array(out, pa.float64())})
    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k of vectors with the largest inner product, but for its own id."""
    ship(vectors.sparkSession)
    rows = usable(vectors, key, vector)
    most = F.array_max(F.transform("v", F.abs))
    norm = most * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / most) * (x / most)))
    # the usual length; a handful of distinct lengths, one row each
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("norm"))
    usual = usual.orderBy(F.col("n").desc(), "d").first()
    if usual is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, total = usual["d"], usual["n"]
    rows = cut(rows.where(F.size("v") == d))
    asked = usable(queries, key, vector).where(F.size("v") == d).dropDuplicates(["id"])
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    codes = Codes(np.array(sample["v"].tolist()), min(float(usual["norm"]), np.finfo(float).max), total, k)
    blocks = -(-total // BLOCK)
    parts = max(1, -(-asked.count() // QUERIES))
    left = asked.withColumn("qb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("vb", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(_search(codes, k), _OUT)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
