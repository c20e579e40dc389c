"""Quality classifier with hierarchical empirical Bayes (operator 5).

Document evidence: two logistic regressions (good writing, toxic words) over a few measures of the text, fitted on a sample of at most
SAMPLE labelled rows. The measure of toxic words comes from a lexicon of at most LEXICON words, those that labelled toxic documents have
far more often than others; words are runs of letters, as hashes.

Sites: documents' probabilities are averaged by host (the source) and by path (the host's language sections) over all documents. Each level is a Beta
posterior around the level above: (sum + strength * parent's mean) / (n + strength), so sites with few documents stay near
the global rate. The strength comes from the spread of the level's own means (method of moments). A document's
final log-odds are its own evidence, moved by SHARE of the difference between its path's log-odds and the global ones; few documents
of a site are overruled by it, sparse sites hardly move at all.

A document is kept if it is more likely good than not, and not more likely toxic than not.

Cases: null and empty texts have the measures of an empty text; a null source or language is a site of its own; null ids and repeated rows are rows like
others; labels that are null, or for documents that aren't there, don't count; without labels of both kinds a
regression gives 0.5 and nothing is rejected by it; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import bytesops as B
from .common import cut, table

SAMPLE, LEXICON, SHARE = 20_000, 2_000, 0.5
#: Least toxic documents that a word of the lexicon stands in, and its least ratio of rates.
SEEN, RATIO = 3, 8.0
#: Bytes that are counted together.
KINDS = ("!?", "|", "%$#&*@~^", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\n", ".,;:", "<>{}[]=\\")
MEASURES = len(KINDS) + 7

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KIND = np.full(256, len(KINDS), np.int64)
for _i, _chars in enumerate(KINDS):
    _KIND[[ord(c) for c in _chars]] = _i


def letter_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words made of letters, A-Z as a-z, each word's text, and the words' lengths."""
    inside = _LETTER[data]
    first, last = inside.copy(), inside.copy()
    if len(data):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = offs[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return B.Rolling(data, lower=True).of(starts, ends), np.searchsorted(offs, starts, "right") - 1, ends - starts


def measures(column, lexicon: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row of MEASURES for each text; lexicon is sorted."""
    data, offs = B.texts(column)
    rows = []
    for i, j in B.slices(offs):
        part, own = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        n = j - i
        size = np.diff(own).astype(float)
        text_of = np.repeat(np.arange(n), np.diff(own))
        counts = np.bincount(text_of * (len(KINDS) + 1) + _KIND[part], minlength=n * (len(KINDS) + 1)).reshape(n, -1)[:, : len(KINDS)]
        h, t, length = letter_runs(part, own)
        words = np.bincount(t, minlength=n).astype(float)
        twice = np.zeros(len(h), bool)
        twice[1:] = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
        order = np.lexsort((h, t))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (t[order][1:] != t[order][:-1])
        distinct = np.bincount(t[order][fresh], minlength=n)
        hits, weight = np.zeros(n), np.zeros(n)
        if len(lexicon) and len(h):
            at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
            hit = lexicon[at] == h
            hits = np.bincount(t[hit], minlength=n).astype(float)
            weight = np.bincount(t[hit], weights=weights[at[hit]], minlength=n)
        w = np.maximum(words, 1)
        rows.append(np.column_stack([
            np.log1p(counts / np.maximum(size, 1)[:, None] * 100), np.bincount(t[twice], minlength=n) / w, distinct / w / np.power(w, -0.1),
            np.bincount(t, weights=length, minlength=n) / w / 10, np.log1p(size) / 10, np.log1p(words) / 10, np.log1p(hits), np.log1p(weight)]))
    return np.concatenate(rows) if rows else np.zeros((0, MEASURES))


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = B.texts(batch.column("text"))
        toxic = np.asarray(batch.column("toxic"))
        for i, j in B.slices(offs):
            h, t, _ = letter_runs(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            pairs = np.unique(np.stack([t.astype(B.U), h]), axis=1) if len(h) else np.zeros((2, 0), B.U)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64)), pa.array(toxic[i:j][pairs[0].astype(np.int64)].astype(np.int32))], names=["h", "toxic"])


def _measured(lexicon: np.ndarray, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measures(batch.column("text"), lexicon, weights)
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("toxic"), *[pa.array(m[:, k]) for k in range(MEASURES)]], names=["quality", "toxic", *[f"m{k}" for k in range(MEASURES)]])
    return run


class Logistic:
    """Regularised logistic regression by Newton steps, over standardised measures."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.weights = None
        if len(y) == 0 or y.min() == y.max():
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        keep = np.append(np.full(x.shape[1], ridge), 1e-6)
        w = np.zeros(z.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        return np.clip((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -30, 30)


class Model:
    """What fit() learned: the lexicon and the two regressions."""

    def __init__(self, lexicon, weights, good: Logistic, toxic: Logistic):
        self.lexicon, self.weights, self.good, self.toxic = lexicon, weights, good, toxic


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most sample labelled documents, the first in order of a hash of their ids."""
    ship(docs.sparkSession)
    chosen = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = cut(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "quality", "toxic"))
    sizes = dict((r["toxic"] > 0, r["n"]) for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect())
    bad, fine = sizes.get(True, 0), sizes.get(False, 0)
    words = known.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")).mapInArrow(_distinct_words, "h long, toxic int")
    words = words.groupBy("h").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") >= SEEN)
    ratio = (F.col("a") + 0.5) / F.lit(bad + 1.0) / ((F.col("b") + 0.5) / F.lit(fine + 1.0))
    # evidence of a word: how far its rate among toxic documents is above chance, by its count and ratio
    top = words.withColumn("r", F.log(ratio)).where(F.col("r") >= float(np.log(RATIO))).orderBy((F.col("r") * F.col("a")).desc(), "h").limit(LEXICON).toPandas()
    h = top["h"].to_numpy(np.int64).view(B.U)
    order = np.argsort(h)
    lexicon, weights = h[order], (top["r"] * np.sqrt(top["a"])).to_numpy(float)[order] / max(1.0, float(np.sqrt(max(bad, 1))))
    got = known.mapInArrow(_measured(lexicon, weights), "quality int, toxic int, " + ", ".join(f"m{k} double" for k in range(MEASURES))).toPandas()
    x = got[[f"m{k}" for k in range(MEASURES)]].to_numpy(float)
    return Model(lexicon, weights, Logistic(x[:, :-2], (got["quality"].to_numpy() > 0).astype(float)), Logistic(x[:, -2:], (got["toxic"].to_numpy() > 0).astype(float)))


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = measures(batch.column("text"), model.lexicon, model.weights)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.good.log_odds(m[:, :-2])), pa.array(model.toxic.log_odds(m[:, -2:]))], names=[*batch.schema.names, "__good", "__toxic"])
    return run


def _level(cells: DataFrame, keys: list[str], parent: str) -> DataFrame:
    """Adds the level's posterior mean as parent + '_': cells has n and s (sum of probabilities) and the parent's mean."""
    own = cells.groupBy(*keys).agg(F.sum("n").alias("ln"), F.sum("s").alias("ls"), F.first(parent).alias("lp"))
    # method of moments: spread of the level's means around their parents, less what chance alone gives
    rate = F.col("ls") / F.col("ln")
    spread = own.agg(F.avg(F.pow(rate - F.col("lp"), 2)).alias("v"), F.avg(F.col("lp") * (1 - F.col("lp")) / F.col("ln")).alias("c"), F.avg(F.col("lp") * (1 - F.col("lp"))).alias("q")).first()
    v = max((spread["v"] or 0.0) - (spread["c"] or 0.0), 1e-6)
    strength = max(1.0, (spread["q"] or 0.0) / v - 1)
    post = own.withColumn(parent + "_", (F.col("ls") + strength * F.col("lp")) / (F.col("ln") + strength)).drop("ln", "ls", "lp")
    post = post.select(*[F.col(k).alias(f"{k}__") for k in keys], parent + "_")
    on = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"{k}__"))
        on = c if on is None else on & c
    return cells.join(post, on).drop(*[f"{k}__" for k in keys])


def _odds(p) -> F.Column:
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(p / (1 - p))


def score(docs: DataFrame, model: Model, host: str = "source", path: str = "lang", share: float = SHARE) -> DataFrame:
    """docs with __quality, __toxicity (probabilities), __host, __path (posterior means of good writing) and __keep."""
    ship(docs.sparkSession)
    kinds = docs.schema
    rows = docs.mapInArrow(_scored(model), type(kinds)(list(kinds.fields)).add("__good", "double").add("__toxic", "double"))
    narrow = docs.select(F.col(host).alias("host"), F.col(path).alias("path"), "text").mapInArrow(_scored(model), "host string, path string, text string, __good double, __toxic double").select("host", "path", "__good")
    cells = cut(narrow.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(1 / (1 + F.exp(-F.col("__good")))).alias("s")))
    world = cells.agg((F.sum("s") / F.sum("n")).alias("p")).first()["p"]
    cells = cells.withColumn("g", F.lit(float(world if world is not None else 0.5)))
    cells = cut(_level(_level(cells, ["host"], "g"), ["host", "path"], "g_"))
    sites = cells.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("g").alias("__g"), F.col("g_").alias("__host"), F.col("g__").alias("__path"))
    joined = rows.join(sites, F.col(host).eqNullSafe(F.col("__h")) & F.col(path).eqNullSafe(F.col("__p")), "left")
    logit = F.col("__good") + F.lit(share) * (_odds(F.col("__path")) - _odds(F.col("__g")))
    quality, toxicity = 1 / (1 + F.exp(-logit)), 1 / (1 + F.exp(-F.col("__toxic")))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], quality.alias("__quality"), toxicity.alias("__toxicity"), "__host", "__path", ((logit >= 0) & (F.col("__toxic") <= 0)).alias("__keep"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.col("__quality").alias("quality"), F.col("__toxicity").alias("toxicity"), F.col("__host").alias("host_prior"), F.col("__path").alias("path_prior"), F.col("__keep").alias("keep"))
