"""Near-duplicate documents by bottom-k sketches of one hash function (operator 7).

A document is the set of its distinct k-word shingles; two documents are linked if 100 * |A and B| >= percent * |A or B|.

1. Each text becomes its set of shingle hashes (from BLAKE2b digests of its words), a 128-bit BLAKE2b fingerprint of the set, and its bottom-k sketch (the
   RETAIN smallest hashes). Documents with the same fingerprint are one class from here on, whatever their number.
2. Inverted lists of retained values. A partner at the threshold has most of a sketch's values (all but 100 - percent of a whole set; of a sketch,
   what a binomial tail of LOSS leaves), so a prefix that is one longer than what may differ holds a common one, in any order that all documents
   share. The order is by how many sketches have a value, rarest first: values that nobody shares use the prefix up and need no list, and
   common lines or passages come last. Lists with one label (their member with most lists) are one group. Of groups of two, union-sketch estimation
   drops those far below the threshold.
3. Each class meets the label of its largest group (exact Jaccard). Groups whose members are in one component by then need no more work.
   Of the others, those of FEW members or less are taken as pairs, which the union-sketch estimate thins out as in 2. and an exact Jaccard settles; that is at
   most FEW / 2 estimates a row. Larger ones are never taken as all pairs. A group's core is the set of the shingles that more than half of its members have; it is
   found from the member whose sketch is nearest to what most have. A member A is told by what it lacks of the core (M) and adds to it (E). Sizes of intersections follow from those: with w(A) = 100 |M| + percent |E| and
   T = (100 - percent) * |core|, A and B are linked exactly if (100 + percent) * s >= w(A) + w(B) - T, s being how many elements their M and their E share.
   The member with the smallest w is compared with all others (exact Jaccard); then only pairs are open in which one isn't linked
   to it, and those must share some of their differences. Every difference is one of at most half of the members, so inverted lists of differences, again as
   rarest-first prefixes by the least s that a partner can ask for, are at most half as large as the group. Members that share fewer differences than any
   partner asks for are through. If at most half of a group is left, those are one group of the next round, a row each; else its lists are the groups. Their
   cores come from the one before and the members' differences from it, so whole sets are read once.
   So rounds are log2 of the largest group at most, and nothing is capped. Where more than half is left, a document may stand in many lists,
   and rows of differences can grow faster than the input (README has the figures).

Cases: null and empty texts, and texts of white space, have an empty set and no links; a text with fewer than k words has one
shingle, the whole sequence. Very long texts are sets like others, one text at a time. Null ids take no part in links and get a null component. Rows that
repeat an id are versions of one document: with different texts they count as linked, so no link of any version is lost. Other columns aren't read. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship
from . import bytesops as B
from .common import components, cut, table

RETAIN = 64
#: Members of a group that is taken as pairs.
FEW = 16
#: Values of a sketch that name the central member of a larger group.
NAMING = 24
#: Chance that a link at the threshold has fewer common values in its sketches than least_common() asks for.
LOSS = 1e-9
_SIGN = B.U(1 << 63)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    h = B.word_digests(text)
    if len(h) >= k:
        return np.unique(B.shingles(h, k))
    return B.shingles(h, len(h)) ^ B.U(len(h)) if len(h) else h


def _longs(sets: list[np.ndarray]) -> pa.ListArray:
    """Signed numbers in the order of the unsigned ones."""
    offs = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array((np.concatenate(sets) ^ _SIGN).view(np.int64) if sets else np.zeros(0, np.int64)))


def _sketch(k: int, retain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, lows = [], [], [], []
            for t in batch.column("text"):
                s = shingle_set((t.as_py() or "").encode(), k)
                d = blake2b(s.tobytes(), digest_size=16).digest()
                n.append(len(s))
                one.append(int.from_bytes(d[:8], "little", signed=True))
                two.append(int.from_bytes(d[8:], "little", signed=True))
                lows.append(s[:retain])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), _longs(lows)], names=["id", "n", "f1", "f2", "low"])
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes: a shuffle moves less."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([press.compress((x or "").encode()) for x in batch.column("text").to_pylist()], pa.binary())], names=["id", "z"])


def packed(docs: DataFrame) -> DataFrame:
    """(id, text) to (id, z)."""
    return docs.select("id", "text").mapInArrow(_pack, "id long, z binary")


def _sets(k: int):
    """(z, want: fingerprints and classes of the row's id) to (c, els), a few rows at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for z, want in zip(batch.column("z"), batch.column("want").to_pylist(), strict=True):
                s = shingle_set(unpack.decompress(z.as_py()), k)
                f = int.from_bytes(blake2b(s.tobytes(), digest_size=16).digest()[:8], "little", signed=True)
                c = [x["c"] for x in want if x["f1"] == f]  # another version of the document has another one
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), _longs([s] * len(c))], names=["c", "els"])
    return run


def estimate(x: str, y: str, k: int) -> F.Column:
    """Jaccard estimate from two bottom-k sketches: the share of the union's bottom-k that both have."""
    low = F.slice(F.array_sort(F.array_union(x, y)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(low, F.col(x)), F.col(y))) / F.size(low)


def least_common(retain: int, share: float) -> int:
    """The most common values that can be asked of two sketches, each value common with that probability, so that at most LOSS of them have fewer."""
    tail, t = 0.0, 0
    while t < retain and tail + comb(retain, t) * share**t * (1 - share) ** (retain - t) <= LOSS:
        tail += comb(retain, t) * share**t * (1 - share) ** (retain - t)
        t += 1
    return t


def too_far(x: str, y: str, percent: int, retain: int) -> F.Column:
    """Do two sketches tell that their sets aren't linked? Whole sets are estimated exactly; of sketches, what the binomial tail leaves."""
    whole = F.size(F.array_union(x, y)) < retain
    return estimate(x, y, retain) < F.when(whole, F.lit(percent / 100 - 1e-6)).otherwise(F.lit((least_common(retain, percent / 100) - 0.5) / retain))


def inverted_lists(reps: DataFrame, percent: int, retain: int) -> DataFrame:
    """(c, low) to (key, c): rarest-first prefixes of the sketches, without lists of one."""
    every = reps.select("c", F.explode("low").alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    ranked = every.join(shared, "key").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("v"))
    lists = ranked.join(reps.select("c", F.size("low").alias("m")), "c")
    j = percent / 100
    # values that a partner must have, of the m retained ones: exactly for whole sets, else what the binomial tail leaves
    need = F.when(F.col("m") < retain, F.ceil(F.col("m") * F.lit(percent) / F.lit(100))).otherwise(F.lit(max(1, least_common(retain, j))))
    first = (F.col("m") - need + 1 - (F.col("m") - F.size("v"))).cast("int")  # the prefix, less the values that nobody shares
    lists = cut(lists.where(first > 0).select("c", F.explode(F.slice("v", F.lit(1), first)).alias("x")).select("c", "x.key"))
    several = lists.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key")
    return cut(lists.join(several, "key").select("key", "c"))


def first_groups(lists: DataFrame, lows: DataFrame, percent: int, retain: int) -> DataFrame:
    """(key, c) and (c, low) to groups (g, p, c, known): lists with the same label p are one; known is a component label."""
    times = lists.groupBy("c").agg(F.count("*").alias("times"))
    label = lists.join(times, "c").groupBy("key").agg(F.max(F.struct("times", "c"))["c"].alias("g"))
    groups = cut(lists.join(label, "key").select("g", "c").distinct())
    sizes = groups.groupBy("g").agg(F.count("*").alias("n"), F.min("c").alias("a"), F.max("c").alias("b"))
    two = sizes.where("n = 2").join(lows.select(F.col("c").alias("a"), F.col("low").alias("x")), "a").join(lows.select(F.col("c").alias("b"), F.col("low").alias("y")), "b")
    far = two.where(too_far("x", "y", percent, retain)).select("g")
    return groups.join(far, "g", "left_anti").select("g", F.col("g").alias("p"), "c", F.col("c").alias("known"))


def central(groups: DataFrame, lows: DataFrame) -> DataFrame:
    """groups (g, p, c, known) with p as the member whose sketch (c, low) is nearest to the values that more than half of a group have.

    Differences from it are about those from the core; from a far member, each of the others has all of that one's own, too.
    """
    n = groups.groupBy("g").agg(F.count("*").alias("n"))
    each = groups.join(n, "g").join(lows, "c").select("g", "n", "c", F.explode(F.slice("low", 1, NAMING)).alias("x")).withColumn("df", F.count("*").over(Window.partitionBy("g", "x")))
    near = each.groupBy("g", "c").agg(F.sum(F.when(F.col("df") * 2 > F.col("n"), 1).otherwise(-1)).alias("near"))
    named = near.groupBy("g").agg(F.max(F.struct("near", "c"))["c"].alias("q"))
    return groups.join(named, "g").select("g", F.col("q").alias("p"), "c", "known")


def differences(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(g, p, c, known) and (c, els) to (g, c, known, k, m, e): the size of the group's core, and what a member lacks of it and adds to it.

    Members are told by their differences from one of them, p, first; what more than half of the members lack of p or add to it then changes sides.
    Only differences are counted, never whole sets.
    """
    # two joins of a small table with the sets, so that these needn't be shuffled for a few groups
    firsts = cut(groups.select(F.col("p").alias("c")).distinct().join(sets, "c").select(F.col("c").alias("p"), F.col("els").alias("of_p")))
    both = groups.join(sets, "c").join(firsts, "p")
    return turned(cut(both.select("g", "c", "known", F.size("of_p").alias("k"), F.array_except("of_p", "els").alias("m"), F.array_except("els", "of_p").alias("e"))))


def turned(near: DataFrame) -> DataFrame:
    """(g, c, known, k, m, e), the differences from any set of k shingles, to those from the group's core."""
    n = near.groupBy("g").agg(F.count("*").alias("n"))
    each = near.join(n, "g").select("g", "n", F.explode(F.concat(F.transform("m", lambda x: F.struct(x.alias("x"), F.lit(True).alias("lack"))), F.transform("e", lambda x: F.struct(x.alias("x"), F.lit(False).alias("lack"))))).alias("d"))
    most = each.groupBy("g", "n", "d.x", "d.lack").agg(F.count("*").alias("df")).where("2 * df > n")
    turn = most.groupBy("g").agg(F.collect_list(F.when(F.col("lack"), F.col("x"))).alias("out"), F.collect_list(F.when(~F.col("lack"), F.col("x"))).alias("new"))
    out, new = (F.coalesce(x, F.array().cast("array<long>")) for x in ("out", "new"))
    return near.join(turn, "g", "left").select(
        "g", "c", "known", (F.col("k") - F.size(out) + F.size(new)).alias("k"),
        F.concat(F.array_except("m", out), F.array_except(new, F.col("e"))).alias("m"), F.concat(F.array_except("e", new), F.array_except(out, F.col("m"))).alias("e"))


def compared(told: DataFrame, percent: int) -> DataFrame:
    """Members with the group's first one (smallest w): adds c0, known0, w, w0, t, and linked, the exact Jaccard test."""
    told = told.withColumn("w", F.size("m") * F.lit(100).cast("long") + F.size("e") * F.lit(percent).cast("long"))
    first = told.groupBy("g").agg(F.min(F.struct("w", "c")).alias("f")).select("g", F.col("f.c").alias("c0"))
    first = told.join(first, "g").where("c = c0").select("g", "c0", F.col("known").alias("known0"), F.col("w").alias("w0"), F.col("m").alias("m0"), F.col("e").alias("e0"))
    both = F.col("k") - F.size("m") - F.size("m0") + F.size(F.array_intersect("m", "m0")) + F.size(F.array_intersect("e", "e0"))
    total = 2 * F.col("k") - F.size("m") + F.size("e") - F.size("m0") + F.size("e0")
    return told.join(first, "g").select("g", "c", "c0", "known", "known0", "k", "w", "w0", (F.col("k") * F.lit(100 - percent).cast("long")).alias("t"), "m", "e",
                                        (F.lit(100 + percent) * both >= F.lit(percent) * total).alias("linked"))


def next_groups(seen: DataFrame, percent: int) -> DataFrame:
    """The open pairs of compared() as smaller groups (g, c, known, k, m, e), told by their differences from the core before: what is left of a group, if that is half of it at most, else lists of differences that
    two members share, one of them not linked to the first."""
    met = F.col("linked") | (F.col("known") == F.col("known0"))
    each = seen.where("c <> c0").select("g", "c", F.when(met, F.col("known0")).otherwise(F.col("known")).alias("known"), met.alias("met"), "w", "w0", "t", F.explode(F.concat("m", "e")).alias("x"))
    of_x = Window.partitionBy("g", "x")
    each = each.withColumns({"df": F.count("*").over(of_x), "open": F.min("met").over(of_x), "lo": F.min("known").over(of_x), "hi": F.max("known").over(of_x)}).where("lo < hi and not open")
    own = each.groupBy("g", "c", "known", "met", "w", "w0", "t").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("v"))
    over = lambda a, b: F.ceil(a / F.lit(float(b)) - F.lit(1e-9)).cast("long")
    # the least number of shared differences that any partner asks for. A partner B of an open A has w(B) >= percent / 100 * (w(A) - T), since it can't share more than it has
    least = F.greatest(F.lit(1), F.when(F.col("met"), F.lit(1)).otherwise(F.greatest(over(F.col("w") - F.col("t"), 100), over(F.col("w") + F.col("w0") - F.col("t"), 100 + percent))))
    own = cut(own.withColumn("s", least).where(F.size("v") >= F.col("s")))
    # with what is left in the group, once more: partners of those that are met are open
    low = own.groupBy("g").agg(F.min("w").alias("any"), F.min(F.when(~F.col("met"), F.col("w"))).alias("open"))
    own = own.join(low, "g").where("open is not null")
    own = own.withColumn("s", F.greatest("s", over(F.col("w") + F.when(F.col("met"), F.col("open")).otherwise(F.col("any")) - F.col("t"), 100 + percent)))
    own = cut(own.where(F.size("v") >= F.col("s")))
    half = own.groupBy("g").agg(F.count("*").alias("left")).join(seen.groupBy("g").agg(F.count("*").alias("n")), "g").where("2 * left <= n").select("g")
    rest = own.join(half, "g").select("g", F.col("g").alias("of"), "c", "known")
    lists = own.join(half, "g", "left_anti").select("g", "c", "known", "met", "w", "t", F.size("v").alias("has"), F.posexplode(F.slice("v", F.lit(1), (F.size("v") - F.col("s") + 1).cast("int"))).alias("i", "y"))
    # a pair is that of its first common list, so all that it shares comes from there on
    lists = cut(lists.select(F.xxhash64("g", "y.x").alias("g"), F.col("g").alias("of"), "c", "known", "met", "w", "t", (F.col("has") - F.col("i")).alias("has")))
    # the same bounds with the partners that a list has, which are far fewer than a group's
    for _ in range(3):
        low = lists.groupBy("g").agg(F.min("w").alias("any"), F.min(F.when(~F.col("met"), F.col("w"))).alias("open"), F.min("known").alias("lo"), F.max("known").alias("hi"))
        lists = lists.join(low.where("lo < hi and open is not null"), "g")
        asked = over(F.col("w") + F.when(F.col("met"), F.col("open")).otherwise(F.col("any")) - F.col("t"), 100 + percent)
        lists = lists.where(F.col("has") >= asked).drop("any", "open", "lo", "hi")
    out = cut(lists.select("g", "of", "c", "known").unionByName(rest))
    still = out.groupBy("g").agg(F.min("known").alias("lo"), F.max("known").alias("hi")).where("lo < hi").select("g")
    return out.join(still, "g").join(seen.select(F.col("g").alias("of"), "c", "k", "m", "e"), ["of", "c"]).select("g", "c", "known", "k", "m", "e")


def at_home(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of each class with the named member p of the largest group that it stands in: exact Jaccard, one comparison a class."""
    n = groups.groupBy("g").agg(F.count("*").alias("n"))
    home = groups.join(n, "g").groupBy("c").agg(F.max(F.struct("n", "p"))["p"].alias("p")).where("c <> p")
    return linked_pairs(home.select(F.col("p").alias("a"), F.col("c").alias("b")), sets, percent)


def unsettled(groups: DataFrame, known: DataFrame) -> DataFrame:
    """groups with the component labels (node, comp) that are known by now; those of one component need no more work."""
    groups = groups.drop("known").join(known, F.col("c") == F.col("node"), "left").select("g", "p", "c", F.coalesce("comp", "c").alias("known"))
    several = groups.groupBy("g").agg(F.min("known").alias("lo"), F.max("known").alias("hi")).where("lo < hi").select("g")
    return groups.join(several, "g")


def close_pairs(groups: DataFrame, lows: DataFrame, percent: int, retain: int) -> DataFrame:
    """The pairs (a, b) of groups (g, c, known) that aren't in one component and whose sketches (c, low) don't rule a link out."""
    one = groups.select("g", F.col("c").alias("a"), F.col("known").alias("ka"))
    pairs = one.join(groups.select("g", F.col("c").alias("b"), F.col("known").alias("kb")), "g").where("a < b and ka <> kb").select("a", "b").distinct()
    both = pairs.join(lows.select(F.col("c").alias("a"), F.col("low").alias("x")), "a").join(lows.select(F.col("c").alias("b"), F.col("low").alias("y")), "b")
    return both.where(~too_far("x", "y", percent, retain)).select("a", "b")


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked: exact Jaccard."""
    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("els").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("els").alias("y")), "b")
    return both.where(F.lit(100 + percent) * F.size(F.array_intersect("x", "y")) >= F.lit(percent) * (F.size("x") + F.size("y"))).select("a", "b")


def links(groups: DataFrame, sets: DataFrame, lows: DataFrame, percent: int, retain: int) -> list[DataFrame]:
    """Links (a, b) of groups (g, p, c, known), one table a round and one of the pairs in small groups; their components are those of all links."""
    found, pairs, groups = [], [], cut(groups)
    while not groups.isEmpty():
        sizes = groups.groupBy("g").agg(F.count("*").alias("n"))
        pairs.append(cut(close_pairs(groups.join(sizes.where(F.col("n") <= FEW).select("g"), "g"), lows, percent, retain)))
        many = cut(groups.join(sizes.where(F.col("n") > FEW).select("g"), "g"))
        if many.isEmpty():
            break
        # each is used several times
        told = cut(turned(many) if found else differences(cut(central(many, lows)), sets))
        seen = cut(compared(told, percent))
        found.append(seen.where("linked and c <> c0").select(F.col("c0").alias("a"), F.col("c").alias("b")))
        groups = cut(next_groups(seen, percent))
    return found + ([cut(linked_pairs(cut(reduce(DataFrame.union, pairs).distinct()), sets, percent))] if pairs else [])


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, retain: int = RETAIN) -> DataFrame:
    """docs with doc_id and text to (doc_id, n_shingles, component_id)."""
    ship(docs.sparkSession)
    ids = docs.select(F.col("doc_id").alias("id"), "text")
    rows = cut(ids.mapInArrow(_sketch(k, retain), "id long, n long, f1 long, f2 long, low array<long>"))
    # a class of equal sets: any of its sketches, and its smallest id; c numbers the classes, in a table that is written once
    full = rows.where("id is not null and n > 0")
    reps = cut(full.groupBy("n", "f1", "f2").agg(F.min("id").alias("sid"), F.first("low").alias("low")).withColumn("c", F.monotonically_increasing_id()))
    named = cut(full.select("id", "n", "f1", "f2").join(reps.select("n", "f1", "f2", "sid", "c"), ["n", "f1", "f2"]).select("id", "c").distinct())
    versions = named.groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("z")).where("a < z")
    edges = [named.join(versions, "id").where("c <> a").select("a", F.col("c").alias("b"))]

    lists = inverted_lists(reps, percent, retain)
    members = reps.join(lists.select("c").distinct(), "c", "left_semi")
    want = members.groupBy("sid").agg(F.collect_list(F.struct("f1", "c")).alias("want"))
    sets = cut(packed(ids.where("id is not null")).join(want, F.col("id") == F.col("sid")).select("z", "want").mapInArrow(_sets(k), "c long, els array<long>").dropDuplicates(["c"]))
    lows = cut(members.select("c", "low"))
    groups = cut(first_groups(lists, lows, percent, retain))
    near = cut(at_home(groups, sets, percent))
    edges += [near, *links(unsettled(groups, components(near)), sets, lows, percent, retain)]
    comps = components(reduce(DataFrame.union, edges))
    own = reps.select("n", "f1", "f2", "sid", "c").join(comps, F.col("c") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "c"))
    label = own.groupBy("comp").agg(F.min("sid").alias("component"))
    out = rows.select("id", "n", "f1", "f2").join(own.join(label, "comp").select("n", "f1", "f2", "component"), ["n", "f1", "f2"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
