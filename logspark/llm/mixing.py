"""Mixing sources to target weights by pivotal dependent rounding (operator 8, DataFrame functions only).

Each source has a target number of words. Every document of a source is to be taken c = target / source size times; the
whole part of c is certain, the fraction is a copy probability. Two documents at a time meet: probability mass, counted in
words, moves from one to the other, in a random direction that leaves both expectations as they were, until one of them
has probability 0 or 1. The other one goes on to the next meeting. Inside a bucket of about FAN documents this is a fold over
an array; what a bucket leaves over meets in the buckets of the next level, so a source of n documents takes about
log(n) / log(FAN) levels, whatever its share of the rows. The words of a source are constant through all meetings, hence the
taken words differ from the target by one document's words at most. Heavy documents meet first, among themselves; what their
rounding took too much or too little is moved to or from all light documents of the source alike, in a last pairing of the
heavy ones with the rest. So the remaining difference is one light document's words.

Cases: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own, last in order; rows that
repeat a doc_id are separate documents; a source of size 0 has target 0; an empty table gives an empty result. Only doc_id,
text and source are read, under own names, so other columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table

#: Documents in a bucket of the reduction tree, on average.
FAN = 24
#: A document with more than so many times its source's mean size is heavy.
HEAVY = 4.0


def word_count(text: Column) -> Column:
    """Words of a text: where a word byte follows a space or the start. Null: 0."""
    squeezed = F.regexp_replace(text, WORD, "a")
    return F.coalesce(F.length(F.translate(squeezed, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(src, source_size) to (src, source_size, target): shares by weight, none above cap times its size, the excess reshared by weight.

    The table has a row for each source, ordered in one small window; a round of resharing is one aggregate over it.
    """
    order = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last()))
    picks = F.array(*[F.lit(float(w)) for w in weights])
    s = cut(sizes.withColumn("w", F.element_at(picks, ((order - 1) % len(weights) + 1).cast("int"))))
    full = F.col("source_size") * F.lit(cap)
    level = 0.0
    while True:  # level: words for each unit of weight; it only rises, and each round caps one source more at least
        high = F.lit(level) * F.col("w") > full
        total, capped, weight = s.agg(F.sum("source_size"), F.sum(F.when(high, full)), F.sum(F.when(~high, F.col("w")))).first()
        if not weight:
            break
        new = (float(total or 0) - float(capped or 0.0)) / weight
        if new <= level * (1 + 1e-15):
            break
        level = new
    return s.withColumn("target", F.least(full, F.lit(level) * F.col("w")))


def _uniform(seed: int, *cols: Column) -> Column:
    return (F.xxhash64(*cols, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) + F.lit(0.5)) / F.lit(float(1 << 53))


def _meet(state: Column, x: Column, seed: int) -> Column:
    """One document joins the open one: the state is (open, done); who becomes integral is done."""
    o = state["open"]
    room_o, room_x = (F.lit(1.0) - o["p"]) * o["size"], (F.lit(1.0) - x["p"]) * x["size"]
    have_o, have_x = o["p"] * o["size"], x["p"] * x["size"]
    up, down = F.least(room_o, have_x), F.least(have_o, room_x)  # words that could move to the open one, or away from it
    rise = _uniform(seed, o["id"], o["tie"], x["id"], x["tie"]) * (up + down) < down
    o_p = F.when(rise, F.when(room_o <= have_x, F.lit(1.0)).otherwise(o["p"] + up / o["size"])).otherwise(
        F.when(have_o <= room_x, F.lit(0.0)).otherwise(o["p"] - down / o["size"]))
    x_p = F.when(rise, F.when(have_x <= room_o, F.lit(0.0)).otherwise(x["p"] - up / x["size"])).otherwise(
        F.when(room_x <= have_o, F.lit(1.0)).otherwise(x["p"] + down / x["size"]))
    item = lambda d, p: F.struct(d["id"].alias("id"), d["tie"].alias("tie"), d["size"].alias("size"), p.alias("p"))
    o_done = (o_p <= 0.0) | (o_p >= 1.0)
    met = F.struct(
        F.when(o_done, item(x, x_p)).otherwise(item(o, o_p)).alias("open"),
        F.concat(state["done"], F.array(F.when(o_done, item(o, o_p)).otherwise(item(x, x_p)))).alias("done"),
    )
    return F.when(o.isNull(), F.struct(x.alias("open"), state["done"].alias("done"))).otherwise(met)


def _level(items: DataFrame, seed: int) -> DataFrame:
    """(src, bucket, id, tie, size, p) to (src, open, done): a fold of each bucket, in an order that reruns repeat."""
    one = F.struct("id", "tie", "size", "p")
    kind = "struct<id:bigint,tie:bigint,size:double,p:double>"
    start = F.struct(F.lit(None).cast(kind).alias("open"), F.array().cast(f"array<{kind}>").alias("done"))
    folded = F.aggregate(F.sort_array(F.collect_list(one)), start, lambda s, x: _meet(s, x, seed))
    return items.groupBy("src", "bucket").agg(folded.alias("f")).select("src", "bucket", "f.open", "f.done")


def pivotal_round(items: DataFrame, seed: int = 17, fan: int = FAN) -> DataFrame:
    """(src, id, tie, size double, p double in [0, 1)) to (src, id, tie, size, up): whether each item is rounded up.

    The sum of size * p by src is kept but for the last item of each src. Buckets are dealt by hash, so any src is spread over
    count / fan of them.
    """
    items = cut(items)
    out = items.where("p <= 0 or size <= 0").select("src", "id", "tie", "size", F.lit(False).alias("up"))
    open_ = items.where("p > 0 and size > 0")
    level = 0
    while True:
        counts = open_.groupBy("src").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if not most:
            return out
        last = most <= fan * 2
        if last:
            dealt = open_.withColumn("bucket", F.lit(0).cast("long"))
        else:
            buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / fan))
            counts = counts.withColumnRenamed("src", "s")
            dealt = open_.join(counts, open_["src"].eqNullSafe(F.col("s"))).select(
                open_["*"], F.pmod(F.xxhash64("id", "tie", F.lit(seed + level)), buckets).alias("bucket"))
        folded = cut(_level(dealt, seed + level))
        done = folded.select("src", F.explode("done").alias("d"))
        rest = folded.where("open is not null")
        if last:
            up = _uniform(seed - 1, F.col("open.id"), F.col("open.tie")) < F.col("open.p")
            done = done.union(rest.select("src", F.struct("open.id", "open.tie", "open.size", F.when(up, 1.0).otherwise(0.0).alias("p"))))
        out = out.union(done.select("src", "d.id", "d.tie", "d.size", F.col("d.p") >= 1.0))
        if last:
            return out
        open_, level = rest.select("src", "open.*"), level + 1


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(doc_id, source, tie, size, source_size, target, copies, taken) for every row of docs; tie is a hash of the text."""
    sized = cut(docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("src"), word_count(F.col("text")).alias("words"),
        F.xxhash64("text", F.lit(seed)).alias("tie")))
    sizes = sized.groupBy("src").agg(F.sum("words").alias("source_size"), F.avg("words").alias("mean"))
    goals = source_targets(sizes, weights, cap).withColumn(
        "c", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    goals = cut(goals.select(F.col("src").alias("s"), "source_size", "target", "mean", F.floor(F.col("c") + F.lit(1e-12)).cast("long").alias("whole"), "c"))
    p = F.greatest(F.lit(0.0), F.col("c") - F.col("whole"))
    items = cut(sized.join(goals, F.col("src").eqNullSafe(F.col("s"))).select("src", "id", "tie", F.col("words").cast("double").alias("size"), p.alias("p"), "mean"))
    heavy = F.col("size") > F.col("mean") * HEAVY
    big = cut(pivotal_round(items.where(heavy).drop("mean"), seed))
    owed = big.groupBy("src").agg(F.sum(F.col("up").cast("double") * F.col("size")).alias("got"))
    due = items.groupBy("src").agg(
        F.sum(F.when(heavy, F.col("p") * F.col("size")).otherwise(0.0)).alias("want"), F.sum(F.when(heavy, 0.0).otherwise(F.col("size"))).alias("room"))
    due = due.withColumnRenamed("src", "d").join(owed.withColumnRenamed("src", "o"), F.col("d").eqNullSafe(F.col("o")), "left")
    due = due.select("d", F.coalesce((F.col("got") - F.col("want")) / F.nullif("room", F.lit(0.0)), F.lit(0.0)).alias("shift"))
    # below 0 or above 1 by rounding only, or where the light documents can't make up for a heavy one
    moved = F.when(F.col("p") > 0, F.least(F.lit(1.0 - 1e-12), F.greatest(F.lit(0.0), F.col("p") - F.col("shift")))).otherwise(F.col("p"))
    light = items.where(~heavy).join(due, F.col("src").eqNullSafe(F.col("d"))).select("src", "id", "tie", "size", moved.alias("p"))
    copies = F.col("whole") + F.col("up").cast("long")
    size = F.col("size").cast("long")
    return big.union(pivotal_round(light, seed)).join(goals, F.col("src").eqNullSafe(F.col("s"))).select(
        F.col("id").alias("doc_id"), F.col("src").alias("source"), "tie", size.alias("size"), "source_size", "target",
        copies.alias("copies"), (copies * size).alias("taken"))


def mixed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs. Rows equal in id, text and source share a count."""
    got = mix(docs, seed).where("copies > 0").groupBy("doc_id", "source", "tie").agg(F.max("copies").alias("copies"))
    got = got.select(*[F.col(c).alias(f"__mix_{c}") for c in got.columns])
    tie = F.xxhash64(docs["text"], F.lit(seed))
    joined = docs.join(got, docs["doc_id"].eqNullSafe(F.col("__mix_doc_id")) & docs["source"].eqNullSafe(F.col("__mix_source")) & (tie == F.col("__mix_tie")))
    return joined.withColumn("__mix_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))).select(*[docs[c] for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
