"""Live-tail frames, over tables and on streams.

A subscription has a ring of `ring` matched rows. Every `ms` milliseconds the oldest `size` of them leave as an events frame; rows that the ring can't hold push
out the oldest, which are counted. Where nothing is waiting, a stats frame leaves once a second, so that counters move on a quiet app, too. Frames carry the
counters since the frame before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Milliseconds of a frame, events of a frame, rows of a ring.
FRAME_MS, FRAME_ROWS, RING = 250, 200, 2000
LEVELS = 6


def step(waiting: int, arrived: int, size: int, ring: int) -> tuple[int, int, int]:
    """One tick of a ring: (rows dropped, rows sent, rows still waiting)."""
    dropped = max(0, waiting + arrived - ring)
    waiting += arrived - dropped
    sent = min(size, waiting)
    return dropped, sent, waiting - sent


# ---- tables

_TICKS = "sub_id string, session bigint, tick bigint, first bigint, sent int, dropped int"


def _ticks(size: int, ring: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot")
        sub, session = rows["sub_id"].iloc[0], rows["session"].iloc[0]
        slots, counts = rows["slot"].tolist(), rows["n"].tolist()
        out, at, head, waiting, tick = [], 0, 0, 0, slots[0]
        while at < len(slots) or waiting:
            arrived = 0
            if at < len(slots) and slots[at] == tick:
                arrived, at = counts[at], at + 1
            dropped, sent, waiting = step(waiting, arrived, size, ring)
            head += dropped
            if sent:
                out.append((sub, session, tick, head, sent, dropped))
            head += sent
            tick = tick + 1 if waiting or at == len(slots) else slots[at]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _TICKS.split(", ")])
    return run


def frames(matched: DataFrame, size: int = FRAME_ROWS, ring: int = RING, ms: int = FRAME_MS) -> DataFrame:
    """(sub_id, arrived, key) to rows of events frames: (sub_id, seq, at, key, dropped).

    The ring is followed on counts by (subscription, tick); rows meet their frame by their place in the order of arrival. A pause in which any ring runs empty
    starts a new session, and sessions are followed side by side.
    """
    m = matched.select("sub_id", "arrived", "key", F.floor(F.unix_micros("arrived") / F.lit(ms * 1000)).alias("slot"))
    counts = m.groupBy("sub_id", "slot").agg(F.count("*").alias("n"))
    order = Window.partitionBy("sub_id").orderBy("slot")
    pause = F.coalesce((F.col("slot") - F.lag("slot").over(order) > -(-ring // size)).cast("int"), F.lit(0))
    counts = counts.withColumn("pause", pause).withColumn("session", F.sum("pause").over(order))
    before = Window.partitionBy("sub_id", "session").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ticks = counts.select("sub_id", "session", "slot", "n").groupBy("sub_id", "session").applyInPandas(_ticks(size, ring), _TICKS)
    ticks = ticks.withColumn("seq", F.row_number().over(Window.partitionBy("sub_id").orderBy("tick")))
    sent = ticks.select("sub_id", "session", "seq", "dropped", F.timestamp_millis((F.col("tick") + 1) * ms).alias("at"), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("sent") - 1)).alias("place"))
    number = F.row_number().over(Window.partitionBy("sub_id", "slot").orderBy("arrived", "key"))
    rows = m.withColumn("number", number).join(counts.select("sub_id", "slot", "session", "base"), ["sub_id", "slot"]).select("sub_id", "session", "key", (F.col("base") + F.col("number") - 1).alias("place"))
    return sent.join(rows, ["sub_id", "session", "place"]).select("sub_id", "seq", "at", "key", "dropped")


# ---- streams

FRAME = "sub_id string, seq bigint, at timestamp, type string, keys array<bigint>, dropped int, total bigint, matched bigint, by_level array<bigint>"
_RATE = "total bigint, matched bigint, " + ", ".join(f"l{i} bigint" for i in range(LEVELS))


class FrameProcessor(StatefulProcessor):
    """The ring and the counters of a subscription in state, and a timer for its next tick.

    Rows wait in a list with the tick in which they arrived, counters in a map by tick, so a batch may hold the arrivals of many ticks, and the watermark may pass
    many ticks at once.
    """

    def __init__(self, size: int, ring: int, ms: int, live: bool):
        self.size, self.ring, self.ms, self.live = size, ring, ms, live
        self.every = max(1, 1000 // ms)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "slot bigint, key bigint")
        self.rates = handle.getMapState("rates", "slot bigint", _RATE)
        self.place = handle.getValueState("place", "tick bigint, seq bigint, carried int")

    def now(self, times) -> int:
        return times.getCurrentProcessingTimeInMs() if self.live else times.getCurrentWatermarkInMs()

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        start = int(initialState["since"].iloc[0].timestamp() * 1000) // self.ms
        self.place.update((start, 0, 0))
        self.handle.registerTimer((start + 1) * self.ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: list[tuple[int, int]] = []
        rates: dict[int, list[int]] = {}
        for part in rows:
            at = [self.now(timerValues) // self.ms] * len(part) if self.live else (part["arrived"].astype("datetime64[ms]").astype("int64") // self.ms).tolist()
            for slot, k, hit, level in zip(at, part["key"].tolist(), part["matched"].tolist(), part["level"].tolist(), strict=True):
                rate = rates.setdefault(slot, [0] * (LEVELS + 2))
                rate[0] += 1
                if hit:
                    rate[1] += 1
                    rate[2 + level] += 1
                    new.append((slot, k))
        first = min(rates)
        if not self.place.exists():
            self.place.update((first, 0, 0))
            self.handle.registerTimer((first + 1) * self.ms)
        tick, seq, carried = self.place.get()
        # what arrives for a tick that has passed counts in the next one
        for slot, rate in sorted(rates.items()):
            slot = max(slot, tick)
            old = self.rates.getValue((slot,)) if self.rates.containsKey((slot,)) else (0,) * (LEVELS + 2)
            self.rates.updateValue((slot,), tuple(a + b for a, b in zip(old, rate, strict=True)))
        if new:
            self.waiting.appendList([(max(slot, tick), k) for slot, k in sorted(new)])
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tick, seq, carried = self.place.get()
        last = self.now(timerValues) // self.ms  # ticks before this one have ended
        rows = sorted(self.waiting.get(), key=lambda r: r[0]) if self.waiting.exists() else []
        rates = {k[0]: v for k, v in self.rates.iterator()}
        ring, at, out = [], 0, []
        total, dropped = [0] * (LEVELS + 2), carried
        for slot in [s for s in rates if s < tick]:  # counters since the last frame
            total = [a + b for a, b in zip(total, rates.pop(slot), strict=True)]
            self.rates.removeKey((slot,))
        while tick < last:
            arrived = 0
            while at < len(rows) and rows[at][0] <= tick:
                ring.append(rows[at][1])
                at, arrived = at + 1, arrived + 1
            lost, sent, _ = step(len(ring) - arrived, arrived, self.size, self.ring)
            dropped += lost
            if tick in rates:
                total = [a + b for a, b in zip(total, rates.pop(tick), strict=True)]
                self.rates.removeKey((tick,))
            if sent or tick % self.every == self.every - 1:
                seq += 1
                out.append((key[0], seq, pd.Timestamp((tick + 1) * self.ms, unit="ms"), "events" if sent else "stats", ring[lost : lost + sent], dropped, total[0], total[1], total[2:]))
                total, dropped = [0] * (LEVELS + 2), 0
            ring = ring[lost + sent :]
            tick += 1
        self.waiting.clear()
        left = [(tick - 1, k) for k in ring] + [(r[0], r[1]) for r in rows[at:]]
        if left:
            self.waiting.put(left)
        if any(total):
            self.rates.updateValue((tick - 1,), tuple(total))
        self.place.update((tick, seq, dropped))
        self.handle.registerTimer((tick + 1) * self.ms)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FRAME.split(", ")])

    def close(self) -> None:
        pass


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_frames(tailed: DataFrame, subscriptions: DataFrame | None = None, size: int = FRAME_ROWS, ring: int = RING, ms: int = FRAME_MS, live: bool = True) -> DataFrame:
    """A stream of (sub_id, arrived, key, level, matched) to frames (FRAME), one row each.

    live: rows arrive when they are processed, and timers follow the clock. Otherwise `arrived`, which needs a watermark, is the clock: a replay gives the
    same frames as the table form. subscriptions (sub_id, since) have stats frames from that time on, before any event is there. The session must keep state in RocksDB.
    """
    spark = tailed.sparkSession
    if spark.conf.get(PROVIDER) != ROCKSDB:
        raise ValueError(f"frames on a stream need {PROVIDER} = {ROCKSDB}")
    initial = None if subscriptions is None else subscriptions.groupBy("sub_id")
    rows = tailed.select("sub_id", "arrived", "key", "level", "matched")
    return rows.groupBy("sub_id").transformWithStateInPandas(FrameProcessor(size, ring, ms, live), FRAME, "append", "ProcessingTime" if live else "EventTime", initialState=initial)
