"""Live feeds as keyed state: a row for each key of a feed, kept, carried forward, expired or dropped as snapshots arrive.

A feed is polled, and each poll publishes a whole snapshot: a row for each key, and a header that says whether the feed was good. The state
is dealt by feed and a hash of the key into a fixed number of buckets, so a large feed is no single group; headers go to all buckets of their
feed. Two clocks: `generated` is the feed's own time, by which a row is newer than another and a snapshot replaces one; `pulled` is the time
of the poll, the event time of the stream, by which rows expire. So a feed that is behind the others loses nothing to the watermark.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GOOD, FAILED = "ok", "failed"
#: What a change means: a key that wasn't there, one with a newer row, one whose feed has failed since, one that a good snapshot no longer has, one past its end.
NEW, RENEWED, CARRIED, DROPPED, EXPIRED = "new", "renewed", "carried", "dropped", "expired"


#: Parts that the rows of a bucket are read and written in, by the hash of their keys: a call of the state store for each key takes longer than all else.
PARTS = 256


class LiveKeys(StatefulProcessor):
    """The rows of one bucket of a feed. Payload: names of further columns, kept as they are."""

    def __init__(self, payload: T.StructType):
        self.payload = payload

    def init(self, handle: StatefulProcessorHandle) -> None:
        columns = [T.StructField("key", T.StringType()), T.StructField("generated", T.LongType()), T.StructField("ends", T.LongType()), *self.payload.fields]  # microseconds
        self.handle = handle
        self.parts = handle.getMapState("rows", T.StructType([T.StructField("part", T.IntegerType())]), T.StructType([T.StructField("rows", T.ArrayType(T.StructType(columns)))]))
        self.feed = handle.getValueState("feed", T.StructType([T.StructField("good", T.LongType()), T.StructField("failed", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[Any], timerValues: Any) -> Iterator[tuple]:
        """Net changes: of several rows of a key the newest counts (of one time, that with the greatest payload), of several headers the newest good and failed ones."""
        seen = self.feed.exists()  # a bucket that has had no polls has no rows
        good, failed = self.feed.get() if seen else (None, None)
        before, was_carried, newest = good, failed is not None and (good is None or failed > good), {}
        for r in rows:
            if r["key"] is None:
                if r["status"] == GOOD and (good is None or r["generated"] > good):
                    good = r["generated"]
                elif r["status"] == FAILED and (failed is None or r["generated"] > failed):
                    failed = r["generated"]
            else:
                value = (r["generated"], r["ends"], *(r[n] for n in self.payload.names))
                if r["key"] not in newest or self.later(value, newest[r["key"]]):
                    newest[r["key"]] = value
        carried = failed is not None and (good is None or failed > good)
        self.feed.update((good, failed))
        now = timerValues.getCurrentWatermarkInMs()
        turned = good != before or carried != was_carried
        # a header concerns all rows, other rows only the parts of their keys
        held = {} if not seen else self.held() if turned else self.held({self.part(k) for k in newest})
        changed, gone = set(), set()
        for k, value in newest.items():
            known = held.get(k)
            if good is not None and value[0] < good or known is not None and not self.later(value, known) or known is None and self.past(value, now):
                continue
            changed.add(k)
            held[k] = value
            if self.past(value, now):
                gone.add(k)
                yield self.change(key, k, EXPIRED, carried, value)
            else:
                yield self.change(key, k, NEW if known is None else RENEWED, carried, value)
        if turned:
            for k, value in held.items():
                if k in changed:
                    continue
                if self.past(value, now) or good is not None and value[0] < good:
                    gone.add(k)
                    yield self.change(key, k, EXPIRED if self.past(value, now) else DROPPED, carried, value)
                elif carried != was_carried:
                    yield self.change(key, k, CARRIED if carried else RENEWED, carried, value)
        self.keep(held, changed | gone, gone)
        self.remind((held[k][1] for k in changed - gone), list(self.handle.listTimers()))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[tuple]:
        """All rows whose end has passed go, in one pass; the timer of the first of the others is the bucket's next."""
        now, held = timerValues.getCurrentWatermarkInMs(), self.held()
        gone = {k for k, value in held.items() if self.past(value, now)}
        for k in gone:
            yield self.change(key, k, EXPIRED, False, held[k])
        self.keep(held, gone, gone)
        self.remind((value[1] for k, value in held.items() if k not in gone), [])

    @staticmethod
    def part(key: str) -> int:
        return zlib.crc32(key.encode()) % PARTS

    def held(self, parts: Iterable[int] | None = None) -> dict[str, tuple]:
        """The rows of these parts, or of all, by key."""
        if parts is None:
            found = (value for _, value in self.parts.iterator())
        else:
            found = (self.parts.getValue((p,)) for p in parts if self.parts.containsKey((p,)))
        return {r[0]: tuple(r[1:]) for (rows,) in found for r in rows}

    def keep(self, held: dict[str, tuple], changed: set[str], gone: set[str]) -> None:
        """Writes the parts of the keys that changed."""
        parts = {self.part(k): [] for k in changed}
        for k, value in held.items():
            if k not in gone and (rows := parts.get(self.part(k))) is not None:
                rows.append((k, *value))
        for p, rows in parts.items():
            if rows:
                self.parts.updateValue((p,), (rows,))
            elif self.parts.containsKey((p,)):
                self.parts.removeKey((p,))

    def remind(self, ends: Iterable[int | None], timers: Sequence[int]) -> None:
        """Keeps one timer for a bucket, for the first end of its rows: with one for each row, a bucket's rows would be read as often as there are timers."""
        first = min((e // 1000 for e in ends if e is not None), default=None)
        if first is not None and all(first < t for t in timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(first)

    def close(self) -> None:
        pass

    @staticmethod
    def past(value: tuple, now: int) -> bool:
        return value[1] is not None and value[1] // 1000 <= now

    @staticmethod
    def later(value: tuple, than: tuple) -> bool:
        order = lambda v: (v[0], [(x is not None, x) for x in (*v[2:], v[1])])
        return order(tuple(value)) > order(tuple(than))

    def change(self, group: Any, key: str, what: str, carried: bool, value: Sequence) -> tuple:
        return T.Row("feed", "key", "change", "carried", "generated", "ends", *self.payload.names)(group[0], key, what, carried, *value)


#: Rows that a task gathers before it leaves out those that can't count.
GATHERED = 500_000
_PLAIN = (T.BooleanType, T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _groups(rows: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """A number for each row, the same for those that are the same in these columns."""
    group = np.zeros(len(rows), np.int64)
    for c in columns:
        own = rows[c].combine_chunks().dictionary_encode()
        group = group * (len(own.dictionary) + 1) + np.asarray(own.indices.fill_null(len(own.dictionary)))
        group = np.unique(group, return_inverse=True)[1]
    return group


def _frontier(rows: pa.Table, within: Sequence[str], order: list[str]) -> pa.Table:
    """The rows that no other of their feed (or what `within` names), key and status beats, by being as late or later in this order and pulled at the same time or after it."""
    group = _groups(rows, (*within, "key", "status"))
    table = rows.append_column("_group", pa.array(group))
    keys = [("_group", "ascending"), *((c, "descending") for c in order), ("pulled", "descending")]
    at = np.asarray(pc.sort_indices(table, sort_keys=keys, null_placement="at_end"))
    group, pulled = group[at], np.asarray(rows["pulled"].combine_chunks().cast(pa.int64()).fill_null(np.iinfo(np.int64).min))[at]
    # the greatest time so far within the group: groups lie one after the other, so ranks of times with the group's number before them only grow from group to group
    rank = np.unique(pulled, return_inverse=True)[1] + group * (len(pulled) + 1)
    before = np.concatenate(([-1], np.maximum.accumulate(rank)[:-1])) if len(rank) else rank
    first = np.concatenate(([True], group[1:] != group[:-1])) if len(rank) else np.zeros(0, bool)
    return rows.take(pa.array(np.sort(at[first | (rank > before)])))


def _superseded(rows: pa.Table, within: Sequence[str]) -> np.ndarray:
    """Whether a row is older than a good snapshot of its feed whose header was pulled at the same time or after it."""
    feed = _groups(rows, within)
    generated, pulled = (np.asarray(rows[c].combine_chunks().cast(pa.int64()).fill_null(np.iinfo(np.int64).min)) for c in ("generated", "pulled"))
    keyed = np.asarray(rows["key"].combine_chunks().is_valid())
    good = np.flatnonzero(~keyed & np.asarray(pc.equal(rows["status"], GOOD).combine_chunks().fill_null(False)))
    if not len(good):
        return np.zeros(len(rows), bool)
    times, rank = np.unique(pulled, return_inverse=True)
    at = feed * len(times) + rank
    good = good[np.argsort(at[good], kind="stable")]
    # of each feed, the newest time of headers that were pulled at a time or after it: from the last to the first, ranks of times with the feed's number before them
    news, newness = np.unique(generated[good], return_inverse=True)
    newest = np.maximum.accumulate(((feed[good].max() - feed[good]) * len(news) + newness)[::-1])[::-1] % len(news)
    next_ = np.minimum(np.searchsorted(at[good], at), len(good) - 1)
    return keyed & (at[good][next_] >= at) & (feed[good][next_] == feed) & (generated < news[newest[next_]])


def _blank(rows: pa.Table, columns: Sequence[str]) -> pa.Table:
    for c in columns:
        at = rows.column_names.index(c)
        rows = rows.set_column(at, rows.schema.field(at), pa.nulls(len(rows), rows.schema.field(at).type))
    return rows


def _plain(polls: DataFrame, payload: Sequence[str]) -> bool:
    return all(isinstance(polls.schema[c].dataType, _PLAIN) for c in payload)


def needed(polls: DataFrame, payload: Sequence[str], snapshots: bool = False, within: Sequence[str] = ("feed",)) -> DataFrame:
    """The polls without rows and headers that can't count, whatever the watermark: a row for whose key the same task has a later one (as LiveKeys orders them)
    that was pulled no earlier, and a header with such a one of its status; with `snapshots` also a row that is older than a good header of its feed in the same
    task that was pulled no earlier. A row with a status comes out as a row and a header. So what reaches the state, row by row, is in proportion to keys, or to the last good snapshots, and not to polls. A
    payload that has columns other than plain ones is left as it is."""
    if not _plain(polls, payload):
        return polls
    order = ["generated", *payload, "ends"]
    same = [c for c in polls.columns if c != "pulled"]

    def left(gathered: list[pa.RecordBatch]) -> tuple[pa.Table, pa.Table]:
        polls = pa.Table.from_batches(gathered)
        keyed = pc.is_valid(polls["key"])
        rows, headers = _blank(polls.filter(keyed), ["status"]), polls.filter(pc.invert(keyed))
        headers = pa.concat_tables([headers, _blank(polls.filter(pc.and_(keyed, pc.is_valid(polls["status"]))), ["key", "ends", *payload])])
        # a snapshot's polls say the same of it over and over
        headers = headers.group_by(same).aggregate([("pulled", "max")]).rename_columns([*same, "pulled"]).select(rows.column_names).cast(rows.schema)
        headers = _frontier(headers, within, order)
        return headers, _frontier(current(headers, rows), within, order)

    def current(headers: pa.Table, rows: pa.Table) -> pa.Table:
        return rows.filter(pa.array(~_superseded(pa.concat_tables([headers, rows]), within)[len(headers) :])) if snapshots else rows

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, aside = [], 0, None
        with tempfile.TemporaryFile() as file:
            for batch in batches:
                held.append(pa.RecordBatch.from_arrays(batch.columns, schema=pa.schema([f.with_nullable(True) for f in batch.schema])))
                size += batch.num_rows
                if size >= GATHERED:
                    headers, rows = left(held)
                    if 2 * len(rows) > GATHERED:  # mostly different keys: they wait in a file, as a header that is still to come can be newer
                        aside = aside or pa.ipc.new_stream(file, rows.schema)
                        aside.write_table(rows)
                        rows = rows.slice(0, 0)
                    held = [b for t in (headers, rows) for b in t.combine_chunks().to_batches()]
                    size = sum(b.num_rows for b in held)
                    if 2 * size > GATHERED:  # mostly different headers
                        yield from held
                        held, size = [], 0
            if held:
                headers, rows = left(held)
                yield from (b for t in (headers, rows) for b in t.combine_chunks().to_batches())
            if aside:
                aside.close()
                file.seek(0)
                for batch in pa.ipc.open_stream(file):
                    yield from current(headers, pa.Table.from_batches([batch])).to_batches()

    return polls.mapInArrow(kept, T.StructType([T.StructField(f.name, f.dataType) for f in polls.schema.fields]))


def live_changes(polls: DataFrame, payload: Sequence[str], buckets: int = 16) -> DataFrame:
    """The changes of live rows, from a stream of polls.

    polls: feed, key (string; null in a header), generated and pulled (timestamps), ends (timestamp or null), status (of a header: ok or failed; a row
    with one is its snapshot's header too), and the payload's columns. Returns feed, key, change, carried (whether the feed has failed since its last good snapshot), generated, ends and
    the payload. Before polls are dealt to buckets, a task leaves out those of its own that can't count (`needed`), and once more when they are dealt. A row that isn't newer than its key's is ignored, as is one older than the last good snapshot or past its end. A key that a newer
    good snapshot doesn't have goes; while the feed fails its keys stay. State holds the live rows, in `PARTS` parts of a bucket that are
    written whole when a key of theirs changes, and two times for each bucket.
    """
    kinds = T.StructType([polls.schema[c] for c in payload])
    places = F.when(F.col("key").isNull(), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")))
    own = polls.select("feed", "key", F.unix_micros("generated").alias("generated"), "pulled", F.unix_micros("ends").alias("ends"), "status", *payload)
    without = lambda *names: F.struct(*(F.lit(None).cast(own.schema[c].dataType).alias(c) if c in names else F.col(c) for c in own.columns))
    apart = F.when(F.col("key").isNotNull() & F.col("status").isNotNull(), F.array(without("key", "ends", *payload), without("status"))).otherwise(F.array(without()))
    dealt = needed(own, payload, snapshots=True).select(F.inline(apart)).withColumn("bucket", F.explode(places))
    if _plain(own, payload):  # what one task has can be of no account by what another has
        dealt = needed(dealt.repartition("feed", "bucket"), payload, snapshots=True, within=("feed", "bucket"))
    dealt = dealt.withWatermark("pulled", "0 seconds")
    fields = [("feed", T.StringType()), ("key", T.StringType()), ("change", T.StringType()), ("carried", T.BooleanType()), ("generated", T.LongType()), ("ends", T.LongType())]
    output = T.StructType([*(T.StructField(n, t) for n, t in fields), *kinds.fields])
    changes = dealt.groupBy("feed", "bucket").transformWithState(statefulProcessor=LiveKeys(kinds), outputStructType=output, outputMode="Update", timeMode="eventTime")
    return changes.withColumns({c: F.timestamp_micros(c) for c in ("generated", "ends")})


def run_live(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the changes of each batch under `path` until all polls that are there are taken. A batch that is run again replaces its own."""
    spark = changes.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def live_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that are live after all changes: the last change of each key, unless it went. A key changes once in a batch at most."""
    changes = spark.read.parquet(path)
    rest = [c for c in changes.columns if c not in ("feed", "key", "epoch")]
    last = changes.groupBy("feed", "key").agg(F.max_by(F.struct(*rest), "epoch").alias("last")).select("feed", "key", "last.*")
    return last.where(~F.col("change").isin(DROPPED, EXPIRED)).drop("change")
