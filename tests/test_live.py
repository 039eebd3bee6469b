"""Live feeds as keyed state."""

import datetime
import json
import os

from voltspan.streaming import live

SCHEMA = "feed string, key string, generated timestamp, pulled timestamp, ends timestamp, status string, note string"


def at(minutes):
    return None if minutes is None else (datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)).isoformat() + "Z"


def poll(folder, number, feed, generated, pulled, rows, status="ok"):
    lines = [{"feed": feed, "key": None, "generated": at(generated), "pulled": at(pulled), "status": status}]
    lines += [{"feed": feed, "key": k, "generated": at(generated), "pulled": at(pulled), "ends": at(ends), "note": note} for k, ends, note in rows]
    (file := folder / f"{number:03d}.json").write_text("".join(json.dumps(x) + "\n" for x in lines))
    os.utime(file, (1_700_000_000 + number, 1_700_000_000 + number))  # a stream takes files by their age


def test_rows_are_kept_carried_expired_and_dropped(spark, tmp_path):
    (folder := tmp_path / "polls").mkdir()
    poll(folder, 0, "fire", 0, 1, [("a", None, "a0"), ("b", 25, "b0"), ("c", None, "c0")])
    poll(folder, 1, "wind", -60, 2, [("a", 500, "w0")])  # an hour behind by its own clock
    poll(folder, 2, "fire", 10, 11, [("a", None, "a1"), ("b", 25, "b1"), ("d", 12, "d1")])  # c drops out
    poll(folder, 3, "fire", 5, 12, [("a", None, "old"), ("c", None, "old")])  # older: changes nothing
    poll(folder, 4, "fire", 20, 21, [], status="failed")  # a and b are carried, d has expired
    poll(folder, 5, "wind", -50, 30, [("a", 500, "w1"), ("z", 31, "w1")])  # b of fire expires
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    run = lambda: live.run_live(live.live_changes(stream(), ["note"], buckets=3), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    changes = [(r["feed"], r["key"], r["change"], r["note"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("epoch").collect()]
    assert sorted(changes) == sorted([
        ("fire", "a", "new", "a0"), ("fire", "b", "new", "b0"), ("fire", "c", "new", "c0"), ("wind", "a", "new", "w0"), ("fire", "a", "renewed", "a1"), ("fire", "b", "renewed", "b1"), ("fire", "d", "new", "d1"),
        ("fire", "c", "dropped", "c0"), ("fire", "d", "expired", "d1"), ("fire", "a", "carried", "a1"), ("fire", "b", "carried", "b1"), ("fire", "b", "expired", "b1"), ("wind", "a", "renewed", "w1"), ("wind", "z", "new", "w1"),
    ])
    rows = lambda: {(r["feed"], r["key"]): (r["note"], r["carried"]) for r in live.live_rows(spark, str(tmp_path / "out")).collect()}
    assert rows() == {("fire", "a"): ("a1", True), ("wind", "a"): ("w1", False), ("wind", "z"): ("w1", False)}
    poll(folder, 6, "fire", 40, 41, [("e", None, "e2")])  # the same checkpoint goes on: a is dropped, z has expired
    run()
    assert rows() == {("fire", "e"): ("e2", False), ("wind", "a"): ("w1", False)}


def test_state_does_not_grow(spark, tmp_path):
    (folder := tmp_path / "polls").mkdir()
    for i in range(8):
        poll(folder, i, "fire", 10 * i, 10 * i + 1, [(f"k{i}-{j}", 10 * i + 5 if j % 2 else None, "x") for j in range(20)])
    query = live.run_live(live.live_changes(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder)), ["note"], buckets=2), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert {r["key"] for r in live.live_rows(spark, str(tmp_path / "out")).collect()} == {f"k7-{j}" for j in range(20)}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 8 and held[-1] <= 2 * held[1]


def test_polls_that_can_not_count_do_not_reach_the_state(spark):
    """Each poll went to the state, row by row, and a header to all buckets."""
    import random

    rng = random.Random(3)
    stamp = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = []
    for i in range(4000):
        feed, key = rng.choice("ab"), rng.choice([None, "x", "y", "z"])
        rows.append((feed, key, rng.randrange(20), stamp(rng.randrange(500)), rng.choice([None, 5, 9]), None if key else rng.choice([live.GOOD, live.FAILED]), rng.choice([None, "m", "n"])))
    polls = spark.createDataFrame(rows, "feed string, key string, generated long, pulled timestamp, ends long, status string, note string").coalesce(1)
    kept = [tuple(r) for r in live.needed(polls, ["note"]).collect()]
    assert len(kept) < 200 and len(set(kept)) == len(kept)
    value = lambda r: (r[2], r[4], r[6])
    for since in range(0, 500, 7):  # whatever the watermark, the same row is the newest
        for group in {(r[0], r[1], r[5]) for r in rows}:
            newest = []
            for some in (rows, kept):
                best = None
                for r in some:
                    if (r[0], r[1], r[5]) == group and r[3].replace(tzinfo=None) >= stamp(since) and (best is None or live.LiveKeys.later(value(r), best)):
                        best = value(r)
                newest.append(best)
            assert newest[0] == newest[1]
    assert max(r[3] for r in kept) == max(r[3] for r in rows)


class State:
    """A bucket's state in a dictionary, with what was read of it and its timers."""

    def __init__(self):
        self.rows, self.feed, self.timers, self.read = {}, None, set(), 0

    getMapState = lambda self, *_: Rows(self)
    getValueState = lambda self, *_: Feed(self)
    registerTimer = lambda self, t: self.timers.add(t)
    deleteTimer = lambda self, t: self.timers.discard(t)
    listTimers = lambda self: iter(sorted(self.timers))


class Feed:
    def __init__(self, state):
        self.state = state

    exists = lambda self: self.state.feed is not None
    get = lambda self: self.state.feed
    update = lambda self, value: setattr(self.state, "feed", value)


class Rows:
    def __init__(self, state):
        self.state = state

    def one(self, found):
        self.state.read += 1
        return found

    containsKey = lambda self, k: self.one(k in self.state.rows)
    getValue = lambda self, k: self.one(self.state.rows[k])
    updateValue = lambda self, k, value: self.state.rows.__setitem__(k, value)
    removeKey = lambda self, k: self.state.rows.pop(k)
    iterator = lambda self: map(self.one, list(self.state.rows.items()))


class Bucket:
    """Batches of one bucket as Spark gives them: rows first, then the timers that the watermark has reached."""

    def __init__(self):
        from pyspark.sql import types as T

        self.state, self.processor = State(), live.LiveKeys(T.StructType([T.StructField("note", T.StringType())]))
        self.processor.init(self.state)

    def batch(self, rows, watermark):
        from types import SimpleNamespace

        times = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
        names = ("key", "generated", "ends", "status", "note")
        changes = list(self.processor.handleInputRows(("fire", 0), (dict(zip(names, r)) for r in rows), times)) if rows else []
        for t in sorted(t for t in self.state.timers if t <= watermark):
            changes += self.processor.handleExpiredTimer(("fire", 0), times, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t))
            self.state.timers.discard(t)
        return sorted((r["key"], r["change"], r["carried"]) for r in changes)


def test_rows_of_a_bucket_are_not_read_for_each_end():
    """Each row had a timer of its own, and each timer read all rows of the bucket."""
    bucket, n = Bucket(), 300
    header = lambda generated, status=live.GOOD: (None, generated, None, status, None)
    assert len(bucket.batch([header(1), *((f"k{i}", 1, 1000 * (i + 1), None, "x") for i in range(n))], 0)) == n
    assert bucket.batch([], n // 2) == sorted((f"k{i}", live.EXPIRED, False) for i in range(n // 2))
    assert bucket.state.read <= 3 * n and len(bucket.state.timers) == 1
    assert bucket.batch([("k299", 2, 151_000, None, "x")], n // 2) == [("k299", live.RENEWED, False)]  # now the second to end
    assert bucket.batch([], n // 2 + 1) == [("k150", live.EXPIRED, False), ("k299", live.EXPIRED, False)]
    assert bucket.batch([], n) == sorted((f"k{i}", live.EXPIRED, False) for i in range(n // 2 + 1, n - 1))
    assert not bucket.state.rows and bucket.state.read <= 5 * n


def test_an_ignored_row_does_not_keep_its_key_from_being_carried():
    bucket = Bucket()
    assert bucket.batch([(None, 10, None, live.GOOD, None), ("a", 10, None, None, "a0"), ("b", 10, None, None, "b0")], 0) == [("a", live.NEW, False), ("b", live.NEW, False)]
    assert bucket.batch([(None, 20, None, live.FAILED, None), ("a", 5, None, None, "old"), ("c", 5, None, None, "old")], 0) == [("a", live.CARRIED, True), ("b", live.CARRIED, True)]
    assert bucket.batch([(None, 30, None, live.GOOD, None), ("b", 30, None, None, "b1"), ("a", 5, None, None, "old")], 0) == [("a", live.DROPPED, False), ("b", live.RENEWED, False)]


def test_rows_older_than_a_good_snapshot_do_not_reach_the_state(spark, monkeypatch):
    """All that a task had of a key's newest rows went to the state, of snapshots long replaced too; and a row with its snapshot's status had to be two."""
    import random

    monkeypatch.setattr(live, "GATHERED", 700)
    rng = random.Random(5)
    stamp = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = []
    for _ in range(4000):
        feed, key, generated = rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), rng.randrange(400)
        status = rng.choice([live.GOOD, live.FAILED]) if key is None else rng.choice([None, live.GOOD])
        rows.append((feed, None if key is None else f"k{key}", generated, stamp(generated + rng.randrange(40)), rng.choice([None, 5, 9]), status, rng.choice([None, "m", "n"])))
    polls = spark.createDataFrame(rows, "feed string, key string, generated long, pulled timestamp, ends long, status string, note string").coalesce(1)
    kept = [tuple(r) for r in live.needed(polls, ["note"], snapshots=True).collect()]
    assert len(kept) < 250 and all(r[1] is None or r[5] is None for r in kept)

    def outcome(polls, since):
        polls, newest = [r for r in polls if r[3].replace(tzinfo=None) >= since], {}
        last = {(f, s): max((r[2] for r in polls if r[0] == f and r[5] == s), default=-1) for f in ("a", "b", None) for s in (live.GOOD, live.FAILED)}
        for r in polls:
            if r[1] is not None and r[2] >= last[r[0], live.GOOD] and (r[:2] not in newest or live.LiveKeys.later((r[2], r[4], r[6]), newest[r[:2]])):
                newest[r[:2]] = (r[2], r[4], r[6])
        return last, newest

    for since in range(0, 440, 7):  # whatever the watermark, the same is live
        assert outcome(rows, stamp(since)) == outcome(kept, stamp(since))
    assert max(r[3] for r in kept) == max(r[3] for r in rows)
    plain = spark.createDataFrame([("a", "k", 1, stamp(1), None, live.GOOD, None)], polls.schema)
    as_given = plain.withColumn("status", plain["key"].isNotNull().cast("string"))  # a column that is never null
    assert [tuple(r)[1:6:4] for r in live.needed(as_given, ["note"], snapshots=True).collect()] == [(None, "true"), ("k", None)]


def test_a_row_with_a_status_is_its_snapshots_header(spark, tmp_path):
    (folder := tmp_path / "polls").mkdir()
    schema = SCHEMA.replace("note string", "note array<string>")  # not a plain payload: rows aren't left out before the state
    for i, (generated, keys) in enumerate([(0, "ab"), (10, "bc")]):
        lines = [{"feed": "fire", "key": k, "generated": at(generated), "pulled": at(generated + 1), "status": "ok", "note": [k], "value": generated} for k in keys]
        (file := folder / f"{i}.json").write_text("".join(json.dumps(x) + "\n" for x in lines))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))
    for payload in (["note"], ["value"]):
        stream = spark.readStream.schema(schema + ", value long").option("maxFilesPerTrigger", 1).json(str(folder))
        out = str(tmp_path / payload[0])
        live.run_live(live.live_changes(stream, payload, buckets=3), out, f"{out}-check").awaitTermination()
        assert {(r["key"], r["carried"]) for r in live.live_rows(spark, out).collect()} == {("b", False), ("c", False)}


def test_rows_that_other_tasks_have_newer_ones_of_do_not_reach_the_state(spark, tmp_path, monkeypatch):
    """Each task's last snapshot reached the state: of polls in order of time, as many rows as there are tasks for each key."""
    (folder := tmp_path / "polls").mkdir()
    for i in range(6):
        poll(folder, i, "fire", 10 * i, 10 * i + 1, [(f"k{j}", None, f"{i}") for j in range(20)])
    poll(folder, 6, "wind", 0, 1, [("k0", None, "w")])
    seen = tmp_path / "seen"

    class Counting(live.LiveKeys):
        def handleInputRows(self, key, rows, timerValues):
            rows = list(rows)
            with open(seen, "a") as f:
                f.write("".join(f"{r['feed']} {r['key']}\n" for r in rows))
            yield from live.LiveKeys.handleInputRows(self, key, iter(rows), timerValues)

    monkeypatch.setattr(live, "LiveKeys", Counting)
    stream = spark.readStream.schema(SCHEMA).json(str(folder))  # one batch, a task for each file
    live.run_live(live.live_changes(stream, ["note"], buckets=3), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(seen.read_text().split("\n")) == sorted(["", *(f"fire k{j}" for j in range(20)), "wind k0", *3 * ["fire None", "wind None"]])
    assert {(r["feed"], r["key"], r["note"]) for r in live.live_rows(spark, str(tmp_path / "out")).collect()} == {("wind", "k0", "w"), *(("fire", f"k{j}", "5") for j in range(20))}


def test_rows_wait_for_headers_that_are_still_to_come(spark, monkeypatch):
    """A task with more keys than it gathers at once gave them all to the state, of each snapshot in order of time."""
    import random

    monkeypatch.setattr(live, "GATHERED", 100)
    stamp = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [("a", f"k{j}", i, stamp(i), None, live.GOOD, "x") for i in range(5) for j in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        for order in (rows, random.Random(7).sample(rows, len(rows))):
            polls = spark.createDataFrame(order, "feed string, key string, generated long, pulled timestamp, ends long, status string, note string").coalesce(1)
            kept = [tuple(r) for r in live.needed(polls, ["note"], snapshots=True).collect()]
            assert sorted(r[1] for r in kept if r[1]) == sorted(f"k{j}" for j in range(300)) and {r[2] for r in kept if r[1]} == {4}
            assert [r[2] for r in kept if r[1] is None] == [4]
            alone = live.needed(polls, ["note"]).where("key IS NOT NULL").collect()  # without `snapshots` headers leave out no rows
            assert {(r["key"], r["generated"]) for r in alone} >= {(f"k{j}", 4) for j in range(300)} and len(alone) > 1000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
