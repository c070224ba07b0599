import datetime as dt
import random

from pyspark.sql import functions as F

from marginalia.streaming.queues import Queue, keyed_queues, pending, replayed

START = dt.datetime(2025, 1, 1)
S = 1_000_000


def told(out):
    return [(o, x) for _, o, x in out]


def test_first_item_waits_for_its_timer():
    q = Queue()
    assert q.step(0, "add", "a") == [(0, "armed", "a")]
    assert q.expire(119 * S) == [] and q.expire(500 * S) == [(120 * S, "started", "a")] and q.expire(900 * S) == []
    assert q.step(930 * S, "done") == [(930 * S, "finished", "a")] and q.front is None


def test_start_replace_and_drop():
    q = Queue()
    q.step(0, "add", "a")
    assert told(q.step(1, "add", "b")) == [("dropped", "a"), ("armed", "b")]
    assert told(q.step(2, "start")) == [("started", "b")] and q.step(3, "start") == []
    assert q.step(4, "drop") == []  # it runs
    q.step(5, "done")
    q.step(6, "add", "c")
    assert told(q.step(7, "drop")) == [("dropped", "c")] and q.step(8, "done") == []


def test_capacity_order_and_pause():
    q = Queue()
    q.step(0, "add", "a")
    q.step(1, "start")
    assert [q.step(2, "add", x)[0][1] for x in "bcde"] == ["queued"] * 3 + ["refused"]
    assert told(q.step(3, "done")) == [("finished", "a")] and (q.front, q.running, q.waiting) == ("b", False, ["c", "d"])
    assert told(q.step(4, "add", "f")) == [("queued", "f")]  # it doesn't replace the one that starts by itself
    assert q.step(5 * S, "noise") == [(3 + 2 * S, "started", "b")]


def test_an_unanswered_question_drops():
    q = Queue()
    q.step(0, "add", "a")
    assert told(q.step(10 * S, "ask")) == [("asked", "a")] and q.step(11 * S, "ask") == []
    assert q.expire(129 * S) == [] and q.expire(130 * S) == [(130 * S, "dropped", "a")] and q.front is None
    q.step(200 * S, "add", "b")
    q.step(201 * S, "ask")
    assert told(q.step(202 * S, "start")) == [("started", "b")]


def test_invariants():
    rng = random.Random(3)
    for _ in range(200):
        q, at = Queue(), 0
        for i in range(60):
            at += rng.randint(0, 100) * S
            q.step(at, rng.choice(["add", "add", "start", "drop", "done", "noise"]), f"i{i}")
            assert len(q.waiting) <= q.capacity and (q.front is not None or not q.waiting) and (q.deadline is None or not q.running)


def test_stream_equals_the_rule(spark, tmp_path):
    rng = random.Random(5)
    events = sorted((rng.randint(0, 3000), rng.choice("xyz"), rng.choice(["add", "add", "start", "done", "drop"]), f"i{i}") for i in range(150))
    events = [(t + i / 1000, *e) for i, (t, *e) in enumerate(events)]  # distinct times
    for i in range(0, len(events), 30):
        rows = [(k, START + dt.timedelta(seconds=t), e, x) for t, k, e, x in events[i : i + 30]]
        spark.createDataFrame(rows, "k string, ts timestamp, e string, x string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, e string, x string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = keyed_queues(stream, "k", "ts", "e", "x", delay="0 seconds")
    q = out.writeStream.format("memory").queryName("queues").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["key"], r["outcome"], r["item"]) for r in spark.sql("SELECT * FROM queues").collect())
    queues, want = {}, []
    for t, k, e, x in events:
        want += [(k, o, i) for _, o, i in queues.setdefault(k, Queue()).step(int(t * S), e, x)]
    for k, one in queues.items():  # timers that the watermark has passed at the end
        want += [(k, o, i) for _, o, i in one.expire(int(events[-1][0] * S))]
    assert got == sorted(want)


def test_replay_equals_the_rule(spark):
    rng = random.Random(6)
    events = [(t * 7.5, rng.choice(["x", "y", None]), rng.choice(["add", "add", "start", "done", "drop", "ask", None]), f"i{t}") for t in range(300)]
    df = spark.createDataFrame([(k, START + dt.timedelta(seconds=t), e, x, "c") for t, k, e, x in events] + [("x", None, "add", "y", "c")], "k string, ts timestamp, e string, x string, key string")
    columns = [F.col(c) for c in ("k", "ts", "e", "x")]
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp()) * S
    want, queues = [], {}
    for t, k, e, x in events:
        if e:
            want += [(k or "", *o) for o in queues.setdefault(k or "", Queue()).step(base + int(t * S), e, x)]
    last = base + int(events[-1][0] * S)
    front = sorted((k, q.front, len(q.waiting)) for k, q in queues.items() if not q.expire(last) and q.front)
    assert sorted((r["key"], r["item"], r["waiting"]) for r in pending(df, *columns, last).collect()) == front
    for k, q in queues.items():
        want += [(k, *o) for o in q.expire(1 << 62)]
    assert sorted((r["key"], r["micros"], r["outcome"], r["item"]) for r in replayed(df, *columns).collect()) == sorted(want)
    assert replayed(df.limit(0), *columns).count() == 0
