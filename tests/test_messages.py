import datetime as dt
import random
import string

from pyspark.sql import functions as F

from marginalia.config import Settings, token_valid
from marginalia.functions import envelope, web
from marginalia.operators import enrich
from marginalia.operators.messages import _entries, _kept, _summaries, accepted, dedup_key
from marginalia.operators.shared import shared_folder, written
from marginalia.schema import NOTE, UPSERT
from marginalia.streaming.messages import Snapshots, decoded, dedup_exact, dedup_within_watermark, read_messages

START = dt.datetime(2025, 1, 1)


def fold(times, ttl):
    out = []
    for t in sorted(times):
        if not out or t - out[-1] >= ttl:
            out.append(t)
    return out


def _events(seed=3):
    rng = random.Random(seed)
    return [(k, rng.choice([0, 100, 300, 350, 600, rng.randint(0, 4000)])) for k in "abc" for _ in range(60)] + [("d", t) for t in (0, 100, 300, 350, 600)]


def test_accepted(spark):
    events = _events() + [(None, 5)]
    df = spark.createDataFrame([(k, START + dt.timedelta(seconds=t)) for k, t in events], "k string, ts timestamp")
    got = {}
    for r in accepted(df, F.coalesce("k", F.lit("")), F.col("ts"), 300).collect():
        got.setdefault(r["dedup_key"], []).append(int((r["ts"] - START).total_seconds()))
    assert {k: sorted(v) for k, v in got.items()} == {k or "": fold([t for x, t in events if x == k], 300) for k in ["a", "b", "c", "d", None]}
    assert accepted(df.limit(0), F.col("k"), F.col("ts"), 300).count() == 0


def test_a_hot_key_in_many_partitions():
    """One key over most partitions of a table in order of key and time, in partitions of any size."""
    import pyarrow as pa

    rng = random.Random(4)
    for step in (1, 40, 400):
        rows = sorted({(rng.choice("abbbbbbc"), rng.randrange(0, 3000, step) if rng.random() < 0.9 else rng.randrange(5000)) for _ in range(400)})
        cuts = sorted(rng.sample(range(len(rows) + 1), 12))
        parts = [rows[a:z] for a, z in zip([0, *cuts], [*cuts, len(rows)])]
        frames = [[pa.RecordBatch.from_pylist([{"dedup_key": k, "t": t, "part": i} for k, t in p[j : j + 7]]) for j in range(0, len(p), 7)] for i, p in enumerate(parts)]
        summaries = [r for f in frames for b in _summaries(iter(f), 300) for r in b.to_pylist()]
        entry = _entries(summaries, 300)
        got = [(r["dedup_key"], r["t"]) for f in frames for b in _kept(iter(f), 300, entry) for r in b.to_pylist()]
        assert got == [(k, t) for k in "abc" for t in fold([x for y, x in rows if y == k], 300)]


def test_stream_dedup_is_exact(spark, tmp_path):
    events = sorted(_events(8), key=lambda e: e[1])
    for i in range(0, len(events), 40):  # several micro-batches in order of time
        rows = [(f"{k}", "", "text", "u", "x", START + dt.timedelta(seconds=t)) for k, t in events[i : i + 40]]
        spark.createDataFrame(rows, "msg_id string, create_time string, msg_type string, from_user string, content string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = read_messages(spark, str(tmp_path / "in"), files_per_trigger=1).withColumn("key", dedup_key(F.col("msg_id"), F.col("create_time")))
    q = dedup_exact(stream, "key", "ts", 300, "2 hours").writeStream.format("memory").queryName("passed").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.sql("SELECT * FROM passed").collect():
        got.setdefault(r["dedup_key"][0], []).append(r["micros"] // 1_000_000 - int(START.replace(tzinfo=dt.timezone.utc).timestamp()))
    assert {k: sorted(v) for k, v in got.items()} == {k: fold([t for x, t in events if x == k], 300) for k in "abcd"}


def test_built_in_stream_dedup(spark, tmp_path):
    rows = [("m1", "1", "text", "u", "x", START), ("m1", "1", "text", "u", "x", START + dt.timedelta(seconds=9)), ("m2", "1", "text", "u", "x", START)]
    spark.createDataFrame(rows, "msg_id string, create_time string, msg_type string, from_user string, content string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = read_messages(spark, str(tmp_path / "in")).withColumn("key", dedup_key(F.col("msg_id"), F.col("create_time")))
    q = dedup_within_watermark(stream, "key", "ts").writeStream.format("memory").queryName("unique").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT * FROM unique").count() == 2


def _note(code, title, arrival):
    base = dict.fromkeys([f.name for f in UPSERT], "")
    base |= dict(video_code=code, title=title, arrival=arrival, duration_seconds=0.0, created_at="2025")
    return tuple(base[f.name] for f in UPSERT)


def test_upsert_sink_is_idempotent(spark, tmp_path):
    store = Snapshots(spark, f"file:{tmp_path}/store")
    apply = store.upsert_batch(lambda: ("NOW", "STAMP"))
    first = spark.createDataFrame([_note("a", "one", 1), _note("b", "two", 2)], UPSERT)
    apply(first, 0)
    apply(spark.createDataFrame([_note("a", "three", 3), _note(None, "four", 4)], UPSERT), 1)
    apply(spark.createDataFrame([_note("a", "again", 5)], UPSERT), 1)  # the same batch, replayed
    assert sorted((r["id"], r["title"]) for r in store.notes().collect()) == [(1, "three"), (2, "two"), (3, "four")]
    assert {r["token"] for r in store.index().postings().where("col = 0").collect()} == {"three", "two", "four"}
    before = store.current()["notes"]
    apply(spark.createDataFrame([_note("b", "five", 6)], UPSERT), 2)
    after = store.current()["notes"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(after) == len(before)  # the other notes stay where they are
    assert {r["token"] for r in store.index().postings(["five", "two", "three"]).collect()} == {"five", "three"}
    assert store.notes().schema.names == NOTE.names


def test_decoding(spark):
    rows = [("text", "u1", "7", "8", "a<b]]>&c"), ("image", "u1", "9", "8", None), ("text", "u2", None, None, "x")]
    df = spark.createDataFrame(rows, "msg_type string, from_user string, msg_id string, create_time string, content string")
    xml = df.select(web.message_xml(**{c: F.col(c) for c in df.columns}).alias("xml"), F.lit(START).alias("ts"))
    got = sorted((r["from_user"], r["content"], r["dedup_key"]) for r in decoded(xml, "xml", "ts").collect())
    assert got == [("u1", "a<b]]>&c", "7_8"), ("u2", "x", "_")]


def test_envelope(spark):
    rng = random.Random(1)
    texts = ["", "a", "中文" * 40, "x" * 11, "y" * 12, "z" * 5000] + ["".join(rng.choices(string.printable, k=n)) for n in range(1, 70)]
    key = envelope.key_bytes(F.lit("kWxPqTz3bQ5nJ8cYf0uLrEo1sVhGmDi7aZtX9yB2wKM"))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    sealed = df.select("i", envelope.seal(F.col("t"), F.lit("corp"), key, F.unhex(F.md5(F.col("t")))).alias("e"))
    back = sealed.select("i", envelope.opened(F.col("e"), key).alias("o")).orderBy("i").collect()
    assert [(r["o"]["text"], r["o"]["receiver"]) for r in back] == [(t, "corp") for t in texts]
    bad = spark.createDataFrame([("AAAA",), ("not base64!",), (None,)], "e string")
    assert [r[0] for r in bad.select(envelope.opened(F.col("e"), key)).collect()] == [None] * 3
    assert spark.range(1).select(envelope.key_bytes(F.lit("short"))).first()[0] is None
    checks = spark.createDataFrame([("s", "s", "r", "r"), ("s", "x", "r", "r"), ("s", "s", "q", "r")], "a string, b string, c string, d string")
    assert [r[0] for r in checks.select(envelope.verdict(*map(F.col, "abcd"))).collect()] == [0, -40001, -40005]


def test_decisions(spark):
    rng = random.Random(2)
    calls = [(f"c{i}", [rng.choice(["200", "400", "401", "413", "429", "502", "timeout", None]) for _ in range(rng.randint(1, 6))]) for i in range(300)]
    calls += [("rate", ["429"] * 5), ("server", ["502", "timeout", "503", "500"]), ("mixed", ["429", "502"])]
    rows = [(c, a + 1, o) for c, outcomes in calls for a, o in enumerate(outcomes)]
    got = {}
    for r in enrich.decisions(spark.createDataFrame(rows + rows[:40], "call_id string, attempt int, outcome string")).orderBy("attempt").collect():
        got.setdefault(r["call_id"], []).append((r["service"], r["action"], r["wait"]))
    assert got == {c: enrich.decide(o) for c, o in calls}
    assert enrich.decide(["429"] * 5) == [(1, "retry", 5), (1, "retry", 10), (1, "retry", 20), (1, "failover", 0), (2, "retry", 2)]
    assert enrich.decide(["413", "200"]) == [(1, "raise", 0), (1, "over", 0)] and enrich.decide(["401"]) == [(1, "failover", 0)] == enrich.decide([None])
    assert enrich.decide(["429", "timeout"]) == [(1, "retry", 5), (1, "raise", 0)] and enrich.decide(["502", "timeout", "400"])[1:] == [(1, "retry", 6), (1, "failover", 0)]
    assert enrich.decide([None, "400", "timeout", "502", "200"]) == [(1, "failover", 0), (2, "retry", 2), (2, "retry", 2), (2, "raise", 0), (2, "over", 0)]


class Scripted:
    def __init__(self, *answers):
        self.answers = list(answers)

    def complete(self, system, user):
        a = self.answers.pop(0)
        if isinstance(a, int):
            raise enrich.StatusError(a)
        if a is None:
            raise TimeoutError
        return a


def test_failover_client():
    def call(first, second):
        waits = []
        try:
            return enrich.ResilientClient(Scripted(*first), Scripted(*second), waits.append).complete("", ""), waits
        except Exception as e:  # noqa: BLE001
            return type(e), waits

    assert call(["fine"], []) == ("fine", [])
    assert call([429, 429, "late"], []) == ("late", [5, 10])
    assert call([502, None, 500, 503], [None, "other"]) == ("other", [3, 6, 12, 0, 2])
    assert call([429, None], ["other"]) == (TimeoutError, [5])
    assert call([401], [500, 500, 500]) == (enrich.StatusError, [0, 2, 2])
    assert call([400], ["other"]) == (enrich.StatusError, [])


class Failing:
    def complete(self, system, user):
        if "fail" in user:
            raise RuntimeError("x" * 200)
        return "#a、 b"


def test_tagging(spark):
    notes = spark.createDataFrame([(1, "fine"), (2, "fail **term**"), (3, None)], "id long, summary_markdown string")
    assert {r["id"]: r["tags"] for r in enrich.tagged(notes, Failing).collect()} == {1: "a,b", 2: "term", 3: "a,b"}
    errors = enrich.call_service(notes, "id", "summary_markdown", Failing).where("error IS NOT NULL").collect()
    assert len(errors) == 1 and len(errors[0]["error"]) == 100


def test_segments(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("a", 3, None), ("b", 1, None)], "k string, o int, t string")
    assert [tuple(r) for r in enrich.joined_segments(df, F.col("k"), F.col("o"), F.col("t")).collect()] == [("a", "x\n\ny")]


def test_settings_and_folder(spark):
    assert Settings.from_env({"MARGINALIA_DEDUP_TTL": "7"}).dedup_ttl == 7 and Settings.from_env({}).dedup_ttl == 300
    assert token_valid(0, 61) and not token_valid(1, 61)
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert written(spark.range(3)).count() == 3
