"""Queries over messages and service calls, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.config import DEDUP_TTL_SECONDS
from marginalia.functions import envelope, web
from marginalia.operators import enrich
from marginalia.operators.messages import accepted, dedup_key
from marginalia.sources.media import route, segments
from marginalia.sources.tables import read_table
from marginalia.streaming import queues

KEY = "kWxPqTz3bQ5nJ8cYf0uLrEo1sVhGmDi7aZtX9yB2wKM"  # an invented key
LONG_TTL = 86_400


def msg_dedup(spark, sf_dir):
    """Accepted deliveries of every message."""
    m = read_table(spark, sf_dir, "messages")
    return accepted(m, dedup_key(F.col("msg_id"), F.col("create_time")), F.col("ts"), DEDUP_TTL_SECONDS)


def msg_dedup_ttl(spark, sf_dir):
    """Accepted events of every user at a TTL of a day, where a comparison with the previous row alone would be wrong."""
    e = read_table(spark, sf_dir, "events")
    return accepted(e, F.col("user_id").cast("string"), F.col("ts"), LONG_TTL)


def text_messages(spark, sf_dir):
    m = read_table(spark, sf_dir, "messages").where("msg_type = 'text'")
    return m.select("msg_id", "from_user", "content", "ts")


def messages_by_type(spark, sf_dir):
    return read_table(spark, sf_dir, "messages").groupBy("msg_type").agg(F.count("*").alias("n"), F.countDistinct("from_user").alias("users"))


def signature(spark, sf_dir):
    e = lambda c: F.coalesce(c, F.lit(""))
    m = read_table(spark, sf_dir, "messages")
    return m.select("msg_id", "ts", envelope.signature(F.lit("token"), e("create_time"), e("msg_id"), e("content")).alias("signature"))


def xml_fields(spark, sf_dir):
    """Every message written as an envelope and read again."""
    names = ["msg_type", "from_user", "msg_id", "create_time", "content"]
    m = read_table(spark, sf_dir, "messages")
    xml = m.select("ts", web.message_xml(**{n: F.col(n) for n in names}).alias("xml"))
    return xml.select("ts", *web.message_fields(F.col("xml")))


def envelope_roundtrip(spark, sf_dir):
    """Every message sealed and opened again."""
    key = envelope.key_bytes(F.lit(KEY))
    m = read_table(spark, sf_dir, "messages").where("content IS NOT NULL")
    sealed = envelope.seal(F.col("content"), F.lit("corp-1"), key, F.unhex(F.md5(F.coalesce("msg_id", F.lit("")))))
    o = m.select("msg_id", "ts", envelope.opened(sealed, key).alias("o"))
    return o.select("msg_id", "ts", F.col("o.text").alias("content"), F.col("o.receiver").alias("receiver"))


def call_decisions(spark, sf_dir):
    return enrich.decisions(read_table(spark, sf_dir, "enrich_calls"))


def tagging(spark, sf_dir):
    """Tags of every note by the stub service."""
    return enrich.tagged(read_table(spark, sf_dir, "knowledge"))


def concat_segments(spark, sf_dir):
    """The messages of every user and type joined in order of time; null parts of the key or the order are empty and come first."""
    m = read_table(spark, sf_dir, "messages")
    key = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("from_user", "msg_type")])
    return enrich.joined_segments(m, key, F.struct("ts", F.coalesce("msg_id", F.lit("")), "content"), F.col("content"))


def audio_segments(spark, sf_dir):
    """Pieces in which the recording of every note would be transcribed."""
    return segments(read_table(spark, sf_dir, "knowledge"), "id", "duration_seconds")


def media_routes(spark, sf_dir):
    """How the recording of every note, at 16,000 bytes a second, would be transcribed, also after the direct way failed."""
    length = (F.col("duration_seconds") * 16_000).cast("long")
    k = read_table(spark, sf_dir, "knowledge").where("duration_seconds > 0 AND NOT isnan(duration_seconds)")
    return k.select("id", route(length).alias("first"), route(length, F.lit(True)).alias("second"))


def enriched(spark, sf_dir):
    """Every document through the three chained calls of the stub service."""
    return enrich.finished(read_table(spark, sf_dir, "documents"), "doc_id", "text", enrich.StubClient).withColumnRenamed("key", "doc_id")


def _task_events(spark, sf_dir):
    """Messages as events of the task queue: links add, start words start, cancel words drop."""
    m = read_table(spark, sf_dir, "messages")
    word = F.lower(F.trim("content"))
    url = web.extract_url(F.col("content"))
    event = F.when(url.isNotNull(), "add").when(word.isin("开始", "start"), "start").when(word.isin("取消", "cancel"), "drop")
    return m, (F.col("from_user"), F.col("ts"), event, url)


def queue_outcomes(spark, sf_dir):
    """What becomes of the tasks of every user."""
    m, event = _task_events(spark, sf_dir)
    return queues.replayed(m, *event)


def queue_pending(spark, sf_dir):
    """Users that have a task in front at the time of the last message, by its phase."""
    m, event = _task_events(spark, sf_dir)
    last = m.agg(F.unix_micros(F.max("ts").cast("timestamp"))).first()[0] or 0
    return queues.pending(m, *event, last).groupBy("phase").agg(F.count("*").alias("users"), F.sum("waiting").alias("waiting"))


def received_codes(spark, sf_dir):
    """Every message sealed, some of the envelopes damaged, and received."""
    m = read_table(spark, sf_dir, "messages").where("content IS NOT NULL")
    md5 = F.md5(F.coalesce("msg_id", F.lit("")))
    m = m.withColumn("n", F.pmod(F.conv(F.substring(md5, 1, 6), 16, 10).cast("int"), F.lit(7)))
    n = F.col("n")
    m = m.withColumn("sealed", envelope.seal(F.col("content"), F.when(n == 1, "corp-2").otherwise("corp-1"), envelope.key_bytes(F.lit(KEY)), F.unhex(md5)))
    m = m.withColumn("sent", F.when(n == 2, F.lit("no base64!")).when(n == 3, F.substring("sealed", 1, 12)).otherwise(F.col("sealed")))
    parts = [F.lit("token"), F.col("create_time"), F.col("msg_id")]
    m = m.withColumn("signed", F.when(n == 4, F.lit("wrong")).otherwise(envelope.signature(*[F.coalesce(p, F.lit("")) for p in (*parts, F.col("sent"))])))
    got = envelope.received(F.col("signed"), parts, F.col("sent"), F.when(n == 5, F.lit("short")).otherwise(F.lit(KEY)), F.lit("corp-1"))
    return m.withColumn("got", got).select("msg_id", "ts", "n", "got.code", "got.text")


QUERIES = {
    f.__name__: f
    for f in (msg_dedup, msg_dedup_ttl, text_messages, messages_by_type, signature, xml_fields, envelope_roundtrip, call_decisions, tagging, concat_segments, audio_segments, enriched, media_routes, queue_outcomes, queue_pending, received_codes)
}


def _dedup(source: str, ttl: int) -> str:
    return f"""WITH RECURSIVE s AS ({source}), a AS (SELECT dedup_key, min(ts) AS ts FROM s GROUP BY dedup_key
      UNION ALL SELECT s.dedup_key, min(s.ts) AS ts FROM a JOIN s ON s.dedup_key = a.dedup_key AND s.ts >= a.ts + INTERVAL {ttl} SECOND GROUP BY s.dedup_key, a.ts)
    SELECT dedup_key, ts FROM a"""


_ANY = r"https?://[A-Za-z0-9.\-]+"
_TASKS = rf"""WITH RECURSIVE m AS (SELECT coalesce(from_user, '') AS key, epoch_us(ts) AS t, lower(trim(content, ' ')) AS word, regexp_extract(regexp_replace(content, '{_ANY}/(?:share/)?video/[0-9]+', ' ', 'g'), '{_ANY}/[A-Za-z0-9_\-]+/?') AS s,
        regexp_extract(content, '{_ANY}/video/[0-9]+') AS v, regexp_extract(content, '{_ANY}/share/video/[0-9]+') AS w FROM messages WHERE ts IS NOT NULL),
      x AS (SELECT key, t, word, CASE WHEN s != '' THEN rtrim(s, '/') || '/' WHEN v != '' THEN v WHEN w != '' THEN w END AS item FROM m),
      e AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, event, item NULLS FIRST) AS r FROM (
        SELECT key, t, item, CASE WHEN item IS NOT NULL THEN 'add' WHEN word IN ('开始', 'start') THEN 'start' WHEN word IN ('取消', 'cancel') THEN 'drop' END AS event FROM x) WHERE event IS NOT NULL),
      z AS (SELECT key, 0::BIGINT AS r, NULL::VARCHAR AS front, false AS running, NULL::BIGINT AS due, 0 AS n, []::STRUCT(t BIGINT, o VARCHAR, x VARCHAR)[] AS told FROM (SELECT DISTINCT key FROM e)
        UNION ALL SELECT key, r, CASE WHEN arms THEN item WHEN drops THEN NULL ELSE front END, CASE WHEN arms OR drops THEN false ELSE runs OR starts END, CASE WHEN arms THEN t + 120000000 WHEN drops OR runs OR starts THEN NULL ELSE due END,
          n + CAST(event = 'add' AND NOT arms AND n < 3 AS INT), list_filter([
            CASE WHEN fires THEN {{'t': due, 'o': 'started', 'x': front}} END, CASE WHEN arms AND front IS NOT NULL THEN {{'t': t, 'o': 'dropped', 'x': front}} END,
            CASE WHEN arms THEN {{'t': t, 'o': 'armed', 'x': item}} WHEN event = 'add' THEN {{'t': t, 'o': CASE WHEN n < 3 THEN 'queued' ELSE 'refused' END, 'x': item}} END,
            CASE WHEN starts THEN {{'t': t, 'o': 'started', 'x': front}} WHEN drops THEN {{'t': t, 'o': 'dropped', 'x': front}} END], lambda y: y IS NOT NULL) FROM (
          SELECT *, event = 'add' AND (front IS NULL OR NOT runs) AS arms, event = 'start' AND front IS NOT NULL AND NOT runs AS starts, event = 'drop' AND front IS NOT NULL AND NOT runs AS drops FROM (
            SELECT *, running OR fires AS runs FROM (SELECT z.key, e.r, e.t, e.event, e.item, z.front, z.running, z.due, z.n, z.front IS NOT NULL AND NOT z.running AND e.t >= z.due AS fires FROM z JOIN e ON e.key = z.key AND e.r = z.r + 1)))),
      last AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY key ORDER BY r DESC) = 1)"""

ORACLE = {
    # the messages hold no event that ends a task, so what waits never starts
    "queue_outcomes": f"""{_TASKS}, o AS (SELECT key, unnest(told) AS one, n FROM z UNION ALL SELECT key, {{'t': due, 'o': 'started', 'x': front}}, n FROM last WHERE front IS NOT NULL AND NOT running)
      SELECT key, one.t AS micros, one.o AS outcome, one.x AS item, n AS waiting FROM o""",
    "queue_pending": f"""{_TASKS} SELECT CASE WHEN running OR due <= (SELECT epoch_us(max(ts)) FROM messages) THEN 'running' ELSE 'armed' END AS phase, count(*) AS users, CAST(sum(n) AS BIGINT) AS waiting FROM last WHERE front IS NOT NULL GROUP BY ALL""",
    "audio_segments": """WITH k AS (SELECT id, duration_seconds AS s FROM knowledge WHERE duration_seconds > 0 AND NOT isnan(duration_seconds)),
      g AS (SELECT id, s, unnest(range(CAST(ceil(s / 600) AS BIGINT))) AS seg FROM k) SELECT id, CAST(seg AS INT) AS seg, CAST(seg * 600 AS DOUBLE) AS seg_start, least(CAST((seg + 1) * 600 AS DOUBLE), s) AS seg_end FROM g""",
    "msg_dedup": _dedup("SELECT DISTINCT concat_ws('_', coalesce(msg_id, ''), coalesce(create_time, '')) AS dedup_key, ts FROM messages WHERE ts IS NOT NULL", 300),
    "msg_dedup_ttl": _dedup("SELECT DISTINCT CAST(user_id AS VARCHAR) AS dedup_key, ts FROM events", 86400),
    "text_messages": "SELECT msg_id, from_user, content, ts FROM messages WHERE msg_type = 'text'",
    "messages_by_type": "SELECT msg_type, count(*) AS n, count(DISTINCT from_user) AS users FROM messages GROUP BY msg_type",
    "signature": "SELECT msg_id, ts, sha1(array_to_string(list_sort(['token', coalesce(create_time, ''), coalesce(msg_id, ''), coalesce(content, '')]), '')) AS signature FROM messages",
    "xml_fields": "SELECT ts, coalesce(msg_type, '') AS msg_type, coalesce(from_user, '') AS from_user, coalesce(msg_id, '') AS msg_id, coalesce(create_time, '') AS create_time, coalesce(content, '') AS content FROM messages",
    "envelope_roundtrip": "SELECT msg_id, ts, content, 'corp-1' AS receiver FROM messages WHERE content IS NOT NULL",
    "media_routes": """SELECT id, CASE WHEN b <= 15728640 THEN 'direct' ELSE 'segments' END AS first, CASE WHEN b <= 26214400 THEN 'speech' ELSE 'segments' END AS second
      FROM (SELECT id, CAST(trunc(duration_seconds * 16000) AS BIGINT) AS b FROM knowledge WHERE duration_seconds > 0 AND NOT isnan(duration_seconds))""",
    "received_codes": """SELECT msg_id, ts, n, CASE n WHEN 1 THEN -40005 WHEN 2 THEN -40010 WHEN 3 THEN -40007 WHEN 4 THEN -40001 WHEN 5 THEN -40004 ELSE 0 END AS code, CASE WHEN n IN (0, 6) THEN content END AS text
      FROM (SELECT *, CAST('0x' || substr(md5(coalesce(msg_id, '')), 1, 6) AS INT) % 7 AS n FROM messages WHERE content IS NOT NULL)""",
    "enriched": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS (SELECT doc_id, regexp_extract_all(t, '\*\*([^*\n]+)\*\*', 1)[1:8] AS b, t FROM d),
      e AS (SELECT doc_id, CASE WHEN len(b) > 0 THEN array_to_string(list_transform(b, lambda x: '# ' || x), '、') ELSE substr(sha1(t), 1, 8) END AS draft FROM a)
      SELECT doc_id, substr(sha1('## draft' || chr(10) || draft || chr(10) || chr(10) || '## report' || chr(10) || substr(sha1(draft), 1, 8) || chr(10)), 1, 8) AS final, CAST(NULL AS VARCHAR) AS error FROM e""",
    "concat_segments": "SELECT coalesce(from_user, '') || '|' || coalesce(msg_type, '') AS key, string_agg(content, chr(10) || chr(10) ORDER BY ts NULLS FIRST, coalesce(msg_id, ''), content) AS text FROM messages WHERE content IS NOT NULL GROUP BY ALL",
    "call_decisions": """WITH RECURSIVE o AS (SELECT call_id, attempt, min(outcome) AS outcome FROM enrich_calls GROUP BY ALL),
      n AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY attempt) AS r, CASE WHEN NOT regexp_full_match(coalesce(outcome, ''), '[0-9]+') THEN 'lost' WHEN outcome LIKE '2__' THEN 'ok' WHEN outcome = '429' THEN 'rate'
        WHEN CAST(outcome AS INT) >= 500 THEN 'server' WHEN outcome IN ('401', '403') OR outcome LIKE '3__' THEN 'refused' ELSE 'client' END AS k FROM o),
      s AS (SELECT call_id, attempt, outcome, r, 1 AS service, k AS chain, 1 AS tries, CASE k WHEN 'ok' THEN 'return' WHEN 'rate' THEN 'retry' WHEN 'server' THEN 'retry' WHEN 'client' THEN 'raise' ELSE 'failover' END AS action FROM n WHERE r = 1
        UNION ALL SELECT n.call_id, n.attempt, n.outcome, n.r, CASE WHEN s.action = 'failover' THEN 2 ELSE s.service END, s.chain, CASE WHEN s.action = 'failover' THEN 1 ELSE s.tries + 1 END,
          CASE WHEN s.action IN ('return', 'raise', 'over') THEN 'over' WHEN n.k = 'ok' THEN 'return' WHEN s.action = 'failover' THEN 'retry' WHEN s.service = 2 AND s.tries = 1 THEN 'retry' WHEN s.service = 2 THEN 'raise'
            WHEN s.chain = 'rate' AND n.k = 'lost' THEN 'raise' WHEN s.tries = 3 OR NOT (n.k = s.chain OR s.chain = 'server' AND n.k = 'lost') THEN 'failover' ELSE 'retry' END
        FROM s JOIN n ON n.call_id IS NOT DISTINCT FROM s.call_id AND n.r = s.r + 1)
      SELECT call_id, attempt, outcome, service, action, CASE WHEN action != 'retry' THEN 0 WHEN service = 2 THEN 2 WHEN chain = 'rate' THEN [5, 10, 20][tries] ELSE [3, 6, 12][tries] END AS wait FROM s""",
}

_BLANK = r"'^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'"
ORACLE["tagging"] = rf"""WITH t AS (SELECT id, regexp_extract_all(coalesce(summary_markdown, ''), '\*\*([^*\n]+)\*\*', 1)[1:8] AS t FROM knowledge),
      a AS (SELECT k.id, CASE WHEN len(t) > 0 THEN array_to_string(list_transform(t, lambda x: '# ' || x), '、') ELSE substr(sha1(coalesce(summary_markdown, '')), 1, 8) END AS a FROM knowledge k JOIN t ON k.id = t.id)
      SELECT id, array_to_string(list_transform(list_filter(string_split(regexp_replace(a, '[、，]', ',', 'g'), ','), lambda x: regexp_replace(x, {_BLANK}) != ''),
        lambda x: regexp_replace(regexp_replace(regexp_replace(x, {_BLANK}), '^#+', ''), {_BLANK})), ',') AS tags FROM a"""
