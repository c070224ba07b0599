"""Explicit schemas of the store and its inputs."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    types = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "timestamp": T.TimestampNTZType()}
    return T.StructType([T.StructField(n, types[t]) for n, t in (x.split(":") for x in spec.split())])


NOTE = _struct(
    "id:long video_id:string title:string author:string source_url:string summary_markdown:string tags:string "
    "user_requirement:string created_at:string duration_seconds:double video_code:string timestamp:string"
)
UPSERT = T.StructType([f for f in NOTE if f.name != "id"] + [T.StructField("arrival", T.LongType())])
MESSAGE = _struct("msg_id:string create_time:string msg_type:string from_user:string content:string ts:timestamp")
PAGE = _struct("page_id:long url:string html:string")
CALL = _struct("call_id:string attempt:int outcome:string")
TABLES = {"knowledge": NOTE, "note_upserts": UPSERT, "messages": MESSAGE, "share_pages": PAGE, "enrich_calls": CALL}
NOTE_COLUMNS = [f.name for f in NOTE]
#: Result columns of the list operators (no summary, requirement or timestamp).
LIST_COLUMNS = ["id", "video_id", "title", "author", "tags", "source_url", "created_at", "duration_seconds", "video_code"]
