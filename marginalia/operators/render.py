"""Result sets as Markdown. The labels are fixed values of the read API."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _e(c: str) -> Column:
    return F.coalesce(c, F.lit(""))


# What stands for an empty or missing title or author, and for a missing code or time.
NO_TITLE, NO_AUTHOR, NO_CODE, NO_TIME = "未知标题", "未知作者", "N/A", "未知时间"


def or_else(c: str, text: str) -> Column:
    """The column, or a text where it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(text))


def shown_time(c: str = "created_at", length: int = 19) -> Column:
    """The stored local time, else the first characters of the creation time."""
    return F.coalesce(F.nullif("timestamp", F.lit("")), F.substring(c, 1, length), F.lit(""))


def search_entry() -> Column:
    """One result of a search."""
    return F.concat(
        F.lit("### ["), F.col("id"), F.lit("] "), F.substring(_e("title"), 1, 60), F.lit("\n- **视频码**: `"), F.coalesce("video_code", F.lit("None")),
        F.lit("`\n- **作者**: "), _e("author"), F.lit("\n- **标签**: "), F.substring(_e("tags"), 1, 120),
        F.lit("\n- **时间**: "), shown_time(), F.lit("\n- **摘要**: "), F.substring(_e("snippet"), 1, 200), F.lit("\n"),
    )


def list_entry(code: bool = True) -> Column:
    """One line of a list; lists have no local time. With the code also the tags, if there are any."""
    when = F.concat(F.lit("_ ("), F.substring(_e("created_at"), 1, 10), F.lit(")"))
    head = [F.lit("- **["), F.col("id"), F.lit("]** ")]
    body = [_e("title"), F.lit(" — _"), _e("author"), when]
    if not code:
        return F.concat(*head, *body)
    tags = F.when(_e("tags") != "", F.concat(F.lit("\n  标签: "), F.substring("tags", 1, 80))).otherwise("")
    return F.concat(*head, F.lit("`"), F.coalesce("video_code", F.lit("None")), F.lit("` "), *body, tags)


def note_document(code: bool = False) -> Column:
    """A whole note with its header; the requirement only if there is one."""
    need = F.when(_e("user_requirement") != "", F.concat(F.lit("- **用户要求**: "), F.col("user_requirement"), F.lit("\n"))).otherwise("")
    shown = [F.lit("- **视频码**: `"), F.coalesce("video_code", F.lit("None")), F.lit("`\n")] if code else []
    when = F.coalesce(F.nullif("timestamp", F.lit("")), "created_at", F.lit(""))
    return F.concat(
        F.lit("# "), _e("title"), F.lit("\n\n"), *shown, F.lit("- **作者**: "), _e("author"), F.lit("\n- **来源**: "), _e("source_url"), F.lit("\n- **标签**: "), _e("tags"),
        F.lit("\n- **创建时间**: "), when, F.lit("\n"), need, F.lit("\n---\n\n"), _e("summary_markdown"),
    )


def stats_text() -> Column:
    latest = F.coalesce(F.nullif("latest_entry", F.lit("")), F.lit("无"))
    return F.concat(F.lit("## 知识库统计\n\n- **总笔记数**: "), F.col("total_entries"), F.lit("\n- **最新记录**: "), latest, F.lit("\n- **数据库路径**: "), F.col("store"), F.lit("\n"))
