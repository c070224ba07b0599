"""URLs, share texts, share pages and XML envelopes as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import ustrip

ANY_HOST = r"[A-Za-z0-9.\-]+"


def share_shapes(hosts: Sequence[str] = ()) -> tuple[str, str, str]:
    """Expressions of share URLs at the given hosts (or any host), by priority: short link, video page, share page.

    A link ends before the first character that can't belong to it.
    """
    host = "https?://(?:" + ("|".join(re.escape(h) for h in hosts) or ANY_HOST) + ")"
    return rf"{host}/(?!(?:share/)?video/[0-9])[A-Za-z0-9_\-]+/?", rf"{host}/video/[0-9]+", rf"{host}/share/video/[0-9]+"

# What is taken out of a share text, in this order.
CLEANERS = (
    r"\d+\.?\d*\s+", r"复制.*?打开.*?抖音[，,]?\s*", r"看看[【\[]?[^】\]]*?的作品[】\]]?\s*", r"#\s*[^\s#]+\s*", r"@[^\s@]+\s*",
    r"\"[^\"]*\.\.\.\s*", r"[A-Za-z]{2,4}:[/\\]\s*", r"[a-zA-Z]@[A-Za-z]\.[A-Z]{2}\s*", r"\d{1,2}/\d{1,2}\s*",
)


def _found(c: Column) -> Column:
    return F.when(c != "", c)


def extract_url(text: Column, hosts: Sequence[str] = ()) -> Column:
    """The share URL of a text, by priority of shape; a short link ends with a slash. Null if there is none.

    With ``hosts`` only links to those count, so that an ordinary page in the text is passed over.
    """
    short, video, share = (_found(F.regexp_extract(text, shape, 0)) for shape in share_shapes(hosts))
    short = F.when(short.endswith("/"), short).otherwise(F.concat(short, F.lit("/")))
    return F.coalesce(short, video, share)


def requirement(text: Column, url: Column) -> Column:
    """What a share text says besides the URL and the template phrases."""
    s = ustrip(F.when(F.coalesce(url, F.lit("")) == "", text).otherwise(F.replace(text, url, F.lit(" "))))
    for rx in CLEANERS:
        s = F.regexp_replace(s, f"(?U){rx}", " ")
    return ustrip(F.regexp_replace(s, r"(?U)\s+", " "))


def video_id(url: Column) -> Column:
    """Last path segment; unless it is all digits, the first run of 19 digits, if there is one."""
    path = F.get(F.split(url, r"\?"), 0)
    segment = F.element_at(F.split(path, "/", -1), -1)
    run = F.regexp_extract(path, r"(\d{19})", 1)
    return F.when(segment.rlike(r"^\d+$") | (run == ""), segment).otherwise(run)


def page_title(html: Column) -> Column:
    return _found(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def router_json(html: Column) -> Column:
    """The JSON of a share page's script; null if there is no script."""
    return _found(ustrip(F.regexp_extract(html, r"(?s)window\._ROUTER_DATA\s*=\s*(.*?)</script>", 1)))


def page_item(html: Column, what: str) -> Column:
    """A field of the first item of a page, e.g. ``desc``; from the video key, else the note key.

    Null for a missing script, broken JSON, an empty list or a missing field.
    """
    j = router_json(html)
    pick = lambda key: F.get_json_object(j, f"$.loaderData['{key}'].videoInfoRes")
    info = F.coalesce(pick("video_(id)/page"), pick("note_(id)/page"))
    return F.get_json_object(info, f"$.item_list[0].{what}")


def play_url(html: Column) -> Column:
    """The address of the video without watermark, with a scheme."""
    url = F.replace(page_item(html, "video.play_addr.url_list[0]"), F.lit("playwm"), F.lit("play"))
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)


def message_fields(xml: Column) -> list[Column]:
    """The fields of a message envelope; optional ones are empty when missing."""
    names = {"MsgType": "msg_type", "FromUserName": "from_user", "MsgId": "msg_id", "CreateTime": "create_time", "Content": "content"}
    return [F.coalesce(F.xpath_string(xml, F.lit(f"/xml/{k}")), F.lit("")).alias(v) for k, v in names.items()]


def message_xml(**fields: Column) -> Column:
    """A message envelope; values in CDATA sections, null values left out."""
    names = {"msg_type": "MsgType", "from_user": "FromUserName", "msg_id": "MsgId", "create_time": "CreateTime", "content": "Content"}
    parts = [F.lit("<xml>")]
    for k, v in fields.items():
        text = F.replace(v, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
        parts.append(F.coalesce(F.concat(F.lit(f"<{names[k]}><![CDATA["), text, F.lit(f"]]></{names[k]}>")), F.lit("")))
    return F.concat(*parts, F.lit("</xml>"))


def merged_requirement(inline: Column, extra: Column) -> Column:
    """The inline requirement, replaced by an extra one unless that is empty or a start word."""
    from marginalia.functions.requirements import START_WORDS

    extra = F.coalesce(extra, F.lit(""))
    return F.when((extra == "") | F.lower(ustrip(extra)).isin(*START_WORDS), inline).otherwise(extra)
