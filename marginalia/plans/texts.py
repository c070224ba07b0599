"""Queries of the text functions over whole tables, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import markdown as md
from marginalia.functions import web
from marginalia.functions.times import epoch_micros, local_stamp
from marginalia.operators.chunks import as_sent, chunked
from marginalia.operators.like import keywords_column
from marginalia.sources.tables import read_table


def _texts(spark: SparkSession, sf_dir: str, f, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", f(F.col("text")).alias("out"), *columns)


def _summaries(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    return read_table(spark, sf_dir, "knowledge").select("id", f(F.col("summary_markdown")).alias("out"))


def cleanup_output(spark, sf_dir):
    """Documents wrapped in search blocks and cleaned again."""
    wrapped = lambda c: md.cleanup_output(F.concat(F.lit("\n\n<search>x\ny</search> \n<query>q</query>\n"), c))
    return _texts(spark, sf_dir, wrapped)


def latex_text(spark, sf_dir):
    return _texts(spark, sf_dir, lambda c: md.latex_text(F.regexp_replace(c, "the", r"\\text{the}")))


def formulas(spark, sf_dir):
    """Formulas of every note: block formulas, then inline ones."""
    return _summaries(spark, sf_dir, md.formulas).select("id", F.array_join("out", "|").alias("out"))


def colon_list(spark, sf_dir):
    return _summaries(spark, sf_dir, lambda c: md.each_line(F.regexp_replace(c, r"\r\n?", "\n"), md.colon_then_list))


def marker_spacing(spark, sf_dir):
    return _summaries(spark, sf_dir, lambda c: md.each_line(F.regexp_replace(c, r"\r\n?", "\n"), md.marker_spacing))


def blank_before_list(spark, sf_dir):
    return _summaries(spark, sf_dir, lambda c: md.blank_before_list(F.regexp_replace(c, r"\r\n?", "\n")))


def split_inline_list(spark, sf_dir):
    return _summaries(spark, sf_dir, md.split_inline_items)


def normalize_md(spark, sf_dir):
    return _summaries(spark, sf_dir, md.normalize_markdown)


def formulas_rendered(spark, sf_dir):
    return _summaries(spark, sf_dir, md.process_formulas)


def deliverable(spark, sf_dir):
    """The whole clean-up chain of a note up to normalised Markdown."""
    return _summaries(spark, sf_dir, lambda c: md.normalize_markdown(md.process_formulas(md.cleanup_output(c))))


def paren_depth(spark, sf_dir):
    """Bracket depth at the end of every title."""
    k = read_table(spark, sf_dir, "knowledge").where("title IS NOT NULL")
    return k.select("id", md.paren_depth(F.col("title"), F.length("title")).alias("depth"), md.paren_depth(F.col("title"), F.length("title") - 1).alias("inner_depth"))


def tags_from_bold(spark, sf_dir):
    return _summaries(spark, sf_dir, md.tags_from_bold)


def tags_clean(spark, sf_dir):
    return read_table(spark, sf_dir, "knowledge").select("id", md.tags_clean(F.col("tags")).alias("out"))


def context(spark, sf_dir):
    """The text given to the first enrichment stage: conditional lines."""
    some = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), F.col(c)))
    k = read_table(spark, sf_dir, "knowledge")
    return k.select("id", F.concat_ws("\n", F.lit("笔记："), some("标题：", "title"), some("作者：", "author"), some("\n要求：", "user_requirement")).alias("out"))


def truncations(spark, sf_dir):
    """Display forms of a note: code points, never bytes."""
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    k = read_table(spark, sf_dir, "knowledge")
    when = F.coalesce(F.nullif("timestamp", F.lit("")), F.substring("created_at", 1, 19))
    return k.select("id", cut("title", 60).alias("title"), cut("tags", 120).alias("tags"), cut("summary_markdown", 200).alias("snippet"), when.alias("shown_time"))


def note_times(spark, sf_dir):
    """Every note's time as microseconds; null if it is none."""
    return read_table(spark, sf_dir, "knowledge").select("id", epoch_micros(F.col("timestamp")).alias("micros"))


#: Hosts whose links are shares, a parameter of the operator.
SHARE_HOSTS = (
    "v.clipnest.example", "play.fernhub.example", "k.quartzlane.example", "www.reelbay.example", "m.tidecast.example", "live.orchardtv.example", "s.pinefeed.example",
    "go.mossline.example", "old.saltreel.example",
)


def extract_url(spark, sf_dir):
    m = read_table(spark, sf_dir, "messages").where("content IS NOT NULL")
    return m.select("msg_id", "ts", web.extract_url(F.col("content"), SHARE_HOSTS).alias("url"))


def extract_url_glued(spark, sf_dir):
    """Links with text right behind them and a page of another host before them."""
    m = read_table(spark, sf_dir, "messages").where("content IS NOT NULL")
    glued = F.concat(F.lit("见 https://example.org/about 和"), F.regexp_replace("content", r"(https?://\S+)\s*", "（$1）复制此链接!"))
    return m.select("msg_id", "ts", web.extract_url(glued, SHARE_HOSTS).alias("url"))


def share_requirement(spark, sf_dir):
    m = read_table(spark, sf_dir, "messages").where("content IS NOT NULL")
    url = web.extract_url(F.col("content"), SHARE_HOSTS)
    return m.select("msg_id", "ts", web.requirement(F.col("content"), url).alias("requirement"))


def video_id_from_url(spark, sf_dir):
    return read_table(spark, sf_dir, "share_pages").select("page_id", web.video_id(F.col("url")).alias("video_id"))


def page_title(spark, sf_dir):
    return read_table(spark, sf_dir, "share_pages").select("page_id", web.page_title(F.col("html")).alias("title"))


def router_json(spark, sf_dir):
    h = F.col("html")
    p = read_table(spark, sf_dir, "share_pages")
    return p.select("page_id", web.page_item(h, "desc").alias("title"), web.page_item(h, "author.nickname").alias("author"), web.play_url(h).alias("video_url"))


def chunk_text(spark, sf_dir):
    return chunked(read_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def chunk_sent(spark, sf_dir):
    """The parts as they are sent, numbered from the second on."""
    return as_sent(chunked(read_table(spark, sf_dir, "documents"), "doc_id", "text")).select(F.col("key").alias("doc_id"), "part_no", "part")


def chunk_markdown(spark, sf_dir):
    return chunked(read_table(spark, sf_dir, "knowledge"), "id", "summary_markdown", markdown=True).withColumnRenamed("key", "id")


def chunk_reassembled(spark, sf_dir):
    """The parts of every document put together again."""
    parts = chunk_text(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("part_no", "part"))).alias("p"))
    return parts.select("doc_id", F.array_join("p.part", "").alias("text"))


def keywords(spark, sf_dir):
    """Every message read as a search: its keywords."""
    m = read_table(spark, sf_dir, "messages").where("content IS NOT NULL")
    return m.select("msg_id", "ts", F.array_join(keywords_column(F.col("content")), "|").alias("keywords"))


def merged_requirements(spark, sf_dir):
    """The requirement of every note, replaced by what its title says as a later message would."""
    k = read_table(spark, sf_dir, "knowledge")
    return k.select("id", web.merged_requirement(F.col("user_requirement"), F.when(F.col("id") % 3 == 0, F.lit(" OK ")).when(F.col("id") % 3 == 1, F.col("title"))).alias("requirement"))


def stamps(spark, sf_dir):
    """The local time of every message."""
    return read_table(spark, sf_dir, "messages").select("msg_id", "ts", local_stamp(F.col("ts")).alias("stamp"))


QUERIES = {
    f.__name__: f
    for f in (
        cleanup_output, latex_text, formulas, colon_list, marker_spacing, blank_before_list, split_inline_list, normalize_md, formulas_rendered, deliverable, paren_depth,
        tags_from_bold, tags_clean, context, truncations, note_times, extract_url, extract_url_glued, share_requirement, video_id_from_url, page_title, router_json, chunk_text, chunk_sent, chunk_markdown, chunk_reassembled, stamps, keywords, merged_requirements,
    )
}

_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_LF = r"regexp_replace(summary_markdown, '\r\n?', chr(10), 'g')"
_LINES = f"string_split({_LF}, chr(10))"
_JSON = r"regexp_extract(html, 'window\._ROUTER_DATA\s*=\s*(.*?)</script>', 1, 's')"
_HOST = r"https?://(?:v\.clipnest|play\.fernhub|k\.quartzlane|www\.reelbay|m\.tidecast|live\.orchardtv|s\.pinefeed|go\.mossline|old\.saltreel)\.example"


def _strip(x: str) -> str:
    return _STRIP.format(x)


_INFO = f"""j AS (SELECT page_id, CASE WHEN json_valid(trim({_JSON}, ' ' || chr(10))) THEN CAST(trim({_JSON}, ' ' || chr(10)) AS JSON) END AS j FROM share_pages),
i AS (SELECT page_id, coalesce(json_extract(j, '$.loaderData."video_(id)/page".videoInfoRes'), json_extract(j, '$.loaderData."note_(id)/page".videoInfoRes')) AS i FROM j)"""
_FORMS = rf"""regexp_extract(regexp_replace(content, '{_HOST}/(?:share/)?video/[0-9]+', ' ', 'g'), '{_HOST}/[A-Za-z0-9_\-]+/?') AS s,
    regexp_extract(content, '{_HOST}/video/[0-9]+') AS v, regexp_extract(content, '{_HOST}/share/video/[0-9]+') AS w"""
_URL = "CASE WHEN s != '' THEN rtrim(s, '/') || '/' WHEN v != '' THEN v WHEN w != '' THEN w END"


def _depth(text: str) -> str:
    """Brackets opened and not closed, never under 0."""
    step = "CASE WHEN x IN ('(', '（', '[', '【') THEN 1 WHEN x IN (')', '）', ']', '】') THEN -1 ELSE 0 END"
    return f"CAST(list_reduce(list_prepend(0, list_transform(string_split({text}, ''), lambda x: {step})), lambda a, b: greatest(a + b, 0)) AS INT)"


# one step for each place where blanks stand before a list mark: cut there, or go on behind it; places count from 0
_ENDS = r"""[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{ff01}-\x{ff60}\x{3000}-\x{303f}a-zA-Z)\]>»）】》''"\x{201d}\x{300d}.!?？。！%‰]"""
_MARK = r"(?:[*\-+][ \t]+|[0-9]{1,3}\.[ \t]+)"


def _split(lines: str) -> str:
    """CTEs up to ``p`` (id, n, k, piece, stays): the pieces of every line of the CTEs ``lines`` up to ``n`` (id, n, line, stays)."""
    return rf"""WITH RECURSIVE {lines},
      c AS (SELECT id, n, line, stays, 0 AS k, 0::BIGINT AS begin, length(regexp_extract(line, '^{_MARK}')) AS spot, NULL::VARCHAR AS piece, stays OR starts_with(line, '#') AS over FROM n
        UNION ALL SELECT id, n, line, stays, k + 1, CASE WHEN cut THEN gap_end ELSE begin END, CASE WHEN cut THEN gap_end + length(regexp_extract(substr(line, gap_end + 1), '^{_MARK}')) ELSE gap_end + 1 END,
          CASE WHEN cut THEN substr(line, begin + 1, gap - begin) END, gap IS NULL FROM (
            SELECT *, coalesce(gap > begin AND regexp_full_match(substr(line, gap, 1), '{_ENDS}') AND {_depth('substr(line, begin + 1, gap - begin)')} = 0, false) AS cut FROM (
              SELECT *, CASE WHEN g.b != '' THEN spot + length(g.a) END AS gap, CASE WHEN g.b != '' THEN spot + length(g.a) + length(g.b) END AS gap_end FROM (
                SELECT *, regexp_extract(substr(line, spot + 1), '^(.*?)([ \t]+)(?:[*\-+][ \t]|[0-9]{{1,3}}\.[ \t])', ['a', 'b']) AS g FROM c WHERE NOT over)))),
      p AS (SELECT id, n, k, piece, stays FROM c WHERE piece IS NOT NULL UNION ALL SELECT id, n, max(k) + 1, substr(any_value(line), max(begin) + 1), any_value(stays) FROM c GROUP BY id, n)"""


_JOINED = "s AS (SELECT id, n, string_agg(piece, chr(10) || chr(10) ORDER BY k) AS line FROM p GROUP BY id, n), o AS (SELECT id, string_agg(line, chr(10) ORDER BY n) AS out FROM s GROUP BY id)"
_SPLIT_ALL = f"""{_split("l AS (SELECT id, string_split(summary_markdown, chr(10)) AS l FROM knowledge WHERE summary_markdown IS NOT NULL), n AS (SELECT id, generate_subscripts(l, 1) AS n, unnest(l) AS line, false AS stays FROM l)")}, {_JOINED}
      SELECT k.id, o.out FROM knowledge k LEFT JOIN o ON o.id = k.id"""
# formulas are one character each while lines are looked at
_FORM = r"\$\$.+?\$\$|\$[^$\n]+?\$|```math\s*\n.+?\n```"
_PREPARED = rf"""f AS (SELECT id, regexp_extract_all({_LF}, '{_FORM}', 0, 's') AS f, regexp_replace({_LF}, '{_FORM}', chr(57344), 'gs') AS s FROM knowledge WHERE summary_markdown IS NOT NULL),
      a AS (SELECT id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT id, string_split(s, chr(10)) AS l FROM f)),
      b AS (SELECT *, starts_with({_strip('line')}, '```') AS fence, {_strip('line')} AS bare FROM a), w AS (SELECT *, sum(CAST(fence AS INT)) OVER (PARTITION BY id ORDER BY i) AS fences FROM b),
      v AS (SELECT id, i, line, fence OR fences % 2 = 1 OR bare = '' OR regexp_matches(bare, '^(#|>|---|===)') AS stays FROM w),
      u AS (SELECT id, i, stays, string_split(CASE WHEN stays THEN line ELSE regexp_replace(line, '^(.*[：:])\s*([*\-+]|\d{{1,3}}\.)([ \t]+.+)$', '\1' || chr(10) || chr(10) || '\2\3') END, chr(10)) AS l FROM v),
      n AS (SELECT id, i * 100000 + generate_subscripts(l, 1) AS n, unnest(l) AS line, stays FROM u)"""
_NORMAL = rf"""{_split(_PREPARED)}, q AS (SELECT id, n, k, CASE WHEN stays OR starts_with(piece, '**') THEN piece ELSE regexp_replace(piece, '^([*\-+])([^\s])', '\1 \2') END AS piece FROM p), {_JOINED.replace('FROM p ', 'FROM q ')},
      r AS (SELECT o.id, array_to_string(list_transform(string_split(out, chr(57344)), lambda x, i: x || coalesce(f[i], '')), '') AS t FROM o JOIN f ON f.id = o.id),
      z AS (SELECT id, string_split(t, chr(10)) AS l, list_transform(string_split(t, chr(10)), lambda x: {_strip('x')}) AS h FROM r),
      y AS (SELECT id, array_to_string(flatten(list_transform(l, lambda x, i: CASE WHEN h[i] != '' AND i < len(l) AND (regexp_matches(h[i + 1], '^[*\-+]\s+') OR regexp_matches(h[i + 1], '^\d+\.\s+'))
          AND (regexp_matches(h[i], '[：:]$') OR NOT (regexp_matches(h[i], '^[#>\-*+]') OR regexp_matches(h[i], '^\d+\.'))) THEN [x, ''] ELSE [x] END)), chr(10)) AS out FROM z)
      SELECT k.id, y.out FROM knowledge k LEFT JOIN y ON y.id = k.id"""
_RENDERED = r"""regexp_replace(regexp_replace(regexp_replace(summary_markdown, '\$\$\s*(.+?)\s*\$\$', chr(10) || chr(10) || '<pre><code>\1</code></pre>' || chr(10) || chr(10), 'gs'),
        '```math\s*\n\s*(.+?)\s*\n```', chr(10) || chr(10) || '<pre><code>\1</code></pre>' || chr(10) || chr(10), 'gs'), '\$\s*([^$\n]+?)\s*\$', '<code>\1</code>', 'g')"""
_CLEANED = rf"""x AS (SELECT id, ltrim(regexp_replace(regexp_replace(summary_markdown, '<search>.*?</search>\s*', '', 'gs'), '<query>.*?</query>\s*', '', 'gs'), chr(10)) AS s FROM knowledge),
      cleaned AS (SELECT id, coalesce(nullif(regexp_extract(s, '(?:^|\n)(#\s+[^\n]+.*)$', 1, 's'), ''), s) AS summary_markdown FROM x), rendered AS (SELECT id, {_RENDERED} AS summary_markdown FROM cleaned)"""
_DELIVERABLE = _NORMAL.replace("FROM knowledge", "FROM rendered").replace("WITH RECURSIVE ", f"WITH RECURSIVE {_CLEANED}, ", 1)
_FIT = "len(list_filter(range(1, length({0}) + 1), lambda i: octet_length(encode(substr({0}, 1, i))) <= 2000))"
_LINE = "length(regexp_extract({0}, '^.*\n', 0, 's'))"
_PARTS = f"""WITH RECURSIVE c AS (SELECT doc_id, 0 AS i, '' AS part, text AS rest FROM documents WHERE text != ''
      UNION ALL SELECT doc_id, i + 1, substr(rest, 1, cut), substr(rest, cut + 1) FROM (
        SELECT doc_id, i, rest, CASE WHEN fit >= length(rest) THEN length(rest) WHEN strpos(head, chr(10)) > 0 AND {_LINE.format('head')} - 1 > fit // 2 THEN {_LINE.format('head')} ELSE fit END AS cut FROM (
          SELECT doc_id, i, rest, fit, substr(rest, 1, fit) AS head FROM (SELECT doc_id, i, rest, CASE WHEN octet_length(encode(rest)) <= 2000 THEN length(rest) ELSE {_FIT.format('substr(rest, 1, 2000)')} END AS fit FROM c WHERE rest != '')))),
      p AS (SELECT doc_id, i, part FROM c WHERE i > 0)"""

ORACLE = {
    "cleanup_output": r"""WITH a AS (SELECT doc_id, ltrim(regexp_replace(regexp_replace(chr(10) || chr(10) || '<search>x' || chr(10) || 'y</search> ' || chr(10) || '<query>q</query>' || chr(10) || text,
        '<search>.*?</search>\s*', '', 'gs'), '<query>.*?</query>\s*', '', 'gs'), chr(10)) AS s FROM documents)
        SELECT doc_id, CASE WHEN regexp_extract(s, '(?:^|\n)(#\s+[^\n]+.*)$', 1, 's') != '' THEN regexp_extract(s, '(?:^|\n)(#\s+[^\n]+.*)$', 1, 's') ELSE s END AS out FROM a""",
    "latex_text": r"SELECT doc_id, replace(text, 'the', '\mathrm{the}') AS out FROM documents",
    "colon_list": rf"""SELECT id, array_to_string(list_transform({_LINES}, lambda x: regexp_replace(x, '^(.*[：:])\s*([*\-+]|\d{{1,3}}\.)([ \t]+.+)$', '\1' || chr(10) || chr(10) || '\2\3')), chr(10)) AS out FROM knowledge""",
    "marker_spacing": rf"""SELECT id, array_to_string(list_transform({_LINES}, lambda x: CASE WHEN starts_with(x, '**') THEN x ELSE regexp_replace(x, '^([*\-+])([^\s])', '\1 \2') END), chr(10)) AS out FROM knowledge""",
    "blank_before_list": rf"""WITH l AS (SELECT id, {_LINES} AS l FROM knowledge), s AS (SELECT id, l, list_transform(l, lambda x: {_strip('x')}) AS s FROM l)
        SELECT id, array_to_string(flatten(list_transform(l, lambda x, i: CASE WHEN s[i] != '' AND i < len(l) AND (regexp_matches(s[i + 1], '^[*\-+]\s+') OR regexp_matches(s[i + 1], '^\d+\.\s+'))
          AND (regexp_matches(s[i], '[：:]$') OR NOT (regexp_matches(s[i], '^[#>\-*+]') OR regexp_matches(s[i], '^\d+\.'))) THEN [x, ''] ELSE [x] END)), chr(10)) AS out FROM s""",
    "paren_depth": f"SELECT id, {_depth('title')} AS depth, {_depth('substr(title, 1, length(title) - 1)')} AS inner_depth FROM knowledge WHERE title IS NOT NULL",
    "tags_from_bold": rf"""WITH t AS (SELECT id, list_filter(list_transform(regexp_extract_all(summary_markdown, '\*\*([^*]+)\*\*', 1), lambda x: {_strip('x')}), lambda x: length(x) >= 2) AS t FROM knowledge)
        SELECT id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i)[1:15], ',') AS out FROM t""",
    "tags_clean": rf"""SELECT id, array_to_string(list_transform(list_filter(string_split(regexp_replace(tags, '[、，]', ',', 'g'), ','), lambda x: {_strip('x')} != ''), lambda x: {_strip("regexp_replace(" + _strip('x') + ", '^#+', '')")}), ',') AS out FROM knowledge""",
    "context": """SELECT id, concat_ws(chr(10), '笔记：', CASE WHEN title != '' THEN '标题：' || title END, CASE WHEN author != '' THEN '作者：' || author END, CASE WHEN user_requirement != '' THEN chr(10) || '要求：' || user_requirement END) AS out FROM knowledge""",
    "truncations": "SELECT id, substr(coalesce(title, ''), 1, 60) AS title, substr(coalesce(tags, ''), 1, 120) AS tags, substr(coalesce(summary_markdown, ''), 1, 200) AS snippet, coalesce(nullif(timestamp, ''), substr(created_at, 1, 19)) AS shown_time FROM knowledge",
    "extract_url": f"SELECT msg_id, ts, {_URL} AS url FROM (SELECT *, {_FORMS} FROM messages WHERE content IS NOT NULL)",
    "extract_url_glued": f"SELECT msg_id, ts, {_URL} AS url FROM (SELECT *, {_FORMS} FROM messages WHERE content IS NOT NULL)",
    "video_id_from_url": r"""WITH p AS (SELECT page_id, string_split(url, '?')[1] AS p FROM share_pages) SELECT page_id, CASE WHEN regexp_matches(string_split(p, '/')[-1], '^\d+$') OR regexp_extract(p, '(\d{19})', 1) = ''
        THEN string_split(p, '/')[-1] ELSE regexp_extract(p, '(\d{19})', 1) END AS video_id FROM p""",
    "page_title": "SELECT page_id, nullif(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '') AS title FROM share_pages",
    "router_json": f"""WITH {_INFO}, u AS (SELECT *, replace(json_extract_string(i, '$.item_list[0].video.play_addr.url_list[0]'), 'playwm', 'play') AS u FROM i)
        SELECT page_id, json_extract_string(i, '$.item_list[0].desc') AS title, json_extract_string(i, '$.item_list[0].author.nickname') AS author, CASE WHEN u LIKE '//%' THEN 'https:' || u ELSE u END AS video_url FROM u""",
    "chunk_reassembled": "SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text != ''",
    "keywords": r"SELECT msg_id, ts, array_to_string(list_filter(regexp_split_to_array(content, '[,，\s\p{Z}\x1c-\x1f\x{85}]+'), lambda k: k != ''), '|') AS keywords FROM messages WHERE content IS NOT NULL",
    "merged_requirements": "SELECT id, CASE WHEN id % 3 = 1 AND coalesce(title, '') != '' AND lower(trim(title)) NOT IN ('开始', 'start', 'ok', '好') THEN title ELSE user_requirement END AS requirement FROM knowledge",
    # without looks around: double dollars go first, so that single ones are left
    "formulas": rf"""WITH f AS (SELECT id, list_concat(regexp_extract_all(summary_markdown, '\$\$(.+?)\$\$', 1, 's'), regexp_extract_all(regexp_replace(summary_markdown, '\$\$.+?\$\$', '', 'gs'), '\$([^$\n]+?)\$', 1)) AS f FROM knowledge)
      SELECT id, array_to_string(list_transform(f, lambda x: {_strip('x')}), '|') AS out FROM f""",
    "formulas_rendered": f"SELECT id, {_RENDERED} AS out FROM knowledge",
    "deliverable": _DELIVERABLE,
    "split_inline_list": _SPLIT_ALL,
    "normalize_md": _NORMAL,
    "stamps": "SELECT msg_id, ts, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS stamp FROM messages",
    # the sender's rule, one part after the other: cut where 2,000 bytes are full, or behind the last line end of the second half
    "chunk_sent": f"{_PARTS} SELECT doc_id, CAST(i AS INT) AS part_no, CASE WHEN i > 1 THEN '[' || i || '/' || max(i) OVER (PARTITION BY doc_id) || ']' || chr(10) ELSE '' END || part AS part FROM p",
    "chunk_text": f"{_PARTS} SELECT doc_id, CAST(i AS INT) AS part_no, CAST(max(i) OVER (PARTITION BY doc_id) AS INT) AS n_parts, part FROM p",
    "chunk_markdown": r"""WITH RECURSIVE k AS (SELECT id, string_split(summary_markdown, chr(10)) AS l FROM knowledge WHERE summary_markdown IS NOT NULL),
      n AS (SELECT id, generate_subscripts(l, 1) AS i, unnest(l) || chr(10) AS line FROM k), b AS (SELECT *, octet_length(encode(line)) AS size FROM n),
      r AS (SELECT id, i, line, size, 1 AS part_no FROM b WHERE i = 1
        UNION ALL SELECT b.id, b.i, b.line, CASE WHEN r.size + b.size > 1800 THEN b.size ELSE r.size + b.size END, CASE WHEN r.size + b.size > 1800 THEN r.part_no + 1 ELSE r.part_no END FROM r JOIN b ON b.id = r.id AND b.i = r.i + 1)
      SELECT id, part_no, CAST(max(part_no) OVER (PARTITION BY id) AS INT) AS n_parts, string_agg(line, '' ORDER BY i) AS part FROM r GROUP BY id, part_no""",
    "note_times": r"""WITH p AS (SELECT id, timestamp AS t, regexp_extract(timestamp, '^\s*(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})日?[T ]*(\d{1,2}):(\d{1,2}):(\d{1,2})\s*(Z|[+-]\d{2}:\d{2})?\s*$', ['y','m','d','h','i','s','z']) AS r FROM knowledge)
        SELECT id, CASE WHEN regexp_full_match(t, '\d{10}') THEN TRY_CAST(t AS BIGINT) * 1000000 WHEN regexp_full_match(t, '\d{13}') THEN TRY_CAST(t AS BIGINT) * 1000
          WHEN r.y != '' AND r.y != '0000' THEN epoch_us(make_timestamp(TRY_CAST(r.y AS BIGINT), TRY_CAST(r.m AS BIGINT), TRY_CAST(r.d AS BIGINT), TRY_CAST(r.h AS BIGINT), TRY_CAST(r.i AS BIGINT), TRY_CAST(r.s AS DOUBLE)))
            - CASE WHEN r.z = 'Z' THEN 0 WHEN r.z = '' THEN 480 ELSE TRY_CAST(r.z[1:3] AS BIGINT) * 60 + TRY_CAST(r.z[1:1] || r.z[5:6] AS BIGINT) END * 60000000 END AS micros FROM p""",
}


def _requirement_sql() -> str:
    """The cleaners one after the other; blanks of all scripts, as RE2 knows only ASCII ones."""
    x = _strip("CASE WHEN coalesce(url, '') = '' THEN content ELSE replace(content, url, ' ') END")
    for rx in web.CLEANERS:
        rx = rx.replace(r"[^\s", r"[^\s\p{Z}").replace("'", "''")
        rx = re.sub(r"(?<!\^)\\s(?!\\p)", lambda m: r"[\s\p{Z}]", rx).replace(r"\d", r"\p{Nd}")
        x = f"regexp_replace({x}, '{rx}', ' ', 'g')"
    x = _strip("regexp_replace(" + x + r", '[\s\p{Z}]+', ' ', 'g')")
    return f"WITH u AS (SELECT msg_id, ts, content, {_URL} AS url FROM (SELECT *, {_FORMS} FROM messages WHERE content IS NOT NULL)) SELECT msg_id, ts, {x} AS requirement FROM u"


ORACLE["share_requirement"] = _requirement_sql()
