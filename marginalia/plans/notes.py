"""Queries over the note store, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import ASCII_LOWER, ASCII_UPPER
from marginalia.operators import fts, render, search
from marginalia.operators.like import has
from marginalia.operators.postings import PostingsIndex, index_of
from marginalia.operators.shared import new_folder
from marginalia.operators.store import TIES, NoteStore, code_collisions, numbered, upsert, upsert_parts, video_code
from marginalia.schema import NOTE_COLUMNS
from marginalia.sources.tables import read_table

TAG, WORDS, TITLE_AUTHOR = "AI编程", "compiler 线程池 beekeeping", ("关于烘烤的3个提醒", "青禾夜读")
NOW, STAMP = "2026-01-01T00:00:00+00:00", "2026-01-01 08:00:00"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "knowledge")


def _store(spark: SparkSession, sf_dir: str) -> NoteStore:
    return NoteStore(_notes(spark, sf_dir), "knowledge")


def list_recent(spark, sf_dir):
    return _store(spark, sf_dir).list_recent(20)


def list_recent_offset(spark, sf_dir):
    return _store(spark, sf_dir).list_recent(20, 40)


def list_by_tag(spark, sf_dir):
    return _store(spark, sf_dir).list_by_tag(TAG)


def list_by_tag_wildcard(spark, sf_dir):
    """A keyword with LIKE wildcards."""
    return _store(spark, sf_dir).list_by_tag("C_+%")


def get_by_id(spark, sf_dir):
    return _store(spark, sf_dir).get_by_id(17)


def get_by_code(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    code = notes.agg(F.min("video_code")).first()[0]
    return NoteStore(notes).get_by_code(code)


def get_latest_by_video_id(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    return NoteStore(notes).get_by_video_id(notes.where("video_id RLIKE '^[0-9]{19}$'").agg(F.min("video_id")).first()[0])


def dup_lookup(spark, sf_dir):
    """All notes of the most frequent pair of title and author, newest first."""
    notes = _notes(spark, sf_dir)
    pairs = notes.where("title != '' AND author != ''").groupBy("title", "author").count()
    top = pairs.orderBy(F.desc("count"), "title", "author").first()
    return NoteStore(notes).by_title_and_author(top["title"], top["author"])


def dup_flag_semi(spark, sf_dir):
    """Rows of the batch whose title and author are already in the store."""
    batch = read_table(spark, sf_dir, "note_upserts").select("arrival", "title", "author")
    return batch.join(_notes(spark, sf_dir).select("title", "author"), ["title", "author"], "left_semi").select("arrival", "title", "author")


def dup_latest(spark, sf_dir):
    """For each row of the batch the newest stored note of its title and author."""
    batch = read_table(spark, sf_dir, "note_upserts").select("arrival", "title", "author")
    return _store(spark, sf_dir).duplicates(batch)


def stats(spark, sf_dir):
    return _store(spark, sf_dir).stats()


def stats_empty(spark, sf_dir):
    return NoteStore(_notes(spark, sf_dir).where("id < 0"), "knowledge").stats()


def search_tags(spark, sf_dir):
    return _notes(spark, sf_dir).where(has(F.col("tags"), TAG)).select("id", "tags")


def search_like(spark, sf_dir):
    hit = has(F.col("title"), "Event Loop") | has(F.col("summary_markdown"), "Event Loop") | has(F.col("tags"), "Event Loop")
    return _notes(spark, sf_dir).where(hit).select("id", "title", F.substring("summary_markdown", 1, 200).alias("snippet"))


def search_precise(spark, sf_dir):
    return search.search_precise(_notes(spark, sf_dir), "编译器,线程池", 50)


def _index(spark, sf_dir) -> PostingsIndex:
    return index_of(_notes(spark, sf_dir), new_folder(spark, "postings"))


def fts_index(spark, sf_dir):
    """Tokens of the index of all notes, with their notes and places."""
    rows = _index(spark, sf_dir).postings()
    return rows.groupBy("token").agg(F.countDistinct("id").alias("notes"), F.count("*").alias("occurrences"))


def fts_index_after_upserts(spark, sf_dir):
    """The same after the batch of note_upserts came as a delta: postings of its notes only."""
    notes = _notes(spark, sf_dir)
    parts = upsert_parts(notes, read_table(spark, sf_dir, "note_upserts"), NOW, STAMP)
    top = notes.agg(F.max("id")).first()[0] or 0
    fresh = numbered(parts.fresh, ["arrival", "video_code", *TIES], top, "id")
    index = PostingsIndex(spark, new_folder(spark, "postings")).apply(notes).apply(parts.after.select(NOTE_COLUMNS).unionByName(fresh.select(NOTE_COLUMNS)))
    return index.postings().groupBy("token").agg(F.countDistinct("id").alias("notes"), F.count("*").alias("occurrences"))


def fts_tokens(spark, sf_dir):
    """Postings of titles and tags, counted by note."""
    return fts.postings(_notes(spark, sf_dir)).groupBy("id", "col").agg(F.count("*").alias("n_tokens"), F.countDistinct("token").alias("n_distinct"))


def fts_df(spark, sf_dir):
    return fts.document_frequency(_notes(spark, sf_dir))


def fts_doclen(spark, sf_dir):
    size = sum((F.size(fts.tokens(F.col(c))) for c in fts.COLUMNS), F.lit(0))
    return _notes(spark, sf_dir).select("id", size.cast("long").alias("n_tokens"))


def fts_bm25_topk(spark, sf_dir):
    scores = _index(spark, sf_dir).bm25_many({0: fts.parse_match(["compiler", "线程池", "beekeeping"])})
    return scores.select("id", F.round("rank", 6).alias("rank")).orderBy("rank", "id").limit(50)


def search_composite(spark, sf_dir):
    return search.search_many(_notes(spark, sf_dir), [WORDS], 40, _index(spark, sf_dir)).select("place", "id", "strategy")


def search_batched(spark, sf_dir):
    return search.search_many(_notes(spark, sf_dir), ["AI编程，智能体", "C++ foo", "", "beekeeping", "a_b"], 15, _index(spark, sf_dir))


def search_columns(spark, sf_dir):
    """``search_notes`` without its snippets."""
    return search_notes(spark, sf_dir).drop("snippet")


def search_notes(spark, sf_dir):
    return search.search(_notes(spark, sf_dir), WORDS, 40, _index(spark, sf_dir))


def upsert_notes(spark, sf_dir):
    return upsert(_notes(spark, sf_dir), read_table(spark, sf_dir, "note_upserts"), NOW, STAMP)


def delete_by_id(spark, sf_dir):
    notes = _notes(spark, sf_dir)
    return NoteStore(notes).delete(notes.where("video_code IS NULL").select("id"))


def delete_by_code(spark, sf_dir):
    return _store(spark, sf_dir).delete_by_code(read_table(spark, sf_dir, "note_upserts").select("video_code"))


def codes_unique(spark, sf_dir):
    """The code generated for every note, and how many others have it too."""
    codes = _notes(spark, sf_dir).select("id", video_code(F.col("id")).alias("code"))
    return codes.join(code_collisions(codes, "code"), "code", "left").select("id", "code", (F.coalesce("n", F.lit(1)) - 1).alias("others"))


def render_search(spark, sf_dir):
    """The strict search's results as Markdown."""
    return search.search_precise(_notes(spark, sf_dir), "编译器,线程池", 50).select("id", render.search_entry().alias("line"))


def render_list(spark, sf_dir):
    """One Markdown line for each of the newest notes."""
    return _store(spark, sf_dir).list_recent(20, 40).select("id", render.list_entry().alias("line"))


def render_note(spark, sf_dir):
    """Every note as a whole Markdown document."""
    return _notes(spark, sf_dir).select("id", render.note_document().alias("text"))


def render_note_by_code(spark, sf_dir):
    """Every note as the document that a request by its code gives."""
    return _notes(spark, sf_dir).where("video_code IS NOT NULL").select("video_code", render.note_document(code=True).alias("text"))


def render_by_tag(spark, sf_dir):
    """One Markdown line for each of the newest notes with a tag."""
    return _store(spark, sf_dir).list_by_tag(TAG, 10).select("id", render.list_entry(code=False).alias("line"))


def fallbacks(spark, sf_dir):
    """Title, author, code and time of every note, with what is shown where they are missing; an empty code or time stays."""
    shown = [render.or_else(c, t).alias(c) for c, t in (("title", render.NO_TITLE), ("author", render.NO_AUTHOR))]
    shown += [F.coalesce(c, F.lit(t)).alias(c) for c, t in (("video_code", render.NO_CODE), ("timestamp", render.NO_TIME))]
    return _notes(spark, sf_dir).select("id", *shown)


def render_stats(spark, sf_dir):
    return stats(spark, sf_dir).select(render.stats_text().alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        list_recent, list_recent_offset, list_by_tag, list_by_tag_wildcard, get_by_id, get_by_code, get_latest_by_video_id, dup_lookup, dup_flag_semi, dup_latest, stats,
        stats_empty, search_tags, search_like, search_precise, fts_index, fts_index_after_upserts, fts_tokens, fts_df, fts_doclen, fts_bm25_topk, search_composite, search_batched, search_columns, search_notes, upsert_notes,
        delete_by_id, delete_by_code, codes_unique, render_search, render_list, render_note, render_note_by_code, render_by_tag, fallbacks, render_stats,
    )
}

# the SQL names columns and constants by itself, so that it can disagree with the code
_LIST = "id, video_id, title, author, tags, source_url, created_at, duration_seconds, video_code"
_ALL = "id, video_id, title, author, source_url, summary_markdown, tags, user_requirement, created_at, duration_seconds, video_code, timestamp"
_NEWEST = "ORDER BY created_at DESC NULLS LAST, id DESC"
_RESULT = "id, video_id, title, author, tags, source_url, created_at, duration_seconds, video_code, timestamp"
_SEARCHED = ["title", "author", "summary_markdown", "tags"]


def _fold(c: str) -> str:
    return f"translate({c}, '{ASCII_UPPER}', '{ASCII_LOWER}')"


def _has(c: str, word: str) -> str:
    return f"coalesce(contains({_fold(c)}, {_fold(repr(word))}), false)"


def _any(word: str, *columns: str) -> str:
    return "(" + " OR ".join(_has(c, word) for c in columns) + ")"


def _tokens(c: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


_POSTINGS = " UNION ALL ".join(f"SELECT id, '{c}' AS col, unnest({_tokens(c)}) AS token FROM knowledge" for c in _SEARCHED)
_LENGTH = " + ".join(f"len({_tokens(c)})" for c in _SEARCHED)


def _bm25(words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""
    p AS ({_POSTINGS}), l AS (SELECT id, created_at, {_LENGTH} AS d FROM knowledge), c AS (SELECT count(*) AS n, sum(d) AS total FROM l),
    f AS (SELECT id, token, count(*) AS f FROM p WHERE token IN ({listed}) GROUP BY id, token), df AS (SELECT token, count(*) AS n_t FROM f GROUP BY token),
    bm AS (SELECT f.id, any_value(l.created_at) AS created_at, -sum((CASE WHEN ln((c.n - n_t + 0.5) / (n_t + 0.5)) <= 0 THEN 1e-6 ELSE ln((c.n - n_t + 0.5) / (n_t + 0.5)) END)
        * f.f * 2.2 / (f.f + 1.2 * (0.25 + 0.75 * l.d / (c.total / c.n)))) AS rank FROM f JOIN df USING (token) JOIN l USING (id) CROSS JOIN c GROUP BY f.id)"""


def _search(queries: list[str], limit: int) -> str:
    from marginalia.operators.like import split_keywords

    bm, parts = "", []
    for q, query in enumerate(queries):
        words = split_keywords(query)
        for k, w in enumerate(words or [query.strip()]):
            for s, columns in ((1, ["tags"]), (3, ["title", "summary_markdown", "tags"])):
                if "_" in w:
                    like = w.lower()
                    hit = "(" + " OR ".join(f"coalesce({_fold(c)} LIKE '%{like}%', false)" for c in columns) + ")"
                else:
                    hit = _any(w, *columns) if w else "(" + " OR ".join(f"{c} IS NOT NULL" for c in columns) + ")"
                parts.append(f"SELECT {q} AS query_no, {s} AS strategy, {k} AS kw, row_number() OVER ({_NEWEST}) AS rk, id FROM knowledge WHERE {hit} QUALIFY rk <= {limit}")
        phrases = fts.parse_match(words)
        if phrases:
            name = f"q{q}"
            tokens = [w for p in phrases for w in p]
            if any(len(p) > 1 for p in phrases):
                bm += f", {name} AS (SELECT id, 0.0 AS rank FROM knowledge WHERE {' OR '.join(_phrase(p) for p in phrases)})"
            else:
                bm += f", {name} AS (WITH {_bm25(tokens)} SELECT id, round(rank, 9) AS rank FROM bm)"
            parts.append(f"SELECT {q}, 2, 0, row_number() OVER (ORDER BY rank, id) AS rk, id FROM {name} QUALIFY rk <= {limit}")
    union = " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)
    return f"""WITH x AS (SELECT 1){bm}, a AS ({union}), b AS (SELECT query_no, id, min(struct_pack(s := strategy, k := kw, r := rk)) AS spot FROM a GROUP BY query_no, id)
    SELECT query_no, row_number() OVER (PARTITION BY query_no ORDER BY spot) AS place, id, spot.s AS strategy FROM b QUALIFY place <= {limit}"""


def _phrase(p: list[str]) -> str:
    rx = "[^\\p{L}\\p{N}\\p{Co}]+".join(p)
    return "(" + " OR ".join(f"regexp_matches(strip_accents(lower(coalesce({c}, ''))), '(^|[^\\p{{L}}\\p{{N}}\\p{{Co}}]){rx}($|[^\\p{{L}}\\p{{N}}\\p{{Co}}])')" for c in _SEARCHED) + ")"


_TIES = "arrival, coalesce(created_at, ''), coalesce(title, ''), coalesce(author, ''), coalesce(summary_markdown, ''), coalesce(tags, ''), coalesce(user_requirement, ''), coalesce(video_id, ''), coalesce(source_url, '')"
_LAST = ", ".join(f"{t} DESC" for t in _TIES.replace(", ''", "|").split(", ")).replace("|", ", ''")
_OVER = ["title", "author", "summary_markdown", "tags", "user_requirement", "created_at", "timestamp"]
_KEEP = ["video_id", "source_url", "duration_seconds"]
UPSERT_SQL = f"""WITH u AS (SELECT * REPLACE (coalesce(nullif(created_at, ''), '{NOW}') AS created_at, '{STAMP}' AS timestamp) FROM note_upserts),
l AS (SELECT * FROM u WHERE video_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_code ORDER BY {_LAST}) = 1),
f AS (SELECT * FROM u WHERE video_code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY video_code ORDER BY {_TIES}) = 1),
old AS (SELECT k.id, {', '.join(f'k.{c}' for c in ['video_code', *_KEEP])}, {', '.join(f'CASE WHEN l.video_code IS NULL THEN k.{c} ELSE l.{c} END AS {c}' for c in _OVER)} FROM knowledge k LEFT JOIN l ON k.video_code = l.video_code),
fresh AS (SELECT f.arrival, f.video_code, {', '.join(f'f.{c}' for c in _KEEP)}, {', '.join(f'l.{c}' for c in _OVER)} FROM f JOIN l ON f.video_code = l.video_code
  WHERE NOT EXISTS (SELECT 1 FROM knowledge k WHERE k.video_code = f.video_code)
  UNION ALL SELECT arrival, video_code, {', '.join(_KEEP)}, {', '.join(_OVER)} FROM u WHERE video_code IS NULL),
new AS (SELECT (SELECT coalesce(max(id), 0) FROM knowledge) + row_number() OVER (ORDER BY arrival, video_code NULLS FIRST, created_at NULLS FIRST, title NULLS FIRST, author NULLS FIRST,
  summary_markdown NULLS FIRST, tags NULLS FIRST, user_requirement NULLS FIRST, video_id NULLS FIRST, source_url NULLS FIRST) AS id, * FROM fresh)
SELECT {_ALL} FROM old UNION ALL SELECT {_ALL} FROM new"""
_WHEN = "coalesce(nullif(timestamp, ''), created_at, '')"

ORACLE = {
    "list_recent": f"SELECT {_LIST} FROM knowledge {_NEWEST} LIMIT 20",
    "list_recent_offset": f"SELECT {_LIST} FROM knowledge {_NEWEST} LIMIT 20 OFFSET 40",
    "list_by_tag": f"SELECT {_LIST} FROM knowledge WHERE {_has('tags', TAG)} {_NEWEST} LIMIT 20",
    "list_by_tag_wildcard": f"SELECT {_LIST} FROM knowledge WHERE {_fold('tags')} LIKE '%c_+%' {_NEWEST} LIMIT 20",
    "get_by_id": "SELECT * FROM knowledge WHERE id = 17",
    "get_by_code": "SELECT * FROM knowledge WHERE video_code = (SELECT min(video_code) FROM knowledge)",
    "get_latest_by_video_id": f"SELECT * FROM knowledge WHERE video_id = (SELECT min(video_id) FROM knowledge WHERE regexp_full_match(video_id, '[0-9]{{19}}')) {_NEWEST} LIMIT 1",
    "dup_lookup": f"""WITH t AS (SELECT title, author FROM knowledge WHERE title != '' AND author != '' GROUP BY title, author ORDER BY count(*) DESC, title, author LIMIT 1)
        SELECT k.* FROM knowledge k JOIN t ON k.title = t.title AND k.author = t.author""",
    "dup_flag_semi": "SELECT arrival, title, author FROM note_upserts u WHERE EXISTS (SELECT 1 FROM knowledge k WHERE k.title = u.title AND k.author = u.author)",
    "dup_latest": """WITH l AS (SELECT * FROM knowledge WHERE title IS NOT NULL AND author IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY title, author ORDER BY coalesce(created_at, '') DESC, id DESC) = 1)
        SELECT u.arrival, u.title, u.author, l.id AS duplicate_id, l.video_code AS duplicate_code FROM note_upserts u LEFT JOIN l ON u.title = l.title AND u.author = l.author""",
    "stats": "SELECT count(*) AS total_entries, max(created_at) AS latest_entry, 'knowledge' AS store FROM knowledge",
    "stats_empty": "SELECT count(*) AS total_entries, max(created_at) AS latest_entry, 'knowledge' AS store FROM knowledge WHERE id < 0",
    "search_tags": f"SELECT id, tags FROM knowledge WHERE {_has('tags', TAG)}",
    "search_like": f"SELECT id, title, substr(summary_markdown, 1, 200) AS snippet FROM knowledge WHERE {_any('Event Loop', 'title', 'summary_markdown', 'tags')}",
    "search_precise": f"""SELECT {_RESULT}, substr(coalesce(summary_markdown, ''), 1, 200) AS snippet FROM knowledge
        WHERE {_any('编译器', 'tags', 'title', 'summary_markdown')} AND {_any('线程池', 'tags', 'title', 'summary_markdown')} {_NEWEST} LIMIT 50""",
    "fts_tokens": f"WITH p AS ({_POSTINGS}) SELECT id, col, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct FROM p GROUP BY id, col",
    "fts_index": f"WITH p AS ({_POSTINGS}) SELECT token, count(DISTINCT id) AS notes, count(*) AS occurrences FROM p GROUP BY token",
    "fts_index_after_upserts": f"WITH after AS ({UPSERT_SQL}), p AS ({_POSTINGS.replace('FROM knowledge', 'FROM after')}) SELECT token, count(DISTINCT id) AS notes, count(*) AS occurrences FROM p GROUP BY token",
    "fts_df": f"WITH p AS ({_POSTINGS}) SELECT token, count(DISTINCT id) AS notes, count(*) AS occurrences FROM p GROUP BY token",
    "fts_doclen": f"SELECT id, {_LENGTH} AS n_tokens FROM knowledge",
    "fts_bm25_topk": f"WITH {_bm25(['compiler', '线程池', 'beekeeping'])} SELECT id, round(rank, 6) AS rank FROM bm ORDER BY round(rank, 6), id LIMIT 50",
    "search_composite": f"SELECT place, id, strategy FROM ({_search([WORDS], 40)})",
    "search_columns": f"SELECT place, strategy, {_RESULT} FROM (SELECT place, id, strategy FROM ({_search([WORDS], 40)})) JOIN knowledge USING (id)",
    "search_batched": _search(["AI编程，智能体", "C++ foo", "", "beekeeping", "a_b"], 15),
    "upsert_notes": UPSERT_SQL,
    "delete_by_id": "SELECT * FROM knowledge WHERE video_code IS NOT NULL",
    "delete_by_code": "SELECT * FROM knowledge k WHERE NOT EXISTS (SELECT 1 FROM note_upserts u WHERE u.video_code = k.video_code)",
    "render_search": f"""SELECT id, concat('### [', id, '] ', substr(coalesce(title, ''), 1, 60), chr(10), '- **视频码**: `', coalesce(video_code, 'None'), '`', chr(10), '- **作者**: ', author, chr(10),
        '- **标签**: ', substr(coalesce(tags, ''), 1, 120), chr(10), '- **时间**: ', coalesce(nullif(timestamp, ''), substr(created_at, 1, 19), ''), chr(10), '- **摘要**: ', substr(coalesce(summary_markdown, ''), 1, 200), chr(10)) AS line
        FROM knowledge WHERE {_any('编译器', 'tags', 'title', 'summary_markdown')} AND {_any('线程池', 'tags', 'title', 'summary_markdown')} {_NEWEST} LIMIT 50""",
    "render_list": f"""SELECT id, concat('- **[', id, ']** `', coalesce(video_code, 'None'), '` ', title, ' — _', author, '_ (', substr(coalesce(created_at, ''), 1, 10), ')',
        CASE WHEN coalesce(tags, '') != '' THEN chr(10) || '  标签: ' || substr(tags, 1, 80) ELSE '' END) AS line FROM (SELECT * FROM knowledge {_NEWEST} LIMIT 20 OFFSET 40)""",
    "render_note": f"""SELECT id, concat('# ', title, chr(10), chr(10), '- **作者**: ', author, chr(10), '- **来源**: ', source_url, chr(10), '- **标签**: ', tags, chr(10), '- **创建时间**: ', {_WHEN}, chr(10),
        CASE WHEN coalesce(user_requirement, '') != '' THEN '- **用户要求**: ' || user_requirement || chr(10) ELSE '' END, chr(10), '---', chr(10), chr(10), summary_markdown) AS text FROM knowledge""",
    "render_note_by_code": f"""SELECT video_code, concat('# ', title, chr(10), chr(10), '- **视频码**: `', video_code, '`', chr(10), '- **作者**: ', author, chr(10), '- **来源**: ', source_url, chr(10), '- **标签**: ', tags, chr(10),
        '- **创建时间**: ', {_WHEN}, chr(10), CASE WHEN coalesce(user_requirement, '') != '' THEN '- **用户要求**: ' || user_requirement || chr(10) ELSE '' END, chr(10), '---', chr(10), chr(10), summary_markdown) AS text
        FROM knowledge WHERE video_code IS NOT NULL""",
    "render_by_tag": f"""SELECT id, concat('- **[', id, ']** ', title, ' — _', author, '_ (', substr(coalesce(created_at, ''), 1, 10), ')') AS line FROM knowledge WHERE {_has('tags', TAG)} {_NEWEST} LIMIT 10""",
    "fallbacks": "SELECT id, coalesce(nullif(title, ''), '未知标题') AS title, coalesce(nullif(author, ''), '未知作者') AS author, coalesce(video_code, 'N/A') AS video_code, coalesce(timestamp, '未知时间') AS timestamp FROM knowledge",
    "render_stats": """SELECT concat('## 知识库统计', chr(10), chr(10), '- **总笔记数**: ', count(*), chr(10), '- **最新记录**: ', coalesce(nullif(max(created_at), ''), '无'), chr(10), '- **数据库路径**: knowledge', chr(10)) AS text FROM knowledge""",
    "codes_unique": """WITH h AS (SELECT id, CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 12) AS BIGINT) % 60466176 AS h FROM knowledge),
        c AS (SELECT id, array_to_string(list_transform([1679616, 46656, 1296, 36, 1], lambda p: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(h // p % 36 AS INT) + 1, 1)), '') AS code FROM h)
        SELECT id, code, count(*) OVER (PARTITION BY code) - 1 AS others FROM c""",
}
