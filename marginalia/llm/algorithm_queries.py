"""Queries of problems 1, 2, 5 and 6 over all notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.requirements import says_something
from marginalia.functions.text import ustrip
from marginalia.functions.times import epoch_micros
from marginalia.llm.cooccurrence import cooccurrence
from marginalia.llm.neardup import as_pairs, groups, near_duplicates
from marginalia.llm.survivors import FieldRule, completeness, source_trust, survivors
from marginalia.llm.term_counts import TermCounts, mark, state_root
from marginalia.operators.bounded import bounded_side
from marginalia.operators.packed_values import MAX_BROADCAST_SOURCES, delimiter_stats, dialects, merged_stats, split_packed
from marginalia.operators.shared import written
from marginalia.operators.store import upsert_parts
from marginalia.plans.notes import NOW, STAMP, UPSERT_SQL
from marginalia.plans.packed import note_tags, tags_sql
from marginalia.sources.tables import read_table, source_host

#: Similarity from which two notes count as the same text with edits, fixed by the problem.
NEAR = 0.6


def _lower_tags(tags):
    return F.transform(tags, lambda t: F.lower(t))


#: Batches in which the notes come to the counts, by the order of their ids.
BATCHES = 4


class _Counted:
    """Persistent counts of the notes' tags after ``BATCHES`` batches of added notes, and what later batches need.

    ``stats``: the statistics of the delimiters, which add up like the counts; ``known``: the dialects from them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.notes = read_table(spark, sf_dir, "knowledge")
        self.stats = written(delimiter_stats(self.hosted(self.notes), "tags", "host"))
        self.known = dialects(self.stats)
        self.state = TermCounts(spark, state_root(spark))
        side = self.side(self.known)
        low, high, self.n = self.notes.agg(F.min("id"), F.max("id"), F.count("*")).first()
        low, high = low or 0, high or 0
        edges = [low + (high + 1 - low) * i // BATCHES for i in range(BATCHES + 1)]
        at = F.coalesce("id", F.lit(low))
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            self.state.apply(self.signed(self.notes.where((at >= a) & (at < b)), side, 1), i)

    @staticmethod
    def side(known: DataFrame) -> DataFrame:
        return bounded_side(known, MAX_BROADCAST_SOURCES)[0]

    @staticmethod
    def hosted(notes: DataFrame) -> DataFrame:
        return notes.select("tags", source_host(F.col("source_url")).alias("host"))

    def signed(self, notes: DataFrame, side: DataFrame, sign: int) -> DataFrame:
        """(terms, sign) of notes, split by the given dialects."""
        split = split_packed(self.hosted(notes), "tags", "host", "tag_list", side)
        return split.select(_lower_tags(F.col("tag_list")).alias("terms"), F.lit(sign).alias("sign"))

    def change(self, batch: int, before: DataFrame, after: DataFrame, untouched: DataFrame) -> DataFrame:
        """The counts after notes went (``before``) and came (``after``): only these rows are read.

        The statistics of the delimiters change with them. Where that gives a source another
        dialect, its ``untouched`` notes are split anew, else they aren't read.
        """
        stats = written(merged_stats((self.stats, 1), (delimiter_stats(self.hosted(after), "tags", "host"), 1), (delimiter_stats(self.hosted(before), "tags", "host"), -1)))
        now = dialects(stats)
        o, n = (k.select("source", F.col("pattern").alias(p)) for k, p in ((self.known, "was"), (now, "is")))
        other = written(o.join(n, "source", "full_outer").where(~F.col("was").eqNullSafe(F.col("is"))).select("source"))
        old, new = self.side(self.known), self.side(now)
        changes = self.signed(before, old, -1).unionByName(self.signed(after, new, 1))
        if other.limit(1).count():
            moved = untouched.join(self.side(other), source_host(F.col("source_url")) == F.col("source"), "left_semi")
            changes = changes.unionByName(self.signed(moved, old, -1)).unionByName(self.signed(moved, new, 1))
        self.state.apply(changes, batch)
        self.stats, self.known = stats, now
        return self.counts()

    def counts(self) -> DataFrame:
        return self.state.counts().select(F.col("term").alias("tag"), "occurrences", F.col("records").alias("notes"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _Counted(spark, sf_dir)
    return mark(counted.state.counts(), counted.n).where("mark IS NOT NULL").select(F.col("term").alias("tag"), "mark")


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag with its occurrences, its notes and its mark."""
    counted = _Counted(spark, sf_dir)
    marked = mark(counted.state.counts(), counted.n)
    return marked.select(F.col("term").alias("tag"), "occurrences", F.col("records").alias("notes"), F.coalesce("mark", F.lit("")).alias("mark"))


def p1_after_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after the batch of note_upserts, as a batch of deltas: those of the table that ``upsert_notes`` gives.

    Notes with a code of the batch change; rows with a new code, and each row without a code, are added.
    """
    counted = _Counted(spark, sf_dir)
    parts = upsert_parts(counted.notes, read_table(spark, sf_dir, "note_upserts"), NOW, STAMP)
    columns = ["tags", "source_url"]
    return counted.change(BATCHES, parts.before.select(columns), parts.after.select(columns).unionByName(parts.fresh.select(columns)), parts.untouched.select(columns))


def p1_after_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after the notes whose code is in note_upserts are deleted: those of the table that ``delete_by_code`` gives."""
    counted = _Counted(spark, sf_dir)
    parts = upsert_parts(counted.notes, read_table(spark, sf_dir, "note_upserts"), NOW, STAMP)
    columns = ["tags", "source_url"]
    return counted.change(BATCHES, parts.before.select(columns), parts.before.select(columns).limit(0), parts.untouched.select(columns))


def _pairs(spark: SparkSession, sf_dir: str, min_count: int) -> DataFrame:
    notes = note_tags(spark, sf_dir).select(_lower_tags(F.col("tag_list")).alias("terms"))
    n = read_table(spark, sf_dir, "knowledge").count()
    return cooccurrence(notes, "terms", n, min_count).withColumn("n", F.lit(n).cast("long"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = F.col("n_ab").cast("decimal(38,0)") * F.col("n") >= F.lit(30) * F.col("n_a").cast("decimal(18,0)") * F.col("n_b")
    return _pairs(spark, sf_dir, 5).where(far).select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of tags of one note with its counts, lift and log-likelihood ratio."""
    return _pairs(spark, sf_dir, 1).select(
        F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n_ab", "n_a", "n_b", F.round("lift", 4).alias("lift"), F.round("llr", 4).alias("llr")
    )


def _video(c):
    run = F.regexp_extract(c, r"(?<!\d)(\d{19})(?!\d)", 1)
    return F.when(run != "", run)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = read_table(spark, sf_dir, "knowledge").select("id", "video_id", "timestamp", "user_requirement")
    time = epoch_micros(F.col("timestamp"))
    rules = [
        FieldRule("latest_id", F.col("id"), [time]),
        FieldRule("requirement_id", F.col("id"), [time], says_something(F.col("user_requirement"))),
    ]
    best = survivors(notes, _video(F.col("video_id")), F.col("id"), rules, min_size=2, group_name="video_id")
    return best.select("video_id", "latest_id", F.coalesce("requirement_id", F.lit(0).cast("long")).alias("requirement_id"))


def p5_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving record of each video with at least two notes, each field from the best note for it.

    Title and author come from the most complete note, then the one of the more trusted source, then the newest;
    the trust of a host is how complete its notes are on average.
    """
    notes = read_table(spark, sf_dir, "knowledge")
    fields = [F.col(c) for c in ("title", "author", "tags", "summary_markdown")]
    notes = notes.select("id", "video_id", "title", "author", "user_requirement", "timestamp", source_host(F.col("source_url")).alias("host"), completeness(*fields).alias("full"))
    trusted, _ = bounded_side(source_trust(read_table(spark, sf_dir, "knowledge"), source_host(F.col("source_url")), *fields), MAX_BROADCAST_SOURCES)
    notes = notes.join(trusted, F.col("host") == F.col("source"), "left")
    time, best = epoch_micros(F.col("timestamp")), [F.col("full"), F.col("trust")]
    named = lambda c, none: (ustrip(F.col(c)) != "") & (F.col(c) != none)
    rules = [
        FieldRule("latest_id", F.col("id"), [time]),
        FieldRule("title", ustrip(F.col("title")), [*best, time], named("title", "未知标题")),
        FieldRule("author", ustrip(F.col("author")), [*best, time], named("author", "未知作者")),
        FieldRule("user_requirement", ustrip(F.col("user_requirement")), [time], says_something(F.col("user_requirement"))),
    ]
    return survivors(notes, _video(F.col("video_id")), F.col("id"), rules, min_size=2, group_name="video_id")


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(read_table(spark, sf_dir, "knowledge").select("id", "summary_markdown"), "id", "summary_markdown", NEAR)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_pairs(*_near(spark, sf_dir))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every note with letters or digits enough: its class of equal texts, named by its smallest id, and the class's size."""
    return _near(spark, sf_dir)[0].select("id", F.col("rep").alias("class_id"), F.col("n").alias("class_size"))


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of different classes that are mostly the same text; with ``p6_classes`` every pair of notes."""
    return _near(spark, sf_dir)[1].select(F.col("rep_a").alias("class_a"), F.col("rep_b").alias("class_b"), F.round("similarity", 6).alias("similarity"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every note with its group of notes that are mostly the same text, and the number of its class's links.

    A note without five letters or digits is a group of its own.
    """
    every = read_table(spark, sf_dir, "knowledge").select("id")
    known = every.join(groups(*_near(spark, sf_dir)), "id", "left")
    return known.select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


QUERIES = {
    "p1_found": p1_found, "p1_counts": p1_counts, "p1_after_upserts": p1_after_upserts, "p1_after_deletes": p1_after_deletes,
    "p2_found": p2_found, "p2_pairs": p2_pairs, "p5_found": p5_found, "p5_records": p5_records,
    "p6_found": p6_found, "p6_classes": p6_classes, "p6_links": p6_links, "p6_groups": p6_groups,
}
_NEAR_PAIRS = r"""WITH RECURSIVE s AS (SELECT id, lower(regexp_replace(summary_markdown, '[^\p{L}\p{N}]', '', 'g')) AS s FROM knowledge WHERE summary_markdown IS NOT NULL),
      m AS (SELECT id, min(id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS class_size FROM s WHERE length(s) >= 5),
      w AS (SELECT id, s, unnest(range(1, length(s) - 3)) AS p FROM s), g AS (SELECT DISTINCT id, substr(s, p, 5) AS g FROM w), n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
      c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
      e AS (SELECT id_a, id_b, c / (x.n + y.n - c) AS similarity FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c * 5 >= 3 * (x.n + y.n - c)),
      l AS (SELECT e.id_a, e.id_b FROM e JOIN m a ON a.id = e.id_a JOIN m b ON b.id = e.id_b WHERE a.class_id != b.class_id AND a.class_id = a.id AND b.class_id = b.id)"""
_VIDEOS = r"""WITH p AS (SELECT id, trim(timestamp) AS t, regexp_extract(video_id, '(?:^|[^0-9])([0-9]{19})(?:[^0-9]|$)', 1) AS v, lower(regexp_replace(coalesce(user_requirement, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS u,
        regexp_extract(timestamp, '^\s*(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})日?[T ]*(\d{1,2}):(\d{1,2}):(\d{1,2})\s*(Z|[+-]\d{2}:\d{2})?\s*$', ['y','m','d','h','i','s','z']) AS r FROM knowledge),
      q AS (SELECT id, v, u, CASE WHEN regexp_full_match(t, '\d{10}') THEN TRY_CAST(t AS BIGINT) * 1000000 WHEN regexp_full_match(t, '\d{13}') THEN TRY_CAST(t AS BIGINT) * 1000
        WHEN r.y != '' AND r.y != '0000' THEN epoch_us(make_timestamp(TRY_CAST(r.y AS BIGINT), TRY_CAST(r.m AS BIGINT), TRY_CAST(r.d AS BIGINT), TRY_CAST(r.h AS BIGINT), TRY_CAST(r.i AS BIGINT), TRY_CAST(r.s AS DOUBLE)))
          - CASE WHEN r.z = 'Z' THEN 0 WHEN r.z = '' THEN 480 ELSE TRY_CAST(r.z[1:3] AS BIGINT) * 60 + TRY_CAST(r.z[1:1] || r.z[5:6] AS BIGINT) END * 60000000 END AS micros FROM p),
      l AS (SELECT v, id, count(*) OVER (PARTITION BY v) AS n FROM q WHERE v != '' QUALIFY row_number() OVER (PARTITION BY v ORDER BY micros DESC NULLS LAST, id DESC) = 1),
      n AS (SELECT v, id FROM q WHERE v != '' AND u NOT IN ('none', 'null', 'nil', 'nan', 'n/a', 'na', 'undefined', 'nothing', '无', '暂无', '没有', '空', '未填', '开始', 'start', 'ok', '好') AND regexp_matches(u, '[\p{L}\p{N}]')
        QUALIFY row_number() OVER (PARTITION BY v ORDER BY micros DESC NULLS LAST, id DESC) = 1) """


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _full(t: str) -> str:
    """How many of four fields hold more than blanks."""
    return " + ".join(f"CAST(length(coalesce(trim({t}.{c}, ' '), '')) > 0 AS INT)" for c in ("title", "author", "tags", "summary_markdown"))


_COUNTS = "(SELECT lower(tag) AS tag, count(*) AS occurrences, count(DISTINCT id) AS notes FROM tags GROUP BY ALL)"
_MARKED = f"SELECT tag, occurrences, notes, CASE WHEN notes < 3 THEN 'rare' WHEN notes * 10 > (SELECT count(*) FROM knowledge) THEN 'common' ELSE '' END AS mark FROM {_COUNTS}"
_PAIRS = f"""WITH {tags_sql()}, i AS (SELECT DISTINCT id, lower(tag) AS tag FROM tags), n AS (SELECT count(*) AS n FROM knowledge), s AS (SELECT tag, count(*) AS n FROM i GROUP BY tag),
      ab AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n_ab FROM i a JOIN i b ON a.id = b.id AND a.tag < b.tag GROUP BY ALL),
      q AS (SELECT tag_a, tag_b, n_ab, x.n AS n_a, y.n AS n_b, n.n FROM ab JOIN s x ON x.tag = tag_a JOIN s y ON y.tag = tag_b CROSS JOIN n)"""
_ENTROPY = "coalesce({0} * ln(nullif({0}, 0)), 0)"
_LLR = " + ".join(_ENTROPY.format(c) for c in ("n_ab", "(n_a - n_ab)", "(n_b - n_ab)", "(n - n_a - n_b + n_ab)", "n")) + "".join(f" - {_ENTROPY.format(c)}" for c in ("n_a", "(n - n_a)", "n_b", "(n - n_b)"))
ORACLE: dict[str, str] = {
    "p1_found": f"WITH {tags_sql()} SELECT tag, mark FROM ({_MARKED}) WHERE mark != ''",
    "p1_counts": f"WITH {tags_sql()} {_MARKED}",
    "p1_after_upserts": f"WITH after AS ({UPSERT_SQL}), {tags_sql('after')} SELECT * FROM {_COUNTS}",
    "p1_after_deletes": f"WITH after AS (SELECT * FROM knowledge k WHERE NOT EXISTS (SELECT 1 FROM note_upserts u WHERE u.video_code = k.video_code)), {tags_sql('after')} SELECT * FROM {_COUNTS}",
    "p2_found": f"{_PAIRS} SELECT tag_a, tag_b FROM q WHERE n_ab >= 5 AND n_ab * n >= 30 * n_a * n_b",
    "p2_pairs": f"{_PAIRS} SELECT tag_a, tag_b, n_ab, n_a, n_b, round(n_ab * n / n_a / n_b, 4) AS lift, round(greatest(2 * ({_LLR}), 0), 4) AS llr FROM q",
    "p6_found": f"{_NEAR_PAIRS} SELECT id_a, id_b FROM e",
    "p6_classes": f"{_NEAR_PAIRS} SELECT id, class_id, class_size FROM m",
    "p6_links": f"{_NEAR_PAIRS} SELECT id_a AS class_a, id_b AS class_b, round(similarity, 6) AS similarity FROM e SEMI JOIN l ON e.id_a = l.id_a AND e.id_b = l.id_b",
    "p6_groups": f"""{_NEAR_PAIRS}, b AS (SELECT id_a AS x, id_b AS y FROM e UNION ALL SELECT id_b, id_a FROM e),
      r AS (SELECT id, id AS g FROM knowledge UNION SELECT b.y, r.g FROM r JOIN b ON b.x = r.id), o AS (SELECT id, min(g) AS group_id FROM r GROUP BY id),
      d AS (SELECT x AS id, count(*) AS links FROM (SELECT id_a AS x FROM l UNION ALL SELECT id_b FROM l) GROUP BY x)
      SELECT o.id, o.group_id, coalesce(d.links, 0) AS links FROM o LEFT JOIN m ON m.id = o.id LEFT JOIN d ON d.id = m.class_id""",
    "p5_found": f"{_VIDEOS}"
    """SELECT l.v AS video_id, l.id AS latest_id, coalesce(n.id, 0) AS requirement_id FROM l LEFT JOIN n ON l.v = n.v WHERE l.n >= 2""",
    "p5_records": f"""{_VIDEOS.rstrip()},
      b AS (SELECT q.*, {_bare('k.title')} AS title, {_bare('k.author')} AS author, {_bare('k.user_requirement')} AS requirement, regexp_extract(lower(k.source_url), '^\\s*(?:[a-z][a-z0-9+.\\-]*:)?//(?:[^/?#@]*@)?([^/?#:\\s]+)', 1) AS host,
        {_full('k')} AS f FROM q JOIN knowledge k ON k.id = q.id),
      h AS (SELECT coalesce(host, '') AS host, sum(f) * 1000 // count(*) AS trust FROM b GROUP BY ALL), bt AS (SELECT b.*, h.trust FROM b JOIN h ON h.host = coalesce(b.host, '') WHERE v != ''),
      t AS (SELECT v, title FROM bt WHERE title != '' AND title != '未知标题' QUALIFY row_number() OVER (PARTITION BY v ORDER BY f DESC, trust DESC, micros DESC NULLS LAST, id DESC) = 1),
      w AS (SELECT v, author FROM bt WHERE author != '' AND author != '未知作者' QUALIFY row_number() OVER (PARTITION BY v ORDER BY f DESC, trust DESC, micros DESC NULLS LAST, id DESC) = 1)
      SELECT l.v AS video_id, l.id AS latest_id, t.title, w.author, bt.requirement AS user_requirement FROM l LEFT JOIN n ON l.v = n.v LEFT JOIN bt ON bt.id = n.id LEFT JOIN t ON t.v = l.v LEFT JOIN w ON w.v = l.v WHERE l.n >= 2""",

}
