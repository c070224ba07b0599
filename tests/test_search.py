"""Search against stock SQLite with its own full-text index."""

import random
import sqlite3

import pytest

from pyspark.sql import functions as F

from marginalia.operators import fts, search
from marginalia.operators.like import has, split_keywords
from marginalia.operators.postings import PostingsIndex
from marginalia.operators.shared import new_folder
from marginalia.schema import NOTE, NOTE_COLUMNS

ROWS = [
    (9, "Cafe\u0301s", "e\u0301", "deco\u0302me\u0323d x\u0332y नमस्ते สวัสดี"), (1, "Agents 101", "AI编程,智能体", "量化交易策略 overview"), (2, "Café notes", "Food", "a résumé of café snake_case"), (3, "ÉCOLE", "fr", "École"),
    (4, "Wildcards", "a_b,100%", "axb C++ GPT-4.5"), (5, "Tie A", "t", "foo bar"), (6, "Tie B", "t", "foo bar"), (7, "Only title: zebra", "z", "word " * 60), (8, "Backslash", "x\\y", "a\\b"),
]
QUERIES = ["", ",", "AI", "AI，智能体", "foo　bar", "a_b", "C++ foo", "NOT", "量化", "cafe", "École", "zebra", "x\\y", "snake_case", "overview foo word", "cafés", "decomed", "xy", "नमस्ते", "สวัสดี"]


@pytest.fixture(scope="module")
def notes(spark):
    full = [(i, "v", t, "author", "", s, g, "", f"2024-01-0{min(i, 5)}", 0.0, f"c{i}", "") for i, t, g, s in ROWS]
    return spark.createDataFrame(full, NOTE)


@pytest.fixture(scope="module")
def lite(notes):
    c = sqlite3.connect(":memory:")
    c.execute(f"CREATE TABLE k ({', '.join(NOTE_COLUMNS)})")
    c.executemany(f"INSERT INTO k VALUES ({','.join('?' * 12)})", [tuple(r) for r in notes.collect()])
    c.execute("CREATE VIRTUAL TABLE f USING fts5(title, author, summary_markdown, tags, tokenize='unicode61')")
    c.execute("INSERT INTO f(rowid, title, author, summary_markdown, tags) SELECT id, title, author, summary_markdown, tags FROM k")
    return c


def expected(c, query, limit):
    """The three strategies, one after the other."""
    words = split_keywords(query) or [query.strip()]
    out = []
    for w in words:
        out += [r[0] for r in c.execute("SELECT id FROM k WHERE tags LIKE ? ORDER BY created_at DESC, id DESC LIMIT ?", (f"%{w}%", limit))]
    try:
        out += [r[0] for r in c.execute("SELECT rowid FROM f WHERE f MATCH ? ORDER BY round(rank, 9), rowid LIMIT ?", (" OR ".join(words), limit))]
    except sqlite3.Error:
        pass
    for w in words:
        like = f"%{w}%"
        sql = "SELECT id FROM k WHERE title LIKE ? OR summary_markdown LIKE ? OR tags LIKE ? ORDER BY created_at DESC, id DESC LIMIT ?"
        out += [r[0] for r in c.execute(sql, (like, like, like, limit))]
    return list(dict.fromkeys(out))[:limit]


@pytest.fixture(scope="module")
def index(spark, notes):
    """The index after batches that added, replaced and removed notes."""
    old = notes.withColumn("title", F.concat("title", F.lit(" outdated"))).unionByName(notes.withColumn("id", F.col("id") + 1000))
    i = PostingsIndex(spark, new_folder(spark, "postings")).apply(old.where("id % 2 = 0")).apply(old.where("id % 2 = 1"))
    return i.apply(notes.where("id < 5"), old.where("id > 1000").select("id")).apply(notes.where("id >= 5"))


@pytest.mark.parametrize("limit", [0, 1, 3, 100])
@pytest.mark.parametrize("indexed", [False, True])
def test_search_like_sqlite(notes, lite, index, limit, indexed):
    got = {}
    for r in search.search_many(notes, QUERIES, limit, index if indexed else None).orderBy("query_no", "place").collect():
        got.setdefault(r["query_no"], []).append(r["id"])
    for q, query in enumerate(QUERIES):
        assert got.get(q, []) == expected(lite, query, limit), query


def test_bm25_values(notes, lite):
    for words in (["foo"], ["cafe", "word"], ["zebra", "foo", "bar"]):
        got = {r["id"]: r["rank"] for r in fts.bm25(notes, fts.parse_match(words)).collect()}
        want = dict(lite.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (" OR ".join(words),)).fetchall())
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in got)


def test_index_keeps_up(spark, notes, lite, index):
    for words in (["foo"], ["cafe", "word"], ["zebra", "foo", "bar"], ["outdated"]):
        got = {r["id"]: r["rank"] for r in index.bm25_many({0: fts.parse_match(words)}).collect()}
        want = dict(lite.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (" OR ".join(words),)).fetchall())
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in got)
    segments = len(index._state()["segments"])
    rows = sorted(map(tuple, index.postings().collect()))
    index.compact()
    assert segments == 4 and len(index._state()["segments"]) == 1 and sorted(map(tuple, index.postings().collect())) == rows
    assert index.lengths().count() == 9 and index.postings(["nowhere"]).count() == 0
    empty = PostingsIndex(spark, new_folder(spark, "postings"))
    assert empty.bm25_many({0: [["a"]]}).count() == 0 and empty.apply(notes.limit(0)).postings().count() == 0


def test_search_reads_no_text(spark, notes, index):
    plan = index.bm25_many({0: [["foo"], ["a", "b"]]})._jdf.queryExecution().toString()
    assert "summary_markdown" not in plan


def test_like_like_sqlite(spark, notes, lite):
    from pyspark.sql import functions as F

    for w in ["a_b", "100%", "é", "É", "e", "AI", "\\", "x%y", ".", "[", "体"]:
        got = sorted(r[0] for r in notes.where(has(F.col("tags"), w) | has(F.col("title"), w)).select("id").collect())
        assert got == sorted(r[0] for r in lite.execute("SELECT id FROM k WHERE tags LIKE ? OR title LIKE ?", (f"%{w}%", f"%{w}%"))), w


def test_precise(notes):
    assert [r["id"] for r in search.search_precise(notes, "foo bar").collect()] == [6, 5]
    assert search.search_precise(notes, " ").count() == 0
    with pytest.raises(ValueError):
        search.search_precise(notes, "a", -1)


def test_snippets(notes, lite):
    for query in ("cafe zebra", "word résumé", "decomed nothing"):
        want = dict(lite.execute("SELECT rowid, snippet(f, 2, '**', '**', '...', 40) FROM f WHERE f MATCH ?", (" OR ".join(query.split()),)))
        got = {r["id"]: r["snippet"] for r in search.search(notes, query).where("strategy = 2").collect()}
        assert got == {i: want[i] for i in got} and got


def test_snippets_like_sqlite():
    rng = random.Random(5)
    words = ["foo", "bar", "baz", "qux", "cafe", "Café", "cafe\u0301", "one", "two", "three", "four", "五 六", "seven"]
    texts = ["".join(rng.choice(words[: rng.choice([3, 13, 13])]) + rng.choice([" ", " ", " ", ". ", ": ", ", ", ".\n", "-"]) for _ in range(rng.choice([0, 5, 30, 41, 60, 200]))) for _ in range(500)]
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE f USING fts5(t, a, s, g, tokenize='unicode61')")
    c.executemany("INSERT INTO f(rowid, t, a, s, g) VALUES (?, ?, '', ?, '')", [(i, "foo" if i % 7 == 0 else "", t) for i, t in enumerate(texts)])
    for query in ("foo", "foo OR bar", "cafe OR foo OR baz", '"foo bar" OR qux', '"one two" OR "two three"'):
        phrases = [p.strip('"').split() for p in query.split(" OR ")]
        for i, want in c.execute("SELECT rowid, snippet(f, 2, '**', '**', '...', 40) FROM f WHERE f MATCH ?", (query,)).fetchall():
            assert fts.snippet_text(texts[i], phrases) == want, (query, texts[i])


def test_nulls(spark):
    notes = spark.createDataFrame([(1, *[None] * 8, None, None, None)], NOTE)
    assert search.search(notes, "a").count() == 0 and fts.postings(notes).count() == 0
