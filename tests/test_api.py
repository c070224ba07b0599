import pytest
from pyspark.sql import functions as F

from marginalia.api import NotesApi
from marginalia.operators import enrich
from marginalia.schema import NOTE
from marginalia.sources.media import read_media, route, segments


@pytest.fixture(scope="module")
def api(spark):
    rows = [
        (1, "v", "Title one", "ann", "u", "body foo", "t1,t2", "", "2024-01-01T00:00:00+00:00", 0.0, "c1", "2024-01-01 08:00:00"),
        (2, "v", "x" * 70, "bob", "u", "body bar", "", "short", "2024-01-02T00:00:00+00:00", 0.0, None, ""),
    ]
    return NotesApi(spark.createDataFrame(rows, NOTE))


def test_search(api):
    text = api.search_notes("body")
    assert text.startswith('## 搜索结果: "body" (2 条)\n') and "### [1] Title one\n- **视频码**: `c1`" in text and "- **时间**: 2024-01-02T00:00:00\n" in text
    assert "x" * 61 not in text and text.endswith("获取完整内容。")
    assert api.search_notes("nothing") == '未找到与 "nothing" 相关的笔记。'
    assert "(1 条)" in api.search_notes_precise("body foo") and api.search_notes_precise("foo bar").startswith("未找到同时")


def test_notes(api):
    assert api.get_note(1) == "# Title one\n\n- **作者**: ann\n- **来源**: u\n- **标签**: t1,t2\n- **创建时间**: 2024-01-01 08:00:00\n\n---\n\nbody foo"
    assert "- **用户要求**: short\n" in api.get_note(2) and api.get_note(9).startswith("❌")
    assert "- **视频码**: `c1`\n" in api.get_note_by_code("c1") and api.get_note_by_code("zz").startswith("❌")


def test_lists(api):
    lines = api.list_notes().split("\n")
    assert lines[0] == "## 最近笔记 (第 1-2 条)" and lines[2].startswith("- **[2]** `None`") and lines[4] == "  标签: t1,t2"
    assert api.list_notes(1, 1).startswith("## 最近笔记 (第 2-2 条)") and api.list_notes(5, 9) == "知识库暂无笔记。"
    assert api.list_by_tag("t2").endswith("- **[1]** Title one — _ann_ (2024-01-01)") and api.list_by_tag("no").startswith("未找到")
    assert "- **总笔记数**: 2\n- **最新记录**: 2024-01-02T00:00:00+00:00\n- **数据库路径**: \n" in api.knowledge_stats()
    assert "- **总笔记数**: 0\n- **最新记录**: 无\n- **数据库路径**: a/b\n" in NotesApi(api.notes.where("id < 0"), "a/b").knowledge_stats()


def test_media(spark, tmp_path):
    (tmp_path / "a.mp3").write_bytes(b"x" * 10)
    (tmp_path / "b.txt").write_bytes(b"x")
    assert [(r["length"], r["path"].rpartition("/")[2]) for r in read_media(spark, str(tmp_path)).collect()] == [(10, "a.mp3")]
    mb = 1024 * 1024
    sizes = spark.createDataFrame([(15 * mb, False), (15 * mb, True), (16 * mb, False), (26 * mb, True)], "n long, failed boolean")
    assert [r[0] for r in sizes.select(route(F.col("n"), F.col("failed"))).collect()] == ["direct", "speech", "segments", "segments"]
    df = spark.createDataFrame([(1, 1300.5), (2, 600.0), (3, 0.0), (4, None), (5, float("nan"))], "id long, s double")
    assert sorted(map(tuple, segments(df, "id", "s").collect())) == [(1, 0, 0.0, 600.0), (1, 1, 600.0, 1200.0), (1, 2, 1200.0, 1300.5), (2, 0, 0.0, 600.0)]


class Flaky:
    def complete(self, system, user):
        if system == "research" and "nofacts" in user or system == "draft" and "broken" in user:
            raise RuntimeError("down")
        return f"<{system}:{user}>"


def test_pipeline(spark):
    df = spark.createDataFrame([(1, "a"), (2, "nofacts"), (3, "broken")], "id long, t string")
    got = {r["key"]: (r["final"], r["error"]) for r in enrich.finished(df, "id", "t", Flaky).collect()}
    assert got[1] == ("<final:## draft\n<draft:a>\n\n## report\n<research:<draft:a>>\n>", None)
    assert enrich.FAILED_REPORT in got[2][0] and got[3] == (None, "down")
