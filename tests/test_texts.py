import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import markdown as md
from marginalia.functions import web
from marginalia.functions.requirements import says_something
from marginalia.functions.times import epoch_micros
from marginalia.operators.chunks import as_sent, chunked, markdown_parts, text_parts


def apply(spark, f, *values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_cleanup(spark):
    got = apply(spark, md.cleanup_output, "\n\n<search>a\nb</search>\n talk\n# Title\nbody\n", "no heading", "## two\n# one\nx", "<query>q</query>  rest", None, "")
    assert got == ["# Title\nbody\n", "no heading", "# one\nx", "rest", None, ""]


def test_tags(spark):
    assert apply(spark, md.tags_from_bold, "**ab** **a** ** cd ** **ab**", "".join(f"**t{i:02}**" for i in range(20)), "none") == ["ab,cd", ",".join(f"t{i:02}" for i in range(15)), ""]
    assert apply(spark, md.tags_clean, "#a、 b ，##c,, # ,d", "") == ["a,b,c,,d", ""]


def test_latex(spark):
    assert apply(spark, md.latex_text, r"\text{km} + \text{}") == [r"\mathrm{km} + \mathrm{}"]
    assert apply(spark, md.formulas, "a $x$ b $$y\nz$$ $ 1", None) == [["y\nz", "x"], None]


@pytest.mark.parametrize(
    "line, want",
    [
        ("a * b", "a\n\n* b"), ("- one - two 2. three", "- one\n\n- two\n\n2. three"), ("(a * b) * c", "(a * b)\n\n* c"), ("5 * 3", "5 * 3"), ("# a * b", "# a * b"),
        ("", ""), ("文字。 1. 甲 2. 乙", "文字。\n\n1. 甲\n\n2. 乙"), ("( a - b", "( a - b"), ("a) - b", "a)\n\n- b"), ("word * ", "word\n\n* "),
    ],
)
def test_split_items(line, want):
    assert md.split_items(line) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("text：* item", "text：\n\n* item"), ("a\r\n- b\rc", "a\n\n- b\nc"), ("**bold** x", "**bold** x"), ("-5", "- 5"), ("--x", "- -x"), ("```\n-5\na * b\n```", "```\n-5\na * b\n```"),
        ("$a - b$ and $$c\nd * e$$", "$a - b$ and $$c\nd * e$$"), ("> q - r", "> q - r"), ("# h\n- a", "# h\n- a"), ("para\n1. a\n2. b", "para\n\n1. a\n2. b"), ("- a:\n- b", "- a:\n\n- b"), ("", ""),
    ],
)
def test_normalize(text, want):
    assert md.normalize(text) == want


@given(st.text(alphabet="ab *-+1.：:(（)）#>\n$`", max_size=60))
@settings(max_examples=300, deadline=None)
def test_normalize_keeps_characters(text):
    bare = lambda s: "".join(s.split())
    assert bare(md.normalize(text)) == bare(text)


def test_blank_before_list_matches_scan(spark):
    texts = ["a\n- b", "a:\n- b", "- a\n- b", "- a：\n- b", "# h\n- b", "> q\n1. x", "3. x\n- y", "a\n\n- b", "", "x\n-y"]
    assert apply(spark, md.blank_before_list, *texts) == ["a\n\n- b", "a:\n\n- b", "- a\n- b", "- a：\n\n- b", "# h\n- b", "> q\n1. x", "3. x\n- y", "a\n\n- b", "", "x\n-y"]


def test_line_expressions(spark):
    assert apply(spark, lambda c: md.each_line(c, md.marker_spacing), "*x\n**b\n- y\n+z", None) == ["* x\n**b\n- y\n+ z", None]
    assert apply(spark, lambda c: md.each_line(c, md.colon_then_list), "a：b:* c", "a: 12. x") == ["a：b:\n\n* c", "a:\n\n12. x"]
    assert apply(spark, lambda c: md.paren_depth(c, F.length(c)), "((a）", "))(", "") == [1, 1, 0]


def test_formulas_rendered():
    assert md.render_formulas("$x$") == "<code>x</code>"
    assert md.render_formulas("$$x$$") == "\n\n<pre><code>x</code></pre>\n\n"
    assert md.render_formulas("> $$x$$ $y$") == "> <code>x</code> <code>y</code>"
    assert md.render_formulas("```math\nz\n```") == "\n\n<pre><code>z</code></pre>\n\n"
    assert md.render_formulas("$x$", lambda c: "AA") == '<img src="data:image/png;base64,AA" alt="formula" class="inline-formula"/>'
    assert md.render_formulas("> $$x$$", lambda c: "AA") == '> <img src="data:image/png;base64,AA" alt="formula" class="block-formula" style="display:block;margin:0 auto;"/>'


def test_formula_expressions_agree_with_the_scan(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab*>#\n$$$$ `\\") for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["```math\nx\n```", "> $$ a $$ $b$", " > $ $ $$ $$ $$a$$"]
    assert apply(spark, md.process_formulas, *texts) == [md.render_formulas(t) for t in texts]


def test_formulas_inside_formulas_come_back():
    assert md.normalize("$a $$b$$ c$ - d") == "$a $$b$$ c$ - d" and "\U000f0000" in md.normalize("x \U000f0000 $y$")


def test_urls(spark):
    texts = ["see https://v.site.example/AbC1 now", "https://v.site.example/AbC1/", "https://a.example/share/video/12 https://a.example/video/34", "none", None, ""]
    assert apply(spark, web.extract_url, *texts) == ["https://v.site.example/AbC1/", "https://v.site.example/AbC1/", "https://a.example/video/34", None, None, None]
    texts = ["https://v.site.example/abc复制此链接", "https://v.site.example/abc!", "(https://v.site.example/abc)", "see https://other.example/about and https://v.site.example/video/123，ok"]
    only = lambda c: web.extract_url(c, ["v.site.example"])
    assert apply(spark, only, *texts) == ["https://v.site.example/abc/"] * 3 + ["https://v.site.example/video/123"]
    assert apply(spark, only, "https://vxsite.example/abc", "https://v.site.example/share/video/9 https://v.site.example/zz") == [None, "https://v.site.example/zz/"]
    df = spark.createDataFrame([("2.91 #sbT title https://h.example/video/1 keep this", "https://h.example/video/1"), ("3 点 @who do", None), ("", "")], "t string, u string")
    assert [r[0] for r in df.select(web.requirement(F.col("t"), F.col("u"))).collect()] == ["title keep this", "点 do", ""]
    urls = ["https://a/share/video/123?x=1", "https://a/b/7037730578408563495_x", "https://a/b/", None, "plain"]
    assert apply(spark, web.video_id, *urls) == ["123", "7037730578408563495", "", None, "plain"]


def test_merged_requirement(spark):
    df = spark.createDataFrame([("a", "b"), ("a", " OK "), ("a", ""), ("a", None), ("", "开始")], "i string, e string")
    assert [r[0] for r in df.select(web.merged_requirement(F.col("i"), F.col("e"))).collect()] == ["b", "a", "a", "a", ""]


def test_pages(spark):
    page = '<script>window._ROUTER_DATA = {"loaderData": {"%s/page": {"videoInfoRes": {"item_list": [%s]}}}}</script>'
    item = '{"desc": "d", "author": {"nickname": "n"}, "video": {"play_addr": {"url_list": ["//h/playwm/1"]}}}'
    pages = [page % ("video_(id)", item), page % ("note_(id)", item), page % ("video_(id)", ""), "<p>", "<script>window._ROUTER_DATA = {bad</script>", None]
    got = apply(spark, lambda c: F.struct(web.page_item(c, "desc"), web.page_item(c, "author.nickname"), web.play_url(c)), *pages)
    assert [tuple(r) for r in got] == [("d", "n", "https://h/play/1")] * 2 + [(None, None, None)] * 4


def test_times(spark):
    texts = ["2025-01-02 08:00:00", "2025/1/2 8:00:00", "2025年01月02日 08:00:00", "2025-01-02T00:00:00Z", "2025-01-02T09:00:00+09:00", "1735776000", "1735776000000", "2025-01-02T08:00:00.5"]
    assert apply(spark, epoch_micros, *texts) == [1735776000000000] * 7 + [1735776000500000]
    assert apply(spark, epoch_micros, "", None, "unknown", "0000-00-00 00:00:00", "2025-02-30 00:00:00", "2025-01-01 25:00:00", "12") == [None] * 7


def test_says_something(spark):
    assert apply(spark, says_something, None, "", "　", "none", "N/A", "暂无", "-", "OK", " 开始 ", "好") == [False] * 10
    assert apply(spark, says_something, "Keep it short", "好的，表格", "3") == [True] * 3


@given(st.text(alphabet="aé中😀\n", max_size=400), st.integers(4, 40))
@settings(max_examples=300, deadline=None)
def test_text_parts(text, limit):
    parts = text_parts(text, limit)
    assert "".join(parts) == text and all(0 < len(p.encode()) <= limit for p in parts)


@given(st.text(alphabet="aé中\n", max_size=300), st.integers(4, 40))
@settings(max_examples=300, deadline=None)
def test_markdown_parts(text, limit):
    parts = markdown_parts(text, limit)
    assert "".join(parts) == text + "\n" and all(len(p.encode()) <= limit or p.count("\n") == 1 for p in parts)


def test_parts_cases(spark):
    assert text_parts("x" * 2000) == ["x" * 2000] and text_parts("") == [] and markdown_parts("") == ["\n"]
    late, early = "a" * 1500 + "\n" + "b" * 1000, "a" * 500 + "\n" + "b" * 2000
    assert text_parts(late)[0] == "a" * 1500 + "\n" and len(text_parts(early)[0]) == 2000
    sent = as_sent(spark.createDataFrame([(1, 1, 2, "a"), (1, 2, 2, "b")], "key int, part_no int, n_parts int, part string"))
    assert [r["part"] for r in sent.orderBy("part_no").collect()] == ["a", "[2/2]\nb"]
    df = spark.createDataFrame([(1, "x" * 4001), (2, None), (3, "")], "id long, t string")
    assert [(r["key"], r["part_no"], r["n_parts"]) for r in chunked(df, "id", "t").collect()] == [(1, 1, 3), (1, 2, 3), (1, 3, 3)]
    assert chunked(df.limit(0), "id", "t").count() == 0
