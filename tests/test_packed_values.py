import json
import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators.packed_values import delimiter_scores, delimiter_stats, explode_packed, merged_stats, split_packed

VALUES = ["red", "deep blue", "编译器", "C#", "F#", "C++", "TCP/IP", "A/B测试", "24/7 support", "v2.0-beta", "snake_case", "R&D", "100%真人", "Beginner's corner", "e.g. list"]
TRICKY = ["Harbour, old town", "茶，咖啡", "输入、输出", "左/右 / 中间", "red|black tree", "Rivers; canals, locks", 'say "no"', 'size 5" nails']
SEPARATORS = [",", ", ", "，", "、", ";", "；", "|", " | ", " / ", "\t", "\n"]


def _csv(v):
    return '"' + v.replace('"', '""') + '"' if v in TRICKY else v


def packed(rng):
    n = rng.randint(1, 6)
    style = rng.choice(["plain", "json", "json-ascii", "hash", "hash-run", "bullets", "quoted", "tricky", "messy"])
    tags = [rng.choice(VALUES) for _ in range(n)]
    sep = rng.choice(SEPARATORS)
    if style == "json" or style == "json-ascii":
        tags = [rng.choice(VALUES + TRICKY) for _ in range(n)]
        return json.dumps(tags, ensure_ascii=style == "json-ascii"), tags
    if style == "hash":
        return " ".join(f"#{t}" for t in tags), tags
    if style == "hash-run":
        return "".join(f"#{t}" for t in tags), tags
    if style == "bullets":
        return "\n".join(f"- {t}" for t in tags), tags
    if style == "quoted":
        return ",".join(rng.choice(['"{}"', "“{}”", "{}"]).format(t) for t in tags), tags
    if style == "tricky":
        tags = [rng.choice(VALUES + TRICKY) for _ in range(n)]
        return sep.join(map(_csv, tags)), tags
    if style == "messy":
        return rng.choice(["　", ",", "，", " ,", ",,", ", ,"]) + ",,".join(tags) + ", ,，", tags
    return sep.join(tags), tags


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(i, f"host{i % 3}", *packed(rng)) for i in range(3000)]


def test_against_the_packed_values(spark, rows):
    df = spark.createDataFrame([r[:3] for r in rows], "id long, host string, tags string")
    got = {r["id"]: r["v"] for r in split_packed(df, "tags", "host", "v").collect()}
    wrong = [(r[2], r[3], got[r[0]]) for r in rows if got[r[0]] != r[3]]
    assert len(wrong) <= 3, wrong[:5]  # a doubled quote beside a delimiter may be read either way


def test_positions(spark, rows):
    df = spark.createDataFrame([r[:3] for r in rows[:50]], "id long, host string, tags string")
    for r in explode_packed(df, "id", "tags", "host", "tag", 2).groupBy("id").agg(F.collect_list("pos").alias("p")).collect():
        assert sorted(r["p"]) == list(range(1, len(r["p"]) + 1)) and len(r["p"]) > 1


def test_edge_cases(spark):
    # other columns keep their names, also those an operator might use itself
    rows = [(1, None, "a,b", 9, "x"), (2, "h", None, 9, "x"), (3, "h", "", 9, "x"), (4, "h", " , ,", 9, "x"), (5, "h", "[1, broken", 9, "x"), (6, "h", "a,b", 9, "x"), (6, "h", "a,b", 9, "x"), (7, "h", "#", 9, "x"), (8, "h", ",".join(["w"] * 50_000), 9, "x")]
    df = spark.createDataFrame(rows, "id long, host string, tags string, source int, pattern string")
    out = split_packed(df, "tags", "host", "values")
    assert out.columns == ["id", "host", "tags", "source", "pattern", "values"]
    got = [(r["id"], r["values"]) for r in out.collect()]
    assert (1, ["a", "b"]) in got and (2, []) in got and (3, []) in got and (4, []) in got and (7, []) in got
    assert got.count((6, ["a", "b"])) == 2 and len(dict(got)[8]) == 50_000
    assert dict(got)[5] == ["[1", "broken"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, host string, tags string")
    assert split_packed(df, "tags", "host", "v").count() == 0
    assert delimiter_scores(delimiter_stats(df, "tags", "host")).count() == 0


def test_statistics_add_up(spark):
    df = spark.createDataFrame([(i, "h" if i % 2 else "g", f"a{i}, b; c{i}", i < 30) for i in range(60)], "id long, host string, tags string, old boolean")
    every, old, rest = (delimiter_stats(x, "tags", "host") for x in (df, df.where("old"), df.where("NOT old")))
    rows = lambda x: {tuple(r) for r in x.collect()}
    assert rows(merged_stats((every, 1), (old, -1))) == rows(rest) and rows(merged_stats((old, 1), (rest, 1))) == rows(every)
    assert rows(merged_stats((old, 1), (old, -1))) == set()
