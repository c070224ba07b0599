import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions.times import epoch_micros
from marginalia.llm import algorithm_queries, neardup
from marginalia.llm.algorithm_queries import QUERIES
from marginalia.llm.cooccurrence import cooccurrence
from marginalia.llm.neardup import Forest, as_pairs, candidates, groups, near_duplicates
from marginalia.llm.survivors import FieldRule, completeness, survivors, trust
from marginalia.llm.term_counts import TermCounts, changes_between, mark, state_root, term_deltas
from marginalia.plans import notes


def records(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(30)]
    return {i: rng.choices(vocabulary, [1 / (j + 1) for j in range(30)], k=rng.randint(0, 6)) for i in range(n)}


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "id long, terms array<string>")


def counted(rows):
    occ, rec = Counter(), Counter()
    for terms in rows.values():
        occ.update(t for t in terms or [] if t)
        rec.update({t for t in terms or [] if t})
    return {t: (occ[t], rec[t]) for t in occ}


def state_of(state):
    return {r["term"]: (r["occurrences"], r["records"]) for r in state.counts().collect()}


# ---------------------------------------------------------------- p1


def test_deltas_equal_a_recount(spark):
    old = records(1)
    state = TermCounts(spark, state_root(spark), buckets=8).apply(frame(spark, old).withColumn("sign", F.lit(1)), 0)
    assert state_of(state) == counted(old)
    new = {k: v for k, v in old.items() if k % 3} | {k: ["t1", "new", "new"] for k in range(10)} | {1000: ["only"]}
    changed = [k for k in {**old, **new} if old.get(k) != new.get(k)]
    batch = changes_between(*(frame(spark, {k: x[k] for k in changed if k in x}) for x in (old, new)), "id", "terms")  # the batch's keys alone
    for _ in range(2):  # the second time it is a replay
        state.apply(batch, 1)
        assert state_of(state) == counted(new)
    state.apply(changes_between(frame(spark, new), frame(spark, {}), "id", "terms"), 2)
    assert state_of(state) == {}
    state.vacuum(1)
    assert state_of(state) == {}


def test_a_writer_from_an_old_state_fails(spark):
    state = TermCounts(spark, state_root(spark), buckets=4).apply(frame(spark, records(2)).withColumn("sign", F.lit(1)), 0)
    number, content = state.manifests.current()
    state.manifests.publish(number + 1, content | {"batch": 7})
    with pytest.raises(Exception, match="(?i)exist"):
        state.manifests.publish(number + 1, content | {"batch": 8})
    assert state.manifests.current() == (number + 1, content | {"batch": 7})


def test_untouched_buckets_stay(spark):
    state = TermCounts(spark, state_root(spark), buckets=16).apply(frame(spark, records(2)).withColumn("sign", F.lit(1)), 0)
    before = state.version()
    state.apply(spark.createDataFrame([(["t1"], 1)], "terms array<string>, sign int"), 1)
    after = state.version()
    assert sum(before[b] != after[b] for b in before) == 1
    state.vacuum()
    assert state.counts().count() == 30


def test_term_cases(spark):
    rows = [(["a", "a", None, ""], 1, "x"), (None, 1, "x"), ([], -1, "x"), (["a"], -1, "x"), (["b"] * 3000, 1, "x")]
    df = spark.createDataFrame(rows, "terms array<string>, sign int, term string")
    assert {tuple(r) for r in term_deltas(df, "terms", "sign").collect()} == {("a", 1, 0), ("b", 3000, 1)}
    assert term_deltas(df.limit(0), "terms", "sign").count() == 0
    marks = spark.createDataFrame([("a", 1, 2), ("b", 9, 3), ("c", 9, 10), ("d", 11, 11)], "term string, occurrences long, records long")
    assert {r["term"]: r["mark"] for r in mark(marks, 100).collect()} == {"a": "rare", "b": None, "c": None, "d": "common"}


@pytest.mark.parametrize("name, table", [("p1_after_upserts", "upsert_notes"), ("p1_after_deletes", "delete_by_code")])
def test_counts_after_a_batch_are_those_of_the_notes_after_it(spark, data, tmp_path, name, table):
    assert spark.read.parquet(f"{data}/note_upserts.parquet").where("video_code IS NULL AND tags != ''").count()
    notes.QUERIES[table](spark, data).write.parquet(f"{tmp_path}/knowledge.parquet")
    want = {(r["tag"], r["occurrences"], r["notes"]) for r in QUERIES["p1_counts"](spark, str(tmp_path)).collect()}
    assert {tuple(r) for r in QUERIES[name](spark, data).collect()} == want


def test_a_batch_that_changes_a_dialect(spark, tmp_path):
    """Bars pack values only once a batch brought enough of them; the notes from before are then split anew."""
    columns = "id long, tags string, source_url string, video_code string"
    old = [(i, f"one{i}|", "https://a.example/x", f"c{i}") for i in range(30)] + [(99, "x1|y1", "https://a.example/x", "c99"), (100, None, None, "d")]
    new = [(200 + i, f"p{i}|q{i}|r{i}", "https://a.example/x", None) for i in range(200)]
    full = lambda rows: spark.createDataFrame(rows, columns)
    state = {}
    for name, rows in (("before", old), ("after", old[1:] + new)):
        full(rows).write.parquet(f"{tmp_path}/{name}/knowledge.parquet")
        state[name] = algorithm_queries._Counted(spark, f"{tmp_path}/{name}")
    got = state["before"].change(algorithm_queries.BATCHES, full(old[:1]), full(new), full(old[1:]))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in state["after"].counts().collect()}


# ---------------------------------------------------------------- p2


@pytest.mark.parametrize("segments", [1, 7])
def test_pairs_by_hand(spark, segments, monkeypatch):
    from marginalia.llm import cooccurrence as module

    monkeypatch.setattr(module, "HELD_ENTRIES", 50)
    rows = records(3)
    n_of, pairs = Counter(), Counter()
    for terms in rows.values():
        n_of.update(set(terms))
        pairs.update(itertools.combinations(sorted(set(terms)), 2))
    got = {(r["item_a"], r["item_b"]): r for r in cooccurrence(frame(spark, rows), "terms", len(rows), 2, segments).collect()}
    assert {k: v["n_ab"] for k, v in got.items()} == {k: v for k, v in pairs.items() if v >= 2}
    for (a, b), r in got.items():
        assert (r["n_a"], r["n_b"]) == (n_of[a], n_of[b])
        cells = [pairs[a, b], n_of[a] - pairs[a, b], n_of[b] - pairs[a, b], len(rows) - n_of[a] - n_of[b] + pairs[a, b]]
        sums = [(n_of[a], n_of[b]), (n_of[a], len(rows) - n_of[b]), (len(rows) - n_of[a], n_of[b]), (len(rows) - n_of[a], len(rows) - n_of[b])]
        llr = 2 * sum(c * math.log(c * len(rows) / x / y) for c, (x, y) in zip(cells, sums) if c)
        assert abs(r["llr"] - llr) < 1e-6 and abs(r["lift"] - pairs[a, b] * len(rows) / n_of[a] / n_of[b]) < 1e-9


def test_pair_cases(spark):
    df = spark.createDataFrame([(["a", "a"],), (None,), ([],), (["b", None, "a", ""],)], "terms array<string>")
    assert [(r["item_a"], r["item_b"], r["n_ab"], r["n_a"]) for r in cooccurrence(df, "terms", 4).collect()] == [("a", "b", 1, 2)]
    assert cooccurrence(df.limit(0), "terms", 0).count() == 0


# ---------------------------------------------------------------- p5


def test_survivors_by_hand(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", None, f"s{i}"]), rng.choice([None, 1, 2, 3]), rng.choice(["", "x", "yy", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, grp string, t int, note string")
    rules = [FieldRule("latest", F.col("id"), [F.col("t")]), FieldRule("noted", F.col("note"), [F.length("note"), F.col("t")], F.col("note") != "")]
    got = {r["group"]: (r["latest"], r["noted"]) for r in survivors(df, F.col("grp"), F.col("id"), rules, min_size=2).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    want = {}
    for g, members in by.items():
        if g is None or len(members) < 2:
            continue
        low = lambda x: -1 if x is None else x
        noted = [m for m in members if m[3]]
        want[g] = (max(members, key=lambda m: (low(m[2]), m[0]))[0], max(noted, key=lambda m: (len(m[3]), low(m[2]), m[0]))[3] if noted else None)
    assert got == want
    noted = {r["group"]: r["noted"] for r in survivors(df, F.col("grp"), F.col("id"), rules[1:], min_size=2).collect()}
    assert noted == {g: v[1] for g, v in want.items()}
    assert survivors(df.limit(0), F.col("grp"), F.col("id"), rules).count() == 0


def test_survivors_cut_before_the_shuffle(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    plan = survivors(df, F.col("g"), F.col("id"), [FieldRule("x", F.col("id"), [F.col("id")])])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_ranks(spark):
    df = spark.createDataFrame([("a", None, "s1"), (" ", "b", "s2"), ("a", "b", None)], "x string, y string, s string")
    r = df.select(completeness(F.col("x"), F.col("y")).alias("c"), trust(F.col("s"), {"s1": 2.0}, 0.5).alias("t")).collect()
    assert [(x["c"], x["t"]) for x in r] == [(1, 2.0), (1, 0.5), (2, 0.5)]


def test_p5_found_by_hand(spark, data):
    import re

    notes = spark.read.parquet(f"{data}/knowledge.parquet").withColumn("micros", epoch_micros(F.col("timestamp"))).collect()
    empty = {"", "none", "null", "n/a", "-", "无", "暂无", "开始", "start", "ok", "好"}
    by = defaultdict(list)
    for r in notes:
        if m := re.search(r"(?<!\d)\d{19}(?!\d)", r["video_id"] or ""):
            by[m.group()].append(r)
    key = lambda r: (-1 if r["micros"] is None else r["micros"], r["id"])
    want = set()
    for v, rs in by.items():
        if len(rs) > 1:
            need = [r for r in rs if (r["user_requirement"] or "").strip().lower() not in empty]
            want.add((v, max(rs, key=key)["id"], max(need, key=key)["id"] if need else 0))
    assert {tuple(r) for r in QUERIES["p5_found"](spark, data).collect()} == want


# ---------------------------------------------------------------- p6


def test_trees_find_all_close_sketches():
    rng = np.random.default_rng(6)
    shard, sketch, cls = np.sort(rng.integers(0, 5, 600)), rng.integers(0, 1 << 16, 600), np.arange(600)
    cls[10], sketch[10], shard[10] = cls[9], sketch[9], shard[9]  # one class from two tasks
    sketch[20:40] = sketch[20]
    for radius in (0, 2, 4):
        got = [tuple(r) for a in Forest(shard, sketch, cls).pairs(radius, most=50) for r in a.tolist()]
        rows = sorted(set(zip(shard.tolist(), cls.tolist(), sketch.tolist())))
        want = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and (a[2] ^ b[2]).bit_count() <= radius}
        assert len(got) == len(set(got)) and set(got) == want
    assert not list(Forest(shard[:0], sketch[:0], cls[:0]).pairs(2))


@pytest.mark.parametrize("shared", [0.0, 0.35, 0.5])
def test_a_search_leaves_out_most_of_a_tree(shared):
    """Shards of 20,000 texts: random ones, and such that agree in a share of their pieces."""
    rng = np.random.default_rng(3)
    values = np.where(rng.random((20_000, neardup.HASHES)) < shared**0.5, np.arange(neardup.HASHES), rng.integers(1000, 1 << 32, (20_000, neardup.HASHES)))
    _, sketch, _ = neardup.shards_of(values.astype(np.uint32))
    for band in (0, 40):
        forest = Forest(np.zeros(20_000, np.int64), sketch[:, band], np.arange(20_000))
        for _ in forest.within(neardup.RADIUS):
            pass
        assert forest.visits / len(forest.sketch) ** 2 < 0.2


def boilerplate(n, rng):
    block = " ".join(f"b{rng.randrange(10**6)}" for _ in range(40))
    return [(i, block + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(37))) for i in range(n)]


def test_boilerplate_gives_few_candidates(spark):
    """Texts that share a block, at a similarity of about 0.35 each: signatures leave no more of them than there are texts."""
    for n in (400, 1600):
        df = spark.createDataFrame(boilerplate(n, random.Random(n)), "id long, t string")
        assert candidates(df, "id", "t", 0.6).count() <= n


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(9999)}"
    return " ".join(words)


def near_rows(seed=7):
    rng, rows = random.Random(seed), []
    for g in range(40):
        words = [f"w{rng.randrange(9999)}" for _ in range(60)]
        for v in range(3):
            rows.append((len(rows) * 10, edited(rng, words, rng.choice([0, 1, 3, 8, 15]))))
    return rows + [(5000, rows[0][1].upper() + "!!"), (5001, None), (5002, ""), (5003, "abc"), (5004, "abc"), (5005, "x" * 200_000), (5006, "x" * 150_000)]


def brute(rows, threshold):
    sets = {i: set(neardup.pieces_of(t).tolist()) for i, t in rows if t}
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            out.add((a, b))
    return out


@pytest.mark.parametrize("tree_size", [2000, 2])
def test_near_duplicates_by_hand(spark, tree_size):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "id long, text string, class int, shard string")
    want = brute(rows, 0.6)
    got = {tuple(r) for r in as_pairs(*near_duplicates(df, "id", "text", 0.6, tree_size=tree_size)).collect()}
    assert len(got & want) >= 0.98 * len(want) and got <= want and len(want) > 40


def test_hot_shards_lose_no_candidate(spark):
    df = spark.createDataFrame(near_rows(9), "id long, text string").repartition(2)
    few, split = (sorted(tuple(r) for r in candidates(df, "id", "text", 0.6, hot=hot, tree_size=size).collect()) for hot, size in ((256, 2000), (1, 3)))
    assert few == split and few


def test_groups_by_hand(spark):
    rows = near_rows(8)
    df = spark.createDataFrame(rows, "id long, text string")
    membership, links = near_duplicates(df, "id", "text", 0.6)
    pairs = {tuple(r) for r in as_pairs(membership, links).collect()}
    parent = {i: i for i, t in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["group_id"] for r in groups(membership, links).collect()}
    assert got == {i: root(i) for i in got} and len(set(got.values())) < len(got)


def chains(spark):
    """(membership, links) of two chains of notes: 0, n-1, n-2, ..., 1, and random ids."""
    shuffled = random.Random(9).sample(range(1000, 1300), 300)
    steps = [p for c in ([0, *range(99, 0, -1)], shuffled) for p in itertools.pairwise(c)]
    ids = spark.range(100).union(spark.range(1000, 1300)).select("id", F.col("id").alias("class"), F.col("id").alias("rep"), F.lit(1).cast("long").alias("n"))
    return ids, spark.createDataFrame([(min(p), max(p), 0.7) for p in steps], "rep_a long, rep_b long, similarity double")


def test_long_chains_are_one_group(spark):
    got = {r["id"]: (r["group_id"], r["links"]) for r in groups(*chains(spark)).collect()}
    assert {i: g for i, (g, _) in got.items()} == {i: 0 if i < 100 else 1000 for i in [*range(100), *range(1000, 1300)]}
    assert sum(n for _, n in got.values()) == 2 * (99 + 299)


def test_unsettled_groups_are_an_error(spark):
    with pytest.raises(RuntimeError):
        groups(*chains(spark), max_rounds=1)


def test_many_copies(spark):
    rows = [(i, "the same text over and over again") for i in range(50)] + [(60, "The same text over and over again!")]
    rows += [(70, "the same text over and over again now"), (100, "another text of its own, not alike"), (101, "another text of its own, not alike")]
    near = near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t", 0.6)
    short = sorted(tuple(r) for r in as_pairs(*near, expanded=5).collect())
    # the 50 byte-identical copies are contracted; other texts of the class and of linked classes keep their pairs
    assert short == sorted([(0, i) for i in range(1, 50)] + [(0, 60), (0, 70), (60, 70), (100, 101)])
    assert {tuple(r) for r in as_pairs(*near).collect()} == brute(rows, 0.6)
    assert as_pairs(*near_duplicates(spark.createDataFrame([], "id long, t string"), "id", "t", 0.6)).count() == 0


def test_classes_and_links_tell_every_pair(spark):
    rows = [(i, "word after word of one text that many notes hold") for i in range(300)] + [(300 + i, f"word after word of one text that many notes hold {'abc'[i]}") for i in range(3)]
    membership, links = near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t", 0.6)
    of = defaultdict(list)
    for r in membership.collect():
        of[r["rep"]].append(r["id"])
    told = {p for ids in of.values() for p in itertools.combinations(sorted(ids), 2)}
    told |= {(min(a, b), max(a, b)) for r in links.collect() for a in of[r["rep_a"]] for b in of[r["rep_b"]]}
    assert told == brute(rows, 0.6) and len(told) == 303 * 302 // 2


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).columns
