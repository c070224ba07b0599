import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import codes as C
from marginalia.llm import leakage, packing, subjects, truncation
from marginalia.llm.leakage import fingerprints, leaked
from marginalia.llm.packing import OpenBins, count_tokens, pack, sizes, tokenizer_path
from marginalia.llm.text_queries import QUERIES
from marginalia.llm.truncation import ending, open_inline, truncated

# ---------------------------------------------------------------- code points


@given(st.lists(st.text(alphabet="abÉ中😀 \n1²İ　", max_size=30), max_size=6))
@settings(max_examples=200, deadline=None)
def test_kept_characters(texts):
    code, at = C.kept(texts, (1, 2))
    low = lambda c: c.lower() if len(c.lower()) == 1 else c
    got = ["".join(map(chr, code[a:b])) for a, b in zip(at, at[1:])]
    assert got == ["".join(low(c) for c in t if c.isalnum()) for t in texts]


@pytest.mark.parametrize("k", [1, 2, 5, 12, 13, 30])
def test_kgrams_agree_with_slices(k):
    code = np.random.default_rng(k).integers(97, 100, 300).astype(np.uint32)
    h = C.kgrams(code, k)
    seen = {}
    for i, x in enumerate(h.tolist()):
        assert seen.setdefault(tuple(code[i : i + k]), x) == x
    assert len(set(seen.values())) == len(seen) and len(h) == 301 - k
    assert len(C.kgrams(code[: k - 1], k)) == 0


# ---------------------------------------------------------------- p3

WHOLE = ["A whole note. It ends.", "完整的一段。结束了。", "Ends with a quote.”", "Code.\n```\nx = 1\n```", "Done.\n\n| a | 3 |", "Done.\n\n[more](https://x.example/1)", "完。\n\n#甲 #乙 #丙", "Done.\n\n## More\n- bank\n- cash flow", "Done.\n\n$$x = 1$$"]
CUT = ["Text with\n```\nx = 1", "A line **with bo", "see [the li", "he said “never", "broken �", "broken �...", "# T\n\nDone.\n\n## Next", "Done.\n3. ", "Done.\n3. **key**:", "entity &am", "escape \\u4f"]


@pytest.mark.parametrize("text", WHOLE)
def test_whole_structures(text):
    assert ending(text)[0] in ("ended", "empty")


@pytest.mark.parametrize("text", CUT)
def test_open_structures(text):
    assert ending(text)[0] == "open"


@pytest.mark.parametrize("text, left", [("a (b [c] d", ["("]), ("**x** `a ( b`", []), ("`a", ["`"]), ("“a「b", ["“", "「"]), ("$5 and $6", []), (") a", [])])
def test_stack(text, left):
    assert open_inline(text) == left


SUBJECTS = ["the compiler", "a fragile bridge", "the old harbour", "our second recipe", "the choir", "every market"]
VERBS = ["changes", "slows down", "supports", "quietly replaces"]
TAILS = ["near the closing minutes", "once the noise settles", "with almost no budget", "by the end of the month"]


def planted(seed=12):
    rng = random.Random(seed)
    sentence = lambda: f"{rng.choice(SUBJECTS).capitalize()} {rng.choice(VERBS)} {rng.choice(SUBJECTS)} {rng.choice(TAILS)}."
    rows, cut = [], set()
    for i in range(1500):
        text, source = " ".join(sentence() for _ in range(rng.randint(3, 12))), rng.choice(["limit", "transfer", "plain"])
        if source == "limit" and len(text) > 400:
            text = text[:400]
            if not text.endswith("."):
                cut.add(i)
        elif source == "transfer" and rng.random() < 0.2:
            text = text[: rng.randint(30, len(text) - 2)].rstrip()
            if not text.endswith("."):
                cut.add(i)
            text += "\n\n-- kept by the site" if rng.random() < 0.5 else ""
        elif source == "transfer" and rng.random() < 0.5:
            text += "\n\n-- kept by the site"
        elif source == "plain" and rng.random() < 0.1:
            text = text[:-1]  # whole, without its full stop
        rows.append((i, source, text))
    return rows, cut


def test_planted_cuts(spark):
    rows, cut = planted()
    extra = [(9001, "plain", None), (9002, None, ""), (9003, "plain", "  \n"), (9004, "plain", "w " * 100_000 + "end.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + extra], "id long, host string, t string, state string, source int")
    got = {r["id"] for r in truncated(df, "id", "t", "host").where("cut").collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.05 * len(cut), (len(cut), sorted(got - cut)[:5], sorted(cut - got)[:5])
    assert not got & {9001, 9002, 9003, 9004}
    assert truncated(df.limit(0), "id", "t", "host").count() == 0


LONG = "This copy was made for a private archive and may leave out pictures, tables and notes of the original page."
FOOTERS = {"short": "-- kept by the site", "long": LONG, "two": "Kept by the site.\n\nAll rights stay with the author of the note.", "five": "\n".join(f"Line {i} of what the site adds." for i in range(5)) + "\n#one #two"}


@pytest.mark.parametrize("footer", sorted(FOOTERS))
@pytest.mark.parametrize("broadcast", [True, False])
def test_footers_of_any_form(spark, monkeypatch, footer, broadcast):
    monkeypatch.setattr(truncation, "MAX_BROADCAST_FOOTERS", 10**6 if broadcast else 0)
    rows, cut = planted(13)
    rows = [(i, source, t.replace("-- kept by the site", FOOTERS[footer])) for i, source, t in rows]
    df = spark.createDataFrame(rows, "id long, host string, t string")
    got = {r["id"] for r in truncated(df, "id", "t", "host").where("cut").collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.05 * len(got), (len(cut), len(got & cut), len(got - cut))


# ---------------------------------------------------------------- p7


def valid(rows, sized, capacity):
    """Every text whole and in order, in containers that are not overfull; the share of unused space."""
    held, free, orders, numbers = {}, {}, {}, {}
    for r in rows:
        kind, no = r["container_kind"], r["container_no"]
        held.setdefault((kind, r["key"]), []).append((r["token_start"], r["token_end"]))
        free[kind, no] = free.get((kind, no), capacity[kind]) - (r["token_end"] - r["token_start"])
        orders.setdefault((kind, no), []).append(r["ord"])
        numbers.setdefault(kind, set()).add(no)
        assert r["tokens_free"] >= 0
    for kind, c in capacity.items():
        for key, n in sized.items():
            parts = sorted(held.pop((kind, key)))
            assert parts[0][0] == 0 and parts[-1][1] == n and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
            assert len(parts) == 1 or n > c
        assert numbers[kind] == set(range(1, len(numbers[kind]) + 1))
    assert not held and all(f >= 0 for f in free.values()) and all(sorted(o) == list(range(1, len(o) + 1)) for o in orders.values())
    return {k: sum(f for (x, _), f in free.items() if x == k) / (capacity[k] * len(numbers[k])) for k in capacity}


@pytest.mark.parametrize("lane_texts", [50_000, 100])
def test_packing_is_valid(spark, lane_texts):
    rng = random.Random(9)
    sized = {i: max(1, int(rng.lognormvariate(4, 1.2))) for i in range(3000)} | {5000: 100, 5001: 1}
    df = spark.createDataFrame([*sized.items(), (6000, 0), (None, 5)], "key long, tokens long")
    capacity = {"short": 100, "long": 700}
    unused = valid(pack(df, list(capacity.items()), lane_texts=lane_texts).collect(), sized, capacity)
    assert unused["short"] < 0.05 and unused["long"] < 0.02, unused


def test_the_plain_online_order(spark):
    """One text at a time into few open containers: the fullest close, and the filling is still valid."""
    rng = random.Random(10)
    sized = {i: max(1, int(rng.lognormvariate(4, 1.2))) for i in range(3000)}
    df = spark.createDataFrame([*sized.items()], "key long, tokens long")
    capacity = {"short": 100, "long": 700}
    for bins, most in ((4, 0.2), (64, 0.05)):
        unused = valid(pack(df, list(capacity.items()), open_bins=bins, window=1).collect(), sized, capacity)
        assert max(unused.values()) < most, unused


def test_violations_are_counted(spark):
    sized = spark.createDataFrame([(1, 5), (2, 4), (3, 12)], "key long, tokens long")
    good = [("k", 1, 1, 1, 0, 5, 1), ("k", 1, 2, 2, 0, 4, 1), ("k", 2, 3, 1, 0, 10, 0), ("k", 3, 3, 1, 10, 12, 8)]
    bad = [("k", 1, 1, 1, 0, 5, 0), ("k", 1, 2, 3, 0, 3, 0), ("k", 3, 3, 1, 0, 12, 0)]
    columns = "container_kind string, container_no long, key long, ord long, token_start long, token_end long, tokens_free long"
    broken = lambda rows: {r["rule"]: r["broken"] for r in packing.violations(spark.createDataFrame(rows, columns), sized, [("k", 10)]).collect()}
    assert set(broken(good).values()) == {0}
    assert broken(bad) == {"overfull": 1, "free space wrong": 2, "orders with gaps": 1, "numbers with gaps": 1, "text not whole": 1, "split without need": 0}


def test_packing_is_repeatable(spark):
    df = spark.range(500).select(F.col("id").alias("key"), (F.col("id") % 60 + 1).alias("tokens"))
    runs = [sorted(map(tuple, pack(d, [("k", 64)], lane_texts=50).collect())) for d in (df, df.repartition(7), df.orderBy(F.rand(1)))]
    assert runs[0] == runs[1] == runs[2]


def test_best_fit_and_fullest_closes():
    closed = []
    bins = OpenBins(10, 2, lambda free, items: closed.append((free, items)))
    for size, name in [(7, "a"), (5, "b"), (3, "c"), (4, "d"), (6, "e")]:
        bins.add(size, [name])
    # c fills a's bin exactly; d joins b; e needs a new bin
    assert closed == [(0, ["a", "c"])] and sorted(bins.rest()) == [(1, ["b", "d"]), (4, ["e"])]
    bins = OpenBins(10, 1, lambda free, items: closed.append((free, items)))
    bins.add(7, ["x"])
    bins.add(8, ["y"])
    assert closed[-1] == (3, ["x"])


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "字" * 3), (5, "word " * 100_000)], "id long, t string")
    got = {r["key"]: r["tokens"] for r in sizes(df, "id", "t", tokenizer_path()).collect()}
    assert 2 <= got[1] <= 4 and got[2] == got[3] == 0 and got[4] >= 3 and got[5] >= 100_000
    assert count_tokens("a b " * 60_000, tokenizer_path()) == len(packing._encoder(tokenizer_path()).encode_ordinary("a b " * 60_000))
    assert pack(df.limit(0).select(F.col("id").alias("key"), F.lit(1).alias("tokens")), [("k", 5)]).count() == 0


# ---------------------------------------------------------------- p8


@given(st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_every_long_span_is_found(seed):
    rng = random.Random(seed)
    text = lambda n: np.array([rng.randrange(97, 100) for _ in range(n)], np.uint32)
    k, w = 8, 9
    span = text(k + w - 1)
    a, b = (np.concatenate([text(rng.randint(0, 80)), span, text(rng.randint(0, 80))]) for _ in range(2))
    assert set(fingerprints(a, k, w)[0].tolist()) & set(fingerprints(b, k, w)[0].tolist())


def letters(s):
    return "".join(c for c in s if c.isalpha()).lower()


def share_by_hand(item, doc, n):
    q, d = letters(item), letters(doc)
    covered = set()
    for i in range(len(q) - n + 1):
        if q[i : i + n] in d:
            covered.update(range(i, i + n))
    return len(covered), len(q)


def test_repeated_syllables_cost_their_length():
    """One fingerprint at every second place of both texts: the product of the places is never formed."""
    import time

    index = leakage.ItemIndex([1, 2], ["ba" * 1200, "na" * 100 + "ba" * 100], 60)
    code, at = C.kept(["ba" * 10_000, "xyz" * 100], (1,))
    began = time.perf_counter()
    pairs = index.candidates(code, at)
    assert pairs.tolist() == [[0, 0], [0, 1]] and index.shared(code[at[0] : at[1]]).tolist() == [2400, 201]
    assert time.perf_counter() - began < 0.1


@pytest.mark.parametrize("block_letters", [1_000_000, 1500])
def test_leaks_by_hand(spark, monkeypatch, block_letters):
    monkeypatch.setattr(leakage, "SLICE", 500)
    rng = random.Random(10)
    words = [f"{chr(97 + i % 26)}{'abcdefgh'[i % 8]}o{chr(97 + i * 7 % 26)}" for i in range(200)]
    items = [(i, " ".join(rng.choices(words, k=40)), 20) for i in range(25)] + [(90, None, 20), (91, "short", 20), (92, "", 20)]
    items.append((93, items[0][1], 20))
    docs = []
    for d in range(120):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 300)))]
        for _ in range(rng.randint(0, 3)):
            t = items[rng.randrange(25)][1].split(" ")
            a = rng.randrange(len(t))
            parts += [" ".join(t[a : a + rng.randint(1, 40)]).title() + " 12, ", " ".join(rng.choices(words, k=rng.randint(0, 30)))]
        docs.append((d, "".join(parts), 1))
    docs += [(900, None, 1), (901, "", 1), (901, "", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    it = spark.createDataFrame(items, "item_id long, text string, stretch int")
    got = {(r["doc_id"], r["item_id"]): (r["shared_letters"], r["item_letters"]) for r in leaked(df, "doc_id", "text", it, "item_id", "text", "stretch", block_letters=block_letters).collect()}
    want = {}
    for d, text, _ in docs:
        for i, item, n in items:
            if text and item:
                c, of = share_by_hand(item, text, n)
                if c and c * 5 >= 2 * of:
                    want[d, i] = (c, of)
    assert got == want and len(want) > 30
    assert leaked(df, "doc_id", "text", it.limit(0), "item_id", "text", "stretch").count() == 0
    assert leaked(df.limit(0), "doc_id", "text", it, "item_id", "text", "stretch").count() == 0


# ---------------------------------------------------------------- p9


def test_terms_and_sentences():
    code, _ = C.joined(["Red red 编译器, v2.0 ok. 完。\nx"])
    slot, at = subjects.terms(code)
    text = "Red red 编译器, v2.0 ok. 完。\nx"
    assert [text[a] for a in at] == ["R", "r", "编", "译", "v", "o", "x"] and slot[0] == slot[1]
    ends = subjects.sentence_ends(code)
    assert [text[i] for i in np.flatnonzero(ends)] == [".", "。", "\n"]


WORDS = {"red": ["rose", "ruby", "fire", "brick", "cherry"], "blue": ["sea", "sky", "ink", "jeans", "whale"], "green": ["leaf", "moss", "frog", "lime", "pine"]}


def coloured(seed=14, n=600):
    rng, docs, truth, labels = random.Random(seed), [], set(), []
    filler = "it is said that here and there one may find a piece of every kind".split()
    for i in range(n):
        mix = rng.choice([["red"], ["blue"], ["green"], ["red", "blue"], ["green", "red"], []])
        about = [rng.choice(mix) if mix and rng.random() < 0.8 else None for _ in range(10)]
        lines = [" ".join(rng.sample(filler, 5) + (rng.choices(WORDS[a], k=2) if a else [])) + "." for a in about]
        docs.append((i, " ".join(lines)))
        truth |= {(i, a) for a in set(about) - {None} if about.count(a) * 4 >= len(about)}
        if i % 2:
            labels += [(i, rng.choice([a.upper(), f" {a}"]), "x") for a in set(mix)] if rng.random() < 0.9 else [(i, rng.choice(list(WORDS)), None)]
    return docs, truth, labels + labels[:20] + [(1, None, None), (3, "unknown", "x")]


def test_subjects_of_planted_documents(spark):
    docs, truth, labels = coloured()
    df = spark.createDataFrame(docs + [(9000, None), (9001, ""), (9002, "…!"), (9003, "sky sea. " * 30_000)], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, annotator string")
    h = subjects.fit(df, "doc_id", "text", lab, "subject", sorted(WORDS))
    got = {(r["doc_id"], r["subject"]) for r in subjects.subjects_of(df, "doc_id", "text", h, sorted(WORDS)).collect()}
    assert (9003, "blue") in got and not {g for g in got if g[0] in (9000, 9001, 9002)}
    held_out = {t for t in truth if not t[0] % 2}
    found = {g for g in got if g[0] < 9000 and not g[0] % 2}
    assert len(found & held_out) >= 0.9 * max(len(found), len(held_out)), (len(found), len(held_out), len(found & held_out))
    assert subjects.subjects_of(df.limit(0), "doc_id", "text", h, sorted(WORDS)).count() == 0


@pytest.mark.parametrize("sample", [16, 24, 3000])
def test_mixture_of_the_fit_is_the_same_at_every_size(spark, monkeypatch, sample):
    df = spark.createDataFrame([(i, f"word{i % 5} other{i % 7}. again word{i % 5}.") for i in range(100)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, "red") for i in range(24)], "doc_id long, subject string")
    seen = []
    monkeypatch.setattr(subjects, "factor", lambda doc, slot, n, seeds: seen.append(seeds.any(1)))
    subjects.fit(df, "doc_id", "text", lab, "subject", ["red"], sample)
    labelled = min(sample, 24)
    assert (seen[0].sum(), (~seen[0]).sum()) == (labelled, int(1.375 * labelled))


@pytest.mark.parametrize("broadcast", [True, False])
def test_fit_takes_all_documents_and_labels(spark, monkeypatch, broadcast):
    """The model is that of the counts of every document, however few carry labels, whichever way blocks and labels come together."""
    if not broadcast:
        monkeypatch.setattr(subjects, "LABELLED", 10)
    docs, _, labels = coloured()
    labels = [x for x in labels if x[0] < 60]
    docs += [(700 + i, f"late{i % 3} words{i % 2} sky.") for i in range(30)] + [(800, "sea whale. " * 5_000), (801, None), (802, ""), (None, "ruby.")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "doc_id")
    h = subjects.fit(df, "doc_id", "text", spark.createDataFrame(labels, "doc_id long, subject string, annotator string"), "subject", sorted(WORDS))
    docs = [(i, t) for i, t in docs if t and i is not None]
    doc, slot, n = [], [], []
    for d, (_, text) in enumerate(docs):
        s, c = np.unique(subjects.terms(C.joined([text])[0])[0], return_counts=True)
        doc, slot, n = doc + [d] * len(s), slot + s.tolist(), n + (c * min(1, subjects.DOC_TERMS / c.sum())).tolist()
    doc, slot, n = np.array(doc), np.array(slot), np.array(n)
    seeds = np.array([[any(x[0] == i and x[1] and x[1].strip().lower() == s for x in labels) for s in sorted(WORDS)] for i, _ in docs], np.float32)
    keep = np.bincount(slot, minlength=subjects.SLOTS)[slot] >= subjects.LEAST_DOCS
    want = subjects.factor(doc[keep], slot[keep], n[keep], seeds)
    assert ((h > 0) == (want > 0)).all() and np.allclose(h, want, rtol=0.01, atol=1e-5), np.abs(h - want).max()


def test_folding_in_is_that_of_single_terms_and_takes_less_time():
    """W of rows of all widths, repeated terms and one very long row, against updates that go over each term by itself."""
    rng = np.random.default_rng(5)
    h = np.concatenate([rng.random((900, 24), np.float32) ** 8, np.zeros((1, 24), np.float32)])
    width = np.concatenate([np.arange(1, 90), rng.integers(1, 120, 3000), [40_000]])
    rng.shuffle(width)
    row, first = rng.integers(0, 900, width.sum()), np.append(0, np.cumsum(width)[:-1])
    w = rng.random((len(width), 24), np.float32)

    def plain():
        own = w
        for _ in range(subjects.FOLD_ROUNDS):
            part = np.repeat(own, width, axis=0) * h[row]
            part /= part.sum(1, keepdims=True) + 1e-20
            terms_of = np.add.reduceat(part, first, axis=0)
            own = terms_of + 0.05
            own /= own.sum(1, keepdims=True)
        return own, terms_of

    def timed(f):
        start = time.process_time()
        return f(), time.process_time() - start

    runs = [(timed(plain), timed(lambda: subjects._folded(h, row, first, w, subjects.FOLD_ROUNDS))) for _ in range(3)]
    for a, b in zip(runs[0][0][0], runs[0][1][0]):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-5)
    assert min(b for _, (_, b) in runs) < 0.7 * min(a for (_, a), _ in runs)


@pytest.mark.parametrize(("exact", "size"), [(1, 8), (3, 1), (10_000, 30)])
def test_last_update_writes_sums_alone(monkeypatch, exact, size):
    """Blocks are written again only where an update follows, and H is the same however many blocks are added up in single precision."""
    monkeypatch.setattr(subjects, "EXACT_BLOCKS", exact)
    monkeypatch.setattr(subjects, "DENSE_DOCS", size)
    monkeypatch.setattr(subjects, "_settled", lambda: None)
    texts = [t for _, t in coloured(n=100)[0]]
    docs = list(subjects._documents(iter([pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts)], names=["doc", "t"])])))
    used = np.flatnonzero(np.frombuffer(docs[-1]["sums"][0].as_py())[:-1])
    at = np.full(subjects.SLOTS, -1, np.int32)
    at[used] = np.arange(len(used))
    labels = pa.array([[i % 3] if i % 2 else None for i in range(100)], pa.list_(pa.int32()))
    rows = [pa.RecordBatch.from_arrays([*d.columns[:3], labels.slice(0, d.num_rows)], names=["doc", "slots", "n", "own"]) for d in docs[:-1]]
    *blocks, sums = subjects._blocks(iter(rows), at, 3, 2)
    sums = np.frombuffer(sums["sums"][0].as_py()).reshape(len(used), 4)
    counts = np.concatenate([np.frombuffer(x, np.int32) for d in docs[:-1] for x in d["n"].to_pylist()])
    assert np.isclose(sums[:, 0].sum(), counts.sum()) and np.isclose(sums[:, 1:].sum(), sum(np.frombuffer(x, np.int32).sum() for x in docs[0]["n"].to_pylist()[1::2]))
    h = subjects._first_h(sums[:, 0], sums[:, 1:], 2)
    blocks = [b.select(["block", "size", "w"]) for b in blocks]
    assert sum(b.num_rows for b in blocks) == -(-100 // size)
    *again, first = subjects._updated(iter(blocks), h, False)
    (last,) = subjects._updated(iter(blocks), h, True)
    assert sum(b.num_rows for b in again) == sum(b.num_rows for b in blocks) and first.equals(last)
    total = (h * np.frombuffer(last["sums"][0].as_py(), np.float32).reshape(h.shape)).sum()
    assert np.isclose(total, counts.sum(), rtol=1e-4)  # every counted term speaks for the components once


@pytest.mark.parametrize("most", [0, 100_000_000])
def test_sums_are_the_same_whether_added_up_before_the_driver(spark, monkeypatch, most):
    monkeypatch.setattr(subjects, "SUMS_BYTES", most)
    rows = [(None,), *((np.arange(5, dtype=np.float32).tobytes(),) for _ in range(7))]
    for parts in (1, 3, 12):
        df = spark.createDataFrame(rows, "sums binary").repartition(parts)
        assert subjects._summed(df, np.float32, 5).tolist() == subjects._summed(df, np.float32, 5, few=False).tolist() == [0, 7, 14, 21, 28]


def test_without_labels_nothing_has_a_subject(spark):
    df = spark.createDataFrame([(1, "red rose.")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, subject string")
    h = subjects.fit(df, "doc_id", "text", lab, "subject", ["red"])
    assert subjects.subjects_of(df, "doc_id", "text", h, ["red"]).count() == 0


def test_agreement_with_labels(spark):
    """Hand labels that were used neither for the fit nor for choosing a parameter; some of them are wrong."""
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/subject_labels.parquet")
    labels = labels.withColumn("subject", F.lower(F.trim("subject"))).where("subject IS NOT NULL").distinct()
    names = sorted(r[0] for r in spark.read.parquet(f"{data}/subjects.parquet").select("subject").collect())
    labels = labels.where(F.col("subject").isin(names))
    h = subjects.fit(docs, "doc_id", "text", labels.where("doc_id % 3 != 0"), "subject", names)
    held = {(r["doc_id"], r["subject"]) for r in labels.where("doc_id % 6 = 3").collect()}
    some = docs.where(F.col("doc_id").isin([i for i, _ in held]))
    got = {(r["doc_id"], r["subject"]) for r in subjects.subjects_of(some, "doc_id", "text", h, names).collect()}
    assert len(got & held) >= 0.9 * len(held) and len(got & held) >= 0.85 * len(got), (len(got), len(held), len(got & held))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).columns


def test_p7_query_is_valid(spark, data):
    kinds = {r[0]: r[1] for r in spark.read.parquet(f"{data}/containers.parquet").collect()}
    sized = {r["key"]: r["tokens"] for r in sizes(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text", tokenizer_path()).collect() if r["tokens"]}
    valid(QUERIES["p7_packed"](spark, data).withColumnRenamed("doc_id", "key").collect(), sized, kinds)


def test_odd_texts_take_linear_time():
    for text in ("$" * 200_000, "(" * 100_000 + "**" * 100_000, "```\n" * 50_001, "#a\n" * 100_000, "- x\n" * 100_000, "“" * 100_000, "<" * 100_000, "`" * 100_001, "a" * 300_000):
        ending(text)
        ending("Done.\n" + text)
