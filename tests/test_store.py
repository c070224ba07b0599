import pytest

from marginalia.operators.store import OVERWRITTEN, NoteStore, upsert
from marginalia.schema import NOTE, NOTE_COLUMNS, UPSERT


def note(i, code, title="t", created="2024", **k):
    base = dict(id=i, video_id=f"v{i}", title=title, author="a", source_url="u", summary_markdown="s", tags="g", user_requirement="", created_at=created, duration_seconds=1.0, video_code=code, timestamp="x")
    return tuple((base | k)[c] for c in NOTE_COLUMNS)


def row(arrival, code, title, created="2025", **k):
    base = dict(video_id=f"n{arrival}", title=title, author="b", source_url="w", summary_markdown="S", tags="", user_requirement="r", created_at=created, duration_seconds=2.0, video_code=code, timestamp="old", arrival=arrival)
    return tuple((base | k)[f.name] for f in UPSERT)


def by_hand(notes, batch, now, stamp):
    out, top = {r[0]: dict(zip(NOTE_COLUMNS, r)) for r in notes}, max([r[0] for r in notes], default=0)
    for r in sorted((dict(zip([f.name for f in UPSERT], x)) for x in batch), key=lambda r: r["arrival"]):
        r["created_at"], r["timestamp"] = r["created_at"] or now, stamp
        same = [n for n in out.values() if r["video_code"] is not None and n["video_code"] == r["video_code"]]
        if same:
            same[0].update({c: r[c] for c in OVERWRITTEN})
        else:
            top += 1
            out[top] = {c: r.get(c, top) for c in NOTE_COLUMNS} | {"id": top}
    return sorted(tuple(n[c] for c in NOTE_COLUMNS) for n in out.values())


CASES = [
    [row(1, "new", "A")], [row(1, "c1", "A")], [row(1, "n", "A"), row(2, "n", "B"), row(3, "n", "C", created="")], [row(1, None, "A"), row(2, None, "A")],
    [row(1, "", "A"), row(2, "", "B")], [row(5, "c2", "late"), row(1, "c2", "early"), row(2, None, "x", created=None)], [],
]


@pytest.mark.parametrize("batch", CASES)
def test_upsert(spark, batch):
    notes = [note(1, "c1"), note(2, "c2"), note(7, None)]
    got = upsert(spark.createDataFrame(notes, NOTE), spark.createDataFrame(batch, UPSERT), "NOW", "STAMP")
    assert sorted(map(tuple, got.collect())) == by_hand(notes, batch, "NOW", "STAMP")


def test_upsert_into_nothing(spark):
    got = upsert(spark.createDataFrame([], NOTE), spark.createDataFrame(CASES[2], UPSERT), "NOW", "S").collect()
    assert [(r["id"], r["title"], r["video_id"]) for r in got] == [(1, "C", "n1")]


def test_lists_and_ties(spark):
    store = NoteStore(spark.createDataFrame([note(1, "a", created="2024"), note(2, "b", created="2024"), note(3, "c", created=None), note(4, "d", created="2025")], NOTE))
    assert [r["id"] for r in store.list_recent(10).collect()] == [4, 2, 1, 3]
    assert [r["id"] for r in store.list_recent(2, 1).collect()] == [2, 1]
    assert store.get_by_video_id("v2").first()["id"] == 2 and store.get_by_id(9).count() == 0
    assert store.list_recent(0).count() == 0
    with pytest.raises(ValueError):
        store.list_recent(-1)


def test_empty_stats(spark):
    r = NoteStore(spark.createDataFrame([], NOTE)).stats().first()
    assert (r["total_entries"], r["latest_entry"]) == (0, None)


def test_deletes(spark):
    store = NoteStore(spark.createDataFrame([note(1, "a"), note(2, None)], NOTE))
    assert [r["id"] for r in store.delete_by_code(spark.createDataFrame([("a",), (None,)], "video_code string")).collect()] == [2]
    assert [r["id"] for r in store.delete(spark.createDataFrame([(2,), (2,)], "id long")).collect()] == [1]
