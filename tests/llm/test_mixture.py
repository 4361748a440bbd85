"""Slots take blocks of documents."""

import pytest

from tidewatch.llm import mixing

ROWS = [(i, "a" if i % 3 else None, i * 7 % 41) for i in range(90)] + [(1000, "b", 5), (1001, "b", 0), (1001, "b", 0), (1002, "c", 0)]


@pytest.mark.parametrize("block", [1, 7, 64])
def test_taken_is_what_ranked_slots_take(spark, block):
    rows = spark.createDataFrame(ROWS, "doc_id long, source string, size long")
    got = mixing.mix(rows, block_words=block, stretch_rows=10).toPandas()
    slots = mixing.ranked(mixing.schedule(mixing.source_targets(rows), block)).toPandas()
    assert len(got) == len(ROWS)
    of = lambda df, s: df[df.source.isna()] if s is None else df[df.source == s]
    for source in ("a", "b", "c", None):
        own, ranks = of(got, source), set(of(slots, source)["rank"])
        total = own["size"].sum()
        for r in own.itertuples():
            words = [p * total + r.place + i for p in range(3) for i in range(r.size)]
            assert r.taken == sum(w // block in ranks for w in words)
            at = min(r.place, total - 1)
            assert r.copies == (sum((p * total + at) // block in ranks for p in range(3)) if total else 0)


def test_a_slot_that_is_missing_takes_nothing(spark, monkeypatch):
    """The words come from the join of slots and blocks, not from how many slots there are."""
    rows = spark.createDataFrame([(i, "a", 10) for i in range(20)], "doc_id long, source string, size long")
    whole = mixing.ranked
    monkeypatch.setattr(mixing, "ranked", lambda slots: whole(slots).filter("rank <> 3"))
    assert mixing.mix(rows, block_words=10).toPandas().taken.sum() == 190
