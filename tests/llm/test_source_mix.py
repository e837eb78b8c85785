import math
import random

import pytest

from panelfactor.llm import source_mix


def test_documents_are_taken_by_their_chances(make):
    """Within a source, the share of documents that get one copy more follows each class's fraction, and classes differ."""
    r = random.Random(4)
    rows = [(k, "w " * r.choice([1, 5, 40, 300]), s) for s, n in (("a", 3000), ("b", 2000), ("c", 1500)) for k in range(10_000 * ord(s), 10_000 * ord(s) + n)]
    got = source_mix.mix(make(rows)).collect()
    rates = {}
    for x in got:
        rates.setdefault((x.source, x.size), []).append(x.copies)
    seen = set()
    for source in "abc":
        own = {size: c for (s, size), c in rates.items() if s == source}
        one = next(x for x in got if x.source == source)
        # solve for c by halving
        low, high = 0.0, 10.0
        words = {size: size * len(c) for size, c in own.items()}
        due = lambda c, size: min(3.0, c * (source_mix.FLOOR + size.bit_length()))
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(words[s] * due(mid, s) for s in words) < one.target else (low, mid)
        for size, copies in own.items():
            d = due(low, size)
            assert set(copies) <= {math.floor(d), math.floor(d) + 1} and max(copies) <= 3
            assert sum(copies) / len(copies) == pytest.approx(d, abs=4 * math.sqrt(0.25 / len(copies)) + 0.01)
            seen.add((source, round(d, 6)))
    assert len(seen) > 6


def test_the_ranking_decides(make, monkeypatch):
    """Turning the inclusion odds into equal ones takes other documents."""
    r = random.Random(4)
    rows = [(k, "w " * r.choice([1, 5, 40, 300]), "ab"[k % 3 > 0]) for k in range(900)]
    taken = lambda: {x.doc_id for x in source_mix.mix(make(rows)).collect() if x.copies}
    before = taken()
    monkeypatch.setattr(source_mix, "FLOOR", 10_000)
    assert len(before ^ taken()) > 20


def test_null_ids_and_long_texts(make):
    rows = [(None, f"w{k} " * (k % 7), "s") for k in range(300)] + [(1, "w " * 1_000_000, "t"), (2, None, "t"), (3, "", None)]
    got = source_mix.mix(make(rows, True)).collect()
    assert len(got) == 303 and {x.copies for x in got if x.size == 0} == {0}
    mixed = source_mix.mixed_documents(make(rows, True))
    assert mixed.columns == make(rows, True).columns
    assert mixed.count() == sum(x.copies for x in got)
