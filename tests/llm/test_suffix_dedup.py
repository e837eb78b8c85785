import hashlib
import random

import numpy as np
import pytest

from panelfactor.llm import suffix_dedup
from panelfactor.llm.suffix_arrays import FIRST, common_prefixes, suffix_array


def pieces(seed):
    r = np.random.default_rng(seed)
    out = [bytes(r.integers(97, 98 + r.integers(0, 3), r.integers(0, 60)).astype(np.uint8)) for _ in range(r.integers(1, 7))]
    return [*out, out[0], b"a" * 90, b"a" * 75, b"\0" * 20, b""] if seed % 2 else out


@pytest.mark.parametrize("seed", range(40))
def test_suffix_order_and_common_prefixes(seed):
    own, length = pieces(seed), 1 + seed
    data, bounds = np.frombuffer(b"".join(own), np.uint8), np.r_[0, np.cumsum([len(p) for p in own])]
    suffixes = [p[k:] for p in own for k in range(len(p))]
    order, near = suffix_array(data, bounds, length)
    assert sorted(order) == list(range(len(data)))
    assert [suffixes[k][:length] for k in order] == sorted(s[:length] for s in suffixes)

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    want = [0] + [common(suffixes[a], suffixes[b]) for a, b in zip(order[1:], order[:-1], strict=True)]
    shown = lambda x: 0 if x < FIRST else min(x, max(length, FIRST))
    assert [shown(x) for x in common_prefixes(data, bounds, order, near, length)] == [shown(x) for x in want[: len(order)]]


def test_common_prefixes_beyond_their_reach(monkeypatch):
    from panelfactor.llm import suffix_arrays

    monkeypatch.setattr(suffix_arrays, "REACH", 16)
    data, bounds = np.frombuffer(b"ab" * 300 + b"ab" * 200, np.uint8), np.array([0, 600, 1000])
    order, near = suffix_array(data, bounds, 8)
    prefix = common_prefixes(data, bounds, order, near, 8)
    left = bounds[np.searchsorted(bounds, order, side="right")] - order
    assert ((prefix >= 8) == np.r_[False, (np.minimum(left[1:], left[:-1]) >= 8) & (order[1:] % 2 == order[:-1] % 2)]).all()


def brute(rows, length=50):
    texts = [(doc, (text or "").encode()) for doc, text in rows]
    first = {}
    for doc, t in texts:
        for p in range(len(t) - length + 1) if doc is not None else ():
            first[t[p : p + length]] = min(doc, first.get(t[p : p + length], doc))
    out = []
    for doc, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1) if doc is not None else ():
            if first[t[p : p + length]] < doc:
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((doc, len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def documents(seed):
    r = random.Random(seed)
    some = lambda n: "".join(r.choice("abcdé \n") for _ in range(n))
    passages = [some(n) for n in (49, 50, 51, 80, 200)] + ["x" * 300, "xy" * 100]
    rows = []
    for k in range(40):
        rows.append((k, "".join(r.choice([some(r.randrange(90)), r.choice(passages), r.choice(passages)[r.randrange(40) :]]) for _ in range(r.randrange(6)))))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (3, rows[3][1]), (7, rows[5][1]), (None, rows[3][1]), (None, passages[4]), (-5, passages[4]), (102, None), (103, ""), (104, passages[1]), (105, passages[0]), (103, passages[3])]
    return rows


@pytest.mark.parametrize(("seed", "shard"), [(1, None), (2, None), (1, 300), (3, 150)])
def test_what_is_removed_equals_brute_force(spark, make, monkeypatch, seed, shard):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 3_000)  # several blocks
    monkeypatch.setattr(suffix_dedup, "STEP", 257)
    monkeypatch.setattr(suffix_dedup, "RANGE", 200)
    if shard:  # keys over several shards, merged by binary search
        monkeypatch.setattr(suffix_dedup, "SHARD", shard)
        monkeypatch.setattr(suffix_dedup, "HEAVY", 100)
    rows = documents(seed)
    got = [tuple(r) for r in suffix_dedup.remove_repeats(make(rows, True)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_merging_finds_the_smallest_document_of_all_lists():
    r = np.random.default_rng(5)
    all_ = np.unique(r.integers(97, 99, (400, 50)).astype(np.uint8), axis=0)
    import pyarrow as pa

    lists, best = [], {}
    for number in range(4):
        some = np.sort(r.choice(len(all_), 150, replace=False))
        lows = r.integers(0, 1000, 150)
        lists.append((7, 0, number, all_[some].tobytes(), lows.tobytes()))
        for k, low in zip(some, lows, strict=True):
            best[all_[k].tobytes()] = min(low, best.get(all_[k].tobytes(), low))
    columns = [pa.array(c) for c in zip(*lists, strict=True)]
    out = suffix_dedup._merge(50)(pa.table(columns, names=["key", "part", "slice", "strings", "lows"]))
    got = {(n, s[k : k + 50]): low for n, s, v in zip(out["slice"].to_pylist(), out["strings"].to_pylist(), out["lows"].to_pylist(), strict=True) for k, low in zip(range(0, len(s), 50), np.frombuffer(v, np.int64), strict=True)}
    want = {(n, s[k : k + 50]): best[s[k : k + 50]] for _, _, n, s, v in lists for k, low in zip(range(0, len(s), 50), np.frombuffer(v, np.int64), strict=True) if best[s[k : k + 50]] < low}
    assert got == want


def test_empty_table_and_texts_without_repeats(make):
    assert suffix_dedup.remove_repeats(make([])).count() == 0
    got = suffix_dedup.remove_repeats(make([(1, None), (2, "short"), (2, "short")])).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(1, 0, 0, 0), (2, 5, 0, 0), (2, 5, 0, 0)]


def test_long_text_of_one_letter_and_plan_without_shuffled_texts(spark, make, capsys):
    rows = [(1, "b" * 300_000), (2, "c" + "b" * 200_000), (3, "b" * 49)]
    out = suffix_dedup.remove_repeats(make(rows))
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in out.collect()) == [(1, 0, 0), (2, 200_000, 1), (3, 0, 0)]
    out.explain()
    plan = capsys.readouterr().out
    branch = plan[plan.index("FlatMapCoGroupsInArrow") : plan.index("FileScan")]
    assert "Exchange" not in branch  # from the blocks' scan up to the last step
