import random
import re

import pytest

from panelfactor.llm import ngram_join


def brute(rows, size=5):
    """component_id by sets and a search, one doc at a time."""
    sets = []
    for _, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc))
    return out


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4)))
    rows, k = [], 0
    for _ in range(12):
        base = [word() for _ in range(r.choice([1, 3, 5, 12, 40, 120]))]
        for _ in range(r.choice([1, 1, 4, 9])):
            ws = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                ws[r.randrange(len(ws))] = word()
            text = r.choice([" ", "\n", " \t"]).join(ws)
            rows.append((k, text.upper() if r.random() < 0.2 else text))
            k += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, 50_000), (2, 50_000), (1, 2), (2, 4)])
def test_classes_equal_brute_force(make, monkeypatch, seed, hot):
    monkeypatch.setattr(ngram_join, "BUCKET", 3)  # several cells for each tree
    monkeypatch.setattr(ngram_join, "MIN_HOT", hot)  # whichever tokens count as frequent
    monkeypatch.setattr(ngram_join, "PACK", 200)  # several flushes in a task
    rows = [*texts(seed), (900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "ONE  two"), (905, "É x"), (906, "é x"), (None, "one two"), (903, "one two")]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(make(rows, True)).collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_one_row_of_each_class_stays(make):
    rows = texts(3) + [(900, None), (901, "")]
    docs = make(rows)
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    want = {d for d, n, c in brute(rows) if d == c}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    twice = docs.unionByName(docs)
    assert sorted(r.doc_id for r in ngram_join.representatives(twice).where("text <> ''").collect()) == sorted(d for d in want if d not in (900, 901))


def test_empty_table(make):
    assert ngram_join.near_duplicates(make([(1, "a")]).where("false")).count() == 0
    assert ngram_join.representatives(make([(1, "a")]).where("false")).count() == 0


def test_the_largest_group_of_postings_fits_a_task():
    """A range holds GROUP_TOKENS postings on average and at most about MIN_HOT of one token: held here against three times as much, all of one token."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    n, flushes = 1_000_000, 3 * (ngram_join.GROUP_TOKENS + ngram_join.MIN_HOT) // 1_000_000
    names = ["part", "tokens", "owners", "sets", "sizes"]
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(flushes):
        sets = rng.integers(-(1 << 62), 1 << 62, n)
        token = np.full(n, 12345, np.uint64)
        rows.append((0, ngram_join._pack_tokens(token), ngram_join._planes(np.arange(n, dtype=np.uint32)), sets.tobytes(), ngram_join._planes(np.full(n, 9, np.uint32))))
    columns = [pa.array(c, pa.int64() if k == 0 else pa.binary()) for k, c in enumerate(zip(*rows, strict=True))]
    del rows
    table = pa.table(columns, names=names)
    tracemalloc.start()
    out = ngram_join._shared(1)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(x.as_buffer()) for x in out["sets"]) == 8 * n * flushes and peak < 400e6


def test_frequent_tokens_are_found_at_a_fixed_number_of_sets(make, monkeypatch):
    """Whatever the corpus holds besides, the same tokens go past the grouping."""
    monkeypatch.setattr(ngram_join, "MIN_HOT", 40)
    often = "five words that many have"
    for more in (0, 400):
        rows = [(k, f"{often} number{k} only{k}") for k in range(60)] + [(1000 + k, f"other words of text {k} and {k} more {k}") for k in range(more)]
        slim = make(rows).selectExpr("doc_id", "text", "xxhash64(text) AS text_key")
        assert len(ngram_join._hot_tokens(slim, 5, len(rows))) == 1


def test_texts_without_a_link_are_not_sent_whole(make, monkeypatch, spark):
    """Unrelated texts shuffle under five bytes a token, though ranges of tokens are so many that a set has few tokens in each."""
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 2_000)
    r = random.Random(5)
    rows = [(k, " ".join(str(r.randrange(10**6)) for _ in range(204))) for k in range(600)]
    rows.append((600, rows[7][1] + " more"))
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = sent()
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(make(rows)).collect()}
    assert got == {k: 7 if k == 600 else k for k in range(601)}
    assert 0 < sent() - before < 5 * 600 * 200
