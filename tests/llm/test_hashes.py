import hashlib

import numpy as np
import pyarrow as pa
import pytest

from panelfactor.llm import line_dedup, ngram_join, quality_rules, skew, store, textkernel

from .test_ngram_join import brute, texts


def thue_morse(n):
    """Two strings that every polynomial modulo 2^64 takes for each other, whatever its base."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def block(text):
    return next(iter(textkernel.blocks(pa.array([text]))))


def test_hashes_tell_thue_morse_strings_apart():
    a, b = thue_morse(4096)
    for x, y in ((a, b), (a[:64], b[:64])):
        ((h,), (g,)), ((i,), (j,)) = block(x).row_hashes(), block(y).row_hashes()
        assert h != i and g != j


def test_hashes_depend_on_the_bytes_alone():
    """Same bytes, same hash, wherever they lie; a change of one byte, of the order or of the length changes it."""
    rng = np.random.default_rng(3)
    seen = {}
    for n in [0, 1, 7, 8, 9, 15, 16, 17, 24, 100, 1000]:
        raw = rng.integers(97, 100, n).astype(np.uint8)
        for before in range(9):
            data = np.r_[np.full(before, 120, np.uint8), raw, np.full(9 - before, 121, np.uint8)]
            b = textkernel.Block(0, 1, data, np.array([0, len(data)]))
            one, two = b.hashes(np.array([before]), np.array([before + n]), wide=True)
            assert seen.setdefault(raw.tobytes(), (one[0], two[0])) == (one[0], two[0])
    raw = bytes(rng.integers(97, 123, 64).astype(np.uint8))
    other = [raw[8:16] + raw[:8] + raw[16:], raw[::-1], raw + b"\0", raw[:-1], *(raw[:k] + b"!" + raw[k + 1 :] for k in range(64))]
    hashes = [tuple(int(x[0]) for x in block(t.decode()).row_hashes()) for t in [raw, *other]]
    assert len(set(hashes)) == len(hashes)


def test_long_rows_in_steps_equal_short_ones(monkeypatch):
    text = "".join(np.random.default_rng(0).choice(list("ab é\n日 \t"), 5000))
    whole = block(text)
    words, hashed = whole.words(), whole.hashes(*whole.words(), wide=True)
    lines, points = whole.lines(), whole.span_points(*whole.words())
    grams = textkernel.shingles(hashed[0], whole.row_of(words[0]), 1, 5)[0]
    monkeypatch.setattr(textkernel, "STEP", 64)
    again = whole.hashes(*whole.words(), wide=True)
    assert all((a == b).all() for a, b in zip(words, whole.words(), strict=True)) and all((a == b).all() for a, b in zip(hashed, again, strict=True))
    assert all((a == b).all() for a, b in zip(lines, whole.lines(), strict=True)) and (points == whole.span_points(*words)).all()
    assert (grams == textkernel.shingles(again[0], whole.row_of(words[0]), 1, 5)[0]).all()
    assert [text.encode()[s:e].decode() for s, e in zip(*words, strict=True)] == text.split()


def test_line_dedup_keeps_lines_that_only_look_alike(make):
    a, b = thue_morse(1024)
    docs = make([(1, a), (2, a), (3, b)])
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs).collect()} == {1: 0, 2: 0, 3: 0}
    docs = make([(1, a), (2, a), (3, a), (4, b)])
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_ngram_join_and_rules_tell_them_apart(make):
    a, b = thue_morse(1024)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(make([(1, a), (2, b), (3, a)])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    rows = [(k, (a if k % 2 else b) + f"\nx{'ab'[k % 2]}" * 3) for k in range(42)]
    assert all(r.n_dup_lines == 2 for r in quality_rules.quality_rules(make(rows)).collect())


def test_sets_with_one_id_are_told_apart(make, monkeypatch):
    """With ids of a few bits at first, the second half of the hash decides."""
    monkeypatch.setattr(ngram_join, "_fingerprints", lambda tokens: np.zeros(len(tokens), np.uint64))
    rows = texts(4)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(make(rows)).collect()]
    assert sorted(got) == sorted(brute(rows))


@pytest.mark.parametrize("keys", [1, 2, 500])
def test_split_join_equals_a_join(spark, monkeypatch, keys):
    monkeypatch.setattr(skew, "HOT_KEYS", keys)
    rows = spark.createDataFrame([(k, [1, 1, 1, 2, 3, None, 9][k % 7]) for k in range(70)], "id long, a long")
    keyed = spark.createDataFrame([(1, 30, "x"), (2, 10, "y"), (3, 10, "z"), (None, 10, "n")], "b long, n long, v string")
    for how, want in (("inner", 60), ("left", 70)):
        got = skew.split_join(rows, keyed, {"a": "b"}, "n", 70, how).select("id", "a", "v").collect()
        assert len(got) == want and all(r.v == {1: "x", 2: "y", 3: "z", None: "n", 9: None}[r.a] for r in got)


def test_many_copies_and_a_shared_template(make):
    """Copies of one text by the thousand, and texts that share three fifths of their words but no link."""
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(words)) for k in range(3000)] + [(5000 + k, " ".join([f"t{j}" for j in range(60)] + [f"{k}own{j}" for j in range(40)])) for k in range(600)]
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(make(rows)).collect()}
    assert all(got[k] == 0 for k in range(3000)) and all(got[5000 + k] == 5000 + k for k in range(600))


def test_folders_need_a_shared_place(spark):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, other=None: "spark://host:7077" if key == "spark.master" else None)

    with pytest.raises(ValueError, match="checkpoint"):
        store.shared_dir(Session)
    with store.scope():
        kept = store.written(spark.range(3), "scoped")
        path = kept._stored_at.removeprefix("file:")
        assert kept.count() == 3
    assert not __import__("os").path.exists(path.replace("//", "/"))


def test_line_runs_over_partitions_and_batches(make, spark, monkeypatch):
    """A line of very many documents, cut by range boundaries and batches, against counting it plainly."""
    monkeypatch.setattr(line_dedup, "LINES_PER_PARTITION", 37)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        line, pair = "this line is in all documents", "this one is in two documents"
        rows = [(k, "\n".join([line] * (1 + k % 3) + [pair] * (k in (7, 90)) + [f"own line of document {k:05d}"])) for k in range(200)]
        got = {r.doc_id: (r.n_dropped, hashlib.md5(r.text.encode()).hexdigest()) for r in line_dedup.dedup_lines(make(rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, text in rows:
        kept = text if k == 199 else "\n".join(x for x in text.split("\n") if x != line)
        assert got[k] == (0 if k == 199 else 1 + k % 3, hashlib.md5(kept.encode()).hexdigest())


def test_streamed_runs_equal_counting(monkeypatch):
    """Random runs cut into random partitions (by hash, then document from large to small, also inside a document) and batches."""
    rng = np.random.default_rng(0)
    names = ["hash", "twin", "doc_id", "text_key", "position"]
    for _ in range(200):
        rows = sorted({(int(rng.integers(0, 3)), 0, int(rng.integers(0, 8)), 0, int(rng.integers(0, 4))) for _ in range(rng.integers(1, 40))}, key=lambda r: (r[0], -r[2], r[4]))
        cuts = sorted({0, len(rows), *(int(x) for x in rng.integers(0, len(rows) + 1, 3))})
        size, out = int(rng.integers(1, 6)), []
        for a, b in zip(cuts, cuts[1:], strict=False):
            batches = (pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 4 else pa.int64()) for k, x in enumerate(zip(*rows[i : min(i + size, b)], strict=True))], names=names) for i in range(a, b, size))
            out += [r for batch in line_dedup._stream(batches) for r in batch.to_pylist()]
        total, keeper, holders, last = {}, {}, {}, {}
        for r in out:  # count rows come in the order of their parts
            if r["position"] == -1:
                again = last.get(r["hash"]) == r["doc_id"]
                total[r["hash"]] = total.get(r["hash"], 0) + r["documents"] - again
                keeper[r["hash"]] = max(keeper.get(r["hash"], -1), r["doc_id"])
                last[r["hash"]] = r["text_key"]
        got = [(r["doc_id"], r["position"]) for r in out if r["position"] >= 0 and (r["documents"] == 1 or (r["documents"] is None and total[r["hash"]] >= 3 and r["doc_id"] != keeper[r["hash"]]))]
        for r in rows:
            holders.setdefault(r[0], set()).add(r[2])
        assert sorted(got) == sorted((r[2], r[4]) for r in rows if len(holders[r[0]]) >= 3 and r[2] != max(holders[r[0]]))
