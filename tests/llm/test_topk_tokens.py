import numpy as np
import pyarrow as pa
import pytest

from panelfactor.llm import token_counts, topk_search
from tests.conftest import SF


def brute(vectors, k):
    good = [(i, np.floor(64 * np.array(v, float))) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    rows = []
    for q in sorted({i for i, _ in good if i % 20 == 0}):
        scores = sorted((-int(u @ v), i) for j, u in good if j == q for i, v in good if i != q)[:k]
        rows += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return rows


@pytest.mark.parametrize("probe", [1, 3])
def test_small_tables_ties_and_bad_vectors(spark, monkeypatch, probe):
    monkeypatch.setattr(topk_search, "ROW_BLOCK", 16 * 6)
    monkeypatch.setattr(topk_search, "WAVE", 2 * 6)
    monkeypatch.setattr(topk_search, "PROBE", probe)
    monkeypatch.setattr(topk_search, "TILE_ROWS", 5)
    rng = np.random.default_rng(0)
    vectors = [(k, [float(x) for x in rng.integers(-2, 3, 6)]) for k in range(130)]  # small whole numbers: many ties
    vectors[20] = (20, None)
    vectors[41] = (41, [1.0, None, 0.0, 0.0, 0.0, 0.0])
    vectors[42] = (42, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0])
    vectors[43] = (43, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0])
    # repeated rows, ids of several vectors (queries among them), null ids
    vectors += [vectors[3], vectors[3], vectors[40], (40, [1.0] * 6), (5, [2.0] * 6), (5, [-1.0] * 6), (None, [2.0] * 6), (-20, [0.5] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as rank")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.top_k(df, 7).collect())
    assert got == sorted(brute(vectors, 7))
    few = spark.createDataFrame(vectors[:3], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"]) for r in topk_search.top_k(few).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert topk_search.top_k(few.where("false")).count() == 0
    assert topk_search.top_k(few.where("vec_id = 0")).count() == 0


def test_few_scores_are_resolved():
    """The cutoff of a quarter of the rows leaves under a fifth of all pairs to resolve, and none that counts is lost."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(8000, 64))
    v = np.floor(64 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    q = v[:100]
    own = np.arange(100)[:, None] == np.arange(8000)[None, :]
    score = q @ v.T
    score[own] = np.iinfo(np.int64).min
    probe = topk_search.Slices(v[::4], q, 2)
    at, found = probe.gathered(slice(0, 100), slice(0, 2000), own[:, ::4], 20)
    cutoff = np.array([np.sort(found[at == k])[-20] for k in range(100)], float)
    assert (cutoff <= np.sort(score, axis=1)[:, -20]).all() and probe.resolved < 0.1 * 100 * 2000
    meet = topk_search.Slices(v, q, 2)
    at, row, got = meet.reaching(slice(0, 100), slice(0, 8000), own, cutoff)
    assert meet.resolved < 0.2 * 100 * 8000
    want = {(a, b) for a, b in zip(*np.nonzero(score >= cutoff[:, None]), strict=True)}
    assert {(a, b) for a, b in zip(at.tolist(), row.tolist(), strict=True)} == want and (got == score[at, row]).all()


def test_norms_pass_whole_blocks_over(spark, monkeypatch):
    """Rows far shorter than those that fill the lists are in blocks of their own, for which no score is made."""
    rng = np.random.default_rng(2)
    long = [(k, [float(x) for x in rng.integers(5, 9, 8)]) for k in range(100)]
    short = [(100 + k, [float(x) / 64 for x in rng.integers(-2, 3, 8)]) for k in range(900)]
    df = spark.createDataFrame(long + short, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.top_k(df.where("vec_id < 1000"), 20).collect())
    assert got == sorted(brute(long + short, 20))
    seen = []
    whole = topk_search.Slices.reaching
    monkeypatch.setattr(topk_search.Slices, "reaching", lambda self, *a: seen.append(1) or whole(self, *a))
    pack = lambda rows: topk_search._pack(pa.table({"block": pa.array([0] * len(rows), pa.int64()), "vec_id": pa.array([k for k, _ in rows], pa.int64()), "v": pa.array([[int(64 * y) for y in x] for _, x in rows], pa.list_(pa.int64()))}))
    value = lambda x: type("Sent", (), {"value": x})
    asked = value((np.array([k for k, _ in long[:5]]), np.array([[int(64 * y) for y in x] for _, x in long[:5]])))
    meet = topk_search._collect(asked, value(np.full(5, 400_000.0)), 20, 2)
    assert next(meet(pack(short).to_batches())).num_rows == 0 and not seen
    assert next(meet(pack(long).to_batches())).num_rows > 0 and seen


@pytest.mark.parametrize("wave", [1 << 23, 10])
def test_repeated_ids_equal_the_sql(spark, monkeypatch, wave):
    import duckdb

    monkeypatch.setattr(topk_search, "WAVE", wave)
    rng = np.random.default_rng(8)
    told = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (1, [5.0, 5.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (20, [0.5, 0.5])]
    many = [(int(rng.integers(0, 60)), [float(x) for x in rng.integers(-3, 4, 2)]) for _ in range(400)]
    for rows, n in ((told, 10), (many, None)):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = sorted(tuple(r) for r in topk_search.top_k(df).collect())
        con = duckdb.connect()
        con.register("embeddings", df.toPandas())
        assert got == sorted(con.execute(topk_search.OP1_SQL).fetchall())
        assert n is None or (len(got) == n and got[0] == (0, 1, 1, 64 * 64 * 15))


def brute_counts(flat, separator):
    """(n_tokens, ended) of the documents in one list of ids."""
    out, n = [], 0
    for x in flat:
        n += 1
        if x == separator:
            out.append((n - 1, True))
            n = 0
    return out + [(n, False)] * (n > 0)


@pytest.mark.parametrize(("width", "block"), [(2, 8), (4, 8), (4, 64), (2, 1 << 20)])
def test_files_of_any_cut(spark, tmp_path, width, block):
    """Random files against a plain count: documents longer than blocks, empty ones, cut files, odd bytes at the end."""
    rng = np.random.default_rng(width * block)
    want = {}
    for name, n in (("a", 0), ("b", 1), ("c", 7), ("d", 500), ("e", 500), ("f", 64)):
        ids = rng.integers(0, 40, n)
        ids[rng.random(n) < (0.3 if name != "e" else 0.01)] = 77
        (tmp_path / f"{name}.bin").write_bytes(ids.astype(f"<u{width}").tobytes() + b"\1" * (width - 1) * (name in "bd"))
        want[name] = brute_counts(ids.tolist(), 77)
    got = {}
    for r in token_counts.token_counts(spark, str(tmp_path), 77, width, block).orderBy("file", "ordinal").collect():
        own = got.setdefault(r.file[-5], [])
        assert r.ordinal == len(own)
        own.append((r.n_tokens, r.ended))
    assert got == {k: v for k, v in want.items() if v}


def test_written_files_hold_every_document(spark, make, tmp_path):
    from tokenizers import Tokenizer

    from panelfactor.llm import bpe

    texts = ["abc def", "", None, "é" * 50, "x " * 30_000, "<|endoftext|> is text here", "y", "abc def"]
    docs = make(list(enumerate(texts)), True)
    token_counts.write_token_files(docs, str(tmp_path / "files"))
    lib = Tokenizer.from_file(bpe.default_path())
    with pytest.raises(ValueError, match="bytes"):
        token_counts.write_token_files(docs, str(tmp_path / "narrow"), width=1)
    token_counts.write_token_files(docs, str(tmp_path / "wide"), width=4)
    assert token_counts.token_counts(spark, str(tmp_path / "wide"), width=4).count() == len(texts)
    got = token_counts.token_counts(spark, str(tmp_path / "files"), block_bytes=256).collect()
    assert all(r.ended for r in got)
    assert sorted(r.n_tokens for r in got) == sorted(len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts)
    token_counts.write_token_files(docs.where("false"), str(tmp_path / "none"))
    assert token_counts.token_counts(spark, str(tmp_path / "none")).count() == 0


def test_the_query_counts_all_documents(spark):
    """Against the library over the whole table."""
    from tokenizers import Tokenizer

    from panelfactor.llm import bpe

    lib = Tokenizer.from_file(bpe.default_path())
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted(len(x.ids) for x in lib.encode_batch(texts, add_special_tokens=False))
    assert sorted(r.n_tokens for r in token_counts.op3_token_counts(spark, SF).collect()) == want


@pytest.mark.parametrize("block", [4, 64])
def test_files_of_a_store_that_only_spark_reaches(spark, tmp_path, monkeypatch, block):
    """The same rows when Spark hands the files over; and the stores' other names are known to both ways."""
    tokens = np.random.default_rng(4).integers(0, 4, 150).astype("<u2")
    tokens[tokens == 3] = 65535
    (tmp_path / "a").write_bytes(tokens.tobytes() + b"x")
    (tmp_path / "b").write_bytes(tokens[:40].tobytes())
    read = lambda: sorted(map(tuple, token_counts.token_counts(spark, f"file://{tmp_path}", block_bytes=block).collect()))
    ours = read()
    assert token_counts.reaches(f"file://{tmp_path}/a") and not token_counts.reaches("dbfs:/x/a") and not token_counts.reaches(f"file://{tmp_path}/none")
    monkeypatch.setattr(token_counts, "reaches", lambda uri: False)
    assert read() == ours and len(ours) == int((tokens == 65535).sum() + (tokens[:40] == 65535).sum()) + (tokens[-1] != 65535) + (tokens[39] != 65535)
