import hashlib
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from panelfactor.llm import bpe, quality_rules, source_mix, store
from tests.conftest import SF

from .test_ngram_join import brute as brute_classes
from .test_text_stages import SPACE, base_figures, brute_lines


def brute_rules(rows):
    """(id, text) of the rows that stay, with their texts after the cut: rules and line counts written out plainly."""
    key = lambda x: re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(SPACE)))
    texts, holders = {}, {}
    for _, text, source in rows:
        texts.setdefault(source, set()).add(text or "")
    for source, own in texts.items():
        for t in own:
            for k in {key(x) for x in t.split("\n") if x.strip(SPACE)}:
                holders[source, k] = holders.get((source, k), 0) + 1
    over = {k for k, n in holders.items() if n > quality_rules.MIN_DOCUMENTS and n > quality_rules.HOST_SHARE * len(texts[k[0]])}
    words = lambda x: len(re.findall(rf"[^{SPACE}]+", x))
    out = []
    for i, text, source in rows:
        lines = (text or "").split("\n")
        gone = [bool(x.strip(SPACE)) and (source, key(x)) in over for x in lines]
        removed = sum(words(x) for x, g in zip(lines, gone, strict=True) if g)
        if not base_figures(text)[-1] and removed <= quality_rules.MAX_REMOVED_SHARE * words(text or ""):
            out.append((i, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gives over a small whole table, and over rows with every kind of trouble."""
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"word{k}" for k in range(60_000))
    odd = [(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, None, "en", None, 0), (-3, long, None, None, len(long)), (None, long + " end", "en", "s", 1), (-4, long, "en", None, 1), (-4, long, "en", None, 1), (5, "tie", "en", "s", 3)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "'clash' as n_lines", "'clash' as copies", "'clash' as source_size")
    states = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, states[-1], SF).write.parquet(str(at / f"{k}-{name}"))
        states.append(spark.read.parquet(str(at / f"{k}-{name}")))
    return states


def listed(state):
    return [(r.doc_id, r.text) for r in state.collect()]


def by_id(rows):
    return sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "source_mix", "bpe"]
    kinds = [{f.name: f.dataType for f in s.schema} for s in stages]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert all(k == kinds[0] for k in kinds[:-1]), kinds


def test_rules(stages):
    assert by_id(listed(stages[1])) == by_id(brute_rules([(r.doc_id, r.text, r.source) for r in stages[0].collect()]))
    assert all(r.n_chars == len(r.text) for r in stages[1].collect())


def test_line_dedup(stages):
    assert by_id(listed(stages[2])) == by_id([(i, t) for i, _, _, t in brute_lines(listed(stages[1]))])
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_one_of_each_class(stages):
    rows = list(dict.fromkeys(listed(stages[2])))  # an id and text that repeat are one
    want = {(d, t) for (d, t), (_, _, c) in zip(rows, brute_classes(rows), strict=True) if d == c}
    got = listed(stages[3])
    assert len(got) == len(set(got)) and set(got) == want


def test_mix(stages, tmp_path):
    stages[3].write.parquet(str(tmp_path / "docs"))
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/docs/*.parquet')")
    want = Counter({r[0]: r[1] // r[2] for r in sql.execute(f"SELECT doc_id, taken, size FROM ({source_mix.OP10_SQL}) WHERE taken > 0").fetchall()})
    assert Counter(i for i, _ in listed(stages[4])) == want
    assert set(listed(stages[4])) <= set(listed(stages[3]))


def test_tokens(stages):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    texts = listed(stages[4])
    want = Counter()
    for (i, _), e in zip(texts, lib.encode_batch([t or "" for _, t in texts], add_special_tokens=False), strict=True):
        digest = hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
        want[i, len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), digest, tuple(e.ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in stages[5].collect()) == want


def test_run_gives_the_last_stage_and_leaves_nothing_else(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} <= set(rows.columns) and rows.count() > 0
    assert [x.split("-")[:2] for x in os.listdir(tmp_path)] == [["pipeline", "bpe"]]


def test_run_over_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert rows.count() == 0 and "ids_sha256" in rows.columns
