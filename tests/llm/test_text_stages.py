import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from panelfactor.llm import bpe, line_dedup, quality_rules, source_mix

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def base_figures(text):
    text = text or ""
    ws = re.findall(rf"[^{SPACE}]+", text)
    seen = {}
    for i in range(len(ws) - 7):
        seen.setdefault(tuple(ws[i : i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    n = len(ws)
    return n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def random_texts(n=60):
    r = random.Random(5)
    out = []
    for _ in range(n):
        words = [r.choice(["a", "be", "é#", "日本", "x|y", "WORD", "z9"]) for _ in range(r.choice([0, 3, 25, 60, 200]))]
        out.append("".join(w + r.choice([" ", " ", "\n", "\t", "  ", " "]) for w in words))
    return out


def test_base_rules_equal_brute_force(make):
    rows = list(enumerate([*random_texts(), None, "", " \n ", "long " * 40_000, "same\nsame\nsame"]))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(make(rows, True)).collect()}
    assert got == {i: base_figures(t) for i, t in rows}
    assert quality_rules.quality_rules(make(rows).where("false")).count() == 0


def test_host_lines_remove_documents(make):
    letters = lambda k: chr(97 + k // 26) + chr(97 + k % 26)  # noqa: E731  digits don't tell lines apart
    own = lambda k: " ".join(f"{letters(k)}x{letters(j)}" for j in range(30))
    menu = "\n".join(f"menu entry number {j} of this host" for j in range(20))
    rows = [(k, f"{own(k)}\n{menu}" if k < 25 else own(k), "host") for k in range(40)] + [(100 + k, own(k) + "\n" + menu, None) for k in range(3)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(make(rows)).collect()}
    assert all(got[k].removed_words == 140 and not got[k].kept for k in range(25))
    assert all(got[k].kept and not got[k].removed_words for k in range(25, 40)) and all(got[100 + k].kept for k in range(3))
    kept = quality_rules.kept_documents(make(rows))
    assert kept.columns == make(rows).columns and sorted(r.doc_id for r in kept.collect()) == [*range(25, 40), 100, 101, 102]


def test_kept_documents_lose_their_hosts_frequent_lines(make, spark):
    """Stage 1 passes on texts without the frequent lines, however these are written, and leaves every other line as it was."""
    letters = lambda k: chr(97 + k // 26) + chr(97 + k % 26)
    own = lambda k: " ".join(f"{letters(k)}x{letters(j)}" for j in range(30))
    text = lambda k: f"\n  {own(k)} \r\nPage {k + 10} of 99\n\nrare {letters(k)}\n \tPAGE {k + 20} OF 10 \n"
    lean = lambda k: f"\n  {own(k)} \r\n\nrare {letters(k)}\n"
    rows = [(k, text(k), "host") for k in range(30)] + [(50, f"é {own(50)}", "host"), (7, text(7), "host"), (None, text(31), "host"), (60, text(60), "other"), (61, text(61), None)]
    want = [(k, lean(k)) for k in range(30)] + [(50, f"é {own(50)}"), (7, lean(7)), (None, lean(31)), (60, text(60)), (61, text(61))]
    docs = make(rows, True)
    kept = quality_rules.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or -1, r.text) for r in kept.collect())) == sorted((i or -1, t) for i, t in want)
    staged = corpus_pipeline.apply_quality_rules(spark, docs, "")
    assert all(r.n_chars == len(r.text) for r in staged.collect()) and staged.schema["n_chars"].dataType == docs.schema["n_chars"].dataType


def test_a_line_in_few_per_cent_of_a_large_host_is_removed(make):
    """2 % of 3,000 texts hold a line, 20 texts another: only the first is boilerplate, at any size of host."""
    letters = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(3))
    own = lambda k: " ".join(f"{letters(k)}x{letters(j)}" for j in range(25))
    text = lambda k: own(k) + "\nall rights reserved" * (k < 60) + "\nsee also" * (k < 20)
    docs = make([(k, text(k), "large") for k in range(3000)])
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert all(got[k].removed_words == 3 * (k < 60) and got[k].kept for k in range(3000))
    kept = {r.doc_id: r.text for r in quality_rules.kept_documents(docs).collect()}
    assert kept == {k: own(k) + "\nsee also" * (k < 20) for k in range(3000)}


def brute_lines(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(SPACE))
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(i)
    low = lambda i: -(1 << 63) if i is None else i
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(key(x), ())) >= 3 and low(i) != max(map(low, h)))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("per_part", [7, 200_000])
def test_line_dedup_equals_brute_force(make, monkeypatch, per_part):
    monkeypatch.setattr(line_dedup, "LINES_PER_PARTITION", per_part)
    r = random.Random(9)
    pool = ["A shared line of some length", "a SHARED line of some length", "another shared line, quite long", "é" * 20, "é" * 19, "short", "", "only two documents hold this", " \tA shared line of some length \r"]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randint(0, 6)))) for k in range(40)] + [(900, None), (901, ""), (902, "A shared line of some length\n" * 500), (None, pool[0])]
    rows += [(None, f"{pool[2]}\nrow {k % 30}") for k in range(60)]  # one document, of many rows, that boundaries must be able to cut
    rows += [(None, f"a line that null ids alone hold {k}\nthe same line of rows without an id") for k in range(20)]
    docs = make(rows, True)
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    key = lambda x: (x[0] is None, x)
    assert sorted(((x.doc_id, x.n_lines, x.n_dropped, x.text) for x in got.collect()), key=key) == sorted(brute_lines(rows), key=key)
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def test_bitmaps_round_trip():
    at = [0, 5, 64, 1000]
    assert np.flatnonzero(line_dedup.unpack(line_dedup.pack(at), 1200)).tolist() == at


def fill(sizes, cap=3):
    """Water filling, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, left = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in target]
        over = [s for s in free if weight[s] * left / sum(weight[x] for x in free) > cap * sizes[s]]
        if not over:
            return target | {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        for s in over:
            target[s] = cap * sizes[s]
        left = sum(sizes.values()) - sum(target.values())


def test_mix_meets_its_targets(make):
    r = random.Random(2)
    rows = [(k, "w " * r.randint(0, 300), s) for k, s in enumerate(["big"] * 300 + ["mid"] * 100 + ["tiny"] * 5 + [None] * 60 + ["zero"] * 3)]
    rows = [(k, "" if s == "zero" else t, s) for k, t, s in rows] + [(900, None, "mid")]
    got = source_mix.mix(make(rows, True)).collect()
    again = source_mix.mix(make(rows).repartition(7)).collect()
    assert sorted((x.doc_id, x.copies) for x in got) == sorted((x.doc_id, x.copies) for x in again)
    sizes, taken, longest = {}, {}, {}
    for x in got:
        sizes[x.source] = sizes.get(x.source, 0) + x.size
        taken[x.source] = taken.get(x.source, 0) + x.size * x.copies
        longest[x.source] = max(longest.get(x.source, 0), x.size)
    want = fill(sizes)
    for x in got:
        assert x.target == pytest.approx(want[x.source]) and x.source_size == sizes[x.source] and 0 <= x.copies <= 3
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    mixed = source_mix.mixed_documents(make(rows))
    assert mixed.columns == make(rows).columns
    counts = {}
    for x in mixed.collect():
        counts[x.doc_id] = counts.get(x.doc_id, 0) + 1
    assert counts == {x.doc_id: x.copies for x in got if x.copies}
    assert source_mix.mix(make(rows).where("false")).count() == 0


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_tokens_equal_the_library(make):
    odd = ["", None, "a'S  İstanbul ΑΣ ΟΔΟΣ.", "日本語 1234", "<|endoftext|> x<|startoftext|>", "é é Å ǅ \x1c ​ 　c", "don’t ½²٣ ﬁ", "x" * 5000, "word " * 3000, "🙂🙂 \x00", "aaaa aaaaa aaaaaaa"]
    rows = list(enumerate([*odd, *random_texts(30)]))
    lib = library()
    got = {r.doc_id: r for r in bpe.round_trip(make(rows, True)).collect()}
    for i, t in rows:
        e = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == e and got[i].n_tokens == len(e)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(e, skip_special_tokens=False).encode()).hexdigest()
    pairs = {r.doc_id: r.decoded for r in bpe.decode_ids(bpe.encode_texts(make(rows, True))).collect()}
    assert all(pairs[i] == lib.decode(got[i].ids, skip_special_tokens=False) for i, _ in rows)
    assert bpe.round_trip(make(rows).where("false")).count() == 0


def test_word_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 5)
    e = bpe.Encoder(bpe.Vocabulary(bpe.default_path()))
    lib = library()
    for text in ("one two three four", "five six seven one", "one", "a b c d e f g h"):
        assert e.encode([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids


def test_long_words_equal_the_library():
    """Words beyond LONG_PIECE, of random, repeated and mixed letters; a million letters take seconds."""
    import time

    rng = np.random.default_rng(8)
    e, lib = bpe.Encoder(bpe.Vocabulary(bpe.default_path())), library()
    draw = lambda n, letters: "".join(rng.choice(list(letters), n))
    texts = ["a" * 3001, "ab" * 2000, draw(5000, "abcdefghijklmnopqrstuvwxyz"), draw(3000, "aab"), "x " + draw(4000, "éàñüa日") + " y", draw(3000, "ABCxyz0189+/="), "the" * 1500, draw(513, "ing"), "!" * 2000]
    for text in texts:
        assert e.encode([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids
    joined = e.encode(texts)
    assert joined[0].tolist() == [k for t in texts for k in lib.encode(t, add_special_tokens=False).ids] and len(joined[1]) == len(texts)
    began = time.time()
    e.encode([draw(1_000_000, "abcdefghijklmnopqrstuvwxyz")])
    assert time.time() - began < 60
