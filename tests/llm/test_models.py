import zlib

import numpy as np
from pyspark.sql import functions as F

from panelfactor.llm import boosted_trees, html_extract, html_pages, quality_classifier, toxicity

SF = "/root/testdata/sf0.1"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held_out_rates(scored, labels, label):
    rows = scored.join(labels, "doc_id").where("held_out").groupBy(label).agg(F.avg("predicted").alias("p"), F.count("*").alias("n"))
    return {r[label]: (r.p, r.n) for r in rows.collect()}


def test_quality_on_held_out_rows(spark):
    docs, labels = tables(spark)
    scored = quality_classifier.classify(docs, labels).persist()
    rates = held_out_rates(scored, labels, "quality")
    assert rates[1][0] > 0.98 and rates[0][0] < 0.03 and rates[0][1] > 50
    assert scored.count() == docs.count() and scored.where("score < 0 or score > 1 or score is null").count() == 0
    for r in scored.select("doc_id", "held_out").limit(200).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = tables(spark)
    rates = held_out_rates(toxicity.classify(docs, labels), labels, "toxic")
    assert rates[1][0] > 0.85 and rates[0][0] < 0.02 and rates[1][1] > 50


def test_held_out_labels_are_not_learnt(spark):
    """Turning the held-out labels round changes no score."""
    docs, labels = tables(spark)
    docs = docs.where("doc_id < 3000")
    for module, label, mod, rem in ((quality_classifier, "quality", 3, 1), (toxicity, "toxic", 5, 0)):
        turned = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string")) % mod == rem, 1 - F.col(label)).otherwise(F.col(label)))
        a, b = (dict(module.classify(docs, x).select("doc_id", "score").collect()) for x in (labels, turned))
        assert max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_odd_rows_and_missing_labels(spark, make):
    docs = make([(1, None), (2, ""), (3, "one two"), (None, "x"), (3, "one two"), (4, "w " * 100_000)], True)
    labels = spark.createDataFrame([(3, 1, 1), (9, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality_classifier, toxicity):
        for given in (labels, labels.where("false")):
            rows = module.classify(docs, given).collect()
            assert len(rows) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
            assert not any(r.held_out for r in rows if r.doc_id is None)
        assert module.classify(docs.where("false"), labels).count() == 0


def groups(x):
    return toxicity.Groups(*np.nonzero(x), np.ones(len(x)))


def test_non_negative_risk_holds_back():
    """With positives hidden among the unlabelled, they are still called positive, and the rest is not."""
    rng = np.random.default_rng(0)
    pos = (rng.random((60, 8)) < [0.9] * 3 + [0.1] * 5).astype(float)
    neg = (rng.random((1000, 8)) < [0.02] * 3 + [0.1] * 5).astype(float)
    hidden = (rng.random((100, 8)) < [0.9] * 3 + [0.1] * 5).astype(float)
    w, b = toxicity.train(groups(pos), groups(np.r_[neg, hidden]).negative, 1100, 8, 100 / 1100)
    assert ((hidden @ w + b) > 0).mean() > 0.8 and ((neg @ w + b) > 0).mean() < 0.05


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    x, theta, bias = (rng.random((50, 6)) < 0.3).astype(float), rng.normal(size=6), 0.3
    g = groups(x)
    loss = lambda t, c: np.logaddexp(0, x @ t + c).sum()
    got = g.negative(theta, bias)
    assert np.isclose(got[0], loss(theta, bias))
    for k in range(6):
        step = np.eye(6)[k] * 1e-6
        assert np.isclose(got[1 + k], (loss(theta + step, bias) - loss(theta - step, bias)) / 2e-6, atol=1e-4)
    assert np.isclose(got[7], (loss(theta, bias + 1e-6) - loss(theta, bias - 1e-6)) / 2e-6, atol=1e-4)


def letters_of(text):
    """Words of a text as the toxicity features see them, plainly."""
    out, word = [], b""
    for c in (text or "").encode() + b" ":
        if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128:
            word += bytes([c + 32 if 65 <= c <= 90 else c])
        elif word:
            out.append(word)
            word = b""
    return out


def test_toxicity_fit_equals_a_plain_one(spark):
    """Counts over all rows, choice of features and training, against sets of words; sums by Spark give the same model."""
    import pyarrow as pa

    from panelfactor.llm import textkernel

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    sets = {d: {w for w in letters_of(t)} | {(w[:6], len(w)) for w in letters_of(t) if len(w) >= 6} for d, t in rows}
    toxic = [r.doc_id for r in labels.collect() if r.toxic == 1 and r.doc_id in sets]
    held = {}
    for s in sets.values():
        for f in s:
            held[f] = held.get(f, 0) + 1
    of_toxic = {}
    for d in toxic:
        for f in sets[d]:
            of_toxic[f] = of_toxic.get(f, 0) + 1
    n, m = len(toxic), len(rows)

    def ratio(a, b):
        out = 0.0
        for k, of, rate in ((a, n, (a + b) / (n + m)), (n - a, n, 1 - (a + b) / (n + m)), (b, m, (a + b) / (n + m)), (m - b, m, 1 - (a + b) / (n + m))):
            out += 2 * k * np.log(k / (of * rate)) if k else 0.0
        return out

    want = {f for f, a in of_toxic.items() if a >= toxicity.MIN_HOLDERS and a / n > 2 * held[f] / m and ratio(a, held[f]) >= toxicity.MIN_EVIDENCE}
    model = toxicity.fit(docs, labels, rounds=30)
    assert len(model.hashes) == len(want) > 0
    spread = toxicity.fit(docs, labels, rounds=30, local_groups=0)
    assert (spread.hashes == model.hashes).all() and np.allclose(spread.weights, model.weights, atol=1e-6) and np.isclose(spread.bias, model.bias)
    # the same training on a dense matrix of plain sets
    order = sorted(want, key=str)
    x = np.array([[f in s for f in order] for s in sets.values()], float)
    p = np.array([[f in sets[d] for f in order] for d in toxic], float)
    learnt = [r for r in labels.collect() if r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5]
    w, bias = toxicity.train(groups(p), groups(x).negative, m, len(order), len([r for r in learnt if r.toxic == 1]) / len(learnt), 30)
    plain = 1 / (1 + np.exp(-(x @ w + bias)))
    for (_, text), score in zip(rows[:300], plain[:300], strict=True):
        got = model.scores(next(iter(textkernel.blocks(pa.array([text or ""])))))
        assert np.isclose(got[0], score, atol=1e-6)


def test_statistics_equal_plain_ones():
    """The 18 statistics of texts, each written out for one text."""
    import re

    import pyarrow as pa

    from panelfactor.llm import textkernel

    texts = ["", "One two, two three!\nOne two, two three!\n\nshort | line #3 (x) é日本", "a " * 50, "UPPER lower MiXed 123 456 averyveryverylongword $5.00\n\tend", "same\nsame\nsame", "日本 日本 x-y"]
    got = np.concatenate([quality_classifier.statistics(b) for b in textkernel.blocks(pa.array(texts))])
    for text, row in zip(texts, got, strict=True):
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        raw = text.encode()
        n, lengths = len(ws), [len(w) for w in ws]
        solid, many = max(sum(lengths), 1), max(n, 1)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        share = lambda x, of, scale: np.arcsinh(scale * x / (of + 30))
        of = lambda chars: sum(c in chars.encode() for c in raw)
        plain_bytes = set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.,") | set(range(128, 256))
        marked = sum(any(c not in plain_bytes for c in w.encode()) for w in ws)
        want = [
            np.log1p(n), np.log((solid + 50) / (many + 10)), share(of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), solid, 20), share(of("0123456789"), solid, 50), share(of("#*$%&<>~^=_@"), solid, 50),
            share(of("|"), solid, 50), share(of("!?"), solid, 50), share(of(".,"), solid, 20), share(of("\"'()[]{}:;/\\+-`"), solid, 50), share(sum(c >= 0xC0 for c in raw), solid, 10),
            np.log1p((n + 20) / (len(lines) + 1)), share(len(lines) - len(set(lines)), max(len(lines), 1), 10), np.log((len(set(ws)) + 5) / (n + 5)) / np.log(n + 5), share(max((ws.count(w) for w in ws), default=0), many, 5), share(sum(a == b for a, b in zip(ws, ws[1:])), many, 20),
            share(sum(x > 12 for x in lengths), many, 5), share(sum(x <= 3 for x in lengths), many, 5), share(marked, many, 10),
        ]
        assert np.allclose(row, want), (text, row - np.array(want))


def test_discriminant_equals_direct_densities():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 1, (80, 3)), rng.normal(1, 2, (90, 3))]
    y = np.r_[np.zeros(80), np.ones(90)]
    s = quality_classifier.Discriminant(x, y, 0.0, 0.0).scores(x)
    z = (x - x.mean(axis=0)) / x.std(axis=0)

    def log_density(c):
        p = z[y == c]
        cov = np.cov(p.T) + 1e-3 * np.eye(3)
        d = z - p.mean(axis=0)
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log((y == c).mean())

    assert np.allclose(s, 1 / (1 + np.exp(log_density(0) - log_density(1))))


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = boosted_trees.fit(x, y, np.ones(2000))
    fresh = rng.random((500, 4)).astype(np.float32)
    assert ((model.logits(fresh) > 0) == ((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.3))).mean() > 0.95


def test_made_up_pages_unseen_in_training():
    maker, right, n = html_pages.Pages(12_345), 0, 150
    strip = lambda s: s.replace(html_pages.OPEN, "").replace(html_pages.CLOSE, "")
    for _ in range(n):
        page = maker.page()
        nodes = html_extract.Nodes()
        nodes.add_page(page)
        want = " ".join(strip(t) for t in nodes.texts if t and html_pages.OPEN in t)
        right += html_extract.main_texts([strip(page)], html_extract.page_model()) == [want]
    assert right / n > 0.95


def test_kept_nodes_have_kept_parents():
    maker, nodes = html_pages.Pages(3), html_extract.Nodes()
    for _ in range(30):
        nodes.add_page(maker.page())
    nodes.features()
    logits = np.random.default_rng(0).normal(0, 3, len(nodes.tag))
    kept = nodes.kept(logits)
    parent = np.array(nodes.parent)
    assert kept[parent < 0].all() and all(kept[parent[k]] for k in np.flatnonzero(kept & (parent >= 0)))


def test_decoding_is_the_best_choice():
    """Against all allowed choices of a small tree."""
    from itertools import product

    nodes = html_extract.Nodes()
    nodes.add_page("<div><p>a</p><p>b</p></div><div>c</div>")
    nodes.features()
    rng = np.random.default_rng(5)
    parent = np.array(nodes.parent)
    for _ in range(20):
        logits = rng.normal(0, 2, len(parent))
        logp, logq = -np.logaddexp(0, -logits), -np.logaddexp(0, logits)
        options = [np.array(o) for o in product([False, True], repeat=len(parent)) if o[0] and all(not o[k] or o[parent[k]] for k in range(1, len(parent)))]
        best = max(options, key=lambda o: np.where(o, logp, logq)[1:].sum())
        assert (nodes.kept(logits) == best).all()


def plain_discriminant(x, y, held, to_pooled=0.3, to_diagonal=0.1):
    """Scores of the regularised discriminant, one density at a time: no cached factors, no stacked algebra."""
    fit, labels = x[~held & (y >= 0)], y[~held & (y >= 0)]
    centre, scale = fit.mean(axis=0), np.maximum(fit.std(axis=0), 1e-6)
    z = (fit - centre) / scale
    own = {c: z[labels == c] for c in (0, 1)}
    pooled = sum(np.cov(p.T) * (len(p) - 1) for p in own.values()) / (len(z) - 2)
    out = []
    for row in (x - centre) / scale:
        log = {}
        for c, p in own.items():
            cov = (1 - to_pooled) * np.cov(p.T) + to_pooled * pooled
            cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + 1e-3 * np.eye(len(cov))
            d = row - p.mean(axis=0)
            log[c] = -0.5 * d @ np.linalg.solve(cov, d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(p) / len(z))
        out.append(1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700))))
    return np.array(out)


def test_shrunk_model_and_whole_query_equal_a_plain_version(spark):
    """op4's result on a whole table: statistics, fold, labels, shrunk covariances and densities, each made again plainly."""
    import pyarrow as pa

    from panelfactor.llm.textkernel import blocks

    small = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").toPandas().sort_values("doc_id")
    labels = spark.read.parquet(f"{small}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    x = np.concatenate([quality_classifier.statistics(b) for b in blocks(pa.array(docs.text.fillna("").tolist(), pa.large_string()))])
    y = np.array([int(labels[d]) if d in labels.index and labels[d] in (0, 1) else -1 for d in docs.doc_id])
    held = np.array([zlib.crc32(str(d).encode()) % 3 == 1 for d in docs.doc_id])
    want = plain_discriminant(x, y, held)
    got = quality_classifier.op4_quality_classifier(spark, small).toPandas().sort_values("doc_id")
    assert (got.held_out.to_numpy() == held).all() and np.allclose(got.score, want, atol=1e-8)
    clear = np.abs(want - 0.5) > 1e-8
    assert (got.predicted.to_numpy()[clear] == (want >= 0.5)[clear]).all()


def test_shrinkage_equals_a_plain_version_where_classes_overlap():
    rng = np.random.default_rng(8)
    x = np.r_[rng.normal(0, 1, (25, 6)), rng.normal(0.4, 1.5, (30, 6)) @ rng.normal(size=(6, 6))]
    y, none = np.r_[np.zeros(25, int), np.ones(30, int)], np.zeros(55, bool)
    got = quality_classifier.Discriminant(x, y).scores(x)
    assert np.allclose(got, plain_discriminant(x, y, none), atol=1e-10) and ((got > 0.01) & (got < 0.99)).sum() > 20
    for other in ((0.0, 0.1), (0.3, 0.0)):  # both shrinkages count
        assert np.abs(quality_classifier.Discriminant(x, y, *other).scores(x) - got).max() > 1e-3
