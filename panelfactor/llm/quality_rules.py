"""Quality rules: rules of one document, and how often its lines occur across a host.

Method: lines are normalised (stripped, A-Z lower-cased, digits made 0) and hashed; for each host
(``source``) the distinct documents that hold a line are counted, exact copies of a text counting
once; lines held by more documents than the host's limit are removed; a document that loses most
of its words this way, or fails a base rule, is rejected. Lines and texts are equal when both halves
of a 128-bit hash are. The lines over a host's limit meet the documents that hold them by hash; lines
that very many rows hold are sent to the rows, not the rows to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .skew import split_join
from .textkernel import blocks, mix, row_sets, shingles

SYMBOLS = "#*$%&|<>"
#: A host's line is boilerplate above this share of the host's distinct documents, and this many: the
#: count decides up to 20,000 documents, the share keeps chance repeats of short lines in larger hosts.
HOST_SHARE, MIN_DOCUMENTS = 0.001, 20
#: A document is depleted when boilerplate lines hold more than this share of its words.
MAX_REMOVED_SHARE = 0.7

_FEATURES = "doc_id long, source string, row_id long, row_key long, text_hash long, text_twin long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, twins array<long>, line_words array<int>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_DIGIT = np.arange(256, dtype=np.uint8)
_DIGIT[48:58] = 48


def _sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64)


def _worded_lines(b, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end, row, first and past-last word, and place in the row, of every line that has a word."""
    at, to, owner = b.lines()
    place = np.arange(len(at)) - np.searchsorted(owner, owner)
    first, last = np.searchsorted(starts, at), np.searchsorted(starts, to)
    worded = last > first
    return at[worded], to[worded], owner[worded], first[worded], last[worded], place[worded]


def _line_hashes(b, at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes (as two arrays) of stripped lines, lower-cased and with digits made 0."""
    return b.lowered().mapped(_DIGIT).hashes(at, to, wide=True)


def _block_features(b) -> dict[str, list]:
    n = b.rows
    starts, ends = b.words()
    row = b.row_of(starts)
    out = {"n_words": np.bincount(row, minlength=n), "word_chars": _sums(b.span_points(starts, ends), row, n), "n_symbols": b.per_row(_IS_SYMBOL)}
    out["text_hash"], out["text_twin"] = (x.view(np.int64) for x in b.row_hashes())
    hashed = b.hashes(starts, ends)

    full = np.bincount(row, minlength=n) >= 8
    keep = full[row]
    grams, owner = shingles(hashed[keep], row[keep], n, 8)
    covered = np.zeros(len(row) + 1, np.int64)
    if len(grams):
        key = mix(grams ^ mix(owner.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        position = np.arange(len(row))[keep]
        whole = row[keep][: len(position) - 7] == row[keep][7:]
        begin = position[: len(position) - 7][whole][twice]
        np.add.at(covered, begin, 1)
        np.add.at(covered, begin + 8, -1)
    out["n_repeat_words"] = _sums(np.cumsum(covered)[:-1] > 0, row, n)

    at, to, owner, first, last, _ = _worded_lines(b, starts)
    raw = b.hashes(at, to)
    order = np.lexsort((raw, owner))
    again = np.zeros(len(raw), np.int64)
    again[order[1:]] = (raw[order][1:] == raw[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out["n_dup_lines"] = _sums(again, owner, n)
    line, twin = _line_hashes(b, starts[first], ends[last - 1]) if len(first) else (raw, raw)
    order = np.lexsort((twin, line, owner))
    line, twin, owner, held = line[order], twin[order], owner[order], (last - first)[order]
    new = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (twin[1:] != twin[:-1]) | (owner[1:] != owner[:-1])]) if len(line) else order
    words = np.add.reduceat(held, new) if len(line) else held
    cuts = pa.array(np.searchsorted(owner[new], np.arange(n + 1)).astype(np.int32))
    for name, values in (("lines", line[new].view(np.int64)), ("twins", twin[new].view(np.int64)), ("line_words", words.astype(np.int32))):
        out[name] = pa.ListArray.from_arrays(cuts, pa.array(values))
    return out


def _features(batches):
    for batch in batches:
        for b in blocks(batch.column("text")):
            got = _block_features(b)
            part = batch.slice(b.lo, b.rows)
            columns = {"doc_id": part.column("doc_id"), "source": part.column("source"), "row_id": part.column("row_id"), "row_key": part.column("row_key")} | got
            order = [x.split()[0] for x in _FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([x if isinstance(x := columns[k], pa.Array) else pa.array(x.astype(np.int64)) for k in order], names=order)


def _cut(batches):
    """Texts without the lines whose hashes _qr_cut holds."""
    for batch in batches:
        names = [x for x in batch.schema.names if x != "_qr_cut"]
        texts, cuts = batch.column("text"), batch.column("_qr_cut")
        # only rows that lose a line are hashed and become Python strings
        some = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
        if len(some):
            short = []
            touched, cuts = texts.take(pa.array(some)), cuts.take(pa.array(some))
            for b in blocks(touched):
                starts, ends = b.words()
                _, _, owner, first, last, place = _worded_lines(b, starts)
                line, twin = (x.view(np.int64) for x in _line_hashes(b, starts[first], ends[last - 1])) if len(first) else (np.empty(0, np.int64),) * 2
                begin = np.searchsorted(owner, np.arange(b.rows + 1))
                for k in range(b.rows):
                    own = slice(begin[k], begin[k + 1])
                    pairs = {(x["line"], x["twin"]) for x in cuts[b.lo + k].as_py()}
                    gone = {i for i, pair in zip(place[own].tolist(), zip(line[own].tolist(), twin[own].tolist(), strict=True), strict=True) if pair in pairs}
                    short.append("\n".join(x for i, x in enumerate(touched[b.lo + k].as_py().split("\n")) if i not in gone))
            mask = np.zeros(batch.num_rows, bool)
            mask[some] = True
            texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(short, texts.type))
        yield pa.RecordBatch.from_arrays([texts if x == "text" else batch.column(x) for x in names], names=names)


def _row_key():
    """Tells rows of one id apart by source and text."""
    source, text = F.col("source").cast("string"), F.col("text").cast("string")
    return F.xxhash64(source.isNull(), source, text.isNull(), text)  # the hash passes nulls over


def verdicts(docs: DataFrame, host_share: float = HOST_SHARE, min_documents: int = MIN_DOCUMENTS, max_removed_share: float = MAX_REMOVED_SHARE) -> DataFrame:
    """:func:`quality_rules` with row_key, which with doc_id names the rows that a verdict holds for, and cut: hashes of the row's lines over the limit, else null."""
    spare = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("row_id"), _row_key().alias("row_key"))
    table = store.written(spare.mapInArrow(_features, _FEATURES), "quality-features")

    once = table.groupBy("source", "text_hash", "text_twin").agg(F.first("lines").alias("lines"), F.first("twins").alias("twins"), F.count("*").alias("copies"))
    hosts = once.groupBy("source").agg(F.count("*").alias("documents"))
    per_text = once.select("source", "copies", F.explode(F.arrays_zip("lines", "twins")).alias("x"))
    held = per_text.groupBy("source", F.col("x.lines").alias("line"), F.col("x.twins").alias("twin")).agg(F.count("*").alias("holders"), F.sum("copies").alias("rows")).where(F.col("holders") > min_documents)
    h, s = held.alias("h"), hosts.alias("s")
    over = h.join(s, F.col("h.source").eqNullSafe(F.col("s.source"))).where(F.col("holders") > host_share * F.col("documents"))
    frequent = store.written(over.select(F.col("h.source").alias("f_source"), F.col("line").alias("f_line"), F.col("twin").alias("f_twin"), "rows"), "frequent-lines")

    n_lines = table.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    spread = table.select("row_id", "source", F.explode(F.arrays_zip("lines", "twins", "line_words")).alias("x")).select("row_id", "source", F.col("x.lines").alias("line"), F.col("x.twins").alias("twin"), F.col("x.line_words").alias("words"))
    met = split_join(spread, frequent, {"line": "f_line", "twin": "f_twin", "source": "f_source"}, "rows", n_lines)
    removed = met.groupBy("row_id").agg(F.sum("words").alias("removed_words"), F.collect_list(F.struct("line", "twin")).alias("cut"))

    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    gone = F.coalesce("removed_words", F.lit(0)).cast("long")
    return (
        table.drop("lines", "twins", "line_words", "source", "text_hash", "text_twin")
        .join(removed, "row_id", "left")
        .select("doc_id", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", gone.alias("removed_words"), base_failed.alias("base_failed"), (~base_failed & (gone <= max_removed_share * F.col("n_words"))).alias("kept"), "cut")
    )


def quality_rules(docs: DataFrame, host_share: float = HOST_SHARE, min_documents: int = MIN_DOCUMENTS, max_removed_share: float = MAX_REMOVED_SHARE) -> DataFrame:
    """Base figures and verdict of every row of ``docs`` (doc_id, text, source).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words (words
    in lines over the host's limit), base_failed, kept; one row for each input row.

    Null or empty text: no words, base_failed. Null doc_id or source: kept as null (null sources are
    one host). Repeated rows: each gets its own row; copies of a text count as one document of
    their host. Texts may have any length: a task holds one whole, and a few numbers for each of its words.
    A line at the limit stays, one above it goes. Other columns are ignored. An empty table gives an empty result.
    """
    return verdicts(docs, host_share, min_documents, max_removed_share).drop("row_key", "cut")


def kept_documents(docs: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with all their columns; ``text`` is without the lines over the host's limit.

    Repeated rows stay as often as they are there; null ids and sources, empty texts and empty tables as in :func:`quality_rules`.
    """
    # copies of a row have one key and lose the same lines
    good = verdicts(docs, **limits).where("kept").groupBy(F.col("doc_id").alias("_qr_id"), F.col("row_key").alias("_qr_key")).agg(F.first("cut").alias("_qr_cut"))
    keyed = docs.withColumn("text", F.col("text").cast("string")).withColumn("_qr_row", _row_key())
    kept = keyed.join(good, (F.col("_qr_row") == F.col("_qr_key")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_qr_id"))).select(*(F.col(f"`{c}`") for c in docs.columns), "_qr_cut")
    fields = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)
    return kept.mapInArrow(_cut, fields)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Query: verdicts on the whole ``documents`` table."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT row_id, i, list_slice(ws, i, i + 7) AS g FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
dup AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT row_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(0, 8)) AS k) GROUP BY row_id),
ln AS (SELECT row_id, source, t, unnest(string_split(t, chr(10))) AS l FROM d),
lw AS (SELECT *, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS nw, regexp_replace(translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS key FROM ln),
lk AS (SELECT * FROM lw WHERE nw > 0),
dl AS (SELECT row_id, sum(c - 1) AS n FROM (SELECT row_id, l, count(*) AS c FROM lk GROUP BY row_id, l) GROUP BY row_id),
hosts AS (SELECT source, count(DISTINCT t) AS documents FROM d GROUP BY source),
held AS (SELECT source, key, count(DISTINCT t) AS holders FROM lk GROUP BY source, key),
freq AS (SELECT h.source, h.key FROM held h JOIN hosts s ON h.source IS NOT DISTINCT FROM s.source WHERE holders > {MIN_DOCUMENTS} AND holders > {HOST_SHARE}::DOUBLE * documents),
rem AS (SELECT row_id, sum(nw) AS n FROM lk JOIN freq f ON lk.key = f.key AND lk.source IS NOT DISTINCT FROM f.source GROUP BY row_id),
x AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(rem.n, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN rep USING (row_id) LEFT JOIN dl USING (row_id) LEFT JOIN rem USING (row_id)),
y AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed, (NOT base_failed AND removed_words <= {MAX_REMOVED_SHARE}::DOUBLE * n_words) AS kept FROM y
"""
