"""Line dedup: drop lines that many documents hold, except in the document with the largest id.

Method: (line hash, document, position) is partitioned by range of (hash, document) and sorted
inside each partition by hash, document descending, position; each run of a hash is streamed: its
first document keeps its lines, and once a third document holds it the others lose theirs, so that
a task holds back the lines of one document at most.
A range boundary may cut the run of a hash that very many documents hold, and even the lines of one of its documents (all
rows without an id are one): what a partition can't decide of its first and last hash is decided from the counts of
all their parts (two for each partition at most). Drops return as compressed per-document bitmaps, never as text.

Lines are equal when both halves of a 128-bit hash are.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .textkernel import blocks

MIN_POINTS, MIN_DOCUMENTS = 20, 3
#: Lines that one range partition should hold, and how few are worth one while cores are idle.
LINES_PER_PARTITION, LEAST_LINES = 4_000_000, 100_000
#: Rows of counts (two for each range partition) that may be broadcast; more are joined by a shuffle.
MAX_BROADCAST = 200_000
#: Stands for a null id: below every other.
NO_ID = -(1 << 63)

_ENTRY = "hash long, twin long, doc_id long, text_key long, position int"
_DECIDED = "hash long, twin long, doc_id long, text_key long, position int, documents long"


def long_lines(b):
    """128-bit hash (two arrays), row and place in its row of each line of MIN_POINTS code points or more."""
    at, to, row = b.lines()
    starts, ends = b.words()
    first, last = np.searchsorted(starts, at), np.searchsorted(starts, to)
    index = np.arange(len(at)) - np.searchsorted(row, np.arange(b.rows))[row]
    some = last > first
    at, to, row, index = starts[first[some]], ends[last[some] - 1], row[some], index[some]
    long = b.span_points(at, to) >= MIN_POINTS
    at, to, row, index = at[long], to[long], row[long], index[long]
    one, two = b.lowered().hashes(at, to, wide=True)
    return one.view(np.int64), two.view(np.int64), row, index


def _entries(batches):
    """Hash, document and position of each long line."""
    names = [x.split()[0] for x in _ENTRY.split(", ")]
    for batch in batches:
        ids, texts = batch.column("key").to_numpy(), batch.column("text_key").to_numpy()
        for b in blocks(batch.column("text")):
            one, two, row, index = long_lines(b)
            columns = [one, two, ids[row + b.lo], texts[row + b.lo], index.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)


class _Run:
    """The run of the hash that a stream is in: its documents so far, and lines that wait for a third one."""

    def __init__(self, key, keeper: int, at_edge: bool):
        self.key, self.keeper, self.at_edge = key, keeper, at_edge
        self.documents, self.last, self.waiting = 0, None, []


def _stream(batches):
    """Stream the runs of a sorted partition.

    Decided drops have documents = 1 and hash 0. Lines that the partition can't decide have documents null; one
    count row of each such hash (position -1) has its documents here and, in doc_id and text_key, the largest and the smallest of them.
    """
    names = [x.split()[0] for x in _DECIDED.split(", ")]

    def rows(h, w, d, t, p, documents):
        n = len(d)
        full = lambda x: x if isinstance(x, np.ndarray) else np.full(n, x, np.int64)
        count = pa.nulls(n, pa.int64()) if documents is None else pa.array(full(documents))
        return pa.RecordBatch.from_arrays([pa.array(full(h)), pa.array(full(w)), pa.array(d), pa.array(t), pa.array(p), count], names=names)

    def closing(run):
        """What is still to say of a run that the partition's end may cut, or its start has."""
        if run.waiting:
            yield rows(*run.key, *(np.concatenate(x) for x in zip(*run.waiting, strict=True)), None)
        yield rows(*run.key, np.array([run.keeper]), np.array([run.last]), np.full(1, -1, np.int32), run.documents)

    run = None
    for batch in batches:
        h, w, d, t, p = (batch.column(c).to_numpy() for c in names[:5])
        if not len(h):
            continue
        begin = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
        goes_on = run is not None and run.key == (h[0], w[0])
        if run is not None and not goes_on and run.at_edge:
            yield from closing(run)
        fresh = np.zeros(len(h), bool)
        fresh[begin] = True
        new = fresh | np.r_[True, d[1:] != d[:-1]]
        if goes_on:
            new[0] = d[0] != run.last
        group = np.cumsum(fresh) - 1
        seen = np.cumsum(new)
        ordinal = seen - (seen[begin] - new[begin])[group]  # which document of its run, from 1
        if goes_on:
            ordinal[group == 0] += run.documents
        else:
            run = _Run((h[0], w[0]), int(d[0]), run is None)
        last_of = np.r_[begin[1:], len(h)] - 1
        total = ordinal[last_of]
        loses = (ordinal > 1) & (total >= MIN_DOCUMENTS)[group]
        mine = group == 0
        if run.at_edge:  # the partition before may hold larger documents of this hash
            yield rows(h[mine], w[mine], d[mine], t[mine], p[mine], None)
            loses &= ~mine
        elif total[0] >= MIN_DOCUMENTS and run.waiting:
            waiting = [np.concatenate(x) for x in zip(*run.waiting, strict=True)]
            yield rows(0, 0, *waiting, 1)
            run.waiting = []
        yield rows(0, 0, d[loses], t[loses], p[loses], 1)
        if len(begin) > 1:
            if run.at_edge:
                run.documents, run.last = int(total[0]), int(d[last_of[0]])
                yield from closing(run)
            run = _Run((h[-1], w[-1]), int(d[begin[-1]]), False)
        run.documents, run.last = int(total[-1]), d[-1]
        if not run.at_edge and total[-1] < MIN_DOCUMENTS:
            wait = (group == len(begin) - 1) & (ordinal > 1)
            if wait.any():
                run.waiting.append((d[wait], t[wait], p[wait]))
    if run is not None:
        yield from closing(run)


def _bitmaps(batches):
    """Each document's drops as one compressed bitmap."""
    for batch in batches:
        maps = [pack(x.values.to_numpy()) for x in batch.column("drops")]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("text_key"), pa.array(maps, pa.binary())], names=["_ld_id", "_ld_of", "_ld_map"])


def pack(positions) -> bytes:
    """Compressed bitmap with the given bits set."""
    bits = np.zeros(int(np.max(positions)) + 1, np.uint8)
    bits[positions] = 1
    return zlib.compress(np.packbits(bits).tobytes())


def unpack(blob: bytes, n: int) -> np.ndarray:
    """The first ``n`` bits of a bitmap; those that it lacks are not set."""
    out = np.zeros(n, bool)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(blob), np.uint8))[:n]
    out[: len(bits)] = bits
    return out


def partitions(lines: int, cores: int) -> int:
    """Range partitions for so many lines: large ones, but not fewer than cores while each has LEAST_LINES."""
    return max(1, math.ceil(lines / LINES_PER_PARTITION), min(2 * cores, math.ceil(lines / LEAST_LINES)))


def drop_bitmaps(docs: DataFrame) -> DataFrame:
    """Per document and text that loses lines: _ld_id (doc_id), _ld_of (hash of the text), _ld_map (compressed bitmap of lines to drop)."""
    spark = docs.sparkSession
    slim = docs.select(_key().alias("key"), _text_key().alias("text_key"), F.col("text").cast("string"))
    entries = store.written(slim.mapInArrow(_entries, _ENTRY), "line-entries")
    parts = partitions(entries.count(), int(spark.conf.get("spark.default.parallelism", "0") or 0) or spark.sparkContext.defaultParallelism)
    ordered = entries.repartitionByRange(parts, "hash", "twin", F.desc("doc_id"), "text_key", "position").sortWithinPartitions("hash", "twin", F.desc("doc_id"), "text_key", "position")
    streamed = store.written(ordered.mapInArrow(_stream, _DECIDED), "line-drops")
    store.drop(entries)
    decided = streamed.where((F.col("documents") == 1) & (F.col("position") >= 0))
    # parts follow each other by falling document, and a document that a boundary cuts is the last of one part and the first of the next
    following = Window.partitionBy("hash", "twin").orderBy(F.desc("doc_id"), F.desc("text_key"))  # rows: one for each part of a hash
    counted = streamed.where("position = -1").withColumn("again", (F.col("doc_id") == F.lag("text_key").over(following)).cast("long"))
    totals = counted.groupBy("hash", "twin").agg((F.sum("documents") - F.coalesce(F.sum("again"), F.lit(0))).alias("total"), F.max("doc_id").alias("keeper")).where(F.col("total") >= MIN_DOCUMENTS)
    totals = F.broadcast(totals) if 2 * parts <= MAX_BROADCAST else totals
    opened = streamed.where("documents is null").join(totals, ["hash", "twin"]).where("doc_id <> keeper")
    columns = ["doc_id", "text_key", "position"]
    drops = decided.select(columns).unionByName(opened.select(columns))
    # no list is longer than its document has lines
    grouped = drops.groupBy(F.col("doc_id").alias("key"), "text_key").agg(F.collect_list("position").alias("drops"))
    return grouped.mapInArrow(_bitmaps, "_ld_id long, _ld_of long, _ld_map binary")


def _key():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def _text_key():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _apply(counts: bool):
    """Texts without the lines that _ld_map marks; with ``counts`` their numbers of lines before, and of dropped ones."""

    def run(batches):
        for batch in batches:
            kept, lines, dropped = [], [], []
            for text, blob in zip(batch.column("text"), batch.column("_ld_map"), strict=True):
                text, blob = text.as_py() or "", blob.as_py()
                n, gone = text.count("\n") + 1, 0
                if blob is not None:
                    out = unpack(blob, n)
                    gone = int(out.sum())
                    text = "\n".join(x for x, o in zip(text.split("\n"), out, strict=True) if not o)
                kept.append(text)
                lines.append(n)
                dropped.append(gone)
            names = [x for x in batch.schema.names if x != "_ld_map"]
            columns = [pa.array(kept, pa.string()) if x == "text" else batch.column(x) for x in names]
            if counts:
                names, columns = [*names, "n_lines", "n_dropped"], [*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def dedup_lines(docs: DataFrame, counts: bool = True) -> DataFrame:
    """``docs`` (doc_id, text, any others) with shared long lines dropped from ``text``; with ``counts``, plus n_lines (before) and n_dropped.

    Null or empty text: one empty line, kept; the text comes back empty. Rows with one doc_id are one
    document; null ids are one document that is smaller than all, whose rows are told apart by text.
    Repeated rows lose the same lines. Texts may have any length: a task holds one whole, and a few
    numbers for each of its lines. With ``counts``, columns called n_lines or n_dropped are replaced; other extra columns
    stay. Order of columns: the input's, then the two. An empty table gives an empty result.
    """
    docs = docs.drop(*["n_lines", "n_dropped"] * counts, "_ld_key", "_ld_text", "_ld_id", "_ld_of", "_ld_map")
    keyed = docs.withColumn("text", F.col("text").cast("string")).withColumn("_ld_key", _key()).withColumn("_ld_text", _text_key())
    same = (F.col("_ld_key") == F.col("_ld_id")) & (F.col("_ld_text") == F.col("_ld_of"))
    joined = keyed.join(drop_bitmaps(docs), same, "left").select(*(F.col(f"`{c}`") for c in docs.columns), "_ld_map")
    fields = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(_apply(counts), fields + ", n_lines long, n_dropped long" * counts)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: line dedup of the whole ``documents`` table, kept texts as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def dedup_sql(table: str) -> str:
    """SQL of the kept text: columns of ``table`` with row_id, and t, n_lines, n_dropped."""
    key = r"translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""ld_rows AS (SELECT row_number() OVER () AS row_id, * FROM {table}),
ld_split AS (SELECT row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM ld_rows),
ld_lines AS (SELECT row_id, doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM ld_split),
ld_keys AS (SELECT *, {key} AS k, coalesce(doc_id, {NO_ID + 1} - 1) AS d FROM ld_lines),
ld_hot AS (SELECT k, max(d) AS keeper FROM ld_keys WHERE length(k) >= {MIN_POINTS} GROUP BY k HAVING count(DISTINCT d) >= {MIN_DOCUMENTS}),
ld_text AS (SELECT row_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE h.k IS NOT NULL AND d <> keeper)::BIGINT AS n_dropped, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE h.k IS NULL OR d = keeper), '') AS t FROM ld_keys LEFT JOIN ld_hot h USING (k) GROUP BY row_id)"""


OP9_SQL = f"WITH {dedup_sql('documents')} SELECT r.doc_id, n_lines, n_dropped, sha256(t) AS kept_sha256 FROM ld_text JOIN ld_rows r USING (row_id)"
