"""Token counts of documents in flat, unindexed token files: separator scan.

A file is nothing but little-endian token ids, each document ended by an end-of-document id. Files are cut
into byte ranges regardless of documents, a task reads ranges, not files; each block is searched for
the id with one vectorised comparison; documents that cross blocks are stitched with a prefix scan over the
blocks' figures (tokens and separators so far, place of the last separator), a small row for each block.

:func:`write_token_files` makes such files from documents with the encoder of :mod:`bpe`. Spark's text writer
writes a document's ids as one record and the end-of-document id as its line separator, so files are
committed like any other output and a lost task's are written again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, store

#: Bytes of a block; bytes of an id.
BLOCK, WIDTH = 4 << 20, 2

_RANGES = "file string, block long, size long"
_SCANNED = "file string, block long, n long, separators long, last long, counts array<long>"


def end_of_document(width: int = WIDTH) -> int:
    """The end-of-document id: the largest of its width, beyond the ids of the vocabulary."""
    return (1 << (8 * width)) - 1


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, width: int = WIDTH) -> None:
    """Encode ``docs`` (text) into flat files of ``width``-byte ids below ``path``, each document ended by :func:`end_of_document`.

    Null or empty text: no ids, only the separator. Every row is written once, whatever its other columns; repeated rows are
    repeated documents; texts are encoded whole. No rows: no files with documents. A vocabulary whose ids need
    more than ``width`` bytes is an error.
    """
    words = bpe.Vocabulary(vocabulary or bpe.default_path())
    if words.width > end_of_document(width):
        raise ValueError(f"{words.width} ids and a separator need more than {width} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        encoder = bpe.Encoder(shared.value)
        for batch in batches:
            for texts in bpe.chunks(batch.column("text")):
                ids, counts = encoder.encode(texts)
                bounds = np.r_[0, np.cumsum(counts)].astype(np.int64) * width
                raw = pa.py_buffer(ids.astype(f"<u{width}").tobytes())
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds), raw]).cast(pa.binary())], names=["value"])

    flat = docs.select(F.col("text").cast("string")).mapInArrow(run, "value binary")
    # the encoding is that of the line separator alone; values are written as the bytes that they are
    end = "\xff" * width
    flat.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", end).option("compression", "none").text(path)


#: Schemes of stores under the names that pyarrow has for them.
SCHEMES = {"s3a": "s3", "s3n": "s3", "viewfs": "hdfs"}


def _opened(uri: str):
    """File system and path of a file; ArrowInvalid or an OSError where pyarrow can't reach its store."""
    scheme, found, rest = uri.partition(":")
    if found and scheme in SCHEMES:
        uri = f"{SCHEMES[scheme]}:{rest}"
    return fs.FileSystem.from_uri(uri)


def reaches(uri: str) -> bool:
    """Whether workers can read ranges of such a file themselves; else Spark reads it for them, whole."""
    try:
        system, at = _opened(uri)
        return system.get_file_info(at).type == fs.FileType.File
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False


def file_ranges(spark: SparkSession, path: str, block_bytes: int = BLOCK) -> DataFrame:
    """(file, block, size) of the byte ranges of all files below ``path``; only names and lengths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    last = F.floor((F.col("length") - 1) / block_bytes)
    ranges = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    return ranges.select("file", "block", F.least(F.lit(block_bytes), F.col("length") - F.col("block") * block_bytes).cast("long").alias("size"))


def _figures(file: str, block: int, raw, separator: int, width: int) -> pa.RecordBatch:
    """One block's row."""
    tokens = np.frombuffer(raw, np.dtype(f"<u{width}"), len(raw) // width)
    found = np.flatnonzero(tokens == separator)
    columns = [[file], [block], [len(tokens)], [len(found)], [int(found[-1]) if len(found) else None]]
    lists = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(np.diff(found, prepend=-1) - 1))
    kinds = [pa.string(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), lists], names=[x.split()[0] for x in _SCANNED.split(", ")])


def scan_blocks(ranges: DataFrame, separator: int, width: int = WIDTH, block_bytes: int = BLOCK) -> DataFrame:
    """Figures of each block: n (tokens), separators, last (place of the last one), counts (tokens before each one in this block).

    Bytes at the end of a file that make no whole token are no token.
    """

    def scan(batches):
        for batch in batches:
            for file, block, size in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "size")), strict=True):
                system, at = _opened(file)
                with system.open_input_file(at) as handle:
                    yield _figures(file, block, handle.read_at(size, block * block_bytes), separator, width)

    return ranges.mapInArrow(scan, _SCANNED)


def scan_files(spark: SparkSession, path: str, separator: int, width: int = WIDTH, block_bytes: int = BLOCK) -> DataFrame:
    """:func:`scan_blocks` where only Spark reaches the store: its reader hands over whole files (below 2 GB), cut into the same blocks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")

    def scan(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                whole = content.as_buffer()
                for block in range(-(-whole.size // block_bytes)):
                    yield _figures(file, block, whole.slice(block * block_bytes, min(block_bytes, whole.size - block * block_bytes)), separator, width)

    return files.mapInArrow(scan, _SCANNED)


def token_counts(spark: SparkSession, path: str, separator: int | None = None, width: int = WIDTH, block_bytes: int = BLOCK) -> DataFrame:
    """file, ordinal (from 0 in its file), n_tokens (without the separator), ended (whether a separator follows) of every document below ``path``.

    ``separator``: none for :func:`end_of_document`. Tokens after a file's last separator are a document of their own with ended false; an empty file has none.
    Bytes at a file's end that make no whole token are ignored. Documents may be longer than blocks. No files or
    only empty ones: an empty result; a path that does not exist: Spark's error.
    """
    if block_bytes % width:
        raise ValueError("blocks hold whole tokens")
    separator = end_of_document(width) if separator is None else separator
    ranges = file_ranges(spark, path, block_bytes)
    first = ranges.select("file").first()
    if first is None or reaches(first.file):
        n = ranges.count()
        spread = ranges.repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism + n // 16)), "file", "block")
        scanned = scan_blocks(spread, separator, width, block_bytes)
    else:
        scanned = scan_files(spark, path, separator, width, block_bytes)
    scanned = store.written(scanned, "token-blocks")

    w = Window.partitionBy("of").orderBy("at")  # rows: a few numbers for each block of a file
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    slim = store.again(scanned).select(F.col("file").alias("of"), F.col("block").alias("at"), "n", "separators", "last")
    begin = F.coalesce(F.sum("n").over(before), F.lit(0))
    slim = slim.withColumn("begin", begin).withColumn("ordinal", F.coalesce(F.sum("separators").over(before), F.lit(0)))
    slim = slim.withColumn("previous", F.max(F.col("begin") + F.col("last")).over(before)).withColumn("final", F.lead("at").over(w).isNull())
    placed = slim.select("of", "at", "ordinal", "final", (F.col("begin") - F.coalesce(F.col("previous") + 1, F.lit(0))).alias("carry"))

    s = scanned.join(placed, (F.col("file") == F.col("of")) & (F.col("block") == F.col("at")))
    ended = F.transform("counts", lambda x, i: F.struct((F.col("ordinal") + i).alias("ordinal"), F.when(i == 0, x + F.col("carry")).otherwise(x).alias("n_tokens"), F.lit(True).alias("ended")))
    tail = F.when(F.col("last").isNull(), F.col("carry") + F.col("n")).otherwise(F.col("n") - F.col("last") - 1)
    rest = F.array(F.struct((F.col("ordinal") + F.col("separators")).alias("ordinal"), tail.alias("n_tokens"), F.lit(False).alias("ended")))
    rows = s.select("file", F.explode(F.when(F.col("final") & (tail > 0), F.concat(ended, rest)).otherwise(ended)).alias("x"))
    return rows.select("file", "x.ordinal", "x.n_tokens", "x.ended")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Query: token counts of the documents in the token files of the whole ``documents`` table, found by separators alone."""
    path = store.folder(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    counts = token_counts(spark, path)
    return counts.select(F.regexp_extract("file", r"part-(\d+)", 1).alias("file"), "ordinal", "n_tokens", "ended")
