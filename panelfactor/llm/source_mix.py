"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Sources share the corpus' words by weight, none beyond ``MAX_COPIES`` times what it has. Inside a source
long documents are wanted more than fragments: a document is due r = c * (FLOOR + bits of its size) copies,
``MAX_COPIES`` at most, where c is the number that makes the source's due words its target. It gets
floor(r) certain whole copies; for the rest f = r - floor(r) documents are ranked by Pareto's ranking
variable, their random odds u / (1 - u) divided by their inclusion odds f / (1 - f), and the first ones
up to the words still due get one copy more, so that a document is taken with a chance near its f.
Document u is a hash of its id and the seed, so reruns agree.

The order inside a source is made without sorting the source in one task: the ranking variable q is cut
into buckets by q / (1 + q), running sums over the buckets' words find the bucket in which a source's
target falls (near q = 1, where buckets hold their share or less), and only that bucket is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .skew import split_join

WEIGHTS, MAX_COPIES, SEED = (1, 2, 3), 3, 20240517
#: What a document is due grows from FLOOR by one for each bit of its size: 5 shares at one word, 14 at a thousand.
FLOOR = 4
#: Documents that one bucket should hold at most when one source has them all.
BUCKET_DOCUMENTS = 2_000


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``: white space becomes one space, trimmed; spaces plus one."""
    flat = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(flat == "", F.lit(0).cast("long")).otherwise(F.length(flat) - F.length(F.translate(flat, " ", "")) + F.lit(1).cast("long"))


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) from the id (null: from the text): 52 bits of MD5."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text.cast("string"), F.lit("")))))
    key = F.concat_ws(":", name, F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def size_bits(size: Column) -> Column:
    """Bits of a number of words: 0 for none, 1 for one, 10 for 512 to 1,023."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, target for (source, source_size) rows, one for each source.

    Water filling: with sources ordered by size / weight, those below the level are full (at
    max_copies times their size) and the others share what is left by weight.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("place", F.row_number().over(place) - 1).withColumn("weight", weight).withColumn("cap", (max_copies * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, onwards = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(1))).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onwards))
    full = F.col("level") * F.col("weight") >= F.col("cap")
    # the first source that is not full sets the level for itself and all after it
    s = s.withColumn("level", F.first(F.when(~full, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return s.select("source", "source_size", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")).alias("target"))


def _text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def due_copies(classes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, bits, whole, fraction for (source, bits, words, target) rows: certain copies, and the chance of one more.

    Water filling: from the largest documents down, classes whose share would exceed max_copies are full, and c
    spreads what is left over the others.
    """
    share = (F.col("bits") + FLOOR).cast("double")
    order = Window.partitionBy("source").orderBy(F.desc("bits"))  # a row for each bit of the longest text
    before, onwards = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("target") - max_copies * F.coalesce(F.sum("words").over(before), F.lit(0))
    c = classes.withColumn("left", left).withColumn("shares", F.sum(F.col("words") * share).over(onwards))
    c = c.withColumn("c", F.when(F.col("shares") > 0, F.col("left") / F.col("shares")))
    open_c = F.first(F.when(F.col("c") * share < max_copies, F.col("c")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    r = F.when(F.col("words") > 0, F.least(F.coalesce(open_c * share, F.lit(float(max_copies))), F.lit(float(max_copies)))).otherwise(F.lit(0.0))
    c = c.withColumn("r", r)
    return c.select("source", "bits", F.floor("r").cast("long").alias("whole"), (F.col("r") - F.floor("r")).alias("fraction"))


def mix(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (whole copies that the mix takes) and text_key of each row of ``docs``.

    Null text: size 0. Null source: a source of its own, last. Documents without words are not taken, which
    changes no sum. Null ids are told apart by their text. Repeated rows and equal ids are ranked alike and then by
    size. Texts may have any length. Other columns are ignored. An empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).cast("long").alias("size"), _text_key().alias("text_key"), uniform(F.col("doc_id"), F.col("text"), seed).alias("u"))
    sized = store.written(slim.withColumn("bits", size_bits(F.col("size"))), "mix-sizes")
    classes = store.written(sized.groupBy("source", "bits").agg(F.sum("size").alias("words"), F.count("*").alias("documents")), "mix-classes")
    per_source = classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("documents").alias("members"))
    n = classes.agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0]
    targets = source_targets(per_source.select("source", "source_size"), weights, max_copies).join(per_source.select(F.col("source").alias("m_source"), "members"), F.col("source").eqNullSafe(F.col("m_source"))).drop("m_source")
    targets = store.written(targets, "mix-targets")
    t, k = targets.alias("t"), store.again(classes).alias("k")
    aimed = k.join(t, F.col("k.source").eqNullSafe(F.col("t.source"))).select("k.source", "bits", "words", "target")
    due = due_copies(aimed, max_copies).alias("d")
    due = due.join(k, F.col("d.source").eqNullSafe(F.col("k.source")) & (F.col("d.bits") == F.col("k.bits"))).select(F.col("d.source").alias("k_source"), F.col("d.bits").alias("k_bits"), "whole", "fraction", "words", "documents")
    due = store.written(due, "mix-due")

    buckets = max(16, n // BUCKET_DOCUMENTS + 1)
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("fraction") / (1 - F.col("fraction")))
    ranked = split_join(sized, due.drop("words"), {"source": "k_source", "bits": "k_bits"}, "documents", n).select("doc_id", "source", "size", "text_key", "whole", F.when(F.col("fraction") > 0, odds).alias("rank"))
    ranked = store.written(ranked.withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * buckets)), "mix-ranks")

    rest = store.again(due).groupBy("k_source").agg(F.sum(F.col("words") * F.col("fraction")).alias("rest"))
    sums = ranked.where("rank is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # rows: buckets, not documents
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(running), F.lit(0)))
    # the bucket in which the words that are due run out; none: all ranked documents fit
    cuts = starts.join(rest, F.col("source").eqNullSafe(F.col("k_source"))).where(F.col("start") + F.col("words") > F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", "start", "rest")).alias("cut"))
    c, t = cuts.alias("c"), store.again(targets).alias("t")
    per_source = t.join(c, F.col("t.source").eqNullSafe(F.col("c.source")), "left").select(F.col("t.source").alias("p_source"), "source_size", "target", "members", "cut")
    d = split_join(ranked, store.written(per_source, "mix-cuts"), {"source": "p_source"}, "members", n)

    inside = F.coalesce(F.col("bucket") == F.col("cut.bucket"), F.lit(False))
    upto = Window.partitionBy("source", "bucket").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    # a document belongs to the sample while the target lies beyond the middle of its words
    last = d.where(inside).withColumn("extra", (F.col("cut.start") + F.sum("size").over(upto) - F.col("size") / 2 <= F.col("cut.rest")).cast("long"))
    before = F.col("rank").isNotNull() & (F.col("cut").isNull() | (F.col("bucket") < F.col("cut.bucket")))
    clear = d.where(~inside).withColumn("extra", before.cast("long"))
    columns = ["doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"), "text_key"]
    return clear.select(columns).unionByName(last.select(columns))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as :func:`mix` takes it (repeated rows: as often as all of them together).

    Documents without words are not in the mix. Nulls, long texts, ties and empty tables as in :func:`mix`; columns of any name stay.
    """
    m = mix(docs, weights, max_copies, seed)
    taken = m.groupBy(F.col("doc_id").alias("_sm_id"), F.col("source").alias("_sm_source"), F.col("text_key").alias("_sm_text")).agg(F.sum("copies").alias("_sm_copies")).where("_sm_copies > 0")
    keyed = docs.withColumn("_sm_doc", F.col("doc_id").cast("long")).withColumn("_sm_key", _text_key())
    met = keyed.join(taken, F.col("_sm_doc").eqNullSafe(F.col("_sm_id")) & (F.col("_sm_key") == F.col("_sm_text")) & F.col("source").cast("string").eqNullSafe(F.col("_sm_source")))
    once = met.withColumn("_sm_row", F.row_number().over(Window.partitionBy("_sm_id", "_sm_text", "_sm_source").orderBy(F.lit(1)))).where("_sm_row = 1")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_sm_copies")))
    return once.withColumn("_sm_copy", copies).select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_source_mix(spark, sf_dir: str) -> DataFrame:
    """Query: the mix of the whole ``documents`` table."""
    m = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, size, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS bits, u FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) || ':{SEED}'), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)} AS u FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::DOUBLE AS weight FROM d GROUP BY source),
-- rounds of resharing: what is full stays full, the others share the rest
fill AS (SELECT 0 AS round, source, source_size, weight, false AS is_full FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight, is_full OR weight * ((sum(source_size) OVER () - coalesce(sum({MAX_COPIES} * source_size) FILTER (WHERE is_full) OVER (), 0)) / sum(weight) FILTER (WHERE NOT is_full) OVER ()) >= {MAX_COPIES} * source_size FROM fill WHERE round < 60),
t AS (SELECT source, source_size, CASE WHEN is_full THEN {MAX_COPIES}.0 * source_size ELSE weight * ((sum(source_size) OVER () - coalesce(sum({MAX_COPIES} * source_size) FILTER (WHERE is_full) OVER (), 0)) / sum(weight) FILTER (WHERE NOT is_full) OVER ()) END::DOUBLE AS target FROM fill WHERE round = 60),
-- the same inside each source, over its size classes
k AS (SELECT source, bits, sum(size)::DOUBLE AS words, ({FLOOR} + bits)::DOUBLE AS share FROM d WHERE size > 0 GROUP BY source, bits),
inner_fill AS (SELECT 0 AS round, k.source, bits, words, share, target, false AS is_full FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
  UNION ALL
  SELECT round + 1, source, bits, words, share, target, is_full OR share * (target - coalesce(sum({MAX_COPIES} * words) FILTER (WHERE is_full) OVER (PARTITION BY source), 0)) / sum(words * share) FILTER (WHERE NOT is_full) OVER (PARTITION BY source) >= {MAX_COPIES} FROM inner_fill WHERE round < 70),
r AS (SELECT source, bits, words, CASE WHEN is_full THEN {MAX_COPIES}.0 ELSE share * (target - coalesce(sum({MAX_COPIES} * words) FILTER (WHERE is_full) OVER (PARTITION BY source), 0)) / sum(words * share) FILTER (WHERE NOT is_full) OVER (PARTITION BY source) END AS r FROM inner_fill WHERE round = 70),
f AS (SELECT source, bits, floor(r)::BIGINT AS whole, r - floor(r) AS f, sum(words * (r - floor(r))) OVER (PARTITION BY source) AS rest FROM r),
x AS (SELECT d.*, source_size, target, coalesce(whole, 0) AS whole, coalesce(f, 0) AS f, rest FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.bits = f.bits),
o AS (SELECT *, sum(CASE WHEN f > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY CASE WHEN f > 0 THEN (u / (1 - u)) / (f / (1 - f)) END NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM x)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN f > 0 AND upto - size / 2 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM o
"""
