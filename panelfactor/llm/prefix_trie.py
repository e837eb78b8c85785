"""Conversation prefix trie by leaf-peeling message passing.

1. Turns are numbered inside their conversation: a range partition by (conversation, turn) with a sort inside each
   part, then counts of the parts, so that no conversation has to fit a task. From here on a turn is 16 bytes of
   its text's sha256 and a number of code points; texts aren't shuffled.
2. Conversations are rebuilt with the shared head of their base (five turns at most).
3. A prefix is known by its depth and 128 bits that combine its turns with their places, as running totals
   in blocks of rows. A node is a group of equal prefixes; it is named by its depth and its smallest member.
4. Nodes with the same members lie on one path, so a chain (a run of only children that have all of their parent's
   members) is one unit: (smallest member, number of members).
5. Peeling. Each unit holds a counter of children that aren't finished. In each round the finished units send
   their subtree's totals to their parents, whose counters fall, until the root is finished. Rounds are as many as
   a path has branching units at most. Totals are summed before they are shuffled, however many children there are.
6. Inside a chain, what lies above a node is taken from the chain's total by running totals.
7. The conversations that end at a node are joined to text in sorted pieces of CHUNK ids, and a node's pieces go
   through one hash in order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .skew import split_join

#: A conversation takes the first crc32 % HEADS turns of the conversation whose id is its own without the rest by GROUP.
GROUP, HEADS = 100, 6
#: Rows of one window; ids in one piece of joined text.
BLOCK, CHUNK = 4_096, 65_536
SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"

_PREFIX = ["depth", "p1", "p2"]


def _running(rows: DataFrame, group: list[str], order: str, values: dict[str, str], fold, empty: int, own: bool) -> DataFrame:
    """``rows`` with running folds of columns (new name to column) along ``order`` (0, 1, 2 ...) within each group.

    ``own``: whether a row's own value is part. Blocks of BLOCK places are folded apart, then blocks: a group of any size goes
    through windows of at most BLOCK rows, and of a row for each of its blocks.
    """
    block = F.floor(F.col(order) / BLOCK).cast("long")
    rows = rows.withColumn("_block", block)
    here = Window.partitionBy(*group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select("*", *(F.coalesce(fold(c).over(here), F.lit(empty)).alias(n) for n, c in values.items()))
    # only groups beyond one block have more than their own rows to look at
    whole = rows.groupBy(*group, "_block").agg(*(fold(c).alias(n) for n, c in values.items()))
    whole = whole.select(*(F.col(g).alias(f"_{g}") for g in group), F.col("_block").alias("_of"), *(fold(n).over(Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias(f"_{n}") for n in values))
    whole = whole.where("_of > 0")
    same = F.col("_block") == F.col("_of")
    for g in group:
        same &= F.col(g) == F.col(f"_{g}")
    merged = local.where("_block > 0").join(whole, same, "left")
    both = {n: F.coalesce(F.col(f"_{n}"), F.lit(empty)) for n in values}
    add = (lambda a, b: a.bitwiseXOR(b)) if fold is F.bit_xor else (lambda a, b: a + b)
    merged = merged.withColumns({n: add(F.col(n), b) for n, b in both.items()})
    names = [c for c in local.columns if c != "_block"]
    return local.where("_block = 0").select(names).unionByName(merged.select(names))


def _numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, place, digest, chars of each turn; conv_id, part, first, before, n of each part of a conversation)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    # the row only lets a boundary fall between equal turns, whose order is of no matter
    ordered = turns.repartitionByRange("conv_id", "turn", "digest", "row").sortWithinPartitions("conv_id", "turn", "digest")
    turns = store.written(ordered.select("conv_id", "digest", "chars", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)), "trie-turns")
    pieces = turns.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return turns, store.written(pieces.withColumn("before", F.coalesce(before, F.lit(0))), "trie-pieces")


def rebuilt(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth from 1, digest, chars, last of each rebuilt turn; conv_id, own, take, h of each conversation).

    See :func:`prefix_trie` for how a conversation is rebuilt; ``last`` marks its last turn.
    """
    turns, pieces = _numbered(conversations)
    key = pieces.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "first", "before")
    placed = turns.join(key, (F.col("conv_id") == F.col("_conv")) & (F.col("part") == F.col("_part")))
    placed = store.written(placed.select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("place"), "digest", "chars"), "trie-placed")
    shared = store.written(placed.where((F.col("conv_id") % group == 0) & (F.col("place") < heads)).select(F.col("conv_id").alias("from"), "place", "digest", "chars"), "trie-heads")
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    convs = pieces.groupBy("conv_id").agg(F.sum("n").alias("own")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % group})
    have = shared.groupBy("from").agg(F.max("place").alias("have"))
    convs = convs.join(have, F.col("base") == F.col("from"), "left").withColumn("take", F.least("h", F.coalesce("have", F.lit(0)))).drop("from", "have")
    convs = store.written(convs, "trie-conversations")
    total = convs.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
    long = store.again(convs).where("own > h").select(F.col("conv_id").alias("of"), "own", "take")
    kept = split_join(store.again(placed).withColumn("h", h).where("place > h"), long, {"conv_id": "of"}, "own", total)
    kept = kept.select("conv_id", (F.col("take") + F.col("place") - F.col("h")).alias("depth"), "digest", "chars", (F.col("place") == F.col("own")).alias("last"))
    copied = store.again(convs).where("take > 0").join(store.again(shared), (F.col("base") == F.col("from")) & (F.col("place") <= F.col("take")))
    copied = copied.select("conv_id", F.col("place").alias("depth"), "digest", "chars", ((F.col("place") == F.col("take")) & (F.col("own") <= F.col("h"))).alias("last"))
    return store.written(kept.unionByName(copied), "trie-rebuilt"), convs


def _same_as_before(columns: list[np.ndarray]) -> np.ndarray:
    """Whether a row has the key of the row before it; the first has not."""
    out = np.zeros(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def _pieces(batches):
    """Sorted (node, conversation) rows in; a row for each node and CHUNK ids or batch out, with the ids as text."""
    for batch in batches:
        key = [batch.column(c).to_numpy() for c in _PREFIX]
        first = np.flatnonzero(~_same_as_before(key))
        sizes = np.diff(np.r_[first, batch.num_rows])
        first = np.concatenate([np.arange(f, f + n, CHUNK) for f, n in zip(first, sizes, strict=True)]) if len(first) else first
        ids = batch.column("conv_id")
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, batch.num_rows].astype(np.int32)), ids.cast(pa.string()))
        at = pa.array(first)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in _PREFIX), ids.take(at), pc.binary_join(lists, ",")], names=[*_PREFIX, "start", "ids"])


def _digests(batches):
    """Pieces sorted by node and first id in, the digest of each node's ids out; one node's hash is all that is held."""
    names, now, state = [*_PREFIX, "ends_sha256"], None, None
    for batch in batches:
        out = []
        for key, ids in zip(zip(*(batch.column(c).to_pylist() for c in _PREFIX), strict=True), batch.column("ids").to_pylist(), strict=True):
            if key == now:
                state.update(b"," + ids.encode())
                continue
            if now is not None:
                out.append((*now, state.hexdigest()))
            now, state = key, hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, state.hexdigest())], names=names)


def _ends(ends: DataFrame) -> DataFrame:
    """depth, p1, p2, ends_sha256 of each node at which conversations end."""
    ordered = ends.repartitionByRange(*_PREFIX, "conv_id").sortWithinPartitions(*_PREFIX, "conv_id")
    pieces = ordered.mapInArrow(_pieces, "depth long, p1 long, p2 long, start long, ids string")
    return pieces.repartition(*_PREFIX).sortWithinPartitions(*_PREFIX, "start").mapInArrow(_digests, "depth long, p1 long, p2 long, ends_sha256 string")


def _nodes(walked: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes with their parents: depth, p1, p2, conv_id, n_convs, chars, n_children, up (parent_conv_id), up_n (its n_convs)."""
    deep = walked.groupBy(*_PREFIX).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.max("k1").alias("k1"), F.max("k2").alias("k2"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(*(F.lit(0).cast("long").alias(c) for c in _PREFIX), "conv_id", "n_convs", *(F.lit(0).cast("long").alias(c) for c in ("chars", "k1", "k2")))
    above = {"q0": F.col("depth") - 1, "q1": F.col("p1").bitwiseXOR(F.col("k1")), "q2": F.col("p2").bitwiseXOR(F.col("k2"))}
    nodes = store.written(deep.unionByName(root).withColumns(above).drop("k1", "k2"), "trie-nodes")
    counts = nodes.where("depth > 0").groupBy("q0", "q1", "q2").agg(F.count("*").alias("n_children"))
    counts = counts.select(F.col("q0").alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), "n_children")
    counted = store.written(store.again(nodes).join(counts, _PREFIX, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-counted")
    total = counted.count()
    parents = store.again(counted).where("n_children > 0").select(*(F.col(c).alias(f"of_{c}") for c in _PREFIX), F.col("conv_id").alias("up"), F.col("n_convs").alias("up_n"), F.col("n_children").alias("siblings"))
    linked = split_join(store.again(counted).where("depth > 0"), parents, {"q0": "of_depth", "q1": "of_p1", "q2": "of_p2"}, "siblings", total)
    names = [*_PREFIX, "conv_id", "n_convs", "chars", "n_children", "up", "up_n"]
    none = F.lit(None).cast("long")
    return store.written(linked.select(names).unionByName(store.again(counted).where("depth = 0").withColumns({"up": none, "up_n": none}).select(names)), "trie-linked")


def _peeled(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(unit, unit_n, size, n_leaves, saved of each chain's subtree, its own included; number of rounds)."""
    own = F.sum((F.col("n_convs") - 1) * F.col("chars"))
    chains = nodes.groupBy(F.col("conv_id").alias("unit"), F.col("n_convs").alias("unit_n")).agg(F.count("*").alias("size"), F.min_by("up", "depth").alias("up"), F.min_by("up_n", "depth").alias("up_n"), F.max_by("n_children", "depth").alias("waiting"), own.alias("saved"))
    now = store.written(chains.withColumn("n_leaves", F.when(F.col("waiting") == 0, 1).otherwise(0).cast("long")), "trie-units")
    done, rounds = [], 0
    while now.where("waiting > 0").limit(1).count():
        rounds += 1
        done.append(now.where("waiting = 0"))
        sent = done[-1].groupBy(F.col("up").alias("to"), F.col("up_n").alias("to_n")).agg(F.count("*").alias("finished"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more"))
        open_ = store.again(now).where("waiting > 0").join(sent, (F.col("unit") == F.col("to")) & (F.col("unit_n") == F.col("to_n")), "left")
        got = {"waiting": ("waiting", "finished", -1), "n_leaves": ("n_leaves", "more_leaves", 1), "saved": ("saved", "more", 1)}
        now = store.written(open_.withColumns({n: F.col(a) + sign * F.coalesce(F.col(b), F.lit(0)) for n, (a, b, sign) in got.items()}).select(now.columns), "trie-round")
    for part in done:
        now = now.unionByName(part)
    return now.select("unit", "unit_n", "size", "n_leaves", F.col("saved").alias("whole")), rounds


def prefix_trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (columns of SCHEMA).

    ``conversations``: conv_id, turn, role, text. A conversation's turns are ordered by turn (null first; equal turns by the
    sha256 of role length, role and text, so repeated rows are turns like others); null role or text counts as empty.
    Conversation c begins with the first h turns of conversation c - c % ``group`` (all if it has fewer, none if it isn't there),
    h = crc32(c in decimal) % ``heads``, and goes on with its own turns after its first h. Rows without conv_id take no part. Texts and
    conversations may have any length. Extra columns are ignored; an empty table gives no rows (not even a root).
    """
    turns, convs = rebuilt(conversations, group, heads)
    k = {f"k{n}": F.xxhash64(F.lit(n), "depth", "digest") for n in (1, 2)}
    walked = _running(turns.withColumns(k), ["conv_id"], "depth", {"p1": "k1", "p2": "k2"}, F.bit_xor, 0, True)
    walked = store.written(walked.select("conv_id", "chars", "last", "k1", "k2", *_PREFIX), "trie-walked")
    nodes = _nodes(walked, store.again(convs))
    peeled, _ = _peeled(store.again(nodes))
    total = nodes.count()
    seen = store.again(nodes).withColumn("own", (F.col("n_convs") - 1) * F.col("chars"))
    once, often = seen.where("n_convs = 1").withColumn("over", F.lit(0).cast("long")), seen.where("n_convs > 1")
    top = often.groupBy(F.col("conv_id").alias("_c"), F.col("n_convs").alias("_n")).agg(F.min("depth").alias("top"), F.count("*").alias("long"))
    often = split_join(often, top, {"conv_id": "_c", "n_convs": "_n"}, "long", total).withColumn("step", F.col("depth") - F.col("top")).drop("_c", "_n", "top", "long")
    over = _running(often, ["conv_id", "n_convs"], "step", {"over": "own"}, F.sum, 0, False).drop("step")
    done = split_join(once.unionByName(over), store.written(peeled, "trie-done"), {"conv_id": "unit", "n_convs": "unit_n"}, "size", total)
    nowhere = store.again(convs).where("take = 0 AND own <= h").select(*(F.lit(0).cast("long").alias(c) for c in _PREFIX), "conv_id")
    ends = _ends(store.again(walked).where("last").select(*_PREFIX, "conv_id").unionByName(nowhere))
    named = done.join(ends, _PREFIX, "left")
    return named.select(
        "conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("whole") - F.col("over")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Query: every node of the trie of the whole ``conversations`` table."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_BITS = ", ".join(f"(ascii(x) >> {k}) & 1" for k in range(8))
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [{_BITS}]))), lambda a, b: xor(a >> 1, CASE WHEN xor(a & 1, b) = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295)"
OP11_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS ts FROM t GROUP BY conv_id),
g AS (SELECT conv_id, ts, {_CRC} % {HEADS} AS h FROM o),
b AS (SELECT g.conv_id, list_concat(coalesce(list_slice(o.ts, 1, h), []), list_slice(g.ts, h + 1, len(g.ts))) AS ts FROM g LEFT JOIN o ON o.conv_id = g.conv_id - g.conv_id % {GROUP}),
p AS MATERIALIZED (SELECT conv_id AS c, d, len(ts) AS n, list_slice(ts, 1, d) AS k FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM b)),
v AS MATERIALIZED (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends, CASE WHEN d = 0 THEN 0 ELSE length(k[d].text) END AS chars FROM p GROUP BY d, k),
m AS MATERIALIZED (SELECT p.c, v.d, v.conv_id FROM p JOIN v USING (d, k)),
w AS MATERIALIZED (SELECT v.*, m.conv_id AS up FROM v LEFT JOIN m ON m.c = v.conv_id AND m.d = v.d - 1),
f AS MATERIALIZED (SELECT w.*, (SELECT count(*) FROM w x WHERE x.d = w.d + 1 AND x.up = w.conv_id) AS n_children FROM w),
s AS (SELECT m.d, m.conv_id, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars)::BIGINT AS saved FROM f JOIN m ON m.c = f.conv_id AND m.d <= f.d GROUP BY 1, 2)
SELECT f.conv_id, f.d::BIGINT AS depth, f.up AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved AS saved_tokens, sha256(f.ends) AS ends_sha256 FROM f JOIN s USING (d, conv_id)
"""
