"""BPE encoding and decoding with a tokenizer file's vocabulary (word-end BPE, lower case, white space dropped).

Method: the words of a chunk of texts that are not known yet become one flat array of byte symbols;
each round looks up all adjacent pairs by binary search over the sorted pair keys, finds each word's
lowest rank and merges that pair wherever it occurs in the word, until no word has a known pair.
A very long word would be looked at whole once for each of its ranks; it is merged by linked symbols
instead, where a round touches only the places of one rank and their neighbours.
The vocabulary is read from a path by the driver and sent as arrays; it is never trained here.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that hold one chunk of texts, and known words kept before the memory starts anew.
CHUNK_CHARS, KNOWN_WORDS = 1 << 21, 200_000
#: Bytes of a piece that is merged by itself, and characters of known words kept.
LONG_PIECE, KNOWN_CHARS = 512, 1 << 25
_NONE = np.iinfo(np.int64).max

# Fixed values of the tokenizer's pre-tokenizer and of Unicode's White_Space property.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
_UNIT = regex.compile("[\x1c-\x1f]")


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Arrays of a tokenizer file: byte symbols (inside a word, at its end), sorted pair keys with ranks and results, tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = [""] * (max(max(ids.values()), *self.special.values()) + 1)
        for token, k in (ids | self.special).items():
            self.tokens[k] = token
        self.inside = np.array([ids[c] for c in byte_characters()])
        self.final = np.array([ids[c + end] for c in byte_characters()])
        self.width = len(self.tokens)
        pairs = np.array([(ids[a] * self.width + ids[b], ids[a + b]) for a, b in model["merges"]])
        order = np.argsort(pairs[:, 0])
        self.keys, self.results, self.ranks = pairs[order, 0], pairs[order, 1], order


class Encoder:
    """Encodes texts; remembers the words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.special = regex.compile("|".join(regex.escape(x) for x in vocabulary.special)) if vocabulary.special else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.starts, self.lengths, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or none) and result of pairs of symbols."""
        v = self.v
        key = left.astype(np.int64) * v.width + right
        at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        return np.where(v.keys[at] == key, v.ranks[at], _NONE), v.results[at]

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Symbols of one piece: rounds from rank to rank over linked symbols; a place lies in the bucket of its pair's rank."""
        raw = np.frombuffer(piece, np.uint8)
        n = len(raw)
        symbol = self.v.inside[raw].astype(np.int32)
        symbol[-1] = self.v.final[raw[-1]]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        rank, result = np.full(n, _NONE), np.zeros(n, np.int32)
        rank[:-1], result[:-1] = self._ranked(symbol[:-1], symbol[1:])
        buckets: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(places: np.ndarray) -> None:
            places = places[rank[places] < _NONE]
            if not len(places):
                return
            order = places[np.argsort(rank[places], kind="stable")]
            ranks, first = np.unique(rank[order], return_index=True)
            for k, own in zip(ranks.tolist(), np.split(order, first[1:]), strict=True):
                if k not in buckets:
                    buckets[k] = []
                    heapq.heappush(heap, k)
                buckets[k].append(own)

        if n > 1:
            put(np.arange(n - 1))
        alive = np.ones(n, bool)
        while heap:
            k = heapq.heappop(heap)
            places = np.unique(np.concatenate(buckets.pop(k)))
            places = places[alive[places] & (rank[places] == k)]
            if not len(places):
                continue
            # in a run of one repeated symbol every second pair is taken, from the left
            chained = np.r_[False, places[1:] == after[places[:-1]]]
            index = np.arange(len(places))
            places = places[(index - np.maximum.accumulate(np.where(chained, 0, index))) % 2 == 0]
            gone = after[places]
            symbol[places] = result[places]
            alive[gone] = False
            after[places] = after[gone]
            follows = after[places] < n
            before[after[places][follows]] = places[follows]
            touched = np.unique(np.concatenate([places, before[places][before[places] >= 0]]))
            ends = after[touched] >= n
            rank[touched[ends]] = _NONE
            touched = touched[~ends]
            rank[touched], result[touched] = self._ranked(symbol[touched], symbol[after[touched]])
            put(touched)
        return symbol[alive].astype(np.int64)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all pieces after all merges, flat, and how many each piece has."""
        long = [k for k, x in enumerate(pieces) if len(x) > LONG_PIECE]
        if not long:
            return self._merge_short(pieces)
        symbols, counts = self._merge_short([x if len(x) <= LONG_PIECE else b"" for x in pieces])
        parts = np.split(symbols, np.cumsum(counts)[:-1])
        for k in long:
            parts[k] = self.merge_long(pieces[k])
            counts[k] = len(parts[k])
        return np.concatenate(parts), counts

    def _merge_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        v = self.v
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(lengths)
        symbols = v.inside[raw]
        some = ends[lengths > 0] - 1
        symbols[some] = v.final[raw[some]]
        word = np.repeat(np.arange(len(pieces)), lengths)
        done_symbols, done_words = [], []
        while len(symbols):
            rank = np.full(len(symbols), _NONE)
            result = np.zeros(len(symbols), np.int64)
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same], result[same] = self._ranked(symbols[same], symbols[same + 1])
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[first, len(word)])
            lowest = np.repeat(np.minimum.reduceat(rank, first), sizes)
            over = lowest == _NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                on = ~over
                symbols, word, rank, result, lowest = symbols[on], word[on], rank[on], result[on], lowest[on]
                if not len(symbols):
                    break
            chosen = rank == lowest
            # in a run of one repeated symbol every second pair is taken, from the left
            index = np.arange(len(chosen))
            run_start = np.maximum.accumulate(np.where(chosen & ~np.r_[False, chosen[:-1]], index, 0))
            chosen &= (index - run_start) % 2 == 0
            symbols = np.where(chosen, result, symbols)
            keep = ~np.r_[False, chosen[:-1]]
            symbols, word = symbols[keep], word[keep]
        if not done_words:
            return np.empty(0, np.int64), np.zeros(len(pieces), np.int64)
        words, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(words, kind="stable")
        return symbols[order], np.bincount(words, minlength=len(pieces))

    def _learn(self, words: list[str]) -> None:
        if self.known and (len(self.known) + len(words) > KNOWN_WORDS or self.held > KNOWN_CHARS):
            self._forget()
        self.held += sum(map(len, words))
        pieces: list[bytes] = []
        owners: list[int] = []
        for k, word in enumerate(words):
            if word.isalpha():
                pieces.append(word.encode())
                owners.append(k)
            else:
                for piece in _PIECE.findall(word):
                    pieces.append(piece.encode())
                    owners.append(k)
        symbols, counts = self.merge(pieces)
        lengths = np.bincount(np.array(owners, np.int64), weights=counts, minlength=len(words)).astype(np.int64)
        base = len(self.pool)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, base + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.pool = np.concatenate([self.pool, symbols])

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [x for x in _SPACE.split(text) if x] if _UNIT.search(text) else text.split()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, flat, and how many each text has."""
        words: list[str] = []
        counts, special = [], []
        for text in texts:
            before = len(words)
            if text and any(x in text for x in self.v.special):
                at = 0
                for m in self.special.finditer(text):
                    words += self._words(text[at : m.start()])
                    special.append((len(words), self.v.special[m[0]]))
                    words.append("")
                    at = m.end()
                words += self._words(text[at:])
            elif text:
                words += self._words(text)
            counts.append(len(words) - before)
        distinct = set(words)
        distinct.discard("")
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > KNOWN_WORDS or self.held > KNOWN_CHARS:
            new = list(distinct)
            self._forget()
        self._learn(new)
        self.known[""] = -1
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        del self.known[""]
        lengths = np.where(index < 0, 1, self.lengths[index]) if len(self.lengths) else np.ones(len(index), np.int64)
        starts = np.where(index < 0, 0, self.starts[index]) if len(self.starts) else np.zeros(len(index), np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
        ids = self.pool[at] if len(self.pool) else np.zeros(total, np.int64)
        for place, k in special:
            ids[ends[place] - 1] = k
        per_text = np.add.reduceat(np.r_[lengths, 0], np.minimum(np.cumsum(counts) - counts, len(lengths))) if len(counts) else np.empty(0, np.int64)
        return ids, np.where(np.array(counts) > 0, per_text, 0)


def decode(vocabulary: Vocabulary, ids) -> str:
    """The tokens of the ids with a space between, as a tokenizer without a decoder gives; unknown ids are left out."""
    n = vocabulary.width
    return " ".join([vocabulary.tokens[k] for k in ids if 0 <= k < n])


def chunks(texts: pa.Array):
    """Runs of whole texts of about CHUNK_CHARS characters."""
    out, size = [], 0
    for text in texts:
        out.append(text.as_py())
        size += len(out[-1] or "")
        if size >= CHUNK_CHARS:
            yield out
            out, size = [], 0
    if out:
        yield out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), the encoding of ``text``; a column named ids is replaced.

    Null or empty text: no ids. Special tokens written in a text get their ids. Texts are encoded
    whole, whatever their length; repeated rows alike; extra columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()))
    docs = docs.drop("ids").withColumn("text", F.col("text").cast("string"))
    names = docs.columns

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            at = 0
            for texts in chunks(batch.column("text")):
                ids, counts = encoder.encode(texts)
                bounds = np.r_[0, np.cumsum(counts)].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(texts)).columns, lists], names=[*names, "ids"])
                at += len(texts)

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", ids array<int>")


def decode_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ``decoded`` (string) made from ``ids``; null ids give an empty text, unknown ids are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()))
    docs = docs.drop("decoded")

    def run(batches):
        for batch in batches:
            texts = [decode(shared.value, x.as_py() or ()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return docs.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", decoded string")


def round_trip(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of every text: encoded, then decoded from the ids, in one pass.

    Nulls, long texts and repeated rows as in :func:`encode_texts`; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches):
        vocabulary = shared.value
        encoder = Encoder(vocabulary)
        for batch in batches:
            at = 0
            for texts in chunks(batch.column("text")):
                ids, counts = encoder.encode(texts)
                bounds = np.r_[0, np.cumsum(counts)].astype(np.int32)
                wide, sums, decoded = ids.astype("<u4"), [], []
                for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    sums.append(hashlib.sha256(wide[begin:end].tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(decode(vocabulary, ids[begin:end].tolist()).encode()).hexdigest())
                columns = [batch.column("doc_id").slice(at, len(texts)), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += len(texts)

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """Query: round trip of the whole ``documents`` table."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
