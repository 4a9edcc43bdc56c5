"""Byte-level BPE over a file of merge ranks: higher-order functions fold the ranked merges over distinct words.

1. Texts are cut into words where the pattern of the vocabulary cuts them, vectorised over the bytes of a batch, and the
   distinct words are counted over the whole corpus.
2. The most frequent words, a bounded number, are merged in Spark: an ``aggregate`` over a word's bytes joins, at each step, the leftmost
   pair of least rank, which it finds in a literal map of the ranks (dealt into buckets, since Spark scans a map to find a key).
   The result is a dictionary of proven size, which is broadcast.
3. Texts are cut again and their words replaced by ids. A word outside the dictionary is merged in the task with a heap, by the same rule.
4. Decoding concatenates the binary pieces of the ids.

Nothing but word counts is shuffled.
"""

from __future__ import annotations

import base64
import heapq
import json
import sys
import types
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import recent_letters
from .common import small_arrow_batches, staged, text_of
from .shingles import mix, text_buffer

#: Words of the dictionary, and the bytes of its longest one: with keys and at most 16 ids a word it holds 30 MB at the very most.
DICTIONARY_WORDS = 1 << 18
SHORT = 16
#: Buckets of the literal rank map.
BUCKETS = 1 << 15
#: Bytes of text whose arrays are held at a time; a longer text is cut before white space.
SEGMENT = 1 << 20
#: Words outside the dictionary that a worker remembers in each of two generations, and words it counts before it hands them on.
REMEMBERED, COUNTED = 100_000, 200_000

_NONE = 1 << 30
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_U64 = np.uint64
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], _U64)
#: The white space of the pattern, and the letters after an apostrophe that it keeps with it.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Letters of Unicode 17, which are none to the library.
UNICODE_17 = "A7CE-A7CE,A7D2-A7D2,A7D4-A7D4,16EA0-16EB8"


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and their ranks, which are their ids, from a rank file (fixed size)."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


# ---- words

def _worker_store(key: str) -> dict:
    """What a Python worker keeps between tasks under ``key``."""
    return sys.modules.setdefault("_byte_bpe", types.ModuleType("_byte_bpe")).__dict__.setdefault(key, {})


@cache
def code_point_classes() -> np.ndarray:
    """Of every code point: white space, letter, number or other, as the library's tables have them (Unicode 16.0)."""
    table = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, what in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
        table[[ord(c) for c in regex.findall(what, every)]] = kind
    fresh = recent_letters()
    if fresh:
        table[[ord(c) for c in regex.findall(f"[{fresh}]", every)]] = _OTHER
    for run in UNICODE_17.split(","):
        lo, hi = (int(x, 16) for x in run.split("-"))
        table[lo : hi + 1] = _OTHER
    table[[ord(c) for c in WHITE_SPACE]] = _SPACE
    return table


@cache
def packed_classes() -> bytes:
    """The classes as a few KB that go to the tasks with the function they run."""
    return zlib.compress(code_point_classes().tobytes())


def unpacked_classes(packed: bytes) -> np.ndarray:
    store = _worker_store("classes")
    if "table" not in store:
        store["table"] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return store["table"]


def byte_classes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    out = table[:256][data]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        padded = np.r_[data, np.zeros(3, np.uint8)].astype(np.uint32)
        b0, b1, b2, b3 = (padded[at + k] for k in range(4))
        tails = [x & 0x3F for x in (b1, b2, b3)]
        size = np.where(b0 < 0xE0, 2, np.where(b0 < 0xF0, 3, 4))
        point = np.where(size == 2, (b0 & 0x1F) << 6 | tails[0], np.where(
            size == 3, (b0 & 0xF) << 12 | tails[0] << 6 | tails[1], (b0 & 0x7) << 18 | tails[0] << 12 | tails[1] << 6 | tails[2]))
        kind = table[np.minimum(point, 0x10FFFF)]
        for k in range(4):
            here = at[(size > k) & (at + k < len(data))]
            out[here + k] = kind[(size > k) & (at + k < len(data))]
    return out


def word_starts(data: np.ndarray, rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """First bytes of the words of texts laid end to end; ``rows`` are the texts' first bytes. Words cover the texts without gaps.

    A run of letters, of numbers or of other characters is a word, together with one space before it. Of white space
    before such a run, the last character is left out of the word of the others. An apostrophe that
    starts a word takes its contraction's letters.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data, table)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[rows[rows < n]] = True
    new_text = np.zeros(n + 1, bool)
    new_text[rows] = True
    new_text[n] = edge[n] = True
    first = np.flatnonzero(edge)
    start = edge.copy()
    # white space before a run of the same text
    end = first[1:]
    white = np.flatnonzero((kind[first[:-1]] == _SPACE) & ~new_text[end])
    stop = end[white]
    last = stop - 1
    while True:  # back to the first byte of the last character
        inside = (data[last] & 0xC0) == 0x80
        if not inside.any():
            break
        last = last - inside
    start[last] = True
    start[stop[data[last] == 0x20]] = False
    # a lone apostrophe that starts a word, before letters
    lone = first[:-1][(end - first[:-1] == 1) & (data[first[:-1]] == 0x27)]
    lone = lone[start[lone] & ~new_text[lone + 1]]
    if len(lone):
        padded = np.r_[data, np.zeros(2, np.uint8)]
        one, two = padded[lone + 1], padded[lone + 2]
        same = np.zeros(len(lone), bool)
        same[lone + 2 < n] = kind[lone[lone + 2 < n] + 2] == _LETTER
        same &= ~edge[lone + 2 - (lone + 2 > n)]
        taken = np.zeros(len(lone), np.int64)
        for c in CONTRACTIONS:
            fits = one == ord(c[0])
            if len(c) == 2:
                fits &= (two == ord(c[1])) & same
            taken[fits] = len(c)
        lone, taken = lone[taken > 0], taken[taken > 0]
        start[lone + 1] = False
        start[lone + 1 + taken] = True
    return np.flatnonzero(start[:n])


def segments(data: np.ndarray, offsets: np.ndarray, most: int = SEGMENT) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row after the last, first byte, byte after the last): rows of about ``most`` bytes together, or a part of a longer row.

    A row is cut before white space that follows another ASCII character: no word spans such a place, nor does what precedes it matter to
    what follows.
    """
    white = np.zeros(256, bool)
    white[[9, 10, 11, 12, 13, 32]] = True
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        a, b = int(offsets[i]), int(offsets[j])
        while b - a > 2 * most:
            cut, at = None, a + most
            while cut is None and at < b:
                part = data[at - 1 : min(b, at + most)]
                found = np.flatnonzero(white[part[1:]] & ~white[part[:-1]] & (part[:-1] < 0x80))
                cut, at = (at + int(found[0]) if len(found) else None), at + most
            if cut is None:
                break
            yield i, j, a, cut
            a = cut
        yield i, j, a, b
        i = j


def distinct(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Place of one occurrence of each distinct word, number of each word's distinct word, and the keys of the distinct words."""
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, tuple(np.zeros(0, _U64) for _ in range(4))
    padded = np.r_[data, np.zeros(24, np.uint8)]
    eight = np.ndarray(len(padded) - 7, "<u8", padded.data, strides=(1,))
    low = eight[starts] & _MASKS[np.minimum(sizes, 8)]
    high = eight[starts + 8] & _MASKS[np.clip(sizes - 8, 0, 8)]
    size = sizes.astype(_U64)
    seen: dict[bytes, int] = {}
    for i in np.flatnonzero(sizes > SHORT).tolist():  # longer words by their whole bytes
        low[i] = seen.setdefault(data[starts[i] : starts[i] + sizes[i]].tobytes(), len(seen))
        high[i], size[i] = 0, SHORT + 1
    key = mix(low * _U64(0x9E3779B97F4A7C15) + mix(high + size * _U64(0xD1342543DE82EF95)))
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    differs = np.r_[True, np.any([c[order][1:] != c[order][:-1] for c in (low, high, size)], axis=0)]
    if (differs & ~new).any():  # different words of one key
        order = np.lexsort((size, high, low))
        new = np.r_[True, np.any([c[order][1:] != c[order][:-1] for c in (low, high, size)], axis=0)]
    number = np.empty(len(starts), np.int64)
    number[order] = np.cumsum(new) - 1
    at = order[new]
    return at, number, (key[at], low[at], high[at], size[at])


class Dictionary:
    """Short words and their ids as arrays: a few MB, and no object for a word."""

    def __init__(self, words: list[bytes], ids: list[list[int]]):
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        at, _, keys = distinct(data, np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(keys[0], kind="stable")
        self.keys = tuple(k[order] for k in keys)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        begin = np.cumsum(count) - count
        self.count, self.begin = count[at][order], begin[at][order]
        self.flat = np.array([x for one in ids for x in one], np.int32)

    def find(self, keys: tuple[np.ndarray, ...]) -> np.ndarray:
        """Places of the words with these keys, -1 where there is none."""
        if not len(self.count):
            return np.full(len(keys[0]), -1)
        at = np.minimum(np.searchsorted(self.keys[0], keys[0]), len(self.count) - 1)
        same = keys[3] <= _U64(SHORT)
        for mine, theirs in zip(self.keys, keys):
            same &= mine[at] == theirs
        return np.where(same, at, -1)


def _cut(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Of each segment: its rows, bytes, word starts, word sizes, one place of each distinct word, each word's number, and the keys."""
    for i, j, a, b in segments(data, offsets):
        part = data[a:b]
        starts = word_starts(part, np.clip(offsets[i:j] - a, 0, b - a), table)
        sizes = np.diff(np.r_[starts, b - a])
        yield i, j, a, part, starts, sizes, *distinct(part, starts, sizes)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (binary) and n: the distinct words of all texts and how often they occur."""
    packed = packed_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        table = unpacked_classes(packed)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for _, _, _, part, starts, sizes, places, number, _ in _cut(*text_buffer(batch.column(0)), table):
                times = np.bincount(number, minlength=len(places)).tolist()
                raw, lo, size = part.tobytes(), starts[places].tolist(), sizes[places].tolist()
                for k, at in enumerate(lo):
                    word = raw[at : at + size[k]]
                    counts[word] = counts.get(word, 0) + times[k]
                if len(counts) > COUNTED:
                    yield rows()
                    counts.clear()
        if counts:
            yield rows()

    found = docs.select(text_of(text_col).alias("text")).mapInArrow(run, "word binary, n long")
    return found.groupBy("word").agg(F.sum("n").cast("long").alias("n"))


# ---- merges

def rank_buckets(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The rank map as a literal: bucket -> {piece in hex: rank}."""
    pieces = sorted(ranks, key=ranks.get)
    told = spark.range(1).select(F.explode(F.split(F.lit(" ".join(p.hex() for p in pieces)), " ")).alias("piece"))
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, bucket in told.select("piece", _bucket(F.col("piece"))).collect():
        buckets[bucket][piece] = ranks[bytes.fromhex(piece)]
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _bucket(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")


def folded(word: Column, buckets: Column) -> Column:
    """Ids of a word (binary): one step for each byte after the first joins the leftmost pair of least rank, if any pair has one.

    The state holds the pieces (hex) and the ranks of neighbours; a join changes two ranks at most.
    """
    no_pieces, no_ranks = F.array().cast("array<string>"), F.array().cast("array<int>")
    size, text = F.octet_length(word), F.lower(F.hex(word))
    several = size > 1

    def with_table(table: Column) -> Column:
        def rank(piece: Column) -> Column:
            return F.coalesce(F.get(table, _bucket(piece))[piece], F.lit(_NONE))

        def begin(pieces: Column) -> Column:
            joined = F.transform(F.sequence(F.lit(0), size - 2), lambda i: rank(F.concat(F.get(pieces, i), F.get(pieces, i + 1))))
            return F.struct(pieces.alias("pieces"), F.when(several, joined).otherwise(no_ranks).alias("ranks"))

        def step(state: Column, _: Column) -> Column:
            pieces, ranks = state["pieces"], state["ranks"]
            least = F.array_min(ranks)
            found = F.struct(least.alias("rank"), F.array_position(ranks, least).cast("int").alias("at"))

            def join(pair: Column) -> Column:
                at, pairs = pair["at"], F.size(ranks)
                both = F.concat(F.get(pieces, at - 1), F.get(pieces, at))
                beside = F.concat(F.when(at > 1, F.array(F.concat(F.get(pieces, at - 2), both))).otherwise(no_pieces),
                                  F.when(at < pairs, F.array(F.concat(both, F.get(pieces, at + 1)))).otherwise(no_pieces))
                after = F.struct(
                    F.concat(F.slice(pieces, F.lit(1), at - 1), F.array(both), F.slice(pieces, at + 2, pairs)).alias("pieces"),
                    F.concat(F.slice(ranks, F.lit(1), F.greatest(at - 2, F.lit(0))), F.transform(beside, rank), F.slice(ranks, at + 2, pairs)).alias("ranks"))
                return F.when(pair["rank"] < _NONE, after).otherwise(state)

            return _let(found, join)

        start = F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(text, 2 * i + 1, F.lit(2)))).otherwise(no_pieces)
        steps = F.when(several, F.sequence(F.lit(2), size)).otherwise(no_ranks)
        return F.aggregate(steps, _let(start, begin), step, lambda state: F.transform(state["pieces"], rank))

    return _let(buckets, with_table)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by a heap over a linked list: least rank first, the leftmost of equal ones; linear but for a logarithm."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n, get = len(word), ranks.get
    end = list(range(1, n + 1))  # end of the piece that starts at a byte; 0 once it is part of another
    before = list(range(-1, n - 1))
    queue = []
    for i in range(n - 1):
        rank = get(word[i : i + 2])
        if rank is not None:
            queue.append((rank, i, i + 2))
    heapq.heapify(queue)
    while queue:
        _, i, j = heapq.heappop(queue)
        middle = end[i]
        if not middle or middle >= n or end[middle] != j:
            continue  # stale: one of the two has been joined since
        end[i], end[middle] = j, 0
        if j < n:
            before[j] = i
            rank = get(word[i : end[j]])
            if rank is not None:
                heapq.heappush(queue, (rank, i, end[j]))
        if before[i] >= 0:
            rank = get(word[before[i] : j])
            if rank is not None:
                heapq.heappush(queue, (rank, before[i], j))
    out, at = [], 0
    while at < n:
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


class Shared:
    """Ranks and dictionary, broadcast: both of bounded size. A worker unpacks what it needs once."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], words: Dictionary):
        self.key = uuid.uuid4().hex
        self.ranks = spark.sparkContext.broadcast(ranks)
        self.words = spark.sparkContext.broadcast(words)

    def of_encoder(self) -> dict:
        store = _worker_store(f"{self.key} words")
        if not store:
            store.update(ranks=self.ranks.value, words=self.words.value, newer={}, older={})
        return store

    def pieces(self) -> list[bytes]:
        store = _worker_store(f"{self.key} pieces")
        if not store:
            pieces = [b""] * (max(self.ranks.value.values(), default=-1) + 1)
            for piece, rank in self.ranks.value.items():
                pieces[rank] = piece
            store["pieces"] = pieces
        return store["pieces"]


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def load(docs: DataFrame, path: str, text_col: str = "text", words: int = DICTIONARY_WORDS) -> Shared:
    """Reads the rank file at ``path`` and folds the merges over the most frequent words of the texts (at most ``words``, ties to the
    smaller word). The dictionary only saves work: ids don't depend on it."""
    spark, ranks = docs.sparkSession, read_ranks(path)
    most = word_counts(docs, text_col).filter(F.octet_length("word") <= SHORT).orderBy(F.desc("n"), "word").limit(words)
    with small_arrow_batches(spark):
        most = staged(most.select("word"), "byte_bpe_words")
    # a single partition came out of the limit; the fold is the work
    spread = most.repartition(spark.sparkContext.defaultParallelism * 4, "word")
    known = spread.select("word", folded(F.col("word"), rank_buckets(spark, ranks)).alias("ids")).toArrow()
    return Shared(spark, ranks, Dictionary(known.column("word").to_pylist(), known.column("ids").to_pylist()))


# ---- texts

def _ids_of_words(tables: dict, words: list[bytes]) -> list[bytes]:
    """Ids (as bytes) of words outside the dictionary."""
    newer, older, ranks = tables["newer"], tables["older"], tables["ranks"]
    out = []
    for word in words:
        ids = newer.get(word)
        if ids is None:
            ids = older.get(word) or _packed(merged(word, ranks))
            if len(word) <= 4 * SHORT:
                newer[word] = ids
        out.append(ids)
    if len(newer) > REMEMBERED:
        tables["older"], tables["newer"] = newer, {}
    return out


def encode(docs: DataFrame, shared: Shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (array of int).

    Null texts count as empty and have no ids; repeated rows are encoded row by row; extra columns are ignored. An empty table gives an
    empty result. Texts and words of any length are encoded whole.
    """
    rows = docs.select(text_of(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    packed = packed_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, classes = shared.of_encoder(), unpacked_classes(packed)
        dictionary = tables["words"]
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            held: list[np.ndarray] = []  # ids of a row that is cut
            for i, j, a, part, starts, sizes, places, number, keys in _cut(data, offsets, classes):
                known = dictionary.find(keys)
                rest = np.flatnonzero(known < 0)
                raw = part.tobytes()
                lists = _ids_of_words(tables, [raw[x : x + n] for x, n in zip(starts[places[rest]].tolist(), sizes[places[rest]].tolist())])
                # the ids of the dictionary, then those of the other words
                flat = np.concatenate([dictionary.flat, np.frombuffer(b"".join(lists), np.int32)])
                count, begin = (x[known] if len(x) else np.zeros(len(known), np.int64) for x in (dictionary.count, dictionary.begin))
                count[rest] = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
                begin[rest] = len(dictionary.flat) + np.cumsum(count[rest]) - count[rest]
                width = count[number]
                upto = np.cumsum(width)
                ids = flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin[number] - upto + width, width)]
                if a + len(part) < offsets[j]:
                    held.append(ids)
                    continue
                first = np.searchsorted(starts, np.clip(offsets[i : j + 1] - a, 0, len(part)))
                bounds = np.r_[0, upto][first]
                if held:  # the row's parts and this last one
                    ids, held = np.concatenate([*held, ids]), []
                    bounds = np.array([0, len(ids)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(i, j - i), pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))],
                    ["doc_id", "n_tokens", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, shared: Shared) -> DataFrame:
    """Adds ``decoded`` (binary) to the rows of :func:`encode`: the pieces of the ids end to end. No ids give no bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.pieces().__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                ids = rows.column("ids")
                flat, bounds = ids.flatten().to_pylist(), np.r_[0, np.cumsum(ids.value_lengths().fill_null(0))].tolist()
                texts = [b"".join(map(pieces, flat[lo:hi])) for lo, hi in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.binary())], [*rows.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")
