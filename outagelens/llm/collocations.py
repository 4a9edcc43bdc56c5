"""Phrases of two to four words that occur together more than apart, from count streams in prefix and suffix order.

1. Counting. Words are counted over all texts, then phrases of two, three and four words. A phrase that occurs ``least`` times consists of
   phrases that do, so an occurrence is only counted if both phrases of one word less in it are marked in a bitmap of fixed size; marks
   of other phrases with the same place only cost work. Tasks add up their phrases before the shuffle. The phrases that
   reach ``least`` are the count streams of the orders 1 to 4.
2. Streams. All orders together are put in prefix order (by the first word, then the second, ...) and in suffix order (by the last word
   first), dealt by ranges, so that a common first word spreads over many tasks. A task runs through its range once, in lockstep over the
   orders: the open entries are the beginnings of the current phrase, whose counts are at hand without a hash table, and an entry is left
   with the largest count among the phrases that extend it by a word. A range starts with the beginnings that were opened
   in the ranges before it.
3. The two passes are merged in prefix order. A phrase's beginnings and ends give the counts of its cuts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_arrow_batches, staged, text_of
from .shingles import mix, powers, text_buffer

#: A candidate's least count, words of the longest one, and percent of its count that a longer one must have to take its place.
LEAST, LONGEST, TAKEN_OVER = 30, 4, 80
#: Rows returned for each language.
TOP = 2000
NO_LANG = "und"
#: Bits of the bitmap of an order's frequent phrases (16 MB, whatever the corpus), and of one of its pieces.
BITS, PIECE = 1 << 27, 1 << 15
#: Bytes of text whose arrays are held at a time, and phrases that a task counts before it hands them on.
SEGMENT, COUNTED = 1 << 19, 100_000

_U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(13))
_VALUE = _RNG.integers(1, 2**64 - 1, 256, dtype=_U64, endpoint=True)
_PLACES = _RNG.integers(1, 2**64 - 1, LONGEST, dtype=_U64, endpoint=True) | _U64(1)
_BASE = 0xA0761D6478BD642F
#: A-Z as a-z, what ends a piece as a line feed, tab as space.
_SPACE, _END = 0x20, 0x0A
_READ = np.arange(256, dtype=np.uint8)
_READ[65:91] += 32
_READ[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _END
_READ[9] = _SPACE


# ---- 1. counting

def segments(read: np.ndarray, offsets: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(first row, row after the last, first byte, byte after the last, byte before which phrases start).

    Rows of about ``most`` bytes together; a longer row in parts that reach ``LONGEST - 1`` words into the next.
    """
    most = most or SEGMENT
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        a, b = int(offsets[i]), int(offsets[j])
        while b - a > 2 * most:
            cut = _after_words(read, a + most, b, 1)
            stop = _after_words(read, cut, b, LONGEST)
            if stop >= b:
                break
            yield i, j, a, stop, cut
            a = cut
        yield i, j, a, b, b
        i = j


def _after_words(read: np.ndarray, a: int, b: int, words: int) -> int:
    """A place at white space, with the ends of ``words`` words between it and ``a``; b if there is none."""
    size = 1 << 12
    while True:
        part = read[a : min(b, a + size)]
        white = (part == _SPACE) | (part == _END)
        ends = np.flatnonzero(white[1:] & ~white[:-1]) + 1
        if len(ends) >= words:
            return a + int(ends[words - 1])
        if a + size >= b:
            return b
        size *= 4


class Words:
    """The words of texts laid end to end: first and last bytes, row, hash, and whether a word continues the piece of the one before."""

    up = powers(_BASE, 1 << 12)
    down = powers(pow(_BASE, -1, 2**64), 1 << 12)

    def __init__(self, read: np.ndarray, rows: np.ndarray, seeds: np.ndarray):
        n = len(read)
        self.raw = read.tobytes()
        white = np.ones(n + 2, bool)  # white space or an end before and behind
        white[1:-1] = (read == _SPACE) | (read == _END)
        fresh = np.zeros(n + 1, bool)
        fresh[rows] = True
        self.first = np.flatnonzero(~white[1:-1] & (white[:-2] | fresh[:-1]))
        self.end = np.flatnonzero(~white[1:-1] & (white[2:] | fresh[1:])) + 1
        self.row = np.searchsorted(rows, self.first, side="right") - 1
        ends = np.zeros(n + 1, np.int64)
        np.cumsum(read == _END, out=ends[1:])
        self.joined = np.zeros(len(self.first), bool)
        self.joined[1:] = (ends[self.first[1:]] == ends[self.end[:-1]]) & (self.row[1:] == self.row[:-1])
        if len(Words.up) < n + 1:
            size = 1 << n.bit_length()
            Words.up, Words.down = powers(_BASE, size), powers(pow(_BASE, -1, 2**64), size)
        sums = np.zeros(n + 1, _U64)
        np.cumsum(_VALUE[read] * Words.up[:n], out=sums[1:])
        own = (sums[self.end] - sums[self.first]) * Words.down[self.first] + (self.end - self.first).astype(_U64)
        self.hash = mix(own ^ seeds[self.row])

    def phrase_hashes(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each word that k - 1 words of its piece follow: its number, and the hash of the phrase."""
        n = max(0, len(self.first) - k + 1)
        whole, total = np.ones(n, bool), np.zeros(n, _U64)
        for j in range(k):
            total += self.hash[j : j + n] * _PLACES[j]
            if j:
                whole &= self.joined[j : j + n]
        at = np.flatnonzero(whole)
        return at, mix(total[at])

    def phrases(self, at: np.ndarray, k: int) -> list[bytes]:
        """The phrases of k words that start at the given words, with single spaces."""
        if k == 1:
            return [self.raw[a:b] for a, b in zip(self.first[at].tolist(), self.end[at].tolist())]
        lo, hi = self.first[at], self.end[at + k - 1]
        out = [self.raw[a:b] for a, b in zip(lo.tolist(), hi.tolist())]
        letters = sum((self.end[at + j] - self.first[at + j]) for j in range(k))
        for x in np.flatnonzero(hi - lo != letters + k - 1).tolist():  # wider gaps
            out[x] = b" ".join(out[x].split())
        return out


def lang_seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & _U64(BITS - 1)
    return (bits[(place >> _U64(3)).astype(np.int64)] >> (place & _U64(7)).astype(np.uint8)) & 1 == 1


def phrase_counts(texts: DataFrame, k: int, shared=None) -> DataFrame:
    """lang, phrase, f of the phrases of k words of ``texts`` (lang, text). ``shared``: the bitmap of the order below (broadcast)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def rows():
            out = [pa.array([lang for lang, c in counts.items() for _ in range(len(c))], pa.string()),
                   pa.array([x for c in counts.values() for x in c], pa.binary()).cast(pa.string()),
                   pa.array([n for c in counts.values() for n in c.values()], pa.int64())]
            counts.clear()
            return pa.RecordBatch.from_arrays(out, ["lang", "phrase", "f"])

        bits = None if shared is None else np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            langs = batch.column(0).to_pylist()
            seeds = np.array([lang_seed(x) for x in langs], _U64)
            for i, j, a, b, cut in segments(_READ[data], offsets):
                read = _READ[data[a:b]]
                words = Words(read, np.clip(offsets[i:j] - a, 0, b - a), seeds[i:j])
                if k == 1:
                    at = np.arange(len(words.first))
                else:
                    at, hashes = words.phrase_hashes(k - 1)
                    at = at[_marked(bits, hashes)]
                    at = at[:-1][at[1:] == at[:-1] + 1] if len(at) else at  # both phrases of one word less
                    at = at[words.joined[at + 1]] if k == 2 else at
                at = at[words.first[at] < cut - a]
                # by row, so by language
                bounds = np.searchsorted(words.row[at], np.arange(j - i + 1))
                found = words.phrases(at, k)
                for r in np.flatnonzero(np.diff(bounds)).tolist():
                    counts.setdefault(langs[i + r], Counter()).update(found[bounds[r] : bounds[r + 1]])
                if sum(map(len, counts.values())) > COUNTED:
                    yield rows()
        if counts:
            yield rows()

    found = texts.mapInArrow(run, "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").cast("long").alias("f"))


def bitmap(phrases: DataFrame, k: int) -> bytes:
    """Marks the places of the phrases' hashes; only pieces of the bitmap reach the driver."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            rows = offsets - offsets[0]
            seeds = np.array([lang_seed(x) for x in batch.column(0).to_pylist()], _U64)
            words = Words(data[offsets[0] : offsets[-1]], rows[:-1], seeds)
            place = np.unique(words.phrase_hashes(k)[1] & _U64(BITS - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place // PIECE), pa.array(place % PIECE)], ["piece", "place"])

    def piece(key, table):
        bits = np.zeros(PIECE, np.uint8)
        bits[table.column("place").to_numpy()] = 1
        return pa.table({"piece": [key[0].as_py()], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    marked = phrases.select("lang", "phrase").mapInArrow(places, "piece long, place long").distinct()
    out = bytearray(BITS // 8)
    for row in marked.groupBy("piece").applyInArrow(piece, "piece long, bits binary").collect():
        out[row["piece"] * PIECE // 8 : (row["piece"] + 1) * PIECE // 8] = row["bits"]
    return bytes(out)


def count_streams(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f, k) of all phrases of up to ``LONGEST`` words that occur ``least`` times, and (lang, n): all words of a language."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), text_of(text_col).alias("text"))
    with small_arrow_batches(spark):
        words = staged(phrase_counts(texts, 1), "colloc_words")
        totals = words.groupBy("lang").agg(F.sum("f").cast("long").alias("n"))
        order = words.filter(F.col("f") >= least)
        streams = order.withColumn("k", F.lit(1))
        for k in range(2, LONGEST + 1):
            shared = spark.sparkContext.broadcast(bitmap(order, k - 1))
            order = staged(phrase_counts(texts, k, shared).filter(F.col("f") >= least), f"colloc_{k}")
            streams = streams.union(order.withColumn("k", F.lit(k)))
    return streams, totals


# ---- 2. streams

_KEYS = ["lang", *(f"w{i}" for i in range(LONGEST))]


def lockstep(streams: DataFrame, backwards: bool) -> DataFrame:
    """lang, phrase, k, f, sides, most of all phrases: in prefix order the counts of its beginnings of 1 .. k-1 words and the largest count
    of a phrase with one more word behind; ``backwards``, in suffix order: of its ends, and of a phrase with one more word before."""
    name = "colloc_suffix" if backwards else "colloc_prefix"
    words = F.split("phrase", " ")
    words = F.reverse(words) if backwards else words
    keyed = streams.select("lang", *(F.coalesce(F.get(words, F.lit(i)), F.lit("")).alias(f"w{i}") for i in range(LONGEST)), "f")
    dealt = staged(keyed.repartitionByRange(*_KEYS).withColumn("part", F.spark_partition_id()), name)

    # what is open where a range begins: beginnings of its first phrase; three rows of each range at most
    firsts = dealt.groupBy("part").agg(F.min(F.struct(*_KEYS)).alias("key"))
    opened = [firsts.filter(F.col(f"key.w{m}") != "").select(F.col("part").alias("at"), "key.lang", *(
        (F.col(f"key.w{i}") if i < m else F.lit("")).alias(f"w{i}") for i in range(LONGEST))) for m in range(1, LONGEST)]
    opened = opened[0].union(opened[1]).union(opened[2]).join(dealt, _KEYS)
    starts: dict[int, list] = {}
    for row in opened.select("at", *_KEYS, "f").collect():
        starts.setdefault(row["at"], []).append((row["lang"], tuple(w for w in row[2 : 2 + LONGEST] if w), row["f"]))
    shared = streams.sparkSession.sparkContext.broadcast({p: sorted(x) for p, x in starts.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, part, out = [], None, []  # entries: lang, words, count, counts of beginnings (None if opened before), largest extension

        def leave(entry):
            lang, phrase, f, sides, most = entry
            if sides is not None or most:
                out.append((lang, " ".join(reversed(phrase) if backwards else phrase), len(phrase), f, sides, most))

        def rows():
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["lang", "phrase", "k", "f", "sides", "most"])
            out.clear()
            return made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                phrase = tuple(w for w in row[2:-1] if w)
                if row[0] != part:
                    while open_:
                        leave(open_.pop())
                    part = row[0]
                    open_ = [[*x, None, 0] for x in shared.value.get(part, ())]
                while open_ and (open_[-1][0] != row[1] or open_[-1][1] != phrase[: len(open_[-1][1])]):
                    leave(open_.pop())
                if open_:
                    open_[-1][4] = max(open_[-1][4], row[-1])
                open_.append([row[1], phrase, row[-1], [x[2] for x in open_], 0])
            if len(out) > 10_000:
                yield rows()
        while open_:
            leave(open_.pop())
        if out:
            yield rows()

    in_order = dealt.repartition("part").sortWithinPartitions("part", *_KEYS).select("part", *_KEYS, "f")
    passed = in_order.mapInArrow(run, "lang string, phrase string, k int, f long, sides array<long>, most long")
    # an entry that stayed open into later ranges has a row of each
    return passed.groupBy("lang", "phrase").agg(F.max("k").alias("k"), F.max("f").alias("f"), F.max("sides").alias("sides"), F.max("most").alias("most"))


# ---- 3. phrases

def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, taken_over: int = TAKEN_OVER, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's first ``top`` phrases by score and a descending, then phrase.

    a counts the phrase; of its cuts the one with the lowest score counts (ties: the shortest first part), l and r count the two parts there,
    score = floor(2000000 a / (l + r)). Phrases inside a longer one with ``taken_over`` percent of their count or more are left out: since
    a phrase occurs wherever a longer one does, it is enough to look at those with one word more. n counts all words of the language. Null
    texts are empty, a null language is ``und``; repeated rows count each time; extra columns are ignored. An empty table gives an empty result.
    """
    streams, totals = count_streams(docs, least, text_col, lang_col)
    before = lockstep(streams, backwards=False).filter("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.col("sides").alias("left"), "most")
    behind = lockstep(streams, backwards=True).filter("k > 1").select("lang", "phrase", F.col("sides").alias("right"), F.col("most").alias("other"))
    both = before.hint("merge").join(behind, ["lang", "phrase"])
    whole = both.filter(F.greatest("most", "other") * 100 < F.col("a") * taken_over)

    cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(
        i.alias("i"), F.get("left", i - 1).alias("l"), F.get("right", F.col("k") - i - 1).alias("r")))
    scored = whole.select("lang", "phrase", "a", F.inline(cuts))
    scored = scored.withColumn("score", F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "i", "l", "r", "a")).alias("x")).select("lang", "phrase", "x.*").drop("i")

    # the first of each share, then the first of all: no task sorts a whole language
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = best.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    share = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    first = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
