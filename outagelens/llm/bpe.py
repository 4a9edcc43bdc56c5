"""BPE encoding and decoding with a priority queue of merge ranks over a doubly linked symbol list.

The vocabulary is a tokenizer file (path as a parameter) read once on the driver and broadcast: its size is fixed, whatever the
corpus. Texts are encoded whole, row by row, in Arrow batches; there is no shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import types
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

#: Words remembered by a worker in each of two generations (results don't depend on it).
REMEMBERED_WORDS = 150_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: visible Latin-1 for itself, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in visible}
    hidden = [b for b in range(256) if b not in letters]
    return letters | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


#: The letters and numbers that came with Unicode 16.0, one version after Python's tables.
UNICODE_16 = ("1C89-1C8A,A7CB-A7CE,A7D2,A7D4,A7DA-A7DC,105C0-105F3,10D40-10D65,10D6F-10D85,10EC2-10EC4,11380-11389,1138B,1138E,11390-113B5,"
              "113B7,113D1,113D3,116D0-116E3,11BC0-11BE0,11BF0-11BF9,13460-143FA,16100-1611D,16130-16139,16D40-16D6C,16D70-16D79,16EA0-16EB8,"
              "18CFF,1CCF0-1CCF9,1E5D0-1E5ED,1E5F0-1E5FA")


def recent_letters() -> str:
    """Ranges, for a character class, of the letters and numbers that ``regex`` knows and Unicode 16.0 doesn't.

    The tokenizers library's tables are of that version; to it these code points are neither.
    """
    known = {c for run in UNICODE_16.split(",") for c in range(int(run.split("-")[0], 16), int(run.split("-")[-1], 16) + 1)}
    found = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))
    fresh = [ord(c) for c in found if unicodedata.category(c) == "Cn" and ord(c) not in known]
    runs: list[list[int]] = []
    for c in fresh:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{chr(x)}-{chr(y)}" for x, y in runs)


class Bpe:
    """Merge ranks and vocabulary of one tokenizer file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        #: Pair of neighbours as one integer -> rank; the symbol that each rank makes.
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 20 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.final = [vocab[letters[b] + suffix] for b in range(256)]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {text: array("I", [i]).tobytes() for text, i in special.items()}
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in special.items()}
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split).findall
        fresh = recent_letters()
        self.has_recent = regex.compile(f"[{fresh}]").search if fresh else lambda text: None
        older = split.replace(r"\p{L}", rf"[\p{{L}}--[{fresh}]]").replace(r"\p{N}", rf"[\p{{N}}--[{fresh}]]") if fresh else split
        self.words_with_recent = regex.compile(older, regex.V1).findall
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token: the neighbours of least rank are joined first, the leftmost of equal rank first."""
        raw = word.encode()
        if not raw:
            return []
        inner, rank_of = self.inner, self.rank.get
        ids = [inner[b] for b in raw]
        n = len(ids)
        ids[-1] = self.final[raw[-1]]
        queue = []  # rank and place of the left symbol as one integer
        for i in range(n - 1):
            rank = rank_of(ids[i] << 20 | ids[i + 1])
            if rank is not None:
                queue.append(rank << 32 | i)
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            item = heapq.heappop(queue)
            rank, i = item >> 32, item & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or rank_of(ids[i] << 20 | ids[j]) != rank:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = self.made[rank], -1
            right, left = after[j], before[i]
            after[i] = right
            if right < n:
                before[right] = i
                rank = rank_of(ids[i] << 20 | ids[right])
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | i)
            if left >= 0:
                rank = rank_of(ids[left] << 20 | ids[i])
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | left)
        return [x for x in ids if x >= 0]

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a stretch without special tokens."""
        if text.isascii():
            return self.words(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # each letter is lowered alone, final sigma too
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.has_recent(text):
                return self.words_with_recent(text)
        return self.words(text)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        known, out = self.known, []
        for k, part in enumerate(self.at_special(text) if self.at_special else [text]):
            if k % 2:
                out.append(self.special[part])
                continue
            words = self.split(part)
            for w in set(words).difference(known):
                known[w] = self.older.get(w) or array("I", self.merge(w)).tobytes()
            out.append(b"".join(map(known.__getitem__, words)))
        if len(known) > REMEMBERED_WORDS:
            self.older, self.known = known, {}
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, joined by a space as a tokenizer without a decoder does."""
        return " ".join(map(self.strings.__getitem__, array("I", ids).tolist()))


def _tables(shared) -> Bpe:
    """The tables of a tokenizer file, made once for each Python worker: tasks of one worker share the remembered words."""
    store = sys.modules.setdefault("_bpe_tables", types.ModuleType("_bpe_tables")).__dict__
    key = hashlib.sha256(shared.value).hexdigest()
    if key not in store:
        store[key] = Bpe(json.loads(shared.value))
    return store[key]


def load(df: DataFrame, path: str):
    """Broadcast the tokenizer file at ``path`` (fixed size, a few MB)."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, the columns to carry, n_tokens, ids (little-endian unsigned 32-bit integers).

    Null texts count as empty and have no ids. Repeated rows are encoded row by row; extra columns are ignored.
    """
    carry = carry or []
    rows = docs.select(text_of(text_col).alias("text"), F.col(id_col).alias("doc_id"), *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tables(shared)
        for batch in small_batches(batches):
            ids = [bpe.encode(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                                             [*batch.schema.names[1:], "n_tokens", "ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{fields}, n_tokens long, ids binary")


def decode(encoded: DataFrame, shared) -> DataFrame:
    """Adds ``decoded`` (string) to the rows of :func:`encode`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tables(shared)
        for batch in small_batches(batches):
            texts = [bpe.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded string")
