"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, one pass, in Arrow batches. The trees are fitted with numpy on a bounded sample of labelled
rows, flattened into arrays and broadcast in the closure; scoring walks all trees of a batch at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Labelled rows that the fit uses at most (those with the smallest hash of their id).
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, RIDGE, LEAST_HESSIAN = 60, 4, 0.25, 32, 0.5, 0.5
PREDICT_AT = 0.3

#: Bytes counted together.
BYTE_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789",
    "symbol": b"#*$%&|<>=_~^{}[]\\/@+", "pipe": b"|", "bang": b"!?", "stop": b".", "comma": b",;:", "quote": b"\"'", "space": b" \t\r\n",
}
_CLASS = np.stack([np.isin(np.arange(256), np.frombuffer(v, np.uint8)) for v in BYTE_CLASSES.values()], 1).astype(np.float64)
FEATURES = [*BYTE_CLASSES, "high", "log_words", "word_bytes", "word_bytes_sd", "distinct", "top_word", "same_next", "caps_words", "line_words",
            "dup_lines", "repeat_trigrams", "capital_share"]


def statistics(text: str) -> list[float]:
    """The document statistics of one whole text, in the order of FEATURES (zeros for an empty text)."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not raw.size:
        return [0.0] * len(FEATURES)
    counts = np.bincount(raw, minlength=256)
    shares = counts @ _CLASS / raw.size
    words = text.split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    often = Counter(words)
    trigrams = Counter(zip(words, words[1:], words[2:]))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = counts[65:91].sum() + counts[97:123].sum()
    return [*shares, counts[128:].sum() / raw.size, np.log1p(len(words)), lengths.mean(), lengths.std(), len(often) / n,
            max(often.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n, sum(w.isupper() and len(w) > 1 for w in words) / n,
            len(words) / max(len(lines), 1), (len(lines) - len(set(lines))) / max(len(lines), 1),
            sum(c for c in trigrams.values() if c > 1) / n, counts[65:91].sum() / max(letters, 1)]


@dataclass
class Trees:
    """All trees flattened: inner node k of tree t goes to child 2k+1 where the feature is at most the threshold, else 2k+2."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; every tree of the batch is walked at once, level by level."""
        if not len(x):
            return np.zeros(0)
        n_trees, inner = self.feature.shape
        trees, rows = np.arange(n_trees)[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), n_trees), np.int64)
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        raw = self.start + self.leaf[trees, node - inner].sum(1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Boosts ``trees`` trees of logistic loss on binned features. Without rows of both labels the score is their share."""
    inner = 2**depth - 1
    share = (y.sum() + 0.5) / (len(y) + 1)
    out = Trees(float(np.log(share / (1 - share))), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    if not len(y) or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)  # bin b: at most edges[b]
    raw = np.full(len(y), out.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = (node - first) * bins
            best_gain, best = np.zeros(width), [(0, np.inf, bins)] * width
            for f, e in enumerate(edges):
                g = np.bincount(at + binned[:, f], grad, width * bins).reshape(width, bins).cumsum(1)
                h = np.bincount(at + binned[:, f], hess, width * bins).reshape(width, bins).cumsum(1)
                gl, hl, gr, hr = g[:, : len(e)], h[:, : len(e)], g[:, -1:] - g[:, : len(e)], h[:, -1:] - h[:, : len(e)]
                if not len(e):
                    continue
                gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - (g[:, -1:] ** 2) / (h[:, -1:] + RIDGE)
                gain = np.where((hl >= LEAST_HESSIAN) & (hr >= LEAST_HESSIAN), gain, 0)
                cut = gain.argmax(1)
                for k in np.flatnonzero(gain[np.arange(width), cut] > best_gain + 1e-9):
                    best_gain[k], best[k] = gain[k, cut[k]], (f, e[cut[k]], cut[k])
            for k, (f, limit, _) in enumerate(best):
                out.feature[t, first + k], out.threshold[t, first + k] = f, limit
            chosen = np.array([b[0] for b in best])[node - first]
            upto = np.array([b[2] for b in best])[node - first]
            node = 2 * node + 1 + (binned[np.arange(len(y)), chosen] > upto)
        g = np.bincount(node - inner, grad, inner + 1)
        h = np.bincount(node - inner, hess, inner + 1)
        out.leaf[t] = rate * g / (h + RIDGE)
        raw += out.leaf[t][node - inner]
    return out


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most ``rows`` labelled documents, none of them held out; rows without a label or id are left out."""
    lab = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    lab = lab.filter(F.col("__id").isNotNull() & F.col("__y").isNotNull() & ~held_out(F.col("__id"))).dropDuplicates(["__id"])
    chosen = lab.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    # at most ``rows`` ids are broadcast
    texts = docs.select(F.col(id_col).alias("__doc"), text_of(text_col).alias("__text"))
    texts = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).select("__id", "__text", "__y")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(stats, pa.list_(pa.float64())), batch.column("__y")], ["id", "stats", "y"])

    got = texts.mapInArrow(measure, f"id {texts.schema['__id'].dataType.simpleString()}, stats array<double>, y int").collect()
    got = sorted(got, key=lambda r: (r["id"], r["stats"]))[:rows]  # repeated ids bring more rows
    x = np.array([r["stats"] for r in got], np.float64).reshape(len(got), len(FEATURES))
    return fit(x, np.array([r["y"] for r in got], np.float64))


def _scores(texts: pa.Array, model: Trees) -> np.ndarray:
    parts = [np.zeros(0)]
    for at in range(0, len(texts), 1024):
        stats = [statistics(t or "") for t in texts.slice(at, 1024).to_pylist()]
        parts.append(model.score(np.array(stats, np.float64)))
    return np.concatenate(parts)


def score(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row, from its whole text alone; null texts count as empty."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch.column("text"), model))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text", at: float = PREDICT_AT) -> DataFrame:
    """The rows of ``docs`` (all its columns) whose score is at least ``at``; one pass, no shuffle."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(place), model) >= at))

    return docs.mapInArrow(run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted. The score uses the text alone.

    Null and empty texts are scored as texts without words; without labels every score is 0.5. Repeated rows are scored row by row.
    """
    scored = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
