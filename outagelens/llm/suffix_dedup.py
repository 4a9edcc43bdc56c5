"""Repeated byte strings across a corpus by bucket-pointer refinement over anchored suffixes.

A string of ``length`` bytes that occurs twice has the same least q-gram (by hash, leftmost of equal ones) at the same place
in both occurrences. So only suffixes at such anchors are bucketed: the windows of a text that share an anchor form a run, and
the initial bucket of a run is its anchor's q-gram. Windows of two runs can only be equal inside one bucket and at the same distance
from the anchor. Buckets are then refined like bucket pointers: a run is cut into cells of windows (64, 8, then 1 wide), and a cell's
new bucket is its parent's together with the identifiers of the strings at the offsets before and behind the anchor
that all its windows share. A cell alone in its bucket is settled (no repeat); cells whose whole extent agrees are settled
(all repeated); only the others are refined again, with the identifiers of the level before. At width 1 a bucket is one string.

Buckets are counted with map-side aggregates, never gathered: a passage in a third of all documents is one key. Of
cells that agree, one stays as a witness for the others in its bucket, so nothing is compared in pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_arrow_batches, small_batches, staged, text_of
from .shingles import _U64, mix, powers, text_buffer

LENGTH = 400
#: Bytes of an anchor's q-gram.
GRAM = 64
#: Widths of the cells of the refinement levels.
WIDTHS = (64, 8, 1)
#: Windows of a text that are handled at a time (their places must fit the low bits of the sort key).
SEGMENT = 1 << 19
_PLACE_BITS = 20

_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**64 - 1, 256, dtype=_U64, endpoint=True)
_BASE = 0xD1342543DE82EF95


class Identifiers:
    """Identifiers (64 bits) of any stretch of a byte string."""

    up = powers(_BASE, 1 << 13)
    down = powers(pow(_BASE, -1, 2**64), 1 << 13)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Identifiers.up) <= n:
            size = 1 << n.bit_length()
            Identifiers.up, Identifiers.down = powers(_BASE, size), powers(pow(_BASE, -1, 2**64), size)
        self.sums = np.zeros(n + 1, _U64)
        np.cumsum(_BYTE[data] * Identifiers.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Identifiers.down[start] + (end - start).astype(_U64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - 1
        return mix((self.sums[size:] - self.sums[: n - size + 1]) * Identifiers.down[: n - size + 1])


def sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    n = len(key) - width + 1
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width, np.iinfo(_U64).max, _U64)
    padded[: len(key)] = key
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, length: int, gram: int) -> list[tuple[np.ndarray, ...]]:
    """Runs of a text, found in segments: (first window, windows, anchor - first window, bucket, identifier of the whole extent).

    Windows of two segments that share an anchor are one run: each (anchor, window) occurs once in a text.
    """
    out = []
    for a in range(0, len(data) - length + 1, SEGMENT):
        part = data[a : min(len(data), a + SEGMENT + length - 1)]
        ids = Identifiers(part)
        grams = ids.grams(gram)
        key = (grams >> _U64(_PLACE_BITS) << _U64(_PLACE_BITS)) | np.arange(len(grams), dtype=_U64)
        anchor = (sliding_least(key, length - gram + 1) & _U64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        count = np.diff(np.r_[first, len(anchor)])
        at = anchor[first]
        out.append((first + a, count, at - first, grams[at].view(np.int64), ids.of(first, first + count - 1 + length).view(np.int64)))
    if len(out) < 2:
        return out
    first, count, d, bucket, whole = (np.concatenate(c) for c in zip(*out))
    fresh = np.r_[True, (first + d)[1:] != (first + d)[:-1]]
    at = np.flatnonzero(fresh)
    first, total, d, bucket, whole = first[at], np.add.reduceat(count, at), d[at], bucket[at], whole[at]
    for i in np.flatnonzero(total != count[at]):
        part = data[first[i] : first[i] + total[i] - 1 + length]
        whole[i] = Identifiers(part).of(np.array([0]), np.array([len(part)])).view(np.int64)[0]
    return [(first, total, d, bucket, whole)]


def removed_spans(n: int, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """Maximal covered stretches (start, end) from runs of repeated windows."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    lo, hi = starts[order], (starts + counts - 1 + length)[order]
    reach = np.maximum.accumulate(hi)
    fresh = np.r_[True, lo[1:] > reach[:-1]]
    at = np.flatnonzero(fresh)
    return np.stack([lo[at], reach[np.r_[at[1:] - 1, len(lo) - 1]]], 1)


def _kept_digest(data: bytes, spans: np.ndarray) -> str:
    digest, at = hashlib.sha256(), 0
    for lo, hi in spans.tolist():
        digest.update(data[at:lo])
        at = hi
    digest.update(data[at:])
    return digest.hexdigest()


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT = "n_bytes long, spans array<struct<start: bigint, `end`: bigint>>, kept_sha256 string"


def _span_list(spans: np.ndarray) -> list[dict]:
    return [{"start": a, "end": b} for a, b in spans.tolist()]


def _runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "p", "r", "d", "b", "u"]
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            keys = np.asarray(batch.column("key"))
            parts, size = [], 0
            for i in range(len(offsets) - 1):
                for x in runs_of(data[offsets[i] : offsets[i + 1]], length, gram):
                    parts.append((np.full(len(x[0]), keys[i], np.int64), *x))
                    size += len(x[0])
                if parts and (size > 50_000 or i == len(offsets) - 2):
                    cols = [np.concatenate(c) for c in zip(*parts)]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if k in (1, 2, 3) else c) for k, c in enumerate(cols)], names)
                    parts, size = [], 0

    return rows.select("key", "text").mapInArrow(run, "key long, p int, r int, d int, b long, u long")


def _place(rows: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """Settles the documents whose runs are all decided; the others carry their text and open runs."""
    per_doc = found.groupBy("key").agg(
        F.collect_list(F.when(F.col("accepted"), F.struct("p", "r"))).alias("accepted"),
        F.collect_list(F.when(F.col("open") | F.col("witness"), F.struct("p", "r", "d", "b", "witness"))).alias("todo"))
    # texts stream past the runs of their partition: they are not sorted
    joined = rows.alias("t").join(per_doc.hint("shuffle_hash").alias("f"), F.col("t.key") == F.col("f.key"), "left").select(
        "t.doc_id", "t.key", "t.text", "f.accepted", "f.todo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = {k: [] for k in ("n_bytes", "spans", "kept_sha256", "text", "accepted", "todo")}
            for text, accepted, todo in zip(*(batch.column(c).to_pylist() for c in ("text", "accepted", "todo"))):
                data = text.encode()
                runs = np.array([(x["p"], x["r"]) for x in accepted or []], np.int64).reshape(-1, 2)
                spans = removed_spans(len(data), runs[:, 0], runs[:, 1], length)
                is_open = any(not x["witness"] for x in todo or [])
                out["n_bytes"].append(len(data))
                out["spans"].append(_span_list(spans))
                out["kept_sha256"].append(None if is_open else _kept_digest(data, spans))
                out["text"].append(text if todo else None)
                out["todo"].append(todo or [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(out["n_bytes"], pa.int64()), pa.array(out["spans"], _SPAN),
                 pa.array(out["kept_sha256"], pa.string()), pa.array(out["text"], pa.string()), pa.array(out["todo"], batch.column("todo").type)],
                ["doc_id", "key", "n_bytes", "spans", "kept_sha256", "text", "todo"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    todo = joined.schema["todo"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, key long, {_RESULT}, text string, todo {todo}")


def _contexts(todo: DataFrame, length: int) -> DataFrame:
    """Each open or witnessing run with the bytes around its anchor that its widest cells reach."""
    wide = WIDTHS[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary())
        names = ["key", "p", "r", "d", "b", "witness", "lo", "bytes"]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        rows = []
        for batch in small_batches(batches, 64):
            for key, text, runs in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "todo"))):
                data = text.encode()
                for x in runs:
                    anchor = x["p"] + x["d"]
                    last = (x["d"] // wide + 1) * wide - 1
                    first = (x["d"] - x["r"] + 1) // wide * wide
                    lo, hi = max(0, anchor - last), min(len(data), anchor - first + length)
                    rows.append((key, x["p"], x["r"], x["d"], x["b"], x["witness"], lo - anchor, data[lo:hi]))
                    if len(rows) == 2000:
                        yield made(rows)
                        rows = []
        if rows:
            yield made(rows)

    return todo.select("key", "text", "todo").mapInArrow(run, "key long, p int, r int, d int, b long, witness boolean, lo int, bytes binary")


def _cells(contexts: DataFrame, width: int, length: int) -> DataFrame:
    """The cells of the contexts: (key, p, cell, b, witness, core, extent). ``parents`` lists the cells of the level above that are
    still open as (cell, witness), null at the first level."""
    above = WIDTHS[WIDTHS.index(width) - 1] if width != WIDTHS[0] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1000):
            out = [[] for _ in range(7)]
            for x in batch.to_pylist():
                low, high = x["d"] - x["r"] + 1, x["d"]  # distances of the run's windows from the anchor
                parents = x["parents"] or []
                if above is None:
                    cells = np.arange(low // width, high // width + 1)
                    witness = np.full(len(cells), x["witness"])
                else:
                    step = above // width
                    cells = np.concatenate([np.arange(y["cell"] * step, (y["cell"] + 1) * step) for y in parents])
                    witness = np.repeat([y["witness"] for y in parents], step)
                    inside = (cells * width <= high) & ((cells + 1) * width - 1 >= low)
                    cells, witness = cells[inside], witness[inside]
                data = np.frombuffer(x["bytes"], np.uint8)
                ids, n = Identifiers(data), len(data)
                near, far = cells * width, (cells + 1) * width - 1
                # places in the context; the extent ends with the text
                start, end = np.clip(-far - x["lo"], 0, n), np.clip(-near + length - x["lo"], 0, n)
                cut = ((start + far + x["lo"]) * 4096 + (end + near - length + x["lo"])).astype(_U64)
                core = ids.of(-near - x["lo"], -far + length - x["lo"])
                extent = mix(ids.of(start, end) ^ cut)
                for k, c in enumerate((np.full(len(cells), x["key"]), np.full(len(cells), x["p"]), cells, np.full(len(cells), x["b"]), witness,
                                       core.view(np.int64), extent.view(np.int64))):
                    out[k].append(c)
            kinds = (np.int64, np.int32, np.int32, np.int64, bool, np.int64, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, t), *c]).astype(t)) for c, t in zip(out, kinds)],
                                             ["key", "p", "cell", "b", "witness", "core", "extent"])

    return contexts.select("key", "p", "r", "d", "b", "witness", "lo", "bytes", "parents").mapInArrow(
        run, "key long, p int, cell int, b long, witness boolean, core long, extent long")


def _same(a: str, b: str, *names: str):
    return [F.col(f"{a}.{n}") == F.col(f"{b}.{n}") for n in names]


def _settle(members: DataFrame, bucket: list[str], full: list[str], live) -> DataFrame:
    """Adds to the members of buckets with two or more of them: accepted, open, and witness (for the next level).

    ``full`` names a kind inside its ``bucket``; members of one kind agree in their whole extent.
    """
    kinds = members.groupBy(*full).agg(F.count(F.lit(1)).alias("agree"), F.count_if(live).alias("live"), F.min(F.struct("key", "p")).alias("first"))
    buckets = kinds.groupBy(*bucket).agg(F.sum("agree").alias("held"), F.count(F.lit(1)).alias("kinds"), F.sum("live").alias("lives"))
    buckets = buckets.filter("held > 1 AND lives > 0")
    judged = kinds.alias("k").join(buckets.alias("b"), _same("k", "b", *bucket)).select(*(f"k.{c}" for c in full), "k.agree", "k.first", "b.kinds")
    out = members.alias("m").join(judged.alias("j"), _same("m", "j", *full))
    is_live = F.col("m.witness").eqNullSafe(F.lit(False)) if "witness" in members.columns else F.lit(True)
    mine = F.struct("m.key", "m.p") == F.col("j.first")
    several, agree = F.col("j.kinds") > 1, F.col("j.agree") > 1
    names = [f"m.{c}" for c in members.columns if c != "witness"]
    return out.select(*names, (agree & is_live).alias("accepted"), (~agree & several & is_live).alias("open"),
                      (several & ((agree & mine) | (~agree & ~is_live))).alias("witness"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (maximal stretches of bytes covered by a string of ``length`` bytes
    that also starts anywhere else), kept_sha256 (of the other bytes, joined).

    Null texts count as empty; texts shorter than ``length`` have no spans. Every row is a document of its own, repeated rows repeat each other.
    Extra columns are ignored.
    """
    if not WIDTHS[0] < gram + WIDTHS[0] <= length - WIDTHS[0]:
        raise ValueError("the string must be longer than its anchor and two cells")
    with small_arrow_batches(docs.sparkSession, 256):
        return _repeated_spans(docs, length, gram, id_col, text_col)


def _repeated_spans(docs: DataFrame, length: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    text = text_of(text_col)
    # rows that agree in id and text have the same spans and may share a key
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("key"))
    runs = staged(_runs(rows, length, gram), "runs")
    found = staged(_settle(runs, ["b"], ["b", "r", "d", "u"], F.lit(True)), "runs_settled")
    placed = staged(_place(rows, found, length), "placed")

    # rows that agree in id and text share a key: one of them stands for all (few rows, so the others move no text)
    todo = placed.filter("text IS NOT NULL")
    shared = staged(todo.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared_keys")
    if not shared.isEmpty():
        todo = todo.join(shared, "key", "left_anti").unionByName(todo.join(shared, "key", "left_semi").dropDuplicates(["key"]))
    contexts = staged(_contexts(todo, length), "contexts")
    live, covered = contexts.withColumn("parents", F.lit(None).cast("array<struct<cell: int, witness: boolean>>")), None
    for width in WIDTHS:
        cells = staged(_cells(live, width, length), f"cells_{width}")
        settled = staged(_settle(cells, ["b", "cell", "core"], ["b", "cell", "core", "extent"], ~F.col("witness")), f"settled_{width}")
        hit = settled.filter("accepted").select("key", "p", F.lit(width).alias("width"), "cell")
        covered = hit if covered is None else covered.union(hit)
        still = settled.filter("open OR witness").groupBy("key", "p").agg(F.collect_list(F.struct("cell", "witness")).alias("parents"))
        live = contexts.alias("x").join(still.alias("s"), _same("x", "s", "key", "p")).select("x.*", "s.parents")

    # windows of accepted cells, cut to their runs
    ranges = covered.alias("h").join(contexts.select("key", "p", "r", "d").alias("x"), _same("h", "x", "key", "p")).select(
        "h.key", (F.col("h.p") + F.greatest(F.lit(0), F.col("d") - ((F.col("cell") + 1) * F.col("width") - 1))).alias("p"),
        (F.col("h.p") + F.least(F.col("r") - 1, F.col("d") - F.col("cell") * F.col("width"))).alias("last"))
    ranges = ranges.select("key", "p", (F.col("last") - F.col("p") + 1).alias("r")).groupBy("key").agg(F.collect_list(F.struct("p", "r")).alias("more"))
    rest = placed.filter("kept_sha256 IS NULL").alias("t").join(ranges.hint("shuffle_hash").alias("f"), F.col("t.key") == F.col("f.key"), "left").select(
        "t.doc_id", "t.text", "t.spans", "f.more")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out = [[], [], []]
            for text, spans, more in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "more"))):
                data = text.encode()
                # a stretch of n bytes holds n - length + 1 windows
                pairs = [(x["start"], x["end"] - x["start"] - length + 1) for x in spans] + [(x["p"], x["r"]) for x in more or []]
                pairs = np.array(pairs, np.int64).reshape(-1, 2)
                merged = removed_spans(len(data), pairs[:, 0], pairs[:, 1], length)
                for c, v in zip(out, (len(data), _span_list(merged), _kept_digest(data, merged))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], _SPAN), pa.array(out[2], pa.string())],
                                             ["doc_id", "n_bytes", "spans", "kept_sha256"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    finished = staged(rest.mapInArrow(finish, f"doc_id {kind}, {_RESULT}"), "finished")
    return placed.filter("kept_sha256 IS NOT NULL").select("doc_id", "n_bytes", "spans", "kept_sha256").union(finished)


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and kept (binary): the texts without the stretches that :func:`repeated_spans` found; ids must be unique."""
    data = F.encode(text_of(text_col), "UTF-8")
    joined = docs.select(F.col(id_col).alias("doc_id"), data.alias("data")).join(spans.select("doc_id", "spans", "n_bytes"), "doc_id")
    # the stretches between the spans
    edges = F.concat(F.array(F.lit(0).cast("long")), F.flatten(F.transform("spans", lambda s: F.array(s["start"], s["end"]))), F.array("n_bytes"))
    pieces = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.substring(
        F.col("data"), (F.get(edges, 2 * i) + 1).cast("int"), (F.get(edges, 2 * i + 1) - F.get(edges, 2 * i)).cast("int")))
    return joined.select("doc_id", F.aggregate(pieces, F.encode(F.lit(""), "UTF-8"), lambda a, x: F.concat(a, x)).alias("kept"))
