"""Suffix dedup and the n-gram Jaccard join against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from outagelens.llm import components, jaccard_join, shingles, suffix_dedup

from .brute import near_components, repeats
from .brute import shingles as plain_shingles
from .conftest import odd_rows, prose


def digest(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"])
                  for r in df.collect())


def want(rows, length):
    return sorted((i is None, i or 0, *x) for (i, *_), x in zip(rows, repeats([r[1] for r in rows], length)))


def passages():
    rng = random.Random(5)
    shared = [prose(100 + k, 130) for k in range(4)]
    rows = []
    for i in range(60):
        parts = [prose(1000 + i, rng.randrange(5, 90))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            cut = rng.randrange(0, 60)
            parts += [s[cut:] if rng.random() < 0.5 else s[: len(s) - cut], prose(rng.randrange(10**6), rng.randrange(0, 40))]
        rows.append((i, " ".join(parts), "en", "a"))
    near = list(rows[3][1] * 3)
    near[len(near) // 2] = "é"
    rows += [(60, "".join(near), "en", "a"), (61, rows[3][1] * 3, "en", "a"), (62, "ab" * 700, "en", "a"), (63, "junk " * 300, "en", "b"),
             (64, "x" * 399, "en", "b"), (65, "x" * 399, "en", "b"), (66, "y" * 400, "en", "b"), (67, "y" * 400, "en", "b"), (68, "z" * 401, "en", "b")]
    return rows


def test_repeated_strings(frame):
    rows = passages()
    assert digest(suffix_dedup.repeated_spans(frame(rows))) == want(rows, 400)


def test_repeated_strings_on_odd_rows(odd, empty):
    assert digest(suffix_dedup.repeated_spans(odd)) == want(odd_rows(), 400)
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_other_lengths_and_removal(frame):
    rows = passages()[:30]
    docs = frame(rows)
    spans = suffix_dedup.repeated_spans(docs, length=200, gram=40)
    assert digest(spans) == want(rows, 200)
    kept = {r["doc_id"]: hashlib.sha256(bytes(r["kept"])).hexdigest() for r in suffix_dedup.remove_spans(docs, spans).collect()}
    assert kept == {r["doc_id"]: r["kept_sha256"] for r in spans.collect()}
    with pytest.raises(ValueError):
        suffix_dedup.repeated_spans(docs, length=100)


def test_long_text_in_segments(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    data = np.frombuffer(prose(3, 900).encode(), np.uint8)
    runs = suffix_dedup.runs_of(data, 400, 64)
    places = np.concatenate([np.concatenate([np.arange(p, p + r) for p, r in zip(x[0], x[1])]) for x in runs])
    assert places.tolist() == list(range(len(data) - 399))


def test_runs_do_not_depend_on_segments(monkeypatch):
    data = np.frombuffer(prose(3, 900).encode(), np.uint8)
    (whole,) = suffix_dedup.runs_of(data, 400, 64)
    for segment in (700, 701, 350, 100):
        monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
        parts = [np.concatenate(c) for c in zip(*suffix_dedup.runs_of(data, 400, 64))]
        assert all(a.tolist() == b.tolist() for a, b in zip(parts, whole))


def test_text_longer_than_two_segments(frame):
    edge = suffix_dedup.SEGMENT
    unique = " ".join(f"{i:x}" for i in range(10**6, 10**6 + edge // 3))  # no string of 400 bytes occurs twice
    assert len(unique) > 2 * edge + 1000
    again = unique[: edge + 300] + " " + unique[edge - 300 : edge + 300]  # a true repeat over the first boundary
    rows = [(1, unique, "en", "a")]
    assert digest(suffix_dedup.repeated_spans(frame(rows))) == want(rows, 400)
    assert want(rows, 400)[0][3:5] == (0, 0)
    rows = [(1, again, "en", "a")]
    assert digest(suffix_dedup.repeated_spans(frame(rows))) == want(rows, 400)
    assert want(rows, 400)[0][3:5] == (1200, 2)


def test_sliding_least():
    x = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    for width in (1, 7, 337, 500):
        assert suffix_dedup.sliding_least(x, width).tolist() == [int(x[i:i + width].min()) for i in range(500 - width + 1)]


def test_shingle_sets_as_sets_of_words():
    import pyarrow as pa

    texts = [x for _, x, _, _ in odd_rows()] + ["a b c d e", "A  b\tc\nd e", "a b c d", "a b c d e a b c d e", "É b c d e", "é b c d e"]
    got = [t for _, t in shingles.shingle_sets(pa.array(texts, pa.string()))]
    plain = [plain_shingles(t) for t in texts]
    assert [len(t) for t in got] == [len(p) for p in plain]
    for a in range(len(texts)):
        for b in range(a):
            assert len(np.intersect1d(got[a], got[b])) == len(plain[a] & plain[b])


def test_short_texts_alone_in_a_chunk():
    import pyarrow as pa

    def tokens(texts):
        return [t.tolist() for _, t in shingles.shingle_sets(pa.array(texts, pa.string()))]

    short = [" ".join("abcde"[:n]) for n in range(6)]
    together = tokens([*short, prose(9, 50)])[:6]  # one chunk holds them all
    assert [len(t) for t in together] == [0, 1, 1, 1, 1, 1]
    assert [tokens([x])[0] for x in short] == together
    long = prose(8, 300_000)
    assert len(long) > shingles.CHUNK_BYTES
    for x, t in zip(short, together):
        assert tokens([long, x, long])[1] == t


def near_rows():
    """A large group of near copies with different texts, a chain, documents that share a passage only, and edges of the threshold."""
    rng = random.Random(2)
    base = prose(50, 300, 5000).split()
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    link = prose(51, 100, 5000).split()
    for i in range(30):  # each is near the next, the ends are far apart
        rows.append((100 + i, " ".join(link[i * 2:] + [f"c{j}" for j in range(i * 2)])))
    passage = prose(52, 60, 5000)
    rows += [(200 + i, prose(600 + i, 120, 5000) + " " + passage) for i in range(60)]
    for n in (5, 9, 10, 20, 45):  # at and around the threshold
        w = [f"t{n}_{j}" for j in range(n + 4)]
        rows += [(300 + n, " ".join(w)), (400 + n, " ".join(w[: -max(1, n // 5)])), (500 + n, " ".join([*w[:-1], "other"]))]
    return rows


@pytest.mark.parametrize("leaf", [256, 8])
def test_near_duplicates(frame, leaf):
    rows = near_rows()
    out = jaccard_join.near_duplicates(frame([(*r, "en", "a") for r in rows]), leaf=leaf)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()]
    assert sorted(got) == sorted(near_components(rows))


def test_guests_meet_what_representatives_miss(spark):
    """Links between others than the representatives are found across leaves, between sizes too."""
    sets, n = [], 0
    for c in range(12):  # chains whose ends meet the next chain's
        for k in range(5):
            sets.append((n, np.arange(c * 80 + k * 16, c * 80 + k * 16 + 160 + 4 * k).astype(np.uint64)))
            n += 1
    rows = [(0, i, len(s), np.sort(shingles.mix(s)).tobytes()) for i, s in sets]
    df = spark.createDataFrame([(b, i, m, bytearray(t)) for b, i, m, t in rows], "block long, sid long, n long, tokens binary")
    links = jaccard_join.block_links(df.withColumn("members", F.lit(len(sets)).cast("long")), 80, leaf=4)
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    parent = {i: i for i, _ in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in sets:
        for j, b in sets[:i]:
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert {i: got.get(i, i) for i, _ in sets} == {i: find(i) for i, _ in sets}


def test_near_on_odd_rows(odd, empty):
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(odd).collect()]
    assert sorted(got, key=str) == sorted(((i is None, i or 0, n, c) for i, n, c in near_components([r[:2] for r in odd_rows()])), key=str)
    assert jaccard_join.near_duplicates(empty).count() == 0
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 3, 4, 5, 6, 7, None, 10, 11, 12}


def test_near_with_null_and_repeated_ids(frame):
    words = prose(70, 100, 5000).split()
    far, mid, near = (" ".join([f"c{j}" for j in range(k)] + words[k:]) for k in (0, 6, 12))  # far and near only link through mid
    alone, other = prose(71, 60, 5000), prose(72, 60, 5000)
    rows = [(1, far), (None, mid), (3, near), (None, alone), (4, prose(73, 60, 5000)), (4, far + " end"), (None, other), (None, other + " end")]
    docs = frame([(*r, "en", "a") for r in rows])
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(((i, n, c) for i, n, c in near_components(rows)), key=str)
    kept = sorted(r["text"] for r in jaccard_join.keep_one(docs).collect())
    assert len(kept) == 4 and {far, alone, rows[4][1]} < set(kept) and len({other, other + " end"} & set(kept)) == 1


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 4999), (4999, 5000), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300)) and got[5000] == got[4999] == 4999
    assert components.components(spark.createDataFrame([], "u long, v long")).select(F.count("*")).first()[0] == 0
