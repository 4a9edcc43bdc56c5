"""Collocations: against a plain count over all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from outagelens.llm import collocations as C

from .brute import LOWER
from .conftest import odd_rows


def plain(rows, least, top=2000, taken_over=80):
    """(doc_id, text, lang, source) rows -> the rows of the operator."""
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.setdefault(lang, Counter()).update(tuple(w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = {p[i:i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= taken_over * count[p[i:i + k]]}
        scored = []
        for p, a in candidates.items():
            score, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            if p not in inside:
                scored.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def got(df, least, **options):
    return sorted(tuple(r) for r in C.collocations(df, least=least, **options).collect())


def corpus(seed, n, words="a bb ccc dd e ff g"):
    rng, words = random.Random(seed), words.split()
    def text():
        out = ""
        for _ in range(rng.randrange(30)):
            out += rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", " \x0b"])
        return out
    return [(i, text(), rng.choice(["en", "en", "en", "fr", None]), "s") for i in range(n)]


@pytest.mark.parametrize("least, top", [(3, 2000), (8, 2000), (5, 7)])
def test_random_texts(frame, least, top):
    rows = corpus(least, 200)
    assert got(frame(rows), least, top=top) == plain(rows, least, top)


def test_odd_rows(frame, empty, odd):
    assert got(empty, 2) == []
    assert got(odd, 2) == plain(odd_rows(), 2)
    rows = [(1, "Ärger IM Haus", "de", "s")] * 3 + [(2, "ärger im Haus x Ärger im haus", "de", "s"), (3, "x " * 50, None, "s"), (4, "x " * 9, "und", "s")]
    assert got(frame(rows), 2) == plain(rows, 2)


def test_ranges_start_with_open_phrases(spark, frame):
    """Many ranges, so that a word's phrases spread over several of them; one first word holds most phrases."""
    rows = corpus(1, 150, "hot hot hot hot a b c") + corpus(2, 150, "hot u v")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        result = got(frame(rows), 3)
    finally:
        spark.conf.set(key, "true")
    assert result == plain(rows, 3) and len(result) > 20


def test_full_bitmaps_only_cost_work(frame, monkeypatch):
    monkeypatch.setattr(C, "_marked", lambda bits, hashes: np.ones(len(hashes), bool))
    rows = corpus(9, 60)
    assert got(frame(rows), 4) == plain(rows, 4)


def test_a_long_text_is_cut_between_words():
    rng = random.Random(3)
    text = "".join(rng.choice(["ab", "c", "dé", "x" * 40]) + rng.choice([" ", "  ", ". "]) for _ in range(3000)) + "y" * 3000
    data = np.frombuffer(text.encode(), np.uint8)
    for k in range(1, 5):
        want, found = Counter(), Counter()
        for piece in text.split("."):
            w = piece.split()
            want.update(" ".join(w[i:i + k]).encode() for i in range(len(w) - k + 1))
        for i, j, a, b, cut in C.segments(C._READ[data], np.array([0, len(data)]), 500):
            words = C.Words(C._READ[data[a:b]], np.array([0]), np.zeros(1, np.uint64))
            at = words.phrase_hashes(k)[0]
            found.update(words.phrases(at[words.first[at] < cut - a], k))
        assert found == want


def test_hashes_of_a_phrase_and_of_its_occurrence_agree(spark):
    table = spark.createDataFrame([("en", "ab cd"), ("fr", "ab cd"), ("en", "x y")], "lang string, phrase string")
    bits = np.frombuffer(C.bitmap(table, 2), np.uint8)
    read = C._READ[np.frombuffer(b"q AB\t cd e x y", np.uint8)]
    for lang, marks in (("en", [False, True, False, False, True]), ("fr", [False, True, False, False, False]), ("de", [False] * 5)):
        words = C.Words(read, np.array([0]), np.array([C.lang_seed(lang)], np.uint64))
        assert C._marked(bits, words.phrase_hashes(2)[1]).tolist() == marks
