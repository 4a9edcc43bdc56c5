"""Byte-level BPE: against the tiktoken library, exactly."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from outagelens.llm import byte_bpe
from outagelens.llm.shingles import text_buffer

from .conftest import odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = byte_bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def words(texts):
    """What the operator cuts the texts into, per text."""
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    out = [[] for _ in texts]
    for i, j, a, part, starts, sizes, places, number, _ in byte_bpe._cut(data, offsets, byte_bpe.code_point_classes()):
        for s, n, k in zip(starts.tolist(), sizes.tolist(), number.tolist()):
            row = i + int(np.searchsorted(offsets[i + 1:j + 1], a + s, side="right"))
            out[row].append(part[s:s + n].tobytes().decode())
            assert part[starts[places[k]]:][:sizes[places[k]]].tobytes() == part[s:s + n].tobytes()
    return out


def test_classes_of_all_code_points():
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    table = byte_bpe.code_point_classes()
    for kind, what in ((byte_bpe._LETTER, r"\p{L}"), (byte_bpe._NUMBER, r"\p{N}"), (byte_bpe._SPACE, r"\s")):
        enc = tiktoken.Encoding("c", pat_str=what, mergeable_ranks=single, special_tokens={})
        theirs = {ord(c) for c in bytes(enc.encode_ordinary(every)).decode()}
        assert theirs == set(np.flatnonzero(table == kind).tolist())


@pytest.mark.parametrize("alphabet", ["a' sltrevmd", "ab 1\n\t.'", "é ñ 　x'2", "'s \r\n!", "日本 \U0001f600a'd "])
def test_words_are_the_pattern_s(alphabet):
    rng, find = random.Random(5), regex.compile(public_tokenizers.PATTERN).findall
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    texts += ["'", "''", "'l", "'ll", "'r", "'re", " 's", "\n's", "x's't", "'sé", "'S", "", " ", "  ", "a  ", "  a", " a", "   a"]
    assert words(texts) == [find(t) for t in texts]


def test_long_texts_are_cut_before_white_space(monkeypatch):
    monkeypatch.setattr(byte_bpe.segments, "__defaults__", (64,))
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab' \n é") for _ in range(n)) for n in (0, 5, 900, 3, 1500, 40)] + ["x" * 1000, " " * 300, " " * 500, "a  " * 300]
    assert words(texts) == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]


def test_different_words_of_one_key(monkeypatch):
    monkeypatch.setattr(byte_bpe, "mix", lambda x: x & np.uint64(1))
    texts = ["one two three one two", "a b a c averyveryverylongword averyveryverylongword averyveryverylongwore"]
    assert words(texts) == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]


def test_fold_and_heap_agree_with_the_library(spark):
    rng = random.Random(7)
    sample = ["".join(rng.choice(s) for _ in range(rng.randrange(1, 20))) for s in ("ab", "etaoin shr", "=", "01", "zéñß", "\U0001f600日本語", " \n") for _ in range(60)]
    cells = sorted({w.encode() for w in sample} | {b"", b"a", b" the", b"hello"})
    df = spark.createDataFrame([(w,) for w in cells], "word binary")
    rows = df.select("word", byte_bpe.folded(F.col("word"), byte_bpe.rank_buckets(spark, RANKS)).alias("ids")).collect()
    assert len(rows) == len(cells)
    for r in rows:
        theirs = LIBRARY._encode_single_piece(bytes(r["word"])) if r["word"] else []
        assert r["ids"] == theirs and (not theirs or byte_bpe.merged(bytes(r["word"]), RANKS) == theirs)


def test_a_megabyte_without_a_cut():
    rng = random.Random(8)
    for text in ("".join(rng.choice("abcdefgh") for _ in range(1 << 20)), "=" * (1 << 20)):
        ids = byte_bpe.merged(text.encode(), RANKS)
        assert b"".join(LIBRARY.decode_single_token_bytes(i) for i in ids).decode() == text


def expected(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return len(ids), ids, (text or "").encode()


def run(docs, **options):
    shared = byte_bpe.load(docs, PATH, **options)
    return [(r["doc_id"], r["n_tokens"], r["ids"], bytes(r["decoded"])) for r in byte_bpe.decode(byte_bpe.encode(docs, shared), shared).collect()]


@pytest.mark.parametrize("size", [0, 5, 1 << 18])
def test_odd_rows(frame, empty, size):
    extra = [(20, "It's they'll I'D we've  \n\n x y", "en", "z"), (21, "q" * 5000 + " end", "en", "z"), (22, "café \U0001f600\U0001f600 naïve", "fr", None)]
    rows = odd_rows() + extra
    want = sorted(((i, *expected(t)) for i, t, *_ in rows), key=str)
    assert sorted(run(frame(rows), words=size), key=str) == want
    assert run(empty, words=size) == []


def test_query(spark):
    import __spark_entry__ as E
    from tests.conftest import SF_MED

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_MED}/documents.parquet").collect()}
    rows = E.queries()["op12_byte_bpe"](spark, SF_MED).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, ids, raw = expected(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            n, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest())
