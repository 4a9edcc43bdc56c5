"""The pipeline's stages on their own inputs, and its registered queries."""

from collections import Counter

import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from outagelens.llm import common
from tests.conftest import SF_SMALL

from .brute import near_components


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input rows, output rows) of each stage over a small table."""
    docs, out = common.documents(spark, SF_SMALL), []
    for name, stage in P.STAGES:
        after = common.staged(stage(spark, docs, SF_SMALL), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_names_and_columns(stages):
    assert [s[0] for s in stages] == ["quality", "exact_dedup", "near_dedup", "mixing", "bpe"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality_drops_labelled_junk_and_keeps_the_rest(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[0][2].select("doc_id").collect()}
    good = [i for i, q in labels.items() if q]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i, q in labels.items() if not q) <= 0.3 * (len(labels) - len(good))


def test_exact_stage(stages):
    best = {}
    for r in stages[1][1].collect():
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"] for r in stages[1][2].collect()} == set(best.values())


def test_near_stage(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2][1].collect()]
    assert {r["doc_id"] for r in stages[2][2].collect()} == {c for _, _, c in near_components(rows)}


def test_mixing_stage(stages):
    times = Counter(r["doc_id"] for r in stages[3][2].collect())
    assert max(times.values()) == 2 and set(times) <= {r["doc_id"] for r in stages[3][1].collect()}


def test_bpe_stage(stages):
    _, before, after = stages[4]
    assert Counter(r["doc_id"] for r in before.select("doc_id").collect()) == Counter(r["doc_id"] for r in after.select("doc_id").collect())


def test_registered():
    names = {n.split("_")[0] for n in E.queries()}
    assert {f"op{k}" for k in range(1, 14)} | {"pipeline"} <= names


@pytest.mark.parametrize("name", [n for n in E.queries() if n.startswith("op") and not n.startswith("op13_")])
def test_query_returns_every_row(spark, name):
    table = "pages" if name.startswith("op4_") else "documents"
    got = E.queries()[name](spark, SF_SMALL)
    key = "page_id" if table == "pages" else "doc_id"
    rows = spark.read.parquet(f"{SF_SMALL}/{table}.parquet")
    assert got.select(key).exceptAll(rows.select(key)).count() == 0 and got.count() == rows.count()
