"""Merkle manifest: against a plain tree, on odd rows, and the persistence of versions."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from outagelens.llm import merkle

from .conftest import odd_rows


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, at):
    """Root of the nodes, siblings of the one at ``at``, and the fold steps (before, after)."""
    steps = []
    while len(nodes) > 1:
        run = nodes[at // 3 * 3:at // 3 * 3 + 3]
        steps.append((run[:at % 3], run[at % 3 + 1:]))
        nodes, at = [H("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)], at // 3
    return nodes[0], steps


def plain(rows):
    """Rows (doc_id, text, lang, source) -> {(doc_id, leaf)}: everything the query returns."""
    full = [(i, s, lang, None if t is None else len(t), t) for i, t, lang, s in rows]
    trees = {}
    for r in full:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda x: x[:3])
    subroots = [climb([x[2] for x in trees[s]], 0)[0] for s in names]
    out = []
    for k, s in enumerate(names):
        leaves = [x[2] for x in trees[s]]
        for at, (*_, own, r) in enumerate(trees[s]):
            subroot, steps = climb(leaves, at)
            root, upper = climb(subroots, k)
            changed = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                changed = leaf((*r[:4], None if r[4] is None else r[4].replace("\n", "")))
            folded = changed
            for before, after in steps + upper:
                folded = H("".join([*before, folded, *after]))
            proof = H("".join("".join(b + a) for b, a in steps + upper))
            out.append((r[0], own, subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def got(df):
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    rows = merkle.manifest(df, tampered={"text": F.translate("text", "\n", "")}, where=tampered)
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], H("".join(r["proof"])), r["folded_root"], r["verified"]) for r in rows.collect()), key=str)


def test_odd_rows(odd, empty):
    assert got(odd) == plain(odd_rows())
    assert got(empty) == []


def test_a_source_of_several_blocks_and_tiers(frame):
    """Sizes around the block of 729 leaves, one source far beyond it, and lone leaves."""
    rows = [(i, f"line {i}\nend" if i % 3 else f"row {i}", "en", "hot") for i in range(2600)]
    rows += [(10_000 + i, f"a\n{i}", "de", "edge") for i in range(729)] + [(20_000 + i, "x", None, "over") for i in range(730)]
    rows += [(30_000 + i, "y\n", "fr", f"s{i}") for i in range(40)] + [(None, "n\n", "fr", None)]
    result = got(frame(rows))
    assert result == plain(rows)
    assert any(not r[-1] for r in result) and any(r[-1] for r in result)


def test_one_row(frame):
    (row,) = got(frame([(7, "a\nb", "en", None)]))
    assert row[1] == row[2] == row[3] and row[4] == H("")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 28])
def test_versions_share_what_they_do_not_change(n):
    leaves = [H(str(i)) for i in range(n)]
    block = merkle.Block(leaves, merkle.height(n))
    before, count = block.digest[block.root], len(block.digest)
    for i in range(n):
        new = block.replaced(block.root, i, H("other"))
        assert len(block.digest) - count == block.levels + 1  # the leaf and its ancestors only
        count = len(block.digest)
        assert block.digest[new] == climb([*leaves[:i], H("other"), *leaves[i + 1:]], 0)[0]
        assert block.digest[block.root] == before  # the older version stays readable
        assert merkle.fold(leaves[i], block.siblings(block.root, i)) == before
