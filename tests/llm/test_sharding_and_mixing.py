"""Bounded-load ring and mixing schedule."""

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from outagelens.llm import mixing, sharding

from .brute import WORD, targets
from .conftest import odd_rows, prose


def test_every_row_has_a_slot_and_counts_differ_by_one(odd):
    got = sharding.shard_rows(odd, shards=4).collect()
    rows = odd_rows()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((x or "").encode()) + 1, zlib.crc32((x or "").encode())) for i, x, _, _ in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 4


def test_fewer_rows_than_shards_and_none(frame, empty):
    got = sharding.shard_rows(frame([(1, "a", "", ""), (2, "a", "", "")]), shards=8).collect()
    assert sorted(r["slot"] for r in got) == [0, 0]
    assert sharding.shard_rows(empty).count() == 0


def test_placement_as_a_walk_of_single_keys():
    """Rank intervals equal what key after key finds by walking the ring, round by round."""
    arcs = [(0, 5), (1, 0), (2, 9), (0, 1), (1, 2), (2, 0)]
    capacity = [6, 6, 5]
    keys = [[a, rank, 0] for a, (_, n) in enumerate(arcs) for rank in range(n)]
    room, placed, waiting = list(capacity), {}, keys
    for step in range(len(arcs)):
        rest = []
        for a, rank, _ in waiting:
            shard = arcs[(a + step) % len(arcs)][0]
            if room[shard]:
                room[shard] -= 1
                placed[a, rank] = shard
            else:
                rest.append([a, rank, 0])
        waiting = rest
    laid = {(a, k): s for a, lo, hi, s, _ in sharding.place(arcs, capacity) for k in range(lo, hi)}
    assert laid == placed and len(laid) == sum(n for _, n in arcs)


def test_one_more_shard_moves_few_rows(frame):
    docs = frame([(i, f"text {i}", "", "") for i in range(2000)]).cache()
    a = sharding.shard_rows(docs, 8).select("doc_id", F.col("shard").alias("old"))
    b = sharding.shard_rows(docs, 9)
    moved = a.join(b, "doc_id").filter("old <> shard").count()
    assert moved < 2000 * 0.45  # a modulo of the hash would move 8 of 9


def test_partitioning_does_not_matter(odd):
    a = sharding.shard_rows(odd, 3).groupBy("doc_id", "shard", "slot").count()
    b = sharding.shard_rows(odd.repartition(7, "lang"), 3).groupBy("doc_id", "shard", "slot").count()
    assert a.exceptAll(b).count() == 0


def test_targets_and_taken(odd):
    got = mixing.mix(odd, block=4).collect()
    rows = odd_rows()
    size = lambda x: len(WORD.findall(x or ""))
    sources = Counter()
    for _, x, _, s in rows:
        sources[s] += size(x)
    want = targets(sources)
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter((i, size(x), sources[s]) for i, x, _, s in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    taken, goal = Counter(), {}
    by_size = {v: k for k, v in sources.items()}
    for r in got:
        s = by_size[r["source_size"]]
        taken[s] += r["taken"]
        goal[s] = r["target"]
    for s, t in want.items():
        assert abs(goal[s] - t) < 1e-6 * max(1, t)
        assert abs(taken[s] - t) <= 16, (s, taken[s], t)


def test_small_sources_reach_their_targets(frame):
    rows = [(0, prose(0, 3000), "en", "big")]
    for k, words in enumerate([5, 1, 10, 31, 32, 33, 40, 65] * 3):
        rows.append((k + 1, prose(k + 1, words), "en", f"s{k:02d}"))
    docs = frame(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    goal = targets({s: len(x.split()) for _, x, _, s in rows})
    for r in got:
        assert abs(r["target"] - goal[rows[r["doc_id"]][3]]) < 1e-6 * r["target"]
        assert r["taken"] == int(r["target"] + 1e-9), (r["size"], r["target"], r["taken"])
    times = Counter(r["doc_id"] for r in mixing.take(docs).collect())
    assert all(times[r["doc_id"]] == int(r["target"] / r["size"] + 0.5) for r in got if r["size"] >= 5)


def test_slots_are_numbered_once_each(spark):
    plan = spark.createDataFrame([("a", 3000, 6000.0), ("b", 5, 10.0), ("c", 40, 80.0), (None, 3, 6.0)], "source string, source_size long, target double")
    slots = mixing.schedule(plan).orderBy("slot").collect()
    assert [r["slot"] for r in slots] == list(range(len(slots)))
    ranks = defaultdict(list)
    for r in slots:
        ranks[r["source"]].append(r["rank"])
    assert all(x == list(range(len(x))) for x in ranks.values())
    assert len(ranks["a"]) >= 188 and len(ranks["b"]) >= 2 and len(ranks["c"]) >= 4 and len(ranks[None]) >= 2


def test_reruns_and_partitionings_agree(odd):
    a = mixing.mix(odd).groupBy("doc_id", "size", "taken").count()
    b = mixing.mix(odd.repartition(5, "text")).groupBy("doc_id", "size", "taken").count()
    assert a.exceptAll(b).count() == 0


def test_schedule_follows_the_shares(spark):
    plan = spark.createDataFrame([("a", 6000, 6000.0), ("b", 3000, 2000.0), (None, 10, 0.0)], "source string, source_size long, target double")
    slots = mixing.schedule(plan, block=10).orderBy("slot").collect()
    assert [r["slot"] for r in slots] == list(range(len(slots)))
    seen = Counter()
    for k, r in enumerate(slots):
        assert r["rank"] == seen[r["source"]]
        seen[r["source"]] += 1
        assert abs(seen["a"] - 0.75 * (k + 1)) < 4  # every stretch holds the sources in their shares


def test_take_repeats_and_drops(frame):
    docs = frame([(i, prose(i, 50), "en", "a" if i < 20 else "b") for i in range(40)] + [(40, "", "en", "a")])
    out = mixing.take(docs)
    assert out.columns == docs.columns
    times = Counter(r["doc_id"] for r in out.collect())
    assert max(times.values()) <= 2 and 40 not in times and sum(times.values()) > 40


def test_mixing_empty(empty):
    assert mixing.mix(empty).count() == 0 and mixing.take(empty).count() == 0


def test_take_with_null_and_repeated_ids(frame):
    """The copies of each text are those the mix plans for its rows, whatever their ids."""
    rows = [(1, prose(i, 40), "en", "a") for i in range(20)] + [(None, prose(50 + i % 3, 30), "en", None) for i in range(9)]
    rows += [(7, prose(99, 25), "en", "b")] * 8 + [(7, prose(99, 25), "en", "a")] * 3
    docs = frame(rows)
    planned = Counter()
    for r in mixing.mix(docs).join(mixing.shuffled(docs, extra=[F.col("text").alias("t")]).select("row", "source", "t").distinct().withColumnRenamed("source", "s"),
                                   "row").filter("source <=> s").collect():
        planned[r["t"], r["source"]] += int(r["taken"] / r["size"] + 0.5)
    taken = Counter((r["text"], r["source"]) for r in mixing.take(docs).collect())
    assert taken == +planned and sum(taken.values()) > 40
