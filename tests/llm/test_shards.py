import zlib
from collections import Counter

import pytest

from msgflow.llm import shards


def test_growth_moves_slots_into_the_new_shard_only():
    now = shards.map_for(1, 512)
    for n in range(1, 30):
        grown = shards.grown_map(now)
        assert {b for a, b in zip(now, grown) if a != b} == {n}
        sizes = Counter(grown).values()
        assert max(sizes) - min(sizes) <= 1 + 512 // (n * (n + 1)) and grown == shards.map_for(n + 1, 512)
        now = grown


def test_rebalancing_narrows_the_gap():
    now, load = shards.map_for(4, 64), {i: (i * 37) % 101 + (500 if i < 6 else 0) for i in range(64)}

    def spread(shard_of):
        total = Counter()
        for slot, shard in enumerate(shard_of):
            total[shard] += load[slot]
        return max(total.values()) - min(total.values())

    edited = shards.rebalanced_map(now, load, 10)
    assert spread(edited) < spread(now) and sum(a != b for a, b in zip(now, edited)) <= 10
    assert shards.rebalanced_map(now, {}, 10) == now


def test_a_map_needs_slots():
    with pytest.raises(ValueError):
        shards.map_for(65, 64)


def test_assignment(spark):
    rows = [(i, f"text {i}" * (i % 5)) for i in range(400)] + [(None, "é"), (400, None), (7, "same"), (7, "same"), (401, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string").repartition(6)
    got = shards.assign(df, "doc_id", "text", 5, 64).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    for shard in range(5):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert all(r.grown_shard in (r.shard, 5) for r in got) and {r.law for r in got} == {"key"}
    grown = {(str(r.doc_id)): r.shard for r in shards.assign(df, "doc_id", "text", 6, 64).collect()}
    assert all(grown[str(r.doc_id)] == r.grown_shard for r in got)
    assert shards.assign(df.limit(0), "doc_id", "text", 5, 64).count() == 0
