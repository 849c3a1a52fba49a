import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from msgflow.llm import prefix_trie


def md5(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain_rebuilt(rows, group, heads):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, md5(role or "", text or ""), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % group) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    out = set()
    for key, who in members.items():
        under = [k for k in members if k[:len(key)] == key]
        inner = {k[:-1] for k in members if k}
        ends = ",".join(str(c) for c in who if len(convs[c]) == len(key))
        out.add((who[0], len(key), members[key[:-1]][0] if key else None, len(who), sum(k[:-1] == key for k in members if k),
                 sum(k not in inner for k in under), sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in under if k),
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows_of(seed, n=60, longest=6):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 3 * n), n):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "bb", None, ""])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(spark, rows, schema=SCHEMA, parts=5):
    df = spark.createDataFrame(rows, schema).repartition(parts)
    return [tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie(prefix_trie.rebuilt(df, 5, 9)).collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    rows = rows_of(seed)
    found = got(spark, rows)
    assert len(found) == len(set(found)) and set(found) == plain_trie(plain_rebuilt(rows, 5, 9))


def test_ties_repeats_nulls_and_clashing_names(spark):
    rows = [(1, None, "user", "x"), (1, 0, None, None), (1, 0, None, None), (1, 0, "b", "a"), (2, 5, "user", "x"), (None, 0, "user", "x"),
            (7, 0, "", ""), (8, 0, "", ""), (9, 0, "a", "\x1f"), (6, 1, "a", "b"), (5, 0, "user", "only"), (11, 0, "user", "q" * 100_000)]
    wide = [(*r, 1, "p", 2) for r in rows]
    found = got(spark, wide, SCHEMA + ", pos int, part string, least int")
    assert set(found) == plain_trie(plain_rebuilt(rows, 5, 9)) and len(found) == len(set(found))


def test_one_conversation_and_none(spark):
    rows = [(3, i, "user", f"t{i}") for i in range(40)]
    assert set(got(spark, rows)) == plain_trie(plain_rebuilt(rows, 5, 9))
    assert got(spark, rows[:0]) == [] and got(spark, [(None, 1, "user", "x")]) == []


def test_a_hot_conversation_and_its_copies_over_many_tasks(spark):
    rows = [(c, i, "user", f"t{i}") for c in (10, 15, 20) for i in range(300)] + [(100 + c, 0, "user", f"t{c % 2}") for c in range(200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert set(got(spark, rows, parts=7)) == plain_trie(plain_rebuilt(rows, 5, 9))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_forests_merge_across_borders():
    """Any cut of the sorted conversations gives the same nodes, once rows of equal nodes are added."""
    rng = random.Random(3)
    convs = {c: [("r", rng.choice("ab") * rng.randint(1, 2)) for _ in range(rng.randint(0, 5))] for c in range(80)}
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    size = lambda key: sum(len(t[1]) for t in key)
    rows = []
    for c, turns in convs.items():
        keys = [tuple(turns[:d]) for d in range(len(turns) + 1)]
        shared = [k for k in keys if len(members[k]) > 1 or not k]
        path = [(len(k), hash(k) & 0xFFFFFF, 0, size(k[:-1])) for k in shared if not k or len(members[k]) < len(members[k[:-1]])]
        rows.append((c, len(turns), path, len(shared[-1]), size(shared[-1])))
    rows.sort(key=lambda r: (r[2], r[1] > r[3], r[0]))

    def nodes(cuts):
        edges, total = [0, *sorted(cuts), len(rows)], {}
        for a, z in zip(edges, edges[1:]):
            forest = prefix_trie.Forest(rows[a:z], rows[a - 1] if a else None, rows[z] if z < len(rows) else None)
            for node in forest.nodes():
                key, (n, least, *sums) = node[:5], node[5:]
                old = total.get(key, (0, least, *[0] * len(sums)))
                total[key] = (old[0] + n, min(old[1], least), *(x + y for x, y in zip(old[2:], sums)))
        return total

    whole = nodes([])
    for k in (1, 2, 5, 20, 79):
        assert nodes(rng.sample(range(1, 80), k)) == whole
    for (depth, _, _, low, _), (n, least, _, children, _) in whole.items():
        key = next(k for k, who in members.items() if len(k) == low and min(who) == least and len(who) == n)
        assert depth <= low and children == sum(k[:-1] == key for k in members if k)
