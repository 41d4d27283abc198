"""The prefix trie against plain Python over whole sequences."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = turns.get(c - c % 100, [])[:h] + mine[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, convs in members.items():
        gain = (len(convs) - 1) * (len(node[-1][1]) if node else 0)
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += gain
    return Counter(
        (
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children[node], leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, convs in members.items()
    )


def conversations(seed, n, words=3, longest=8):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", None])
            rows.append((c, t, role, rng.choice(["a", "bb", "é", "👍 x", None][:words])))
    rng.shuffle(rows)
    return rows


def run(spark, rows, tasks=8, parts=3, **options):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        found = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(parts), **options)
        return Counter(tuple(r)[:8] for r in found.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize(
    "options",
    [dict(), dict(shard_turns=20), dict(shard_turns=5, top_nodes=3), dict(shard_turns=1, top_nodes=1)],
)
def test_equal_to_plain_python(spark, options):
    rows = conversations(1, 250)
    assert run(spark, rows, **options) == plain_trie(rows)


def test_one_conversation_in_many_tasks(spark):
    rng = random.Random(2)
    rows = [(100, t, "user", rng.choice(["x", "yy"])) for t in range(400)]
    rows += [(c, t, "user", text) for c in (101, 102, 103) for _, t, _, text in rows[:390]]
    rows += [(c, 0, "user", "x") for c in range(104, 160)]
    assert run(spark, rows, tasks=9) == plain_trie(rows)
    assert run(spark, rows, tasks=5, shard_turns=100, top_nodes=50) == plain_trie(rows)


def test_copies_share_one_digest(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(3000) for t in range(2)]
    got = run(spark, rows, tasks=6)
    assert got == plain_trie(rows) and len(got) == 3


def test_nulls_ties_repeats_and_turnless(spark):
    rows = [
        (5, None, None, None), (5, None, "user", "late"), (5, 1, "b", "x"), (5, 1, "a", "x"), (5, 1, "a", "x"),
        (None, 0, "user", "nobody"), (100, 0, "user", ""), (101, 0, "user", "only turn"), (102, 0, None, ""),
        (203, 0, "user", "no base"), (-7, 0, "user", "negative"), (-7, 1, "user", "negative"),
    ]
    rows += [(c, 0, "user", "one") for c in range(300, 330)]
    want = plain_trie([r for r in rows if r[0] is None or r[0] >= 0])
    assert run(spark, [r for r in rows if r[0] is None or r[0] >= 0]) == want
    assert any(r[1] == 0 for r in run(spark, rows))
    assert run(spark, rows[:0]) == Counter()


def test_clashing_columns(spark):
    rows = conversations(3, 40)
    extra = {c: F.lit("x") for c in ("depth", "k1", "place", "s1", "t1", "chars", "h", "base", "task", "size", "shard", "saved")}
    table = spark.createDataFrame(rows, SCHEMA).withColumns(extra)
    assert Counter(tuple(r)[:8] for r in prefix_trie.prefix_trie(table).collect()) == plain_trie(rows)


def test_slot_table_is_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        k1, k2 = rng.integers(-(2**62), 2**62, n), rng.integers(-(2**62), 2**62, n)
        table = prefix_trie.SlotTable(k1, k2)
        assert sorted(table.slots.tolist()) == list(range(n))
        assert np.array_equal(table.find(k1, k2), table.slots)
        assert (table.find(k1, k2 + 1) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(np.zeros(2, np.int64), np.zeros(2, np.int64))
