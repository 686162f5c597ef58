"""Prefix trie against a plain version that walks every conversation and every subtree."""

import hashlib
import random
import zlib

import pytest

from troughline.llm import prefix_trie

COLUMNS = "conv_id long, turn long, role string, text string"


def sequences(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    return {c: [(role, text) for _, _, role, _, text in sorted(turns)] for c, turns in convs.items()}


def shared_heads(convs):
    found = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        found[c] = convs.get(base, [])[:h] + turns[h:]
    return found


def plain(convs):
    nodes, children = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)
    totals = {}
    for key in sorted(nodes, key=len, reverse=True):
        below = [totals[x] for x in children.get(key, [])]
        own = (len(nodes[key]) - 1) * len(key[-1][1]) if key else 0
        totals[key] = (sum(x[0] for x in below) or 1, own + sum(x[1] for x in below))
    rows = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(key))
        parent = min(nodes[key[:-1]]) if key else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        rows.append((min(members), len(key), parent, len(members), len(children.get(key, [])), *totals[key], digest))
    return sorted(map(str, rows))


def mine(spark, rows, rebuild=False):
    df = spark.createDataFrame(rows, COLUMNS)
    if rebuild:
        parts = prefix_trie.rebuilt(df, "conv - conv % 100", "crc32(cast(conv as string)) % 6", 5)
    else:
        parts = prefix_trie.original(df)
    return sorted(str(tuple(r)) for r in prefix_trie.prefix_trie(*parts).collect())


def generated(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-300, 1500), n):
        length = rng.choice([1, 2, 3, longest, rng.randint(1, longest)])
        turns = [rng.choice(["u", "a", None]) for _ in range(length)]
        rows += [(conv, k, role, rng.choice(["x", "yé", "", None, "z" * 40])) for k, role in enumerate(turns)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rebuild", [False, True])
def test_generated(spark, rebuild):
    rows = generated(3, 150, 7)
    rows += [(1000, None, "u", "first"), (1000, 2, "u", "x"), (1000, 2, "u", "x"), (1000, 2, "a", None), (None, 1, "u", "lost")]
    convs = sequences(rows)
    assert mine(spark, rows, rebuild) == plain(shared_heads(convs) if rebuild else convs)


def test_long_chains_of_many_ends(spark, monkeypatch):
    """Chains whose nodes have falling smallest members, so that each run is one node, and runs over blocks."""
    monkeypatch.setattr(prefix_trie, "RUN", 4)
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "CHUNK", 8)
    rows = [(100 - n, k, "u", f"t{k}") for n in range(1, 24) for k in range(n)]  # each a prefix of the next
    rows += [(200, k, "u", f"t{k}" if k < 9 else f"v{k}") for k in range(50)]
    rows += [(300 + n, k, "a", f"w{k}") for n in range(30) for k in range(20)]  # copies
    rows += [(400 + n, k, "a", "s" if k < n else f"e{n}") for n in range(15) for k in range(n + 1)]  # a caterpillar
    assert mine(spark, rows) == plain(sequences(rows))


def test_very_long_conversation_and_text(spark):
    rows = [(1, k, "u", f"t{k}") for k in range(3000)] + [(2, k, "u", f"t{k}") for k in range(2500)] + [(3, 0, "u", "t0"), (3, 1, "a", "x" * 1_000_000), (4, 0, "u", "t0"), (4, 1, "a", "x" * 1_000_000)]
    want = {}
    df = spark.createDataFrame(rows, COLUMNS)
    for r in prefix_trie.prefix_trie(*prefix_trie.original(df)).collect():
        want[(r.conv_id, r.depth)] = (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens)
    length = [len(f"t{k}") for k in range(3000)]
    assert len(want) == 1 + 3000 + 1
    assert want[1, 3000] == (1, 1, 0, 1, 0) and want[1, 2500] == (1, 2, 1, 1, length[2499])
    assert want[1, 2] == (1, 2, 1, 1, sum(length[1:2500])) and want[3, 2] == (1, 2, 0, 1, 1_000_000)
    assert want[1, 0] == (None, 4, 1, 2, 3 * length[0] + sum(length[1:2500]) + 1_000_000)


def test_rebuilt_conversations_without_turns(spark):
    short = [c for c in range(100, 200) if zlib.crc32(str(c).encode()) % 6 >= 2][:5]
    rows = [(c, 0, "u", f"own {c}") for c in short if c != 100]  # conversation 100 is absent
    convs = shared_heads(sequences(rows))
    assert all(turns == [] for turns in convs.values())
    assert mine(spark, rows, rebuild=True) == plain(convs)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "u", "a", 9, "q"), (2, 0, "u", "a", None, None)], COLUMNS + ", depth long, conv string")
    rows = prefix_trie.prefix_trie(*prefix_trie.original(df)).collect()
    assert sorted((r.conv_id, r.depth, r.n_convs, r.saved_tokens) for r in rows) == [(1, 0, 2, 1), (1, 1, 2, 1)]
    for parts in (prefix_trie.original(df.limit(0)), prefix_trie.rebuilt(df.limit(0), "conv", "2", 5)):
        assert prefix_trie.prefix_trie(*parts).collect() == []
