"""The trie of conversation prefixes against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

pytest.importorskip("nounspan.llm")

from nounspan.llm import prefix_trie  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, key int, path int, conv int"


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()[:16]
            own[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    turns = {c: [t for *_, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, own_turns in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        # The remainder has the sign of the id, as in SQL.
        out[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + own_turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        chars = len(node[-1][1]) if node else 0
        saved[node] = sum(saved[k] for k in below) + (len(members[node]) - 1) * chars
    out = []
    for node, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(held), len(node), parent, len(held), len(children[node]), leaves[node], saved[node], digest))
    return sorted(out, key=repr)


def made(seed, n):
    rng = random.Random(seed)
    openings = [("system", "s" * rng.randrange(9)) for _ in range(3)]
    rows = []
    for i in range(n):
        c = rng.randrange(0, 700) * (1 if i % 9 else 100)
        for t in range(rng.randrange(1, 9)):
            said = rng.choice(openings) if t < 3 else (rng.choice(["user", "assistant"]), rng.choice("abc") * rng.randrange(3))
            rows.append((c, t, *said, 1, 2, 3))
    # A third of all conversations are equal, and one is very long.
    for c in range(100_000, 100_000 + n // 3):
        rows += [(c, 0, "user", "hello", 1, 2, 3), (c, 1, "assistant", "hi", 1, 2, 3)]
    rows += [(777_777, t, "user", str(t // 2), 1, 2, 3) for t in range(500)]
    rows += [
        (-5, 0, "user", "below zero", 1, 2, 3), (800_001, None, None, None, None, None, None),
        (800_001, None, "user", "no number", 1, 2, 3), (800_002, 0, "user", "same", 1, 2, 3),
        (800_002, 0, "user", "same", 1, 2, 3), (800_002, 0, "", "user", 1, 2, 3),
        (800_003, 0, "a", "bc", 1, 2, 3), (800_004, 0, "ab", "c", 1, 2, 3), (800_005, 0, "a:b", "", 1, 2, 3),
        (None, 0, "user", "of no conversation", 1, 2, 3),
    ]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shards, seed", [(1, 1), (2, 2), (7, 3), (60, 4)])
def test_equal_to_brute_force(spark, monkeypatch, shards, seed):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    monkeypatch.setattr(prefix_trie, "BATCH_ROWS", 50)
    rows = made(seed, 150)
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), shards=shards).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_no_conversations_give_no_nodes(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.conversation_trie(empty).collect() == []
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 0, "u", "t", 1, 2, 3)], SCHEMA)).collect() == []


def test_a_conversation_without_turns_of_its_own_is_a_member_of_the_root(spark):
    # crc32 of "1" is 1 modulo 6, and there is no conversation 0.
    rows = [(1, 0, "user", "x", 1, 2, 3)]
    assert zlib.crc32(b"1") % 6 >= 1
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [tuple(r)[:7] for r in got] == [(1, 0, None, 1, 0, 1, 0)]
    assert got[0]["ends_sha256"] == hashlib.sha256(b"1").hexdigest()


def test_equal_conversations_are_dealt_over_the_shards(spark):
    n, shards = 3000, 6
    turns = spark.range(n).selectExpr("id AS conv", "array(named_struct('digest', unhex(repeat('ab', 16)), 'chars', 3)) AS turns")
    paths = turns.selectExpr("conv", "turns[0].digest AS path", "array(3) AS chars")
    cuts = prefix_trie.splitters(paths, shards)
    assert len(cuts) == shards - 1
    parts = prefix_trie.shard_parts(paths, cuts, shards).filter("kind = 1 AND depth = 1").collect()
    assert sum(r["n"] for r in parts) == n and max(r["n"] for r in parts) < n / 2
    (root, node) = sorted(map(tuple, prefix_trie.prefix_trie(turns, shards).collect()), key=lambda r: r[1])
    assert root[3:7] == (n, 1, 1, (n - 1) * 3) and node[3:7] == (n, 0, 1, (n - 1) * 3)
