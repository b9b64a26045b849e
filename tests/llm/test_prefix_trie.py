"""The trie against plain Python: in one shard and many, in stretches of few turns, with copies, long conversations, nulls and ties."""

import hashlib
import random
import re
import zlib

import pytest

from tripledger.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, node int"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def plain(rows, rebuilt):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), digest(role or "", text or ""), role or "", text or ""))
    convs = {c: [(t[2], t[3]) for t in sorted(own)] for c, own in convs.items()}
    if rebuilt:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
        convs = {c: convs.get(c - c % 20, [])[: h[c]] + own[h[c] :] for c, own in convs.items()}
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        if node:
            kids[node[:-1]] = kids.get(node[:-1], 0) + 1
        leaf = not kids.get(node)
        own = (len(members[node]) - 1) * (len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0)
        leaves[node], saved[node] = leaves.get(node, 0) + leaf, saved.get(node, 0) + own
        if node:
            leaves[node[:-1]] = leaves.get(node[:-1], 0) + leaves[node]
            saved[node[:-1]] = saved.get(node[:-1], 0) + saved[node]
    out = []
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), kids.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(120):
        if rng.random() < 0.1:
            continue
        for turn in range(rng.randint(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant"][turn % 2 :][:1] + [None] * (turn == 3)), rng.choice(["a b", "a", "b c d", None, ""] if rng.random() < 0.9 else [f"own {c}"]), "x", 1))
    for c in range(200, 230):  # copies, some of which go on
        rows += [(c, t, "user", f"same {t}", "x", 1) for t in range(7)] + [(c, 7 + t, "user", f"other {t}", "x", 1) for t in range(c % 3)]
    for c, n in ((300, 40), (301, 40), (302, 33), (310, 25)):  # long ones, two with the same beginning
        rows += [(c, t, "user", f"long {c // 10} {t}", "x", 1) for t in range(n)]
    rows += [(400, None, "user", "late", "x", 1), (400, None, "user", "first", "x", 1), (400, 2, "b", "tie", "x", 1), (400, 2, "a", "tie", "x", 1), (None, 1, "user", "nobody", "x", 1)]
    rows += [(401, 1, "user", "twice", "x", 1)] * 2
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("deep", "shard", "rebuilt"), [(128, 1 << 15, True), (128, 12, False), (16, 12, True)])
def test_trie_equals_plain_python(spark, monkeypatch, deep, shard, rebuilt):
    monkeypatch.setattr(prefix_trie, "DEEP", deep)
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "LEAST", 64)
    rows = conversations(deep + shard)
    got = [tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), rebuilt).collect()]
    want = plain(rows, rebuilt)
    assert len(got) == len(want) and sorted(got, key=str) == sorted(want, key=str)


def test_empty_tables_and_conversations_without_turns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.conversation_trie(none).collect() == [] and prefix_trie.conversation_trie(none, True).collect() == []
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 2)  # its only turn gives way to a beginning that is absent
    rows = [(c, 0, "user", "gone", "x", 1)]
    got = [tuple(r) for r in prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), True).collect()]
    assert got == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())] == plain(rows, True)
