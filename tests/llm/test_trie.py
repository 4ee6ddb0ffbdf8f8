"""The prefix trie against a plain one of dictionaries."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from docloom.llm import queries, trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, top int"


def ordered(rows):
    talks = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            talks[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    return {conv: [t[3:] for t in sorted(turns)] for conv, turns in talks.items()}


def regrown(talks):
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in talks}
    return {c: talks.get(c - int(math.fmod(c, 20)), [])[: h[c]] + turns[h[c] :] for c, turns in talks.items()}


def plain(talks):
    at = defaultdict(list)
    for conv, turns in talks.items():
        for d in range(len(turns) + 1):
            at[tuple(turns[:d])].append(conv)
    below = defaultdict(list)
    for node in at:
        if node:
            below[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(at, key=len, reverse=True):
        leaves[node] = sum(leaves[b] for b in below[node]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(at[node]) - 1) * words + sum(saved[b] for b in below[node])
        ends = ",".join(map(str, sorted(c for c in at[node] if len(talks[c]) == len(node))))
        parent = min(at[node[:-1]]) if node else None
        out.append((min(at[node]), len(node), parent, len(at[node]), len(below[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def some():
    draw = random.Random(5)
    said = ["yes", "no\tno", "", None, "a b c", "É 😀 x"]
    rows = []
    for conv in [*range(70), 400, 403, -20, -19, -3, 10**12]:
        for turn in range(draw.choice([1, 1, 2, 3, 5, 9, 17])):
            rows.append((conv, None if draw.random() < 0.05 else turn * 2, draw.choice(["user", None]), draw.choice(said if turn > 2 else said[:2]), "k", 1))
    rows += rows[5:9]  # repeated rows
    rows += [(None, 1, "user", "no conversation", "k", 1), (500, 1, "user", "only one turn", "k", 1), (501, 1, "user", "x", "k", 1)]
    rows += [(c, 1, "user", "no stem", "k", 1) for c in range(521, 529)]
    rows += [(77, t, "user", "on and on", "k", 1) for t in range(70)]  # a long one
    return rows


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 8)
    monkeypatch.setattr(trie, "PIECE", 10)


def test_trie_equals_a_plain_one(spark, small_blocks, tmp_path):
    rows = some()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(map(tuple, trie.prefix_trie(frame).collect())) == plain(ordered(rows))
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    again = plain(regrown(ordered(rows)))
    assert sorted(map(tuple, queries.op12_conversation_trie(spark, str(tmp_path)).collect())) == again
    assert any(r[1] == 0 and r[7] != trie.EMPTY_SHA256 for r in again)  # a conversation without turns is there


def test_no_conversations_no_nodes(spark, tmp_path):
    frame = spark.createDataFrame([(None, 1, "user", "x", "k", 1)], SCHEMA)
    assert trie.prefix_trie(frame).count() == 0
    frame.where("false").write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op12_conversation_trie(spark, str(tmp_path)).count() == 0


def test_places_cross_ranges(spark):
    rows = [(1, t, "user", str(t), "k", 1) for t in range(3000)] + [(2, 0, "user", "x", "k", 1)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = trie.numbered(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    keys = [hashlib.sha256(f"4:user{t}".encode()).hexdigest() for t in range(3000)]
    assert [r["key"] for r in sorted(found, key=lambda r: (r["conv_id"], r["place"]))][:3000] == keys
    assert sorted(r["place"] for r in found) == sorted([*range(1, 3001), 1])
