"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cuewright.llm import trie

from ..compare import connect, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    """conv_id -> its turns (role, text) in order; rows of equal turn must be equal."""
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [x[1:] for x in sorted(ts)] for c, ts in by.items()}


def rebuild(by):
    out = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = by.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(by):
    members = defaultdict(list)
    for c, turns in by.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        inner = {m[:-1] for m in members if m}
        ends = sorted(c for c in convs if len(by[c]) == len(node))
        saved = sum((len(members[m]) - 1) * len(WORD.findall(m[-1][1])) for m in below if m)
        rows.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), sum(len(m) == len(node) + 1 for m in below), sum(m not in inner for m in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=str)


def made(seed, convs, longest, roles=("user", "assistant"), variety=2):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.choice([1, 2, longest // 2, longest])):
            rows.append((c, t, roles[t % 2], " ".join("ab"[: rng.randrange(1, 3)] for _ in range(rng.randrange(variety))) if rng.random() < 0.3 else "same words here"))
    return rows


@pytest.mark.parametrize("seed,block,stretch", [(1, 8, 1024), (2, 1, 4), (3, 3, 2), (4, 64, 3)])
def test_nodes_of_any_block_length(spark, monkeypatch, seed, block, stretch):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "STRETCH", stretch)
    rows = made(seed, 40, 11)
    got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == brute(sequences(rows))


def test_rebuilt_conversations_with_awkward_rows(spark, monkeypatch):
    rows = made(5, 70, 9)
    rows = [r for r in rows if r[0] not in (0, 21, 41)]  # two families without their first conversation's members, one without it
    rows += [(20, None, None, None), (20, None, None, None), (45, 99, "user", ""), (45, 99, "user", ""), (None, 1, "user", "stray"), (41, 0, "user", "lone"), (63, None, "tool", "x " * 5000)]
    rows += [(1000 + i, 0, "user", "hi") for i in range(30)]  # some of these are left without turns
    more = spark.createDataFrame([(*r, -1) for r in rows], SCHEMA + ", depth long").withColumn("l1", F.lit("mine"))
    got = trie.prefix_trie(*trie.rebuilt(more)).select(*COLUMNS).collect()
    want = brute(rebuild(sequences(rows)))
    assert sorted(map(tuple, got), key=str) == want
    assert any(not t for t in rebuild(sequences(rows)).values())


def test_only_turnless_and_empty_tables(spark):
    gone = [c for c in range(1, 2000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:3]
    df = spark.createDataFrame([(c, 0, "user", "x") for c in gone], SCHEMA)
    got = [tuple(r) for r in trie.prefix_trie(*trie.rebuilt(df)).select(*COLUMNS).collect()]
    assert got == [(gone[0], 0, None, 3, 0, 1, 0, hashlib.sha256(",".join(map(str, gone)).encode()).hexdigest())]
    assert trie.prefix_trie(*trie.rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0


def test_members_digest_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 64)
    rows = [(c, 0, "user", "hot") for c in range(500)] + [(c, 0, "user", f"t{c}") for c in range(500, 520)]
    got = {r["conv_id"]: r["ends_sha256"] for r in trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).where("depth = 1").collect()}
    assert got[0] == hashlib.sha256(",".join(map(str, range(500))).encode()).hexdigest()
    assert got[507] == hashlib.sha256(b"507").hexdigest() and len(got) == 21


def test_texts_of_nodes(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, None, "b"), (2, 0, "user", "a"), (2, 1, "assistant", None)], SCHEMA)
    got = sorted((r["conv_id"], r["depth"], r["role"], r["text"]) for r in trie.with_texts(trie.conversation_trie(df), df).where("depth > 0").collect())
    assert got == [(1, 1, "user", "a"), (1, 2, "", "b"), (2, 2, "assistant", "")]


def test_matches_sql(spark, data):
    same(trie.op11_trie(spark, data), connect(data), trie.ORACLE_SQL)
