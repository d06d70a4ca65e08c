"""Operator 11 against a dictionary of prefixes."""

import hashlib
import math
import random
import zlib

import pytest

from postworks.llm import conversation_trie as ct


def in_order(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, role, digest, text))
    return {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    return out


def brute(convs):
    members, kids = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
            if d:
                kids.setdefault(tuple(turns[: d - 1]), set()).add(tuple(turns[:d]))
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(who) - 1) * (len(p[-1][1].encode()) if p else 0)
    sha = lambda p, who: hashlib.sha256(",".join(str(c) for c in sorted(who) if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(w), len(p), min(members[p[:-1]]) if p else None, len(w), len(kids.get(p, ())), leaves[p], saved[p], sha(p, w)) for p, w in members.items()), key=repr)


def conversations(seed, n=60, hot=0):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        depth = rng.choice([1, 2, 3, 5, 9, 12])
        rows += [(c * 3 - 20, t if rng.random() < 0.97 else None, rng.choice(["user", "bot", None]), rng.choice(["", "a", "É", "long text", None])) for t in range(depth)]
    for c in range(hot):
        rows += [(1000 + 5 * c, t, "user", f"the same {t}") for t in range(4)] + [(1000 + 5 * c, 4, "bot", f"{c}")] * (c % 3 == 0)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("seed", "hot", "rows", "turns"), [(1, 0, 1 << 16, 1 << 19), (2, 80, 7, 1 << 19), (3, 80, 1 << 16, 9), (4, 60, 1, 1)])
def test_nodes_are_those_of_a_dictionary(spark, monkeypatch, seed, hot, rows, turns):
    monkeypatch.setattr(ct, "BLOCK_ROWS", rows)
    monkeypatch.setattr(ct, "BLOCK_TURNS", turns)
    data = conversations(seed, hot=hot) + [(None, 1, "user", "nobody's"), (500, 1, "user", "x" * 100_000), (501, 1, "user", "twice"), (501, 1, "user", "twice")]
    table = spark.createDataFrame([(*r, "clash") for r in data], SCHEMA + ", depth string").repartition(5)
    found = ct.trie(ct.rebuilt(ct.sequences(table)))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rebuilt(in_order(data)))


def test_long_and_empty(spark):
    assert ct.trie(ct.rebuilt(ct.sequences(spark.createDataFrame([], SCHEMA)))).count() == 0
    # One conversation with many turns, another with all of these but the last, and two that come out without turns.
    data = [(10, t, "u", f"t{t}") for t in range(3000)] + [(20, t, "u", f"t{t}") for t in range(2999)]
    alone = [c for c in range(101, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1][:2]
    data += [(c, 0, "u", "own") for c in alone]
    convs = rebuilt(in_order(data))
    assert [convs[c] for c in alone] == [[], []]
    table = spark.createDataFrame(data, SCHEMA)
    found = sorted((tuple(r) for r in ct.trie(ct.rebuilt(ct.sequences(table))).collect()), key=repr)
    assert len(found) == 3001
    root = next(r for r in found if r[1] == 0)
    assert root[:6] == (10, 0, None, 4, 1, 1)
    assert root[7] == hashlib.sha256(",".join(map(str, alone)).encode()).hexdigest()
    only = spark.createDataFrame([(alone[0], 0, "u", "own")], SCHEMA)
    assert [tuple(r)[:7] for r in ct.trie(ct.rebuilt(ct.sequences(only))).collect()] == [(alone[0], 0, None, 1, 0, 1, 0)]
