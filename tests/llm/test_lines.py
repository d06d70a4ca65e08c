"""Operator 2 against brute force."""

import hashlib
import random

import numpy as np
import pytest

from postworks.llm import line_dedup, queries


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, s, most=3):
    b = list(s)
    for _ in range(rng.randint(0, most)):
        kind, i = rng.random(), rng.randint(0, len(b) - 1)
        if kind < 0.4:
            b.insert(i, rng.choice("abé梦"))
        elif kind < 0.7 and len(b) > 1:
            del b[i]
        else:
            b[i] = rng.choice("abx")
    return "".join(b)


@pytest.mark.parametrize("most", [0, 1, 2, 5])
def test_banded_distance(most):
    rng = random.Random(most)
    left = ["".join(rng.choices("abé", k=rng.randint(1, 14))) for _ in range(1500)] + ["", "", "a"]
    right = [changed(rng, s, 6) for s in left[:1500]] + ["", "a", ""]
    assert line_dedup.within_edits(left, right, most).tolist() == [edits(a, b) <= most for a, b in zip(left, right, strict=True)]


def line_hash(s):
    data = np.frombuffer(s.encode(), np.uint8)
    return int(line_dedup.Lines(data, np.array([len(data)]), 1).line[0])


def brute(rows, least=40, most=2):
    at = {}
    for i, t in rows:
        if t is not None and i is not None:
            for n, line in enumerate(t.split("\n")):
                if len(line) >= least:
                    at.setdefault(line, []).append((i, n))
    h = {x: line_hash(x) for x in at}
    near = {a for a in at if any(h[b] < h[a] and abs(len(a) - len(b)) <= most and edits(a, b) <= most for b in at if b != a)}
    gone = {p for line, places in at.items() for p in places if p != min(places) or line in near}
    return {(i, t): t if t is None or i is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


@pytest.mark.parametrize(("small", "crowded"), [(32, 256), (4, 256), (32, 1), (4, 3)])
def test_operator(spark, monkeypatch, small, crowded):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    monkeypatch.setattr(line_dedup, "CROWDED", crowded)  # 1, 3: segments are shared with a piece of the rest only
    monkeypatch.setattr(line_dedup, "TRIES", 100 if crowded == 3 else line_dedup.TRIES)
    monkeypatch.setattr(line_dedup, "SEEN", min(crowded, line_dedup.SEEN))
    rng = random.Random(7)
    base = ["".join(rng.choices("abcdefgh é", k=rng.randint(38, 60))) for _ in range(30)]
    base += [f"a beginning that many of the lines share {i}" for i in range(60)]
    rows = [(i, None if i % 40 == 0 else "\n".join(changed(rng, rng.choice(base)) if rng.random() < 0.7 else rng.choice(["short", "", rng.choice(base)]) for _ in range(rng.randint(0, 8)))) for i in range(150)]
    rows += [rows[7], (None, "x" * 50), (None, "x" * 50), (999, ""), (998, "y" * 30000), (997, "y" * 29999)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lines string").repartition(5)
    found = [(r.row.doc_id, r.row.text, r.lines.text) for r in line_dedup.dedup_lines(df).collect()]
    expected = brute(rows[:-2])
    assert len(found) == len(rows)
    long = {r[0]: r[2] for r in found if r[0] in (997, 998)}
    assert sorted(map(len, long.values()))[0] == 0  # one of the two near lines goes
    for i, t, left in found:
        if i not in (997, 998):
            assert left == expected[(i, t)]


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(df).count() == 0


def test_short_lines(spark, tmp_path):
    """Equal lines of the query go at every length, near ones from 20 characters on; blank ones stay."""
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefgh é", k=rng.randint(20, 45))).replace(" ", "x") for _ in range(25)]
    short = ["a", "é", "}", "Les.", "All rights reserve.", "\tx", "a\u00a0b", "19 characters long.", "18 characters long."]
    rows = [(i, "\n".join(changed(rng, rng.choice(base), 2) if rng.random() < 0.5 else rng.choice(short + ["", " ", "\t", "\u00a0", " \u3000"]) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    expected, seen = brute(rows, least=20), set()
    for i, t in rows:
        kept = []
        for line in expected[(i, t)].split("\n"):
            if len(line) >= 20 or not line.strip() or line not in seen:
                kept.append(line)
                seen.add(line)
        expected[(i, t)] = "\n".join(kept)
    found = queries.op2_segment_join(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text_sha256 for r in found} == {i: hashlib.sha256(expected[(i, t)].encode()).hexdigest() for i, t in rows}
    assert sum(r.n_removed for r in found) > 300


@pytest.mark.parametrize("most", [1, 2, 3])
def test_pieces_of_crowded_segments_lose_no_pair(monkeypatch, most):
    """With every slot crowded each pair within the edits still meets in a key."""
    rng = random.Random(most)
    base = ["".join(rng.choices("abcd", k=rng.randint(12, 30))) for _ in range(40)]
    lines = sorted({changed(rng, b, most) for b in base for _ in range(12)} | set(base))
    data = "".join(lines).encode()
    x = line_dedup.Lines(np.frombuffer(data, np.uint8), np.cumsum([len(t.encode()) for t in lines]), 4)
    keys = x.keys(np.arange(len(lines)), most, np.ones(line_dedup.SLOTS, bool))
    met, at = {}, {int(h): i for i, h in enumerate(x.line)}
    for k, h, sig in zip(keys["key"].tolist(), keys["line"].tolist(), keys["sig"].tolist(), strict=True):
        met.setdefault(k, (set(), set()))[sig >> 31 & 1].add(at[h])
    together = {(a, b) for own, probes in met.values() for a in own for b in probes}
    for a in range(len(lines)):
        for b in range(a):
            if edits(lines[a], lines[b]) <= most:
                assert (a, b) in together or (b, a) in together


def test_a_beginning_that_most_lines_share_crowds_no_key(spark):
    rng = random.Random(3)
    lines = ["Posted by the careers team on " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(20_000)]
    df = spark.createDataFrame([(i, "\n".join(lines[i * 100 : i * 100 + 100] + [lines[0]])) for i in range(200)], "id long, text string").repartition(4)
    crowded = line_dedup._crowded(df, 20, 2)
    assert 0 < crowded.sum() < 20
    data = "".join(lines).encode()
    x = line_dedup.Lines(np.frombuffer(data, np.uint8), np.arange(1, len(lines) + 1) * 70, 20)
    largest = []
    for c in (None, crowded):
        keys = x.keys(np.arange(len(lines)), 2, c)
        owned = keys["key"][(keys["sig"] & line_dedup._PROBE) == 0]
        largest.append(np.unique(keys["key"][np.isin(keys["key"], owned)], return_counts=True)[1].max())
    assert largest[0] > 20_000 and largest[1] < 600
    found = line_dedup.dedup_lines(df, "id", min_chars=20).collect()
    assert sum(len(r.lines.removed or ()) for r in found) == 200


def test_rows_that_repeat_an_id_with_other_texts(spark):
    line = "a line that is long enough to be looked at, indeed"
    df = spark.createDataFrame([(1, f"{line}\nx"), (1, f"other\n{line}"), (2, line)], "doc_id long, text string")
    found = sorted((r.row.text, r.lines.text) for r in line_dedup.dedup_lines(df).collect())
    kept = [text for text, left in found if left == text]
    assert len(kept) == 1 and kept[0] != line
    assert all(left in (text, text.replace(line, "").strip("\n")) for text, left in found)
