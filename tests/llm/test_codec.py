"""Operator 1 against the sentencepiece library."""

import hashlib
import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")

from postworks.llm import queries, sentencepiece_codec  # noqa: E402

PATH = queries.piece_model_path()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return sentencepiece_codec.Codec(f.read())


def texts():
    rng = random.Random(5)
    parts = ["a", "th", "in", "  ", "   ", " ", "\n", "\t", "é", "梦", "▁", "0", "..", "<0x0A>", "</s>", "😀", "\x00", "ü", "####", "aaaa", " the", "ing", ",", "!"]
    out = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)]
    out += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x3000), rng.randint(0x4E00, 0x5000)])) for _ in range(rng.randint(0, 30))) for _ in range(1000)]
    return [*out, "", " ", "  ", "\n", "▁▁ a", "a" * 5000, " " * 777, "=-" * 3000, "word " * 20000]


def test_ids_and_text_are_those_of_the_library(library, codec):
    for t in texts():
        ids = library.encode(t) + [2]
        assert codec.encode(t) == ids, repr(t[:60])
        assert codec.decode(ids) == library.decode(ids), repr(t[:60])


def test_pairs_of_whole_pieces(library, codec):
    """Any two pieces side by side, the rare ones included, and each piece that holds a mark after another character."""
    rng = random.Random(7)
    pieces = [p.replace("▁", " ") for p in codec.id_of]
    marked = [p for p in pieces if len(p) > 1 and any(c in p[1:] for c in "!,.:;?|")]
    assert "²." in marked
    pairs = ["".join(rng.choices(pieces, k=2)) for _ in range(60_000)] + [a + b for a in marked for b in rng.sample(pieces, 12)] + [b + a for a in marked for b in rng.sample(pieces, 12)]
    for t in [*pairs, "an area of 5 km².", "²." * 40]:
        assert codec.encode(t) == library.encode(t) + [2], repr(t)


def test_backtracking_is_what_merging_gives(codec):
    rng = random.Random(6)
    for _ in range(2000):
        t = "▁" + "".join(rng.choices("etaoinshrdlu.", k=rng.randint(1, 12)))
        assert codec.backtrack(t) == codec.merge(t)


def test_operator(spark, library):
    rows = [(1, "Hello wörld\n", "x"), (2, None, "x"), (3, "", None), (None, "a", "x"), (1, "Hello wörld\n", "x"), (4, "long " * 50000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    found = sentencepiece_codec.digests(sentencepiece_codec.encode_decode(df, PATH)).collect()
    expected = []
    for i, t, _ in rows:
        ids = library.encode(t or "") + [2]
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert sentencepiece_codec.encode_decode(df.limit(0), PATH).count() == 0
