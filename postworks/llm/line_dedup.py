"""Operator 2: removal of repeated and nearly repeated lines, by a segment-partition edit join.

A line of at least `min_chars` characters is removed if

* an equal line stands earlier (in a document with a smaller id, or higher up
  in the same one), or
* a line within `max_edits` edits (of characters) has a smaller line hash.
  Which of two near lines stays is thus arbitrary but fixed, for whatever rows
  are read with it, and needs no order among documents.

Of shorter lines, equal ones alone are removed, and only from `exact_chars`
characters on (unless given, these are left alone); shorter ones of nothing but
white space always stay. The join: a line is cut into max_edits + 1
segments; of a line within max_edits edits, one segment must occur in it
unchanged, near its place. Segments are keyed by the line's length, their number
and their characters; each line probes the keys of its own length and of up to
max_edits less, with those substrings only that can be a segment's counterpart.
Lines that meet in a key and whose character parities are close are verified
with a banded bit-parallel edit distance, many pairs at once.

Lines often begin or end alike, so that one segment is shared by very many.
Keys that many lines own are found beforehand, by a sketch of fixed size. Lines
meet in such a key only together with a piece of the rest of the line: the other
segments are halved, which gives twice as many pieces as edits are left, so one
of them is unchanged too. In a key that is crowded all the same each line is
tried with the smallest lines first, in bounded work, and only lines that this
doesn't decide are paired with all others there, in a join that Spark splits where it is
skewed. Equal lines are made one inside each task before anything is shuffled.

Defined results: a null text stays null and has no lines; an empty text has one
empty line; a row with a null id is left as it is and removes nothing; rows that
repeat an id and text give equal results; of rows that repeat an id with other
texts each has its own lines, in an order by hash of the text. Rows keep all
their columns, which may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postworks.llm.scratch import keep, passing_tables, small_batches, written
from postworks.llm.sketch import id_filter, may_have
from postworks.llm.words import mix, text_chunks

MAX_EDITS, MIN_CHARS = 2, 40
#: The bound of the registered queries' edit join; they remove equal lines at every length.
SHORT_CHARS = 20
#: Characters that are white space, as Python's isspace() has them.
BLANK = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)
#: In keys with more lines the smallest ones are tried first: so many of them at least, and as many as take so many comparisons.
SMALL, CENTRES, TRIES = 32, 4, 4_000_000
#: Slots of the sketch of keys; the least count in a task that it hears of; lines that crowd a slot.
SLOTS, SEEN, CROWDED = 1 << 20, 4, 256
#: Key entries that a task gathers before it sends blocks; bytes of text that it works on at once.
FLUSH, CHUNK = 1_000_000, 1 << 20
#: Bytes of text whose keys a task should meet in.
BUCKET_BYTES = 48 << 20

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_KEY = np.dtype([("key", "<u8"), ("line", "<u8"), ("sig", "<u8")])
_AT = np.dtype([("line", "<u8"), ("line2", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("no", "<i8")])
#: A signature has parities of characters below the bit that marks probes, and parities of neighbouring characters above.
_PROBE, _CHARS = _U(1 << 31), _U((1 << 31) - 1)
REMOVED, FIRST, PAIR, MEMBER = range(4)
_ROW = "kind int, a long, b long, c long, d long"


#: Scrambled code points of the first plane.
_PLANE = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def _scrambled(codes: np.ndarray) -> np.ndarray:
    """mix(code + 1) of each code point, mostly looked up."""
    if not len(codes) or codes.max() < len(_PLANE):
        return _PLANE[codes]
    return mix(codes.astype(np.uint64) + _U(1))


def _power(base: int, n: int, inverse: bool = False) -> np.ndarray:
    out = np.full(max(n, 1), pow(base, -1, 1 << 64) if inverse else base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Lines:
    """The lines of a slice of texts: code points, and each line's text, number, start and length."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, min_chars: int, hash_only: bool = False, exact_chars: int | None = None):
        self.codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        char_ends = ends if len(self.codes) == len(data) else np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[ends]
        starts_of_text = np.concatenate(([0], char_ends[:-1]))
        breaks = np.flatnonzero(self.codes == 10)
        text_of_break = np.searchsorted(char_ends, breaks, "right")
        start = np.concatenate((starts_of_text, breaks + 1))
        text = np.concatenate((np.arange(len(ends)), text_of_break))
        order = np.lexsort((start, text))
        start, text = start[order], text[order]
        last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
        end = np.where(last, char_ends[text], np.append(start[1:], 0) - 1)
        first = np.searchsorted(text, np.arange(len(ends)))
        number = np.arange(len(text)) - first[text]
        keep = end - start >= min_chars
        if exact_chars is not None and exact_chars < min_chars:
            short = np.flatnonzero((end - start >= max(exact_chars, 1)) & ~keep)
            size = (end - start)[short]
            begin = np.cumsum(size) - size
            place = np.arange(size.sum()) - np.repeat(begin, size)
            printed = ~np.isin(self.codes[np.repeat(start[short], size) + place], BLANK)
            keep[short] = np.logical_or.reduceat(printed, begin) if len(short) else False
        self.text, self.number, self.start, self.length = text[keep], number[keep], start[keep], (end - start)[keep]
        self.within = np.cumsum(self.length) - self.length  # where a line begins among the characters of all lines
        place = np.arange(self.length.sum()) - np.repeat(self.within, self.length)
        chars = _scrambled(self.codes[np.repeat(self.start, self.length) + place])
        most = int(self.length.max()) if len(self.length) else 1
        self.sums, self.inverses, hashes = [], [], []
        for k, base in enumerate(_BASES[: 1 if hash_only else 2]):
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(chars * _power(base, most)[place], dtype=np.uint64))))
            self.inverses.append(_power(base, most + 1, inverse=True))
            hashes.append(mix(self.substring(np.arange(len(self.start)), np.zeros(len(self.start), np.int64), self.length, k) ^ self.length.astype(np.uint64)))
        self.line, self.line2 = hashes[0], hashes[-1]
        if not hash_only:
            # A bit for each of 31 classes of characters, and for each of 32 of neighbours: whether the line has an odd number of them.
            bits = _U(1) << chars % _U(31)
            inside = np.ones(len(chars), bool)
            inside[np.cumsum(self.length) - 1] = False
            at = np.flatnonzero(inside[:-1])
            bits[at] ^= _U(1) << (mix(chars[at] * _U(3) + chars[at + 1]) % _U(32) + _U(32))
            self.sig = np.bitwise_xor.reduceat(bits, self.within) if len(self.within) else np.zeros(0, np.uint64)

    def substring(self, lines: np.ndarray, start: np.ndarray, length: np.ndarray, k: int = 0) -> np.ndarray:
        """Hashes of parts of lines."""
        at = self.within[lines] + start
        return (self.sums[k][at + length] - self.sums[k][at]) * self.inverses[k][start]

    def own_keys(self, chosen: np.ndarray, max_edits: int) -> np.ndarray:
        """Keys of the chosen lines' own segments."""
        n, parts = self.length[chosen], max_edits + 1
        return np.concatenate([mix(self.substring(chosen, *_segment(n, parts, i)) ^ _tag(n, i)) for i in range(parts)])

    def keys(self, chosen: np.ndarray, max_edits: int, crowded: np.ndarray | None = None) -> np.ndarray:
        """Segments that the chosen lines are found by, and substrings that find others' segments.

        Of a key in a crowded slot there is one for each piece of the rest instead.
        """
        out = []
        n, parts = self.length[chosen], max_edits + 1

        def put(key: np.ndarray, lines: np.ndarray, role: np.uint64) -> None:
            entry = np.empty(len(key), _KEY)
            entry["key"], entry["line"], entry["sig"] = key, self.line[lines], self.sig[lines] | role
            out.append(entry)

        def add(length: np.ndarray, i: int, less: int, move: int, role: np.uint64) -> None:
            start, size = _segment(length, parts, i)
            at = start + move
            rows = (at >= 0) & (at + size <= n)
            lines, length = chosen[rows], length[rows]
            key = mix(self.substring(lines, at[rows], size[rows]) ^ _tag(length, i))
            if crowded is None or parts == 1:
                return put(key, lines, role)
            full = crowded[(key & _U(SLOTS - 1)).astype(np.int64)]
            put(key[~full], lines[~full], role)
            if not full.any():
                return None
            key, lines, length = key[full], lines[full], length[full]
            for j in [j for j in range(parts) if j != i]:
                start, size = _segment(length, parts, j)
                # Pieces before the segment are moved by at most i edits, as is the segment; the rest goes for those after it.
                left = max_edits - i
                low, high = (max(-i, move - i), min(i, move + i)) if j < i else (max(move - left, less - left), min(move + left, less + left))
                for half, (begin, piece) in enumerate(((start, size // 2), (start + size // 2, size - size // 2))):
                    for shift in range(low, high + 1) if role else [0]:
                        place = begin + shift
                        fits = (place >= 0) & (place + piece <= self.length[lines])
                        sub = mix(self.substring(lines[fits], place[fits], piece[fits]) ^ mix(key[fits] + _U(2 * j + half + 1)))
                        put(sub, lines[fits], role)
            return None

        for less in range(parts):
            for i in range(parts):
                if less == 0:
                    add(n, i, 0, 0, _U(0))
                for move in range(max(-i, less - (max_edits - i)), min(i, less + (max_edits - i)) + 1):
                    add(n - less, i, less, move, _PROBE)
        return np.concatenate(out) if out else np.zeros(0, _KEY)


def _segment(length: np.ndarray, parts: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of a segment; the last ones have the characters that are left over, one more each."""
    short = length // parts
    longer = length - short * parts
    return i * short + np.maximum(0, i - (parts - longer)), short + (i >= parts - longer)


def _tag(length: np.ndarray, i: int) -> np.ndarray:
    return mix(length.astype(np.uint64) * _U(64) + _U(i + 1))


def _crowded(rows: DataFrame, min_chars: int, max_edits: int) -> np.ndarray:
    """Slots whose keys many lines own. What tasks report are sums for slots, of keys that are frequent in a task."""

    def seen(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= SEEN
        slots, at = np.unique((keys[often] & _U(SLOTS - 1)).astype(np.int64), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.bincount(at, n[often], len(slots)).astype(np.int64))], ["slot", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, known = [], 0, np.zeros(0, np.uint64)
        for whole in batches:
            for _, data, ends in text_chunks(whole, "text", CHUNK):
                x = Lines(data, ends, min_chars, hash_only=True)
                _, once = np.unique(x.line, return_index=True)
                once = once[~np.isin(x.line[once], known)]
                known = np.concatenate((known, x.line[once]))
                held.append(x.own_keys(once, max_edits))
                n += len(held[-1])
                if n >= FLUSH:
                    yield seen(held)
                    held, n, known = [], 0, np.zeros(0, np.uint64)
        if held:
            yield seen(held)

    table = rows.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= CROWDED).toArrow()
    out = np.zeros(SLOTS, bool)
    out[table["slot"].to_numpy()] = True
    return out


def _pass(rows: np.ndarray, at: int, buckets: int) -> pa.RecordBatch:
    bucket = int(mix(np.array([at], np.int64).view(np.uint64))[0] % _U(buckets))
    return _batch([bucket], [0], [np.ascontiguousarray(rows.T.astype(np.int64)).tobytes()])


def _batch(bucket, what, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(what, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "what", "blob"])


def _blocks(x: np.ndarray, by: np.ndarray, what: int, buckets: int) -> Iterator[pa.RecordBatch]:
    bucket = (mix(by) % _U(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    x, bucket = x[order], bucket[order]
    cuts = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(x)) if len(x) else np.array([0])
    blobs = [b"".join(np.ascontiguousarray(x[lo:hi][f]).tobytes() for f in x.dtype.names) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    if blobs:
        yield _batch(bucket[cuts[:-1]].astype(np.int32), [what] * len(blobs), blobs)


def _unpack(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    parts = []
    for blob in blobs:
        part, at = np.empty(len(blob) // kind.itemsize, kind), 0
        for f in kind.names:
            part[f] = np.frombuffer(blob, kind[f], len(part), at)
            at += len(part) * kind[f].itemsize
        parts.append(part)
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _first_occurrences(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences sorted by line and place, each once, and which of them none precedes."""
    at = at[np.lexsort((at["no"], at["text"], at["doc"], at["line2"], at["line"]))]
    new = np.ones(len(at), bool)
    new[1:] = (at["line"][1:] != at["line"][:-1]) | (at["line2"][1:] != at["line2"][:-1])
    again = np.zeros(len(at), bool)
    again[1:] = ~new[1:] & (at["doc"][1:] == at["doc"][:-1]) & (at["text"][1:] == at["text"][:-1]) & (at["no"][1:] == at["no"][:-1])
    return at[~again], new[~again]


def _entries(rows: DataFrame, min_chars: int, max_edits: int, buckets: int, exact_chars: int | None, crowded) -> DataFrame:
    def flush(places: list, keys: list) -> Iterator[pa.RecordBatch]:
        at, first = _first_occurrences(np.concatenate(places))
        late = at[~first]
        if len(late):
            yield _pass(np.stack([np.full(len(late), REMOVED), late["doc"], late["no"], late["text"], np.zeros(len(late), np.int64)]), int(late["no"][0] + late["doc"][0]), buckets)
        yield from _blocks(at[first], at["line"][first], 1, buckets)
        k = np.concatenate(keys)
        yield from _blocks(k, k["key"], 2, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, keys, held, seen = [], [], 0, np.zeros(0, np.uint64)
        for whole in batches:
            for batch, data, ends in text_chunks(whole, "text", CHUNK):
                x = Lines(data, ends, min_chars, exact_chars=exact_chars)
                at = np.empty(len(x.line), _AT)
                at["line"], at["line2"], at["no"] = x.line, x.line2, x.number
                at["doc"], at["text"] = (batch.column(c).to_numpy()[x.text] for c in (0, 2))
                places.append(at)
                _, once = np.unique(x.line, return_index=True)
                once = once[x.length[once] >= min_chars]
                once = once[~np.isin(x.line[once], seen)]
                seen = np.concatenate((seen, x.line[once]))
                keys.append(x.keys(once, max_edits, crowded.value))
                held += len(keys[-1]) + len(at)
                if held >= FLUSH:
                    yield from flush(places, keys)
                    places, keys, held, seen = [], [], 0, np.zeros(0, np.uint64)
        if places:
            yield from flush(places, keys)

    return rows.select("id", "text", "hash").mapInArrow(run, "bucket int, what int, blob binary")


def _meet(max_edits: int):
    def run(table: pa.Table) -> pa.Table:
        blobs = lambda what: table.filter(pc.equal(table["what"], what))["blob"].to_pylist()
        out = [np.frombuffer(b, np.int64).reshape(-1, 5).T for b in blobs(0)]
        at, first = _first_occurrences(_unpack(blobs(1), _AT))
        late, early = at[~first], at[first]
        zero = np.zeros(len(late), np.int64)
        out.append(np.stack([zero + REMOVED, late["doc"], late["no"], late["text"], zero]))
        out.append(np.stack([np.full(len(early), FIRST), early["line"].view(np.int64), early["doc"], early["no"], early["text"]]))
        out += _pairs(_unpack(blobs(2), _KEY), max_edits)
        rows = np.concatenate(out, axis=1)
        return pa.table([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.int64()) for r in rows[1:]]], ["kind", "a", "b", "c", "d"])

    return run


def _close(a: np.ndarray, b: np.ndarray, max_edits: int) -> np.ndarray:
    """Whether lines can be within the edits: one changes the parity of two characters at most, and of four neighbourhoods."""
    x = a ^ b
    return (np.bitwise_count(x & _CHARS) <= 2 * max_edits) & (np.bitwise_count(x >> _U(32)) <= 4 * max_edits)


def _pairs(x: np.ndarray, max_edits: int) -> Iterator[np.ndarray]:
    """Rows (PAIR, line, smaller line) and, of keys in which many meet, (MEMBER, key, line, signature, probes)."""
    x = x[np.argsort(x["key"])]
    shared = np.zeros(len(x) + 1, bool)
    shared[1:-1] = x["key"][1:] == x["key"][:-1]
    x = x[shared[1:] | shared[:-1]]  # most keys have one line, with nothing to pair
    x = x[np.lexsort((x["sig"], x["line"], x["key"]))]
    new = np.ones(len(x), bool)
    new[1:] = (x["key"][1:] != x["key"][:-1]) | (x["line"][1:] != x["line"][:-1]) | (x["sig"][1:] != x["sig"][:-1])
    x = x[new]
    if not len(x):
        return
    begin = np.flatnonzero(np.concatenate(([True], x["key"][1:] != x["key"][:-1])))
    size = np.diff(np.append(begin, len(x)))
    probes = (x["sig"] & _PROBE) > 0
    both = np.logical_or.reduceat(probes, begin) & ~np.logical_and.reduceat(probes, begin)
    # With one line there is nothing to pair.
    low, high = np.minimum.reduceat(x["line"], begin), np.maximum.reduceat(x["line"], begin)
    use = both & (low != high)
    found = []
    small = use & (size <= SMALL)
    for g in np.unique(size[small]):
        at = begin[small & (size == g)]
        i, j = np.triu_indices(g, 1)
        found.append(((at[:, None] + i).ravel(), (at[:, None] + j).ravel()))
    large = use & (size > SMALL)
    for lo, n in zip(begin[large], size[large], strict=True):
        i = np.arange(lo, lo + n)
        # The smallest few lines, tried in turn for those that have none with a close signature yet.
        open_ = i[1:]
        for centre in i[: max(CENTRES, TRIES // n)]:
            open_ = open_[open_ > centre]
            if not len(open_):
                break
            close = _close(x["sig"][open_], x["sig"][centre], max_edits)
            close &= x["line"][open_] != x["line"][centre]
            found.append((np.full(int(close.sum()), centre), open_[close]))
            open_ = open_[~close]
        part = x[lo : lo + n]
        yield np.stack([np.full(n, MEMBER), part["key"].view(np.int64), part["line"].view(np.int64), (part["sig"] & ~_PROBE).view(np.int64), ((part["sig"] & _PROBE) > 0).astype(np.int64)])
    if not found:
        return
    a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    fit = (probes[a] != probes[b]) & (x["line"][a] != x["line"][b]) & _close(x["sig"][a], x["sig"][b], max_edits)
    a, b = a[fit], b[fit]
    pair = np.empty(len(a), [("hi", "<u8"), ("lo", "<u8")])
    pair["hi"], pair["lo"] = np.maximum(x["line"][a], x["line"][b]), np.minimum(x["line"][a], x["line"][b])
    pair = np.unique(pair)
    zero = np.zeros(len(pair), np.int64)
    yield np.stack([zero + PAIR, pair["hi"].view(np.int64), pair["lo"].view(np.int64), zero, zero])


def within_edits(left: list[str], right: list[str], max_edits: int) -> np.ndarray:
    """Whether each two strings are at most so many edits apart: a banded bit-parallel distance, all pairs in step.

    Bit b of a word stands for the row b - max_edits below the diagonal.
    """
    out = np.zeros(len(left), bool)
    sizes = np.array([[len(a), len(b)] for a, b in zip(left, right, strict=True)], np.int64).reshape(-1, 2)
    order = np.argsort(sizes.max(1), kind="stable") if len(sizes) else []
    lo = 0
    while lo < len(order):
        # As many pairs at once as 4 million characters are, of the longest.
        hi = lo + 1
        while hi < len(order) and (hi - lo) * sizes[order[hi]].max() < 4_000_000:
            hi += 1
        own = order[lo:hi]
        lo = hi
        own = own[np.abs(sizes[own, 0] - sizes[own, 1]) <= max_edits]
        if len(own):
            pairs = [(left[i], right[i]) if len(left[i]) <= len(right[i]) else (right[i], left[i]) for i in own]
            out[own] = _distance([p[0] for p in pairs], [p[1] for p in pairs], max_edits) <= max_edits
    return out


def _matrix(texts: list[str], before: int, after: int) -> np.ndarray:
    """Code points, one text a row, with zeros around."""
    n = max(map(len, texts))
    out = np.zeros((len(texts), before + n + after), np.uint32)
    for i, t in enumerate(texts):
        out[i, before : before + len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    return out


def _distance(short: list[str], long: list[str], k: int) -> np.ndarray:
    m, n = np.array([len(t) for t in short]), np.array([len(t) for t in long])
    rows, columns = _matrix(short, k, int(n.max()) + 2 * k + 1 - int(m.max())).T.copy(), _matrix(long, 0, 1).T.copy()
    vp = np.full(len(m), ~_U(0) << _U(k), np.uint64)
    vn = np.zeros(len(m), np.uint64)
    distance = np.zeros(len(m), np.int64)
    one = _U(1)
    for j in range(int(n.max())):
        eq = np.zeros(len(m), np.uint64)
        for b in range(2 * k + 1):
            eq |= (rows[j + b] == columns[j]).astype(np.uint64) << _U(b)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        # Down the diagonal to the last row, then along it.
        bit = np.where(j < m, k, np.maximum(m - 1 - j + k, 0)).astype(np.uint64)
        step = np.where(j < m, 1 - (d0 >> bit & one).astype(np.int64), (hp >> bit & one).astype(np.int64) - (hn >> bit & one).astype(np.int64))
        distance += np.where(j < n, step, 0)
        vp = hn | ~((d0 >> one) | hp)
        vn = (d0 >> one) & hp
    return distance


def _near(pairs: DataFrame, first: DataFrame, rows: DataFrame, min_chars: int, max_edits: int) -> DataFrame:
    """Lines (`line`) of those pairs (line, smaller) that are within the edits. first: the document (id) that has a line first."""
    spark = pairs.sparkSession
    lines = written(pairs.select(F.explode(F.array("line", "smaller")).alias("line")).distinct(), "lines")
    # Of the others few pass the filter, and a join drops those.
    wanted = spark.sparkContext.broadcast(id_filter(lines, "line"))
    holders = spark.sparkContext.broadcast(id_filter(first.join(lines, "line", "left_semi").select("id").distinct(), "id"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(pa.array(may_have(holders.value, whole.column(0).to_numpy())))
            for _, data, ends in text_chunks(whole, "text", CHUNK):
                x = Lines(data, ends, min_chars, hash_only=True)
                _, at = np.unique(x.line, return_index=True)
                ids = x.line.view(np.int64)
                at = at[may_have(wanted.value, ids[at])]
                chars = [x.codes[x.start[i] : x.start[i] + x.length[i]].tobytes().decode("utf-32-le", "replace") for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(chars, pa.string())], ["line", "chars"])

    found = rows.select("id", "text").mapInArrow(texts, "line long, chars string").groupBy("line").agg(F.first("chars").alias("chars"))
    found = written(found.join(lines, "line", "left_semi"), "texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = within_edits(b.column(1).to_pylist(), b.column(2).to_pylist(), max_edits)
            yield b.select(["line"]).filter(pa.array(near))

    both = pairs.join(found, "line").join(found.select(F.col("line").alias("smaller"), F.col("chars").alias("other")), "smaller")
    return written(both.select("line", "chars", "other").mapInArrow(verify, "line long").distinct(), "near")


def _unsigned(column: str):
    """Order of a 64-bit value without sign, as Spark's signed one."""
    return F.col(column).bitwiseXOR(F.lit(-(1 << 63)))


def removed_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """(id, hash, removed): the numbers, from 0, of the lines to remove, of each document that has any; hash: xxhash64 of its text."""
    if not 0 <= max_edits <= 15 or min_chars <= max_edits:
        raise ValueError("max_edits must be 0 to 15, and less than min_chars")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("hash")).where("id IS NOT NULL AND text IS NOT NULL")
    with passing_tables(spark):
        return keep(_removed(rows, max_edits, min_chars, exact_chars))


def _removed(rows: DataFrame, max_edits: int, min_chars: int, exact_chars: int | None) -> DataFrame:
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    crowded = spark.sparkContext.broadcast(_crowded(rows, min_chars, max_edits))
    blocks = _entries(rows, min_chars, max_edits, buckets, exact_chars, crowded).repartition(buckets, "bucket")
    found = written(blocks.groupBy("bucket").applyInArrow(_meet(max_edits), _ROW), "lines", "kind")
    pairs = written(found.where(F.col("kind") == PAIR).select(F.col("a").alias("line"), F.col("b").alias("smaller")).distinct(), "pairs")
    first = found.where(F.col("kind") == FIRST).select(F.col("a").alias("line"), F.col("b").alias("id"), F.col("c").alias("no"), F.col("d").alias("hash"))
    near = _near(pairs, first, rows, min_chars, max_edits)
    # Lines of crowded keys that no partner has decided, with all that meet them there.
    members = found.where(F.col("kind") == MEMBER).select(F.col("a").alias("key"), F.col("b").alias("line"), F.col("c").alias("sig"), F.col("d").alias("probes"))
    left = written(members.join(near, "line", "left_anti"), "undecided")
    if left.limit(1).count():
        other = written(members.select("key", F.col("line").alias("smaller"), F.col("sig").alias("sig2"), F.col("probes").alias("probes2")), "members")
        differs = F.col("sig").bitwiseXOR(F.col("sig2"))
        fits = (F.bit_count(differs.bitwiseAND(int(_CHARS))) <= 2 * max_edits) & (F.bit_count(F.shiftrightunsigned(differs, 32)) <= 4 * max_edits)
        close = (_unsigned("smaller") < _unsigned("line")) & (F.col("probes") != F.col("probes2")) & fits
        more = left.join(other, "key").where(close).select("line", "smaller").distinct().join(pairs, ["line", "smaller"], "left_anti")
        near = near.union(_near(written(more, "pairs"), first, rows, min_chars, max_edits)).distinct()
    gone = found.where(F.col("kind") == REMOVED).select(F.col("a").alias("id"), F.col("c").alias("hash"), F.col("b").alias("no")).union(first.join(near, "line", "left_semi").select("id", "hash", "no"))
    return written(gone.groupBy("id", "hash").agg(F.array_sort(F.collect_set("no")).alias("removed")), "removed")


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """Two columns for each document: `row`, a struct of all its columns, and `lines`, of n_lines, removed and the text that is left."""
    removed = removed_lines(docs, id_column, text_column, max_edits, min_chars, exact_chars)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_column).alias("text"), F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("hash"))
    # One document has one row of numbers at most, and the texts are not sorted for it.
    joined = rows.join(removed.hint("shuffle_hash"), ["id", "hash"], "left")
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    n = F.when(F.col("text").isNull(), 0).otherwise(breaks + 1).cast("long")

    def without(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0).cast("long"), (F.size(lines) - 1).cast("long")), "removed")
        return F.array_join(F.transform(kept, lambda i: F.element_at(lines, (i + 1).cast("int"))), "\n")

    # Inside the lambda the lines are there once, however many are taken.
    left = F.element_at(F.transform(F.array(F.split("text", "\n", -1)), without), 1)
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(left)
    return joined.select("row", F.struct(n.alias("n_lines"), "removed", text.alias("text")).alias("lines"))
