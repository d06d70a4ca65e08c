"""Operator 11: the trie of conversation prefixes.

Conversations are sequences of turns. Spark sorts them by their turns' digests,
range by range; in a sorted range all members of a prefix are neighbours. Each
task takes its range in blocks and computes, for a block,

* the longest common prefix of each two neighbours (LCPs),
* a sparse table of LCP minima over 2^j neighbours,
* for each candidate prefix (what a row shares with the one before it, and the
  whole of each row) its left and its right extent, each found by a binary
  search over the table that knows nothing of other candidates.

Depths between a candidate's and that of the interval around it have the same
members. Counts of members, sums of bytes and of leaves come from running sums,
the smallest member from a second sparse table. What is left to do is small:
nodes whose members reach the edge of a block are sums of one piece for each block,
which Spark groups by the prefix's hash; how the first row of each block
continues the last one of the block before it corrects what pieces counted
twice. So no task holds more than a block, however many conversations share a
prefix, and the turns' texts are never gathered: only digests and sizes are.

Hashes: a turn is the 16 bytes of an MD5 of its role and text; a prefix is a
128-bit sum over these by place.

Defined results: rows with a null conv_id belong to no conversation. Null role or
text count as empty. Turns in order of `turn`, null first, ties by role, then by
the digest; repeated rows are turns of their own. Conversations without turns (they
come about by rebuilding) are members of the root. An empty table has no nodes.
Other columns are not read. The digests of one conversation have to fit a row (20
bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postworks.llm.scratch import keep, passing_tables, small_batches, written
from postworks.llm.words import mix

#: Conversations and turns that a block has at most, but for its last conversation.
BLOCK_ROWS, BLOCK_TURNS = 1 << 16, 1 << 19

_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93))
_SEEDS = (_U(0x2545F4914F6CDD1D), _U(0x5851F42D4C957F2D))
NODE, PIECE, ENDS, BOUND = range(4)
_NUMBERS = ("kind", "at", "k0", "k1", "p0", "p1", "depth", "conv", "n", "children", "leaves", "total", "fresh", "prefix", "starts", "ends", "parent")
_SCHEMA = ", ".join(f"{c} long" for c in _NUMBERS) + ", sha string, blob binary, more binary"
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns) with a digest and the UTF-8 bytes of each turn, in order."""
    who, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)))
    place = (F.col(turn).isNotNull().alias("known"), F.coalesce(F.col(turn), F.lit(0)).alias("turn"), who.alias("role"))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.struct(*place, digest.alias("digest"), F.octet_length(said).alias("size")).alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuilt(own: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """Conversations that begin with the first turns of the one they branch from, and go on with their own.

    Those from a multiple of `every` to the next one branch from that multiple.
    How many turns come from there is a hash of the id, below `heads`.
    """
    base, h = F.col("conv_id") - F.col("conv_id") % every, (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    first = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    both = own.withColumns({"base": base, "h": h}).join(first, "base", "left")
    none = F.slice("turns", 1, 0)
    return both.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _table(values: np.ndarray) -> list[np.ndarray]:
    """Minima over 1, 2, 4, ... neighbours from each place on."""
    out = [values]
    while len(out[-1]) > 1 << (len(out) - 1):
        half, x = 1 << (len(out) - 1), out[-1]
        out.append(np.minimum(x[:-half], x[half:]))
    return out


def _least(table: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima from lo to hi, both included."""
    level = np.frexp((hi - lo + 1).astype(float))[1] - 1
    out = np.empty(len(lo), table[0].dtype)
    for j in range(len(table)):
        own = level == j
        out[own] = np.minimum(table[j][lo[own]], table[j][hi[own] + 1 - (1 << j)])
    return out


def _reach_right(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last row that shares so many turns with the row: steps of halving length over LCPs after it."""
    r = at.copy()
    for j in reversed(range(len(table))):
        can = r + 1 < len(table[j])
        ok = can & (table[j][np.where(can, r + 1, 0)] >= depth)
        r += ok.astype(np.int64) << j
    return r


def _reach_left(table: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first row that shares so many turns with the row."""
    r = at.copy()
    for j in reversed(range(len(table))):
        lo = r - (1 << j) + 1
        ok = (lo >= 1) & (table[j][np.maximum(lo, 0)] >= depth)
        r -= ok.astype(np.int64) << j
    return r


def _prefix_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Running sums within each row, the own place included."""
    sums = np.cumsum(values, dtype=values.dtype)
    before = np.concatenate((np.zeros(1, values.dtype), sums))[offsets[:-1]]
    return sums - np.repeat(before, np.diff(offsets))


def _common(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> int:
    """How many first turns two rows share, by the hashes of their prefixes."""
    n = min(len(a0), len(b0))
    return int(((a0[:n] == b0[:n]) & (a1[:n] == b1[:n])).sum())


def _block(conv: np.ndarray, lens: np.ndarray, digests: np.ndarray, sizes: np.ndarray, at: int) -> pa.RecordBatch:
    """The nodes of sorted conversations, pieces of nodes that may go on in other blocks, and the block's first and last row."""
    m, off = len(conv), np.concatenate(([0], np.cumsum(lens)))
    row = np.repeat(np.arange(m), lens)
    place = np.arange(off[-1]) - off[row]
    longest = int(lens.max())
    keys = []
    for lane, (base, seed) in enumerate(zip(_BASES, _SEEDS, strict=True)):
        powers = np.multiply.accumulate(np.full(longest + 1, base, _U))
        keys.append(_prefix_sums(mix(digests[:, lane] ^ seed ^ mix(digests[:, 1 - lane])) * powers[place], off))
    k0, k1 = keys
    bytes_to = _prefix_sums(sizes, off)

    def prefix_bytes(rows: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return np.where(depth > 0, bytes_to[np.maximum(off[rows] + depth - 1, 0)], 0) if len(bytes_to) else np.zeros(len(rows), np.int64)

    # What each row shares with the one before it; of the first one that isn't known here.
    before = off[np.maximum(row - 1, 0)] + place
    near = (row > 0) & (place < lens[np.maximum(row - 1, 0)])
    same = np.zeros(len(row), bool)
    same[near] = (k0[near] == k0[before[near]]) & (k1[near] == k1[before[near]])
    lcp = np.bincount(row, same, m).astype(np.int64)
    total = prefix_bytes(np.arange(m), lens)
    fresh = np.cumsum(total - prefix_bytes(np.arange(m), lcp))
    totals = np.cumsum(total)
    leaf = np.append(lcp[1:] < lens[:-1], lens[-1] > 0)
    leaves = np.concatenate(([0], np.cumsum(leaf)))
    runs = np.flatnonzero(np.append((lcp[1:] < lens[1:]) | (lens[1:] != lens[:-1]), True))  # last rows of equal sequences
    lows = np.concatenate(([-1], lcp[1:]))  # nothing comes before the first row
    table, smallest = _table(lows), _table(conv)

    rows = np.arange(m)
    cand_at, cand_depth = np.concatenate((rows[1:], rows)), np.concatenate((lcp[1:], lens))
    real = cand_depth > 0
    cand_at, cand_depth = cand_at[real], cand_depth[real]
    left, right = _reach_left(table, cand_at, cand_depth), _reach_right(table, cand_at, cand_depth)
    _, one = np.unique(left * (longest + 1) + cand_depth, return_index=True)
    left, right, deepest = left[one], right[one], cand_depth[one]
    floor = np.maximum(np.maximum(lows[left], 0), np.where(right + 1 < m, lows[np.minimum(right + 1, m - 1)], 0))
    times = deepest - floor
    of = np.repeat(np.arange(len(left)), times)
    depth = floor[of] + 1 + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    # The root comes first.
    left, right, deepest = np.concatenate(([0], left[of])), np.concatenate(([m - 1], right[of])), np.concatenate(([0], deepest[of]))
    depth = np.concatenate(([0], depth))

    deep = np.where(depth > 0, off[left] + depth - 1, -1)
    up = np.where(depth > 1, off[left] + depth - 2, -1)
    pick = lambda x, i: np.where(i >= 0, x[np.maximum(i, 0)], _U(0)) if len(x) else np.zeros(len(i), _U)
    n = right - left + 1
    # Children that begin after the first row, by how much that row shares with the one before it; and the first row's own.
    by_lcp = np.flatnonzero((rows > 0) & (lens > lcp))
    by_lcp = np.sort(lcp[by_lcp] * m + by_lcp)
    later = np.searchsorted(by_lcp, depth * m + right, "right") - np.searchsorted(by_lcp, depth * m + left, "right")
    children = np.where(depth < deepest, 1, later + (lens[left] > depth))
    prefix = prefix_bytes(left, np.maximum(depth - 1, 0))
    own_total = totals[right] - totals[left] + total[left]
    own_fresh = fresh[right] - fresh[left] + total[left] - prefix
    least = _least(smallest, left, right)
    ending = np.where((depth == deepest) & (lens[left] == depth), runs[np.searchsorted(runs, left)] - left + 1, 0)
    touches = (left == 0) | (right == m - 1)

    # A parent that is whole in this block is known here.
    key0, up0, up1 = pick(k0, deep), pick(k0, up), pick(k1, up)
    order = np.argsort(key0, kind="stable")
    found = order[np.minimum(np.searchsorted(key0[order], up0), len(order) - 1)]
    inside = (key0[found] == up0) & ~touches[found] & ~touches
    parent = np.where(inside, least[found], 0)

    sha: list = [None] * len(depth)
    blob: list = [None] * len(depth)
    ends_at = []
    for i in np.flatnonzero(~touches):
        sha[i] = _NO_ENDS
    for i in np.flatnonzero(ending):
        ids = ",".join(map(str, conv[left[i] : left[i] + ending[i]].tolist())).encode()
        if touches[i]:
            ends_at.append((i, ids))
        else:
            sha[i] = hashlib.sha256(ids).hexdigest()
    signed = lambda x: x.view(np.int64)
    columns = {
        "kind": np.where(touches, PIECE, NODE), "at": np.full(len(depth), at), "k0": signed(key0), "k1": signed(pick(k1, deep)), "p0": signed(up0), "p1": signed(up1), "depth": depth, "conv": least, "n": n, "children": children, "leaves": leaves[right + 1] - leaves[left],
        "total": own_total, "fresh": own_fresh, "prefix": prefix, "starts": (left == 0).astype(np.int64), "ends": (right == m - 1).astype(np.int64), "parent": parent,
    }
    nodes = [pa.array(columns[c].astype(np.int64), mask=~inside if c == "parent" else None) for c in _NUMBERS]
    out = pa.table([*nodes, pa.array(sha, pa.string()), pa.array(blob, pa.binary()), pa.array(blob, pa.binary())], [*_NUMBERS, "sha", "blob", "more"])

    def extra(kind: int, some: dict, first: bytes, second: bytes | None) -> pa.Table:
        return pa.table([pa.array([some.get(c, {"kind": kind, "at": at}.get(c))], pa.int64()) for c in _NUMBERS] + [pa.array([None], pa.string()), pa.array([first], pa.binary()), pa.array([second], pa.binary())], out.schema.names)

    path = lambda i: np.stack((k0[off[i] : off[i + 1]], k1[off[i] : off[i + 1]], bytes_to[off[i] : off[i + 1]].view(_U))).tobytes()
    more = [extra(BOUND, {}, path(0), path(m - 1))]
    more += [extra(ENDS, {"k0": int(columns["k0"][i]), "k1": int(columns["k1"][i]), "conv": int(conv[left[i]])}, ids, None) for i, ids in ends_at]
    return pa.concat_tables([out, *more]).combine_chunks().to_batches()[0]


def _nodes(ordered: DataFrame) -> DataFrame:
    """Nodes, pieces, ends and bounds of all blocks of sorted (conv_id, digests, sizes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, rows, turns = TaskContext.get().partitionId(), 0, [], 0, 0

        def block() -> pa.RecordBatch:
            conv, lens, digests, sizes = (np.concatenate(c) for c in zip(*held, strict=True))
            return _block(conv, lens.astype(np.int64), digests, sizes.astype(np.int64), part << 32 | number)

        for whole in batches:
            for lo in range(0, len(whole), BLOCK_ROWS):
                b = whole.slice(lo, BLOCK_ROWS)
                flat = b.column(1).flatten().cast(pa.large_binary())
                at = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8) if len(flat) else np.zeros(1, np.int64)
                digests = np.frombuffer(flat.buffers()[2], np.uint64, 2 * len(flat), int(at[0])).reshape(-1, 2) if len(flat) else np.zeros((0, 2), np.uint64)
                held.append((b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy(), digests, b.column(2).flatten().to_numpy()))
                rows, turns = rows + len(b), turns + len(flat)
                if rows >= BLOCK_ROWS or turns >= BLOCK_TURNS:
                    yield block()
                    number, held, rows, turns = number + 1, [], 0, 0
        if rows:
            yield block()

    return ordered.mapInArrow(run, _SCHEMA)


def _edges(bounds: DataFrame) -> DataFrame:
    """Of each block: how much its first row shares with the row before it, the bytes of that, how much its last row shares with the row after it, and that row's turns."""
    spark = bounds.sparkSession
    order = sorted(r[0] for r in bounds.select("at").collect())  # a number for each block
    neighbours = spark.createDataFrame([(a, p) for a, p in zip(order[1:], order[:-1], strict=True)], "at long, previous long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, previous, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, y = (np.frombuffer(z, _U).reshape(3, -1) for z in (first, last))
                shared = _common(x[0], x[1], y[0], y[1])
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (at, previous, shared, int(x[2][shared - 1]) if shared else 0, int(shared >= y.shape[1] > 0))], ["at", "previous", "shared", "bytes", "goes_on"])

    firsts, lasts = bounds.select("at", F.col("blob").alias("first")), bounds.select(F.col("at").alias("previous"), F.col("more").alias("last"))
    both = neighbours.join(firsts, "at").join(lasts, "previous").select("at", "previous", "first", "last")
    return both.mapInArrow(compare, "at long, previous long, shared long, bytes long, goes_on long")


def _digests(ends: DataFrame) -> DataFrame:
    """(k0, k1, sha) of the ids that end in nodes of several blocks: each node's texts go through the hash in order, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda k, h: pa.RecordBatch.from_arrays([pa.array([k[0]], pa.int64()), pa.array([k[1]], pa.int64()), pa.array([h.hexdigest()])], ["k0", "k1", "sha"])
        current, state = None, None
        for b in batches:
            for k0, k1, ids in zip(*(b.column(c).to_pylist() for c in ("k0", "k1", "blob")), strict=True):
                if (k0, k1) != current:
                    if current:
                        yield made(current, state)
                    current, state = (k0, k1), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids)
        if current:
            yield made(current, state)

    return ends.select("k0", "k1", "conv", "blob").repartition("k0", "k1").sortWithinPartitions("k0", "k1", "conv").mapInArrow(run, "k0 long, k1 long, sha string")


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark: SparkSession = conversations.sparkSession
    small_batches(spark)
    rows = conversations.select("conv_id", F.transform("turns", lambda t: t["digest"]).alias("digests"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    with passing_tables(spark):
        found = keep(written(_nodes(rows.orderBy("digests", "conv_id")), "nodes", "kind"))
        of_kind = lambda k: found.where(F.col("kind") == k)
        with passing_tables(spark):
            edges = written(_edges(of_kind(BOUND)), "edges")
            first = edges.select("at", "shared", "bytes")
            last = edges.select(F.col("previous").alias("at"), "goes_on")
            pieces = of_kind(PIECE).join(first, "at", "left").join(last, "at", "left")
            goes = (F.col("starts") == 1) & (F.col("depth") <= F.col("shared"))
            again = F.coalesce((goes & (F.col("depth") < F.col("shared"))).cast("long"), F.lit(0))
            twice = F.coalesce(F.when(goes, F.col("bytes") - F.col("prefix")), F.lit(0))
            merged = pieces.groupBy("k0", "k1").agg(
                F.first("p0").alias("p0"), F.first("p1").alias("p1"), F.first("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("n").alias("n"),
                F.sum(F.col("children") - again).alias("children"), F.sum(F.col("leaves") - F.coalesce(F.col("ends") * F.col("goes_on"), F.lit(0))).alias("leaves"),
                F.sum("total").alias("total"), F.sum(F.col("fresh") - twice).alias("fresh"), F.max("prefix").alias("prefix"),
            )
            split = written(merged.join(_digests(of_kind(ENDS)), ["k0", "k1"], "left").withColumn("sha", F.coalesce("sha", F.lit(_NO_ENDS))), "split")
            split = keep(split)
        split = keep(split)
        root = split.where("depth = 0").select("conv").first()
    names = split.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv").alias("of_split"))
    columns = ["p0", "p1", "depth", "conv", "n", "children", "leaves", "total", "fresh", "prefix", "sha", "parent"]
    nodes = of_kind(NODE).select(*columns)
    pieces = split.withColumn("parent", F.lit(None).cast("long")).select(*columns)
    # All first turns hang from the root, whose smallest member is one number.
    below_root = (F.col("depth") == 1) & F.col("parent").isNull()
    loose = (F.col("depth") > 1) & F.col("parent").isNull()
    every = nodes.union(pieces)
    placed = every.where(~below_root & ~loose).union(every.where(below_root).withColumn("parent", F.lit(root[0] if root else None).cast("long")))
    joined = every.where(loose).join(names, ["p0", "p1"], "left").withColumn("parent", F.col("of_split")).select(*columns)
    leaves = F.greatest("leaves", (F.col("depth") == 0).cast("long"))
    return placed.union(joined).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), leaves.alias("n_leaves"),
        (F.col("total") - F.col("n") * F.col("prefix") - F.col("fresh")).alias("saved_tokens"), F.col("sha").alias("ends_sha256"),
    )
