"""Operator 5: near-duplicate documents by an n-gram Jaccard join.

The join is a sparse product of the document by n-gram incidence matrix with
its transpose, done in blocks of columns. Columns are ordered by how often the
n-gram was seen, rare ones first; of each document only the first columns are
needed (two sets with a Jaccard index of at least t share one of each other's
first n - ceil(t n) + 1). Block by block, tasks multiply the columns and
accumulate the overlap counts of document pairs; a pair is discarded if the
sizes of its sets don't fit, or if its count stays below what the sizes demand
of the columns covered, with those that are too frequent to be multiplied
counted from the documents' lists of them. What is left is verified on whole sets.

Only components are asked for, so pairs of one component need not be made:

* documents with equal sets are one (the smallest id stands for all);
* in a column with many documents, each is paired with one centre at first,
  the document in which fewest rarer n-grams come before that column, and only
  documents that are then still in different components are paired with one
  another. Tasks do so for columns that are frequent among their own documents
  before anything is shuffled, so no task gathers a hot column.

No pair of documents that link and are not connected otherwise is lost; there
is no cap.

Defined results: a text without words, or null, has no n-grams and links with
nothing; a text of fewer words than n has its whole sequence as one n-gram. A
row with a null id takes no part in linking and has no component. Rows that
repeat an id are one node. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postworks.llm.components import components
from postworks.llm.scratch import keep, passing_tables, small_batches, written
from postworks.llm.sketch import id_filter, may_have
from postworks.llm.words import SPACED, mix, shingles, split_words, text_chunks

#: The index that links: 75 of 100, as whole numbers.
NUM, DEN = 75, 100
#: A column with more documents is paired with its centre first; with more in one task, by that task.
SMALL, LOCAL = 32, 16
#: Slots of the frequency sketch, of fixed size whatever the corpus; n-grams that a task counts together, and the least count it reports.
SLOTS, COUNTED, SEEN = 1 << 20, 4_000_000, 3
#: Column entries that a task gathers before it sends blocks, and that a block should hold.
FLUSH, BLOCK = 1_000_000, 4_000_000
#: 64-bit words of a set's signature.
SIGNATURE = 16

_U = np.uint64
_ENTRY = np.dtype([("key", "<u8"), ("id", "<i8"), ("sig", "<u8"), ("n", "<u4"), ("pos", "<u4")])
PAIR, STAR, MEMBER, DOC = range(4)
_ROW = "kind int, a long, b long, na long, nb long, c long"


def _sets(data: np.ndarray, ends: np.ndarray, size: int, classes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct elements of each text, one after another, and where each text's begin (len(ends) + 1).

    An element is an n-gram's hash with its frequency class as the leading bits.
    """
    h, of = shingles(*split_words(data, ends, SPACED), size)
    order = np.argsort(of, kind="stable") if len(of) and (np.diff(of) < 0).any() else None
    if order is not None:
        h, of = h[order], of[order]
    e = h >> _U(6)
    if classes is not None:
        e |= classes[(e & _U(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << _U(58)
    bounds = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(ends)))))
    for i in range(len(ends)):
        e[bounds[i] : bounds[i + 1]].sort()
    if len(e):
        new = np.ones(len(e), bool)
        new[1:] = (e[1:] != e[:-1]) | (of[1:] != of[:-1])
        e, of = e[new], of[new]
    return e, np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(ends)))))


def prefix_length(n):
    """How many first elements of a set of n are needed."""
    return n - (NUM * n + DEN - 1) // DEN + 1


def _frequencies(rows: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Frequency class of each slot of n-grams (the logarithm of a lower bound of the count), and the entries to expect."""

    def seen(held: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= SEEN
        slots, at = np.unique((values[often] & _U(SLOTS - 1)).astype(np.int64), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(np.bincount(at, n[often], len(slots)).astype(np.int64))], ["slot", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = 0, [], 0
        for whole in batches:
            for _, data, ends in text_chunks(whole, "text"):
                e, bounds = _sets(data, ends, size, None)
                total += int(prefix_length(np.diff(bounds)).sum())
                held.append(e)
                n += len(e)
                if n >= COUNTED:
                    yield seen(held)
                    held, n = [], 0
        if held:
            yield seen(held)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([total], pa.int64())], ["slot", "n"])

    table = rows.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slots, n = table["slot"].to_numpy(), table["n"].to_numpy()
    counts = np.zeros(SLOTS, np.int64)
    counts[slots[slots >= 0]] = n[slots >= 0]
    return np.minimum(np.log2(counts + 1) * 2, 63).astype(np.uint8), int(n[slots == -1].sum())


def _entries(rows: DataFrame, size: int, frequency, buckets: int) -> DataFrame:
    """Blocks of column entries: (bucket, own, blob). own: rows for the result that are done already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_held = [], 0
        for whole in batches:
            for batch, data, ends in text_chunks(whole, "text"):
                ids = batch.column(0).to_numpy()
                e, bounds = _sets(data, ends, size, frequency.value)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                sums = [np.zeros(len(n), np.uint64) for _ in range(2)]
                if len(full):
                    for k in range(2):
                        sums[k][full] = np.add.reduceat(mix(e ^ _U(0x5851F42D4C957F2D * k & (2**64 - 1))), bounds[full])
                yield _own(np.stack([np.full(len(n), DOC), ids, n, sums[0].view(np.int64), sums[1].view(np.int64), np.zeros(len(n), np.int64)]), int(ids[0]) if len(ids) else 0, buckets)
                # Of equal sets in these texts the smallest id goes on.
                order = np.lexsort((ids, sums[1], sums[0]))
                order = order[n[order] > 0]
                new = np.ones(len(order), bool)
                new[1:] = (sums[0][order][1:] != sums[0][order][:-1]) | (sums[1][order][1:] != sums[1][order][:-1])
                keep = np.sort(order[new])
                p = prefix_length(n[keep])
                total = int(p.sum())
                pos = np.arange(total) - np.repeat(np.cumsum(p) - p, p)
                out = np.empty(total, _ENTRY)
                out["key"] = mix(e[np.repeat(bounds[keep], p) + pos]) >> _U(16)  # 6 bytes tell columns apart well enough to count by
                out["id"], out["sig"], out["n"] = (np.repeat(x[keep], p) for x in (ids, sums[0], n))
                out["pos"] = pos
                held.append(out)
                rows_held += total
                if rows_held >= FLUSH:
                    yield from _flush(np.concatenate(held), buckets)
                    held, rows_held = [], 0
        if held:
            yield from _flush(np.concatenate(held), buckets)

    return rows.mapInArrow(run, "bucket int, own boolean, blob binary")


_COLLAPSED = np.uint32(1 << 31)


def _own(rows: np.ndarray, at: int, buckets: int) -> pa.RecordBatch:
    """Rows (kind, a, b, na, nb, c) that pass through a block unchanged."""
    bucket = int(mix(np.array([at], np.int64).view(np.uint64))[0] % _U(buckets))
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([True]), pa.array([np.ascontiguousarray(rows.T.astype(np.int64)).tobytes()], pa.binary())], ["bucket", "own", "blob"])


def _flush(x: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    x, single = _shared(x)
    x = _one_of_equal(x)
    begin, size = _groups(x["key"])
    for rows in _centred(x, begin, size, size > LOCAL):
        yield _own(rows, int(rows[1][0]), buckets)
    # A column that is frequent here goes on as its centre alone, marked.
    large = np.repeat(size > LOCAL, size)
    centre = np.zeros(len(x), bool)
    centre[begin] = True
    x["pos"][large & centre] |= _COLLAPSED
    x = np.concatenate((x[~large | centre], single))
    bucket = (mix(x["key"]) % _U(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    x, bucket = x[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(x) else np.array([0])
    blobs = [_pack(x[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    if blobs:
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array([False] * len(blobs)), pa.array(blobs, pa.binary())], ["bucket", "own", "blob"])


def _pack(x: np.ndarray) -> bytes:
    """Entries as columns, with what is the same for all entries of a document once.

    First bytes of a column's numbers stand together, then second ones, and so on: many are alike, which the shuffle's compression then finds.
    """
    first, of = _documents(x)
    docs = x[first]
    parts = [np.array([len(docs), len(x)], "<i8"), docs["id"], docs["sig"], docs["n"], (x["key"] & _U(0xFFFFFFFF)).astype("<u4"), (x["key"] >> _U(32)).astype("<u2"), of.astype("<u4"), x["pos"]]
    return b"".join(p.tobytes() if k == 0 else np.ascontiguousarray(p).view(np.uint8).reshape(len(p), p.itemsize).T.tobytes() for k, p in enumerate(parts))


def _documents(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An entry of each document, and the number of each entry's document."""
    order = np.lexsort((x["sig"], x["id"]))
    y = x[order]
    new = np.ones(len(y), bool)
    new[1:] = (y["id"][1:] != y["id"][:-1]) | (y["sig"][1:] != y["sig"][:-1])
    of = np.empty(len(y), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def _unpack(blob: bytes) -> np.ndarray:
    docs, entries = np.frombuffer(blob, "<i8", 2).tolist()
    at = 16

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        size = np.dtype(kind).itemsize
        out = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n)
        at += out.nbytes
        return np.ascontiguousarray(out.T).view(kind).ravel()

    own = [take(k, docs) for k in ("<i8", "<u8", "<u4")]
    low, high, of, pos = (take(k, entries) for k in ("<u4", "<u2", "<u4", "<u4"))
    out = np.empty(entries, _ENTRY)
    out["key"] = low.astype(np.uint64) | high.astype(np.uint64) << _U(32)
    out["id"], out["sig"], out["n"] = (c[of] for c in own)
    out["pos"] = pos
    return out


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(key)))


def _one_of_equal(x: np.ndarray) -> np.ndarray:
    """Of entries in a column that have equal sets, the smallest id; marks are kept. Sorted by column, place and id."""
    order = np.lexsort((x["id"], x["n"], x["sig"], x["key"]))
    y = x[order]
    same = np.zeros(len(y), bool)
    same[1:] = (y["key"][1:] == y["key"][:-1]) & (y["sig"][1:] == y["sig"][:-1]) & (y["n"][1:] == y["n"][:-1])
    if same.any():
        marked = (y["pos"] & _COLLAPSED) > 0
        begin = np.flatnonzero(~same)
        any_marked = np.logical_or.reduceat(marked, begin)
        y = y[begin]
        y["pos"] |= np.where(any_marked, _COLLAPSED, np.uint32(0))
    return y[np.lexsort((y["id"], y["pos"], y["key"]))]


def _shared(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of columns with more than one, and the others."""
    x = x[np.argsort(x["key"])]
    same = np.zeros(len(x) + 1, bool)
    same[1:-1] = x["key"][1:] == x["key"][:-1]
    shared = same[1:] | same[:-1]
    return x[shared], x[~shared]


def _centred(x: np.ndarray, begin: np.ndarray, size: np.ndarray, which: np.ndarray) -> Iterator[np.ndarray]:
    """For the chosen columns: pairs of each document with the centre, which is the first, and all members."""
    if not which.any():
        return
    rows = np.repeat(which, size)
    centre = np.repeat(x[begin[which]], size[which])
    own = x[rows]
    pos = (own["pos"] & ~_COLLAPSED).astype(np.int64)
    key = own["key"].view(np.int64)
    zero = np.zeros(len(own), np.int64)
    yield np.stack([zero + MEMBER, key, own["id"], own["n"].astype(np.int64), pos, zero])
    pairs = (own["id"] != centre["id"]) & _sizes_fit(own["n"], centre["n"])
    if pairs.any():
        a, b, na, nb = own["id"][pairs], centre["id"][pairs], own["n"][pairs].astype(np.int64), centre["n"][pairs].astype(np.int64)
        order = np.lexsort((b, a))
        a, b, na, nb = a[order], b[order], na[order], nb[order]
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        yield np.stack([np.full(len(new), STAR), a[new], b[new], na[new], nb[new], np.diff(np.append(new, len(a)))])


def _sizes_fit(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    na, nb = na.astype(np.int64), nb.astype(np.int64)
    return DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)


def _multiply(table: pa.Table, document_of: Callable[[np.ndarray], np.ndarray] = lambda ids: ids) -> pa.Table:
    """The product within a block of columns: rows (kind, a, b, na, nb, c)."""
    own = table.filter(table["own"])
    out = [np.frombuffer(b, np.int64).reshape(-1, 6).T for b in own["blob"].to_pylist()]
    parts = [_unpack(b) for b in table.filter(pa.compute.invert(table["own"]))["blob"].to_pylist()]
    if parts:
        x = _one_of_equal(_shared(np.concatenate(parts))[0])
        begin, size = _groups(x["key"])
        marked = np.logical_or.reduceat((x["pos"] & _COLLAPSED) > 0, begin) if len(begin) else np.zeros(0, bool)
        large = marked | (size > SMALL)
        x["pos"] &= ~_COLLAPSED
        x = x[np.lexsort((x["id"], x["pos"], x["key"]))]
        out += _centred(x, begin, size, large)
        # All pairs of the small columns, by the columns' sizes.
        a, b = [], []
        for g in range(2, SMALL + 1):
            at = begin[(size == g) & ~large]
            i, j = np.triu_indices(g, 1)
            a.append((at[:, None] + i).ravel())
            b.append((at[:, None] + j).ravel())
        a, b = np.concatenate(a), np.concatenate(b)
        fit = _sizes_fit(x["n"][a], x["n"][b]) & (document_of(x["id"][a]) != document_of(x["id"][b]))
        a, b = a[fit], b[fit]
        swap = x["id"][a] > x["id"][b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        pair = np.empty(len(a), [("a", "<i8"), ("b", "<i8")])
        pair["a"], pair["b"] = x["id"][a], x["id"][b]
        order = np.lexsort((pair["b"], pair["a"]))
        pair, a, b = pair[order], a[order], b[order]
        if len(pair):
            new = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            count = np.diff(np.append(new, len(pair)))
            out.append(np.stack([np.full(len(new), PAIR), pair["a"][new], pair["b"][new], x["n"][a[new]].astype(np.int64), x["n"][b[new]].astype(np.int64), count]))
    rows = np.concatenate(out, axis=1) if out else np.zeros((6, 0), np.int64)
    return pa.table([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.int64()) for r in rows[1:]]], ["kind", "a", "b", "na", "nb", "c"])


def _of_ids(ids: DataFrame, rows: DataFrame, size: int, frequency, make, schema: str) -> DataFrame:
    """What `make` gives for the ids, elements and bounds of the documents with these ids, and of a few others, which joins must drop."""
    spark = ids.sparkSession
    wanted = spark.sparkContext.broadcast(id_filter(ids, "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(pa.array(may_have(wanted.value, whole.column(0).to_numpy())))
            for batch, data, ends in text_chunks(whole, "text"):
                yield make(batch.column(0), *_sets(data, ends, size, frequency.value))

    return rows.select("id", "text").mapInArrow(run, schema)


_WORDS = [f"s{k}" for k in range(SIGNATURE)]


def _signatures(ids: pa.Array, e: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """Parities of how many elements fall to each of 64 * SIGNATURE bits: sets differ in at least as many elements as these in bits."""
    bits = 64 * SIGNATURE
    of = np.repeat(np.arange(len(ids)), np.diff(bounds))
    odd = np.bincount(of * bits + (mix(e) % _U(bits)).astype(np.int64), minlength=len(ids) * bits) & 1
    words = np.packbits(odd.astype(np.uint8).reshape(len(ids), bits), axis=1).view(np.int64) if len(ids) else np.zeros((0, SIGNATURE), np.int64)
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(bounds)), *[pa.array(np.ascontiguousarray(w)) for w in words.T]], ["id", "size", *_WORDS])


def _elements(ids: pa.Array, e: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(e.view(np.int64)))], ["id", "elements"])


def _signed(ids: DataFrame, rows: DataFrame, size: int, frequency) -> DataFrame:
    """(id, size, s0, ...): sizes and signatures of the sets of the documents with these ids, and of a few others."""
    return written(_of_ids(ids, rows, size, frequency, _signatures, "id long, size long, " + ", ".join(f"{w} long" for w in _WORDS)).dropDuplicates(["id"]), "signatures")


def _may_link(na: Column, nb: Column) -> Column:
    """Whether signatures (s0_a, s0_b, ...) of sets of these sizes differ in no more bits than those of sets that link."""
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in _WORDS])
    return differ <= na + nb - 2 * _least_overlap(na, nb)


def _ids_of(pairs: DataFrame) -> DataFrame:
    return written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")


def _links(pairs: DataFrame, rows: DataFrame, size: int, frequency) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets link. Sets are moved for those only that signatures, which are far smaller, leave open."""
    with passing_tables(pairs.sparkSession):
        return keep(written(_verified(pairs, rows, size, frequency), "links"))


def _verified(pairs: DataFrame, rows: DataFrame, size: int, frequency) -> DataFrame:
    signed = _signed(_ids_of(pairs), rows, size, frequency)
    left, right = (signed.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("size", *_WORDS)]) for side in "ab")
    near = written(pairs.join(left, "a").join(right, "b").where(_may_link(F.col("size_a"), F.col("size_b"))).select("a", "b"), "near")
    sets = written(_of_ids(_ids_of(near), rows, size, frequency, _elements, "id long, elements array<long>"), "sets")
    both = near.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("ea")), "a").join(sets.select(F.col("id").alias("b"), F.col("elements").alias("eb")), "b")
    common = F.size(F.array_intersect("ea", "eb"))
    return both.where(common * DEN >= NUM * (F.size("ea") + F.size("eb") - common)).select("a", "b")


def _least_overlap(na: Column, nb: Column) -> Column:
    """The smallest overlap of sets of these sizes that links."""
    return F.floor((NUM * (na + nb) + NUM + DEN - 1) / (NUM + DEN))


def _prefix_length(n: Column) -> Column:
    return n - F.floor((NUM * n + DEN - 1) / DEN) + 1


def _due(na: Column, nb: Column) -> Column:
    """The fewest columns that sets of these sizes share if they link."""
    least = _least_overlap(na, nb)
    return F.greatest(F.lit(1), F.least(_prefix_length(na) - na + least, _prefix_length(nb) - nb + least))


def _enough(pairs: DataFrame, large: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, na, nb, c, ...) that share as many columns as sets that link; c, the small columns they share, becomes all of them.

    Pairs that share too few small columns are looked up in the lists of large
    ones (id, keys) only where both may have one.
    """
    wanted = pairs.sparkSession.sparkContext.broadcast(id_filter(large, "id"))
    a, b, short = pairs.columns.index("a"), pairs.columns.index("b"), len(pairs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            open_ = np.logical_and(*[may_have(wanted.value, x.column(k).to_numpy()) for k in (a, b)])
            x = x.filter(pa.array(open_ | ~x.column(short).to_numpy(zero_copy_only=False)))
            yield x.select(list(range(short)))

    found = pairs.withColumn("short", F.col("c") < _due(F.col("na"), F.col("nb"))).mapInArrow(run, pairs.schema)
    for side in ("a", "b"):
        found = found.join(large.select(F.col("id").alias(side), F.col("keys").alias(f"keys_{side}")), side, "left")
    all_ = F.col("c") + F.coalesce(F.size(F.array_intersect("keys_a", "keys_b")), F.lit(0))
    return found.withColumn("c", all_.cast("long")).where(F.col("c") >= _due(F.col("na"), F.col("nb"))).select(*pairs.columns)


def join_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, document: Callable[[Column], Column] | None = None, document_of: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of each document.

    document: whose text a row is, by the row's id, where documents have several
    texts. Those of one document belong together, so they aren't compared, and
    component_id is the smallest document. document_of: the same for arrays of
    ids; with it pairs of one document aren't even made.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    everything = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    rows = everything.where("id IS NOT NULL")
    with passing_tables(spark):
        known, groups = _components(rows, size, document, document_of or (lambda ids: ids))
    own = F.coalesce("component", "one").alias("component_id")
    known = known if document is None else known.withColumn("one", document(F.col("one")))
    done = known.join(groups.select(F.col("id").alias("one"), "component"), "one", "left").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), own)
    return done.union(everything.where("id IS NULL").select("id", F.lit(None).cast("long"), F.lit(None).cast("long")))


def _components(rows: DataFrame, size: int, texts_of: Callable[[Column], Column] | None, document_of: Callable[[np.ndarray], np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """(id, n, one) of each text, where `one` stands for all of an equal set; and the components of documents."""
    document = texts_of or (lambda c: c)
    spark = rows.sparkSession
    classes, entries = _frequencies(rows, size)
    frequency = spark.sparkContext.broadcast(classes)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // BLOCK))
    blocks = _entries(rows, size, frequency, buckets).repartition(buckets, "bucket")
    found = written(blocks.groupBy("bucket").applyInArrow(lambda table: _multiply(table, document_of), _ROW), "product", "kind")

    # Documents with equal sets are one, by the smallest id.
    texts = found.where(F.col("kind") == DOC).select(F.col("a").alias("id"), F.col("b").alias("n"), F.col("na").alias("s1"), F.col("nb").alias("s2"))
    classes_ = written(texts.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("n", "s1", "s2", "first"), "classes")
    known = keep(written(texts.join(classes_, ["n", "s1", "s2"], "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("first", "id")).otherwise(F.col("id")).alias("one")), "documents"))
    moved = written(known.where("id != one").select("id", "one").distinct(), "moved")

    def as_one(df: DataFrame, column: str) -> DataFrame:
        to = moved.select(F.col("id").alias(column), F.col("one").alias("_one"))
        return df.join(to, column, "left").withColumn(column, F.coalesce("_one", column)).drop("_one")

    members = written(as_one(found.where(F.col("kind") == MEMBER).select(F.col("a").alias("key"), F.col("b").alias("id"), F.col("na").alias("n"), F.col("nb").alias("pos")), "id").distinct(), "members")
    large = written(members.groupBy("id").agg(F.collect_set("key").alias("keys")), "large")
    apart = document(F.col("a")) != document(F.col("b"))
    # forth: b is to be held against a, as it is the later one or a is the centre; back: a against b, the centre.
    small = found.where((F.col("kind") == PAIR) & apart).select("a", "b", "na", "nb", "c", F.lit(1).alias("forth"), F.lit(0).alias("back"))
    stars = as_one(as_one(found.where(F.col("kind") == STAR).select(F.col("a").alias("of"), F.col("b").alias("to"), "na", "nb"), "of"), "to")
    later = F.col("of") > F.col("to")
    ends = [F.when(later, F.col(x)).otherwise(F.col(y)).alias(n) for x, y, n in (("to", "of", "a"), ("of", "to", "b"), ("nb", "na", "na"), ("na", "nb", "nb"))]
    centred = stars.select(*ends, F.lit(0).cast("long").alias("c"), later.cast("int").alias("forth"), (~later).cast("int").alias("back")).where(apart)
    together = small.union(centred).groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("c").alias("c"), F.max("forth").alias("forth"), F.max("back").alias("back"))
    pairs = written(_enough(together, large), "pairs")

    # First each document with the partner it shares most columns with; then what is still apart.
    ordered = lambda df: df.select(F.least("of", "to").alias("a"), F.greatest("of", "to").alias("b")).distinct()
    ways = pairs.where("forth = 1").select(F.col("b").alias("of"), F.col("a").alias("to"), "c").union(pairs.where("back = 1").select("a", "b", "c"))
    first = written(ordered(ways.groupBy("of").agg(F.max(F.struct("c", (-F.col("to")).alias("to"))).alias("best")).select("of", (-F.col("best.to")).alias("to"))), "first")
    between = lambda df, a, b: df.select(document(F.col(a)).alias("a"), document(F.col(b)).alias("b"))
    links = between(_links(first, rows, size, frequency), "a", "b")
    links = written(links.union(between(moved, "id", "one")) if texts_of else links, "links")
    groups = keep(written(components(links), "groups"))
    rest = written(_still_apart(pairs, members, large, groups, rows, size, frequency, document).join(first, ["a", "b"], "left_anti"), "rest")
    more = _links(rest, rows, size, frequency)
    if more.limit(1).count():
        groups = keep(written(components(links.union(between(more, "a", "b"))), "groups"))
    return known, groups


def _still_apart(pairs: DataFrame, members: DataFrame, large: DataFrame, groups: DataFrame, rows: DataFrame, size: int, frequency, document: Callable[[Column], Column]) -> DataFrame:
    """Pairs of different components: those given, and those of members of a large column whose sizes, places, signatures and shared large columns can fit.

    Of the latter, those that share small columns too are given, or were found to share too few.
    """

    def grouped(df: DataFrame, column: str, name: str) -> DataFrame:
        own = df.withColumn("_of", document(F.col(column)))
        return own.join(groups.select(F.col("id").alias("_of"), F.col("component").alias(name)), "_of", "left").withColumn(name, F.coalesce(name, "_of")).drop("_of")

    given = grouped(grouped(pairs, "a", "ca"), "b", "cb").where("ca != cb").select("a", "b")
    known = written(grouped(members, "id", "g"), "members")
    mixed = written(known.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo != hi").select("key"), "mixed")
    open_ = written(known.join(mixed, "key", "left_semi"), "open")
    signed = _signed(written(open_.select("id").distinct(), "ids"), rows, size, frequency).drop("size")
    open_ = written(open_.join(signed, "id"), "open")
    left, right = (open_.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "pos", "g", *_WORDS)]) for side in "ab")
    na, nb = F.col("n_a"), F.col("n_b")
    fits = (F.col("id_a") < F.col("id_b")) & (F.col("g_a") != F.col("g_b")) & (F.least(na - F.col("pos_a"), nb - F.col("pos_b")) >= _least_overlap(na, nb)) & (DEN * F.least(na, nb) >= NUM * F.greatest(na, nb))
    fits &= _may_link(na, nb)
    within = left.join(right, (left["key"] == right["key"]) & fits).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), na.alias("na"), nb.alias("nb"), F.lit(0).cast("long").alias("c"))
    return given.union(_enough(within.distinct(), large).select("a", "b")).distinct()
