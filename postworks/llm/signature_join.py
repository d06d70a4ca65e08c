"""Operator 12: near-duplicate documents by an inverted join of MinHash signatures.

A document's signature has the least hash of its shingles under each of K
functions; two documents agree in a coordinate as often as their sets overlap.
Documents are posted under their (coordinate, value) pairs, and pairs of
documents are counted by the lists they meet in:

* prefix: values are ordered by how often they were seen, rare ones first. Two
  signatures that agree in T places share at least C of each other's first
  K - T + C values, so only those are posted;
* skip: long lists aren't merged. A pair goes on if it meets in a short list, or
  in a long one of two documents that have C of those;
* a pair's collisions are counted on the two signatures; pairs with T or more are
  retained, unless parities of their sets tell that too many shingles differ
  (which no pair that links can fail), and confirmed on full sets.

Only components are asked for, so pairs of one component need not be made:
documents with equal sets are one (the smallest id stands for all). Each document
is first held against centres of its lists, in two rounds with other centres, and
linked with the one that it agrees with most; lists are merged only for documents
that are in different components after that.

A link is missed only if two sets that overlap by the threshold agree in fewer
than T of K coordinates: 6 in 10^9 at 0.8 exactly (K 48, T 21), less above.

Defined results: a text without words, or null, has no shingles and links with
nothing; a text of fewer words than n has its whole sequence as one shingle. A
row with a null id takes no part in linking and has no component. Rows that
repeat an id are one node. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postworks.llm.components import components
from postworks.llm.scratch import keep, passing_tables, small_batches, written
from postworks.llm.sketch import id_filter, may_have
from postworks.llm.words import SPACED, mix, shingles, split_words, text_chunks

#: The index that links: 80 of 100, as whole numbers. Words of a shingle.
NUM, DEN, SIZE = 80, 100, 2
#: Coordinates, those that have to agree, and collisions that have to be among the posted ones.
COORDINATES, MATCHES, COLLISIONS = 48, 21, 3
#: Documents of a list that is merged; longer ones are skipped.
SHORT = 32
#: Rounds of centres, and centres that a document is held against in a round.
ROUNDS, CENTRES = 2, 4
#: Bits of a set's parities; 64-bit words of them, folded, that are compared inside the join.
PARITIES, FOLDED = 1024, 8
#: Values of a document that tell whether a pair has met in an earlier list.
FIRST = 4
#: Slots of the frequency sketch, values that a task counts together, and the least count it reports.
SLOTS, COUNTED, SEEN = 1 << 20, 1 << 22, 3

_U = np.uint64
_FACTORS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
_OFFSETS = mix(_FACTORS ^ _U(0x2545F4914F6CDD1D))
_LAST = _U(0xFF51AFD7ED558CCD)


def _sets(data: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, one after another, and where each text's begin."""
    h, of = shingles(*split_words(data, ends, SPACED), size)
    if len(of) and (np.diff(of) < 0).any():
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(ends)))))
    for i in range(len(ends)):
        h[bounds[i] : bounds[i + 1]].sort()
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[new], of[new]
    return h, np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(ends)))))


def _least_hashes(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A row of COORDINATES least hashes for each set; sets begin at the given places."""
    out = np.empty((len(begins), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        v = (h ^ _OFFSETS[k]) * _FACTORS[k]
        v ^= v >> _U(29)
        v *= _LAST
        out[:, k] = np.minimum.reduceat((v >> _U(32)).astype(np.uint32), begins)
    return out


def _parities(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set the parities of how many elements fall to each bit: sets differ in at least as many elements as these in bits."""
    bit, out = (mix(h) % _U(PARITIES)).astype(np.int64), []
    for lo in range(0, len(bounds) - 1, 1000):  # so many sets' counts at a time
        own = bounds[lo : lo + 1001]
        of = np.repeat(np.arange(len(own) - 1), np.diff(own))
        odd = np.bincount(of * PARITIES + bit[own[0] : own[-1]], minlength=(len(own) - 1) * PARITIES) & 1
        out.append(np.packbits(odd.astype(np.uint8).reshape(-1, PARITIES), axis=1))
    return np.concatenate(out) if out else np.zeros((0, PARITIES // 8), np.uint8)


def signatures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SIZE) -> DataFrame:
    """(id, n, s1, s2, signature) of each document: the size of its set, 128 bits that tell it from others, its least hashes and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data, ends in text_chunks(whole, "text"):
                h, bounds = _sets(data, ends, size)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                sums = np.zeros((2, len(n)), np.uint64)
                signed: list = [None] * len(n)
                if len(full):
                    for k in range(2):
                        sums[k][full] = np.add.reduceat(mix(h ^ _U(0x5851F42D4C957F2D * k & (2**64 - 1))), bounds[full])
                    least, odd = _least_hashes(h, bounds[full]), _parities(h, bounds)[full]
                    for i, row, bits in zip(full, least, odd, strict=True):
                        signed[i] = row.tobytes() + bits.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *[pa.array(s.view(np.int64)) for s in sums], pa.array(signed, pa.binary())], ["id", "n", "s1", "s2", "signature"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "id long, n long, s1 long, s2 long, signature binary")


def _parts(signed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Least hashes and parities of signatures, a row for each."""
    whole = np.frombuffer(b"".join(signed.to_pylist()), np.uint8).reshape(-1, 4 * COORDINATES + PARITIES // 8)
    return np.ascontiguousarray(whole[:, : 4 * COORDINATES]).view(np.uint32), np.ascontiguousarray(whole[:, 4 * COORDINATES :]).view(np.uint64)


def _values(batch: pa.RecordBatch) -> np.ndarray:
    """(coordinate, value) pairs of a batch's signatures as one number each, a row for each document."""
    return mix(_parts(batch.column(1))[0].astype(np.uint64) | np.arange(COORDINATES, dtype=np.uint64) << _U(32))


def _frequencies(signed: DataFrame) -> np.ndarray:
    """Frequency class of each slot of values: the logarithm of a lower bound of the count."""

    def seen(total: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(total >= SEEN)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SLOTS, np.int64), 0
        for b in batches:
            v = _values(b)
            np.add.at(total, (v & _U(SLOTS - 1)).astype(np.int64).ravel(), 1)
            n += v.size
            if n >= COUNTED:
                yield seen(total)
                total[:], n = 0, 0
        yield seen(total)

    table = signed.select("id", "signature").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[table["slot"].to_numpy()] = table["n"].to_numpy()
    return np.minimum(np.log2(counts + 1) * 2, 63).astype(np.uint8)


def _postings(signed: DataFrame, frequency) -> DataFrame:
    """(value, id) for the first values of each signature, rare ones first."""
    posted = COORDINATES - MATCHES + COLLISIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _values(b)
            order = v >> _U(6) | frequency.value[(v & _U(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << _U(58)
            first = np.take_along_axis(v, np.argpartition(order, posted - 1, axis=1)[:, :posted], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(first.ravel().view(np.int64)), pa.array(np.repeat(b.column(0).to_numpy(), posted))], ["value", "id"])

    return signed.select("id", "signature").mapInArrow(run, "value long, id long")


def _sizes_fit(na: Column, nb: Column) -> Column:
    return DEN * F.least(na, nb) >= NUM * F.greatest(na, nb)


def _agreeing(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (of, to) that agree in MATCHES coordinates, with their number, and whose sizes and parities allow a link."""
    sides = [signed.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}")) for c in ("of", "to")]
    both = pairs.join(sides[0], "of").join(sides[1], "to").where(_sizes_fit(F.col("n_of"), F.col("n_to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (x, odd_x), (y, odd_y) = (_parts(b.column(c)) for c in (2, 3))
            matches = (x == y).sum(axis=1)
            n = b.column(4).to_numpy()  # of both sets together
            overlap = -(-NUM * n // (NUM + DEN))
            good = (matches >= MATCHES) & (np.bitwise_count(odd_x ^ odd_y).sum(axis=1, dtype=np.int64) <= n - 2 * overlap)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), b.column(1).filter(pa.array(good)), pa.array(matches[good])], ["of", "to", "matches"])

    return both.select("of", "to", "s_of", "s_to", (F.col("n_of") + F.col("n_to")).alias("n")).mapInArrow(run, "of long, to long, matches long")


def _links(pairs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """Those of the pairs (of, to) whose full sets link, as (a, b), written."""
    with passing_tables(rows.sparkSession):
        return keep(written(_linked(pairs, rows, size), "links"))


def _linked(pairs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    spark = rows.sparkSession
    ids = written(pairs.select(F.col("of").alias("id")).union(pairs.select("to")).distinct(), "ids")
    # Of other documents few pass the filter, and a join drops what was made of those.
    wanted = spark.sparkContext.broadcast(id_filter(ids, "id"))

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            whole = whole.filter(pa.array(may_have(wanted.value, whole.column(0).to_numpy())))
            for batch, data, ends in text_chunks(whole, "text"):
                h, bounds = _sets(data, ends, size)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))], ["id", "elements"])

    sets = written(rows.select("id", "text").mapInArrow(elements, "id long, elements array<long>").join(ids, "id", "left_semi"), "sets")
    both = pairs.join(sets.select(F.col("id").alias("of"), F.col("elements").alias("e_of")), "of").join(sets.select(F.col("id").alias("to"), F.col("elements").alias("e_to")), "to")
    common = F.size(F.array_intersect("e_of", "e_to"))
    return both.where(common * DEN >= NUM * (F.size("e_of") + F.size("e_to") - common)).select(F.col("of").alias("a"), F.col("to").alias("b"))


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SIZE) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each document."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    everything = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    rows = everything.where("id IS NOT NULL")
    with passing_tables(spark):
        known, groups = _components(rows, size)
    own = F.coalesce("component", "one")
    done = known.join(groups.select(F.col("id").alias("one"), "component"), "one", "left").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), own.alias("component_id"), (own == F.col("id")).alias("kept"))
    nobody = everything.where("id IS NULL").select("id", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("boolean"))
    return done.union(nobody)


def _components(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, one) of each document, where `one` stands for all of an equal set; and the components of those."""
    spark = rows.sparkSession
    with passing_tables(spark):
        known, one, same = _distinct(rows, size)
    known = keep(known)
    frequency = spark.sparkContext.broadcast(_frequencies(one))
    postings = _postings(one, frequency)
    with passing_tables(spark):
        lists = written(postings.groupBy("value").agg(F.count("*").alias("size"), F.min("id").alias("centre")).where("size > 1"), "lists")
        posted = keep(written(postings.join(lists, "value"), "posted"))
    skipped = written(posted.where(F.col("size") > SHORT).groupBy("id").agg(F.countDistinct("value").alias("skipped")), "skipped")

    links, lists = same, posted.withColumn("g", F.col("id"))
    for number in range(ROUNDS):
        with passing_tables(spark):
            pairs = written(_best(_agreeing(_starred(lists, number), one)), "pairs")
            found = keep(_links(pairs, rows, size))
        links = links.union(found)
        with passing_tables(spark):
            groups = keep(written(components(links), "groups"))
        groups = keep(groups)
        lists = _mixed(posted, groups)
    with passing_tables(spark):
        rest = written(_agreeing(_apart(lists, skipped, one), one).select("of", "to"), "rest")
        more = keep(_links(rest, rows, size))
    if more.limit(1).count():
        groups = keep(written(components(links.union(more)), "groups"))
    return known, groups


def _distinct(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (id, n, one), the signatures of those that stand for others, and links between texts of one id."""
    signed = written(signatures(rows, "id", "text", size), "signatures")
    equal = written(signed.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("n", "s1", "s2", "first"), "equal")
    joined = signed.join(equal, ["n", "s1", "s2"], "left").withColumn("one", F.when(F.col("n") > 0, F.coalesce("first", "id")).otherwise(F.col("id")))
    one = keep(written(joined.where("n > 0 AND id = one").select("id", "n", "s1", "s2", "signature").dropDuplicates(["id", "n", "s1", "s2"]).select("id", "n", "signature"), "distinct"))
    # An id with several texts is one node: its copies' nodes are linked.
    several = joined.groupBy("id").agg(F.countDistinct("one").alias("m")).where("m > 1").select(F.col("id").alias("a"))
    same = keep(written(joined.where("id != one").select(F.col("id").alias("a"), F.col("one").alias("b")).join(several, "a", "left_semi").distinct(), "same"))
    known = keep(written(joined.select("id", "n", "one"), "documents"))
    return known, one, same


def _mixed(posted: DataFrame, groups: DataFrame) -> DataFrame:
    """Lists with documents of several components (g)."""
    grouped = posted.join(groups.select("id", F.col("component").alias("g")), "id", "left").withColumn("g", F.coalesce("g", "id"))
    several = grouped.groupBy("value").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo != hi").select("value")
    return grouped.join(several, "value", "left_semi")


def _starred(lists: DataFrame, number: int) -> DataFrame:
    """Each document with the centres of its lists, those of most lists first; a list's centre is its smallest id, in later rounds by a hash."""
    if number == 0:
        stars = lists.where("id != centre").groupBy("id", F.col("centre").alias("to")).agg(F.count("*").alias("c"))
    else:
        centres = lists.groupBy("value").agg(F.min_by(F.struct("id", "g"), F.struct(F.xxhash64("id", F.lit(number)), "id")).alias("new"))
        stars = lists.join(centres, "value").where("g != new.g").groupBy("id", F.col("new.id").alias("to")).agg(F.count("*").alias("c"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("c", (-F.col("to")).alias("to"))), asc=False), 1, CENTRES)  # of as many as it has lists
    return stars.groupBy("id").agg(best.alias("best")).select(F.col("id").alias("of"), F.explode("best.to").alias("to")).select("of", (-F.col("to")).alias("to"))


def _best(agreeing: DataFrame) -> DataFrame:
    """Each document with the one that it agrees with most."""
    return agreeing.groupBy("of").agg(F.max(F.struct("matches", (-F.col("to")).alias("to"))).alias("best")).select("of", (-F.col("best.to")).alias("to"))


def _apart(lists: DataFrame, skipped: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs (of, to) of `_meetings`, each once."""
    return _meetings(lists, skipped, signed).distinct()


def _meetings(lists: DataFrame, skipped: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs of different components that may link: those that meet in short lists, or else in long ones.

    Who shares no short list has to share COLLISIONS long ones, so other members of
    those stay out. Sizes and parities are held against each other inside the join,
    so that no pair leaves it that can't link. A pair leaves it where it first meets,
    not from every list that both are in, as far as the FIRST least values of both tell.
    """
    words = [f"p{k}" for k in range(FOLDED)]

    def parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odd = np.bitwise_xor.reduce(_parts(b.column(2))[1].reshape(len(b), -1, FOLDED), axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(np.ascontiguousarray(w)) for w in odd.T]], ["id", "n", *words])

    long = F.col("size") > SHORT
    many = lists.where(long).join(skipped.where(F.col("skipped") >= COLLISIONS).select("id"), "id", "left_semi")
    wanted = written(lists.where(~long).select("value", "id", "g").union(many.select("value", "id", "g")), "wanted")
    # Of as many values as a document is posted under.
    least = wanted.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("value")), 1, FIRST).alias("first"))
    told = signed.select("id", "n", "signature").mapInArrow(parities, "id long, n long, " + ", ".join(f"{w} long" for w in words))
    open_ = written(wanted.join(least, "id").join(told, "id"), "open")
    sides = [open_.select("value", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "g", "n", "first", *words)]) for side in ("of", "to")]
    na, nb = F.col("n_of"), F.col("n_to")
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{w}_of").bitwiseXOR(F.col(f"{w}_to"))) for w in words])
    overlap = F.ceil(NUM * (na + nb) / (NUM + DEN))
    fits = (F.col("id_to") < F.col("id_of")) & (F.col("g_of") != F.col("g_to")) & _sizes_fit(na, nb) & (differ <= na + nb - 2 * overlap)
    here = F.coalesce(F.array_min(F.array_intersect("first_of", "first_to")) >= sides[0]["value"], F.lit(True))
    met = sides[0].join(sides[1], (sides[0]["value"] == sides[1]["value"]) & fits & here)
    return met.select(F.col("id_of").alias("of"), F.col("id_to").alias("to"))
