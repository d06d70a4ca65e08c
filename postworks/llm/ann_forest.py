"""Operator 3: approximate nearest neighbours with a forest of random-projection trees.

The forest is fitted on a bounded sample (`sample` vectors, chosen by a hash of
their id); each tree is grown in a task of its own. A tree splits its points at
the median along a direction between two random groups of them until few are
left. Then every vector is indexed: its leaf in each tree. A query searches all
trees through one shared priority queue, which holds tree nodes by how far on
the right side of every hyperplane on their way the query is; leaves are taken
from it, best first, until they hold the part `search_part` of the sample (and
`least_points` at least), summed over all trees. Vectors that stand in at least
`votes` of those leaves are candidates; distances are computed for candidates
alone, exactly and in double precision.

Candidates are not gathered: queries go to the index in blocks of bounded size,
a task counts in bit planes in how many visited leaves of each query a vector
stands, keeps the nearest of its own vectors, and those few are merged. So a
cluster that holds a third of all vectors burdens no task more than others.
Queries that find fewer than k (in small tables) visit all leaves.

Defined results: vectors that are null, zero or hold null or non-finite
components take no part, neither do those of another than the most frequent
length. Of rows that repeat an id the nearest counts, once. Ties go to the
smaller id; with fewer than k candidates all are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postworks.llm.scratch import written

#: Vectors that the forest is fitted on, at most, and their bytes; trees; points of the sample in a leaf.
SAMPLE, SAMPLE_BYTES, TREES, LEAF = 16_384, 32 << 20, 96, 16
#: The part of the sample that visited leaves hold, summed over all trees, and the fewest points; leaves that make a candidate.
SEARCH_PART, LEAST_POINTS, VOTES = 1.0, 2000, 3
#: Queries that are sent to all tasks at once, and such blocks in one job; vectors that a task compares at once.
QUERY_BLOCK, JOB_BLOCKS, VECTOR_BLOCK = 2048, 4, 4096
#: Points that a split's direction is found on.
_SUB = 256


@dataclass
class Forest:
    """Inner nodes have a hyperplane (normal, offset) and two children; a child below 0 is the leaf -1 - child."""

    normals: list[np.ndarray]
    offsets: list[np.ndarray]
    children: list[np.ndarray]
    sizes: list[np.ndarray]  # of each leaf, in the sample

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        out = np.zeros((len(x), len(self.normals)), np.int32)
        x = x.astype(np.float32)
        for t, (normals, offsets, children) in enumerate(zip(self.normals, self.offsets, self.children, strict=True)):
            node = np.zeros(len(x), np.int64) if len(normals) else np.full(len(x), -1)
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                side = (np.einsum("ij,ij->i", x[inner], normals[at]) > offsets[at]).astype(np.int64)
                node[inner] = children[at, side]
            out[:, t] = -1 - node
        return out

    def firsts(self) -> np.ndarray:
        """Where the leaves of each tree begin among those of all trees, and how many there are."""
        return np.concatenate(([0], np.cumsum([len(s) for s in self.sizes])))

    def search(self, query: np.ndarray, points: float) -> list[int]:
        """Leaves to visit, numbered over all trees, best first until they hold so many points of the sample."""
        margins = [n @ query.astype(np.float32) - o for n, o in zip(self.normals, self.offsets, strict=True)]
        heap = [(-np.inf, t, 0 if len(n) else -1) for t, n in enumerate(self.normals)]
        heapq.heapify(heap)
        first, found = self.firsts(), []
        while heap and points > 0:
            worst, t, node = heapq.heappop(heap)
            if node < 0:
                found.append(int(first[t]) - 1 - node)
                points -= self.sizes[t][-1 - node]
                continue
            m = margins[t][node]
            left, right = self.children[t][node].tolist()
            heapq.heappush(heap, (max(worst, m), t, left))
            heapq.heappush(heap, (max(worst, -m), t, right))
        return found


def _direction(points: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
    """From one to the other of two groups, which two random points gather around them in a few rounds."""
    some = points[rng.choice(len(points), min(len(points), _SUB), replace=False)]
    centres = some[:2]
    for _ in range(4):
        side = (some - centres.mean(0)) @ (centres[1] - centres[0]) > 0
        if not side.any() or side.all():
            break
        centres = np.stack([some[~side].mean(0), some[side].mean(0)])
    normal = centres[1] - centres[0]
    length = np.linalg.norm(normal)
    if not length:  # two equal points: a random direction
        normal = rng.standard_normal(points.shape[1])
        length = np.linalg.norm(normal)
    return normal / length


def grow_tree(sample: np.ndarray, leaf: int, seed: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normals, offsets, children and sizes of one tree."""
    rng = np.random.default_rng(seed)
    normals, offsets, children, sizes = [], [], [], []
    # Each open set of points, with the child slot that it becomes.
    todo = [(np.arange(len(sample)), None)]
    while todo:
        points, slot = todo.pop()
        name = None
        if len(points) > leaf:
            normal = _direction(sample[points], rng)
            along = sample[points] @ normal
            offset = np.median(along)
            right = along > offset
            if not right.any():  # more than half are the same: part them from the rest
                offset = (along[along < offset].max() + offset) / 2 if (along < offset).any() else None
                right = along > offset if offset is not None else right
            if right.any() and not right.all():
                name = len(normals)
                normals.append(normal)
                offsets.append(offset)
                children.append([0, 0])
                todo += [(points[~right], (name, 0)), (points[right], (name, 1))]
        if name is None:
            name = -1 - len(sizes)
            sizes.append(len(points))
        if slot:
            children[slot[0]][slot[1]] = name
    return np.array(normals, np.float32).reshape(-1, sample.shape[1]), np.array(offsets, np.float32), np.array(children, np.int32).reshape(-1, 2), np.array(sizes, np.int32)


def _valid(vector: Column) -> Column:
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def fit(vectors: DataFrame, dimension: int, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, seed: int = 1) -> Forest:
    """A forest from a sample of (id, vector); the sample and the forest are of bounded size."""
    spark = vectors.sparkSession
    n = vectors.count()
    most = min(sample, max(1, SAMPLE_BYTES // (8 * dimension)))
    part = vectors if n <= most else vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    table = part.orderBy("id").select("vector").toArrow()
    sent = spark.sparkContext.broadcast(_matrix(table["vector"].combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                parts = grow_tree(sent.value, leaf, (seed, t))
                yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], ["t", "normals", "offsets", "children", "sizes"])

    grown = spark.range(0, trees, 1, min(trees, max(spark.sparkContext.defaultParallelism, 1))).mapInArrow(run, "t long, normals binary, offsets binary, children binary, sizes binary")
    rows = sorted(grown.collect(), key=lambda r: r.t)
    of = lambda name, kind, *shape: [np.frombuffer(bytes(r[name]), kind).reshape(-1, *shape) for r in rows]
    return Forest(of("normals", np.float32, dimension), of("offsets", np.float32), of("children", np.int32, 2), of("sizes", np.int32))


def index(vectors: DataFrame, forest: Forest) -> DataFrame:
    """(id, vector, leaves array<int>) of every vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = sent.value.leaves(_matrix(b.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(leaves) + 1) * leaves.shape[1], pa.int32()), pa.array(leaves.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["id", "vector", "leaves"])

    return vectors.mapInArrow(run, "id long, vector array<double>, leaves array<int>")


class _Nearest:
    """The k nearest so far of each query: ids, and distances sorted with them."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.ids, self.k = queries, ids, k
        self.best: list[list[tuple[float, int]]] = [[] for _ in ids]

    def offer(self, q: int, ids: np.ndarray, x: np.ndarray, candidates: np.ndarray) -> None:
        """Compute the distances of a query's candidates among vectors x, and keep the nearest."""
        own = self.best[q]
        at = candidates[ids[candidates] != self.ids[q]]
        exact = np.sqrt(((x[at] - self.queries[q]) ** 2).sum(1))
        if len(own) == self.k:
            near = exact <= own[-1][0]
            at, exact = at[near], exact[near]
        if len(at) > 4 * self.k:
            # More than k distinct ids are within this distance unless ids repeat.
            near = exact <= np.partition(exact, self.k - 1)[self.k - 1]
            if len(np.unique(ids[at[near]])) >= self.k:
                at, exact = at[near], exact[near]
        if len(at):
            merged: dict[int, float] = {}
            for d, i in sorted([*own, *zip(exact.tolist(), ids[at].tolist(), strict=True)]):
                merged.setdefault(i, d)
            self.best[q] = [(d, i) for i, d in list(merged.items())[: self.k]]


def at_least(bits: Iterator[np.ndarray], votes: int) -> np.ndarray:
    """Of bit arrays of one shape: which bits are set in at least so many of them, counted in bit planes."""
    planes: list[np.ndarray] = []
    over = None
    for carry in bits:
        if over is None:
            planes = [np.zeros_like(carry) for _ in range(votes.bit_length())]
            over = np.zeros_like(carry)
        for plane in planes:
            plane ^= carry
            carry = carry & ~plane
        over |= carry
    if over is None:
        raise ValueError("there are no bits")
    above, same = np.zeros_like(over), ~np.zeros_like(over)
    for i in reversed(range(len(planes))):
        if votes >> i & 1:
            same &= planes[i]
        else:
            above |= same & planes[i]
            same &= ~planes[i]
    return over | above | same


def search(indexed: DataFrame, forest: Forest, queries: DataFrame, k: int, search_part: float = SEARCH_PART, least_points: float = LEAST_POINTS, votes: int = VOTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query (id, vector)."""
    spark = indexed.sparkSession
    points = max(search_part * float(forest.sizes[0].sum()), least_points)
    sent_forest = spark.sparkContext.broadcast(forest)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent_forest.value.search(q, points) for q in _matrix(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], ["id", "vector", "visits"])

    planned = written(queries.mapInArrow(visit, "id long, vector array<double>, visits array<int>"), "queries")
    blocks = max(1, -(-planned.count() // QUERY_BLOCK))
    first = forest.firsts()
    parts: list[DataFrame] = []
    # The index is read once for each block of queries; a few blocks are one job, so that few are held at a time.
    for lo in range(0, blocks, JOB_BLOCKS):
        job: list[DataFrame] = []
        for n in range(lo, min(lo + JOB_BLOCKS, blocks)):
            own = planned.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n).toArrow()
            if own.num_rows:
                visits = own["visits"].combine_chunks()
                q = np.repeat(np.arange(own.num_rows), visits.value_lengths().to_numpy())
                visited = np.zeros((int(first[-1]), -(-own.num_rows // 8)), np.uint8)  # one bit a query: rows of bytes by leaf
                np.bitwise_or.at(visited, (visits.flatten().to_numpy(), q >> 3), (1 << (q & 7)).astype(np.uint8))
                block = spark.sparkContext.broadcast((own["id"].to_numpy(), _matrix(own["vector"].combine_chunks()), visited))
                job.append(indexed.mapInArrow(_block_search(block, first[:-1], k, votes), "query_id long, vec_id long, score double"))
        for i, p in enumerate(job):
            job[0] = p if i == 0 else job[0].union(p)
        if job:
            parts.append(written(job[0], "nearest") if blocks > JOB_BLOCKS else job[0])
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.union(p)
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = merged.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _block_search(block, first: np.ndarray, k: int, votes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, visited = block.value
        nearest = _Nearest(queries, ids, k)
        for whole in batches:
            for lo in range(0, whole.num_rows, VECTOR_BLOCK):
                b = whole.slice(lo, VECTOR_BLOCK)
                leaves = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1) + first
                chosen = at_least((visited[leaves[:, t]] for t in range(leaves.shape[1])), votes)
                allowed = np.unpackbits(np.ascontiguousarray(chosen.T), axis=0, count=len(ids), bitorder="little")
                own, x = b.column(0).to_numpy(), _matrix(b.column(1))
                for q in np.flatnonzero(allowed.any(1)):
                    nearest.offer(q, own, x, np.flatnonzero(allowed[q]))
        rows = [(int(q), i, d) for q, best in zip(ids, nearest.best, strict=True) for d, i in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(df: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, search_part: float = SEARCH_PART, least_points: float = LEAST_POINTS, votes: int = VOTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows where is_query holds, the k nearest other rows found."""
    vector = F.col(vector_column).cast("array<double>")
    rows = df.where(_valid(vector) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), vector.alias("vector"), is_query.alias("is_query"))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension = lengths[0].n
    rows = rows.where(F.size("vector") == dimension)
    vectors, queries = rows.select("id", "vector"), rows.where("is_query").select("id", "vector")
    forest = fit(vectors, dimension, trees, leaf, sample)
    indexed = written(index(vectors, forest), "index")
    found = written(search(indexed, forest, queries, k, search_part, least_points, min(votes, trees)), "found")
    enough = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = written(queries.join(enough, "id", "left_anti"), "short")
    if not short.limit(1).count():
        return found
    more = search(indexed, forest, short, k, least_points=float("inf"), votes=1)
    return found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").union(more)
