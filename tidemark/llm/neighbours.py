"""Nearest vectors by inner product through stable projections and a kd-tree.

Every row is indexed: distinct rows are dealt by hash into blocks of about ``BLOCK`` rows, and
each block builds its own index, a row of a written table.  Within a block one more coordinate
makes all vectors equally long, so that the largest inner product is the smallest distance.
Gaussian (2-stable) projections to ``PLANES`` dimensions are cut into a kd-tree; a query walks
its leaves in order of their distance in the projection and verifies their members on the
original vectors.  For a vector at distance d the squared projected distance over d squared is
chi-square with ``PLANES`` degrees of freedom, so the walk stops once the next leaf lies so far
off that a vector as near as the query's k-th best would have been met with probability
``SURE``.  The stated query set meets all blocks, block by block: an index stays in its task, and
the queries, a small part of the rows, are sent past it in packs.  Fewer than ``TASKS`` blocks are
copied until there are about so many tasks; more blocks are never copied.  The best of each block
are merged by a top-k window, which cuts in each task first.

Equal vectors form one class in a block, with its smallest keys, so a vector with any number
of copies costs one comparison and ties go to the smaller key.  Rows take no part if they are
null, zero, or hold null or non-finite components; rows equal in key and vector count once.
Vectors of different lengths are never compared.  A null key takes no part either.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.staging import stage

BLOCK, QUERIES, LEAF, PLANES, SURE, SEED = 16_384, 1024, 64, 8, 0.95, 7
#: Tasks which a search is spread over at least, and partitions it has at most.
TASKS, PARTITIONS = 32, 20_000
#: Leaves which a query looks at between two stopping tests.
WAVE = 16


def chi_square_quantile(p: float, freedom: int) -> float:
    """``freedom`` is even, so the distribution function is a finite sum."""

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Members of each leaf; nodes are halved at the median of their widest dimension."""
    leaves, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            leaves.append(own)
            continue
        spread = points[own].max(0) - points[own].min(0)
        order = own[np.argpartition(points[own, spread.argmax()], len(own) // 2)]
        todo += [order[: len(own) // 2], order[len(own) // 2 :]]
    return leaves


class BlockIndex:
    def __init__(self, keys: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((keys, *vectors.T[::-1]))
        keys, vectors = keys[order], vectors[order]
        new = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(1)])
        first = np.flatnonzero(new)
        sizes = np.minimum(np.diff(np.append(first, len(keys))), k + 1)
        at = np.repeat(first, sizes) + _count_up(sizes)
        classes = vectors[first]
        self.limit = math.sqrt(float((classes.astype(np.float64) ** 2).sum(1).max()))
        turned = np.random.default_rng(SEED).standard_normal((vectors.shape[1] + 1, PLANES))
        points = self._lift(classes.astype(np.float64)) @ turned
        leaves = kd_leaves(points)
        placed = np.concatenate(leaves)
        self.vectors = classes[placed]
        self.low = np.array([points[x].min(0) for x in leaves])
        self.high = np.array([points[x].max(0) for x in leaves])
        self.ends = np.cumsum([len(x) for x in leaves])
        starts = np.cumsum(sizes) - sizes
        # members of the classes, in the order of the leaves
        self.sizes = sizes[placed]
        self.keys = keys[at][np.repeat(starts[placed], self.sizes) + _count_up(self.sizes)]

    def _lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = self.limit**2 - (vectors**2).sum(1)
        return np.hstack([vectors, np.sqrt(np.maximum(rest, 0))[:, None]])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: v for n, v in vars(self).items()})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> BlockIndex:
        index = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as stored:
            for name in stored.files:
                setattr(index, name, stored[name])
        index.limit = float(index.limit)
        return index

    def search(self, own: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, key, score) of the ``k`` best of each query which have another key."""
        queries = vectors.astype(np.float64)
        scaled = queries * (self.limit / np.sqrt((queries**2).sum(1)))[:, None]
        turned = np.random.default_rng(SEED).standard_normal((queries.shape[1] + 1, PLANES))
        points = scaled @ turned[:-1]
        stored = self.vectors.astype(np.float64)
        gap = np.maximum(np.maximum(self.low[None] - points[:, None], points[:, None] - self.high[None]), 0)
        gap = np.einsum("qlm,qlm->ql", gap, gap)
        order = np.argsort(gap, axis=1, kind="stable")
        gap = np.take_along_axis(gap, order, 1)
        sure = chi_square_quantile(SURE, PLANES)
        keep = min(k + 1, len(stored))
        best = np.full((len(queries), keep), -np.inf)
        place = np.full((len(queries), keep), -1)
        active = np.arange(len(queries))
        for t in range(0, len(self.ends), WAVE):
            if t:
                far = 2 * self.limit * (self.limit - best[active].min(1))  # squared distance of the k-th best
                active = active[~(gap[active, t] >= sure * np.maximum(far, 0))]
            if not len(active):
                break
            leaf = order[active, t : t + WAVE]
            who, leaf = np.repeat(active, leaf.shape[1]), leaf.ravel()
            by_leaf = np.argsort(leaf, kind="stable")
            who, leaf = who[by_leaf], leaf[by_leaf]
            cuts = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1], [True]]))
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                some, end = who[low:high], self.ends[leaf[low]]
                start = self.ends[leaf[low] - 1] if leaf[low] else 0
                score = scaled[some] @ stored[start:end].T / self.limit
                better = (score > best[some].min(1)[:, None]).any(1)
                some, score = some[better], score[better]
                if not len(some):
                    continue
                every = np.hstack([best[some], score])
                at = np.hstack([place[some], np.broadcast_to(np.arange(start, end), score.shape)])
                top = np.argpartition(-every, keep - 1, axis=1)[:, :keep]
                best[some] = np.take_along_axis(every, top, 1)
                place[some] = np.take_along_axis(at, top, 1)
        query, cls = np.repeat(np.arange(len(queries)), keep), place.ravel()
        query, cls = query[cls >= 0], cls[cls >= 0]
        exact = inner_products(stored[cls], queries[query])
        starts, n = np.cumsum(self.sizes) - self.sizes, self.sizes[cls]
        query, exact = np.repeat(query, n), np.repeat(exact, n)
        keys = self.keys[np.repeat(starts[cls], n) + _count_up(n)]
        other = keys != own[query]
        query, exact, keys = query[other], exact[other], keys[other]
        ranked = np.lexsort((keys, -exact, query))
        query, exact, keys = query[ranked], exact[ranked], keys[ranked]
        first = np.arange(len(query)) - np.searchsorted(query, query) < k
        return query[first], keys[first], exact[first]


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added from the first component on: equal vectors score equally wherever they lie."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _count_up(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def usable(vector: Column) -> Column:
    """Not null, finite in all components, and not zero."""
    infinite = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def _packed(rows: DataFrame, number: int, pack, name: str) -> DataFrame:
    """Rows dealt into ``number`` blocks by hash; each packed into one row ``dim, name, data``."""
    schema = f"dim int, {name} int, data binary"

    def one(group: pa.Table) -> pa.Table:
        order = group.sort_by("vec_id")
        data = pack(order["vec_id"].to_numpy(), _matrix(order["vector"]))
        return pa.table(
            {"dim": pa.array([group["dim"][0].as_py()], pa.int32()), name: pa.array([group[name][0].as_py()], pa.int32()), "data": [data]}
        )

    place = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(number)).cast("int")
    return rows.withColumn(name, place).groupBy("dim", name).applyInArrow(one, schema)


def _dump(keys: np.ndarray, vectors: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, keys=keys, vectors=vectors)
    return out.getvalue()


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
    block: int = BLOCK, queries: int = QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row which ``is_query`` marks.

    ``is_query`` speaks of the column ``vec_id``.
    """
    body = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("vector"))
    fine = body.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    rows = stage(fine.distinct().withColumn("dim", F.size("vector")), "vectors")
    asked = rows.filter(is_query)
    n_rows, n_asked = rows.count(), asked.count()
    n_blocks, n_parts = max(1, -(-n_rows // block)), max(1, -(-n_asked // queries))

    index = _packed(rows, n_blocks, lambda ids, m: BlockIndex(ids, m, k).dump(), "block")
    built = stage(index, "vector-index")
    parts = stage(_packed(asked, n_parts, _dump, "part"), "vector-queries")
    lanes = min(n_parts, max(1, TASKS // n_blocks))  # copies of each index
    indexes = built.withColumn("part", F.lit(-1)).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    packs = parts.withColumn("lane", F.col("part") % lanes).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    place = (F.col("block").cast("bigint") * lanes + F.col("lane")) % PARTITIONS
    together = (
        indexes.unionByName(packs)
        .repartitionById(min(n_blocks * lanes, PARTITIONS), place.cast("int"))
        .sortWithinPartitions("dim", "block", "lane", "part")
        .select("dim", "block", "part", "data")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An index is followed by the packs it is asked for."""
        index, held = None, None
        for batch in batches:
            for dim, block, part, data in zip(*batch.columns, strict=True):
                home = dim.as_py(), block.as_py()
                if part.as_py() < 0:
                    index, held = BlockIndex.load(data.as_py()), home
                elif home == held:  # else no row of this length lies in the block
                    with np.load(io.BytesIO(data.as_py())) as stored:
                        own, wanted = stored["keys"], stored["vectors"]
                    query, found, score = index.search(own, wanted, k)
                    names, marks = ["query_id", "mark", "vec_id", "score"], _digest(wanted)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[query]), pa.array(marks[query]), pa.array(found), pa.array(score)], names=names
                    )

    found = together.mapInArrow(search, "query_id bigint, mark bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _digest(vectors: np.ndarray) -> np.ndarray:
    """Tells apart queries of one key with different vectors."""
    return np.array([xxhash.xxh64_intdigest(v.tobytes()) for v in vectors], np.uint64).view(np.int64)
