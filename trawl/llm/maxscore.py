"""Exact top-k by inner product with MaxScore, over shards of packed vectors.

A query's terms are its dimensions. Within a block of candidates each dimension has a least and a largest value, so
a term adds at most max(q x least, q x largest). Terms are ordered by how much they can move a score (the
difference of the two). The last terms whose bounds together stay below the k-th best score so far are not essential: no
candidate gets there by them alone. The columns (postings) of the essential terms are traversed for all candidates of the
block; the others are probed only for candidates that are still competitive, and candidates are given up as soon as
score so far + bound of the rest is below the k-th best. A block whose bounds all together stay below is skipped. Ties can't
be lost: only candidates strictly below are given up. A task passes the k-th best that a query has reached on to its next shard.

Vectors are packed into blocks of rows by a hash of their id. Query blocks meet candidate shards in a Cartesian product of
partitions: each task reads its shards and its group of query blocks from where they were written, so that queries are neither
broadcast nor copied through a shuffle, whatever their number and the session's broadcast threshold. Each pair
gives at most k rows for each query, and shards' results are merged by a windowed top-k, which Spark limits before
its shuffle. Work grows as queries times candidates, as an exact search over a stated query set must.

Vectors that are null, or hold null or non-finite components, take no part. Vectors meet only those with as many
components. Other columns are ignored, whatever their names. Null ids take no part. Rows with equal ids are separate candidates, but for the query's own id; as a query,
the least of their vectors is asked.
Scores beyond a long are held at its limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.cluster import ship, slices, staged

#: Candidates in a packed shard, queries in a packed block, candidates bounded together.
SHARD, QUERIES, BLOCK = 4096, 256, 1024
#: Bytes of queries that a task holds for each of its shards.
GROUP_BYTES = 32 << 20
#: Queries whose best scores a task remembers.
FLOORS = 1_000_000
_LONG = 1 << 63
PACKED = "dims int, shard bigint, ids binary, vectors binary"


def usable(vector: Column) -> Column:
    number = vector.cast("array<double>")
    return vector.isNotNull() & F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def quantised(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(vectors * scale)


def _exact(candidates: np.ndarray, query: np.ndarray) -> bool:
    """Whether float64 sums of the products are exact."""
    top = np.abs(candidates).max(initial=0) * np.abs(query).max(initial=0)
    return bool(top * max(1, len(query)) < 2**53)


def essential(up: np.ndarray, least: float) -> tuple[int, np.ndarray]:
    """(how many terms are essential, what the terms from each on can add at most); up: terms' bounds in their order."""
    rest = np.append(np.cumsum(up[::-1])[::-1], 0.0)
    below = rest < least
    below[:-1] &= np.logical_and.accumulate(below[::-1])[::-1][:-1]  # from there on all suffixes stay below
    return int(np.argmax(below)) if below[-1] else len(up), rest


def top_k(candidates: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, block: int = BLOCK, floor: float = -np.inf, visited: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int]]:
    """[(score, id)] of the k best rows of integer-valued float vectors, best first, ties to smaller ids, without rows of the id ``own``.

    floor: rows below needn't be found. visited: gets (essential terms, postings traversed, postings probed) of each block."""
    if not _exact(candidates, query):
        exact_query = [int(x) for x in query]
        scored = [(max(-_LONG, min(_LONG - 1, sum(int(a) * b for a, b in zip(row, exact_query, strict=True)))), i) for row, i in zip(candidates, ids.tolist(), strict=True) if i != own]
        return sorted(scored, key=lambda x: (-x[0], x[1]))[:k]
    best: list[tuple[int, int]] = []
    for at in range(0, len(ids), block):
        part, part_ids = candidates[at : at + block], ids[at : at + block]
        low, high = query * part.min(axis=0), query * part.max(axis=0)
        up = np.maximum(low, high)
        order = np.argsort(-(up - np.minimum(low, high)), kind="stable")
        least = max(floor, best[k - 1][0]) if len(best) >= k else floor
        term, rest = essential(up[order], least)
        if rest[0] < least:
            if visited is not None:
                visited.append((0, 0, 0))
            continue
        first, probed = order[:term], 0
        scores = part[:, first] @ query[first]
        alive = np.flatnonzero(part_ids != own)
        alive = alive[scores[alive] + rest[term] >= least]
        split = term
        while term < len(order) and len(alive):
            now = order[term : term + 16]
            scores[alive] += part[np.ix_(alive, now)] @ query[now]
            probed += len(alive) * len(now)
            term = min(term + 16, len(order))
            alive = alive[scores[alive] + rest[term] >= least]
        if visited is not None:
            visited.append((split, split * len(part_ids), probed))
        if len(alive):
            found = scores[alive]
            if len(alive) > 4 * k:
                cut = np.partition(found, len(found) - k)[len(found) - k]
                alive, found = alive[found >= cut], found[found >= cut]
            best = sorted([*best, *zip(found.astype(np.int64).tolist(), part_ids[alive].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
    return best


def packed(rows: DataFrame, size: int, shards: int) -> DataFrame:
    """rows: (id, vector). One row for each shard: ids and float64 components as bytes."""
    ship(rows.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list[int], list[np.ndarray]]] = {}

        def row(key: tuple[int, int]) -> pa.RecordBatch:
            ids, vectors = held.pop(key)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([np.concatenate(vectors).astype("<f8").tobytes()])], ["dims", "shard", "ids", "vectors"])

        for batch in slices(batches):
            for i, shard, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                values = vector.values.to_numpy(zero_copy_only=False)
                ids, vectors = held.setdefault((len(values), shard), ([], []))
                ids.append(i)
                vectors.append(values)
                if len(ids) >= size:
                    yield row((len(values), shard))
            while len(held) > 64:  # ragged vectors: no more than so many shards are open
                yield row(next(iter(held)))
        for key in list(held):
            yield row(key)

    dealt = rows.select("id", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.col("vector").cast("array<double>")).repartition(shards, "shard")
    return dealt.mapInArrow(pack, PACKED)


def search(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """Rows of ``vectors`` for which ``queries`` holds are the queries, all rows the candidates. Returns (query_id, rank, vec_id, score)."""
    spark = vectors.sparkSession
    ship(spark)
    clean = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    n, m, components = clean.select(F.count("*"), F.count(F.when(queries, 1)), F.coalesce(F.sum(F.when(queries, F.size(vector_col))), F.lit(0))).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    rows = lambda df: df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"))
    candidates = staged(packed(rows(clean), shard * 2, shards), "candidates")
    once = rows(clean.where(queries)).groupBy("id").agg(F.min("vector").alias("vector"))
    asked = staged(packed(once, block * 2, blocks), "queries")
    groups = max(1, -(-8 * components // GROUP_BYTES))
    asked = asked.select(F.col("dims").alias("q_dims"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")).coalesce(groups)
    alike = (F.col("dims") <= F.col("q_dims")) & (F.col("dims") >= F.col("q_dims"))  # not an equality, for which the join would be shuffled or broadcast
    pairs = candidates.join(asked.hint("shuffle_replicate_nl"), alike).select("dims", "ids", "vectors", "q_ids", "q_vectors")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, int] = {}  # of queries, the k-th best in shards that this task has seen
        for batch in slices(batches, 1):
            dims = batch.column(0)[0].as_py()
            ids, values, q_ids, q_values = (np.frombuffer(batch.column(c)[0].as_buffer(), t) for c, t in ((1, "<i8"), (2, "<f8"), (3, "<i8"), (4, "<f8")))
            own, wanted = quantised(values.reshape(len(ids), dims), scale), quantised(q_values.reshape(len(q_ids), dims), scale)
            order = np.argsort(-np.abs(own).sum(axis=1), kind="stable")  # large vectors first raise the k-th best early
            own, ids = own[order], ids[order]
            found = []
            for q, w in zip(q_ids.tolist(), wanted, strict=True):
                best = top_k(own, ids, w, q, k, floor=floors.get(q, -np.inf))
                if len(best) == k and len(floors) < FLOORS:
                    floors[q] = max(floors.get(q, best[-1][0]), best[-1][0])
                found += [(q, i, s) for s, i in best]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    scored = pairs.mapInArrow(score, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
