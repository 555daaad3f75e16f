"""Exact top-k inner-product search by ball trees.

Vectors are made integers by floor(scale * x). A shard is up to ``SHARD`` candidates of a task. Its ball tree halves the points
along the direction of widest spread down to leaves of ``LEAF`` points; a node knows its centre and radius. For a query q a
node's points have inner products of at most q.centre + |q| * radius. A shard's nodes are taken in order of that bound for a
block of queries at a time, and a node is passed by for every query whose current kth score exceeds the bound. The kth scores
are shared: leaves of a shard and the shards that a task holds share them, and all tasks start from the kth scores that a first
search over some ``PILOT`` candidates has found (scores of real rows, so a bound from below of each final kth score).

Nothing of this passes through the driver. Queries are a written table in blocks of at most ``QUERY_BLOCK`` rows, with their kth scores
so far, which a task a block makes for the first search. A search task gathers candidates of some ``HELD_BYTES`` and their trees,
then reads the blocks one by one from the shared folder; all that a task holds is bounded in bytes, however wide the vectors are.

Candidates are searched in rounds, each ``GROW`` times as many as those before it: after a round the kth scores are those of all
candidates so far, so of the next some k * ``GROW`` rows a query at most can be expected to reach them, whatever the number of
tasks, and tasks return what reaches them. Up to GROW * PILOT candidates are one round. Each candidate is read in one round.

Vectors with components so large that products might leave 64 bits (``LIMIT``) are multiplied in Python's whole numbers, apart from
the others. A score beyond a long counts as the largest or smallest long, with ties to the smaller vec_id.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; a query meets only vectors of
its own length; of several rows with a query's vec_id the least vector asks, and none of those rows is its candidate;
other repeated rows are candidates each; rows with a null vec_id ask nothing but are candidates, last among equal scores; ties go
to the smaller vec_id; components of any finite size take part.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, file_system, new_path

SCALE = 1024
LEAF = 64
QUERY_BLOCK = 4096
PILOT, GROW = 4096, 32
#: Candidates of a shard; bytes of candidates that a task holds together, and of queries or pilot candidates.
SHARD, HELD_BYTES, BLOCK_BYTES = 8192, 1 << 26, 1 << 25
#: Products of vectors whose components times the root of their number are below this fit 64 bits.
LIMIT = 2.0**30.5
NONE = np.iinfo(np.int64).min


class BallTree:
    """Points ordered so that each leaf is a run of rows; leaves with centre and radius, and the inner nodes above them."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        self.nodes: list[tuple[int, int, np.ndarray, float, int, int]] = []
        self._grow(x, 0, len(x), leaf)
        self.centre = np.stack([n[2] for n in self.nodes])
        self.radius = np.array([n[3] for n in self.nodes])

    def _grow(self, x: np.ndarray, lo: int, hi: int, leaf: int) -> int:
        own = x[self.order[lo:hi]]
        centre = own.mean(axis=0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
        me = len(self.nodes)
        self.nodes.append((lo, hi, centre, radius, -1, -1))
        if hi - lo > leaf and radius > 0:
            far = own[((own - centre) ** 2).sum(axis=1).argmax()]
            other = own[((own - far) ** 2).sum(axis=1).argmax()]
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(own @ (other - far), mid)]
            left = self._grow(x, lo, lo + mid, leaf)
            self.nodes[me] = (lo, hi, centre, radius, left, self._grow(x, lo + mid, hi, leaf))
        return me


class TopK:
    """Best k of each query so far: score falling, then place rising (candidates are placed in order of vec_id)."""

    def __init__(self, queries: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.floor = np.full(queries, NONE) if floor is None else floor
        self.score = np.full((queries, k), NONE)
        self.place = np.full((queries, k), np.iinfo(np.int64).max)

    def bound(self) -> np.ndarray:
        """What a new score must reach."""
        return np.maximum(self.floor, self.score[:, -1])

    def add(self, query: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        """score: queries x points; NONE for none."""
        s = np.concatenate((self.score[query], score), axis=1)
        v = np.concatenate((self.place[query], np.broadcast_to(place, score.shape)), axis=1)
        best = np.lexsort((v, ~s), axis=1)[:, : self.k]
        self.score[query], self.place[query] = np.take_along_axis(s, best, 1), np.take_along_axis(v, best, 1)


class Shard:
    """Candidates with their ball tree. x: whole numbers, as float64 where products stay exact there and as int64 otherwise."""

    def __init__(self, names: np.ndarray, known: np.ndarray, place: np.ndarray, x: np.ndarray):
        self.names, self.known, self.place, self.x = names, known, place, x
        self.tree = BallTree(x.astype(np.float64))

    def search(self, query_names: np.ndarray, q: np.ndarray, top: TopK) -> None:
        """Branch and bound for a block of queries."""
        tree, wide = self.tree, q.astype(np.float64)
        norm = np.sqrt((wide**2).sum(axis=1))
        reach = wide @ tree.centre.T + norm[:, None] * tree.radius
        reach += 1e-9 * (np.abs(reach) + norm[:, None] * (np.abs(tree.centre).max() + 1)) + 1e-6  # rounding must never lower a bound
        heap: list[tuple[float, int, np.ndarray]] = [(-float(reach[:, 0].max()), 0, np.arange(len(q)))]
        while heap:
            _, node, asked = heapq.heappop(heap)
            asked = asked[reach[asked, node] >= top.bound()[asked]]
            if not len(asked):
                continue
            lo, hi, _, _, left, right = tree.nodes[node]
            if left < 0:
                rows = tree.order[lo:hi]
                score = (q[asked] @ self.x[rows].T).astype(np.int64)
                score[(self.known[rows] & (self.names[rows] == query_names[asked][:, None])) | (score < top.bound()[asked][:, None])] = NONE
                some = (score > NONE).any(axis=1)
                if some.any():
                    top.add(asked[some], score[some], self.place[rows])
            else:
                for child in (left, right):
                    heapq.heappush(heap, (-float(reach[asked, child].max()), child, asked))


def _matrix(column: pa.ListArray, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _table(folder: str, columns: list[str], block: int | None = None) -> pa.Table:
    from pyarrow import parquet

    system, base = file_system(folder)
    return parquet.read_table(base if block is None else f"{base}/block={block}", filesystem=system, columns=columns, partitioning=None).combine_chunks()


@functools.lru_cache(maxsize=1)
def _block(folder: str, block: int, width: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """vec_ids, vectors and kth scores of a written block of queries; a worker keeps the last one."""
    rows = _table(folder, ["vec_id", "v", "floor"], block)
    return rows["vec_id"].to_numpy(), _matrix(rows["v"].combine_chunks(), width, kind), rows["floor"].to_numpy()


def _shards(ids: pa.Array, x: np.ndarray) -> list[Shard]:
    """Shards of the candidates, placed in order of vec_id, nulls last."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    names = ids.fill_null(0).to_numpy()
    place = np.empty(len(names), np.int64)
    place[np.lexsort((names, ~known))] = np.arange(len(names))
    return [Shard(names[at], known[at], place[at], x[at]) for at in (slice(i, i + SHARD) for i in range(0, len(names), SHARD))]


def _floors(pilot: str, width: int, kind: type, k: int):  # noqa: ANN202
    """kth scores of a block's queries among the pilot candidates."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if shards is None:
                rows = _table(pilot, ["vec_id", "v"])
                shards = _shards(rows["vec_id"].combine_chunks(), _matrix(rows["v"].combine_chunks(), width, kind)) if rows.num_rows else []
            top = TopK(batch.num_rows, k)
            for s in shards:
                s.search(batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), width, kind), top)
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("vec_id"), batch.column("v"), pa.array(top.bound())], ["block", "vec_id", "v", "floor"])

    return search


def _searcher(queries: str, blocks: list[int], width: int, kind: type, k: int):  # noqa: ANN202
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids = rows["vec_id"].combine_chunks()
            shards = _shards(ids, _matrix(rows["v"].combine_chunks(), width, kind))
            at = np.empty(len(ids), np.int64)
            at[np.concatenate([s.place for s in shards])] = np.arange(len(ids))
            for b in blocks:
                names, q, floor = _block(queries, b, width, kind)
                top = TopK(len(q), k, floor)
                for s in shards:
                    s.search(names, q, top)
                row, nth = np.nonzero(top.score > NONE)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(names[row]), ids.take(pa.array(at[top.place[row, nth]])), pa.array(top.score[row, nth])], ["query_id", "vec_id", "score"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if 8 * width * sum(b.num_rows for b in held) >= HELD_BYTES:
                    yield from done()
        if held:
            yield from done()

    return search


def _exact(queries: str, blocks: list[int], k: int):  # noqa: ANN202
    """Candidates (vec_id, d: whole numbers as doubles) against all queries in Python's whole numbers."""

    def whole(rows: pa.ListArray) -> list[np.ndarray]:
        top = np.finfo(float).max
        return [np.array([int(min(max(c, -top), top)) for c in r], object) for r in rows.to_pylist()]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column("vec_id").to_pylist(), whole(batch.column("d"))
            for b in blocks if ids else ():
                asked = _table(queries, ["vec_id", "d"], b)
                out = []
                for q, v in zip(asked["vec_id"].to_pylist(), whole(asked["d"].combine_chunks()), strict=True):
                    met = ((max(NONE + 1, min(-NONE - 1, int(v @ c))), i) for i, c in zip(ids, x, strict=True) if i != q)
                    out += [(q, i, s) for s, i in heapq.nsmallest(k, met, key=lambda m: (-m[0], m[1] is None, m[1] or 0))]
                yield pa.RecordBatch.from_pydict({n: pa.array([r[j] for r in out], pa.int64()) for j, n in enumerate(("query_id", "vec_id", "score"))})

    return search


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long), d (the same as doubles), width, large (d must be used); only whole vectors."""
    x = F.col(embedding).cast("array<double>")
    good = F.col(embedding).isNotNull() & (F.size(embedding) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # doubles from 2^53 on are whole numbers
    d = F.transform(x, lambda c: F.when(F.abs(c * scale) >= 2.0**53, c * scale).otherwise(F.floor(c * scale).cast("double")))
    out = rows.where(good).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"), d.alias("d"), F.size(embedding).alias("width"))
    return out.withColumn("large", F.array_max(F.transform("d", F.abs)) * F.sqrt("width") >= LIMIT)


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _search(candidates: DataFrame, asked: DataFrame, width: int, total: int, n: int, most: float, k: int, pilot_rows: int, grow: int) -> DataFrame:
    """query_id, vec_id, score: what may be among the k best, of candidates and queries of one width."""
    spark = candidates.sparkSession
    kind = np.float64 if most * most * width < 1 << 53 else np.int64
    fit = max(1, BLOCK_BYTES // (8 * width))  # rows that a block or the pilot may have
    place, whole = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)), 1 << 30
    share = min(whole, int(whole * min(pilot_rows, fit) / max(1, total)) + 1)
    pilot = new_path(spark, "pilot")
    candidates.where(place < share).limit(2 * min(pilot_rows, fit)).write.parquet(pilot)
    blocks = -(-n // min(QUERY_BLOCK, fit))
    block = F.pmod(F.xxhash64("vec_id", F.lit(b"block")), F.lit(blocks)).cast("int")
    dealt = asked.select(block.alias("block"), "vec_id", "v").repartition(blocks, "block").sortWithinPartitions("block")
    dealt.mapInArrow(_floors(pilot, width, kind, k), "block int, vec_id long, v array<long>, floor long").write.partitionBy("block").parquet(queries := new_path(spark, "queries"))
    read = lambda path: spark.read.schema("vec_id long, v array<long>, floor long, block int").parquet(path)
    numbers = sorted(r[0] for r in read(queries).select("block").distinct().collect())
    low, high, best = 0, max(share * grow, int(whole * pilot_rows * grow / max(1, total)) + 1), None
    while True:
        part = candidates.where((place >= low) & (place < high)) if low or high < whole else candidates
        found = part.mapInArrow(_searcher(queries, numbers, width, kind, k), "query_id long, vec_id long, score long")
        found = found if best is None else best.unionByName(found)
        if high >= whole:
            return found
        best = cut(_top(found, k).select("query_id", "vec_id", "score"), "best")
        reached = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "kth")
        rows = read(queries).join(reached, "vec_id", "left").select("vec_id", "v", F.greatest("floor", F.coalesce("kth", "floor")).alias("floor"), "block")
        rows.repartition(blocks, "block").write.partitionBy("block").parquet(queries := new_path(spark, "queries"))
        low, high = high, high * grow


def top_k(rows: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, pilot_rows: int = PILOT, grow: int = GROW) -> DataFrame:
    """query_id, rank, vec_id, score for every row that satisfies is_query (a condition on column vec_id), against all other rows."""
    spark = rows.sparkSession
    v = cut(integer_vectors(rows, vec_id, embedding, scale), "vectors")
    first = F.min(F.struct("d", "v", "large")).alias("x")
    asked = cut(v.where(is_query & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(first).select("vec_id", "x.*", F.size("x.v").alias("width")), "asked")
    largest = F.max(F.when(~F.col("large"), F.array_max(F.transform("d", lambda c: F.greatest(F.abs(c), F.lit(1.0))))))
    is_large = F.count_if("large")
    shape = v.groupBy("width").agg(F.count_if(~F.col("large")).alias("all"), largest.alias("most"), is_large.alias("large")).join(asked.groupBy("width").agg(F.count_if(~F.col("large")).alias("n"), F.count("*").alias("asked"), is_large.alias("large_asked")), "width").collect()  # one row for each length of vector
    out = spark.createDataFrame([], "query_id long, vec_id long, score long")
    for r in shape:
        of, q = v.where(F.col("width") == r["width"]), asked.where(F.col("width") == r["width"])
        if r["n"] and r["all"]:
            out = out.unionByName(_search(of.where(~F.col("large")).select("vec_id", "v"), q.where(~F.col("large")), r["width"], r["all"], r["n"], r["most"], k, pilot_rows, grow))
        # large vectors as candidates of all queries, the others as candidates of large queries
        for candidates, queries, n in ((of.where("large"), q, r["large"] and r["asked"]), (of.where(~F.col("large")), q.where("large"), r["all"] and r["large_asked"])):
            if n:
                blocks = -(-n // max(1, min(QUERY_BLOCK, BLOCK_BYTES // (32 * r["width"]))))
                dealt = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "d").repartition(blocks, "block")
                dealt.write.partitionBy("block").parquet(path := new_path(spark, "queries"))
                numbers = sorted(x[0] for x in spark.read.parquet(path).select("block").distinct().collect())
                out = out.unionByName(candidates.select("vec_id", "d").mapInArrow(_exact(path, numbers, k), "query_id long, vec_id long, score long"))
    return _top(out, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
