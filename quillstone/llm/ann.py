"""Approximate nearest neighbours by largest inner product, with a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE_ROWS``) and has about
4 n^(1/3) leaves, at most ``MOST_LEAVES``, so its broadcast is bounded; every
row is indexed in the leaf that descending by nearest centre leads to. A query
opens leaves best bin first: a priority queue holds the tree's open branches by
the largest inner product expected below them. How many leaves are opened is
calibrated: for a bounded sample of queries the true neighbours are found by
brute force over all rows, and visits are widened until they hold the wanted
share of those neighbours. A query whose leaves hold too few rows for its answer
opens more until they don't.

Rows and queries of a leaf meet in a grid of chunks, sized by counts, so that a
crowded leaf is many tasks of bounded memory. Of rows with equal vectors only
the k + 1 of smallest ids can be among anyone's k nearest; the others are put
aside beforehand, so a vector that very many rows share costs a few.

Defined cases: vectors that are null, zero, of another length than most, or hold
null or non-finite components take no part, as candidates or as queries; a row
with the query's id is its own; repeated rows count once; ties go to smaller ids;
an empty table, or none asked, gives no rows; only the id and the vector are
read, so that further columns clash with nothing.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SAMPLE_ROWS, MOST_LEAVES, BRANCHES = 16_384, 4_096, 8
#: Queries whose neighbours calibrate the visits, and the share of neighbours wanted.
CALIBRATION_QUERIES, RECALL = 200, 0.95
CHUNK_ROWS, CHUNK_QUERIES = 20_000, 4_000
#: How much of a branch's spread is added to its centre's inner product; calibration chooses.
SPREADS = (0.0, 0.3, 0.6)


def _matrix(column) -> np.ndarray:
    """Vectors packed as float64."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)


class Tree:
    """Nodes with centres and spreads; node 0 is the root."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 1):
        self.random = np.random.default_rng(seed)
        self.centers: list[np.ndarray] = []
        self.spreads: list[float] = []
        self.children: list[list[int]] = []
        self.leaf_of: list[int] = []
        self.leaves = 0
        self._grow(sample, max(1, len(sample) // max(1, leaves)))
        self.centers_ = np.array(self.centers)
        self.spreads_ = np.array(self.spreads)

    def _grow(self, rows: np.ndarray, most: int) -> int:
        node = len(self.centers)
        center = rows.mean(axis=0)
        self.centers.append(center)
        self.spreads.append(float(np.sqrt(((rows - center) ** 2).sum(axis=1)).mean()) if len(rows) else 0.0)
        self.children.append([])
        self.leaf_of.append(-1)
        if len(rows) > most:
            of = self._split(rows, min(BRANCHES, -(-len(rows) // most)))
            parts = [rows[of == c] for c in np.unique(of)]
            if len(parts) > 1:
                for part in parts:
                    self.children[node].append(self._grow(part, most))
                return node
        self.leaf_of[node] = self.leaves
        self.leaves += 1
        return node

    def _split(self, rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
        centers = rows[self.random.choice(len(rows), k, replace=False)]
        for _ in range(rounds):
            of = ((centers**2).sum(axis=1)[None] - 2 * rows @ centers.T).argmin(axis=1)
            for c in range(k):
                if (of == c).any():
                    centers[c] = rows[of == c].mean(axis=0)
        return of

    def assign(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(rows), dtype=np.int32)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, index = todo.pop()
            below = self.children[node]
            if not below:
                out[index] = self.leaf_of[node]
                continue
            centers = self.centers_[below]
            of = ((centers**2).sum(axis=1)[None] - 2 * rows[index] @ centers.T).argmin(axis=1)
            todo += [(below[c], index[of == c]) for c in np.unique(of).tolist()]
        return out

    def visits(self, queries: np.ndarray, most: int, spread: float, rows: np.ndarray | None = None, least: int = 0) -> list[list[int]]:
        """The first leaves that best-bin-first traversal opens for each query: so many, and more until they hold at least
        so many rows (rows: of each leaf)."""
        hopes = queries @ self.centers_.T + spread * np.sqrt((queries**2).sum(axis=1))[:, None] * self.spreads_[None]
        out = []
        for hope in hopes.tolist():
            heap, found, held = [(-hope[0], 0)], [], least if rows is None else 0
            while heap and (len(found) < most or held < least):
                _, node = heapq.heappop(heap)
                if self.children[node]:
                    for child in self.children[node]:
                        heapq.heappush(heap, (-hope[child], child))
                else:
                    found.append(self.leaf_of[node])
                    held += 0 if rows is None else int(rows[self.leaf_of[node]])
            out.append(found)
        return out


def _valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v): usable vectors as packed float64, of the most frequent length."""
    usable = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e")).where(
        "id is not null and e is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(e, x -> x <> 0)"
    )
    length = usable.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(batch.num_rows, -1) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in values], pa.binary())], names=["id", "v"])

    return usable.where(F.size("e") == (length[0]["n"] if length else 0)).mapInArrow(pack, "id long, v binary")


def _share(frame: DataFrame, rows: int, total: int, salt: int) -> DataFrame:
    """About rows of total rows, by a hash of their ids."""
    part = min(1.0, rows / max(1, total))
    return frame.where(F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1 << 30)) < int(part * (1 << 30)))


def _best(scores: np.ndarray, q: np.ndarray, x: np.ndarray, qid: np.ndarray, xid: np.ndarray, k: int) -> list[np.ndarray]:
    """Rows (query index, id, score) of each query's k best, scored pair by pair in one order of addition."""
    scores = np.where(qid[:, None] == xid[None], -np.inf, scores)
    if scores.shape[1] > k:
        low = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        low = np.full(len(scores), -np.inf)
    slack = 1e-9 * (1 + np.abs(low))
    at, of = np.nonzero((scores >= np.where(np.isfinite(low), low - slack, low)[:, None]) & np.isfinite(scores))
    exact = np.empty(len(at))
    for i in range(0, len(at), 50_000):
        exact[i : i + 50_000] = (q[at[i : i + 50_000]] * x[of[i : i + 50_000]]).sum(axis=1)
    order = np.lexsort((xid[of], -exact, at))
    at, of, exact = at[order], of[order], exact[order]
    nth = np.arange(len(at)) - np.searchsorted(at, at)
    keep = nth < k
    return [at[keep], xid[of[keep]], exact[keep]]


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, *, vec_id: str = "vec_id", embedding: str = "embedding",
    recall: float = RECALL, sample_rows: int = SAMPLE_ROWS, chunk_rows: int = CHUNK_ROWS, chunk_queries: int = CHUNK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, nearest first. A row with the query's id isn't its neighbour."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    alike = Window.partitionBy("v").orderBy("id")
    rows = common.durable(
        _valid(vectors, vec_id, embedding).withColumn("nth", F.dense_rank().over(alike)).where(F.col("nth") <= k + 1).dropDuplicates(["v", "id"]).select("id", "v")
    )
    asked = common.durable(_valid(queries, vec_id, embedding).dropDuplicates(["id", "v"]))
    n = rows.count()
    n_asked = asked.count()
    if not n or not n_asked:
        return spark.createDataFrame([], schema)

    sample = _share(rows, sample_rows, n, 1).select("v").limit(2 * sample_rows).toArrow()
    if not sample.num_rows:
        sample = rows.select("v").limit(1).toArrow()
    tree = Tree(_matrix(sample.column("v")), min(MOST_LEAVES, max(1, round(4 * n ** (1 / 3))), sample.num_rows))
    held = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield common.extended(batch, leaf=pa.array(held.value.assign(_matrix(batch.column(1))), pa.int32()))

    indexed = common.durable(rows.mapInArrow(assign, "id long, v binary, leaf int"))
    most, spread = _calibrated(indexed, asked, n_asked, tree, k, recall)
    # Sizes of leaves are bounded in number, and so are these collected counts.
    crowd = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}
    sizes = np.array([crowd.get(leaf, 0) for leaf in range(tree.leaves)], dtype=np.int64)

    def open_leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1_000):
                part = batch.slice(i, 1_000)
                yield common.extended(part, leaves=pa.array(held.value.visits(_matrix(part.column(1)), most, spread, sizes, k + 1), pa.list_(pa.int32())))

    visits = asked.mapInArrow(open_leaves, "id long, v binary, leaves array<int>").select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.explode("leaves").alias("leaf"))
    asking = {r["leaf"]: r["count"] for r in visits.groupBy("leaf").count().collect()}
    grid = {leaf: (-(-c // chunk_rows), -(-asking.get(leaf, 0) // chunk_queries)) for leaf, c in crowd.items() if asking.get(leaf)}
    of_rows = F.create_map(*[F.lit(x) for leaf, (a, _) in grid.items() for x in (leaf, a)])
    of_queries = F.create_map(*[F.lit(x) for leaf, (_, b) in grid.items() for x in (leaf, b)])
    chunk = lambda column, n: F.pmod(F.xxhash64(column), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = indexed.withColumn("a", F.element_at(of_rows, F.col("leaf"))).withColumn("b", F.element_at(of_queries, F.col("leaf"))).where("b is not null")
    left = left.select("leaf", "id", "v", chunk("id", F.col("a")).alias("i"), every(F.col("b")).alias("j"))
    right = visits.withColumn("a", F.element_at(of_rows, F.col("leaf"))).withColumn("b", F.element_at(of_queries, F.col("leaf"))).where("a is not null")
    right = right.select("leaf", "query_id", "q", every(F.col("a")).alias("i"), chunk("query_id", F.col("b")).alias("j"))

    def meet(x: pa.Table, q: pa.Table) -> pa.Table:
        out = [[], [], []]
        if x.num_rows and q.num_rows:
            points, xid = _matrix(x.column("v")), x.column("id").to_numpy()
            asks, qid = _matrix(q.column("q")), q.column("query_id").to_numpy()
            step = max(1, 2_000_000 // len(points))
            for i in range(0, len(asks), step):
                part, ids = asks[i : i + step], qid[i : i + step]
                at, found, score = _best(part @ points.T, part, points, ids, xid, k)
                for o, c in zip(out, (ids[at], found, score), strict=True):
                    o.append(c)
        columns = [np.concatenate(o) if o else np.zeros(0, dtype=t) for o, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    keys = ["leaf", "i", "j"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrated(indexed: DataFrame, asked: DataFrame, n_asked: int, tree: Tree, k: int, recall: float) -> tuple[int, float]:
    """How many leaves to visit, and the spread's weight, so that sampled queries get the wanted share of their true neighbours."""
    drawn = _share(asked, CALIBRATION_QUERIES, n_asked, 2).limit(2 * CALIBRATION_QUERIES).toArrow()
    if tree.leaves == 1 or not drawn.num_rows:
        return tree.leaves, 0.0
    asks, qid = _matrix(drawn.column("v")), drawn.column("id").to_numpy()
    held = indexed.sparkSession.sparkContext.broadcast((asks, qid))

    def truth(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, qid = held.value
        for batch in batches:
            for i in range(0, batch.num_rows, 5_000):
                part = batch.slice(i, 5_000)
                points, xid = _matrix(part.column(1)), part.column(0).to_numpy(zero_copy_only=False)
                leaf = dict(zip(xid.tolist(), part.column(2).to_pylist(), strict=True))
                at, found, score = _best(asks @ points.T, asks, points, qid, xid, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), pa.array(found, pa.int64()), pa.array(score, pa.float64()), pa.array([leaf[f] for f in found.tolist()], pa.int32())],
                    names=["query", "id", "score", "leaf"],
                )

    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    near = indexed.mapInArrow(truth, "query int, id long, score double, leaf int").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "leaf").toArrow()
    query, leaf = near.column("query").to_numpy(), near.column("leaf").to_numpy()
    choices = []
    for spread in SPREADS:
        place = np.empty((len(asks), tree.leaves), dtype=np.int64)
        for i, order in enumerate(tree.visits(asks, tree.leaves, spread)):
            place[i, order] = np.arange(1, len(order) + 1)
        needed = np.sort(place[query, leaf])
        choices.append((int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else tree.leaves, spread))
    return min(choices)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"), 20)


def brute_force(rows: list[tuple], asked: set, k: int) -> dict:
    """By scoring all pairs; for tests. Query id to its ids, nearest first."""
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in ok]), np.array([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i in asked:
            score = (x * v).sum(axis=1)
            order = np.lexsort((ids, -score))
            out[i] = [int(ids[o]) for o in order if ids[o] != i][:k]
    return out
