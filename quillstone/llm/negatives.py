"""Hard negatives: rows of another label whose score lies just under that of an anchor's best rows of its own label.

Components become integers (256 times the component, rounded down), so scores
are exact integer inner products. Every vector gets one more component that
brings all to the largest norm R, and an anchor's is 0; the squared distance of
an anchor a to a row is then |a|^2 + R^2 - 2 score. The highest scores are the
nearest rows, and a window of scores is an annulus around the anchor.

A vantage-point tree is fitted on a bounded sample (``SAMPLE_ROWS``, at most
``MOST_LEAVES`` leaves, so its broadcast is bounded). All rows go to its leaves,
and each node knows the exact range of its rows' distances to the vantage point
above it, so the triangle inequality bounds how near and how far a node's rows
can be to an anchor. Leaves are visited nearest first, from the annulus's inner
rim outwards, in two waves: a priority queue opens leaves until they hold
``FIRST_ROWS`` rows, and the k-th best row found there bounds the second wave,
which opens every leaf that may hold a better one. So the result is exact; how
many leaves that takes depends on the data, and in many dimensions without
clusters it is most of them.

Anchors of one vector and label ask once. Of the rows of one vector and label
only those of smallest ids can be among anyone's first, and the others are put
aside beforehand, so a vector that very many rows share costs a few. Rows and
blocks of anchors meet leaf by leaf in chunks of bounded size.

Defined cases: rows without an id, and rows whose label or vector is null, empty,
of another length than most, with null or non-finite components, or so large that
100 times a score may not fit a long, take no part; zero vectors do; repeated
rows (same id, label and vector) count once, and rows that share only an id are
rows of their own; ties go to smaller ids; anchors without positives, and
positives without negatives in their window, give no rows; empty tables give
none; only id, label and vector are read, so that further columns clash with
nothing.
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

POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these percentages of the positive's.
LOW, HIGH = 50, 95
SAMPLE_ROWS, MOST_LEAVES = 16_384, 4_096
#: Rows that the first wave's leaves hold at least.
FIRST_ROWS = 2_000
#: Rows of a leaf that meet in one task; anchors in a block; blocks that meet in one task.
CHUNK_ROWS, BLOCK_ROWS, BLOCKS = 20_000, 1_000, 16
_FAR = 1 << 62
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _ints(column) -> np.ndarray:
    """Packed vectors as a matrix of int64."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=np.int32).reshape(len(raw), -1).astype(np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products, exact."""
    most = lambda x: int(np.abs(x).max(initial=0))
    if a.shape[1] * most(a) * most(b) < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _usable(rows: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    return rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("e")).where(
        "id is not null and label is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )


def _packed(usable: DataFrame, length: int) -> DataFrame:
    """(id, label, v, norm): integer vectors packed, and their squared norms."""
    most = min(2**31 - 1, int(np.sqrt(2**63 / 100 / max(1, length))) - 1)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column(2).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(batch.num_rows, -1)
            with np.errstate(over="ignore"):
                values = np.floor(256 * values)
            fits = (np.abs(values) <= most).all(axis=1)
            ints = values[fits].astype(np.int32)
            keep = pa.array(fits)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array([v.tobytes() for v in ints], pa.binary()), pa.array((ints.astype(np.int64) ** 2).sum(axis=1))],
                names=["id", "label", "v", "norm"],
            )

    return usable.where(F.size("e") == length).mapInArrow(pack, "id long, label long, v binary, norm long")


class Tree:
    """Nodes of a vantage-point tree; node 0 is the root. lo and hi: the range of a node's rows' distances to the vantage
    point of the node above."""

    def __init__(self, sample: np.ndarray, leaves: int, radius2: int, seed: int = 1):
        self.radius2 = radius2
        self.random = np.random.default_rng(seed)
        self.points: list[np.ndarray] = []
        self.radii: list[float] = []
        self.children: list[tuple[int, int] | None] = []
        self.leaf_of: list[int] = []
        self.leaves = 0
        self._grow(self.lifted(sample), max(1, len(sample) // max(1, leaves)))
        self.lo, self.hi = np.full(len(self.children), np.inf), np.full(len(self.children), -np.inf)
        self.inner = [n for n, c in enumerate(self.children) if c]
        self.vantage = np.array([self.points[n] for n in self.inner]).reshape(len(self.inner), sample.shape[1] + 1)
        del self.points
        # Room for rounding in the last component and in square roots.
        self.slack = 1e-6 * (1 + np.sqrt(float(radius2)))

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        """rows with the component that brings them to the common norm."""
        rest = self.radius2 - (rows**2).sum(axis=1)
        return np.concatenate((rows.astype(np.float64), np.sqrt(rest.astype(np.float64))[:, None]), axis=1)

    @staticmethod
    def _distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
        squares = (rows**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None] - 2 * rows @ points.T
        return np.sqrt(np.maximum(squares, 0))

    def _grow(self, rows: np.ndarray, most: int) -> int:
        node = len(self.children)
        self.children.append(None)
        self.points.append(rows[:0].sum(axis=0))
        self.radii.append(0.0)
        self.leaf_of.append(-1)
        if len(rows) > most:
            tried = rows[self.random.choice(len(rows), min(8, len(rows)), replace=False)]
            far = self._distances(rows, tried)
            best = int(far.std(axis=0).argmax())
            far, self.points[node] = far[:, best], tried[best]
            self.radii[node] = float(np.median(far))
            inside = far <= self.radii[node]
            if not inside.all():
                self.children[node] = (self._grow(rows[inside], most), self._grow(rows[~inside], most))
                return node
        self.leaf_of[node] = self.leaves
        self.leaves += 1
        return node

    def assign(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The leaf of each row, and for each node the least and the greatest distance of its rows to the vantage point above."""
        lifted = self.lifted(rows)
        out, lo, hi = np.zeros(len(rows), dtype=np.int32), np.full(len(self.children), np.inf), np.full(len(self.children), -np.inf)
        place = {n: i for i, n in enumerate(self.inner)}
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, index = todo.pop()
            if not self.children[node]:
                out[index] = self.leaf_of[node]
                continue
            far = self._distances(lifted[index], self.vantage[place[node]][None])[:, 0]
            inside = far <= self.radii[node]
            for child, part in zip(self.children[node], (inside, ~inside), strict=True):
                if part.any():
                    lo[child], hi[child] = far[part].min(), far[part].max()
                    todo.append((child, index[part]))
        return out, lo, hi

    def bounds(self, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How near and how far the rows of each node (columns) can be to each ask (rows)."""
        far = self._distances(np.concatenate((asks.astype(np.float64), np.zeros((len(asks), 1))), axis=1), self.vantage) if self.inner else np.zeros((len(asks), 0))
        near, most = np.zeros((len(asks), len(self.children))), np.full((len(asks), len(self.children)), np.inf)
        for i, node in enumerate(self.inner):
            for child in self.children[node]:
                near[:, child] = np.maximum(near[:, node], np.maximum(far[:, i] - self.hi[child], self.lo[child] - far[:, i]) - self.slack)
                most[:, child] = np.minimum(most[:, node], far[:, i] + self.hi[child] + self.slack)
        return near, most

    def nearest_first(self, near: list[float], most: list[float], inner: float, outer: float) -> Iterator[int]:
        """The leaves that may hold rows between inner and outer, in the order of how near these can be."""
        heap = [(max(near[0], inner), 0)]
        while heap:
            least, node = heapq.heappop(heap)
            if least > outer or most[node] < inner:
                continue
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (max(near[child], inner), child))
            else:
                yield self.leaf_of[node]


def _rims(norms: np.ndarray, radius2: int, high: np.ndarray, low: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Windows of scores (asks x windows) as distances."""
    base = (norms + radius2).astype(np.float64)[:, None]
    far = lambda score: np.sqrt(np.maximum(base - 2 * score.astype(np.float64), 0))
    return far(high) - slack, far(low) + slack


def _first(scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best scores among those that fit; ties to smaller ids."""
    if fits.sum() > 16 * k * len(fits) and fits.shape[1] > k:
        masked = np.where(fits, scores, -_FAR)
        fits = fits & (masked >= np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k][:, None])
    at, of = np.nonzero(fits)
    order = np.lexsort((ids[of], -scores[at, of], at))
    at, of = at[order], of[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], of[keep]


class Index:
    """All rows in the leaves of a tree."""

    def __init__(self, rows: DataFrame, n: int, radius2: int):
        """rows: (id, label, v, norm), each once, n in all."""
        spark = rows.sparkSession
        part = min(1.0, SAMPLE_ROWS / n)
        sample = rows.where(F.pmod(F.xxhash64(F.lit(3), "id", "v"), F.lit(1 << 30)) < int(part * (1 << 30))).select("v").limit(2 * SAMPLE_ROWS).toArrow()
        if not sample.num_rows:
            sample = rows.select("v").limit(1).toArrow()
        # Leaves hold some 8 sqrt(n) rows: so many more rows, so many more leaves and larger ones.
        self.tree = tree = Tree(_ints(sample.column("v")), min(MOST_LEAVES, sample.num_rows, int(np.ceil(np.sqrt(n) / 8))), radius2)
        held = spark.sparkContext.broadcast(tree)

        def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield common.extended(batch, leaf=pa.array(held.value.assign(_ints(batch.column(2)))[0], pa.int32()))

        def ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nodes = len(held.value.children)
            lo, hi, count = np.full(nodes, np.inf), np.full(nodes, -np.inf), np.zeros(held.value.leaves, dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    leaf, low, high = held.value.assign(_ints(batch.column(0)))
                    lo, hi, count = np.minimum(lo, low), np.maximum(hi, high), count + np.bincount(leaf, minlength=len(count))
            counts = np.zeros(nodes, dtype=np.int64)
            counts[[n for n in range(nodes) if held.value.leaf_of[n] >= 0]] = count[[x for x in held.value.leaf_of if x >= 0]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(nodes)), pa.array(lo), pa.array(hi), pa.array(counts)], names=["node", "lo", "hi", "rows"])

        self.rows = common.durable(rows.select("id", "label", "v").mapInArrow(assign, "id long, label long, v binary, leaf int"))
        # As many rows as the tree has nodes.
        self.count = np.zeros(tree.leaves, dtype=np.int64)
        for r in self.rows.select("v").mapInArrow(ranges, "node long, lo double, hi double, rows long").groupBy("node").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("rows").alias("rows")).collect():
            tree.lo[r["node"]], tree.hi[r["node"]] = r["lo"], r["hi"]
            if tree.leaf_of[r["node"]] >= 0:
                self.count[tree.leaf_of[r["node"]]] = r["rows"]

    def nearest(self, asks: DataFrame, n_asks: int, k: int, same: bool) -> DataFrame:
        """(ask, slot, rank, id, score, equal): for each ask (ask, label, v, norm, high, low: arrays of the windows' scores)
        and window the k rows of highest score, of the ask's label or of others; equal: of the ask's own vector."""
        first = self._wave(asks, n_asks, k, same, FIRST_ROWS)
        reached = first.where(F.col("rank") == k).groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("reached"))
        # What the k-th row found reaches is the least score still wanted.
        bounded = asks.join(reached, "ask", "left").withColumn("low", F.expr("transform(low, (x, i) -> greatest(x, coalesce(reached[i], x)))")).drop("reached")
        return self._wave(common.durable(bounded), n_asks, k, same, None)

    def _wave(self, asks: DataFrame, n_asks: int, k: int, same: bool, enough: int | None) -> DataFrame:
        tree, counts = self.tree, self.count
        held = asks.sparkSession.sparkContext.broadcast(tree)
        blocks = -(-n_asks // BLOCK_ROWS)
        groups = -(-blocks // BLOCKS)

        def visits(table: pa.Table) -> pa.Table:
            tree = held.value
            vectors, norms = _ints(table.column("v")), table.column("norm").to_numpy()
            high, low = (np.array(table.column(c).to_pylist(), dtype=np.int64).reshape(len(vectors), -1) for c in ("high", "low"))
            near, most = tree.bounds(vectors)
            inner, outer = _rims(norms, tree.radius2, high, low, tree.slack)
            asked: dict[int, list[int]] = {}
            if enough is None:
                at_leaf = [n for n, leaf in enumerate(tree.leaf_of) if leaf >= 0]
                for node in at_leaf:
                    opened = ((near[:, node][:, None] <= outer) & (most[:, node][:, None] >= inner) & (high >= low)).any(axis=1)
                    asked[tree.leaf_of[node]] = np.flatnonzero(opened).tolist()
            else:
                for i, (a, b) in enumerate(zip(near.tolist(), most.tolist(), strict=True)):
                    leaves = set()
                    for s in np.flatnonzero(high[i] >= low[i]).tolist():
                        rows = 0
                        for leaf in tree.nearest_first(a, b, inner[i, s], outer[i, s]):
                            leaves.add(leaf)
                            rows += counts[leaf]
                            if rows >= enough:
                                break
                    for leaf in leaves:
                        asked.setdefault(leaf, []).append(i)
            asked = {leaf: np.array(at, dtype=np.int64) for leaf, at in sorted(asked.items()) if len(at) and counts[leaf]}
            ids, labels = table.column("ask").to_numpy(), table.column("label").to_numpy()
            packed = vectors.astype(np.int32)
            raw = [pa.array([x[at].tobytes() for at in asked.values()], pa.binary()) for x in (ids, labels, packed, high, low)]
            block = pa.array([table.column("block")[0].as_py()] * len(asked), pa.int32())
            return pa.table([pa.array(list(asked), pa.int32()), block, *raw], names=["leaf", "block", "asks", "labels", "vs", "highs", "lows"])

        sent = asks.withColumn("block", F.pmod(F.xxhash64("ask"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(
            visits, "leaf int, block int, asks binary, labels binary, vs binary, highs binary, lows binary"
        )
        chunks = F.element_at(F.array(*[F.lit(max(1, -(-int(c) // CHUNK_ROWS))) for c in counts]), F.col("leaf") + 1)
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = self.rows.select("leaf", F.pmod(F.xxhash64("id", "label"), chunks).cast("int").alias("i"), every(F.lit(groups)).alias("j"), "id", "label", "v")
        right = sent.withColumn("i", every(chunks)).withColumn("j", (F.col("block") % groups).cast("int"))

        def meet(x: pa.Table, q: pa.Table) -> pa.Table:
            out: list[list[np.ndarray]] = [[] for _ in range(5)]
            if x.num_rows and q.num_rows:
                points, ids, labels = _ints(x.column("v")), x.column("id").to_numpy(), x.column("label").to_numpy()
                step = max(1, 2_000_000 // len(points))
                for row in q.select(["asks", "labels", "vs", "highs", "lows"]).to_pylist():
                    asked, own = np.frombuffer(row["asks"], dtype=np.int64), np.frombuffer(row["labels"], dtype=np.int64)
                    vectors = np.frombuffer(row["vs"], dtype=np.int32).reshape(len(asked), -1).astype(np.int64)
                    high, low = (np.frombuffer(row[c], dtype=np.int64).reshape(len(asked), -1) for c in ("highs", "lows"))
                    for a in range(0, len(asked), step):
                        part = slice(a, a + step)
                        scores = _products(vectors[part], points)
                        of_label = (own[part][:, None] == labels[None]) == same
                        for slot in range(high.shape[1]):
                            at, of = _first(scores, of_label & (scores <= high[part, slot][:, None]) & (scores >= low[part, slot][:, None]), ids, k)
                            equal = (points[of] == vectors[part][at]).all(axis=1)
                            for o, c in zip(out, (asked[part][at], np.full(len(at), slot), ids[of], scores[at, of], equal), strict=True):
                                o.append(c)
            kinds = (np.int64, np.int32, np.int64, np.int64, np.bool_)
            return pa.table([pa.array(np.concatenate(o).astype(t) if o else np.zeros(0, dtype=t)) for o, t in zip(out, kinds, strict=True)], names=["ask", "slot", "id", "score", "equal"])

        keys = ["leaf", "i", "j"]
        met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "ask long, slot int, id long, score long, equal boolean")
        best = Window.partitionBy("ask", "slot").orderBy(F.desc("score"), "id")
        return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor, one of vectors' rows,
    and each of its first positives, the first negatives with low % to high % of the positive's score."""
    spark = vectors.sparkSession
    usable = _usable(vectors, vec_id, embedding, label)
    length = usable.groupBy(F.size("e").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not length:
        return spark.createDataFrame([], RESULT)
    alike = Window.partitionBy("label", "v").orderBy("id")
    rows = common.durable(
        _packed(usable, length[0]["n"]).withColumn("nth", F.dense_rank().over(alike)).where(F.col("nth") <= positives + 1).dropDuplicates(["label", "v", "id"]).drop("nth")
    )
    n, radius2 = rows.agg(F.count("*"), F.max("norm")).first()
    asking = common.durable(_packed(_usable(anchors, vec_id, embedding, label), length[0]["n"]).dropDuplicates(["id", "label", "v"]))
    asks = common.durable(asking.select("label", "v", "norm").distinct().withColumn("ask", F.monotonically_increasing_id()))
    n_asks = asks.count()
    if not n or not n_asks:
        return spark.createDataFrame([], RESULT)
    # Scores between anchors and rows stay below the larger squared norm; an anchor is one of the rows.
    index = Index(rows, n, max(radius2, asks.agg(F.max("norm")).first()[0]))
    any_score = asks.withColumn("high", F.array(F.lit(_FAR))).withColumn("low", F.array(F.lit(-_FAR)))
    found = index.nearest(any_score, n_asks, positives + 1, same=True)
    best = common.durable(found.groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "equal"))).alias("best")))
    windows = (
        asks.join(best, "ask").withColumn("scores", F.array_distinct("best.score")).drop("best")
        .withColumn("scores", F.concat("scores", F.array_repeat(F.lit(None).cast("long"), F.lit(positives + 1) - F.size("scores"))))
        .withColumn("high", F.expr(f"transform(scores, x -> coalesce(cast(floor({high} * x / 100.0BD) as long), {-_FAR}))"))
        .withColumn("low", F.expr(f"transform(scores, x -> coalesce(cast(ceil({low} * x / 100.0BD) as long), {_FAR}))"))
    )
    windows = common.durable(windows)
    under = index.nearest(windows.drop("scores"), n_asks, negatives, same=False).join(windows.select("ask", "scores"), "ask").select(
        "ask", F.element_at("scores", F.col("slot") + 1).alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    # An anchor isn't its own positive.
    own = (
        asking.join(asks, ["label", "v"]).select(F.col("id").alias("anchor_id"), "ask").join(best, "ask")
        .select("anchor_id", "ask", F.explode(F.slice(F.filter("best", lambda x: ~((x["id"] == F.col("anchor_id")) & x["equal"])), 1, positives)).alias("p"))
        .select("anchor_id", "ask", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    )
    return own.join(under, ["ask", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.expr("case when vec_id % 7 = 0 then (cast(label as long) + 1) % 10 else cast(label as long) end").alias("label")
    )
    return mine(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scores as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0
),
positives as (select * from scores where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select p.anchor_id, p.other as positive_id, (row_number() over (partition by p.anchor_id, p.other order by s.score desc, s.other))::int as rank,
  s.other as negative_id, p.score as positive_score, s.score as negative_score
from positives p join scores s on s.anchor_id = p.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
qualify row_number() over (partition by p.anchor_id, p.other order by s.score desc, s.other) <= 3
"""
