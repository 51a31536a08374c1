"""A stored cell index of vectors: retrieval reads the files of a few cells instead of all vectors.

build() fits centres on a bounded sample and writes every vector to the folder of its nearest centre's cell, beside 8-bit
codes of what remains after the centre, with their scale. A query opens the cells whose centres promise most, ranks their
codes, and takes exact scores of the few best from the vectors in those rows' cells. How many cells are opened is
calibrated when the index is built: sampled vectors are looked up by brute force, and cells are added until they hold the
wanted share of the true neighbours. With guaranteed=True all cells and codes are read whose bounds don't rule out a better
vector, so the result is that of a full scan.

add() puts new or changed vectors beside the old ones. With vectors given to search(), the index only chooses candidates
and scores come from these, so a vector that has changed is scored as it is now, and one that has gone is left out."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from quillstone.functions import scalars as S
from quillstone.tables import shared_dir

from . import retrieval

#: Vectors that centres are fitted on; cells at most; vectors that calibrate, their neighbours, and the share wanted.
SAMPLE_ROWS, MOST_CELLS = 20_000, 4_096
CALIBRATION_ROWS, CALIBRATION_NEIGHBOURS, RECALL = 100, 15, 0.97
#: Rows in one file of a cell; a crowded cell has several.
FILE_ROWS = 200_000
#: Candidates that get exact scores for each result wanted, and at least.
RERANKED, LEAST_RERANKED = 4, 64


def _schema(vectors: DataFrame) -> str:
    """Of the cells: vectors' own columns beside codes."""
    kinds = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name != "embedding"}
    own = kinds.pop("id")
    return ", ".join([own, "code array<tinyint>, scale double, reach double, embedding array<float>", *kinds.values(), "cell int"])


def _matrix(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)


def _centres(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    random = np.random.default_rng(11)
    centres = sample[random.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        of = _nearest_centre(sample, centres)
        sums, counts = np.zeros_like(centres), np.bincount(of, minlength=len(centres))
        np.add.at(sums, of, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
    return centres


def _usable(vectors: DataFrame) -> DataFrame:
    others = [c for c in vectors.columns if c not in ("id", "embedding")]
    return vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"), *others).where("id is not null and embedding is not null and size(embedding) > 0")


class VectorIndex:
    """The index at a path: centres and settings in memory (at most MOST_CELLS centres), cells in files."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = json.loads("".join(r[0] for r in spark.read.text(f"{self.path}/about").collect()))
        self.opened, self.schema = about["opened"], about["schema"]
        rows = sorted(spark.read.parquet(f"{self.path}/centres").collect(), key=lambda r: r["cell"])
        self.centres = np.array([r["centre"] for r in rows], dtype=np.float64).reshape(len(rows), -1)

    @property
    def cells(self) -> DataFrame:
        """(id, code, scale, reach, embedding, further columns, cell): reach is the distance from the centre."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/cells")

    def add(self, vectors: DataFrame) -> None:
        _write(vectors, self.centres, self.path, "append")

    def reaches(self) -> np.ndarray:
        """How far each cell's vectors are from its centre at most."""
        out = np.full(len(self.centres), -1.0)
        for r in self.cells.groupBy("cell").agg(F.max("reach").alias("reach")).collect():
            out[r["cell"]] = r["reach"]
        return out

    def coded(self, query: list[float], cells: list[int], where: Column | str = "true") -> DataFrame:
        """(id, cell, about, rounding) of the rows in some cells; only their files are read. A row's score differs from about
        by rounding at most."""
        q = np.asarray(query, dtype=np.float64)
        promise = F.create_map(*[F.lit(x) for c in cells for x in (c, float(self.centres[c] @ q))])
        about = F.element_at(promise, F.col("cell")) + F.col("scale") * S.dot(F.col("code"), F.array(*[F.lit(float(x)) for x in query]))
        # Half a step in each component.
        rounding = F.col("scale") * F.lit(0.5 * float(np.abs(q).sum())) + F.lit(1e-6)
        return self.cells.where(F.col("cell").isin(cells)).where(where).select("id", "cell", about.alias("about"), rounding.alias("rounding"))

    def search(self, query: list[float], n: int, min_score: float | None = None, *, guaranteed: bool = False, where: Column | str | None = None, vectors: DataFrame | None = None) -> DataFrame:
        """(id, score) of the n vectors (of unit length) with the largest cosine among those of the cells opened; with
        guaranteed, or a condition on the further columns (where), among all that are indexed. vectors: (id, embedding) as
        they are now."""
        guaranteed, where = guaranteed or where is not None, "true" if where is None else where
        q = np.asarray(query, dtype=np.float64)
        order = np.argsort(-(self.centres @ q), kind="stable").tolist()
        wanted = max(LEAST_RERANKED, RERANKED * n)
        # No more rows than wanted reach the driver; their cells' files are read again for the vectors.
        best = self.coded(query, order[: self.opened], where).orderBy(F.desc("about"), "id").limit(wanted).select("id", "cell").collect()
        rows = self.cells.where(F.col("cell").isin(sorted({r["cell"] for r in best})) & F.col("id").isin([r["id"] for r in best]))
        now = lambda rows: vectors.join(rows.select("id").distinct(), "id", "left_semi") if vectors is not None else rows.select("id", "embedding").distinct()
        if guaranteed:
            least = self._least(now(rows), query, n, min_score)
            reaches = self.reaches()
            most = self.centres @ q + float(np.sqrt(q @ q)) * np.maximum(reaches, 0) + 1e-6
            cells = [c for c in order if reaches[c] >= 0 and (least is None or most[c] >= least)]
            near = self.coded(query, cells, where)
            if least is not None:
                near = near.where(F.col("about") + F.col("rounding") >= least)
            rows = self.cells.where(F.col("cell").isin(cells)).join(near.select("id", "cell").distinct(), ["id", "cell"], "left_semi")
        return retrieval.nearest(now(rows), query, n, min_score)

    @staticmethod
    def _least(rows: DataFrame, query: list[float], n: int, min_score: float | None) -> float | None:
        """The score that a row must reach to be among the n best, as far as the first candidates tell."""
        scores = sorted((r["score"] for r in retrieval.nearest(rows, query, n).collect()), reverse=True)
        told = [x for x in (min_score, scores[n - 1] if len(scores) >= n else None) if x is not None]
        return max(told, default=None)


def _write(vectors: DataFrame, centres: np.ndarray, path: str, mode: str) -> None:
    rows = _usable(vectors)
    held = rows.sparkSession.sparkContext.broadcast(centres)

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            if not len(x):
                continue
            cell = _nearest_centre(x, held.value)
            rest = x - held.value[cell]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-300) / 127
            codes = np.rint(rest / scale[:, None]).astype(np.int8)
            lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32), pa.array(codes.ravel()))
            reach = np.sqrt((rest**2).sum(axis=1))
            kept = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, pa.array(scale), pa.array(reach), batch.column(1), *kept, pa.array(cell.astype(np.int32))],
                names=["id", "code", "scale", "reach", "embedding", *batch.schema.names[2:], "cell"],
            )

    same = rows.where(F.size("embedding") == centres.shape[1])
    made = same.mapInArrow(coded, _schema(rows).replace("embedding array<float>", "embedding array<double>")).withColumn("embedding", F.col("embedding").cast("array<float>"))
    # A cell's rows come together, so a cell has few files, in which ids are in order; adaptive execution splits a crowded one.
    made.hint("rebalance", "cell").sortWithinPartitions("cell", "id").write.mode(mode).option("maxRecordsPerFile", FILE_ROWS).partitionBy("cell").parquet(f"{path}/cells")


def build(vectors: DataFrame, path: str, cells: int | None = None, recall: float = RECALL) -> VectorIndex:
    """Writes the index of vectors (id, embedding, and columns that searches filter by) at path. Vectors that are null, or of another length than most, are
    left out; of repeated ids each is a candidate."""
    spark, path = vectors.sparkSession, path.rstrip("/")
    rows = _usable(vectors)
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    n, dimensions = (lengths[0]["count"], lengths[0]["n"]) if lengths else (0, 1)
    rows = rows.where(F.size("embedding") == dimensions)
    share = lambda most, salt: rows.where(F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1 << 30)) < int(min(1.0, most / max(1, n)) * (1 << 30))).limit(2 * most)
    sample = _matrix(share(SAMPLE_ROWS, 5).select("embedding").toArrow().column(0).combine_chunks()) if n else np.zeros((0, dimensions))
    if not len(sample):
        sample = _matrix(rows.limit(1).select("embedding").toArrow().column(0).combine_chunks()) if n else np.zeros((1, dimensions))
    centres = _centres(sample, cells or min(MOST_CELLS, max(1, round(2 * n**0.5) if n > 1_000 else n // 32)))
    _write(rows, centres, path, "overwrite")
    listed = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(listed, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    opened = _calibrated(rows, share(CALIBRATION_ROWS, 6), centres, recall) if n else 1
    about = json.dumps({"opened": opened, "schema": _schema(rows)})
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return VectorIndex(spark, path)


def _calibrated(rows: DataFrame, asked: DataFrame, centres: np.ndarray, recall: float) -> int:
    """How many cells to open so that sampled vectors find the wanted share of their true neighbours."""
    asks = _matrix(asked.select("embedding").toArrow().column(0).combine_chunks())
    if not len(asks) or len(centres) == 1:
        return 1
    held = rows.sparkSession.sparkContext.broadcast((asks, centres))

    def truth(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, centres = held.value
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                scores, cell = asks @ x.T, _nearest_centre(x, centres)
                k = min(CALIBRATION_NEIGHBOURS, len(x))
                at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(len(asks), dtype=np.int32), k)), pa.array(np.take_along_axis(scores, at, 1).ravel()), pa.array(cell[at].ravel().astype(np.int32))],
                    names=["ask", "score", "cell"],
                )

    best = Window.partitionBy("ask").orderBy(F.desc("score"), "cell")
    near = rows.select("embedding").mapInArrow(truth, "ask int, score double, cell int").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= CALIBRATION_NEIGHBOURS).select("ask", "cell").toArrow()
    place = np.argsort(np.argsort(-(asks @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.sort(place[near.column("ask").to_numpy(), near.column("cell").to_numpy()]) + 1
    return int(needed[int(np.ceil(recall * len(needed))) - 1])


def temporary(spark: SparkSession, vectors: DataFrame, **options) -> VectorIndex:
    """An index in the shared folder, for one application."""
    return build(vectors, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", **options)
