"""Statistics, duplicates, staleness, quality and merging of entries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import scalars as S
from quillstone.tables import durable

from .search import in_project

NO_PROJECT = "(no project)"
SEPARATOR = "\n\n---\n\n"
#: Rows of one block of the similarity join; two blocks meet in a task.
BLOCK_ROWS = 4_096
#: Products held at once while two blocks meet, and pairs whose scores are worked out at once.
MET, SCORED = 1_000_000, 50_000
#: Cells of the similarity join at most.
MOST_PIVOTS = 1_024


def count_by_project(entries: DataFrame) -> DataFrame:
    """Null and empty projects count together."""
    named = F.coalesce(F.when(F.col("project") != "", F.col("project")), F.lit(NO_PROJECT))
    return entries.groupBy(named.alias("project")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "project")


def most_used(entries: DataFrame, n: int = 5) -> DataFrame:
    return entries.orderBy(F.desc("usage_count"), "id").limit(n)


def newest(entries: DataFrame, n: int = 5) -> DataFrame:
    return entries.orderBy(F.desc("created"), "id").limit(n)


def latest_used(entries: DataFrame, n: int = 5) -> DataFrame:
    return entries.where("last_used is not null").orderBy(F.desc("last_used"), "id").limit(n)


def stats(entries: DataFrame) -> dict[str, DataFrame]:
    brief = entries.select("id", "title", "project", "usage_count", "created", "last_used")
    return {
        "total": entries.agg(F.count("*").alias("n")), "by_project": count_by_project(entries),
        "most_used": most_used(brief), "recently_added": newest(brief), "recently_used": latest_used(brief),
    }


def stale(entries: DataFrame, now, days: int = 90, project: str | None = None) -> DataFrame:
    """Entries neither used nor changed for so many days, the longest first, with days_stale."""
    at = F.lit(now).cast("timestamp_ntz")
    cutoff = at - F.make_dt_interval(F.lit(days))
    used = F.col("last_used").isNotNull() & (F.col("last_used") < cutoff) & (F.col("updated_at") < cutoff)
    never = F.col("last_used").isNull() & (F.coalesce("updated_at", "created") < cutoff)
    active = F.coalesce("last_used", "updated_at", "created")
    found = in_project(entries, project).where(used | never)
    return found.withColumn("days_stale", S.days_between(at, active)).orderBy(active, "id")


def quality(entries: DataFrame, low: int | None = None, high: int | None = None, project: str | None = None) -> DataFrame:
    """Entries with score (0 to 100), the lowest first."""
    found = in_project(entries, project).withColumn("score", S.quality(F.col("tags"), F.col("description"), F.col("content"), F.col("usage_count")))
    if low is not None:
        found = found.where(F.col("score") >= low)
    if high is not None:
        found = found.where(F.col("score") <= high)
    return found.orderBy("score", "id")


def exact_duplicates(entries: DataFrame) -> DataFrame:
    """(content_hash, n, first_id) of contents that several entries have."""
    h = S.content_hash(F.col("title"), F.col("description"), F.col("content"))
    return entries.groupBy(h.alias("content_hash")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def _packed(vectors: DataFrame) -> DataFrame:
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.asarray(v, dtype=np.float64).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["id", "v"])

    return vectors.select(F.col("id").cast("long").alias("id"), "embedding").where("embedding is not null").mapInArrow(pack, "id long, v binary")


class MetricJoin:
    """All pairs of vectors (id, embedding of unit length) that are at least so similar, by an exact join in metric cells.

    Vectors that are equal are one row (members()), so copies cost no pairs. Pivots are drawn from the rows, at most
    MOST_PIVOTS. Each row lies in the cell of its nearest pivot and is copied to those further cells, of higher number, that
    the triangle inequality doesn't rule out: to which the plane between both pivots is near enough, and whose rows reach far
    enough. So every pair within the distance meets in one cell. A crowded cell is split into blocks, and every two blocks of
    it that need to meet do so in a task of bounded size."""

    def __init__(self, vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS, pivots: int | None = None):
        self.threshold, self.block_rows = threshold, block_rows
        self.packed = durable(_packed(vectors))
        rows = durable(self.packed.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")))
        self.rows, count = rows, rows.count()
        self.copies_a_row = 0.0
        # Of unit vectors the squared distance is two less twice the cosine.
        self.reach = max(0.0, 2 - 2 * threshold) ** 0.5
        wanted = pivots or min(MOST_PIVOTS, max(1, round((count / 50) ** 0.5)))
        share = int(min(1.0, 2.0 * wanted / max(1, count)) * (1 << 30))
        drawn = rows.where(F.pmod(F.xxhash64(F.lit(9), "v"), F.lit(1 << 30)) < share).orderBy("id").limit(wanted).select("v").toArrow().column("v").to_pylist()
        self.pivots = np.frombuffer(b"".join(drawn), dtype=np.float64).reshape(len(drawn), -1) if drawn else None

    def members(self) -> DataFrame:
        """(id, representative): of equal vectors the smallest id stands for all."""
        return self.packed.join(self.rows.select("v", F.col("id").alias("representative")), "v").select("id", "representative")

    def _cells(self) -> DataFrame:
        """(id, v, cell, own): rows in their own cell, and their copies in others."""
        if self.pivots is None:
            return self.rows.select("id", "v", F.lit(0).alias("cell"), F.lit(True).alias("own"))
        held, reach = self.rows.sparkSession.sparkContext.broadcast(self.pivots), self.reach + 1e-6

        def distances(batch: pa.RecordBatch) -> np.ndarray:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.float64).reshape(batch.num_rows, -1)
            p = held.value
            return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None] - 2 * x @ p.T, 0))

        def widths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.full(len(held.value), -1.0)
            for batch in batches:
                for part in (batch.slice(i, 5_000) for i in range(0, batch.num_rows, 5_000)):
                    far = distances(part)
                    np.maximum.at(out, far.argmin(axis=1), far.min(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["cell", "width"])

        # As many rows as pivots.
        width = np.full(len(self.pivots), -1.0)
        for r in self.rows.select("id", "v").mapInArrow(widths, "cell int, width double").groupBy("cell").agg(F.max("width").alias("width")).collect():
            width[r["cell"]] = r["width"]

        def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = held.value
            apart = np.sqrt(np.maximum((p**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None] - 2 * p @ p.T, 1e-18))
            for batch in batches:
                for part in (batch.slice(i, 2_000) for i in range(0, batch.num_rows, 2_000)):
                    far = distances(part)
                    home = far.argmin(axis=1)
                    least = far[np.arange(len(home)), home]
                    plane = (far**2 - (least**2)[:, None]) / (2 * apart[home])
                    near = (plane <= reach) & (far <= width[None] + reach) & (width[None] >= 0) & (np.arange(len(p))[None] > home[:, None])
                    near[np.arange(len(home)), home] = True
                    row, cell = np.nonzero(near)
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(cell.astype(np.int32)), pa.array(cell == home[row])], names=["id", "v", "cell", "own"])

        return self.rows.select("id", "v").mapInArrow(deal, "id long, v binary, cell int, own boolean")

    def pairs(self) -> DataFrame:
        """(a, b, similarity), a < b, of representatives."""
        cells = durable(self._cells())
        sizes = {r["cell"]: (r["own"], r["all"]) for r in cells.groupBy("cell").agg(F.count_if("own").alias("own"), F.count("*").alias("all")).collect()}
        rows = sum(own for own, _ in sizes.values())
        self.copies_a_row = (sum(n for _, n in sizes.values()) - rows) / max(1, rows)
        blocks = lambda n: -(-n // self.block_rows)
        if not sizes:
            return cells.sparkSession.createDataFrame([], "a long, b long, similarity double")
        grid = F.create_map(*[F.lit(x) for cell, (own, n) in sizes.items() for x in (cell, F.struct(F.lit(blocks(own)).alias("own"), F.lit(blocks(n - own)).alias("copies")))])
        dealt = cells.withColumn("grid", F.element_at(grid, F.col("cell")))
        # Blocks of own rows have numbers from 0 on, blocks of copies from -1 down: these meet blocks of own rows only.
        block = F.when(F.col("own"), F.pmod(F.xxhash64("id"), F.greatest("grid.own", F.lit(1)))).otherwise(-1 - F.pmod(F.xxhash64("id"), F.greatest("grid.copies", F.lit(1)))).cast("int")
        dealt = dealt.withColumn("block", block)
        others = F.sequence(F.when(F.col("own"), -F.col("grid.copies")).otherwise(0), F.col("grid.own") - 1)
        met = dealt.select("id", "v", "cell", "block", F.explode(others).alias("other"))
        met = met.select("id", "v", "cell", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
        threshold = self.threshold

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(list(batches))
            ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
            x = np.frombuffer(b"".join(table.column("v").to_pylist()), dtype=np.float64).reshape(len(ids), -1)
            lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
            del table
            left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            others, strip = x[right], max(1, MET // max(1, len(right)))
            # A strip of rows at a time, so that memory is bounded even where all are similar to all.
            for i in range(0, len(left), strip):
                at, of = np.nonzero(x[left[i : i + strip]] @ others.T >= threshold - 1e-9)
                at, of = left[i + at], right[of]
                keep = ids[at] < ids[of] if lo == hi else np.ones(len(at), dtype=bool)
                at, of = at[keep], of[keep]
                for j in range(0, len(at), SCORED):
                    p, q = at[j : j + SCORED], of[j : j + SCORED]
                    score = (x[p] * x[q]).sum(axis=1)
                    keep = score >= threshold
                    a, b = np.minimum(ids[p], ids[q])[keep], np.maximum(ids[p], ids[q])[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score[keep])], names=["a", "b", "similarity"])

        return met.groupBy("cell", "lo", "hi").applyInArrow(meet, "a long, b long, similarity double")


def similar_pairs(vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, similarity), a < b, of all vectors (id, embedding of unit length) at least so similar, copies included: as many
    rows as there are such pairs. MetricJoin gives pairs of representatives and their members instead."""
    join = MetricJoin(vectors, threshold, block_rows)
    members, pairs = durable(join.members()), durable(join.pairs())
    side = lambda name: members.select(F.col("representative").alias(name), F.col("id").alias(f"{name}_id"))
    between = pairs.join(side("a"), "a").join(side("b"), "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "similarity")
    own = _packed(vectors).mapInArrow(_squares, "id long, similarity double").where(F.col("similarity") >= threshold)
    twins = side("a").join(side("b"), F.col("a") == F.col("b")).where("a_id < b_id").join(own.select(F.col("id").alias("a_id"), "similarity"), "a_id")
    return between.unionByName(twins.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "similarity"))


def _squares(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [float((np.frombuffer(v, dtype=np.float64) ** 2).sum()) for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["id", "similarity"])


def similar_groups(entries: DataFrame, vectors: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """duplicate_groups() of entries (id, created, last_used) by their vectors, without a pair for every two copies: of equal
    vectors only the first entry in the order of lists is clustered, and the others follow it to its leader, or to itself."""
    join = MetricJoin(vectors, threshold, block_rows)
    placed = entries.select("id", "created", "last_used", _list_order().alias("o"))
    members = join.members().join(placed, "id")
    first = members.groupBy("representative").agg(F.min_by(F.struct("id", "created", "last_used"), "o").alias("f"), F.count("*").alias("n")).select("representative", "f.*", "n")
    first = durable(first)
    name = lambda c: first.select(F.col("representative").alias(c), F.col("id").alias(f"{c}_first"))
    pairs = join.pairs().join(name("a"), "a").join(name("b"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"), "similarity")
    groups = durable(duplicate_groups(first.select("id", "created", "last_used"), pairs))
    own = join.packed.mapInArrow(_squares, "id long, similarity double").where(F.col("similarity") >= threshold)
    copies = members.select("id", "representative").join(first.where("n > 1").select("representative", F.col("id").alias("first")), "representative").where("id <> first")
    followed = copies.join(groups.select(F.col("member").alias("first"), "leader", F.col("similarity").alias("near")), "first", "left").join(own, "id", "left")
    joined = followed.where("leader is not null or similarity is not null").select(F.coalesce("leader", "first").alias("leader"), F.col("id").alias("member"), F.coalesce("near", "similarity").alias("similarity"))
    return groups.unionByName(joined)


def similar_pairs_lsh(vectors: DataFrame, threshold: float, bucket: float = 0.5, tables: int = 8) -> DataFrame:
    """The same by locality-sensitive hashing: fewer comparisons, and a few pairs may be missed."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where("embedding is not null").select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=3).fit(rows)
    # Of unit vectors the squared distance is two less twice the cosine.
    near = model.approxSimilarityJoin(rows, rows, (2 - 2 * threshold) ** 0.5 + 1e-9, "d").where("datasetA.id < datasetB.id")
    return near.select(F.col("datasetA.id").alias("a"), F.col("datasetB.id").alias("b"), (1 - F.col("d") * F.col("d") / 2).alias("similarity"))


def _list_order() -> Column:
    """Of entries in lists: the last used first, then the newest."""
    used = F.unix_micros(F.coalesce("last_used", F.lit("1970-01-01").cast("timestamp_ntz")).cast("timestamp"))
    return F.struct(F.when(F.col("last_used").isNull(), 1).otherwise(0), -used, -F.unix_micros(F.col("created").cast("timestamp")), F.col("id"))


def duplicate_groups(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(leader, member, similarity): entries are taken in the order of lists; one that isn't a member yet leads, and its
    similar entries that have no group yet become its members. All rounds are joins; a round decides every entry whose
    earlier neighbours are decided."""
    placed = entries.select("id", _list_order().alias("o"))
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "similarity").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "similarity"))
    near = both.join(placed.select(F.col("id").alias("x"), F.col("o").alias("ox")), "x").join(placed.select(F.col("id").alias("y"), F.col("o").alias("oy")), "y")
    near = durable(near.select("x", "y", "similarity", "ox", (F.col("oy") < F.col("ox")).alias("earlier")))
    state = durable(near.select("x").distinct().select(F.col("x").alias("id"), F.lit(None).cast("boolean").alias("leads")))
    while not state.where("leads is null").isEmpty():
        seen = near.where("earlier").join(state.select(F.col("id").alias("y"), F.col("leads").alias("y_leads")), "y")
        told = seen.groupBy("x").agg(F.max(F.coalesce("y_leads", F.lit(False))).alias("led"), F.max(F.col("y_leads").isNull()).alias("open"))
        state = durable(
            state.join(told, state.id == told.x, "left").select(
                "id", F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("led", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True).alias("leads")
            )
        )
    leaders = state.where("leads").select(F.col("id").alias("x"))
    members = state.where("not leads").select(F.col("id").alias("y"))
    linked = near.join(leaders, "x").join(members, "y")
    return linked.groupBy("y").agg(F.min_by(F.struct("x", "similarity"), "ox").alias("m")).select(F.col("m.x").alias("leader"), F.col("y").alias("member"), F.col("m.similarity").alias("similarity"))


def merge(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Targets of pairs (target, source) with their source's content, tags, context and usage added."""
    target, source = entries.alias("t"), entries.alias("s")
    ends = pairs.select(F.col("target").alias("to_id"), F.col("source").alias("from_id")).alias("p")
    joined = ends.join(target, F.col("t.id") == F.col("p.to_id")).join(source, F.col("s.id") == F.col("p.from_id"))
    changed = {
        "content": F.concat("t.content", F.lit(SEPARATOR), "s.content"),
        "usage_count": (F.coalesce("t.usage_count", F.lit(0)) + F.coalesce("s.usage_count", F.lit(0))).cast("long"),
    }
    for name in ("tags", "context"):
        if name in entries.columns:
            changed[name] = F.array_sort(F.array_union(f"t.{name}", f"s.{name}"))
    return joined.select([changed.get(c, F.col(f"t.{c}")).alias(c) for c in entries.columns])
