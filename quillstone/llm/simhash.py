"""SimHash near-duplicates, found with deletion-variant signatures.

A fingerprint of 64 bits is cut into 3 segments. Of two fingerprints that
differ in at most 4 bits, one segment differs in at most one, so they share one
of the segment's variants with a single bit masked out. Distinct fingerprints
are indexed under all their 64 variants; an equality grouping brings candidates
together and every candidate is verified on all bits.

Rows of one fingerprint are one node from the start. Within a variant's group
the nodes are linked by a search that compares each reached node only with
those not yet reached and reports one link per node, so a group of copies costs
about its size, and no group is expanded into pairs. Groups of more than
``group_rows`` nodes are split into chunks, and every two chunks meet in a task
of their own: the same links, with bounded memory. A masked segment has some 2^20
values, so a variant's group, and with it what one fingerprint is compared with,
grows with the distinct fingerprints over 2^20.

Defined cases: null, empty and wordless texts have fingerprint zero and link
like any other; fewer than four words are one shingle; repeated rows share a
fingerprint; a null doc_id takes part but is never a component_id unless a
component has no other; an empty table gives one; only doc_id and text are read,
so that further columns clash with nothing; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, graph

BITS, MOST = 64, 4
#: (shift, width) of the segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Nodes of one variant that meet in one task.
GROUP_ROWS = 20_000
_BATCH_BYTES = 4_000_000


def fingerprint_of(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of one text as an unsigned number."""
    words = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [hashed(b" ".join(words), seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        joined = b" ".join(words)
        hashes = [hashed(joined[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]
    bits = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):
        part = np.array(hashes[i : i + 65_536], dtype="<u8")
        ones = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Sums of 255 rows fit in a byte, which keeps the addition in bytes.
        bits += np.add.reduceat(ones, np.arange(0, len(ones), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * bits > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def _fingerprints(text: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, text, _BATCH_BYTES):
            texts = common.utf8(batch.column(batch.schema.get_field_index(text)))
            values = np.array([fingerprint_of(t) for t in texts], dtype=np.uint64).view(np.int64)
            rest = batch.select([n for n in batch.schema.names if n != text])
            yield common.extended(rest, fp=pa.array(values, pa.int64()))

    return run


def fingerprints(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents without their text, with fp (long): the fingerprint's bits as a signed number."""
    schema = common.with_fields(T.StructType([f for f in documents.schema.fields if f.name != text]), T.StructField("fp", T.LongType()))
    return documents.mapInArrow(_fingerprints(text), schema)


def _variants() -> tuple[np.ndarray, np.ndarray]:
    """For each of the variants: the mask of the bits that it keeps, and its number above them."""
    keep, tag = [], []
    for shift, width in SEGMENTS:
        for bit in range(width):
            keep.append((((1 << width) - 1) << shift) & ~(1 << (shift + bit)))
            tag.append(len(tag))
    return np.array(keep, dtype=np.uint64), np.array(tag, dtype=np.uint64)


def _index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fp) for each variant of each fingerprint. The key packs the segment's bits and the variant's number."""
    keep, tag = _variants()
    shifts = np.repeat([s for s, _ in SEGMENTS], [w for _, w in SEGMENTS]).astype(np.uint64)
    for batch in batches:
        fp = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64)
        for i in range(0, len(fp), 10_000):
            part = fp[i : i + 10_000]
            keys = (((part[:, None] & keep) >> shifts) << np.uint64(8)) | tag
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(part, len(keep)).view(np.int64))], names=["key", "fp"])


def links_within(fps: np.ndarray, most: int = MOST) -> list[tuple[int, int]]:
    """Links that connect the fingerprints (uint64, distinct) as all pairs within ``most`` bits would."""
    links: list[tuple[int, int]] = []
    left = fps
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            node = frontier.pop()
            near = np.bitwise_count(left ^ node) <= most
            if near.any():
                links += [(int(node), int(x)) for x in left[near]]
                frontier += list(left[near])
                left = left[~near]
    return links


def _pairs_small(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs inside groups of few fingerprints, by comparing each with its next, next but one, and so on."""
    a, b = [], []
    for step in range(1, int(sizes.max(initial=1))):
        n = np.maximum(sizes - step, 0)
        first = np.repeat(starts, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        near = np.bitwise_count(fps[first] ^ fps[first + step]) <= MOST
        a.append(fps[first[near]])
        b.append(fps[first[near] + step])
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _link_sorted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside the groups of a partition that is sorted by its group columns (all but the last, fp)."""
    few = 24

    def linked(keys: list[np.ndarray], fp: np.ndarray) -> pa.RecordBatch:
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        starts = np.concatenate(([0], change))
        sizes = np.diff(np.concatenate((starts, [len(fp)])))
        small = (sizes > 1) & (sizes <= few)
        a, b = _pairs_small(fp, starts[small], sizes[small])
        more = [x for i in np.flatnonzero(sizes > few).tolist() for x in links_within(np.unique(fp[starts[i] : starts[i] + sizes[i]]))]
        if more:
            m = np.array(more, dtype=np.uint64)
            a, b = np.concatenate((a, m[:, 0])), np.concatenate((b, m[:, 1]))
        pairs = np.unique(np.stack((a, b)), axis=1).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [np.asarray(c.to_numpy(zero_copy_only=False), dtype=np.int64) for c in batch.columns]
        if not len(columns[0]):
            continue
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        *keys, fp = columns
        # The last group may go on in the next batch.
        differs = np.any([k != k[-1] for k in keys], axis=0)
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if cut:
            yield linked([k[:cut] for k in keys], fp[:cut].view(np.uint64))
        held = [c[cut:] for c in columns]
    if held is not None and len(held[0]):
        yield linked(held[:-1], held[-1].view(np.uint64))


def links(nodes: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints (nodes: fp) that connect whatever pairs within 4 bits connect."""
    index = nodes.select("fp").mapInArrow(_index, "key long, fp long")
    # Sizes of segment values bound their variants' groups: a variant joins two values, so it can only be large if one of them is.
    value = F.explode(F.array(*[
        F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1).alias("value")) for i, (s, w) in enumerate(SEGMENTS)
    ])).alias("s")
    large = nodes.select(value).groupBy("s.segment", "s.value").count().where(F.col("count") > group_rows // 2)
    tags = [0, SEGMENTS[0][1], SEGMENTS[0][1] + SEGMENTS[1][1]]
    width = F.element_at(F.array(*[F.lit(w) for _, w in SEGMENTS]), F.col("segment") + 1)
    hot = (
        large.select("segment", "value", "count", F.explode(F.sequence(F.lit(0), width - 1)).alias("bit"))
        .select(
            F.expr("shiftleft(value & ~shiftleft(1L, bit), 8)").bitwiseOR(F.element_at(F.array(*[F.lit(t) for t in tags]), F.col("segment") + 1) + F.col("bit")).alias("key"),
            F.ceil(2 * F.col("count") / group_rows).cast("int").alias("chunks"),
        )
        .groupBy("key").agg(F.max("chunks").alias("chunks")).where("chunks > 1")
    )
    hot = common.durable(hot)
    if hot.isEmpty():
        return index.repartition("key").sortWithinPartitions("key").mapInArrow(_link_sorted, "a long, b long").distinct()
    # Chunk i of a large group meets every chunk j in the task of {i, j}.
    sized = index.join(hot, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    met = sized.withColumn("i", chunk).select("key", "fp", "i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"))
    met = met.select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp").select("key", F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("hi")).alias("pair"), "fp")
    return met.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(_link_sorted, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every row."""
    marked = common.durable(fingerprints(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))))
    nodes = common.durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = graph.components(links(nodes, group_rows), "a", "b")
    # Only the linked fingerprints (roots are linked too) need the smallest document of their component.
    ends = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = nodes.join(ends, nodes.fp == ends.node).select("fp", "least", "root")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    found = linked.join(smallest, "root").select("fp", F.col("component_id").alias("linked"))
    named = nodes.join(found, "fp", "left").select("fp", F.coalesce("linked", "least").alias("component_id"))
    return marked.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def keep_first(documents: DataFrame) -> DataFrame:
    """One document of each group: the one with the smallest doc_id (rows without one come last), of several with this id
    the one with the smallest hash of its text; one of several rows with this id and text."""
    names = documents.columns
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("text"))
    # The rows' own columns are set aside, so that none clashes with the key.
    held = documents.select(key.alias("key"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    keyed = documents.select(key.alias("doc_id"), "text")
    found = near_duplicates(keyed).where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct()
    kept = held.join(found, "key", "left_semi").dropDuplicates(["key"])
    return kept.select([F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def brute_force(documents: list[tuple]) -> dict:
    """By comparing all pairs; for tests. doc_id to (fingerprint, component_id)."""
    fp = [(d, fingerprint_of(t.encode() if t is not None else None)) for d, t in documents]
    parent = list(range(len(fp)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fp)):
        for j in range(i):
            if (fp[i][1] ^ fp[j][1]).bit_count() <= MOST:
                parent[root(i)] = root(j)
    groups: dict[int, list] = {}
    for i in range(len(fp)):
        groups.setdefault(root(i), []).append(fp[i][0])
    return {fp[i][0]: (f"{fp[i][1]:016x}", min(groups[root(i)])) for i in range(len(fp))}
