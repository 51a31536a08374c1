"""Exact repeats of long byte strings by a sparse, distributed suffix array.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else is found, in four steps whose shuffles grow with the input alone:

1. Suffix sampling. In each window of ``length`` bytes the K-byte string of
   least hash is its anchor. The choice depends on the window's bytes only, so
   equal windows have equal anchors. Neighbouring windows of one anchor form a
   block; there is about one for 70 bytes. Blocks whose anchor string occurs once
   can't repeat and go. Of the blocks that are left, the distinct ones are cut
   out, each at two of its places where it has several.
2. Suffix sorting. Blocks are range-partitioned by the leading bytes of their
   anchors' suffixes with sampled splitters. In each bucket the suffixes are
   sorted by multikey quicksort, with eight bytes for a token: suffixes are
   parted by one token, and only those that tie go on to the next, to the last.
   First the blocks as wholes: neighbours that agree in all bytes are copies, all
   of whose windows repeat. Then, of anchors with several distinct blocks, the
   suffixes at all window starts: neighbours that agree in a window's bytes repeat.
3. Boundaries. Splitters never part equal leading bytes, so no repeat of a usual
   anchor crosses a boundary. An anchor string of more than ``group_blocks``
   blocks, too many for one bucket, has the suffixes at all its window starts
   range-partitioned by all their bytes instead; neighbours are compared inside
   the partitions, and then the first and the last of each with those of others.
4. Covering. Each document's repeated ranges are joined to it.

An anchor string that very many blocks share is counted before its shuffle and
its join is open to skew splitting; copies of a passage are one distinct block.

Defined cases: null text is empty; shorter texts have no repeats; a repeat
inside one document counts; repeated rows repeat each other; of strings that
tie all are removed; an empty table gives one; columns named n_bytes, n_removed,
n_spans or removed give way to the result's; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH, K = 200, 64
#: Windows of a block at most.
BLOCK_WINDOWS = 256
GROUP_BLOCKS = 2_000
_SCAN_BYTES, _SORT_BYTES = 1_000_000, 2_000_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _doubled(x: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all strings of size bytes (a power of two), each from those of its halves."""
    h, step = (x.astype(np.uint64) + np.uint64(1 + seed)) * _M2, 1
    while step < size:
        h = h[:-step] * _M1 + (h[step:] ^ (h[step:] >> np.uint64(31)))
        step *= 2
    return h ^ (h >> np.uint64(29))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each width neighbours, from running minima of blocks in both directions."""
    n = len(h) - width + 1
    padded = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(h)] = h
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def blocks_of(texts: list[bytes], length: int = LENGTH, k: int = K) -> dict[str, np.ndarray]:
    """The blocks of some texts: text number, first window (in the text), windows, anchor hash, anchor's place in the
    block, and whether the anchor string occurs in the block again."""
    buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.cumsum(sizes) - sizes
    width = length - k + 1
    none = np.zeros(0, dtype=np.int64)
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.sum():
        return {"text": none, "first": none, "windows": none, "hash": none.astype(np.uint64), "place": none, "again": none.astype(bool)}
    h = _doubled(buffer, k)
    least = _least(h, width)
    at = np.repeat(starts - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    value = least[at]
    turn = np.ones(len(at), dtype=bool)
    turn[1:] = (at[1:] != at[:-1] + 1) | (value[1:] != value[:-1])
    first = np.flatnonzero(turn)
    count = np.diff(np.concatenate((first, [len(at)])))
    if (count > BLOCK_WINDOWS).any():  # periodic texts
        pieces = -(-count // BLOCK_WINDOWS)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        count = np.minimum(BLOCK_WINDOWS, np.repeat(count, pieces) - nth * BLOCK_WINDOWS)
        first = np.repeat(first, pieces) + nth * BLOCK_WINDOWS
    begin, anchor = at[first], value[first]
    place, last = np.empty(len(begin), dtype=np.int64), np.empty(len(begin), dtype=np.int64)
    around = np.arange(width)
    for i in range(0, len(begin), 4_000):
        part = slice(i, i + 4_000)
        place[part] = (h[begin[part, None] + around] == anchor[part, None]).argmax(axis=1)
        ends = begin[part] + count[part] - 1
        last[part] = count[part] - 1 + width - 1 - (h[ends[:, None] + around[::-1]] == anchor[part, None]).argmax(axis=1)
    text = np.searchsorted(starts + sizes, begin, side="right")
    return {"text": text, "first": begin - starts[text], "windows": count, "hash": anchor, "place": place, "again": place != last}


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (rid, text): a row for each block. loc packs first window, anchor's place and windows."""
    for batch in common.small_batches(batches, "text", _SCAN_BYTES):
        rid = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        texts = [t or b"" for t in common.utf8(batch.column(1))]
        found = blocks_of(texts)
        digest = xxhash.xxh64_intdigest
        stop = found["first"] + found["windows"] + LENGTH - 1
        hashes = np.fromiter(
            (digest(texts[t][a:b]) for t, a, b in zip(found["text"].tolist(), found["first"].tolist(), stop.tolist(), strict=True)), dtype=np.uint64, count=len(stop)
        )
        loc = (found["first"] << 20) | (found["place"] << 10) | found["windows"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (found["hash"].view(np.int64), hashes.view(np.int64), rid[found["text"]], loc, found["again"])],
            names=["anchor", "block", "rid", "loc", "again"],
        )


def _pack(text: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in common.small_batches(batches, text, 4_000_000):
            packed = [compress(t) if t else None for t in common.utf8(batch.column(batch.schema.get_field_index(text)))]
            rest = batch.select([n for n in batch.schema.names if n != text])
            yield common.extended(rest, packed=pa.array(packed, pa.binary()))

    return run


def _packed(documents: DataFrame, text: str) -> DataFrame:
    """documents with their text compressed by itself, which halves what its shuffle writes."""
    schema = common.with_fields(T.StructType([f for f in documents.schema.fields if f.name != text]), T.StructField("packed", T.BinaryType()))
    return documents.mapInArrow(_pack(text), schema)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (packed, chosen): the chosen blocks' bytes, with the leading bytes of their anchors' suffixes, and whether their
    anchor has several distinct blocks."""
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        for packed, chosen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = expand(packed)
            for c in chosen:
                first, place, windows = c["loc"] >> 20, c["loc"] >> 10 & 1023, c["loc"] & 1023
                lead = text[first + place : first + place + 16]
                rows.append((int.from_bytes(lead[:8]) - 2**63, int.from_bytes(lead[8:]) - 2**63, c["anchor"], c["block"], c["mixed"], text[first : first + windows + LENGTH - 1]))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (*(pa.int64(),) * 4, pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lead0", "lead1", "anchor", "block", "mixed", "bytes"])


def _ties(index: np.ndarray, token, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of suffixes, all groups of a level at once: a group is parted by one token, and only suffixes that
    tie go on to the next one. Returns those that tie in all tokens, and their groups. token(suffixes, depth): numbers."""
    if len(index) < 2:
        return index[:0], index[:0]
    index, group = index.copy(), np.zeros(len(index), dtype=np.int64)
    for depth in range(tokens):
        if not len(index):
            break
        now = token(index, depth)
        # Groups that tie as a whole stay as they are.
        differ = np.flatnonzero((group[1:] == group[:-1]) & (now[1:] != now[:-1]))
        if not len(differ):
            continue
        parted = np.zeros(int(group[-1]) + 1, dtype=bool)
        parted[group[differ]] = True
        place = np.flatnonzero(parted[group])
        order = place[np.lexsort((now[place], group[place]))]
        index[place], now[place] = index[order], now[order]
        new = np.ones(len(index), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (now[1:] != now[:-1])
        group = np.cumsum(new) - 1
        tied = np.bincount(group)[group] > 1
        index, group = index[tied], group[tied]
    return index, group


class Suffixes:
    """Blocks laid end to end, each filled up with zeros, and the suffixes at their starts and at their windows' starts."""

    def __init__(self, blocks: list[bytes]):
        self.sizes = np.fromiter(map(len, blocks), dtype=np.int64, count=len(blocks))
        filled = -(-self.sizes // 8) * 8
        self.buffer = np.frombuffer(b"".join(b + bytes(n - len(b)) for b, n in zip(blocks, filled.tolist(), strict=True)) + bytes(8), dtype=np.uint8)
        self.starts = np.cumsum(filled) - filled
        self._eight = np.lib.stride_tricks.sliding_window_view(self.buffer, 8)

    def _token(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes as a number, in their order."""
        return np.ascontiguousarray(self._eight[at]).view(">u8").ravel().astype(np.uint64)

    def copies(self) -> np.ndarray:
        """For each block the first one that equals it."""
        first = np.arange(len(self.sizes))
        # Blocks of one length tie in all their bytes or don't.
        for size in np.unique(self.sizes).tolist():
            index, group = _ties(np.flatnonzero(self.sizes == size), lambda i, depth: self._token(self.starts[i] + 8 * depth), -(-size // 8))
            if len(index):
                least = np.full(int(group.max()) + 1, len(first))
                np.minimum.at(least, group, index)
                first[index] = least[group]
        return first

    def repeated(self, blocks: np.ndarray) -> np.ndarray:
        """For some blocks: which of their windows, one block after the other, equal another window of them."""
        windows = self.sizes[blocks] - LENGTH + 1
        at = np.repeat(self.starts[blocks] - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        out = np.zeros(len(at), dtype=bool)
        index, _ = _ties(np.arange(len(at)), lambda i, depth: self._token(at[i] + 8 * depth), LENGTH // 8)
        out[index] = True
        return out


def _ranges(starts: np.ndarray) -> tuple[list[int], list[int]]:
    """The byte ranges that windows at these sorted starts cover."""
    if not len(starts):
        return [], []
    gap = np.flatnonzero(starts[1:] > starts[:-1] + LENGTH)
    return starts[np.concatenate(([0], gap + 1))].tolist(), (starts[np.concatenate((gap, [len(starts) - 1]))] + LENGTH).tolist()


def _found(rows: list[tuple]) -> pa.RecordBatch:
    """From (anchor, block, begins, ends)."""
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "block", "begins", "ends"])


def _resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (anchor, block, mixed, bytes): the repeated byte ranges of each block that has any."""

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        suffixes = Suffixes([r[3] for r in rows])
        first = suffixes.copies()
        whole = np.bincount(first, minlength=len(rows)) > 1
        found = [(rows[i][0], rows[i][1], [0], [len(rows[i][3])]) for i in np.flatnonzero(whole).tolist()]
        # One of each copy takes part where its anchor has other blocks.
        several = np.flatnonzero((first == np.arange(len(rows))) & np.fromiter((r[2] for r in rows), dtype=bool, count=len(rows)))
        repeated = suffixes.repeated(several)
        ends = np.cumsum(suffixes.sizes[several] - LENGTH + 1)
        for i, end in zip(several.tolist(), ends.tolist(), strict=True):
            if not whole[i]:
                begins, stops = _ranges(np.flatnonzero(repeated[end - (len(rows[i][3]) - LENGTH + 1) : end]))
                if begins:
                    found.append((rows[i][0], rows[i][1], begins, stops))
        return _found(found)

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > _SORT_BYTES and row[0] != held[-1][0]:
                yield solved(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield solved(held)


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (anchor, block, bytes): a row for each window, with all its bytes as the key."""
    for batch in batches:
        for i in range(0, batch.num_rows, 200):
            anchor, block, raw = (c.slice(i, 200).to_pylist() for c in batch.columns)
            n = [len(r) - LENGTH + 1 for r in raw]
            keys = [r[j : j + LENGTH] for r in raw for j in range(len(r) - LENGTH + 1)]
            place = [j for m in n for j in range(m)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(np.repeat(anchor, n), pa.int64()), pa.array(np.repeat(block, n), pa.int64()), pa.array(place, pa.int32())], names=["key", "anchor", "block", "j"]
            )


_PLACE = "anchor long, block long, j int, edge binary"


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (key, anchor, block, j): windows that equal the one before or after them; the first and the last of the
    partition come with their key, as their other neighbours lie in other partitions."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["anchor", "block", "j", "edge"])

    last = None
    for batch in batches:
        out = []
        for key, *place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if last is None:
                out.append((*place, key))
            elif last[0] == key:
                out += [(*last[1], None), (*place, None)]
            last = (key, place)
        yield made(out)
    if last is not None:
        yield made([(*last[1], last[0])])


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        yield _found([(anchor, block, *_ranges(np.array(sorted(set(j)), dtype=np.int64))) for anchor, block, j in rows])


_RANGES = "anchor long, block long, begins array<int>, ends array<int>"


def _across(blocks: DataFrame) -> DataFrame:
    """The repeated ranges of blocks whose groups don't fit into one bucket."""
    order = ["key", "anchor", "block", "j"]
    windows = blocks.select("anchor", "block", "bytes").mapInArrow(_windows, "key binary, anchor long, block long, j int")
    near = common.durable(windows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, _PLACE))
    # Two rows of each partition.
    edges = near.where("edge is not null").select(F.col("edge").alias("key"), "anchor", "block", "j").coalesce(1).sortWithinPartitions(*order).mapInArrow(_neighbours, _PLACE)
    found = near.unionByName(edges).where("edge is null").groupBy("anchor", "block").agg(F.collect_set("j").alias("j"))
    return found.mapInArrow(_joined, _RANGES)


def _spans(documents: DataFrame, text: str, group_blocks: int) -> DataFrame:
    """(rid, spans): the repeated ranges of each document that has any. documents: rid, text."""
    anchors = common.durable(documents.select("rid", F.col(text).alias("text")).mapInArrow(_scan, "anchor long, block long, rid long, loc long, again boolean"))
    counted = anchors.groupBy("anchor").agg(
        F.count("*").alias("total"), F.min("block").alias("low"), F.max("block").alias("high"), F.max("again").alias("again")
    ).where("total > 1 or again")
    shared = common.durable(counted.select("anchor", F.expr("low <> high or again").alias("mixed")))
    flagged = common.durable(anchors.drop("again").join(shared, "anchor"))
    common.discard(anchors)
    common.discard(shared)

    place = F.struct("rid", "loc")
    chosen = flagged.groupBy("anchor", "block").agg(F.max("mixed").alias("mixed"), F.min(place).alias("first"), F.max(place).alias("last"))
    chosen = chosen.select("anchor", "block", "mixed", F.explode(F.array_distinct(F.array("first", "last"))).alias("at"))
    by_document = chosen.groupBy(F.col("at.rid").alias("rid")).agg(F.collect_list(F.struct("anchor", "block", "mixed", F.col("at.loc").alias("loc"))).alias("chosen"))
    # Rows of the same doc_id and text share a rid: their blocks come as often as they do, and do repeat.
    blocks = common.durable(
        _packed(documents.select("rid", text), text).join(by_document, "rid").select("packed", "chosen")
        .mapInArrow(_cut, "lead0 long, lead1 long, anchor long, block long, mixed boolean, bytes binary")
    )
    large = common.durable(blocks.where("mixed").groupBy("anchor").count().where(F.col("count") > group_blocks).select("anchor"))
    if large.isEmpty():
        usual, ranges = blocks, None
    else:
        usual, ranges = blocks.join(large, "anchor", "left_anti"), _across(blocks.join(large, "anchor", "left_semi"))
    key = ["lead0", "lead1", "anchor"]
    buckets = usual.select(*key, "block", "mixed", "bytes").repartitionByRange(*key).sortWithinPartitions(*key).select("anchor", "block", "mixed", "bytes")
    sorted_ranges = buckets.mapInArrow(_resolve, _RANGES)
    # A table of its own, so that the join's sides are plain shuffles and a block that very many share can be split.
    ranges = sorted_ranges if ranges is None else sorted_ranges.unionByName(ranges)
    ranges = common.durable(ranges.select("anchor", "block", F.arrays_zip("begins", "ends").alias("ranges")).dropDuplicates(["anchor", "block"]))

    part = (
        flagged.select("anchor", "block", "rid", F.shiftright("loc", 20).alias("first")).join(ranges, ["anchor", "block"])
        .select("rid", "first", F.explode("ranges").alias("r"))
        .select("rid", (F.col("first") + F.col("r.begins")).alias("begin"), (F.col("first") + F.col("r.ends")).alias("end"))
    )
    return part.groupBy("rid").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs: overlapping and touching ranges are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, pieces = 0, []
    for a, b in spans:
        pieces.append(text[at:a])
        at = b
    return b"".join([*pieces, text[at:]])


def _joined_spans(documents: DataFrame, text: str, group_blocks: int) -> DataFrame:
    """documents with packed for text, and spans (array of begin, end, or null)."""
    named = documents.withColumn("rid", F.xxhash64(*[F.col(c) for c in ("doc_id", text) if c in documents.columns]))
    spans = _spans(named.select("rid", text), text, group_blocks)
    return _packed(named, text).join(spans, "rid", "left").drop("rid")


def _finish(text: str, digest: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                column = lambda name: part.column(part.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
                texts = [expand(p) if p is not None else b"" for p in column("packed")]
                spans = [merged([(s["begin"], s["end"]) for s in x]) if x else [] for x in column("spans")]
                left = [kept(t, s) for t, s in zip(texts, spans, strict=True)]
                rest = part.select([n for n in part.schema.names if n not in ("packed", "spans")])
                added = {
                    "n_bytes": pa.array(map(len, texts), pa.int64()), "n_removed": pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                    "n_spans": pa.array(map(len, spans), pa.int64()),
                }
                if digest:
                    added["kept_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in left], pa.string())
                else:
                    added["removed"] = pa.array([[{"begin": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([pa.field("begin", pa.int64()), pa.field("end", pa.int64())])))
                    added[text] = pa.array([t.decode("utf-8", "ignore") for t in left], pa.string())
                yield common.extended(rest, **added)

    return run


def _finished(documents: DataFrame, text: str, group_blocks: int, digest: bool) -> DataFrame:
    joined = _joined_spans(documents, text, group_blocks)
    counts = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    span = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    own = [T.StructField("kept_sha256", T.StringType())] if digest else [T.StructField("removed", T.ArrayType(span)), T.StructField(text, T.StringType())]
    rest = T.StructType([f for f in joined.schema.fields if f.name not in ("packed", "spans")])
    return joined.mapInArrow(_finish(text, digest), common.with_fields(rest, *counts, *own))


def remove_repeats(documents: DataFrame, *, text: str = "text", group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """documents (with doc_id) whose text has lost its repeated bytes, with n_bytes, n_removed, n_spans (long) and removed
    (array of begin, end in bytes). Bytes that a removal left of a character go too; a null text becomes empty."""
    return _finished(documents, text, group_blocks, False)


def query(spark: SparkSession, sf_dir: str, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return _finished(documents, "text", group_blocks, True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def keep_unrepeated(documents: DataFrame) -> DataFrame:
    """All documents, with their own columns; text without its repeated parts, n_chars its length."""
    names = documents.columns
    held = documents.select([F.col(f"`{c}`").alias({"text": "text", "doc_id": "doc_id"}.get(c, f"c{i}")) for i, c in enumerate(names)])
    found = remove_repeats(held)
    return found.select([
        F.length("text").cast(documents.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col({"text": "text", "doc_id": "doc_id"}.get(c, f"c{i}")).alias(c)
        for i, c in enumerate(names)
    ])


def brute_force(documents: list[tuple], length: int = LENGTH) -> dict:
    """By a dictionary of all strings; for tests."""
    texts = [(d, t.encode() if t is not None else b"") for d, t in documents]
    seen: dict[bytes, int] = {}
    for _, t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = {}
    for d, t in texts:
        spans = merged([(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1])
        out[d] = (len(t), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept(t, spans)).hexdigest())
    return out
