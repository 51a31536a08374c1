"""Byte-level BPE encoding and decoding with length-bucketed padded matrices.

A text is split by the tokenizer's pattern. Pieces that are whole vocabulary
entries need no merging; the distinct others of a batch are laid out as rows of
padded matrices, one matrix for each length bucket. In each round every row
merges its leftmost pair of minimum rank; pairs are looked up in an
open-addressing hash table, rows are compacted to the left, and finished rows
leave the matrix. Very long pieces are merged one at a time through a heap,
with the same result, as rows would cost the square of their length.

Results are kept by piece between batches, in a cache of bounded size.

Defined cases: a null or empty text has no tokens; strings of special tokens
are ordinary text; decoding returns the text's UTF-8 bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Pieces of more bytes are merged through a heap.
LONG = 256
#: Pieces whose ids a worker keeps.
CACHE_PIECES = 300_000
_BATCH_BYTES = 4_000_000
_NONE = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token, space, rank, by line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """Encodes and decodes by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.tokens = {i: t for t, i in ranks.items()}
        self.names = {i: str(i) for i in self.tokens}
        self.bytes_of = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self._build_pairs()
        self.cache: dict[str, tuple[int, ...]] = {}

    def _build_pairs(self) -> None:
        found = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    found[(left << 32) | right] = rank
        keys = np.array(list(found), dtype=np.int64)
        values = np.array(list(found.values()), dtype=np.int32)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
        self.slot_keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot_ranks = np.full(1 << self.bits, _NONE, dtype=np.int32)
        left, at, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(left):  # linear probing: the first of a slot stays, the rest move on
            self.probes += 1
            free = self.slot_keys[at] == -1
            first = np.zeros(len(left), dtype=bool)
            first[np.unique(np.where(free, at, -1), return_index=True)[1]] = True
            stay = first & free
            self.slot_keys[at[stay]], self.slot_ranks[at[stay]] = keys[left[stay]], values[left[stay]]
            left, at = left[~stay], (at[~stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> 29)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merger, _NONE where they don't merge."""
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        held = self.slot_keys[at]
        out = np.where(held == keys, self.slot_ranks[at], _NONE)
        going = np.flatnonzero((held != keys) & (held != -1))
        for _ in range(self.probes - 1):
            if not len(going):
                break
            at[going] = (at[going] + 1) & ((1 << self.bits) - 1)
            held = self.slot_keys[at[going]]
            hit = held == keys[going]
            out[going[hit]] = self.slot_ranks[at[going[hit]]]
            going = going[~hit & (held != -1)]
        return out

    def _merge_rows(self, rows: np.ndarray, lengths: np.ndarray) -> list[tuple[int, ...]]:
        """rows: ids by byte, padded with -1 to the longest."""
        out: list[tuple[int, ...] | None] = [None] * len(rows)
        number = np.arange(len(rows))
        width = rows.shape[1]
        inside = np.arange(1, width) < lengths[:, None]
        ranks = np.full((len(rows), width - 1), _NONE, dtype=np.int32)
        ranks[inside] = self.pair_ranks(rows[:, :-1][inside], rows[:, 1:][inside])
        while len(rows):
            at = ranks.argmin(axis=1)
            line = np.arange(len(rows))
            best = ranks[line, at]
            done = best == _NONE
            if done.any():
                for i in np.flatnonzero(done).tolist():
                    out[number[i]] = tuple(rows[i, : lengths[i]].tolist())
                go = ~done
                rows, ranks, lengths, number, at, best = rows[go], ranks[go], lengths[go], number[go], at[go], best[go]
                if not len(rows):
                    break
                line = np.arange(len(rows))
            # Compaction: what stands right of the pair moves one to the left.
            columns = np.arange(rows.shape[1] - 1)
            moved = columns > at[:, None]
            rows[line, at] = best
            rows = np.where(moved, rows[:, 1:], rows[:, :-1])
            ranks = np.where(columns[:-1] > at[:, None], ranks[:, 1:], ranks[:, :-1]) if ranks.shape[1] > 1 else ranks[:, :0]
            lengths = lengths - 1
            if ranks.shape[1]:
                has = at > 0
                ranks[line[has], at[has] - 1] = self.pair_ranks(rows[line[has], at[has] - 1], best[has])
                has = at < lengths - 1
                ranks[line[has], at[has]] = self.pair_ranks(best[has], rows[line[has], at[has] + 1])
                ends = (at >= lengths - 1) & (at < ranks.shape[1])
                ranks[line[ends], at[ends]] = _NONE
            longest = int(lengths.max())
            if longest < rows.shape[1]:
                rows, ranks = rows[:, :longest], ranks[:, : max(0, longest - 1)]
            if not ranks.shape[1]:
                for i in range(len(rows)):
                    out[number[i]] = tuple(rows[i, : lengths[i]].tolist())
                break
        return out  # type: ignore[return-value]

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """One piece by a heap of (rank, position) and linked neighbours."""
        ids = self.bytes_of[np.frombuffer(piece, dtype=np.uint8)]
        first = self.pair_ranks(ids[:-1], ids[1:])
        ids = ids.tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != _NONE]
        heapq.heapify(heap)
        ranks, tokens = self.ranks, self.tokens
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(ids) and (r := ranks.get(tokens[ids[left]] + tokens[ids[right]])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[right]))
        return tuple(i for i in ids if i >= 0)

    def _learn(self, pieces: set[str]) -> None:
        """Puts the ids of new pieces into the cache."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.cache[piece] = (whole,)
            elif len(raw) > LONG:
                self.cache[piece] = self._merge_long(raw)
            else:
                n = len(raw)
                buckets.setdefault(n if n <= 16 else -(-n // 8) * 8 if n <= 64 else -(-n // 64) * 64, []).append((piece, raw))
        for width, group in buckets.items():
            step = max(1, 200_000 // width)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                lengths = np.fromiter((len(r) for _, r in part), dtype=np.int64, count=len(part))
                flat = self.bytes_of[np.frombuffer(b"".join(r for _, r in part), dtype=np.uint8)]
                rows = np.full((len(part), int(lengths.max())), -1, dtype=np.int32)
                rows[np.arange(rows.shape[1]) < lengths[:, None]] = flat
                self.cache.update(zip((p for p, _ in part), self._merge_rows(rows, lengths), strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.pieces(t) if t else [] for t in texts]
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        new = set().union(*split).difference(self.cache)
        if new:
            self._learn(new)
        of = self.cache.__getitem__
        return [list(chain.from_iterable(map(of, pieces))) for pieces in split]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(name: str, folder: str | None = None) -> Codec:
    """The codec of a rank file, once in each Python worker; every machine has the vocabulary files."""
    import os

    import public_tokenizers

    return Codec(read_ranks(os.path.join(folder, name) if folder else public_tokenizers.path(name)), public_tokenizers.PATTERN)


VOCABULARY = "byte_bpe_50k.tiktoken"


def encode(documents: DataFrame, *, text: str = "text", vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """documents with ids (array of int)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, folder)
        for batch in common.small_batches(batches, text, _BATCH_BYTES):
            ids = own.encode_batch(batch.column(batch.schema.get_field_index(text)).to_pylist())
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
            yield common.extended(batch, ids=pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))

    return documents.mapInArrow(run, common.with_fields(documents.schema, T.StructField("ids", T.ArrayType(T.IntegerType()))))


def decode(encoded: DataFrame, *, vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """encoded (with ids) with decoded (binary); null ids decode to null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, folder)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            yield common.extended(batch, decoded=pa.array([None if x is None else own.decode(x) for x in ids], pa.binary()))

    return encoded.mapInArrow(run, common.with_fields(encoded.schema, T.StructField("decoded", T.BinaryType())))


def round_trip(documents: DataFrame, *, text: str = "text", vocabulary: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """documents without their text, with n_tokens, ids_sha256 and decoded_sha256: encode() and decode() in one pass,
    so that ids, which are larger than the texts, don't leave the worker."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, folder)
        name = own.names.__getitem__
        for batch in common.small_batches(batches, text, _BATCH_BYTES):
            encoded = own.encode_batch(batch.column(batch.schema.get_field_index(text)).to_pylist())
            rest = batch.select([n for n in batch.schema.names if n != text])
            yield common.extended(
                rest, n_tokens=pa.array([len(x) for x in encoded], pa.int64()),
                ids_sha256=pa.array([hashlib.sha256(" ".join(map(name, x)).encode()).hexdigest() for x in encoded], pa.string()),
                decoded_sha256=pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in encoded], pa.string()),
            )

    added = (T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()))
    return documents.mapInArrow(run, common.with_fields(T.StructType([f for f in documents.schema.fields if f.name != text]), *added))


def digest(documents: DataFrame) -> DataFrame:
    return round_trip(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"))
