"""Benchmark decontamination with a distributed positional inverted index.

index() turns training texts into a stored table of index segments. A segment
holds some megabytes of text: its terms, and for each term the sorted list of its
positions. Segments are split by document, so a term or a passage that very many
documents hold is spread over all segments.

A window of test words is looked up by intersecting offset-adjusted lists of
positions, from its rarest term on: document frequencies of the test terms are
summed over all segments first, and order each window's terms. Besides these
exact phrases, proximity matches are found: an occurrence of the window's rarest
word (the first of equals) with every other word of it within ``NEAR`` words on
either side, in the same document.

The test set is taken in blocks of at most ``block_bytes`` of text. Each block is
one broadcast of that bounded size, which is given up before the next one, and
one pass over the stored index; its matches are a table, united by text.

Defined cases: null or empty text has no words and no hits; an item of null or
wordless text has no windows; an item of fewer than ``window`` words is one
window; repeated items and repeated documents count each by itself; an item
without an id makes hits, but isn't among the items found; ids sort as strings;
an empty table of items leaves all documents clean; what mark() adds comes last,
and columns of the same names give way; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Lower-cases A-Z, keeps digits, a-z and every byte of non-ASCII characters; all else parts words.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
#: Text bytes in one index segment; words on either side of the rarest one that a proximity match reaches.
SEGMENT_BYTES, NEAR = 6_000_000, 20


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, dictionary-encoded, and the texts' numbers of words."""
    folded = [t.translate(_WORD_BYTES) if t else b"" for t in common.utf8(texts)]
    # White space around a text would make empty words.
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pa.array(folded, pa.string())))
    sizes = np.asarray(pc.list_value_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)
    flat = words.flatten()
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False)
    if empty.any():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~empty], minlength=len(sizes))
        flat = flat.filter(pa.array(~empty))
    return pc.dictionary_encode(flat), sizes


INDEX = "cids array<long>, lengths array<int>, terms binary, counts binary, postings binary"


def _indexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (cid, text): a row for each segment. Postings are positions in the segment's texts laid end to end, by term."""
    compress = zstandard.ZstdCompressor(level=1).compress
    for part in common.small_batches(batches, "text", SEGMENT_BYTES):
        words, sizes = _split(part.column(1))
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        order = np.argsort(codes, kind="stable").astype(np.int32)
        counts = np.bincount(codes, minlength=len(words.dictionary)).astype(np.int32)
        terms = b"\n".join(common.utf8(words.dictionary))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([sizes.tolist()], pa.list_(pa.int32())),
                *(pa.array([compress(x)], pa.binary()) for x in (terms, counts.tobytes(), order.tobytes())),
            ],
            names=["cids", "lengths", "terms", "counts", "postings"],
        )


def index(documents: DataFrame, text: str = "text") -> DataFrame:
    """The stored index of the texts that aren't null; a text goes by the hash of its characters (cid)."""
    named = documents.select(F.col(text).alias("text")).where("text is not null").select(F.xxhash64("text").alias("cid"), "text")
    return common.durable(named.mapInArrow(_indexed, INDEX))


def _terms(raw: bytes, counts: bytes) -> tuple[list[bytes], np.ndarray]:
    expand = zstandard.ZstdDecompressor().decompress
    joined = expand(raw)
    return joined.split(b"\n") if joined else [], np.frombuffer(expand(counts), dtype=np.int32)


class TestWindows:
    """The windows of one block of items: term ids by window, grouped by window length, each in the order of the block's
    items; after rank(), also the order in which a window's terms are looked up."""

    __test__ = False

    def __init__(self, items: Iterable[tuple[str | None, bytes | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.owners: list[str | None] = []
        windows: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            number = len(self.owners)
            self.owners.append(item)
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                windows.setdefault(tuple(ids[i : i + size]), set()).add(number)
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for w in windows:
            by_length.setdefault(len(w), []).append(w)
        self.groups = [(np.array(ws, dtype=np.int64), [sorted(windows[w]) for w in ws]) for _, ws in sorted(by_length.items())]
        self.ranks: list[np.ndarray] = []

    def rank(self, frequency: np.ndarray) -> None:
        """frequency: occurrences of each term in all training texts. Windows with a term that never occurs go."""
        kept, self.ranks = [], []
        for windows, owners in self.groups:
            counts = frequency[windows]
            alive = np.flatnonzero(counts.min(axis=1) > 0)
            kept.append((windows[alive], [owners[i] for i in alive.tolist()]))
            self.ranks.append(np.argsort(counts[alive], axis=1, kind="stable"))
        self.groups = kept

    def named(self, owners: Iterable[int]) -> list[str]:
        return [self.owners[o] for o in owners if self.owners[o] is not None]


class Segment:
    """A segment of the index, opened for a block of test windows: terms go by their ids in the block's vocabulary."""

    def __init__(self, lengths: list[int], terms: bytes, counts: bytes, postings: bytes, vocabulary: dict[bytes, int]):
        #: Documents lie in one position space; a window may not cross their bounds.
        self.starts = np.concatenate(([0], np.cumsum(np.array(lengths, dtype=np.int64))))
        names, own = _terms(terms, counts)
        asked = np.fromiter((vocabulary.get(t, -1) for t in names), dtype=np.int64, count=len(names))
        positions = np.frombuffer(zstandard.ZstdDecompressor().decompress(postings), dtype=np.int32)
        of = np.repeat(asked, own)
        held, positions = of[of >= 0], positions[of >= 0].astype(np.int64)
        keys = (held << 32) | positions
        #: Sorted by term, then position.
        self.postings = np.sort(keys)
        self.counts = np.bincount(held, minlength=len(vocabulary))
        self.firsts = np.concatenate(([0], np.cumsum(self.counts)))

    def _from_rarest(self, windows: np.ndarray, rank: np.ndarray, slice_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Window numbers and the places of their rarest terms, for windows all of whose terms the segment holds."""
        alive = np.flatnonzero(self.counts[windows].min(axis=1) > 0) if len(windows) and len(self.postings) else np.zeros(0, dtype=np.int64)
        rarest = windows[alive, rank[alive, 0]]
        for a, b in common.slices(self.counts[rarest], slice_rows):
            n = self.counts[rarest[a:b]]
            window = np.repeat(alive[a:b], n)
            nth = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
            yield window, self.postings[np.repeat(self.firsts[rarest[a:b]], n) + nth] & 0xFFFFFFFF

    def phrases(self, windows: np.ndarray, rank: np.ndarray, slice_rows: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers and start positions of all exact occurrences inside one document."""
        size, found = windows.shape[1], [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        for window, place in self._from_rarest(windows, rank, slice_rows):
            start = place - rank[window, 0]
            window, start = window[start >= 0], start[start >= 0]
            for r in range(1, size):
                offset = rank[window, r]
                keys = (windows[window, offset] << 32) | (start + offset)
                at = np.minimum(np.searchsorted(self.postings, keys), len(self.postings) - 1)
                keep = self.postings[at] == keys
                window, start = window[keep], start[keep]
                if not len(window):
                    break
            document = np.searchsorted(self.starts, start, side="right") - 1
            keep = start + size <= self.starts[document + 1]
            found.append((window[keep], start[keep]))
        return np.concatenate([w for w, _ in found]), np.concatenate([s for _, s in found])

    def near(self, windows: np.ndarray, rank: np.ndarray, slop: int, slice_rows: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers and places of their rarest term with every other term within slop words in the same document."""
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
        for window, place in self._from_rarest(windows, rank, slice_rows):
            document = np.searchsorted(self.starts, place, side="right") - 1
            low, high = np.maximum(place - slop, self.starts[document]), np.minimum(place + slop, self.starts[document + 1] - 1)
            for r in range(1, windows.shape[1]):
                term = windows[window, rank[window, r]] << 32
                at = np.minimum(np.searchsorted(self.postings, term | low), len(self.postings) - 1)
                keep = (self.postings[at] >= (term | low)) & (self.postings[at] <= (term | high))
                window, place, low, high = window[keep], place[keep], low[keep], high[keep]
                if not len(window):
                    break
            found.append((window, place))
        return np.concatenate([w for w, _ in found]), np.concatenate([p for _, p in found])


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The test set in blocks of bounded size; the driver holds one at a time."""
    block: list[tuple[str | None, bytes | None]] = []
    size = 0
    for row in items.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        value = row[1].encode() if row[1] is not None else None
        if block and size + len(value or b"") > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], value))
        size += len(value or b"")
    if block:
        yield block


def _frequencies(segments: DataFrame, held, terms: int) -> np.ndarray:
    """Occurrences of each of the block's terms in all segments; their number is bounded by the block's size."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value.vocabulary
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for raw, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, own = _terms(raw, counts)
                asked = np.fromiter((vocabulary.get(t, -1) for t in names), dtype=np.int64, count=len(names))
                total[asked[asked >= 0]] += own[asked >= 0]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["term", "n"])

    found = segments.select("terms", "counts").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(terms, dtype=np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


_SPANS = "array<struct<start:int,end:int>>"
_MATCH = f"cid long, hit_spans {_SPANS}, items array<string>, near_items array<string>"


def _matcher(held, slop: int):
    """The matches of one block in each text that has any."""
    span = pa.struct([pa.field("start", pa.int32()), pa.field("end", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: TestWindows = held.value
        for batch in batches:
            for cids, lengths, *raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                segment = Segment(lengths, *raw, tests.vocabulary)
                spans: dict[int, list] = {}
                items: dict[int, set[str]] = {}
                near: dict[int, set[str]] = {}
                edges = np.zeros(int(segment.starts[-1]) + 1, dtype=np.int64)
                of = lambda at: np.searchsorted(segment.starts, at, side="right") - 1  # noqa: B023, E731
                for (windows, owners), rank in zip(tests.groups, tests.ranks, strict=True):
                    number, start = segment.phrases(windows, rank)
                    np.add.at(edges, start, 1)
                    np.add.at(edges, start + windows.shape[1], -1)
                    for w, d in set(zip(number.tolist(), of(start).tolist(), strict=True)):
                        items.setdefault(d, set()).update(tests.named(owners[w]))
                    number, place = segment.near(windows, rank, slop)
                    for w, d in set(zip(number.tolist(), of(place).tolist(), strict=True)):
                        near.setdefault(d, set()).update(tests.named(owners[w]))
                if items:
                    total = np.cumsum(edges) > 0
                    for d in items:
                        hit = total[segment.starts[d] : segment.starts[d + 1]]
                        turn = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                        spans[d] = [{"start": s, "end": e} for s, e in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)]
                rows = sorted({*items, *near})
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([cids[d] for d in rows], pa.int64()), pa.array([spans.get(d, []) for d in rows], pa.list_(span)),
                        pa.array([sorted(items.get(d, ())) for d in rows], pa.list_(pa.string())), pa.array([sorted(near.get(d, ())) for d in rows], pa.list_(pa.string())),
                    ],
                    names=["cid", "hit_spans", "items", "near_items"],
                )

    return run


def matches(segments: DataFrame, items: DataFrame, *, item_id: str = "item_id", item_text: str = "text", window: int = 13, block_bytes: int = 8_000_000, slop: int = NEAR) -> DataFrame:
    """(cid, hit_spans, n_hit, items, near_items) of each text with a match in any block."""
    sc, found = segments.sparkSession.sparkContext, segments.sparkSession.createDataFrame([], _MATCH)
    for block in _blocks(items, item_id, item_text, block_bytes):
        tests = TestWindows(block, window)
        words = sc.broadcast(tests)
        tests.rank(_frequencies(segments, words, len(tests.vocabulary)))
        words.destroy()
        held = sc.broadcast(tests)
        found = found.unionByName(common.durable(segments.mapInArrow(_matcher(held, slop), _MATCH)).dropDuplicates(["cid"]))  # copies match alike
        held.destroy()
    together = found.groupBy("cid").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("hit_spans", "items", "near_items")])
    # Spans of several blocks may overlap or touch.
    spans = F.array_sort(F.array_distinct("hit_spans"))
    walk = F.aggregate(
        spans, F.array().cast(_SPANS),
        lambda s, x: F.when((F.size(s) > 0) & (F.get(s, F.size(s) - 1)["end"] >= x["start"]), F.concat(
            F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.struct(F.get(s, F.size(s) - 1)["start"].alias("start"), F.greatest(F.get(s, F.size(s) - 1)["end"], x["end"]).alias("end")))
        )).otherwise(F.concat(s, F.array(x))),
    )
    ids = lambda c: F.array_sort(F.array_distinct(c)).alias(c)
    return together.select("cid", walk.alias("hit_spans"), ids("items"), ids("near_items")).withColumn(
        "n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))
    )


def mark(documents: DataFrame, items: DataFrame, *, text: str = "text", segments: DataFrame | None = None, **options) -> DataFrame:
    """documents with n_words, n_hit (long), hit_spans (array of [start, end) word ranges, disjoint and sorted), items (ids
    with an exact window in the document, sorted as strings) and near_items (ids with a proximity match). segments: the
    index of documents, if there is one; options: as of matches()."""
    segments = index(documents, text) if segments is None else segments
    lengths = segments.select(F.explode(F.arrays_zip("cids", "lengths")).alias("x")).groupBy(F.col("x.cids").alias("cid")).agg(F.first("x.lengths").cast("long").alias("n_words"))
    added = ["n_words", "n_hit", "hit_spans", "items", "near_items"]
    # A table of its own, so that the join's sides are plain shuffles and a text that very many documents have can be split.
    told = common.durable(lengths.join(matches(segments, items, **options), "cid", "left").select(F.col("cid").alias("_cid"), F.struct(*added).alias("_told")))
    held = documents.withColumn("_cid", F.when(F.col(text).isNotNull(), F.xxhash64(text)))
    zero, none = F.lit(0).cast("long"), lambda t: F.array().cast(t)
    defaults = {"n_words": zero, "n_hit": zero, "hit_spans": none(_SPANS), "items": none("array<string>"), "near_items": none("array<string>")}
    return held.join(told, "_cid", "left").select(
        *[F.col(f"`{c}`") for c in documents.columns if c not in added], *[F.coalesce(F.col(f"_told.{c}"), defaults[c]).alias(c) for c in added]
    )


#: Contaminated from one hit word in twenty on.
CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def digest(marked: DataFrame) -> DataFrame:
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"), F.size("near_items").cast("long").alias("n_near"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(mark(documents, common.table(spark, sf_dir, "benchmark")))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w"
#: The digest for DuckDB: exact windows by joining all word windows, proximity by joining the places of their words.
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} FROM benchmark),
windows AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
  SELECT item, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, k, item FROM grams JOIN windows USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY doc_id),
places AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d), often AS (SELECT t, count(*) AS c FROM places GROUP BY t),
terms AS (SELECT g, unnest(string_split(g, ' ')) AS t, unnest(range(1, len(string_split(g, ' ')) + 1)) AS j FROM (SELECT DISTINCT g FROM windows)),
rarest AS (SELECT g, arg_min(t, (c, j)) AS r, count(DISTINCT t) AS n FROM terms JOIN often USING (t) GROUP BY g HAVING count(*) = len(string_split(g, ' '))),
around AS (SELECT rarest.g, a.doc_id, a.p FROM rarest JOIN places a ON a.t = r JOIN (SELECT DISTINCT g, t FROM terms) x ON x.g = rarest.g
  JOIN places q ON q.doc_id = a.doc_id AND q.t = x.t AND q.p BETWEEN a.p - {NEAR} AND a.p + {NEAR} GROUP BY rarest.g, a.doc_id, a.p, n HAVING count(DISTINCT x.t) = n),
nears AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM around JOIN windows USING (g) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN nears USING (doc_id)
"""


def keep_clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    segments = index(documents)
    lengths = segments.select(F.explode(F.arrays_zip("cids", "lengths")).alias("x")).select(F.col("x.cids").alias("cid"), F.col("x.lengths").alias("n_words"))
    gone = common.durable(matches(segments, items).where("n_hit > 0").join(lengths, "cid").where(F.expr(CONTAMINATED)).select(F.col("cid").alias("_cid")).distinct())
    return documents.withColumn("_cid", F.xxhash64("text")).join(gone, "_cid", "left_anti").select([F.col(f"`{c}`") for c in documents.columns])


def brute_force(documents: list[tuple], items: list[tuple], window: int = 13) -> dict:
    """By trying every window at every word; for tests. doc_id to n_words, n_hit, n_items, items_sha256, contaminated, n_near."""
    out, often = {}, {}
    for _, text in documents:
        for w in words_of(text.encode() if text is not None else None):
            often[w] = often.get(w, 0) + 1
    for doc, text in documents:
        words = words_of(text.encode() if text is not None else None)
        hit, found, near = set(), set(), set()
        for item, test in items:
            terms = words_of(test.encode() if test is not None else None)
            size = min(window, len(terms))
            for i in range(len(terms) - size + 1 if size else 0):
                own = terms[i : i + size]
                for j in range(len(words) - size + 1):
                    if words[j : j + size] == own:
                        hit.update(range(j, j + size))
                        found.add(item)
                rarest = min(own, key=lambda w: often.get(w, 0))
                if any(w == rarest and set(own) <= set(words[max(0, j - NEAR) : j + NEAR + 1]) for j, w in enumerate(words)):
                    near.add(item)
        ids = sorted(str(x) for x in found if x is not None)
        out[doc] = (len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words), len(near - {None}))
    return out
