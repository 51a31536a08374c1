"""Document fingerprints by I-Match with randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency lies in a band: of
N documents at least N / ``RAREST`` and at most N / ``COMMONEST`` hold them.
Document frequencies count all documents. A text's terms outside the lexicon go,
the distinct others are sorted, and what of them lies in each of ``SUBSETS``
random subsets of the lexicon is hashed to 16 bits; zero stands for nothing. The
subsets keep from a quarter down to 1 / 2,048 of the terms, so that a few changed
words leave many hashes as they are, in short and in long texts.

The lexicon is broadcast as 8 bytes a term. Its size has a bound that doesn't
grow with the corpus: frequencies add up to N times the mean number of distinct
terms of a document, so at most ``RAREST`` times that mean are so frequent.

likeness() compares two fingerprints. How many subsets of each density hold terms
of either text tells how many terms both have together, and how many subsets
differ tells how many terms only one of them has, each as the most likely number.
That gives the common share J of both texts' lexicon terms; 2 J / (1 + J), the
share of one text's terms that the other has, is returned.

Defined cases: a text without lexicon terms takes all its terms instead; null
and empty texts, and those without any term, share one fingerprint of zeros, of
likeness 1 with each other; equal texts have equal fingerprints; repeated
documents count each by itself; an empty table gives no rows; columns besides
the results' are left out by the query and kept by fingerprints(), where what it
adds comes last and columns of the same names give way; texts of any length are
read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: The band: a term's documents are at least one in RAREST and at most one in COMMONEST.
RAREST, COMMONEST = 1_000, 20
#: Random subsets for each density; densities are 1/4, 1/8, ... 1/2048.
EACH, DENSITIES = 16, tuple(2.0**-j for j in range(2, 12))
SUBSETS = EACH * len(DENSITIES)
_SEEDS = np.random.default_rng(7).integers(1, 2**64, SUBSETS, dtype=np.uint64)
#: Numbers of terms that likeness() tells apart.
_NUMBERS = np.exp(np.arange(-1.5, 11, 0.02))
_BATCH_BYTES = 4_000_000
#: Lower-cases A-Z, keeps digits, a-z and every byte of non-ASCII characters; all else parts terms.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of each unsigned number spread over all its bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def distinct_terms(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, hash of the term), sorted, each once."""
    folded = [t.translate(_TERM_BYTES) if t else b"" for t in texts]
    words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pa.array(folded, pa.large_binary()).cast(pa.large_string())))
    sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(words.flatten())
    hashed = np.array([xxhash.xxh3_64_intdigest(w) if w else 0 for w in common.utf8(coded.dictionary)], dtype=np.uint64)
    # Codes in the order of the hashes, so that one sort of small numbers orders terms too.
    order = np.argsort(hashed, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    codes = place[coded.indices.to_numpy(zero_copy_only=False)]
    keys = np.unique(np.repeat(np.arange(len(texts), dtype=np.int64), sizes) * max(1, len(order)) + codes)
    of, code = np.divmod(keys, max(1, len(order)))
    terms = hashed[order][code]
    real = terms != 0  # white space around a text makes empty words
    return of[real], terms[real]


def _document_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in common.small_batches(batches, "text", _BATCH_BYTES):
        terms, n = np.unique(distinct_terms(common.utf8(part.column(0)))[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])


def lexicon(documents: DataFrame, text: str = "text", rarest: int = RAREST, commonest: int = COMMONEST) -> np.ndarray:
    """Hashes of the terms in the band, sorted."""
    texts = documents.select(F.col(text).alias("text"))
    n = texts.count()
    counted = texts.mapInArrow(_document_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = counted.where((F.col("n") * rarest >= n) & (F.col("n") * commonest <= n)).select("term").toArrow()
    return np.sort(band.column("term").to_numpy().view(np.uint64))


def hashes(texts: list[bytes | None], terms: np.ndarray) -> np.ndarray:
    """The 16-bit hashes (texts x SUBSETS) under a sorted lexicon."""
    of, term = distinct_terms(texts)
    at = np.minimum(np.searchsorted(terms, term), max(0, len(terms) - 1))
    inside = terms[at] == term if len(terms) else np.zeros(len(term), dtype=bool)
    some = np.bincount(of[inside], minlength=len(texts)) > 0
    inside |= ~some[of]
    of, term = of[inside], term[inside]
    out = np.zeros((len(texts), SUBSETS), dtype=np.uint16)
    for level, density in enumerate(DENSITIES):
        for j in range(level * EACH, level * EACH + EACH):
            drawn = _mixed(term ^ _SEEDS[j])
            keep = drawn < np.uint64(int(density * 2.0**64))
            owner = of[keep]
            if not len(owner):
                continue
            # Terms are in order, so each one's place among its text's terms goes into the hash.
            first = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
            place = np.arange(len(owner)) - np.repeat(first, np.diff(np.concatenate((first, [len(owner)]))))
            summed = _mixed(np.add.reduceat(_mixed(term[keep] ^ _mixed(place.astype(np.uint64) ^ _SEEDS[j])), first))
            out[owner[first], j] = 1 + summed % np.uint64(65_535)
    return out


def _terms_behind(subsets: np.ndarray) -> np.ndarray:
    """The most likely number of terms, if so many subsets of each density (rows x DENSITIES) hold any of them."""
    p = np.array(DENSITIES)
    chance = np.outer(p, _NUMBERS)
    fit = subsets @ np.log(-np.expm1(-chance)) - (EACH - subsets) @ chance
    return np.where(subsets.any(axis=1), _NUMBERS[fit.argmax(axis=1)], 0.0)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row's two fingerprints (arrays as of hashes()), 0 to 1."""
    by_density = lambda x: x.reshape(len(a), len(DENSITIES), EACH).sum(axis=2)
    either, one = _terms_behind(by_density((a > 0) | (b > 0))), _terms_behind(by_density(a != b))
    share = np.where(either > 0, np.clip(1 - one / np.maximum(either, 1e-9), 0, 1), 1.0)
    return 2 * share / (1 + share)


def shown(fingerprints: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in fingerprints.astype(">u2")]


def fingerprints(documents: DataFrame, terms: np.ndarray, text: str = "text") -> DataFrame:
    """documents without their text, with fingerprint (string)."""
    held = documents.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches, text, _BATCH_BYTES):
            texts = common.utf8(batch.column(batch.schema.get_field_index(text)))
            yield common.extended(batch.select([n for n in batch.schema.names if n != text]), fingerprint=pa.array(shown(hashes(texts, held.value)), pa.string()))

    return documents.mapInArrow(run, common.with_fields(T.StructType([f for f in documents.schema.fields if f.name != text]), T.StructField("fingerprint", T.StringType())))


def successors(documents: DataFrame, buckets: int | None = None) -> DataFrame:
    """(bucket, guest, doc_id, text), sorted in each partition by these columns, so that each document is followed by the
    next one in the order of doc_id (nulls last, equal ids by text). Documents lie in buckets of consecutive ids; a bucket
    ends with a guest, a copy of the first document of the next bucket, and the last bucket with the very first document."""
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets or 4 * parts
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("at", F.col("doc_id").cast("double"))
    cuts = docs.agg(F.percentile_approx("at", [i / buckets for i in range(1, buckets)] or [0.5], 100 * buckets)).first()[0] or [0.0]
    bounds = [-float("inf"), *sorted(set(cuts)), float("inf")]
    dealt = Bucketizer(splits=bounds, inputCol="at", outputCol="bucket", handleInvalid="keep").transform(docs).withColumn("bucket", F.coalesce(F.col("bucket").cast("int"), F.lit(len(bounds)))).drop("at")
    heads = sorted((r["bucket"], r["first"]) for r in dealt.groupBy("bucket").agg(F.min("doc_id").alias("first")).collect())
    if not heads:
        return dealt.select("bucket", F.lit(0).alias("guest"), "doc_id", "text")
    # As many rows as buckets: the bucket of the heads' ids, and the bucket before it.
    before = [(b, heads[i - 1][0], first) for i, (b, first) in enumerate(heads)]
    known = spark.createDataFrame(before, "bucket int, before int, first long")
    guests = (
        dealt.join(F.broadcast(known), (dealt["bucket"] == known["bucket"]) & dealt["doc_id"].eqNullSafe(known["first"]))
        .groupBy("before").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text")).select(F.col("before").alias("bucket"), F.lit(1).alias("guest"), "doc_id", "text")
    )
    rows = dealt.select("bucket", F.lit(0).alias("guest"), "doc_id", "text").unionByName(guests)
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.asc_nulls_last("doc_id"), "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """text with the later half of its characters replaced by the first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(documents: DataFrame, terms: np.ndarray, buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document."""
    held = documents.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (row, fingerprint) whose follower is still to come
        for batch in common.small_batches(batches, "text", _BATCH_BYTES):
            _, guest, ids, texts = (batch.column(i).to_pylist() for i in range(4))
            prints = hashes([t.encode() for t in texts], held.value)
            rows = list(zip(guest, ids, texts, prints, strict=True))
            if last is not None:
                rows.insert(0, last)
            last = rows[-1]
            # A guest closes its bucket and is no document there.
            at = [i for i in range(len(rows) - 1) if not rows[i][0]]
            changed = [edited(rows[i][2], rows[i + 1][2]).encode() for i in at]
            own = np.array([rows[i][3] for i in at], dtype=np.uint16).reshape(-1, SUBSETS)
            follow = np.array([rows[i + 1][3] for i in at], dtype=np.uint16).reshape(-1, SUBSETS)
            new = hashes(changed, held.value)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i][1] for i in at], pa.int64()), pa.array([len(rows[i][2]) for i in at], pa.int64()),
                    pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()), pa.array(shown(own), pa.string()), pa.array(shown(new), pa.string()),
                    pa.array(likeness(own, new)), pa.array(likeness(own, follow)),
                ],
                names=[f.split()[0] for f in RESULT.split(", ")],
            )

    return successors(documents, buckets).mapInArrow(run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return compared(documents, lexicon(documents))
