"""Language identification with error-correcting output codes.

Each language gets a codeword; one binary n-gram classifier per bit predicts
its bits from a text's hashed byte 2-grams and 3-grams. Decoding adds up, for
each codeword, the classifiers' losses (weighted by how reliable each was in
training) and chooses the codeword of least loss; a text whose two best
codewords are close is flagged as ambiguous.

The classifiers are fitted on a bounded sample of labelled training documents,
chosen by a hash of doc_id and text: about ``ROWS_PER_LABEL`` of each language, and
about ``SAMPLE_ROWS`` of all languages together, but one at least of each. All
languages are learned. Features are made where the documents are; only the
sample's travel, as bytes. Everything else covers all documents and whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
without any labelled document all texts are ``und``; with one language every
text with a letter is that language; of codewords that fit alike the one of the
language that sorts first is chosen. Null lang isn't learned from; repeated rows
count each; an empty table gives one; lang_pred, score and ambiguous come last,
and columns of the same names give way; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Buckets of hashed n-grams.
BUCKETS = 1 << 13
ROWS_PER_LABEL, SAMPLE_ROWS = 400, 8_000
#: A text is ambiguous where its best codeword leads the next by less than this share of the loss.
MARGIN = 0.1
_BATCH_BYTES = 2_000_000

#: ASCII letters to lower case, other non-letters of ASCII to one space; bytes of other characters as they are.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], dtype=np.uint32)


def features(text: bytes) -> np.ndarray:
    """Log counts of hashed 2-grams and 3-grams of the whole text, of unit length."""
    x = _FOLD[np.frombuffer(b" " + text + b" ", dtype=np.uint8)]
    x = x[np.concatenate(([True], (x[1:] != 32) | (x[:-1] != 32)))]
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + x[2:] * np.uint32(0x27D4EB2F)
    counts = np.bincount(two >> np.uint32(19), minlength=BUCKETS) + np.bincount(three >> np.uint32(19), minlength=BUCKETS)
    logs = np.log1p(counts).astype(np.float32)
    return logs / max(1e-9, float(np.sqrt(logs @ logs)))


def codewords(n: int) -> np.ndarray:
    """n distinct codewords of +1 and -1, with no constant column: all possible columns for few labels, else random ones
    whose smallest distance is the best of several draws."""
    if n <= 6:
        columns = [[1] + [1 if c >> i & 1 else -1 for i in range(n - 1)] for c in range(2 ** (n - 1) - 1)]
        return np.array(columns, dtype=np.float32).T if columns else np.ones((1, 1), dtype=np.float32)
    random, best, most = np.random.default_rng(8), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(50):
        code = np.where(random.random((n, bits)) < 0.5, 1, -1).astype(np.float32)
        distance = int(((bits - code @ code.T) / 2 + bits * np.eye(n)).min())
        if distance > most and (np.abs(code.sum(axis=0)) < n).all():
            best, most = code, distance
    return best


class Model:
    """Codewords, and a linear classifier with a weight for each of their bits."""

    def __init__(self, labels: list[str], rows: np.ndarray, of: np.ndarray, rounds: int = 150):
        self.labels = labels
        self.code = codewords(len(labels)) if labels else np.ones((0, 1), dtype=np.float32)
        bits = self.code.shape[1]
        self.weights, self.bias = np.zeros((BUCKETS, bits), dtype=np.float32), np.zeros(bits, dtype=np.float32)
        self.trust = np.ones(bits, dtype=np.float32)
        if len(labels) > 1:
            wanted = self.code[of]
            # Labels count alike, however many rows each has.
            share = 1.0 / np.maximum(1, np.bincount(of, minlength=len(labels)))[of]
            share = (share / share.sum()).astype(np.float32)[:, None]
            speed_w, speed_b = np.zeros_like(self.weights), np.zeros_like(self.bias)
            for i in range(rounds):  # logistic loss, gradient descent with momentum
                margin = wanted * (rows @ self.weights + self.bias)
                pull = share * wanted / (1 + np.exp(np.clip(margin, -30, 30)))
                speed_w = 0.9 * speed_w + rows.T @ pull - 1e-6 * self.weights
                speed_b = 0.9 * speed_b + pull.sum(axis=0)
                self.weights += 10.0 * speed_w
                self.bias += 2.0 * speed_b
            margin = wanted * (rows @ self.weights + self.bias)
            self.trust = np.maximum(0.05, 1 - 2 * (share * (margin <= 0)).sum(axis=0)).astype(np.float32)
            self.trust /= self.trust.mean()

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label numbers, scores (0 to 1) and ambiguity."""
        said = rows @ self.weights + self.bias
        losses = np.logaddexp(0, -said[:, None, :] * self.code[None]) @ self.trust
        order = np.argsort(losses, axis=1, kind="stable")
        first = order[:, 0]
        least = losses[np.arange(len(rows)), first]
        if len(self.labels) < 2:
            return first, np.ones(len(rows)), np.zeros(len(rows), dtype=bool)
        second = losses[np.arange(len(rows)), order[:, 1]]
        share = np.exp(least[:, None] - losses)
        return first, 1 / share.sum(axis=1), (second - least) < MARGIN * second


def _featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, text): languages and features, as compressed 32-bit floats."""
    compress = zstandard.ZstdCompressor(level=1).compress
    for batch in common.small_batches(batches, "text", _BATCH_BYTES):
        rows = [compress(features(t).tobytes()) for t in common.utf8(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["lang", "features"])


def _sample(documents: DataFrame, rows_per_label: int, sample_rows: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All labels, and a bounded number of rows of features with their labels' numbers."""
    labelled = documents.where("lang is not null and text is not null")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.xxhash64(F.lit(8), "doc_id", "text")).alias("least")).collect()
    labels = sorted(r["lang"] for r in counts)
    none = np.zeros((0, BUCKETS), dtype=np.float32)
    if not labels:
        return [], none, np.zeros(0, dtype=np.int64)
    # A row is drawn if its hash falls below its language's share; the least one always is.
    wanted = min(rows_per_label, max(1, sample_rows // len(labels)))
    below = documents.sparkSession.createDataFrame(
        [(r["lang"], max(r["least"], min(2**63 - 1, int(-(2**63) + min(1.0, wanted / r["n"]) * 2**64)))) for r in counts], "lang string, below long"
    )
    drawn = labelled.select("lang", "text", F.xxhash64(F.lit(8), "doc_id", "text").alias("h")).join(F.broadcast(below), "lang").where("h <= below").select("lang", "text")
    made = drawn.mapInArrow(_featured, "lang string, features binary").limit(2 * wanted * len(labels) + len(labels)).toArrow()
    number = {x: i for i, x in enumerate(labels)}
    expand = zstandard.ZstdDecompressor().decompress
    rows = np.frombuffer(b"".join(map(expand, made.column("features").to_pylist())), dtype=np.float32).reshape(-1, BUCKETS) if made.num_rows else none
    return labels, rows, np.array([number[x] for x in made.column("lang").to_pylist()], dtype=np.int64)


def fit(documents: DataFrame, *, rows_per_label: int = ROWS_PER_LABEL, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of documents (doc_id, text, lang)."""
    return Model(*_sample(documents, rows_per_label, sample_rows))


def identify(documents: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """documents with lang_pred, score (double) and ambiguous (boolean)."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}").search
        own: Model = held.value
        for batch in common.small_batches(batches, text, _BATCH_BYTES):
            column = batch.column(batch.schema.get_field_index(text))
            n = batch.num_rows
            pred, score, unsure = np.full(n, "und", dtype=object), np.zeros(n), np.zeros(n, dtype=bool)
            told = np.flatnonzero([t is not None and bool(own.labels) and letter(t) is not None for t in column.to_pylist()])
            raw = common.utf8(column)
            for i in range(0, len(told), 256):
                rows = told[i : i + 256]
                first, score[rows], unsure[rows] = own.predict(np.array([features(raw[r]) for r in rows.tolist()]))
                pred[rows] = np.array(own.labels, dtype=object)[first]
            yield common.extended(batch, lang_pred=pa.array(pred, pa.string()), score=pa.array(score, pa.float64()), ambiguous=pa.array(unsure, pa.bool_()))

    added = (T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType()))
    return documents.mapInArrow(run, common.with_fields(documents.schema, *added))


def held_out(doc_id: str = "doc_id") -> Column:
    """A null doc_id hashes as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(documents.where(~held_out()))
    return identify(documents.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(documents: DataFrame) -> DataFrame:
    """The documents whose language is known, with their own columns. Only und is rejected; an ambiguous text is kept."""
    model = fit(documents.where(~held_out()).select("doc_id", "text", "lang"))
    names = documents.columns
    held = documents.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    found = identify(held, model, text=f"c{names.index('text')}").where("lang_pred <> 'und'")
    return found.select([F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
