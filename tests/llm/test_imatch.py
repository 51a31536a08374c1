"""Fingerprints against plain loops over numbers of Python, and on the odd cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from quillstone.llm import imatch

from .test_operators import words

SCHEMA = "doc_id long, text string, fingerprint string, bucket int, guest int"
M = 2**64


def mixed(x):
    x = (x ^ (x >> 31)) * 0x7FB5D329728EA185 % M
    x = (x ^ (x >> 27)) * 0x81DADEF4BC2DD44D % M
    return x ^ (x >> 33)


def terms_of(text):
    folded = "".join(c.lower() if c.isascii() else c for c in text or "")
    return {xxhash.xxh3_64_intdigest(w.encode()) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)}


def plain(text, lexicon):
    terms = sorted(terms_of(text) & lexicon or terms_of(text))
    out = ""
    for j, seed in enumerate(imatch._SEEDS.tolist()):
        kept = [t for t in terms if mixed(t ^ seed) < int(imatch.DENSITIES[j // imatch.EACH] * 2.0**64)]
        value = mixed(sum(mixed(t ^ mixed(i ^ seed)) for i, t in enumerate(kept)) % M)
        out += f"{1 + value % 65_535 if kept else 0:04x}"
    return out


def corpus():
    texts = [words(5 + 11 * i % 90, 300 + i) for i in range(90)]
    texts += [None, "", " .,! ", "one", "Ünïcödé ÀB жук 日本語 ab\x00cd", "x" * 3_000, words(9_000, 400), texts[3], texts[3], "a b " * 500, "😀😀 é"]
    return list(enumerate(texts))


@pytest.mark.parametrize("buckets", [1, 7, 60])
def test_against_plain_loops(spark, buckets):
    rows = corpus()
    rows += [(None, "without an id"), (7, rows[7][1]), (7, "another under one id")]
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA).repartition(5)
    lexicon = imatch.lexicon(frame, rarest=60, commonest=3)
    held = Counter(t for _, text in rows for t in terms_of(text))
    assert lexicon.tolist() == sorted(t for t, n in held.items() if n * 60 >= len(rows) and n * 3 <= len(rows)) and len(lexicon) > 20
    got = sorted(tuple(r) for r in imatch.compared(frame, lexicon, buckets).collect() if r["doc_id"] is not None)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    known, want = set(lexicon.tolist()), []
    for i, (doc_id, text) in enumerate(order):
        text, follow = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + follow[:half]
        want.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), plain(text, known), plain(new, known)))
    assert [g[:5] for g in got] == sorted(w for w in want if w[0] is not None)
    assert all(0 <= g[5] <= 1 and 0 <= g[6] <= 1 for g in got)
    assert all((g[5] == 1) == (g[3] == g[4]) for g in got)


def test_likeness(spark):
    base = [words(1, 7_000 + i) + str(i) for i in range(400)]
    halves = [" ".join(base), " ".join(base[:390]), " ".join(base[:200] + [b + "z" for b in base[200:]]), " ".join(b + "y" for b in base), ""]
    prints = imatch.hashes([h.encode() for h in halves], np.zeros(0, dtype=np.uint64))
    same, near, half, none, empty = imatch.likeness(np.repeat(prints[:1], 5, axis=0), prints)
    assert same == 1 and near > 0.95 and 0.35 < half < 0.65 and none < 0.1 and empty == 0
    assert imatch.likeness(prints[4:], prints[4:]).tolist() == [1.0]


def test_fingerprints_and_nothing(spark):
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in corpus()], SCHEMA).repartition(3)
    lexicon = imatch.lexicon(frame, rarest=60, commonest=3)
    made = imatch.fingerprints(frame, lexicon)
    assert made.columns == ["doc_id", "bucket", "guest", "fingerprint"]
    got = {r["doc_id"]: r["fingerprint"] for r in made.collect()}
    assert all(got[i] == plain(t, set(lexicon.tolist())) for i, t in corpus())
    none = spark.createDataFrame([], SCHEMA)
    assert not len(imatch.lexicon(none)) and imatch.compared(none, imatch.lexicon(none)).count() == 0
    alone = spark.createDataFrame([(4, "ab cd ef gh", "x", 1, 2)], SCHEMA)
    assert imatch.compared(alone, imatch.lexicon(alone)).first()["edited_sha256"] == hashlib.sha256(b"ab cd ab cd"[:6] + b"ab cd").hexdigest()
