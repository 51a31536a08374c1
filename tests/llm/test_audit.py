"""The source audit against plain loops, and on the odd cases."""

import re
from collections import Counter, defaultdict

import pytest

from quillstone.llm import audit

from .test_operators import words

SCHEMA = "doc_id long, text string, lang string, source string, term string, value long, n int"


def plain(rows, least, prior, top):
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        folded = "".join(c.lower() if c.isascii() else c for c in text or "")
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded))
        counts[lang, source].update(found)
        documents[lang].update(found.keys())
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in documents[lang].items() if n >= least]
        sources = [s for at, s in groups if at == lang]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = lambda n, all_n: 1 + 10**9 * (n + prior) // (all_n + prior * len(kept))
        p = {(s, t): share(counts[lang, s][t], total[s]) for s in sources for t in kept}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        ranked = lambda items: sorted(items, key=lambda x: (-x[1], x[0].encode()))
        for s in sources:
            pairs = ranked([(o, sum(abs(p[s, t] - p[o, t]) for t in kept)) for o in sources if o != s])
            terms = ranked([(t, p[s, t] - q[t]) for t in kept if counts[lang, s][t] and p[s, t] > q[t]])[:top]
            out |= {(lang, s, part, item, value, i + 1) for part, of in (("pair", pairs), ("term", terms)) for i, (item, value) in enumerate(of)}
    return out


@pytest.mark.parametrize("least", [1, 3])
def test_against_plain_loops(spark, least):
    rows = [(words(40, i), "en" if i % 3 else "de", f"s{i % 5}") for i in range(60)]
    rows += [(None, "en", "s0"), ("", None, None), ("Ab aB ÀB Éa\x00tail 12 x_y", None, "s1"), ("1 2 3", "fr", "only"), ("", "it", "a"), (None, "it", "b"), ("same same", "en", "s1"), ("same same", "en", "s1"), ("long " * 60_000, "en", "s2")]
    frame = spark.createDataFrame([(i, t, la, s, "term", 1, 2) for i, (t, la, s) in enumerate(rows)], SCHEMA).repartition(4)
    got = audit.audit(frame, least=least, top=4, shards=3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows, least, 5, 4)
    assert ("it", "a", "pair", "b", 0, 1) in found


def test_nothing(spark):
    assert audit.audit(spark.createDataFrame([], SCHEMA), shards=2).count() == 0
