"""Each operator against a brute-force version, and on the odd cases: nulls, empty and long texts, ties, repeated rows,
empty tables, and extra columns whose names clash with results."""

import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillstone.llm import ann, bpe, chat, decontaminate, graph, html, langid, lm, passages, registry, simhash, suffix

random.seed(5)
_SYLLABLES = "an be cor dal el fin gor hu is jat kel lo mar nus or pel qui ras sol tur".split()


def words(n, seed=None):
    r = random.Random(seed) if seed is not None else random
    return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words int, fp string, ids string"


def rows(texts):
    """Documents with columns that clash with the operators' own."""
    return [(i, t, "xx", "s", len(t or ""), 7, "fp", "ids") for i, t in texts]


def corpus():
    shared, long = words(90, 1), words(4000, 2)
    texts = [words(1 + 37 * i % 120, 1000 + i) for i in range(40)]
    texts += [shared + " " + words(30, 91), words(20, 92) + "\n" + shared, words(5, 93) + " " + shared + " " + words(5, 94)]
    near = words(200, 95).split()
    texts.append(" ".join(near))
    near[70] = "changed"
    texts += [" ".join(near), " ".join(near)]
    texts += ["", "   ", "one", "A b\tC d", "é" * 300, "x" * 1500, long, "ab " * 400, "日本語 текст \x00 nul", "1234 !!"]
    return [*enumerate(texts), (900, None), (901, None), (3, texts[3])]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(rows(corpus()), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def as_dict(df, key="doc_id"):
    return {r[key]: tuple(r)[1:] for r in df.collect()}


# Nearest neighbours


def test_neighbours(spark):
    r = np.random.default_rng(1)
    data = [(i, [float(x) for x in r.normal(size=8)]) for i in range(600)]
    data += [(600 + i, [1.0] * 8) for i in range(80)]  # one vector that many share
    data += [(700, None), (701, [0.0] * 8), (702, [None] + [1.0] * 7), (703, [float("nan")] * 8), (704, [float("inf")] + [0.0] * 7), (705, [1.0]), (5, data[5][1])]
    vectors = spark.createDataFrame([(i, v, "q") for i, v in data], "vec_id long, embedding array<double>, score string").repartition(3)
    found = ann.search(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()
    truth = ann.brute_force([d for d in data[:-2]], set(range(0, 720, 20)), 20)
    got = {}
    for row in sorted(found, key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    assert set(got) == set(truth)
    assert all([x[0] for x in g] == list(range(1, 21)) and all(x[1] != q for x in g) for q, g in got.items())
    assert all(g == sorted(g, key=lambda x: (-x[2], x[1])) for g in got.values())
    share = np.mean([len({x[1] for x in got[q]} & set(truth[q])) / 20 for q in truth])
    assert share >= 0.9
    assert [x[1] for x in got[600]] == [600 + i for i in range(1, 21)] or share < 1


def test_neighbours_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<float>")
    found = ann.search(few, few.where("vec_id = 0"), 20).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(1, 0.5), (2, 0.5)]
    assert ann.search(few.limit(0), few, 3).collect() == [] and ann.search(few, few.limit(0), 3).collect() == []


def test_neighbours_widen_until_there_are_enough(spark):
    """Far clusters of few rows each: a query's own leaves hold fewer rows than it asks for."""
    r = np.random.default_rng(6)
    rows = [(20 * i + j, [float(x) for x in r.normal(size=8) * 0.01 + np.eye(8)[i % 8] * (1 + i)]) for i in range(30) for j in range(4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(frame, frame.where("vec_id % 20 = 0"), 20, recall=0.01)
    assert {r["query_id"]: r["n"] for r in got.groupBy("query_id").count().withColumnRenamed("count", "n").collect()} == {20 * i: 20 for i in range(30)}


def test_neighbours_in_chunks(spark):
    r = np.random.default_rng(2)
    data = [(i, [float(x) for x in r.normal(size=4)]) for i in range(300)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    asked = vectors.where("vec_id < 40")
    whole = {tuple(x) for x in ann.search(vectors, asked, 5, recall=1.0).collect()}
    parts = {tuple(x) for x in ann.search(vectors, asked, 5, recall=1.0, chunk_rows=7, chunk_queries=3).collect()}
    assert whole == parts


# Passages


def test_passages(spark, documents, nothing):
    found = passages.passages(documents).collect()
    linked = {frozenset((r["doc_id"], r["class_id"])) for r in found}
    assert frozenset((40, 41)) in linked or frozenset((41, 42)) in linked
    together = {x for pair in linked for x in pair}
    assert {40, 41, 42, 43, 44, 45} <= together and not together & set(range(40))
    copy = [r for r in found if r["kind"] == "copy" and r["doc_id"] == 45]
    assert [r["class_id"] for r in copy] == [44]
    assert passages.passages(nothing).collect() == []


def test_chains_follow_both_texts():
    matches = [(0, 5), (10, 15), (20, 25), (30, 2), (500, 505)]
    assert passages.chains(matches) == [[(0, 5), (10, 15), (20, 25)]]
    best = passages.chains([(i * 10, i * 10) for i in range(5)] + [(0, 40), (10, 30), (40, 0)])
    assert best[0] == [(i * 10, i * 10) for i in range(5)]


def test_chain_worth_is_the_best_of_all(seed=3):
    r = random.Random(seed)
    for _ in range(50):
        points = sorted({(r.randint(0, 60), r.randint(0, 60)) for _ in range(8)})
        worth = {}
        for x, y in points:  # plain dynamic programme
            worth[x, y] = max([1.0] + [worth[p] + 1 - 0.01 * (x - p[0] + y - p[1]) for p in points if p[0] < x and p[1] < y])
        found = passages.chains(points)
        if found:
            c = found[0]
            got = 1 + sum(1 - 0.01 * (b[0] - a[0] + b[1] - a[1]) for a, b in zip(c, c[1:], strict=False))
            assert abs(got - max(worth.values())) < 1e-9 or max(worth.values()) == 1.0


def test_common_subsequence():
    r = random.Random(4)
    for _ in range(50):
        a, b = [r.randint(0, 4) for _ in range(r.randint(0, 12))], [r.randint(0, 4) for _ in range(r.randint(0, 12))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert passages._common(np.array(a), np.array(b)) == table[-1][-1]


def test_passage_with_gap_is_fuzzy(spark):
    base = words(120, 50).split()
    other = base[:40] + ["zz", "yy"] + base[41:80] + base[84:]
    found = passages.passages(spark.createDataFrame([(1, " ".join(base)), (2, words(30, 51) + " " + " ".join(other))], "doc_id long, text string")).collect()
    assert len(found) == 1 and 0.8 <= found[0]["identity"] < 1 and found[0]["end"] - found[0]["begin"] > 100


def test_passage_of_texts_whose_parts_stand_in_others(spark):
    """Two texts share 60 words; fragments of them stand in two others (few holders) or in sixty (many)."""
    cases = []
    for others in (2, 60):
        for seed in range(12):
            own = 1_000_000 * others + 10_000 * seed
            base = words(60, own).split()
            texts = [words(30, own + 1) + " " + " ".join(base) + " " + words(30, own + 2), words(20, own + 3) + " " + " ".join(base)]
            texts += [words(25, own + 10 * i) + " " + " ".join(base[:34] if i % 2 else base[26:]) + " " + words(25, own + 10 * i + 1) for i in range(1, others + 1)]
            cases.append(texts)
    texts = [(1_000 * k + i, t) for k, case in enumerate(cases) for i, t in enumerate(case)]
    found = passages.passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    linked = {frozenset((r["doc_id"], r["class_id"])) for r in found}
    assert [k for k in range(len(cases)) if frozenset((1_000 * k, 1_000 * k + 1)) not in linked] == []


def test_passage_under_very_many_fragments(spark):
    """Two texts share 100 words; 640 others hold fifteen of them each."""
    base = words(100, 71).split()
    texts = [words(40, 72) + " " + " ".join(base), " ".join(base) + " " + words(40, 73)]
    texts += [words(20, 2_000 + i) + " " + " ".join(base[i % 85 : i % 85 + 15]) + " " + words(20, 5_000 + i) for i in range(640)]
    found = passages.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [{r["doc_id"], r["class_id"]} for r in found] == [{0, 1}] and found[0]["end"] - found[0]["begin"] == 100


def test_passages_against_all_pairs(spark):
    """Texts made of passages of 60 words and of fragments: all that share 50 words in a row are connected by rows of
    overlapping ranges, and every row holds what it says."""
    r = random.Random(9)
    pool = [words(60, 300 + i).split() for i in range(12)]
    texts = []
    for i in range(90):
        text = words(r.randint(3, 25), 7_000 + i).split()
        for _ in range(r.randint(1, 3)):
            passage = r.choice(pool[: 3 if i % 2 else 12])
            start, size = (0, 60) if r.random() < 0.5 else (r.randint(0, 40), 20)
            text += passage[start : start + size] + words(r.randint(1, 9), r.randint(10**5, 10**6)).split()
        texts.append(text)
    found = passages.passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    for f in found:
        a, b = texts[f["class_id"]][f["class_begin"] : f["class_end"]], texts[f["doc_id"]][f["begin"] : f["end"]]
        assert f["identity"] >= 0.8 and min(len(a), len(b)) >= 50
        assert passages._common(np.array([hash(w) for w in a]), np.array([hash(w) for w in b])) >= 0.8 * min(len(a), len(b)) - 1
    holders: dict[tuple, list] = {}
    for i, t in enumerate(texts):
        for at in range(len(t) - 49):
            holders.setdefault(tuple(t[at : at + 50]), []).append((i, at))
    ranges = [((f["class_id"], f["class_begin"], f["class_end"]), (f["doc_id"], f["begin"], f["end"])) for f in found]
    for held in [holders.get(tuple(x[at : at + 50]), ()) for x in pool for at in range(11)]:
        if len({i for i, _ in held}) < 2:
            continue
        reached, open_ = {held[0][0]}, [held[0][0]]
        where = {i: [at + 25 for j, at in held if j == i] for i, _ in held}
        while open_:  # along rows that hold the middle of the 50 words on either side
            i = open_.pop()
            for side in ranges:
                for (p, p0, p1), (q, q0, q1) in (side, side[::-1]):
                    if p == i and q in where and q not in reached and any(p0 <= x < p1 for x in where[i]) and any(q0 <= x < q1 for x in where[q]):
                        reached.add(q)
                        open_.append(q)
        assert reached == set(where)


def test_seeds_of_short_and_repeated_texts():
    import pyarrow as pa

    texts = ["", None, "a b c d", "a b c d e", " A b c d e ", words(7, 5), words(300, 6), "ab " * 50, words(12, 7)]
    of, at, h = passages.seeds_of(pa.array(texts, pa.string()))
    assert not set(of.tolist()) & {0, 1, 2} and set(of.tolist()) == {3, 4, 5, 6, 7, 8}
    assert h[of == 3].tolist() == h[of == 4].tolist()
    for i in (5, 6, 8):  # each text by itself, window by window
        _, _, own = passages.seeds_of(pa.array([texts[i]], pa.string()))
        assert own.tolist() == h[of == i].tolist()
        places = set(at[of == i].tolist())
        n = len(texts[i].split()) - 4
        assert all(places & set(range(j, min(j + 8, n))) for j in range(max(1, n - 7)))


def test_a_text_that_repeats_a_shared_passage_loses_no_occurrence(spark):
    passage = words(300, 77)
    texts = [words(40, 7_700) + " " + passage + " " + words(90, 7_701) + " " + passage + " " + words(70, 7_702) + " " + passage + " " + words(30, 7_703)]
    texts += [words(20 + i, 7_800 + i) + " " + passage + " " + words(25, 7_900 + i) for i in range(6)]
    found = passages.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    covered = np.zeros(len(texts[0].split()), dtype=bool)
    for r in found:
        if r["kind"] == "passage":
            for side, at, to in (("doc_id", "begin", "end"), ("class_id", "class_begin", "class_end")):
                if r[side] == 0:
                    covered[r[at] : r[to]] = True
    starts = (40, 430, 800)
    assert [int(covered[s : s + 300].sum()) for s in starts] == [300, 300, 300]


def test_passages_of_texts_that_repeat_words(spark):
    """Two, or seven, texts repeat a word, or three in turn, for over 50 words, others for 20 to 40 words only."""
    texts, groups = [], []
    for k, (unit, long) in enumerate([("der", 2), ("der", 7), ("la lo lu", 2), ("la lo lu", 7)]):
        for n in [60 + 13 * i for i in range(long)] + [20 + i for i in range(21)]:
            repeated = f" {' '.join((f'{k}{unit} ' * n).split()[:n])} "
            texts.append(words(25, 40_000 + len(texts)) + repeated + words(25, 50_000 + len(texts)))
        groups.append(set(range(len(texts) - 21 - long, len(texts) - 21)))
    found = passages.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    pairs = {(r["doc_id"], r["class_id"]) for r in found}
    for group in groups:
        reached = {min(group)}
        for _ in group:
            reached |= {x for pair in pairs for x in pair if reached & set(pair)}
        assert reached == group
    for f in found:
        a, b = texts[f["class_id"]].split()[f["class_begin"] : f["class_end"]], texts[f["doc_id"]].split()[f["begin"] : f["end"]]
        assert min(len(a), len(b)) >= 50 and f["identity"] >= 0.8


def test_passages_query_names_every_holder_as_doc_id(spark, tmp_path):
    passage = words(60, 611)
    texts = [words(20 + i, 620 + i) + " " + passage + " " + words(9, 640 + i) for i in range(9)] + [words(90, 660 + i) for i in range(5)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = [r.asDict() for r in passages.query(spark, str(tmp_path)).collect()]
    assert {r["doc_id"] for r in found} == set(range(9))
    sides = {(r["doc_id"], r["begin"], r["end"], r["class_id"], r["class_begin"], r["class_end"]) for r in found}
    assert len(found) == len(sides) and {(*s[3:], *s[:3]) for s in sides} == sides


def test_neighbours_across_batches_and_partitions():
    """Each row meets the nearest row of another text on one side, however the sorted rows are dealt."""
    r = random.Random(31)
    rows = sorted((bytes([r.randint(0, 2)]) * 9 + bytes([r.randint(0, 40)]), r.randint(0, 3), i) for i in range(300))
    pairs = set()
    for i, (key, cid, pos) in enumerate(rows):
        for step in (1, -1):
            j = i + step
            while 0 <= j < len(rows) and rows[j][0][:9] == key[:9] and rows[j][1] == cid:
                j += step
            if 0 <= j < len(rows) and rows[j][0][:9] == key[:9]:
                pairs.add(tuple(sorted(((cid, pos), rows[j][1:]))))
    kind = pa.schema([("key", pa.binary()), ("cid", pa.int64()), ("pos", pa.int32())])
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*part, strict=True), kind, strict=True)], schema=kind)
    out = lambda dealt: [x for b in passages._neighbours(dealt) for x in b.to_pylist()]
    for size, parts in ((300, 1), (7, 1), (1, 1), (50, 6), (3, 20), (300, 300)):
        got, edge = [], []
        step = -(-len(rows) // parts)
        for p in range(0, len(rows), step):
            part = rows[p : p + step]
            for x in out([batch(part[i : i + size]) for i in range(0, len(part), size)]):
                (edge if x["edge"] is not None else got).append(x)
        ends = sorted({(x["edge"], x["a"], x["x"]) for x in edge})
        got += [x for x in out([batch(ends)]) if x["edge"] is None]
        found = {((x["a"], x["x"]), (x["b"], x["y"])) for x in got}
        # Every row that has a partner gets one, and texts that stand side by side are joined.
        assert parts > 1 or found <= pairs
        assert {x for p in found for x in p} == {x for p in pairs for x in p}
        beside = {tuple(sorted((a[1:], b[1:]))) for a, b in zip(rows, rows[1:]) if a[0][:9] == b[0][:9] and a[1] != b[1]}
        assert beside <= found


def test_passage_next_to_what_agrees_less_is_kept():
    r = np.random.default_rng(8)
    exact, other, end = r.integers(0, 2**32, 52), r.integers(0, 2**32, (2, 20)), r.integers(0, 2**32, 6)
    a, b = (np.concatenate((exact, other[i], end)) for i in (0, 1))
    assert passages.align(a, b, [0, 20, 47, 72], [0, 20, 47, 72]) == [(0, 52, 0, 52, 3, 1.0)]
    # An inserted word shifts what follows; 200 equal words stand before 200 of which some 55 in 100 agree, in short runs.
    a = r.integers(0, 2**32, 400)
    b = a.copy()
    at = np.flatnonzero(np.arange(200) % 11 >= 6) + 200
    b[at] = r.integers(0, 2**32, len(at))
    b = np.insert(b, 100, 7)
    places = [0, 50, 120, *range(198, 396, 11)]
    found = passages.align(a, b, places, [x + (x > 100) for x in places])
    assert found[0][:4] == (0, 206, 0, 207) and found[0][5] > 0.99 and all(f[5] >= 0.8 for f in found)
    # Against all ranges.
    for _ in range(30):
        agreed = (r.random(90) < 0.75).astype(np.int64)
        score = 1000 * agreed - 800
        sums = np.concatenate(([0], np.cumsum(score)))
        longest = max(j - i for i in range(91) for j in range(i, 91) if sums[j] >= sums[i])
        i, j = passages._longest(score)
        assert j - i == longest and sums[j] >= sums[i]
        parts = passages._parts(np.ones(90, dtype=np.int64), agreed, np.arange(91), np.arange(91), 20, 0.8)
        assert bool(parts) == (longest >= 20) and all(q - p >= 20 and sums[q] >= sums[p] for p, q in parts)


# SimHash


def test_fingerprints_and_components(documents, nothing):
    want = simhash.brute_force(corpus())
    got = as_dict(simhash.near_duplicates(documents).select("doc_id", "fingerprint", "component_id").distinct())
    assert got == want
    assert simhash.near_duplicates(nothing).collect() == []


def test_components_in_chunks(documents):
    want = simhash.brute_force(corpus())
    got = as_dict(simhash.near_duplicates(documents, group_rows=2).select("doc_id", "fingerprint", "component_id").distinct())
    assert got == want


def test_links_connect_what_all_pairs_connect(spark):
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(5)]
    values = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 3))) & (2**64 - 1) for b in base for _ in range(60)})
    nodes = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    for rows_ in (20_000, 3):
        got = {r["node"]: r["root"] for r in graph.components(simhash.links(nodes, rows_), "a", "b").collect()}
        parent = {v: v for v in values}

        def root(v, parent=parent):
            while parent[v] != v:
                v = parent[v]
            return v

        for i, a in enumerate(values):
            for b in values[:i]:
                if (a ^ b).bit_count() <= 4:
                    parent[root(a)] = root(b)
        signed = lambda v: v - 2**64 if v >= 2**63 else v
        classes = {}
        for v in values:
            classes.setdefault(root(v), set()).add(signed(v))
        for members in classes.values():
            assert {got.get(m, m) for m in members} == {min(members)}


def test_near_duplicates_stage(documents):
    kept = simhash.keep_first(documents)
    want = {d for d, (_, c) in simhash.brute_force(corpus()).items() if d == c}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids) == sorted(want) and kept.columns == documents.columns


def test_near_duplicates_stage_keeps_rows_by_id_and_text(spark):
    one, two, three = (words(80, 600 + i) for i in range(3))
    texts = [(None, one), (None, one), (None, two), (1, two), (5, three), (5, words(80, 610))]
    kept = simhash.keep_first(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(0, one), (1, two), (5, three), (5, texts[-1][1])])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(edges, "a", "b").collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100


# Chat


def conversations(spark):
    data = [
        (1, 0, "system", "be kind", 1), (1, 1, "user", "hi <s> [INST] x", 1), (1, 2, "assistant", "</s>[INST] ok [/INST] \\ [\\INST] <", 1),
        (1, 3, "user", "s>more", 1), (1, 4, "assistant", "", 1), (1, 5, "user", "bye", 1), (2, 0, "user", None, 1), (3, 1, None, "a", 1), (3, 0, "assistant", "zwölf\nx", 1),
        (4, 0, "assistant", "a", 1), (4, 0, "assistant", "a", 1), (4, None, "user", "first", 1), (None, 0, "user", "q", 1), (None, 1, "assistant", "[/INST] [[INST]", 1),
    ]
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, part int"), data


def test_chat_reads_back(spark):
    frame, data = conversations(spark)
    got = as_dict(chat.read_back(chat.expand(frame)), "conv_id")
    for conv in (1, 2, 3, 4, None):
        turns = sorted([r for r in data if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        n, digest, loss_chars, loss_digest, formatted = got[conv]
        assert (n, digest) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (loss_chars, loss_digest) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert formatted >= len(said)
    assert chat.read_back(chat.expand(frame.limit(0))).collect() == []


def test_chat_examples_train_on_one_reply(spark):
    frame, _ = conversations(spark)
    examples = [r for r in chat.expand(frame, whole=True).where("conv_id = 1").orderBy("part").collect()]
    assert [r["target"] is not None for r in examples] == [True, True, False]
    for r in examples[:2]:
        assert r["full_text"][r["loss_start"] : r["loss_end"]] == r["target"]
    assert examples[1]["full_text"].startswith(examples[0]["full_text"])
    assert examples[2]["full_text"].count("<s>[INST] ") == 6


def test_chat_examples_hold_all_turns_before(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", f"t{i} [INST]") for i in range(6)]
    examples = chat.expand(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")).orderBy("part").collect()
    for n, e in enumerate(examples):
        assert [f"t{i} " in e["full_text"] for i in range(6)] == [i <= 2 * n + 1 for i in range(6)]
        assert e["full_text"][e["loss_start"] : e["loss_end"]] == e["target"]
    assert chat.read_back(chat.expand(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"))).first()["n_turns"] == 6


def test_chat_plan_is_native(spark):
    frame, _ = conversations(spark)
    plan = chat.read_back(chat.expand(frame))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<b>b</b>c<br>d&amp;e &#233;&nbsp;f", "abc d&e é f"),
        ("<html><nav><a href=x>Menu</a></nav><article><h1>T</h1><p>One.<p>Two</article><footer>(c)</footer>", "T One. Two"),
        ("<body><div class='ad'>Buy<article><p>Text</p></article></div></body>", "Text"),
        ("<main><p>Text <script>var x='</p>';</script>more</p><form>Name<input></form><aside>Side</aside><p>End</main><div id=comments><p>First!</div>", "Text more End"),
        ("<article><p>A</p><div class='share-buttons'><a>Tweet</a></div><p>B</p></article>", "A B"),
        ("<div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p>Real text that is long enough to stay.</p><!-- no --></div>", "Real text that is long enough to stay."),
        ("<article><p>a < b and <b>c", "a < b and c"), ("<article>x<!-- open", "x"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_short_text_apart_from_a_long_one_is_kept():
    menu = "<nav>Home</nav><aside>More</aside><nav>Next</nav><footer>End</footer>"
    page = f"<body><p>A short start.</p>{menu}<p>{'Long body. ' * 60}</p>{menu}<p>See <a href=x>the whole long report on this</a>.</p><ul><li><a href=y>Archive</a></li></ul></body>"
    assert html.main_text(page) == "A short start. " + "Long body. " * 60 + "See the whole long report on this."
    for tag in ('<svg width="3"/>', "<iframe src='a>b' />", "<object/>", "<math />"):
        assert html.main_text(f"<article><p>One.</p>{tag}<p>Two.</p></article>") == "One. Two."
    assert html.main_text("<article><p>One.</p><svg><text/>no</svg><p>Two.</p></article>") == "One. Two."
    assert html.main_text("<body><div><a href=x>Home</a> | <a href=y>News</a></div><p>Text.</p></body>") == "Text."


def plain_main_text(page, window=3):
    """The surge and dive rule by plain loops over all windows."""
    lines = [x for x in html.lines_of(page or "") if not x.aside]
    if [x for x in lines if x.article]:
        lines = [x for x in lines if x.article]

    def weight(x):
        if x.article:
            return 0.3 * len(x.text) if x.menu else 4.0 * (max(20, len(x.text)) if x.prose else len(x.text))
        return 0.0 if x.menu else float(max(20, len(x.text))) if x.prose else 0.3 * len(x.text)

    w = [weight(x) for x in lines]
    biggest = max([sum(w[i : i + window]) for i in range(len(w))], default=0)
    need = min(80, 0.3 * biggest)
    kept, inside = [], False
    for i, v in enumerate(w):
        enough, some = sum(w[i : i + window]) >= need - 1e-9, v >= min(20, need) - 1e-9
        inside = (inside or (enough and some and v > 0)) and (enough or some)
        if inside and v:
            kept.append(lines[i].text)
    return " ".join(kept)


def test_main_text_against_plain_loops():
    r, cut = random.Random(12), 0
    for n in range(200):
        article = n % 3 == 0
        parts = []
        for _ in range(r.randint(0, 14)):
            text = words(r.choice((1, 1, 3, 10, 40)), r.randint(0, 10**6))
            parts.append(r.choice((f"<p>{text}</p>", f"<div>{text}</div>", f"<div><a href=x>{text}</a> <a href=y>More</a></div>", f"<ul><li><a href=x>{text}</a></ul>", f"<h2>{text}</h2>", f"<nav>{text}</nav>", text + "<hr>")))
        page = "<body>" + ("<article>" + "".join(parts) + "</article><div>Outside of it</div>" if article else "".join(parts))
        assert html.main_text(page) == plain_main_text(page)
        inside = [x for x in html.lines_of(page) if x.article and not x.aside]
        got = html.main_text(page)
        assert not inside or set(" ".join(x.text for x in inside if x.prose and not x.menu).split()) <= set(got.split())
        cut += bool(inside) and got != " ".join(x.text for x in inside)
    assert cut > 5


def test_windows_decide_in_marked_articles_too():
    links = "".join(f"<ul><li><a href=/{i}>Part {i}</a></li></ul>" for i in range(5))
    page = f"<article>{links}<h1>Title</h1><p>{'Long body. ' * 20}</p>{links}<p>Short.</p><p>{'More text. ' * 20}</p><div>A closing line.</div>{links}<div>Top</div></article>"
    lines = html.lines_of(page)
    text = html.main_text(page)
    # Runs of links end the text before them and come back with the text after them only where a window reaches it.
    assert "Title Long body." in text and "Short. More text." in text and "A closing line." in text and not text.endswith("Top")
    assert text != " ".join(x.text for x in lines) and html.main_text(page, window=40) != text
    weights, least = html.weighed(lines)
    assert all(w < least for w, x in zip(weights, lines, strict=True) if x.menu)


def test_pages_without_any_marks():
    """No article, class, id or role: the distribution alone finds the text, and it needs its window."""
    r, dropped = random.Random(13), 0
    for n in range(60):
        menu = "".join(f"<div><a href=/{i}>{words(1, 50 * n + i)}</a></div>" for i in range(6))
        paragraphs = [words(30, 5_000 + n)] + [words(r.choice((2, 12, 60)), 9_000 + 20 * n + i) for i in range(8)] + [words(60, 8_000 + n), words(2, 4_000 + n)]
        title = words(4, 6_000 + n)
        page = f"<html><body><div>{menu}</div><div>Buy {words(3, n)}</div><div><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + f"</div><div>(c) {words(4, 70 + n)}</div>{menu}</body></html>"
        assert html.main_text(page) == " ".join([title, *paragraphs])
        dropped += html.main_text(page, window=1) != html.main_text(page)
    assert dropped > 30


def test_pages(spark):
    long = " ".join(f"<p>{words(50, i)}</p>" for i in range(400))
    data = [(1, "u", f"<article>{long}</article>", "t"), (2, None, None, "t"), (2, "v", "<p>x</p>", "t")]
    got = html.extract(spark.createDataFrame(data, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in got.collect()}
    want = " ".join(words(50, i) for i in range(400))
    assert found == {(1, "u"): (want, len(want)), (2, None): ("", 0), (2, "v"): ("x", 1)}
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# Language model


def test_lm(spark, documents, nothing):
    held = documents.select("doc_id", "text", lm.held_out().alias("held_out"))
    got = lm.score(held, lm.fit(held.where("not held_out"))).collect()
    assert len(got) == len(corpus())
    counts, texts = {}, corpus()
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in texts}
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in (t or "").encode().lower().split() + [None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in got:
        own = tokens[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts.get(w, 0) > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in own))
        assert r["score"] < 0 and r["bits_per_byte"] > 0
    empty = nothing.select("doc_id", "text", lm.held_out().alias("held_out"))
    assert lm.score(empty, lm.fit(empty)).collect() == []
    untrained = lm.score(held, lm.fit(empty)).collect()
    assert len(untrained) == len(texts)


def test_lm_code_and_probabilities():
    histogram = np.zeros(256, dtype=np.int64)
    histogram[list(range(97, 123)) + [32]] = range(1, 28)
    code = lm.Code(histogram)
    assert abs(sum(2.0 ** -code.length) - 1) < 1e-12
    model = lm.Model(code)
    counts = lm.Counts(code)
    counts.add([b"the cat sat on the mat"] * 50)
    for order, number, packed in counts.slices():
        import zstandard

        part = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint32).reshape(-1, lm.SYMBOLS)
        model.put(order, number, *lm.odds_of(code, order, part.ravel()))
    # The probabilities of all continuations of a text by one byte, each followed by anything, add up to one.
    alone = model.score([b"the cat sat on the mat"])[0]
    assert alone > model.score([b"the cat sat on the xat"])[0]
    together = model.score([b"the cat", b"zzz", b"", b"the cat sat on the mat"])
    assert together[3] == pytest.approx(alone, rel=1e-6)
    firsts = np.exp(model.score([bytes([b]) for b in range(255)])) / np.exp([_end_after(model, bytes([b])) for b in range(255)])
    assert firsts.sum() + np.exp(model.score([b""])[0]) == pytest.approx(1, rel=1e-3)


def _end_after(model, text):
    """Natural logarithm of the probability that a text ends, given that it began so."""
    code = model.code
    raw, symbols, at, _ = lm._laid_out([text], code)
    slots = lm._slots(raw, list(lm.ORDERS))
    place = at[-1]
    end = code.symbol[lm.END]
    path = slice(code.first[end], code.first[end] + code.length[end])
    total = 0.0
    for node, sign in zip(code.node[path], code.sign[path], strict=True):
        said = sum(w * model.tables[o][(slots[o][place] << 6) + node] / lm.SCALE for w, o in zip(lm.START, lm.ORDERS, strict=True))
        total -= np.log1p(np.exp(-sign * said))
    return total


def plain_lm_score(model, text):
    """One text, byte by byte and bit by bit, with the same tables."""
    code, mask = model.code, (1 << 64) - 1
    raw, total, weights = [0] * 10 + list(text) + [255], 0.0, [[float(x) for x in row] for row in model.start]
    done, step, at = 0, 16, 10
    while at < len(raw):
        moved = [[0.0] * 8 for _ in weights]
        many = [0] * 8
        for i in range(at, min(at + step, len(raw))):
            word, j, k = 0, i - 1, 1
            while raw[j] not in (0, 9, 10, 11, 12, 13, 32, 255):
                word, j, k = (word + (raw[j] + 1) * k) & mask, j - 1, k * int(lm._K_INVERSE) & mask
            contexts = [sum(raw[i - 1 - b] << 8 * b for b in range(4)), sum(raw[i - 1 - b] << 8 * b for b in range(6)), word ^ word >> 29]
            slots = [(c * 0x9E3779B97F4A7C15 & mask) >> 64 - lm.SLOT_BITS for c in contexts]
            gate = int(model.seen[0][slots[2]]) * 2 + (int(model.seen[6][slots[1]]) >> 1)
            symbol = int(code.symbol[raw[i]])
            for n in range(code.first[symbol], code.first[symbol] + code.length[symbol]):
                odds = [int(model.tables[o][(s << 6) + code.node[n]]) / lm.SCALE for o, s in zip(lm.ORDERS, slots, strict=True)]
                sign = float(code.sign[n])
                said = sign * max(-20.0, min(20.0, sum(w[gate] * x for w, x in zip(weights, odds, strict=True))))
                total -= np.log1p(np.exp(-said))
                for w, x in zip(moved, odds, strict=True):
                    w[gate] += x * sign * (1 - 1 / (1 + np.exp(-said)))
                many[gate] += 1
            if symbol == lm.ESCAPE:
                for k in range(8):
                    node, bit = 1 << k | raw[i] >> 8 - k, raw[i] >> 7 - k & 1
                    said = 0.0
                    for w, o in zip(lm.ESCAPE_WEIGHTS, lm.ESCAPE_ORDERS, strict=True):
                        context = 0
                        for b in range(o):
                            context = context << 8 | raw[i - 1 - b]
                        said += w * int(model.escapes[o][((context << 8 | node) * 0x9E3779B97F4A7C15 & mask) >> 64 - lm.ESCAPE_BITS]) / lm.SCALE
                    if code.open[node]:
                        total -= np.log1p(np.exp(-said if bit else said))
        for w, m in zip(weights, moved, strict=True):
            for g in range(8):
                if many[g]:
                    w[g] += lm.RATE * m[g] / np.sqrt(many[g])
        at, step = at + step, min(2 * step, 256)
    return total


def test_lm_score_against_plain_loops(spark):
    texts = [words(60, i) + " Ünïcödé жук 日本 " * (i % 3) for i in range(80)] + ["日本語テキスト " * 40, "x" * 900, ""]
    frame = spark.createDataFrame([(i, t, i % 7 == 2) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    model = lm.fit(frame.where("not held_out"))
    assert np.abs(model.start - np.array(lm.START)[:, None]).max() > 0.01
    got = {r["doc_id"]: r["score"] for r in lm.score(frame, model).collect()}
    for i in (0, 2, 5, 80, 81, 82):
        assert got[i] * np.log(10) == pytest.approx(plain_lm_score(model, texts[i].encode().lower()), rel=2e-3)
    # Rare bytes are told by what stands before them.
    assert got[80] * np.log2(10) / len(texts[80].encode()) > -2


def test_lm_long_text(spark):
    frame = spark.createDataFrame([(0, words(200_000, 1), False), (1, words(20, 2), True)], "doc_id long, text string, held_out boolean")
    got = {r["doc_id"]: r for r in lm.score(frame, lm.fit(frame.where("not held_out"))).collect()}
    assert got[0]["n_tokens"] == 200_001 == got[0]["train_tokens"] and np.isfinite(got[0]["score"])


# Byte-pair encoding


def test_bpe_as_the_library(spark, documents, nothing):
    import public_tokenizers
    import tiktoken

    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digest(documents).collect()}
    for i, t in corpus():
        ids = library.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.digest(nothing).collect() == []
    there = bpe.decode(bpe.encode(documents.select("doc_id", "text", "ids")))
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") and r["ids"] == library.encode_ordinary(r["text"] or "") for r in there.collect())


def test_bpe_odd_pieces():
    import tiktoken

    codec = bpe.codec(bpe.VOCABULARY)
    import public_tokenizers

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(9)
    texts = ["".join(r.choice("abcdefgh éñ日\n\t 019.,<|>") for _ in range(r.randint(0, 400))) for _ in range(200)]
    texts += ["a" * 3000, "ab" * 800, " " * 700, "<|endoftext|>", "".join(r.choice("etaoin") for _ in range(2000)), "\U0001f600" * 90]
    assert codec.encode_batch(texts) == [library.encode_ordinary(t) for t in texts]


# Language ID


def test_languages(spark):
    r = random.Random(11)
    alphabets = {"aa": "abcde", "bb": "defgh", "cc": "ghijk", "dd": "jklma", "ee": "éèêabc", "ff": "мнопр"}
    data = [(i, " ".join("".join(r.choice(a) for _ in range(r.randint(3, 7))) for _ in range(40)), lang, "x") for i, (lang, a) in enumerate([*alphabets.items()] * 30)]
    odd = [(1000, None, "aa", "x"), (1001, "12 34 !", "aa", "x"), (1002, "", None, "x"), (1003, data[0][1], None, "x")]
    frame = spark.createDataFrame(data + odd, "doc_id long, text string, lang string, score string")
    model = langid.fit(frame.where(~langid.held_out()))
    got = {r["doc_id"]: r for r in langid.identify(frame, model).collect()}
    right = [got[i]["lang_pred"] == lang for i, _, lang, _ in data if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(right) > 20 and np.mean(right) > 0.95
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.keep_identified(frame)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {d[0] for d in data} | {1003}


def test_languages_without_labels(spark, nothing):
    frame = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(frame, langid.fit(frame)).collect()} == {"und"}
    one = spark.createDataFrame([(1, "abc", "zz"), (2, "??", "zz")], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.identify(one, langid.fit(one)).orderBy("doc_id").collect()] == ["zz", "und"]
    assert langid.identify(nothing, langid.fit(nothing)).collect() == []


def test_languages_without_a_cap_ties_and_long_texts(spark):
    many = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 30, f"l{i % 600:03d}", "s", 1, 1, "f", "i") for i in range(1200)]
    frame = spark.createDataFrame([(*r,) for r in many], SCHEMA)
    model = langid.fit(frame, sample_rows=1000)
    assert len(model.labels) == 600 and model.code.shape[0] == 600
    # Of languages whose texts are the same, the one that sorts first.
    same = spark.createDataFrame(rows(enumerate(words(30, i) for i in range(8))), SCHEMA).replace("xx", "aa", "lang")
    two = same.unionByName(same.replace("aa", "bb", "lang"))
    long = spark.createDataFrame(rows(enumerate((words(60_000, 3), words(30, 2)))), SCHEMA)
    got = langid.identify(long, langid.fit(two)).collect()
    assert [r["lang_pred"] in ("aa", "bb") for r in got] == [True, True] and all(r["ambiguous"] for r in got)


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 20, 60])
def test_codewords_stand_apart(n):
    code = langid.codewords(n)
    distance = (code.shape[1] - code @ code.T) / 2 + 99 * np.eye(n)
    assert code.shape[0] == n and distance.min() >= (1 if n < 3 else 2) and (np.abs(code.sum(axis=0)) < n).all()


# Decontamination


def test_windows(spark, documents, nothing):
    shared = corpus()[40][1].split()
    items = [("7", " ".join(shared[20:50]).upper()), ("10", " ".join(shared[60:66])), ("11", None), ("12", "-- !!"), ("9", words(40, 300)), ("9", words(40, 300)), (None, " ".join(shared[55:80]))]
    tests = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id string, text string, n_hit string")
    want = decontaminate.brute_force(corpus(), items)
    assert as_dict(decontaminate.digest(decontaminate.mark(documents, tests)).distinct()) == want
    assert as_dict(decontaminate.digest(decontaminate.mark(documents, tests, block_bytes=50)).distinct()) == want
    assert any(w[4] for w in want.values())
    none = decontaminate.digest(decontaminate.mark(documents, tests.limit(0)))
    assert all(r["n_hit"] == 0 and r["n_words"] == want[r["doc_id"]][0] for r in none.collect())
    assert decontaminate.digest(decontaminate.mark(nothing, tests)).collect() == []
    kept = decontaminate.keep_clean(documents, tests)
    assert kept.columns == documents.columns and {r["doc_id"] for r in kept.collect()} == {d for d, w in want.items() if not w[4]}


def test_near_windows(spark):
    docs = spark.createDataFrame([(1, "c x b y a"), (2, "a b"), (3, "a " + "z " * 50 + "b c")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    got = {r["doc_id"]: r["near_items"] for r in decontaminate.mark(docs, tests, slop=5).collect()}
    assert got == {1: ["1"], 2: [], 3: []}
    # An item without an id hits all the same.
    nameless = spark.createDataFrame([(None, "x b"), (4, "b y a")], "item_id long, text string")
    found = {r["doc_id"]: (r["n_hit"], r["items"], [tuple(s) for s in r["hit_spans"]]) for r in decontaminate.mark(docs, nameless).collect()}
    assert found == {1: (4, ["4"], [(1, 5)]), 2: (0, [], []), 3: (0, [], [])}


def test_windows_against_sql(spark):
    """The exact and the proximity matches of random texts of few words, against the SQL counterpart."""
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(21)
    vocabulary = "a b c d e f g h".split()
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(40)] + [(90, None), (91, "")]
    items = [(i if i else None, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 5)))) for i in range(8)] + [(9, " ".join(docs[3][1].split()[:20]))]
    got = as_dict(decontaminate.digest(decontaminate.mark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))))
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", docs)
    c.execute("create table benchmark (item_id bigint, text varchar)")
    c.executemany("insert into benchmark values (?, ?)", items)
    assert got == {row[0]: tuple(row[1:]) for row in c.execute(decontaminate.ORACLE).fetchall()}
    assert any(v[5] > v[2] for v in got.values()) and any(v[4] for v in got.values())


# Suffixes


def test_repeats(documents, nothing):
    want = suffix.brute_force(corpus())
    for group in (2_000, 1):
        got = as_dict(suffix._finished(documents.select("doc_id", "text"), "text", group, True).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").distinct())
        assert got == want
    assert sum(w[1] > 0 for w in want.values()) > 5
    assert suffix.remove_repeats(nothing).collect() == []


def test_repeats_stage(documents):
    kept = suffix.keep_unrepeated(documents)
    assert kept.schema.names == documents.schema.names
    removed = {d: w[1] for d, w in suffix.brute_force(corpus()).items()}
    texts = dict(corpus())
    for r in kept.collect():
        assert r["n_chars"] == len(r["text"]) and (removed[r["doc_id"]] or r["text"] == (texts[r["doc_id"]] or ""))
        assert r["n_words"] == 7 and r["ids"] == "ids"


def test_repeats_of_periodic_texts(spark):
    texts = [(1, "ab" * 900), (2, "ab" * 150 + "c" + words(60, 5)), (3, ("x" * 199 + "y") * 3), (4, "é" * 250), (5, "q" * 199)]
    got = as_dict(suffix._finished(spark.createDataFrame(texts, "doc_id long, text string"), "text", 2_000, True))
    assert got == suffix.brute_force(texts)


# The pipeline and the registered queries


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = corpus()
    spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    item = " ".join(texts[10][1].split()[:30])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = [(i, t) for i, t in dict(texts).items() if any(c.isalpha() for c in t or "")]
    groups = simhash.brute_force(left)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    seen = {}
    for _, t in left:
        raw = t.encode()
        for i in range(len(raw) - 199):
            seen[raw[i : i + 200]] = seen.get(raw[i : i + 200], 0) + 1
    cut = []
    for d, t in left:
        raw = t.encode()
        spans = suffix.merged([(i, i + 200) for i in range(len(raw) - 199) if seen[raw[i : i + 200]] > 1])
        cut.append((d, suffix.kept(raw, spans).decode("utf-8", "ignore")))
    assert any(a != b for a, b in zip(left, cut, strict=True))
    marked = decontaminate.brute_force(cut, [(1, item)])
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in cut if not marked[d][4]}
    assert 10 not in got and len(got) < len(cut)


def test_pipeline_odd_cases(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, cid long, n_hit string, `_told` int, lang_pred string, rid string"
    one, two = words(80, 801), words(80, 802)
    rows_ = [(None, one, None, None, None, 1, "a", 2, "b", "c"), (None, two, "xx", "s", 1, None, None, None, None, None), (4, two, "xx", "s", 1, 1, "a", 2, "b", "c"), (5, None, None, None, None, None, None, None, None, None), (6, "", "xx", "s", 0, 1, "a", 2, "b", "c"), (7, words(30_000, 803), "xx", "s", 1, 1, "a", 2, "b", "c"), (7, words(40, 804), "xx", "s", 1, 1, "a", 2, "b", "c")]
    for name, data in (("some", rows_), ("none", [])):
        at = tmp_path / name
        spark.createDataFrame(data, schema).write.parquet(str(at / "documents.parquet"))
        spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
        docs = spark.read.parquet(str(at / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(at))
            assert docs.columns == [f.strip().split()[0].strip("`") for f in schema.split(",")]
        ids = sorted((r["doc_id"] or 0, len(r["text"])) for r in docs.collect())
        assert ids == (sorted([(0, len(one)), (4, len(two)), (7, len(words(30_000, 803))), (7, len(words(40, 804)))]) if data else [])
        assert corpus_pipeline.run(spark, str(at)).count() == len(ids)


def test_registered_queries_have_known_names():
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} and set(registry.oracle_sql()) <= names
    json.dumps(sorted(names))


def test_lm_counts_outgrow_two_bytes():
    import zstandard

    code = lm.Code(np.bincount(np.frombuffer(b"a" * 50 + b"b", dtype=np.uint8), minlength=256))
    counts = lm.Counts(code)
    for _ in range(3):
        counts.add([b"a" * 50_000, b"b"])
    total = {o: 0 for o in lm.ORDERS}
    most = 0
    for order, _, packed in counts.slices():
        part = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint32)
        total[order] += int(part.sum())
        most = max(most, int(part.max()))
    assert set(total.values()) == {3 * (50_001 + 2)} and 149_000 < most <= 150_000


def test_lm_draws_no_sample(spark):
    """What fit() sets beside counts doesn't depend on which documents there are."""
    one, two = (spark.createDataFrame([(w * n,) for n in range(1, 40)], "text string") for w in ("some words of a text. ", "andere woorden, niet dezelfde. "))
    assert (lm.fit(one).start == lm.fit(two).start).all()
