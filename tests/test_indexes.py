"""Substring search by trigrams, fuzzy tags by deletions, and staleness by timers, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest

from quillstone.operators import tag_dictionary, text_index
from quillstone.streaming import streams

ENTRY = "id string, title string, description string, content string"


def folded(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def test_trigrams_find_what_a_scan_finds(spark, tmp_path):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abAB éß%_") for _ in range(r.randint(0, 30)))
    rows = [(f"e{i}", word(), word(), word() * r.randint(0, 4)) for i in range(200)]
    rows += [("long", "t", None, "x" * 50_000 + "Needle 😀" + "y" * 50_000), ("none", None, None, None), ("split", "ab", "cd", "ef")]
    index = text_index.build(spark.createDataFrame(rows, ENTRY).repartition(3), str(tmp_path / "i"), buckets=5, parts=7)
    for text in ("needle 😀", "AB", "abab", "é", "a%b", "%", "_a", "bcd", "ß ", "zzz", "", "ABA B", "b￿c"):
        want = {i for i, *c in rows if any(folded(text) in folded(x) for x in c)}
        assert {x["id"] for x in index.hits(text).collect()} == want, text
    plan = index.candidates("needle")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(gram" in plan
    index.changed(spark.createDataFrame([("long", "t", "d", "nothing"), ("new", "t", "d", "another needle")], ENTRY))
    assert {x["id"] for x in text_index.TextIndex(spark, str(tmp_path / "i")).hits("Needle").collect()} == {"new"}


@pytest.mark.parametrize("few", [10_000, 3])
def test_many_candidates(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(text_index, "FEW", few)
    rows = [(str(i), "shared text", "d", f"number {i}") for i in range(60)]
    index = text_index.build(spark.createDataFrame(rows, ENTRY), str(tmp_path / "i"), buckets=3, parts=4)
    assert index.hits("shared TEXT").count() == 60 and [x["id"] for x in index.hits("number 7").collect()] == ["7"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_deletions_find_all_near_tags(spark):
    r = random.Random(4)
    tags = ["".join(r.choice("abc") for _ in range(r.randint(0, 7))) for _ in range(60)] + ["x" * n for n in (38, 39, 40, 41, 42, 43, 90)] + ["x" * 20 + "y" + "x" * 19, "É", "Python", "GO", "js"]
    rows = [(i, r.sample(tags, r.randint(0, 4)), "x") for i in range(150)] + [(200, None, "x"), (201, [None, "ab"], "x"), (202, tags[-12:], "x")]
    entries = spark.createDataFrame(rows, "id long, tags array<string>, tag string")
    dictionary = tag_dictionary.build(entries)
    for wanted in (["abca"], ["ab", "CCC"], ["x" * 40], ["x" * 42], ["x" * 41, "pythn"], ["go"], [""], ["é"], ["zzzzzz"], []):
        want = {i for i, t, _ in rows if all(any(x is not None and distance(w.lower(), x.lower()) <= 2 for x in t or []) for w in wanted)}
        assert {x["id"] for x in tag_dictionary.tagged(entries, dictionary, wanted).collect()} == want, wanted


def test_entries_turn_stale_when_only_the_watermark_moves(spark, tmp_path):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    schema = "user_id long, ts timestamp_ntz, event_type string"
    batches = [
        [(1, day(0), "view"), (2, day(1), "view"), (3, day(0), "click")],
        [(9, day(8), "click")],  # no view: only the watermark moves on
        [(2, day(8), "view"), (9, day(9), "click")],  # entry 2 was told of before, and begins anew
        [(9, day(30), "view")],
    ]
    told = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.stale_entries(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), days=3, late="1 day")
        seen = []
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda df, _, seen=seen: seen.extend(tuple(r) for r in df.collect())).start()
        query.awaitTermination()
        told.append(sorted(seen))
    assert told == [[], [(1, day(0), day(3)), (2, day(1), day(4))], [], [(2, day(8), day(11))]]
