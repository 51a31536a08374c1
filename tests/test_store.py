"""What a store must not lose: entries of one title, files in their folder, logs while they are rewritten, locks."""

import json
import time
from datetime import datetime, timedelta

import pytest

from quillstone.operators import commits
from quillstone.sources import readers
from quillstone.store import Engine, Store

ROWS = "id string, title string, description string, content string"


@pytest.fixture
def engine(spark, tmp_path):
    clock = iter(datetime(2024, 1, 1) + timedelta(minutes=i) for i in range(10_000))
    return Engine(spark, str(tmp_path / "kb"), now=lambda: next(clock))


def test_every_row_is_an_entry(engine, spark):
    rows = spark.createDataFrame([("Fix the bug", "d", f"content {i // 2}", 1.0) for i in range(6)], "title string, description string, content string, confidence double").repartition(3)
    ids = {r["id"] for r in engine.capture_all(rows).collect()}
    assert len(ids) == 6 and {r["id"] for r in engine.entries().collect()} == ids
    with pytest.raises(ValueError):
        engine.capture_all(spark.createDataFrame([("x", "t", "d", "c"), ("x", "t", "d", "c2")], ROWS).selectExpr("*", "1.0D as confidence"))
    engine.now = lambda: datetime(2025, 1, 1)
    engine.capture("Same title", "d", "one")
    with pytest.raises(ValueError):
        engine.capture("Same title", "d", "two")
    assert engine.entries().count() == 7


def test_import_of_one_id_twice(engine, spark):
    schema = readers.ENTRY
    blank = {f.split()[0]: None for f in schema.split(", ")}
    row = lambda i, title, at: tuple((blank | {"id": i, "title": title, "description": "d", "content": "c", "updated_at": at}).values())
    rows = spark.createDataFrame([row("i", "old", datetime(2023, 1, 1)), row("i", "new", datetime(2024, 1, 1)), row("i", "", datetime(2025, 1, 1)), row(None, "t", None), row(None, "t", None)], schema)
    assert engine.import_rows(rows) == {"imported": 3, "skipped": 1, "errors": 1}
    assert sorted(r["title"] for r in engine.entries().collect()) == ["new", "t", "t"]
    assert engine.import_rows(rows.where("title = 'old'"), skip_duplicates=False) == {"imported": 0, "skipped": 0, "errors": 1}


def test_documents_stay_in_their_folder(engine, spark, tmp_path):
    odd = ["../../out", 'q"x', "a/b", ".hidden", "..", "späß *?[x]{y}", "l" * 400, "plain-1_2.3"]
    folder = tmp_path / "deep" / "replica"
    e = spark.createDataFrame([(i, i, "d", "c", datetime(2023, 1, 1)) for i in odd], ROWS + ", updated_at timestamp_ntz")
    engine.store.append("entries", engine.embed(e))
    before = {p for p in tmp_path.rglob("*") if "replica" not in p.parts and "kb" not in p.parts}
    engine.sync(str(folder))
    assert {p for p in tmp_path.rglob("*") if "replica" not in p.parts and "kb" not in p.parts} - before <= {tmp_path / "deep"}
    assert len([p for p in (folder / "entries").glob("*.json")]) == len(odd) and (folder / "entries" / "plain-1_2.3.json").exists()
    told = json.loads((folder / "manifest.json").read_text())
    assert set(told["entries"]) == set(odd) and set(told["last_sync"]) == {readers.S.machine()}
    told["last_sync"]["another"] = "2020-01-01T00:00:00"
    (folder / "manifest.json").write_text(json.dumps(told))
    (folder / ".manifest.json.crc").unlink(missing_ok=True)
    assert [r["id"] for r in readers.replica_entry(spark, str(folder), "../../out").collect()] == ["../../out"]
    other = Engine(spark, str(tmp_path / "kb2"), now=engine.now)
    other.sync(str(folder))
    assert {r["id"] for r in other.entries().collect()} == set(odd)
    assert set(json.loads((folder / "manifest.json").read_text())["last_sync"]) == {readers.S.machine(), "another"}
    assert other.delete("a/b") and other.update('q"x', content="changed")
    other.sync(str(folder))
    engine.sync(str(folder))
    assert {r["id"]: r["content"] for r in engine.entries().collect()} == {i: "changed" if i == 'q"x' else "c" for i in odd if i != "a/b"}


def test_reads_of_logs_need_no_shuffle(engine, spark):
    e = spark.createDataFrame([(str(i), f"t{i}", "d", "c") for i in range(50)], ROWS)
    engine.store.append("entries", e)
    engine.store.append("entries", e.where("id % 3 = 0").withColumn("title", e["id"]))
    engine.store.append("entries", e.where("id % 5 = 0"), "delete")
    engine.store.append("usage", e.selectExpr("id", "timestamp_ntz'2024-01-01' as ts"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(engine.store.current("entries")) and "Exchange hashpartitioning" not in plan(engine.entries().select("id", "title", "usage_count"))
    want = {str(i): str(i) if i % 3 == 0 else f"t{i}" for i in range(50) if i % 5}
    assert {r["id"]: r["title"] for r in engine.entries().collect()} == want


def test_compaction_and_writers_that_die(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kb"))
    rows = lambda *ids: spark.createDataFrame([(i, i, "d", "c") for i in ids], ROWS)
    ids = lambda: {r["id"] for r in store.current("entries").collect()}
    store.append("entries", rows("a", "b", "c"))
    store.append("entries", rows("b"), "delete")
    reader = store.current("entries").select("id")
    write, store._write = store._write, lambda *a: (write(*a), (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.compact("entries")
    store._write = write
    assert ids() == {"a", "c"}
    store.compact("entries")
    assert ids() == {"a", "c"} and {r["id"] for r in reader.collect()} == {"a", "c"} and store.log("entries").count() == 3
    store.append("entries", rows("d"))
    store.compact("entries")
    assert ids() == {"a", "c", "d"} and Store(spark, str(tmp_path / "kb")).log("entries").agg({"seq": "max"}).first()[0] == 3
    assert len([p for p in (tmp_path / "kb").glob("entries-*")]) == 3  # now, before, and what the lost writer left


def test_logs_of_plain_files_are_read_and_bucketed(spark, tmp_path):
    rows = spark.createDataFrame([("a", "t", "d", "c")], ROWS)
    store = Store(spark, str(tmp_path / "kb"))
    schema = spark.createDataFrame([], f"{readers.ENTRY}, embedding array<float>, seq long, op string, at timestamp_ntz").schema
    spark.createDataFrame([tuple({"id": "a", "title": "t", "seq": 4, "op": "upsert"}.get(f.name) for f in schema)], schema).write.parquet(str(tmp_path / "kb" / "entries"))
    assert store.current("entries").count() == 1
    store.append("entries", rows.withColumn("title", rows["id"]))
    assert store.current("entries").first()["title"] == "a" and store.log("entries").agg({"seq": "max"}).first()[0] == 5
    store.compact("entries")
    assert store.current("entries").first()["title"] == "a" and store._place("entries")["buckets"]


def test_locks(spark, tmp_path, monkeypatch):
    at = str(tmp_path)
    monkeypatch.setattr(readers, "LOCK_STALE", 1.0)
    with readers.locked(spark, at) as held:
        time.sleep(1.5)  # renewed meanwhile
        with pytest.raises(TimeoutError), readers.locked(spark, at, timeout=0.5):
            pass
        held.check()
    (tmp_path / ".lock").write_text("left behind")
    (tmp_path / "..lock.crc").unlink(missing_ok=True)
    time.sleep(1.2)
    with readers.locked(spark, at, timeout=3.0) as held:
        (tmp_path / ".lock").write_text("another")
        (tmp_path / "..lock.crc").unlink(missing_ok=True)
        with pytest.raises(RuntimeError):
            held.check()
    assert (tmp_path / ".lock").read_text() == "another"  # not ours to remove


def test_retrieval_through_the_index(engine):
    texts = {"Auth": "Tokens are signed with a secret key.", "Pool": "Database connections are pooled.", "Cache": "Pages are cached in memory."}
    ids = {t: engine.capture(t, "d", c, project="p") for t, c in texts.items()}
    engine.build_index()
    new = engine.capture("Queue", "d", "Jobs wait in a durable queue.", project="p")
    assert [r["id"] for r in engine.retrieve("jobs wait in a durable queue", indexed=True, min_score=0.2, n=1).collect()] == [new]
    engine.update(ids["Auth"], content="Invoices are sent by mail.")
    assert [r["id"] for r in engine.retrieve("invoices are sent by mail", indexed=True, min_score=0.2, n=1, project="p").collect()] == [ids["Auth"]]
    engine.delete(new)
    assert new not in [r["id"] for r in engine.retrieve("jobs wait in a durable queue", indexed=True, min_score=0.0).collect()]


def test_changed_lines_do_not_tell_the_kind_of_change():
    text = "\n".join([
        "diff --git a/x y.py b/x y.py", "index 1..2 100644", "--- a/x y.py", "+++ b/x y.py", "@@ -1,3 +1,4 @@ def f", " new file mode", "-deleted file mode 1", "+rename from here", "++++ not counted",
        "+ diff --git a/no b/no", "@@ -9 +10 @@", "-a", "+b", "diff --git a/old.py b/new.py", "similarity index 90%", "rename from old.py", "rename to new.py", "diff --cc merged", "@@@ -1 -1 +1 @@@", "+z",
        "diff --git a/n.py b/n.py", "new file mode 100644", "@@ -0,0 +1,2 @@", "+one", "+two",
    ])
    got = commits.parse_diff(text)
    assert [(d["file_path"], d["change_type"], d["old_path"], d["additions"], d["deletions"]) for d in got] == [("x y.py", "modified", None, 3, 2), ("new.py", "renamed", "old.py", 0, 0), ("n.py", "added", None, 2, 0)]
    assert [(h["old_start"], h["old_count"], h["new_start"], h["new_count"], h["header"]) for h in got[0]["hunks"]] == [(1, 3, 1, 4, "def f"), (9, 1, 10, 1, "")]
    assert got[0]["hunks"][1]["content"] == "-a\n+b" and got[2]["hunks"][0]["content"] == "+one\n+two"
