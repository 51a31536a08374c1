"""The store and the engine: writes append, reads see the last state."""

import json
from datetime import datetime, timedelta

import pytest

from quillstone.operators import ledgers, sessions
from quillstone.sources import readers
from quillstone.store import Engine
from quillstone.streaming import streams


@pytest.fixture
def engine(spark, tmp_path):
    clock = iter(datetime(2024, 1, 1) + timedelta(minutes=i) for i in range(10_000))
    return Engine(spark, str(tmp_path / "kb"), now=lambda: next(clock))


def test_entries_live_and_die(engine, tmp_path):
    a = engine.capture("Auth tokens", "How tokens are made", "Tokens are signed with a key.", tags="Python, auth", project="web")
    b = engine.capture("Database pool", "How the pool works", "Connections are pooled.", tags=["python"], project="db")
    with pytest.raises(ValueError):
        engine.capture(" ", "d", "c")
    assert engine.get(a).first()["tags"] == ["python", "auth"] and engine.projects().count() == 2
    assert engine.update(a, title="Auth keys", odd=1) and engine.update(a, content="Keys rotate.", tags="auth") and not engine.update("none", title="x")
    row = engine.get(a).first()
    assert (row["title"], row["content"], row["tags"], row["brief"]) == ("Auth keys", "Keys rotate.", ["auth"], "Keys rotate.")
    assert [r["version_number"] for r in engine.history(a).collect()] == [2, 1]
    d = engine.diff(a, 1).first()
    assert "-Auth tokens" in d["title_diff"] and d["tags_changed"]
    assert engine.rollback(a, 1) and engine.get(a).first()["title"] == "Auth tokens" and engine.history(a).count() == 3 and not engine.rollback(a, 9)
    found = engine.retrieve("tokens signed with a key", min_score=0.1).collect()
    assert found and found[0]["id"] == a
    assert engine.get(a).first()["usage_count"] == 1
    assert engine.link(a, b) and not engine.link(b, a) and engine.related(a).first()["title"] == "Database pool"
    c = engine.create_collection("Core")
    assert engine.add_to_collection(c, a) and not engine.add_to_collection(c, a) and engine.collections().first()["member_count"] == 1
    engine.export(str(tmp_path / "out"))
    assert engine.delete(a) and not engine.delete(a)
    assert engine.related(b).count() == 0 and engine.collection_members(c).count() == 0 and engine.history(a).count() == 0
    assert engine.import_from(str(tmp_path / "out")) == {"imported": 1, "skipped": 1, "errors": 0}
    assert engine.get(a).first()["tags"] == ["python", "auth"]
    assert engine.purge("db") == 1 and engine.purge() == 1 and engine.entries().count() == 0


def test_merge_and_duplicates(engine):
    a = engine.capture("Same words here", "d", "Identical content of both", tags="x")
    b = engine.capture("Same words here", "d", "Identical content of both", tags="y")
    groups = engine.duplicates(0.9).collect()
    assert len(groups) == 1 and {groups[0]["leader"], groups[0]["member"]} == {a, b}
    assert engine.merge(a, b)
    row = engine.get(a).first()
    assert row["tags"] == ["x", "y"] and row["content"].count("Identical") == 2 and engine.get(b).count() == 0


def test_sync(engine, spark, tmp_path):
    a = engine.capture("One", "d", "c1")
    folder = tmp_path / "replica" / "entries"
    folder.mkdir(parents=True)
    (folder / "r.json").write_text('{"id":"r1","title":"Two","description":"d","content":"c2","updated_at":"2024-01-01T00:00:00"}')
    (folder / "bad.json").write_text("{")
    at = str(tmp_path / "replica")
    acts = {r["id"]: r["action"] for r in engine.sync(at, dry_run=True).collect()}
    assert acts == {a: "push", "r1": "pull"} and engine.entries().count() == 1
    c = engine.create_collection("Core")
    engine.add_to_collection(c, a)
    engine.sync(at)
    assert {r["id"] for r in engine.entries().collect()} == {a, "r1"} and {r["id"] for r in spark.read.json(str(folder), multiLine=True, mode="DROPMALFORMED").where("id is not null").collect()} == {a, "r1"}
    engine.link(a, "r1")
    assert {r["action"] for r in engine.sync(at).collect()} == {"no_change"}

    # Another store of the same folder gets it all; what it changes comes back.
    other = Engine(spark, str(tmp_path / "other"), now=engine.now)
    other.sync(at)
    assert {r["id"] for r in other.entries().collect()} == {a, "r1"} and other.related(a).count() == 1 and other.collection_members(c).first()["id"] == a
    other.update(a, title="One more")
    other.delete("r1")
    assert {r["id"]: r["action"] for r in other.sync(at).collect()} == {a: "push", "r1": "delete_remote"}
    assert {r["id"]: r["action"] for r in engine.sync(at, dry_run=True).collect()}[a] == "pull"
    engine.sync(at)
    assert engine.get(a).first()["title"] == "One more"


def test_mining_stream_repeats_nothing(spark, tmp_path):
    folder, line = tmp_path / "in", '{"type":"%s","uuid":"%s","timestamp":"2024-01-01T00:00:00Z","message":{"role":"x","content":"%s"}}'
    folder.mkdir()

    def put(name):
        (folder / f"{name}.jsonl").write_text("\n".join([line % ("user", name + "u", "How do I fix it?"), line % ("assistant", name + "a", "You change the first of the lines.")]))

    def run():
        m = readers.messages(readers.transcripts(spark.readStream, str(folder)))
        q = streams.mined(m, ledgers.SESSION, sessions.extract, str(tmp_path / "entries"), str(tmp_path / "ledger"), str(tmp_path / "state")).start()
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "entries")).count()

    put("one")
    assert run() == 1 and run() == 1
    put("two")
    assert run() == 2
    marks = ledgers.current(spark.read.parquet(str(tmp_path / "ledger")), ledgers.SESSION).collect()
    assert {(r["session_id"], r["entries_created"]) for r in marks} == {("one", 1), ("two", 1)}


def two_engines(spark, tmp_path):
    clock = iter(datetime(2024, 1, 1) + timedelta(minutes=i) for i in range(10_000))
    return [Engine(spark, str(tmp_path / n), now=lambda: next(clock)) for n in ("a", "b")]


def test_sync_keeps_edits_and_tells_of_deletions(spark, tmp_path):
    a, b = two_engines(spark, tmp_path)
    folder = str(tmp_path / "folder")
    one, two = a.capture("One", "d", "first"), a.capture("Two", "d", "second")
    a.sync(folder)
    assert a.sync_status().count() == 0 and a.sync_path() == folder
    assert {r["action"] for r in b.sync(folder).collect()} == {"pull"} and b.entries().count() == 2
    # An edit outlives a synchronization that doesn't push it.
    a.update(one, content="edited")
    assert a.sync(pull_only=True).count() == 0
    assert [(r["id"], r["action"]) for r in a.sync_status().collect()] == [(one, "push")]
    assert {(r["id"], r["action"]) for r in a.sync().where("action <> 'no_change'").collect()} == {(one, "push")}
    b.sync()
    assert b.get(one).first()["content"] == "edited" and b.history(one).count() == 1
    # What one side deletes goes from the folder and from the other side.
    b.delete(two)
    assert {(r["id"], r["action"]) for r in b.sync().where("action <> 'no_change'").collect()} == {(two, "delete_remote")}
    assert {(r["id"], r["action"]) for r in a.sync().where("action <> 'no_change'").collect()} == {(two, "delete_local")}
    assert a.get(two).count() == 0 and readers.replica_entry(spark, folder, two).count() == 0 and readers.replica_entry(spark, folder, one).count() == 1
    assert [r["id"] for r in readers.replica_tombstones(spark, folder).collect()] == [two] and [r["id"] for r in readers.manifest(spark, folder).collect()] == [one]
    # Both sides edit: manual leaves the conflict, and its base.
    a.update(one, content="of a")
    b.update(one, content="of b")
    a.sync()
    assert [r["action"] for r in b.sync(strategy="manual").collect()] == ["conflict"] and b.get(one).first()["content"] == "of b"
    assert [r["action"] for r in b.sync(strategy="remote-wins").collect()] == ["pull"] and b.get(one).first()["content"] == "of a"


def test_replica_reads_indented_documents(spark, tmp_path):
    folder = tmp_path / "f" / "entries"
    folder.mkdir(parents=True)
    for i in range(3):
        (folder / f"e{i}.json").write_text(json.dumps({"id": f"e{i}", "title": f"T\n{i}", "content": "c", "tags": ["x"]}, indent=2))
    (folder / "bad.json").write_text('{"id": ')
    assert sorted(r["id"] for r in readers.replica(spark, str(tmp_path / "f"), "entries", readers.ENTRY).collect()) == ["e0", "e1", "e2"]
    engine = Engine(spark, str(tmp_path / "kb"))
    engine.sync(str(tmp_path / "f"))
    assert engine.entries().count() == 3


def test_trees_collections_and_relationships(engine):
    a, b, c = (engine.capture(x, "d", f"content {x}") for x in ("A", "B", "C"))
    for x, y in ((a, b), (b, c), (c, a)):
        assert engine.link(x, y, "depends-on")
    tree = {(r["level"], r["title"], r["circular"]) for r in engine.dependency_tree(a, 5).collect()}
    assert tree == {(0, "A", False), (1, "B", False), (2, "C", False), (3, "A", True)} and engine.dependency_tree("none").count() == 0
    edges = engine.relationships_of(a).collect()
    assert len(edges) == 2 and engine.relationship(edges[0]["id"]).count() == 1
    k = engine.create_collection("Core")
    engine.create_collection("Other")
    assert engine.update_collection(k, " Kernel ", "about") and engine.collection("Kernel").first()["description"] == "about" and not engine.update_collection("none", "x")
    with pytest.raises(ValueError):
        engine.update_collection(k, "Other")
    engine.add_to_collection(k, a)
    before = engine.collection(k).first()["updated_at"]
    assert engine.remove_from_collection(k, a) and engine.collection(k).first()["updated_at"] > before and engine.collections_of(a).count() == 0


def test_import_of_lists_and_compaction(engine, tmp_path, spark):
    rows = [{"title": "X", "description": "d", "content": "c", "id": "i1"}, {"title": "Y", "description": "d", "content": "c", "id": "i1"}, {"title": " \n", "description": "d", "content": "c"}, {"title": "Z", "description": "d", "content": "c"}]
    (tmp_path / "list.json").write_text(json.dumps(rows, indent=2))
    assert engine.import_from(str(tmp_path / "list.json")) == {"imported": 2, "skipped": 1, "errors": 1} and engine.entries().count() == 2
    assert engine.import_rows(readers.parse_export(spark, json.dumps(rows[:1]))) == {"imported": 0, "skipped": 1, "errors": 0}
    with pytest.raises(ValueError):
        readers.parse_export(spark, "{}")
    assert readers.write_list(engine.entries().drop("embedding"), str(tmp_path / "out.json")) == 2 and len(json.loads((tmp_path / "out.json").read_text())) == 2
    engine.update("i1", content="changed")
    before = engine.store.log("entries").count()
    engine.store.compact("entries")
    assert engine.store.log("entries").count() < before and engine.get("i1").first()["content"] == "changed" and engine.entries().count() == 2


def test_locks(spark, tmp_path):
    with readers.locked(spark, str(tmp_path)):
        with pytest.raises(TimeoutError):
            with readers.locked(spark, str(tmp_path), timeout=0.3):
                pass
    with readers.locked(spark, str(tmp_path), timeout=0.3):
        pass


def test_replica_needs_no_task_for_each_few_files(spark, tmp_path):
    folder = tmp_path / "f" / "entries"
    folder.mkdir(parents=True)
    for i in range(300):
        (folder / f"e{i}.json").write_text(json.dumps({"id": f"e{i}", "title": "T"}))
    (folder / "list.json").write_text(json.dumps([{"id": "l1", "title": "T"}, {"id": "l2", "title": "T"}]))
    (folder / "typed.json").write_text(json.dumps({"id": "bad", "tags": {"not": "a list"}}))
    (folder / ".hidden.json").write_text(json.dumps({"id": "hidden"}))
    found = readers.replica(spark, str(tmp_path / "f"), "entries", readers.ENTRY)
    assert found.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r["id"] for r in found.collect()} == {*(f"e{i}" for i in range(300)), "l1", "l2"}


def test_sync_starts_no_job_without_need_and_opens_the_folder_once(spark, tmp_path, monkeypatch):
    a, b = two_engines(spark, tmp_path)
    folder, opened, replica = str(tmp_path / "folder"), [], readers.replica
    monkeypatch.setattr(readers, "replica", lambda spark, folder, kind, schema: opened.append(kind) or replica(spark, folder, kind, schema))
    a.capture("One", "d", "first")
    a.sync(folder)
    assert opened.count("entries") == 1
    b.sync(folder)
    for name in ("nothing", "edited"):
        if name == "edited":
            a.capture("Two", "d", "second")
        opened.clear()
        spark.sparkContext.setJobGroup(name, "")
        a.sync()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert opened == ["entries"] and 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)) <= 25, name


def test_sync_knows_what_both_sides_hold(spark, tmp_path):
    a, b = two_engines(spark, tmp_path)
    folder = str(tmp_path / "folder")

    def told():
        """By id: what a knows of the folder, and the folder's manifest and documents, beside a's own."""
        hashes = lambda df: {r["id"]: r["content_hash"] for r in df.select("id", "content_hash").collect()}
        there = hashes(readers.with_hash(readers.replica(spark, folder, "entries", readers.ENTRY + ", content_hash string")))
        return hashes(a.store.current("synced")), hashes(readers.manifest(spark, folder)), there, hashes(readers.with_hash(a.store.current("entries")))

    def both(there, here):
        return {k: v for k, v in here.items() if there.get(k) == v}

    ids = {t: a.capture(t, "d", "of " + t, project="p" if t < "E" else "q") for t in "ABCDEF"}
    a.sync(folder)
    b.sync(folder)
    b.update(ids["A"], content="by b")
    b.delete(ids["B"])
    other = b.capture("G", "d", "of G", project="q")
    b.sync()
    a.update(ids["C"], content="by a")
    a.update(ids["E"], content="by a")
    a.delete(ids["D"])
    a.delete(ids["F"])
    assert {(r["id"], r["action"]) for r in a.sync(project="p").where("action <> 'no_change'").collect()} == {(ids["A"], "pull"), (ids["B"], "delete_local"), (ids["C"], "push"), (ids["D"], "delete_remote")}
    known, manifest, there, here = told()
    assert manifest == both(there, here) and set(manifest) == {ids["A"], ids["C"]} and other in there and other not in here
    # Of what wasn't asked for it keeps what it knew.
    assert {k: v for k, v in known.items() if k in manifest} == manifest and set(known) - set(manifest) == {ids["E"], ids["F"]}
    base = spark.createDataFrame([(ids["E"], there[ids["E"]])], "id string, content_hash string")
    assert {(r["id"], r["action"]) for r in a.sync(base=base, push_only=True).collect()} == {(ids["E"], "push"), (ids["F"], "delete_remote")}
    known, manifest, there, here = told()
    assert known == manifest == both(there, here) and set(manifest) == {ids["A"], ids["C"], ids["E"]}
    assert {(r["id"], r["action"]) for r in a.sync().where("action <> 'no_change'").collect()} == {(other, "pull")}
    known, manifest, there, here = told()
    assert known == manifest == there == here and readers.last_syncs(spark, folder)


def test_last_syncs_of_other_manifests(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps({"entries": {"e": {"content_hash": "h"}}, "last_sync": {"m": "2024-01-01"}}, indent=2))
    assert readers.last_syncs(spark, str(tmp_path)) == {"m": "2024-01-01"} and readers.last_syncs(spark, str(tmp_path / "none")) == {}
