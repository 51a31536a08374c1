"""Entry operators on small written rows, against plain Python where order or recursion matters."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillstone.functions import scalars as S
from quillstone.operators import code, commits, graph, ledgers, maintenance, retrieval, search, sessions, sync, versions
from quillstone.sources import readers

NOW = datetime(2024, 6, 1)
ENTRY = "id long, title string, description string, content string, tags array<string>, project string, created timestamp_ntz, updated_at timestamp_ntz, last_used timestamp_ntz, usage_count long"


def entry(i, title="t", content="c", tags=("python",), project="p", created=0, used=None, usage=0, description="d", updated=None):
    at = NOW - timedelta(days=created)
    return (i, title, description, content, list(tags), project, at, at if updated is None else NOW - timedelta(days=updated), None if used is None else NOW - timedelta(days=used), usage)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ENTRY)


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize(("sizes", "budget", "n", "want"), [
    ([30, 80, 15], 50, 5, [1, 3]), ([80, 10], 50, 5, [1]), ([10, 10, 10], 100, 2, [1, 2]), ([50, 1], 50, 5, [1]), ([20, 40, 40, 30], 60, 9, [1, 2]), ([20, 50, 30], 60, 9, [1, 3]),
])
def test_budget(spark, sizes, budget, n, want):
    ranked = spark.createDataFrame([(i + 1, s) for i, s in enumerate(sizes)], "rank int, tokens long")
    assert sorted(r["rank"] for r in retrieval.within_budget(ranked, budget, n).collect()) == want


def test_retrieve_filters_and_null_dates(spark):
    e = frame(spark, entry(1, used=1), entry(2, used=100), entry(3), entry(4, tags=["go"], used=1))
    v = spark.createDataFrame([(i, [1.0, 0.0] if i != 3 else [0.8, 0.6]) for i in range(1, 5)], "id long, embedding array<float>")
    found = retrieval.retrieve(e, v, [1.0, 0.0], tags=["python"], since=(NOW - timedelta(days=30)).isoformat(), date_field="last_used")
    assert [(r["rank"], r["id"]) for r in found.orderBy("rank").collect()] == [(1, 1), (2, 3)]
    listed = search.list_entries(e, tags=["python"], since=(NOW - timedelta(days=30)).isoformat(), date_field="last_used")
    assert ids(listed) == [1]
    used = retrieval.with_usage(e, retrieval.usage(found, NOW)).where("id = 3").first()
    assert used["usage_count"] == 1 and used["last_used"] == NOW


def test_signs_stand_for_themselves(spark):
    e = frame(spark, entry(1, "at 100% load"), entry(2, "at 100 load"), entry(3, "test_value"), entry(4, "testXvalue"), entry(5, "ÉCOLE"))
    assert ids(search.search_entries(e, "100%")) == [1] and ids(search.search_entries(e, "T_V")) == [3]
    assert ids(search.search_entries(e, "école")) == [] and ids(search.search_entries(e, "École".upper())) == [5]


def test_tags(spark):
    e = frame(spark, entry(1, tags=["javascript", "api"]), entry(2, tags=["python"]), entry(3, tags=[]))
    like = lambda *t: ids(e.where(search.tagged(t, True)))
    assert like("javascrpt", "api") == [1] and like("jvscrpt", "api") == [] and like("pythn") == [2]
    assert ids(e.where(search.tagged(["Python"], False))) == [] and ids(e.where(search.tagged(["python"], False))) == [2]


def test_limit_comes_before_tags_unless_exact(spark):
    e = frame(spark, *[entry(i, tags=["a"], created=i) for i in range(1, 8)], entry(9, tags=["b"], created=50))
    assert ids(search.list_entries(e, limit=2, tags=["b"])) == [] and ids(search.list_entries(e, limit=2, tags=["b"], exact=True)) == [9]


def test_bare_date_leaves_out_its_day(spark):
    e = frame(spark, entry(1, created=0.5), entry(2, created=1.5))
    assert ids(search.list_entries(e, until="2024-05-31")) == [2]


def test_stale(spark):
    e = frame(spark, entry(1, created=100), entry(2, created=100, used=0), entry(3, created=50), entry(4, created=100, used=100, updated=10))
    found = {r["id"]: r["days_stale"] for r in maintenance.stale(e, NOW, 30).collect()}
    assert found == {1: 100, 3: 50} and ids(maintenance.stale(e, NOW, 90)) == [1]


def test_quality(spark):
    full = dict(description="d" * 50, content="c" * 100, usage=1)
    e = frame(spark, entry(1, **full), entry(2, **full | {"tags": []}), entry(3, **full | {"description": "d" * 49}), entry(4, **full | {"usage": 0}), entry(5, tags=[]))
    assert {r["id"]: r["score"] for r in maintenance.quality(e).collect()} == {1: 100, 2: 75, 3: 75, 4: 75, 5: 0}
    assert ids(maintenance.quality(e, 75, 75)) == [2, 3, 4]


def test_projects_count_together(spark):
    e = frame(spark, entry(1, project=None), entry(2, project=""), entry(3, project="x"))
    assert [tuple(r) for r in maintenance.count_by_project(e).collect()] == [("(no project)", 2), ("x", 1)]


def test_duplicate_groups_follow_the_order(spark):
    r = random.Random(2)
    for _ in range(3):
        n = 30
        rows = [entry(i, created=r.randint(0, 40), used=r.choice([None, r.randint(0, 9)])) for i in range(n)]
        pairs = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(45)})
        order = sorted(rows, key=lambda x: (x[8] is None, -(x[8] or NOW).timestamp(), -x[6].timestamp(), x[0]))
        near = {i: {b if a == i else a for a, b in pairs if i in (a, b)} for i in range(n)}
        leader, grouped = {}, set()
        for x in order:
            if x[0] in grouped:
                continue
            grouped.add(x[0])
            for m in near[x[0]] - grouped:
                leader[m] = x[0]
                grouped.add(m)
        found = maintenance.duplicate_groups(frame(spark, *rows), spark.createDataFrame([(a, b, 0.9) for a, b in pairs], "a long, b long, similarity double"))
        assert {x["member"]: x["leader"] for x in found.collect()} == leader


def test_similar_pairs_in_blocks(spark):
    r = random.Random(3)
    data = []
    for i in range(40):
        v = [r.gauss(0, 1) for _ in range(4)]
        n = sum(x * x for x in v) ** 0.5
        data.append((i, [x / n for x in v]))
    want = {(i, j) for i, v in data for j, w in data if i < j and sum(a * b for a, b in zip(v, w, strict=True)) >= 0.8}
    vectors = spark.createDataFrame(data, "id long, embedding array<double>")
    for block in (4096, 7):
        assert {(x["a"], x["b"]) for x in maintenance.similar_pairs(vectors, 0.8, block).collect()} == want
    near = {(x["a"], x["b"]) for x in maintenance.similar_pairs_lsh(vectors, 0.8).collect()}
    assert near <= want and len(near) >= 0.8 * len(want)


def test_metric_join_in_cells(spark):
    r = random.Random(8)
    data = []
    for c in range(25):
        centre = [r.gauss(0, 1) for _ in range(6)]
        for i in range(12):
            v = [x + r.gauss(0, 0.05) for x in centre]
            n = sum(x * x for x in v) ** 0.5
            data.append((100 * c + i, [x / n for x in v]))
    data += [(5_000 + i, data[3][1]) for i in range(30)] + [(6_000, data[200][1]), (7_000, None), (7_001, [0.0] * 6)]
    want = {(i, j) for i, v in data for j, w in data if v and w and i < j and sum(a * b for a, b in zip(v, w, strict=True)) >= 0.9}
    vectors = spark.createDataFrame(data, "id long, embedding array<double>").repartition(3)
    for block, pivots in ((4096, 20), (5, 8), (4096, None), (5, 1)):
        join = maintenance.MetricJoin(vectors, 0.9, block, pivots)
        pairs = {(x["a"], x["b"]) for x in join.pairs().collect()}
        members = {x["id"]: x["representative"] for x in join.members().collect()}
        assert members[5_000] == members[3] == 3 and len(members) == len(data) - 1
        assert pairs == {p for p in want if members[p[0]] != members[p[1]] and all(members[x] == x for x in p)}
        if pivots == 20:
            assert join.copies_a_row < 3
    assert {(x["a"], x["b"]) for x in maintenance.similar_pairs(vectors, 0.9).collect()} == want
    rows = frame(spark, *[entry(i, created=r.randint(0, 40), used=r.choice([None, r.randint(0, 9)])) for i, _ in data])
    groups = lambda g: {x["member"]: (x["leader"], round(x["similarity"], 6)) for x in g.collect()}
    assert groups(maintenance.similar_groups(rows, vectors, 0.9)) == groups(maintenance.duplicate_groups(rows, maintenance.similar_pairs(vectors, 0.9)))
    none = spark.createDataFrame([], "id long, embedding array<double>")
    assert maintenance.similar_pairs(none, 0.9).count() == 0 and maintenance.similar_groups(rows, none, 0.9).count() == 0


def test_merge(spark):
    e = frame(spark, entry(1, content="a", tags=["tag1", "tag2"], usage=2), entry(2, content="b", tags=["tag2", "tag3"], usage=3))
    row = maintenance.merge(e, spark.createDataFrame([(1, 2)], "target long, source long")).first()
    assert row["content"] == "a\n\n---\n\nb" and row["tags"] == ["tag1", "tag2", "tag3"] and row["usage_count"] == 5


EDGE = "source_id long, target_id long, relationship_type string"


def test_links(spark):
    e = frame(spark, *[entry(i) for i in (1, 2, 3)])
    have = spark.createDataFrame([(1, 2, "related")], EDGE)
    wanted = spark.createDataFrame([(2, 1, "related"), (3, 3, "related"), (1, 9, "related"), (3, 1, "depends-on"), (3, 1, "depends-on"), (1, 2, "odd")], EDGE)
    assert [tuple(r) for r in graph.link(have, wanted, e).select("source_id", "target_id", "relationship_type").collect()] == [(3, 1, "depends-on")]
    edges = spark.createDataFrame([(1, 2, "related"), (2, 1, "depends-on"), (1, 3, "supersedes")], EDGE)
    assert graph.unlink(edges, 2, 1).count() == 1 and graph.unlink(edges, 1, 2, "depends-on").count() == 3 and graph.unlink(edges, 2, 1, "related").count() == 2
    both = {(r["other_id"], r["direction"]) for r in graph.related(edges, e, e.where("id = 1")).collect()}
    assert both == {(2, "outgoing"), (2, "incoming"), (3, "outgoing")}
    assert graph.cascade(edges, e.where("id = 3"), "source_id", "target_id").count() == 2
    n = {r["id"]: (r["relationships"], r["collections"]) for r in graph.link_counts(edges, spark.createDataFrame([(7, 2)], "collection_id long, entry_id long"), e).collect()}
    assert n == {1: (3, 0), 2: (2, 1), 3: (1, 0)}


def test_tree(spark):
    d = lambda *pairs: spark.createDataFrame([(a, b, "depends-on") for a, b in pairs], EDGE)
    paths = lambda e, root, depth=3: {tuple(r["path"]): r["circular"] for r in graph.dependency_tree(spark, e, root, depth).collect()}
    assert paths(d((1, 2), (2, 3)), 1, 1) == {(1,): False, (1, 2): False}
    assert paths(d((1, 2), (2, 1)), 1) == {(1,): False, (1, 2): False, (1, 2, 1): True}
    assert sum(p[-1] == 4 for p in paths(d((1, 2), (1, 3), (2, 4), (3, 4)), 1)) == 2
    assert max(map(len, paths(d(*[(i, i + 1) for i in range(20)]), 0, 99))) == 11


def test_collections(spark):
    c = spark.createDataFrame([(1, " a ", "x", NOW), (2, "a", "x", NOW + timedelta(1)), (3, " ", "x", NOW), (4, "b", "y" * 2001, NOW)], "id long, name string, description string, created timestamp_ntz")
    assert ids(graph.valid_collections(c)) == [1]
    m = spark.createDataFrame([(1, 5, NOW)], "collection_id long, entry_id long, added_at timestamp_ntz")
    assert graph.add_members(m, m.unionByName(m.withColumn("entry_id", F.lit(6).cast("long")))).count() == 1
    assert [(r["id"], r["member_count"]) for r in graph.list_collections(c.where("id < 3"), m).collect()] == [(1, 1), (2, 0)]
    assert graph.get_collection(c, "b").first()["id"] == 4


def test_versions(spark):
    images = spark.createDataFrame([(1, f"t{i}", "same" if i < 3 else None, NOW + timedelta(i), i) for i in range(10)], "entry_id long, title string, content string, at timestamp_ntz, seq long")
    v = versions.numbered(images, "entry_id", "at", "seq")
    assert sorted(r["version_number"] for r in versions.pruned(v, "entry_id", 5).collect()) == [6, 7, 8, 9, 10]
    changed = {r["version_number"]: (r["title_changed"], r["content_changed"]) for r in versions.changed_fields(v, "entry_id", ["title", "content"]).collect()}
    assert changed[2] == (True, False) and changed[4] == (True, True) and changed[5] == (True, False)
    now = spark.createDataFrame([(1, "now", "x"), (2, "now", "x")], "entry_id long, title string, content string")
    assert {r["entry_id"]: r["title"] for r in versions.rolled_back(now, v, "entry_id", 2).collect()} == {1: "t1", 2: "now"}
    row = versions.diff(v, "entry_id", 1, 2, ["title"], ["content"]).first()
    assert row["title_diff"] == "--- v1\n+++ v2\n@@ -1 +1 @@\n-t0\n+t1" and row["content_changed"] is False
    assert versions.diff_text("a", "a") is None


@pytest.mark.parametrize(("local", "remote", "base", "dead", "want"), [
    ("a", "a", None, None, "no_change"), ("b", "a", "a", None, "push"), ("a", "b", "a", None, "pull"), ("b", "c", "a", None, "conflict"), ("b", "c", None, None, "conflict"),
    ("a", None, "a", 5, "delete_local"), ("a", None, "a", -5, "push"), ("a", None, None, None, "push"), (None, "a", "a", 5, "delete_remote"), (None, "a", None, -5, "pull"), (None, "a", None, None, "pull"),
])
def test_sync_decisions(spark, local, remote, base, dead, want):
    side = lambda h: spark.createDataFrame([(1, h, NOW)] if h else [], "id long, content_hash string, updated_at timestamp_ntz")
    tombs = spark.createDataFrame([(1, NOW + timedelta(days=dead))] if dead else [], "id long, deleted_at timestamp_ntz")
    acts = sync.actions(side(local), side(remote), spark.createDataFrame([(1, base)] if base else [], "id long, content_hash string"), tombs)
    assert acts.first()["action"] == want


@pytest.mark.parametrize(("strategy", "later", "want"), [("last-write-wins", 1, "pull"), ("last-write-wins", 0, "push"), ("local-wins", 1, "push"), ("remote-wins", -1, "pull"), ("manual", 1, "conflict")])
def test_conflicts(spark, strategy, later, want):
    acts = spark.createDataFrame([(1, "conflict", NOW, NOW + timedelta(later))], "id long, action string, local_updated timestamp_ntz, remote_updated timestamp_ntz")
    assert sync.resolved(acts, strategy).first()["action"] == want


def test_ledgers(spark):
    items = spark.createDataFrame([("f", "r", "h1"), ("g", "r", "h2")], "file_path string, repo_path string, content_hash string")
    done = spark.createDataFrame([("f", "r", "old"), ("g", "r", "h2")], "file_path string, repo_path string, content_hash string")
    assert ledgers.pending(items, done, ledgers.FILE).count() == 0 and ledgers.pending(items, done, ledgers.FILE, True).first()["file_path"] == "f"


# Miners

_LINES = [
    '{"type":"user","uuid":"u1","timestamp":"2024-01-01T00:00:00Z","message":{"role":"user","content":"Hi, can you please fix the login error? Thanks"}}',
    '{"type":"assistant","uuid":"a1","timestamp":"2024-01-01T00:01:00Z","message":{"role":"assistant","content":[{"type":"text","text":"I changed the token check.\\n\\nMore words."},{"type":"tool_use","id":"x","name":"Edit","input":{"file_path":"a.py","old_string":"x","new_string":"def f(a):\\n  pass"}}]}}',
    "", "not json", '{"type":"summary","uuid":"s"}',
    '{"type":"user","uuid":"u2","message":{"role":"user","content":[{"type":"tool_result","content":"done"}]}}',
    '{"type":"user","uuid":"u3","message":{"role":"user","content":"Perfect, it works"}}',
    '{"type":"assistant","uuid":"a3","message":{"role":"assistant","content":"Glad to hear."}}',
]


def test_sessions(spark, tmp_path):
    (tmp_path / "s1.jsonl").write_text("\n".join(_LINES))
    m = readers.sessions(spark, str(tmp_path))
    assert sorted(r["uuid"] for r in m.collect()) == ["a1", "a3", "u1", "u2", "u3"]
    pairs = sessions.with_outcome(sessions.conversation_pairs(m)).orderBy("pair").collect()
    assert [(p["user_uuid"], p["assistant_uuid"], p["acknowledged"], p["corrected"]) for p in pairs] == [("u1", "a1", True, True), ("u3", "a3", True, False)]
    found = sessions.extract(m, spark.createDataFrame([("s1", "/home/x/Shop")], "session_id string, project_path string")).collect()
    assert len(found) == 1 and found[0]["title"] == "Fix the login error" and found[0]["extraction_type"] == "problem_solution"
    assert found[0]["confidence"] == 0.7 and found[0]["description"] == "I changed the token check."
    assert found[0]["tags"] == ["auth", "code", "error-handling", "python", "shop"] or {"auth", "code", "python", "shop"} <= set(found[0]["tags"])
    assert "Edit to a.py:\n```\ndef f(a):" in found[0]["content"]


_DIFF = """diff --git a/src/api/auth.py b/src/api/auth.py
index 1..2 100644
--- a/src/api/auth.py
+++ b/src/api/auth.py
@@ -1,2 +1,3 @@ def f
 a
+b
-c
@@ -9 +10 @@
+d
diff --git a/tests/test_auth.py b/tests/test_auth.py
new file mode 100644
--- /dev/null
+++ b/tests/test_auth.py
@@ -0,0 +1 @@
+x
diff --git a/old.go b/new.go
rename from old.go
rename to new.go
"""


def test_diffs():
    found = commits.parse_diff(_DIFF)
    assert [(d["file_path"], d["change_type"], d["old_path"], d["additions"], d["deletions"], len(d["hunks"])) for d in found] == [
        ("src/api/auth.py", "modified", None, 2, 1, 2), ("tests/test_auth.py", "added", None, 1, 0, 1), ("new.go", "renamed", "old.go", 0, 0, 0),
    ]
    assert (found[0]["hunks"][0]["old_count"], found[0]["hunks"][1]["new_count"], found[0]["hunks"][0]["header"]) == (2, 1, "def f")
    assert commits.parse_diff(None) == [] and commits.parse_diff("diff --cc x") == []


def test_commits(spark):
    messages = ["fix(auth): repair token check\n\nThe check was wrong for a day or so.", "update", "Merge branch x", "Add new cache and support it", "wip: temp", "quick fix"]
    raw = spark.createDataFrame([(str(i) * 10, m, "A", "a@x", NOW, _DIFF) for i, m in enumerate(messages)], "sha string, message string, author string, author_email string, timestamp timestamp_ntz, diff string")
    found = {r["source_refs"][0][0]: r for r in commits.extract(commits.with_diffs(raw)).collect()}
    assert set(found) == {"0", "3", "4"}
    first = found["0"]
    assert first["title"] == "Fix: Repair token check" and first["extraction_type"] == "bug_fix" and first["confidence"] == 0.8
    assert first["description"] == "The check was wrong for a day or so." and first["tags"] == ["api", "auth", "bug-fix", "go", "python"]
    assert "- [M] src/api/auth.py (+2/-1)" in first["content"] and "```python\n" in first["content"]
    assert found["3"]["extraction_type"] == "feature" and found["3"]["description"].startswith("New feature affecting src/api/auth.py, tests/test_auth.py, new.go (+3/-1 lines).")
    assert commits.extract(commits.with_diffs(raw), kinds=["feature"]).count() == 1


_PY = '''import os
from a.b import c

@dec
class UserRepository(Base):
    """A repository of users, with words enough to count as documentation of it.

    Args:
        x: y
    """

    @property
    def find_by(self, name) -> int:
        pass

    def save(self):
        # TODO: later
        pass


def top(a, b):
    """Short."""
'''


def test_source_files(spark, tmp_path):
    files = {"src/user_repo.py": _PY, "src/order_repository.py": _PY.replace("User", "Order"), "node_modules/x.js": "class X {", "lib/a.js": "import q from 'w'\n/** Doc.\n * More */\nexport class A extends B {\nconst f = (a) => 1\n// FIXME: it\n", "m.go": 'import (\n "fmt"\n)\n// Doc of T\ntype T struct {\nfunc (t *T) Run(x int) int {\nfunc main() {\n', "r.rb": "require 'json'\nclass A < B\n  # doc\n  def go!(x)\n  # note: x\n", "n.txt": "class X:"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    parsed = code.parse(readers.source_files(spark, str(tmp_path))).collect()
    by = {r["path"]: r for r in parsed}
    assert set(by) == {"src/user_repo.py", "src/order_repository.py", "lib/a.js", "m.go", "r.rb"}
    shape = lambda p: [(e["element_type"], e["name"], e["parent"]) for e in by[p]["elements"]]
    assert shape("src/user_repo.py") == [("class", "UserRepository", None), ("method", "find_by", "UserRepository"), ("method", "save", "UserRepository"), ("function", "top", None)]
    assert by["src/user_repo.py"]["elements"][0]["decorators"] == ["dec"] and by["src/user_repo.py"]["imports"] == ["os", "a.b"]
    assert by["src/user_repo.py"]["comments"] == ["[TODO] later"] and by["lib/a.js"]["comments"] == ["[FIXME] it"] and by["r.rb"]["comments"] == ["[NOTE] x"]
    assert shape("lib/a.js") == [("class", "A", None), ("function", "f", None)] and by["lib/a.js"]["imports"] == ["w"] and by["lib/a.js"]["elements"][0]["docstring"] == "Doc.\nMore"
    assert shape("m.go") == [("class", "T", None), ("method", "Run", "T"), ("function", "main", None)] and by["m.go"]["imports"] == ["fmt"] and by["m.go"]["elements"][0]["docstring"] == "Doc of T"
    assert shape("r.rb") == [("class", "A", None), ("method", "go!", "A")] and by["r.rb"]["imports"] == ["json"]
    frame_ = code.parse(readers.source_files(spark, str(tmp_path)))
    kinds = {(r["pattern_type"], r["name"]) for r in code.pattern_matches(frame_).collect()}
    assert {("repository", "UserRepository"), ("repository", "OrderRepository")} <= kinds
    made = {r["extraction_type"]: r for r in code.extract(frame_, "Shop").collect()}
    assert made["docstring"]["confidence"] == 0.4 and "repository" in made["pattern"]["tags"]
    many = frame_.unionByName(frame_.withColumn("path", F.concat("path", F.lit("2")))).unionByName(frame_.withColumn("path", F.concat("path", F.lit("3"))))
    todo = code.comment_groups(many).where("title = 'Code TODOs'").first()
    assert todo["confidence"] == 0.35 and todo["description"] == "Found 6 TODO comments across the codebase."
    assert readers.source_files(spark, str(tmp_path), include=["*.go"]).count() == 1 and readers.source_files(spark, str(tmp_path), languages=["ruby"]).count() == 1


def test_log_records(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=N", "-c", "user.email=n@x", *a], check=True, capture_output=True)
    git("init", "-q")
    for i, m in enumerate(["feat: one\n\nBody of it", "fix: two"]):
        (tmp_path / "a.py").write_text(f"x = {i}\n")
        git("add", ".")
        git("commit", "-qm", m)
    found = commits.with_diffs(readers.git_log(spark, str(tmp_path))).collect()
    assert sorted(r["message"] for r in found) == ["feat: one\n\nBody of it", "fix: two"] and all(r["diffs"][0]["file_path"] == "a.py" for r in found)
    assert readers.git_log(spark, str(tmp_path), limit=1).count() == 1
    assert readers.repo_name("git@host:a/b.git") == "b" and readers.repo_name("https://host/a/c") == "c"


def test_driver_values():
    now = datetime(2024, 3, 1)
    assert S.since("7d", now) == "2024-02-23T00:00:00" and S.since("1m", now) == "2024-01-31T00:00:00" and S.since("2024-01-01", now) == "2024-01-01" and S.since("soon", now) is None
    assert S.since_short("2h", now) == datetime(2024, 2, 29, 22) and S.since_short("2w", now) is None and S.path_code("/a/b") == "-a-b"


def test_scalars(spark):
    row = spark.range(1).select(
        S.brief(F.lit("a" * 150 + " " + "b" * 100)).alias("a"), S.brief(F.lit("x" * 300)).alias("b"), S.tags_from_json(F.lit("nope")).alias("c"),
        S.display_language(F.lit("#!/usr/bin/env python\nx")).alias("d"), S.display_language(F.lit("SELECT 1; select * from t")).alias("e"),
        S.band(F.lit(0.5), 0.7, 0.4).alias("f"), F.levenshtein(F.lit("python"), F.lit("pyhton")).alias("g"), S.iso(F.lit("2024-01-01 00:00:00.5").cast("timestamp_ntz")).alias("h"),
    ).first()
    assert row["a"] == "a" * 150 + "..." and row["b"] == "x" * 200 + "..." and row["c"] == [] and row["d"] == "python" and row["e"] == "sql"
    assert row["f"] == "yellow" and row["g"] == 2 and row["h"] == "2024-01-01T00:00:00.500000"


def test_threads(spark):
    block = [("text", "x", None, None, None, None)]
    rows = [("s", i, t, u, p, NOW, block) for i, (t, u, p) in enumerate([
        ("user", "u1", None), ("assistant", "a1", "u1"), ("assistant", "a2", "a1"), ("user", "u2", "a2"), ("assistant", "b1", "u1"), ("user", "u3", "b1"), ("assistant", "c1", "u2"),
    ])]
    m = spark.createDataFrame(rows, f"session_id string, seq long, type string, uuid string, parent_uuid string, timestamp timestamp, blocks array<{sessions.BLOCK}>")
    got = [(r["user_uuid"], r["assistant_uuid"], r["text"].count("x"), r["pair"]) for r in sessions.threaded_pairs(m).orderBy("pair").collect()]
    assert got == [("u1", "a1", 3, 0), ("u2", "c1", 1, 1)]


def test_long_threads_and_circles(spark):
    block = [("text", "x", None, None, None, None)]
    rows = [("long", 0, "user", "m0", None, NOW, block)] + [("long", i, "assistant", f"m{i}", f"m{i - 1}", NOW, block) for i in range(1, 5_001)]
    rows += [("long", 6_000, "user", "m6000", "m5000", NOW, block), ("long", 6_001, "assistant", "m6001", "m6000", NOW, block)]
    rows += [("circle", i, t, u, p, NOW, block) for i, (t, u, p) in enumerate([
        ("user", "u", "b"), ("assistant", "a", "u"), ("assistant", "b", "a"), ("assistant", "x", "y"), ("assistant", "y", "x"), ("assistant", "z", "y"), ("assistant", "lost", "none"),
        ("assistant", None, "u"), ("assistant", "a", "y"), ("assistant", "own", "own"), ("assistant", "top", None),
    ])]
    m = spark.createDataFrame(rows, f"session_id string, seq long, type string, uuid string, parent_uuid string, timestamp timestamp, blocks array<{sessions.BLOCK}>")
    roots = {(r["session_id"], r["uuid"]): (r["root"], r["level"]) for r in sessions.thread_roots(m).collect()}
    assert roots == {
        **{("long", f"m{i}"): ("m0", i) for i in range(5_001)}, ("long", "m6000"): ("m6000", 0), ("long", "m6001"): ("m6000", 1),
        ("circle", "u"): ("u", 0), ("circle", "a"): ("u", 1), ("circle", "b"): ("u", 2),
    }
    got = {(r["session_id"], r["user_uuid"]): (r["pair"], r["text"].count("x")) for r in sessions.threaded_pairs(m.where("session_id = 'long'")).collect()}
    assert got == {("long", "m0"): (0, 5_000), ("long", "m6000"): (1, 1)}
    assert sessions.threaded_pairs(m.where("false")).count() == 0


def test_registered_functions(spark):
    from quillstone.functions.registered import register

    register(spark)
    spark.createDataFrame([("a", "b", _DIFF, _PY)], "a string, b string, d string, s string").createOrReplaceTempView("t")
    assert spark.sql("SELECT unified_diff(a, b) AS d FROM t").first()["d"].endswith("-a\n+b")
    assert spark.sql("SELECT p.file_path FROM t, LATERAL parse_diff(d) p").count() == 3
    assert spark.sql("SELECT p.name FROM t, LATERAL parse_source('python', s) p WHERE p.element_type = 'method'").count() == 2


def test_repository_reads(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=N", "-c", "user.email=n@x", *a], check=True, capture_output=True)
    assert not readers.is_repository(str(tmp_path))
    git("init", "-q", "-b", "trunk")
    for i in range(2):
        (tmp_path / "a.py").write_text(f"x = {i}\n")
        git("add", ".")
        git("commit", "-qm", f"fix: {i}")
    assert readers.is_repository(str(tmp_path)) and readers.branch_name(str(tmp_path)) == "trunk"
    assert readers.git_show(spark, str(tmp_path), "HEAD").first()["message"] == "fix: 1"
    d = commits.with_diffs(readers.git_diff(spark, str(tmp_path), "HEAD~1", "HEAD")).first()["diffs"]
    assert [(x["file_path"], x["additions"], x["deletions"]) for x in d] == [("a.py", 1, 1)]


def test_sources_are_parsed_once(spark):
    """All three miners together open a source once, whatever they ask of it."""
    from quillstone.operators import code

    opened = spark.sparkContext.accumulator(0)
    files = spark.createDataFrame([(f"src/f{i}_repo.py", f"class P{i}Repository:\n    def find_all(self):\n        pass  # TODO: {i}\n") for i in range(20)], "path string, content string")

    def count(batches):
        for batch in batches:
            opened.add(batch.num_rows)
            yield batch

    counted = code.parse(files).mapInArrow(count, code.parse(files).schema)
    found = {r["title"]: r for r in code.extract(counted, "Store").collect()}
    assert opened.value == 20 and set(found) == {"Repository Pattern", "Code TODOs"}
    entry = found["Repository Pattern"]
    names = sorted(f"src/f{i}_repo.py" for i in range(20))
    assert entry["source_refs"] == names and "and 17 more" in entry["description"] and entry["content"].count("### ") == 5
    assert entry["content"].index("P0R") < entry["content"].index("P10R") < entry["content"].index("P11R") and "15 more instances" in entry["content"]


def test_two_blocks_meet_in_bounded_memory(spark, monkeypatch):
    """All similar to all: no more products and scores than a strip has are held at once."""
    from quillstone.operators import maintenance

    monkeypatch.setattr(maintenance, "MET", 64, raising=True)
    monkeypatch.setattr(maintenance, "SCORED", 7, raising=True)
    v = [[1.0, i / 1e4] for i in range(40)]
    v = [[a / (a * a + b * b) ** 0.5, b / (a * a + b * b) ** 0.5] for a, b in v]
    found = maintenance.similar_pairs(spark.createDataFrame(list(enumerate(v)), "id long, embedding array<double>"), 0.9, block_rows=16)
    assert {(r["a"], r["b"]) for r in found.collect()} == {(i, j) for j in range(40) for i in range(j)}


def test_questions_carry_no_answers_through_the_shuffle(spark):
    from quillstone.operators import sessions

    block = lambda t: f"array(named_struct('type', 'text', 'text', '{t}', 'id', null, 'name', null, 'input', null, 'result', null))"
    m = spark.sql(f"select 's' session_id, 0L seq, 'user' type, 'u' uuid, current_timestamp() timestamp, from_json(to_json({block('how to?')}), 'array<{sessions.BLOCK}>') blocks")
    plan = sessions.conversation_pairs(m).select("session_id", "pair", "user_text")._jdf.queryExecution().optimizedPlan().toString()
    assert "AS asked" in plan and "AS text#" not in plan and "AS tools#" not in plan
