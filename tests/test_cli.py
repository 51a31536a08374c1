import io
import json

from quillstone import cli
from quillstone.store import Engine


def test_commands(spark, tmp_path, capsys, monkeypatch):
    engine = Engine(spark, str(tmp_path / "kb"))

    def run(*args):
        assert cli.main(list(args), engine) == 0
        return capsys.readouterr().out.strip()

    a = run("capture", "Cache keys", "How keys are made", "Keys have a prefix of the tenant.", "--tags", "Cache,api", "--project", "p")
    b = run("capture", "Pool size", "How large", "Ten connections are enough.")
    assert a in run("list") and a in run("search", "tenant") and a in run("retrieve", "keys prefix tenant", "--min-score", "0.1")
    assert json.loads(run("--format", "json", "get", a))[0]["tags"] == ["cache", "api"]
    assert run("update", a, "--title", "Cache names") == "done" and "Cache names" in run("--format", "markdown", "get", a)
    assert "version_number=1" in run("history", a) and run("rollback", a, "1") == "done"
    assert run("link", a, b) == "done" and b in run("related", a) and run("unlink", a, b) == "1 removed"
    run("collection", "create", "Core")
    assert run("collection", "add", "Core", "--entry", a) == "done" and a in run("collection", "show", "Core")
    assert "score=" in run("quality") and "by_project" in run("stats") and run("stale") == "" and run("completions", "project", "p") == "project=p"
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "x.py").write_text('class Thing:\n    """' + "Words about a thing. " * 8 + '"""\n')
    assert run("analyze", str(tmp_path / "src"), "--code") == "1 entries" and run("analyze", str(tmp_path / "src"), "--code") == "0 entries"
    (tmp_path / "src" / "x.py").write_text('class Other:\n    """' + "Words about another thing. " * 8 + '"""\n')
    assert run("analyze", str(tmp_path / "src"), "--code") == "1 entries" and "entries_created=1" in run("processed", "files")
    assert "Core" in run("collection", "list") and run("collection", "update", "Core", "--rename", "Kernel") == "done"
    assert len(json.loads(run("export", "-"))) == 4 and run("export", str(tmp_path / "all.json")) == "4 entries"
    assert json.loads(run("import", str(tmp_path / "all.json"))) == {"imported": 0, "skipped": 4, "errors": 0}
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps([{"title": "In", "description": "d", "content": "c"}])))
    assert json.loads(run("import", "-")) == {"imported": 1, "skipped": 0, "errors": 0}
    assert "action=push" in run("sync", str(tmp_path / "replica")) and run("sync", "--status") == ""
    talk = [{"type": "user", "uuid": "u1", "message": {"role": "user", "content": "How do I fix the failing cache test?"}}, {"type": "assistant", "uuid": "a1", "parentUuid": "u1", "message": {"role": "assistant", "content": [{"type": "text", "text": "Clear the cache before each test, then run it again."}, {"type": "tool_use", "id": "t", "name": "Edit", "input": {"file_path": "x.py", "old_string": "a", "new_string": "b"}}]}}]
    (tmp_path / "talks").mkdir()
    (tmp_path / "talks" / "s1.jsonl").write_text("\n".join(json.dumps(x) for x in talk))
    assert run("summarize", str(tmp_path / "talks")) == "1 entries" and run("summarize", str(tmp_path / "talks")) == "0 entries"
    assert run("delete", b) == "done" and run("delete", b) == "not found" and run("purge") == "5 entries"
