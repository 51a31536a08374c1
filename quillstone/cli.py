"""Command line over the engine: python -m quillstone.cli --kb DIR COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import scalars as S
from quillstone.operators import code, commits, graph, search, sessions
from quillstone.session import builder
from quillstone.sources import readers
from quillstone.store import LEDGERS, TABLES, Engine
from quillstone.tables import durable

_SHOWN = ("id", "title", "description", "project", "tags", "score", "usage_count", "last_used", "days_stale", "leader", "member", "similarity", "action", "version_number", "created_at", "change_summary", "name", "member_count", "level", "parent", "circular", "session_id", "commit_sha", "file_path", "processed_at", "entries_created", "other_id", "relationship_type", "direction")


def shown(df: DataFrame, form: str) -> str:
    """Rows for a terminal, one after the other from the cluster: a line each, JSON, or Markdown."""
    rows = [r.asDict(recursive=True) for r in df.toLocalIterator()]
    if form == "json":
        return json.dumps(rows, indent=2, default=str)
    if form == "markdown":
        return "\n".join(f"## {r.get('title', r.get('id'))}\n\n{r.get('description') or ''}\n\n{r.get('content') or ''}\n" for r in rows)
    return "\n".join("  ".join(f"{k}={r[k]}" for k in _SHOWN if r.get(k) not in (None, [])) for r in rows)


def _filters(p: argparse.ArgumentParser, limit: int) -> None:
    p.add_argument("--project")
    p.add_argument("--tags")
    p.add_argument("--fuzzy", action="store_true")
    p.add_argument("--since")
    p.add_argument("--until")
    p.add_argument("--date-field", default="created", choices=["created", "last_used"])
    p.add_argument("--limit", type=int, default=limit)


def _options(a: argparse.Namespace) -> dict:
    now = datetime.now()
    return {"project": a.project, "tags": [t.strip() for t in a.tags.split(",")] if a.tags else None, "fuzzy": a.fuzzy, "since": S.since(a.since, now), "until": S.since(a.until, now), "date_field": a.date_field}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillstone", description=__doc__)
    top.add_argument("--kb", default="kb", help="folder of the knowledge base")
    top.add_argument("--format", default="text", choices=["text", "json", "markdown"])
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *places: str, **flags) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for x in places:
            p.add_argument(x)
        for k, v in flags.items():
            p.add_argument(f"--{k.replace('_', '-')}", **({"action": "store_true"} if v is True else {"default": v, "type": type(v)} if v not in (None, False) else {"default": None}))
        return p

    add("capture", "title", "description", "content", tags=None, context=None, project=None, confidence=1.0)
    _filters(add("retrieve", "query", budget=2000, min_score=0.3), 5)
    _filters(add("list", collection=None), 20)
    _filters(add("search", "text"), 20)
    for name in ("get", "delete"):
        add(name, "id")
    add("update", "id", title=None, description=None, content=None, tags=None, context=None, project=None, confidence=None)
    add("stats")
    add("export", "path", project=None)
    add("import", "path", no_skip_duplicates=True)
    add("purge", project=None)
    sub_sync = add("sync", strategy="last-write-wins", push_only=True, pull_only=True, dry_run=True, status=True, project=None)
    sub_sync.add_argument("path", nargs="?")
    add("duplicates", threshold=0.85)
    add("stale", days=90, project=None)
    add("quality", min=None, max=None, project=None)
    add("completions", "column", "prefix")
    add("summarize", "folder", min_confidence=0.5, since=None, force=True)
    add("analyze", "folder", commits=True, code=True, project=None, min_confidence=0.5, since=None, force=True)
    add("processed", "kind")
    add("tree", "id", depth=graph.DEPTH)
    add("link", "source", "target", type="related")
    add("unlink", "source", "target", type=None)
    add("related", "id", type=None, direction="both")
    collection = add("collection", "action", entry=None, description=None, rename=None)
    collection.add_argument("name", nargs="?")
    add("history", "id")
    add("rollback", "id", "version")
    add("diff", "id", "a", b=None)
    return top


def _mine(engine: Engine, kind: str, items: DataFrame, extract: Callable[[DataFrame], DataFrame], least: float, force: bool, project: str | None = None) -> str:
    """Mines the items (the ledger's key, and what extract needs) that the ledger doesn't tell of, and marks them."""
    key = TABLES[LEDGERS[kind]][0]
    todo = durable(items if force else engine.pending(kind, items))
    made = extract(todo)
    kept = made.where(F.col("confidence") >= least)
    columns = ["title", "description", "content", "tags", "confidence"]
    refs = F.array("session_id") if kind == "sessions" else F.col("source_refs")
    rows = durable(kept.select(*columns, F.lit(project).alias("project"), F.col("extraction_type").alias("source"), refs.alias("refs"), F.array().cast("array<string>").alias("context")))
    n = rows.count()
    if n:
        engine.capture_all(rows.drop("refs"))
    which = todo.select(*key, *[c for c in ("content_hash",) if c in todo.columns]).distinct()
    engine.mark(kind, which, rows.select(F.explode("refs").alias(key[0])).join(which, key[0]))
    return f"{n} entries"


def run(a: argparse.Namespace, engine: Engine) -> str:
    spark, show = engine.spark, lambda df: shown(df, a.format)
    said = lambda ok: "done" if ok else "not found"
    number = lambda x: None if x is None else int(x)

    def collection() -> str:
        if a.action == "list":
            return show(engine.collections(None))
        if a.action == "create":
            return engine.create_collection(a.name, a.description or "")
        found = engine.collection(a.name).first()
        if found is None:
            return "not found"
        act: dict[str, Callable[[], str]] = {
            "delete": lambda: said(engine.delete_collection(found["id"])), "show": lambda: show(engine.collection_members(found["id"]).drop("embedding")),
            "update": lambda: said(engine.update_collection(found["id"], a.rename, a.description)), "add": lambda: said(engine.add_to_collection(found["id"], a.entry)), "remove": lambda: said(engine.remove_from_collection(found["id"], a.entry)),
        }
        return act[a.action]()

    def since(text: str | None) -> str | None:
        """A number of hours or days, or what the filters of lists take."""
        short = S.since_short(text, datetime.now()) if text else None
        return short.isoformat() if short else S.since(text, datetime.now())

    def analyze() -> str:
        folder = a.folder.rstrip("/")
        if a.code:
            files = readers.source_files(spark, folder).where("content is not null").withColumns({"file_path": F.col("path"), "repo_path": F.lit(folder), "content_hash": S.file_hash(F.col("content"))})
            return _mine(engine, "files", files, lambda todo: code.extract(code.parse(todo.select("path", "content")), a.project), a.min_confidence, a.force, a.project)
        log = readers.git_log(spark, folder, since=since(a.since)).withColumns({"commit_sha": F.col("sha"), "repo_path": F.lit(folder)})
        return _mine(engine, "commits", log, lambda todo: commits.extract(commits.with_diffs(todo.drop("commit_sha", "repo_path"))), a.min_confidence, a.force, a.project)

    def summarize() -> str:
        messages = durable(readers.sessions(spark, a.folder))
        ids = messages.groupBy("session_id").agg(F.max("timestamp").alias("latest"))
        if since(a.since):
            ids = ids.where(F.col("latest") >= F.lit(since(a.since)).cast("timestamp"))
        return _mine(engine, "sessions", ids.select("session_id"), lambda todo: sessions.extract(messages.join(todo, "session_id", "left_semi")), a.min_confidence, a.force)

    def exported() -> str:
        if a.path == "-":
            return "[" + ",\n".join(text for _, text in readers._documents(chosen(engine.entries()))) + "]"
        if a.path.endswith(".json"):
            return f"{readers.write_list(chosen(engine.entries()), a.path)} entries"
        return engine.export(a.path, a.project) or "done"

    def chosen(entries: DataFrame) -> DataFrame:
        return search.in_project(entries, a.project).drop("embedding")

    def imported() -> str:
        skip = not a.no_skip_duplicates
        found = engine.import_rows(readers.parse_export(spark, sys.stdin.read()), skip) if a.path == "-" else engine.import_from(a.path, skip)
        return json.dumps(found)

    def synced() -> str:
        if a.status:
            return show(engine.sync_status(a.path, a.project))
        return show(engine.sync(a.path, None, a.strategy, push_only=a.push_only, pull_only=a.pull_only, dry_run=a.dry_run, project=a.project))

    table: dict[str, Callable[[], str]] = {
        "capture": lambda: engine.capture(a.title, a.description, a.content, tags=a.tags, context=a.context, project=a.project, confidence=a.confidence),
        "retrieve": lambda: show(engine.retrieve(a.query, n=a.limit, token_budget=a.budget, min_score=a.min_score, **_options(a))),
        "list": lambda: show(engine.collection_members(a.collection).drop("embedding") if a.collection else engine.list(limit=a.limit, **_options(a)).drop("embedding")),
        "search": lambda: show(engine.search(a.text, limit=a.limit, **_options(a)).drop("embedding")),
        "get": lambda: show(engine.get(a.id).drop("embedding")), "delete": lambda: said(engine.delete(a.id)),
        "update": lambda: said(engine.update(a.id, title=a.title, description=a.description, content=a.content, tags=a.tags, context=a.context, project=a.project, confidence=None if a.confidence is None else float(a.confidence))),
        "stats": lambda: "\n".join(f"{k}:\n{show(df)}" for k, df in engine.stats().items()),
        "export": exported, "import": imported, "processed": lambda: show(engine.processed(a.kind)), "tree": lambda: show(engine.dependency_tree(a.id, a.depth)), "purge": lambda: f"{engine.purge(a.project)} entries",
        "sync": synced,
        "duplicates": lambda: show(engine.duplicates(a.threshold)), "stale": lambda: show(engine.stale(a.days, a.project).drop("embedding")),
        "quality": lambda: show(engine.quality(number(a.min), number(a.max), a.project).drop("embedding")),
        "completions": lambda: show(search.complete(engine.entries(), a.column, a.prefix)),
        "summarize": summarize, "analyze": analyze,
        "link": lambda: said(engine.link(a.source, a.target, a.type)), "unlink": lambda: f"{engine.unlink(a.source, a.target, a.type)} removed",
        "related": lambda: show(engine.related(a.id, a.type, a.direction)), "collection": collection, "history": lambda: show(engine.history(a.id)),
        "rollback": lambda: said(engine.rollback(a.id, int(a.version))), "diff": lambda: show(engine.diff(a.id, int(a.a), number(a.b))),
    }
    return table[a.command]()


def main(args: list[str] | None = None, engine: Engine | None = None) -> int:
    a = parser().parse_args(args)
    engine = engine or Engine(builder("quillstone").getOrCreate(), a.kb)
    try:
        print(run(a, engine))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
