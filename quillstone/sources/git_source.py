"""Commits of a repository as a data source of Spark: register(spark), then
spark.read.format("git").load(repository), or spark.readStream for those that come in.

The driver only lists the commits' hashes; they are dealt to partitions of ``commits`` each (an option), and each partition
asks the tool for its own commits and their differences and hands them on one by one. So no process holds a whole log. The
repository's folder must be one that executors reach. The options since, until, author, limit, branch and file are the tool's
own filters; a condition on sha chooses commits before any is read. A stream's offset is the last commit it has seen, so that
each trigger reads what has been added to the branch since."""

from __future__ import annotations

import subprocess
import uuid
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

SCHEMA = "sha string, author string, author_email string, timestamp timestamp_ntz, message string, diff string"
#: Commits in a partition.
COMMITS = 500
_FIELDS = "%H%x00%an%x00%ae%x00%aI%x00%B%x00"


class Commits(InputPartition):
    def __init__(self, shas: list[str]):
        super().__init__(len(shas))
        self.shas = shas


def _listed(repo: str, *arguments: str) -> Iterator[str]:
    with subprocess.Popen(["git", "-C", repo, "rev-list", *arguments], stdout=subprocess.PIPE, text=True) as run:
        yield from (line.strip() for line in run.stdout)
    if run.returncode:
        raise subprocess.CalledProcessError(run.returncode, run.args)


def _records(repo: str, shas: list[str]) -> Iterator[tuple]:
    """The commits of these hashes, one after the other as the tool writes them."""
    mark = f"commit-{uuid.uuid4().hex}".encode()
    command = ["git", "-C", repo, "show", "--stdin", f"--format={mark.decode()}{_FIELDS}", "-p", "--no-color"]
    with subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE) as run:
        run.stdin.write("\n".join(shas).encode())
        run.stdin.close()
        held = b""
        while part := run.stdout.read(1 << 16):
            *whole, held = (held + part).split(mark)
            yield from (_record(r) for r in whole if r.strip())
        if held.strip():
            yield _record(held)
    if run.returncode:
        raise subprocess.CalledProcessError(run.returncode, command)


def _record(raw: bytes) -> tuple:
    sha, author, email, at, message, diff = raw.decode("utf-8", "replace").split("\0", 5)
    when = datetime.fromisoformat(at)
    when = (when - when.utcoffset()).replace(tzinfo=None) if when.utcoffset() is not None else when
    return sha.strip(), author, email, when, message.rstrip(), diff.lstrip()


class _Reader:
    def __init__(self, options: dict):
        self.repo, self.each = options["path"], int(options.get("commits", COMMITS))
        self.branch, self.file = options.get("branch", "HEAD"), options.get("file")
        self.filters = [f"--{k}={options[k]}" for k in ("since", "until", "author") if options.get(k)] + ([f"--max-count={options['limit']}"] if options.get("limit") else [])

    def chosen(self, *range_: str) -> list[Commits]:
        shas = list(_listed(self.repo, *self.filters, *range_, *(["--", self.file] if self.file else [])))
        return [Commits(shas[i : i + self.each]) for i in range(0, len(shas), self.each)]

    def read(self, partition: Commits | None) -> Iterator[tuple]:
        yield from _records(self.repo, partition.shas) if partition is not None and partition.shas else ()


class _BatchReader(_Reader, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.shas: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("sha",):
                some = set(f.value) if isinstance(f, In) else {f.value}
                self.shas = some if self.shas is None else self.shas & some
            else:
                yield f

    def partitions(self) -> list[Commits]:
        found = self.chosen(self.branch)
        if self.shas is None:
            return found
        kept = [s for p in found for s in p.shas if s in self.shas]
        return [Commits(kept[i : i + self.each]) for i in range(0, len(kept), self.each)]


class _StreamReader(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"sha": ""}

    def latestOffset(self) -> dict:
        return {"sha": next(_listed(self.repo, "--max-count=1", self.branch), "")}

    def partitions(self, start: dict, end: dict) -> list[Commits]:
        if not end["sha"] or start["sha"] == end["sha"]:
            return [Commits([])]
        return self.chosen("--reverse", *([f"^{start['sha']}"] if start["sha"] else []), end["sha"]) or [Commits([])]

    def commit(self, end: dict) -> None:
        pass


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets conditions reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitSource)
