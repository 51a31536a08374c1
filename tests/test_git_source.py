"""The data source of commits: partitions, conditions that reach it, and a stream that takes up what is new."""

import subprocess

import pytest
from pyspark.sql import functions as F

from quillstone.operators import commits
from quillstone.sources import readers
from quillstone.sources.git_source import _records, register


def git(repo, *arguments):
    out = subprocess.run(["git", "-C", str(repo), "-c", "user.name=Ann \x01 B", "-c", "user.email=a@x.org", *arguments], capture_output=True, check=True)
    return out.stdout.decode().strip()


def commit(repo, n):
    (repo / f"f{n % 2}.py").write_text(f"x = {n}\n# a line with \x01 and commit-{'0' * 32}\n")
    git(repo, "add", "-A")
    git(repo, "commit", "-qm", f"fix: change {n}\n\nBody of {n}.")
    return git(repo, "rev-parse", "HEAD")


@pytest.fixture
def repo(tmp_path):
    at = tmp_path / "repo"
    at.mkdir()
    git(at, "init", "-q")
    return at


def test_partitions_and_conditions(spark, repo):
    shas = [commit(repo, n) for n in range(7)]
    register(spark)
    log = spark.read.format("git").option("commits", 3).load(str(repo))
    assert log.rdd.getNumPartitions() == 3
    got = {r["sha"]: r for r in log.collect()}
    assert set(got) == set(shas) and got[shas[2]]["message"] == "fix: change 2\n\nBody of 2." and got[shas[2]]["author"] == "Ann \x01 B"
    plain = {r["sha"]: (r["timestamp"], r["diff"].strip()) for r in readers.git_log(spark, str(repo)).collect()}
    assert {s: (r["timestamp"], r["diff"].strip()) for s, r in got.items()} == plain
    assert {r["sha"]: len(r["diffs"]) for r in commits.with_diffs(log).collect()} == dict.fromkeys(shas, 1)
    assert [r["sha"] for r in log.where(F.col("sha") == shas[4]).collect()] == [shas[4]]
    assert {r["sha"] for r in log.where(F.col("sha").isin(shas[1], shas[5], "0" * 40) & (F.col("message").contains("5"))).collect()} == {shas[5]}
    assert spark.read.format("git").option("limit", 2).load(str(repo)).count() == 2
    assert spark.read.format("git").option("file", "f1.py").load(str(repo)).count() == 3
    assert [r[0] for r in _records(str(repo), shas[:2])] == shas[:2] and list(_records(str(repo), [shas[0]]))[0][5].startswith("diff --git")


def test_stream_of_new_commits(spark, repo, tmp_path):
    register(spark)
    told, shas = [], []

    def keep(batch, number):
        told.extend(r["sha"] for r in batch.collect())

    stream = spark.readStream.format("git").option("commits", 2).load(str(repo))
    for n in (3, 0, 2):
        shas += [commit(repo, len(shas) + i) for i in range(n)]
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).start()
        query.processAllAvailable()
        query.stop()
        assert sorted(told) == sorted(shas)
