"""The stored index of vectors: recall against brute force, exact results, plans that read a part of the cells."""

import numpy as np
import pytest

from quillstone.operators import retrieval, vector_index


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(5)
    x = np.repeat(r.normal(size=(40, 12)), 50, axis=0) + 0.4 * r.normal(size=(2_000, 12))
    x = (x / np.sqrt((x**2).sum(axis=1))[:, None]).astype(np.float32)
    rows = [(i, [float(a) for a in v], f"p{i % 3}") for i, v in enumerate(x)]
    rows += [(3_000, None, "p0"), (3_001, [1.0], "p0"), (3_002, [], "p1"), (None, rows[0][1], "p1")]
    return spark.createDataFrame(rows, "id long, embedding array<float>, project string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return vector_index.build(vectors, str(tmp_path_factory.mktemp("index") / "v"))


def usable(vectors):
    return vectors.where("id < 2500")


def asked(vectors, ids):
    return {r["id"]: [float(x) for x in r["embedding"]] for r in vectors.where(f"id in ({','.join(map(str, ids))})").collect()}


def test_recall_and_part_of_the_cells(spark, vectors, index):
    found, queries = [], asked(vectors, range(7, 2_000, 199))
    for q in queries.values():
        want = {r["id"] for r in retrieval.nearest(usable(vectors), q, 15).collect()}
        found.append(len(want & {r["id"] for r in index.search(q, 15).collect()}) / 15)
    assert np.mean(found) >= 0.95 and index.opened < len(index.centres) / 3
    order = np.argsort(-(index.centres @ np.array(q)))[: index.opened].tolist()
    plan = index.coded(q, order)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "embedding" not in plan[plan.index("ReadSchema") :]


def test_guaranteed_and_conditions(spark, vectors, index):
    for i, q in asked(vectors, (3, 704, 1_999)).items():
        exact = retrieval.nearest(usable(vectors), q, 9)
        assert [tuple(r) for r in index.search(q, 9, guaranteed=True).collect()] == [tuple(r) for r in exact.collect()]
        some = retrieval.nearest(usable(vectors).where("project = 'p2'"), q, 9, 0.2)
        assert [tuple(r) for r in index.search(q, 9, 0.2, where="project = 'p2'").collect()] == [tuple(r) for r in some.collect()]
    assert index.search(q, 9, 1.1, guaranteed=True).count() == 0


def test_changes(spark, tmp_path):
    rows = [(str(i), [float(np.cos(i)), float(np.sin(i))]) for i in range(60)]
    index = vector_index.build(spark.createDataFrame(rows, "id string, embedding array<float>"), str(tmp_path / "v"), cells=6)
    index.add(spark.createDataFrame([("new", [1.0, 0.0]), ("1", [1.0, 0.0])], "id string, embedding array<float>"))
    now = spark.createDataFrame([(i, v) for i, v in rows if i not in ("0", "1")] + [("new", [1.0, 0.0]), ("1", [1.0, 0.0])], "id string, embedding array<float>")
    again = vector_index.VectorIndex(spark, str(tmp_path / "v"))
    got = [r["id"] for r in again.search([1.0, 0.0], 4, guaranteed=True, vectors=now).collect()]
    assert got[:2] == ["1", "new"] and "0" not in got and len(got) == 4


def test_nothing(spark, tmp_path):
    index = vector_index.build(spark.createDataFrame([], "id long, embedding array<float>"), str(tmp_path / "v"))
    assert index.search([1.0], 3).count() == 0 and index.search([1.0], 3, guaranteed=True).count() == 0
