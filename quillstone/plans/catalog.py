"""Registered queries over the driver's tables, each with equivalent SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import scalars as S
from quillstone.operators import commits, graph, ledgers, maintenance, retrieval, search, sessions, sync, tag_dictionary, text_index, vector_index, versions
from quillstone.streaming import streams
from quillstone.tables import shared_dir, table

from . import kb

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def registered(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _queries[name or f.__name__] = f
        if sql:
            _sql[name or f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    from . import mined  # registers its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)


def _time(c: str) -> object:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _t(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


def _with(sql: str) -> str:
    return kb.SQL + sql


# Retrieval


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval under a score floor and a token budget."""
    found = retrieval.retrieve(kb.entries(spark, sf_dir), kb.vectors(spark, sf_dir), kb.vector(spark, sf_dir, 53), n=5, token_budget=2000, min_score=0.3)
    return found.select("rank", "id", "title", F.round("score", 6).alias("score"), "tokens")


_SCORED = """, q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 53), scored AS (
  SELECT vec_id AS id, list_inner_product(CAST(embedding AS DOUBLE[]), q.v) AS score FROM embeddings, q), near AS (
  SELECT * FROM scored WHERE score >= {floor} ORDER BY score DESC, id LIMIT {n})"""


@registered("SELECT vec_id AS id, round(list_inner_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 53)), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 15")
def retrieve_topk(spark, sf_dir):
    return retrieval.nearest(kb.vectors(spark, sf_dir), kb.vector(spark, sf_dir, 53), 15).select("id", F.round("score", 6).alias("score"))


_TOPK = "SELECT vec_id AS id, round(list_inner_product(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 53)), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 15"


def _index(spark, sf_dir) -> vector_index.VectorIndex:
    """A stored index of all vectors, with the project of those that have an entry."""
    projects = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("project"))
    return vector_index.temporary(spark, kb.vectors(spark, sf_dir).join(projects, "id", "left"))


@registered(_TOPK)
def vector_index_topk(spark, sf_dir):
    """From cells of a stored index, opened until no other can hold a better vector."""
    return _index(spark, sf_dir).search(kb.vector(spark, sf_dir, 53), 15, guaranteed=True).select("id", F.round("score", 6).alias("score"))


@registered(_with(_SCORED.format(floor=0.1, n=15) + "SELECT k.id, k.title, round(score, 6) AS score FROM near JOIN kb k USING (id) WHERE list_contains(tags, 'en') AND (last_used IS NULL OR last_used >= '2024-01-10')"))
def retrieve_filtered(spark, sf_dir):
    """The candidates that pass, before the budget."""
    near = retrieval.nearest(kb.vectors(spark, sf_dir), kb.vector(spark, sf_dir, 53), 15, 0.1)
    passes = search.tagged(["en"], False) & search.between("last_used", "2024-01-10", None, keep_null=True)
    return kb.entries(spark, sf_dir, usage=True).join(F.broadcast(near), "id").where(passes).select("id", "title", F.round("score", 6).alias("score"))


@registered(_with(_SCORED.format(floor=0.1, n=50) + "SELECT k.id, round(score, 6) AS score, last_used IS NULL AS no_date FROM near JOIN kb k USING (id) WHERE last_used IS NULL OR last_used >= '2024-01-15'"))
def retrieve_null_date_passthrough(spark, sf_dir):
    near = retrieval.nearest(kb.vectors(spark, sf_dir), kb.vector(spark, sf_dir, 53), 50, 0.1)
    found = kb.entries(spark, sf_dir, usage=True).join(F.broadcast(near), "id").where(search.between("last_used", "2024-01-15", None, keep_null=True))
    return found.select("id", F.round("score", 6).alias("score"), F.col("last_used").isNull().alias("no_date"))


_BUDGET = _SCORED.format(floor=0.3, n=15) + """, ranked AS (
  SELECT row_number() OVER (ORDER BY score DESC, k.id) AS rk, k.id, k.title, score, length(content) // 4 AS tokens FROM near JOIN kb k USING (id)
), walk(rk, total, n, taken, stop) AS (
  SELECT 0, 0::BIGINT, 0, [-1], false
  UNION ALL
  SELECT w.rk + 1,
    CASE WHEN NOT stop AND n < 5 AND (total + tokens <= {b} OR (n = 0 AND tokens > {b})) THEN total + tokens ELSE total END,
    CASE WHEN NOT stop AND n < 5 AND (total + tokens <= {b} OR (n = 0 AND tokens > {b})) THEN n + 1 ELSE n END,
    CASE WHEN NOT stop AND n < 5 AND (total + tokens <= {b} OR (n = 0 AND tokens > {b})) THEN list_append(taken, CAST(r.rk AS INT)) ELSE taken END,
    stop OR (NOT stop AND n = 0 AND tokens > {b})
  FROM walk w JOIN ranked r ON r.rk = w.rk + 1
) SELECT CAST(r.rk AS INT) AS rank, r.id, r.title, round(score, 6) AS score, tokens FROM ranked r, (SELECT taken FROM walk ORDER BY rk DESC LIMIT 1) w WHERE list_contains(w.taken, CAST(r.rk AS INT))"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH kb", "WITH RECURSIVE kb", 1)


@registered(_recursive(_with(_BUDGET.format(b=2000))))
def retrieve_token_budget(spark, sf_dir):
    return flagship(spark, sf_dir)


@registered(_recursive(_with(_BUDGET.format(b=500))))
def retrieve_small_budget(spark, sf_dir):
    found = retrieval.retrieve(kb.entries(spark, sf_dir), kb.vectors(spark, sf_dir), kb.vector(spark, sf_dir, 53), n=5, token_budget=500, min_score=0.3)
    return found.select("rank", "id", "title", F.round("score", 6).alias("score"), "tokens")


_PROJECT = _with(""", q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 53)
SELECT k.id, round(list_inner_product(CAST(e.embedding AS DOUBLE[]), q.v), 6) AS score FROM kb k JOIN embeddings e ON e.vec_id = k.id, q WHERE project = 'src3' ORDER BY score DESC, k.id LIMIT 5""")


@registered(_PROJECT)
def retrieve_in_project(spark, sf_dir):
    found = retrieval.retrieve(kb.entries(spark, sf_dir), kb.vectors(spark, sf_dir), kb.vector(spark, sf_dir, 53), n=5, token_budget=10**9, project="src3", min_score=-1.0)
    return found.select("id", F.round("score", 6).alias("score"))


@registered(_PROJECT)
def vector_index_project(spark, sf_dir):
    """The project is looked at inside the cells, before codes are ranked."""
    found = retrieval.retrieve(kb.entries(spark, sf_dir), None, kb.vector(spark, sf_dir, 53), n=5, token_budget=10**9, project="src3", min_score=-1.0, index=_index(spark, sf_dir))
    return found.select("id", F.round("score", 6).alias("score"))


@registered(_recursive(_with(_BUDGET.format(b=2000))))
def vector_index_retrieve(spark, sf_dir):
    found = retrieval.retrieve(kb.entries(spark, sf_dir), None, kb.vector(spark, sf_dir, 53), n=5, token_budget=2000, min_score=0.3, index=_index(spark, sf_dir), guaranteed=True)
    return found.select("rank", "id", "title", F.round("score", 6).alias("score"), "tokens")


# Lists, lookups and searches


@registered(_with(f"SELECT id, title, description, project, {_t('created')} FROM kb WHERE project = 'src7'"))
def scan_project_filter(spark, sf_dir):
    return search.in_project(kb.entries(spark, sf_dir), "src7").select("id", "title", "description", "project", _time("created"))


@registered(_with("SELECT id, title, content FROM kb WHERE id = 42"))
def point_lookup(spark, sf_dir):
    return search.get(kb.entries(spark, sf_dir), 42).select("id", "title", "content")


@registered(_with("SELECT id, title FROM kb WHERE id IN (SELECT vec_id FROM embeddings WHERE label = 3)"))
def batch_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))
    return search.get_many(kb.entries(spark, sf_dir), ids).select("id", "title")


@registered(_with(f"SELECT id, title, usage_count, {_t('last_used')} FROM kb ORDER BY kb.last_used DESC NULLS LAST, created DESC, id LIMIT 50"))
def list_recent(spark, sf_dir):
    return search.list_entries(kb.entries(spark, sf_dir, usage=True)).select("id", "title", "usage_count", _time("last_used"))


@registered(_with("SELECT id, title FROM (SELECT * FROM kb ORDER BY last_used DESC NULLS LAST, created DESC, id LIMIT 60) t WHERE list_contains(ltags, 'en') AND list_contains(ltags, 'src1') ORDER BY last_used DESC NULLS LAST, created DESC, id LIMIT 20"))
def list_tags_exact(spark, sf_dir):
    return search.list_entries(kb.entries(spark, sf_dir, usage=True, labels=True), limit=20, tags=["en", "src1"]).select("id", "title")


@registered(_with("SELECT id, array_to_string(list_sort(ltags), ',') AS tags FROM kb WHERE list_contains(ltags, 'toxic') ORDER BY last_used DESC NULLS LAST, created DESC, id LIMIT 20"))
def list_tags_filter_first(spark, sf_dir):
    found = search.list_entries(kb.entries(spark, sf_dir, usage=True, labels=True), limit=20, tags=["toxic"], exact=True)
    return found.select("id", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@registered(_with("SELECT id, array_to_string(ltags, ',') AS tags FROM kb WHERE len(list_filter(ltags, lambda x: levenshtein(lower(x), 'toxxic') <= 2)) > 0"))
def list_tags_fuzzy(spark, sf_dir):
    found = kb.entries(spark, sf_dir, labels=True).where(search.tagged(["Toxxic"], True))
    return found.select("id", F.array_join("tags", ",").alias("tags"))


@registered(_with(f"SELECT id, {_t('created')} FROM kb WHERE {kb.ISO.format('created')} >= '2024-01-10' AND {kb.ISO.format('created')} <= '2024-01-20' ORDER BY kb.created DESC, id LIMIT 100"))
def list_date_range(spark, sf_dir):
    return search.list_entries(kb.entries(spark, sf_dir), limit=100, since="2024-01-10", until="2024-01-20").select("id", _time("created"))


_FOUND = "contains(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{q}')"


def _search_sql(q: str, limit: int) -> str:
    return _with(f"SELECT id, title, usage_count FROM kb WHERE {' OR '.join(_FOUND.format(c=c, q=q) for c in ('title', 'description', 'content'))} ORDER BY usage_count DESC, last_used DESC NULLS LAST, id LIMIT {limit}")


@registered(_search_sql("license", 40))
def search_substring(spark, sf_dir):
    return search.search_entries(kb.entries(spark, sf_dir, usage=True), "License", limit=40).select("id", "title", "usage_count")


def _text_index(spark, sf_dir) -> text_index.TextIndex:
    return text_index.build(kb.entries(spark, sf_dir), f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}")


@registered(_search_sql("license", 40))
def text_index_search(spark, sf_dir):
    """Candidates by their trigrams, the rarest first; their texts decide."""
    return search.search_entries(kb.entries(spark, sf_dir, usage=True), "License", limit=40, index=_text_index(spark, sf_dir)).select("id", "title", "usage_count")


@registered(_with("SELECT id FROM kb WHERE contains(translate(title || chr(65535) || description || chr(65535) || content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'th')"))
def text_index_short(spark, sf_dir):
    """Two characters have no trigram: all indexed texts are read."""
    return _text_index(spark, sf_dir).hits("TH")


@registered(_with("SELECT id, array_to_string(ltags, ',') AS tags FROM kb WHERE len(list_filter(ltags, lambda x: levenshtein(lower(x), 'toxxic') <= 2)) > 0 AND len(list_filter(ltags, lambda x: levenshtein(lower(x), 'src11') <= 2)) > 0"))
def tag_dictionary_search(spark, sf_dir):
    """Fuzzy tags by deletions: a distance is worked out for each distinct tag once."""
    e = kb.entries(spark, sf_dir, labels=True)
    return tag_dictionary.tagged(e, tag_dictionary.build(e), ["Toxxic", "src11"]).select("id", F.array_join("tags", ",").alias("tags"))


@registered(_with("SELECT id, title FROM kb WHERE title LIKE '%/%%' ESCAPE '/' OR content LIKE '%/%%' ESCAPE '/'"))
def search_literal_percent(spark, sf_dir):
    return search.search_entries(kb.entries(spark, sf_dir), "%", limit=10**6).select("id", "title")


@registered(_with("SELECT DISTINCT project FROM kb WHERE project <> '' ORDER BY project"))
def distinct_projects(spark, sf_dir):
    return search.projects(kb.entries(spark, sf_dir))


@registered(_with("SELECT DISTINCT project FROM kb WHERE starts_with(project, 'src1') ORDER BY project"))
def complete_project(spark, sf_dir):
    return search.complete(kb.entries(spark, sf_dir), "project", "src1")


# Maintenance


@registered("SELECT coalesce(nullif(CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN '' ELSE source END, ''), '(no project)') AS project, count(*) AS n FROM documents GROUP BY 1")
def stats_by_project(spark, sf_dir):
    named = F.when(F.col("id") % 13 == 0, None).when(F.col("id") % 17 == 0, "").otherwise(F.col("project"))
    return maintenance.count_by_project(kb.entries(spark, sf_dir).withColumn("project", named))


@registered(_with("SELECT id, title, usage_count FROM kb ORDER BY usage_count DESC, id LIMIT 5"))
def stats_top_used(spark, sf_dir):
    return maintenance.most_used(kb.entries(spark, sf_dir, usage=True)).select("id", "title", "usage_count")


@registered(_with(f"SELECT id, title, {_t('created')} FROM kb ORDER BY kb.created DESC, id LIMIT 5"))
def stats_recent(spark, sf_dir):
    return maintenance.newest(kb.entries(spark, sf_dir)).select("id", "title", _time("created"))


@registered(_with(f"SELECT id, title, {_t('last_used')} FROM kb WHERE kb.last_used IS NOT NULL ORDER BY kb.last_used DESC, id LIMIT 5"))
def stats_recent_used(spark, sf_dir):
    return maintenance.latest_used(kb.entries(spark, sf_dir, usage=True)).select("id", "title", _time("last_used"))


@registered("SELECT count(*) AS n FROM documents")
def stats_total(spark, sf_dir):
    return maintenance.stats(kb.entries(spark, sf_dir))["total"]


@registered(_with(f"""SELECT id, date_diff('microsecond', coalesce(last_used, updated_at, created), TIMESTAMP '{kb.NOW}') // 86400000000 AS days_stale FROM kb
WHERE (last_used IS NOT NULL AND last_used < TIMESTAMP '{kb.NOW}' - INTERVAL 90 DAY AND updated_at < TIMESTAMP '{kb.NOW}' - INTERVAL 90 DAY)
   OR (last_used IS NULL AND coalesce(updated_at, created) < TIMESTAMP '{kb.NOW}' - INTERVAL 90 DAY)"""))
def stale_entries(spark, sf_dir):
    return maintenance.stale(kb.entries(spark, sf_dir, usage=True), kb.NOW, 90).select("id", "days_stale")


_QUALITY = "CAST(CASE WHEN len(ltags) > 0 THEN 25 ELSE 0 END + CASE WHEN length(description) >= 50 THEN 25 ELSE 0 END + CASE WHEN length(content) >= 100 THEN 25 ELSE 0 END + CASE WHEN usage_count > 0 THEN 25 ELSE 0 END AS BIGINT)"


@registered(_with(f"SELECT id, {_QUALITY} AS score FROM kb"))
def quality_scores(spark, sf_dir):
    return maintenance.quality(kb.entries(spark, sf_dir, usage=True)).select("id", "score")


@registered(_with(f"SELECT id, score FROM (SELECT id, {_QUALITY} AS score FROM kb) t WHERE score BETWEEN 26 AND 75"))
def quality_range(spark, sf_dir):
    return maintenance.quality(kb.entries(spark, sf_dir, usage=True), 26, 75).select("id", "score")


@registered(_with("""SELECT sha256(title || chr(10) || description || chr(10) || content) AS content_hash, count(*) AS n, min(id) AS first_id FROM kb GROUP BY 1 HAVING count(*) > 1"""))
def dup_exact(spark, sf_dir):
    return maintenance.exact_duplicates(kb.entries(spark, sf_dir))


@registered("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.4""")
def dup_pairs(spark, sf_dir):
    return maintenance.similar_pairs(kb.vectors(spark, sf_dir), 0.4).select("a", "b", F.round("similarity", 6).alias("similarity"))


@registered(_with(""", o AS (SELECT id, row_number() OVER (ORDER BY last_used DESC NULLS LAST, created DESC, id) AS r FROM kb),
near AS (SELECT x.r AS a, y.r AS b, x.id AS aid, y.id AS bid, list_inner_product(CAST(p.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s FROM embeddings p JOIN embeddings q ON p.vec_id <> q.vec_id JOIN o x ON x.id = p.vec_id JOIN o y ON y.id = q.vec_id
  WHERE list_inner_product(CAST(p.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) >= 0.4),
nodes AS (SELECT row_number() OVER (ORDER BY a) AS k, a FROM (SELECT DISTINCT a FROM near)),
earlier AS (SELECT n.k, n.a, coalesce(list(e.b) FILTER (WHERE e.b < n.a), []) AS before FROM nodes n LEFT JOIN near e ON e.a = n.a GROUP BY n.k, n.a),
walk(k, leaders) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT w.k + 1, CASE WHEN list_has_any(w.leaders, e.before) THEN w.leaders ELSE list_append(w.leaders, e.a) END FROM walk w JOIN earlier e ON e.k = w.k + 1),
leaders AS (SELECT unnest(leaders) AS a FROM (SELECT leaders FROM walk ORDER BY k DESC LIMIT 1))
SELECT arg_min(aid, a) AS leader, bid AS member, round(arg_min(s, a), 3) AS similarity FROM near WHERE a IN (SELECT a FROM leaders) AND b NOT IN (SELECT a FROM leaders) GROUP BY bid""").replace("WITH kb", "WITH RECURSIVE kb", 1))
def dup_groups(spark, sf_dir):
    """Leader clustering in the order of lists; the SQL walks through the entries one by one."""
    return maintenance.similar_groups(kb.entries(spark, sf_dir, usage=True), kb.vectors(spark, sf_dir), 0.4).select("leader", "member", F.round("similarity", 3).alias("similarity"))


@registered(_with("""SELECT t.id, sha256(t.content || chr(10) || chr(10) || '---' || chr(10) || chr(10) || s.content) AS content_sha256, array_to_string(list_sort(list_distinct(list_concat(t.ltags, s.ltags))), ',') AS tags,
t.usage_count + s.usage_count AS usage_count FROM kb t JOIN kb s ON s.id = t.id + 1 WHERE t.id % 2 = 0"""))
def merge_entries(spark, sf_dir):
    e = kb.entries(spark, sf_dir, usage=True, labels=True)
    pairs = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("target"), (F.col("doc_id") + 1).alias("source"))
    found = maintenance.merge(e, pairs)
    return found.select("id", F.sha2("content", 256).alias("content_sha256"), F.array_join("tags", ",").alias("tags"), "usage_count")


# Relationships and collections


def _edges(spark, sf_dir):
    """Each order links the entry of its customer to that of its own number: the ends that no entry has fall away."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("target_id"), F.when(F.col("o_orderkey") % 3 == 0, "related").when(F.col("o_orderkey") % 3 == 1, "depends-on").otherwise("supersedes").alias("relationship_type"))


_EDGES = """WITH RECURSIVE raw AS (SELECT o_custkey AS s, o_orderkey AS t, CASE o_orderkey % 3 WHEN 0 THEN 'related' WHEN 1 THEN 'depends-on' ELSE 'supersedes' END AS k FROM orders WHERE o_custkey IN (SELECT doc_id FROM documents) AND o_orderkey IN (SELECT doc_id FROM documents)),
edges AS (SELECT DISTINCT CASE WHEN k = 'related' THEN least(s, t) ELSE s END AS source_id, CASE WHEN k = 'related' THEN greatest(s, t) ELSE t END AS target_id, k AS relationship_type FROM raw WHERE s <> t)"""


def _linked(spark, sf_dir):
    ids = kb.entries(spark, sf_dir)
    empty = spark.createDataFrame([], "source_id long, target_id long, relationship_type string")
    return graph.link(empty, _edges(spark, sf_dir), ids).select("source_id", "target_id", "relationship_type")


@registered(_EDGES + " SELECT source_id, target_id, relationship_type FROM edges")
def link_normalized(spark, sf_dir):
    return _linked(spark, sf_dir)


@registered(_EDGES + """ SELECT e.id, e.other_id, e.relationship_type, e.direction, left(split_part(d.text, chr(10), 1), 80) AS title FROM (
  SELECT source_id AS id, target_id AS other_id, relationship_type, 'outgoing' AS direction FROM edges UNION ALL SELECT target_id, source_id, relationship_type, 'incoming' FROM edges) e
LEFT JOIN documents d ON d.doc_id = e.other_id""")
def related_edges(spark, sf_dir):
    entries = kb.entries(spark, sf_dir)
    return graph.related(_linked(spark, sf_dir), entries, entries).select("id", "other_id", "relationship_type", "direction", "title")


def _tree_sql(root: int, depth: int) -> str:
    return _EDGES + f""", tree(id, parent, level, path, circular) AS (
  SELECT CAST({root} AS BIGINT), CAST(NULL AS BIGINT), 0, [CAST({root} AS BIGINT)], false
  UNION ALL SELECT e.target_id, t.id, t.level + 1, list_append(t.path, e.target_id), list_contains(t.path, e.target_id)
  FROM tree t JOIN edges e ON e.source_id = t.id AND e.relationship_type = 'depends-on' WHERE NOT t.circular AND t.level < {depth}
) SELECT id, coalesce(parent, -1) AS parent, CAST(level AS INT) AS level, array_to_string(path, '>') AS path, circular FROM tree"""


def _tree(spark, sf_dir, root, depth):
    found = graph.dependency_tree(spark, _linked(spark, sf_dir), root, depth)
    return found.select("id", F.coalesce("parent", F.lit(-1)).alias("parent"), F.col("level").cast("int").alias("level"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "circular")


@registered(_tree_sql(5, 3))
def dependency_tree(spark, sf_dir):
    return _tree(spark, sf_dir, 5, 3)


@registered("""WITH RECURSIVE edges AS (SELECT DISTINCT o_custkey % 4 AS source_id, o_orderkey % 5 AS target_id FROM orders WHERE o_custkey % 4 <> o_orderkey % 5), tree(id, level, path, circular) AS (
  SELECT CAST(1 AS BIGINT), 0, [CAST(1 AS BIGINT)], false UNION ALL
  SELECT e.target_id, t.level + 1, list_append(t.path, e.target_id), list_contains(t.path, e.target_id) FROM tree t JOIN edges e ON e.source_id = t.id WHERE NOT t.circular AND t.level < 4
) SELECT array_to_string(path, '>') AS path, circular FROM tree""")
def dependency_cycle(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).alias("source_id"), (F.col("o_orderkey") % 5).alias("target_id"), F.lit("depends-on").alias("relationship_type"))
    found = graph.dependency_tree(spark, graph.normalized(e).distinct(), 1, 4)
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "circular")


def _collections(spark, sf_dir):
    """Nations are collections of customers."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("").alias("description"))
    m = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("collection_id"), F.col("c_custkey").alias("entry_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("c_custkey") % 50).cast("int"))).alias("added_at"))
    return n, m


@registered("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, count(c_custkey) AS member_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def collections_counts(spark, sf_dir):
    return graph.list_collections(*_collections(spark, sf_dir), limit=None).select("id", "name", "member_count")


@registered("SELECT c_custkey AS id, c_name AS title FROM customer WHERE c_nationkey = 7")
def collection_members(spark, sf_dir):
    _, m = _collections(spark, sf_dir)
    return graph.members(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title")), m, 7).select("id", "title")


@registered("SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_nationkey = (SELECT c_nationkey FROM customer WHERE c_custkey = 33)")
def entry_collections(spark, sf_dir):
    return graph.collections_of(*_collections(spark, sf_dir), 33).select("id", "name")


@registered(_EDGES + """ SELECT d.doc_id AS id, coalesce(ends.n, 0) AS relationships, CAST(CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS collections
FROM documents d LEFT JOIN customer ON c_custkey = d.doc_id LEFT JOIN (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) GROUP BY id) ends ON ends.id = d.doc_id""")
def link_counts(spark, sf_dir):
    return graph.link_counts(_linked(spark, sf_dir), _collections(spark, sf_dir)[1], kb.entries(spark, sf_dir))


# Versions: the orders of a customer as the versions of an entry


def _versions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entry_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("content"))
    return versions.numbered(o, "entry_id", "at", "seq")


_VERSIONS = "WITH v AS (SELECT o_custkey AS entry_id, o_orderkey AS seq, o_orderstatus AS title, o_orderpriority AS content, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_number FROM orders)"


@registered(_VERSIONS + " SELECT entry_id, seq, version_number FROM v")
def version_numbers(spark, sf_dir):
    return _versions(spark, sf_dir).select("entry_id", "seq", "version_number")


@registered(_VERSIONS + " SELECT entry_id, seq, version_number FROM v QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY version_number DESC) <= 5")
def version_prune(spark, sf_dir):
    return versions.pruned(_versions(spark, sf_dir), "entry_id", 5).select("entry_id", "seq", "version_number")


@registered(_VERSIONS + " SELECT entry_id, max(version_number) AS version_number, count(*) AS n FROM v GROUP BY entry_id")
def version_latest(spark, sf_dir):
    return versions.newest_version(_versions(spark, sf_dir), "entry_id")


@registered(_VERSIONS + " SELECT version_number, title, content FROM v WHERE entry_id = 17 ORDER BY version_number DESC LIMIT 10")
def version_history(spark, sf_dir):
    o = _versions(spark, sf_dir)
    return versions.history(o, "entry_id", 17, 10).select("version_number", "title", "content")


@registered(_VERSIONS + """ SELECT c.entry_id, coalesce(o.title, c.title) AS title, coalesce(o.content, c.content) AS content
FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY version_number DESC) = 1) c LEFT JOIN v o ON o.entry_id = c.entry_id AND o.version_number = 2""")
def rollback_state(spark, sf_dir):
    v = _versions(spark, sf_dir)
    current = versions.pruned(v, "entry_id", 1).select("entry_id", "title", "content")
    return versions.rolled_back(current, v, "entry_id", 2)


@registered(_VERSIONS + """ SELECT entry_id, version_number, title IS DISTINCT FROM lag(title) OVER w AS title_changed, content IS DISTINCT FROM lag(content) OVER w AS content_changed
FROM v WINDOW w AS (PARTITION BY entry_id ORDER BY version_number) QUALIFY version_number > 1""")
def version_changed_fields(spark, sf_dir):
    return versions.changed_fields(_versions(spark, sf_dir), "entry_id", ["title", "content"])


@registered(_VERSIONS + """ SELECT a.entry_id, CASE WHEN a.content <> b.content THEN '--- v1' || chr(10) || '+++ v2' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-' || a.content || chr(10) || '+' || b.content END AS content_diff, a.title <> b.title AS title_changed
FROM v a JOIN v b ON b.entry_id = a.entry_id AND a.version_number = 1 AND b.version_number = 2""")
def version_diff(spark, sf_dir):
    return versions.diff(_versions(spark, sf_dir), "entry_id", 1, 2, ["content"], ["title"])


# Replicas: orders with deterministic edits


def _replicas(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    side = lambda edit, days: (F.sha2(F.concat(k.cast("string"), F.when(edit, F.lit("x")).otherwise("")), 256).alias("content_hash"), (F.col("o_orderdate") + F.make_dt_interval(F.when(edit, F.lit(days)).otherwise(0))).alias("updated_at"))
    local = o.where(k % 11 != 0).select(k.alias("id"), *side(k % 5 == 0, 3))
    remote = o.where(k % 13 != 0).select(k.alias("id"), F.sha2(F.concat(k.cast("string"), F.when(k % 7 == 0, F.lit("y")).otherwise("")), 256).alias("content_hash"), (F.col("o_orderdate") + F.make_dt_interval(F.when(k % 7 == 0, 5).otherwise(0) - F.when(k % 2 == 0, 4).otherwise(0))).alias("updated_at"))
    base = o.where(k % 17 != 0).select(k.alias("id"), F.sha2(k.cast("string"), 256).alias("content_hash"))
    tombs = o.where(k % 19 == 0).select(k.alias("id"), (F.col("o_orderdate") + F.make_dt_interval(F.lit(1))).alias("deleted_at"))
    return local, remote, base, tombs


_ACTIONS = """WITH l AS (SELECT o_orderkey AS id, sha256(o_orderkey::VARCHAR || CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END) AS h, o_orderdate + to_days(CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 0 END) AS u FROM orders WHERE o_orderkey % 11 <> 0),
r AS (SELECT o_orderkey AS id, sha256(o_orderkey::VARCHAR || CASE WHEN o_orderkey % 7 = 0 THEN 'y' ELSE '' END) AS h, o_orderdate + to_days(CAST(CASE WHEN o_orderkey % 7 = 0 THEN 5 ELSE 0 END - CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 0 END AS INT)) AS u FROM orders WHERE o_orderkey % 13 <> 0),
b AS (SELECT o_orderkey AS id, sha256(o_orderkey::VARCHAR) AS h FROM orders WHERE o_orderkey % 17 <> 0), t AS (SELECT o_orderkey AS id, o_orderdate + INTERVAL 1 DAY AS d FROM orders WHERE o_orderkey % 19 = 0),
a AS (SELECT coalesce(l.id, r.id) AS id, l.u AS lu, r.u AS ru, CASE
  WHEN l.id IS NOT NULL AND r.id IS NOT NULL AND l.h = r.h THEN 'no_change'
  WHEN l.id IS NOT NULL AND r.id IS NOT NULL AND l.h IS DISTINCT FROM b.h AND r.h IS NOT DISTINCT FROM b.h THEN 'push'
  WHEN l.id IS NOT NULL AND r.id IS NOT NULL AND r.h IS DISTINCT FROM b.h AND l.h IS NOT DISTINCT FROM b.h THEN 'pull'
  WHEN l.id IS NOT NULL AND r.id IS NOT NULL THEN 'conflict'
  WHEN l.id IS NOT NULL AND t.d > l.u THEN 'delete_local' WHEN l.id IS NOT NULL THEN 'push' WHEN t.d > r.u THEN 'delete_remote' ELSE 'pull' END AS action
 FROM l FULL JOIN r ON r.id = l.id LEFT JOIN b ON b.id = coalesce(l.id, r.id) LEFT JOIN t ON t.id = coalesce(l.id, r.id))"""


@registered(_ACTIONS + " SELECT id, action FROM a")
def sync_actions(spark, sf_dir):
    return sync.actions(*_replicas(spark, sf_dir)).select("id", "action")


@registered(_ACTIONS + " SELECT id, CASE WHEN action <> 'conflict' THEN action WHEN ru > lu THEN 'pull' ELSE 'push' END AS action FROM a")
def sync_lww(spark, sf_dir):
    return sync.resolved(sync.actions(*_replicas(spark, sf_dir))).select("id", "action")


@registered(_ACTIONS + " SELECT action, count(*) AS n FROM a GROUP BY action")
def sync_dry_run_counts(spark, sf_dir):
    return sync.counts(sync.actions(*_replicas(spark, sf_dir)))


@registered(_ACTIONS + " SELECT coalesce(p.id, l.id) AS id, coalesce(p.h, l.h) AS content_hash FROM l FULL JOIN (SELECT r.id, r.h FROM r JOIN a ON a.id = r.id AND (action = 'pull' OR action = 'conflict')) p ON p.id = l.id WHERE coalesce(p.id, l.id) NOT IN (SELECT id FROM a WHERE action = 'delete_local')")
def sync_applied_remote_wins(spark, sf_dir):
    local, remote, base, tombs = _replicas(spark, sf_dir)
    return sync.apply_local(local, remote, sync.resolved(sync.actions(local, remote, base, tombs), "remote-wins")).select("id", "content_hash")


@registered("""WITH e AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS t, l_suppkey % 4 AS m FROM lineitem), l AS (SELECT DISTINCT s, t FROM e WHERE m <> 1), r AS (SELECT DISTINCT s, t FROM e WHERE m <> 2)
SELECT s AS source_id, t AS target_id, 'push' AS action FROM l WHERE (s, t) NOT IN (SELECT (s, t) FROM r) AND s % 7 <> 0 AND t % 7 <> 0
UNION ALL SELECT s, t, 'pull' FROM r WHERE (s, t) NOT IN (SELECT (s, t) FROM l) AND s % 5 <> 0 AND t % 5 <> 0""")
def sync_relationships(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), (F.col("l_suppkey") % 4).alias("m"), F.lit("related").alias("relationship_type"))
    local, remote = e.where("m <> 1").drop("m").distinct(), e.where("m <> 2").drop("m").distinct()
    ids = table(spark, sf_dir, "lineitem").select(F.explode(F.array("l_orderkey", "l_partkey")).alias("id")).distinct()
    return sync.relationships(local, remote, ids.where("id % 5 <> 0"), ids.where("id % 7 <> 0")).select("source_id", "target_id", "action")


@registered("""WITH l AS (SELECT o_custkey AS id, max(o_orderdate) AS u FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), r AS (SELECT o_custkey AS id, max(o_orderdate) AS u FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT coalesce(l.id, r.id) AS id, CASE WHEN r.u IS NULL OR l.u > r.u THEN 'push' WHEN l.u IS NULL OR r.u > l.u THEN 'pull' ELSE 'no_change' END AS action FROM l FULL JOIN r USING (id)""")
def sync_collections(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    side = lambda n: o.where(F.col("o_orderkey") % n == 0).groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("updated_at"))
    return sync.collections(side(2), side(3))


# Ledgers


@registered("SELECT o_orderkey AS commit_sha FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def incremental_pending(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_sha"), F.lit("r").alias("repo_path"))
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("commit_sha"), F.lit("r").alias("repo_path"))
    return ledgers.pending(items, done, ledgers.COMMIT).select("commit_sha")


@registered("SELECT l_orderkey AS session_id, CAST(l_quantity AS BIGINT) AS entries_created FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, CAST(l_quantity AS BIGINT) DESC) = 1")
def ledger_upsert(spark, sf_dir):
    marks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_shipdate").alias("processed_at"), F.col("l_quantity").cast("long").alias("entries_created"))
    return ledgers.current(marks, ledgers.SESSION).select("session_id", "entries_created")


@registered("SELECT o_orderkey AS file_path FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0)")
def ledger_changed_files(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    items = o.select(k.alias("file_path"), F.lit("r").alias("repo_path"), F.sha2(F.when(k % 5 == 0, "new").otherwise("old"), 256).alias("content_hash"))
    done = o.where(k % 3 == 0).select(k.alias("file_path"), F.lit("r").alias("repo_path"), F.sha2(F.lit("old"), 256).alias("content_hash"))
    return ledgers.pending(items, done, ledgers.FILE, content_hash=True).select("file_path")


# Mining


def _messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    block = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), *[F.lit(None).cast("string").alias(n) for n in ("id", "name")], F.lit(None).cast("struct<file_path:string,old_string:string,new_string:string,content:string,command:string>").alias("input"), F.lit(None).cast("array<string>").alias("result"))
    return c.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("seq"), F.col("role").alias("type"), F.concat("conv_id", F.lit("-"), "turn").alias("uuid"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"), F.array(block).alias("blocks"))


_PAIRS = """WITH m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations WHERE role <> 'system'),
p AS (SELECT conv_id, g, min(turn) FILTER (role = 'user') AS first_turn, any_value(text) FILTER (role = 'user') AS user_text, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant' AND text <> '') AS answer
 FROM m WHERE g > 0 GROUP BY conv_id, g HAVING count(*) FILTER (role = 'assistant') > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY g) - 1 AS pair FROM p)"""


@registered(_PAIRS + " SELECT conv_id::VARCHAR AS session_id, CAST(pair AS INT) AS pair, conv_id || '-' || first_turn AS user_uuid, sha256(user_text) AS asked_sha256, sha256(coalesce(answer, '')) AS answer_sha256 FROM n")
def conv_pairs(spark, sf_dir):
    p = sessions.conversation_pairs(_messages(spark, sf_dir))
    return p.select("session_id", "pair", "user_uuid", F.sha2("user_text", 256).alias("asked_sha256"), F.sha2("text", 256).alias("answer_sha256"))


_SUBJECTS = ["fix(auth): minor token bug", "feat: add cache layer", "Update", "Improve the performance of the parser", "wip", "docs: explain", "Merge branch 'x'", "Rename and move helpers", "Bump version"]


def _commits(spark, sf_dir):
    """Orders as commits: their lines are the files they change."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("changes"), F.count("*").alias("files"), F.max(F.col("l_linenumber") == 3).alias("tests"))
    o = table(spark, sf_dir, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"))
    text = F.element_at(F.array(*[F.lit(s) for s in _SUBJECTS]), (F.col("o_orderkey") % len(_SUBJECTS) + 1).cast("int"))
    return o.select("o_orderkey", text.alias("subject"), F.when(F.col("o_orderkey") % 2 == 0, "A body of some length.").otherwise("").alias("body"), "changes", "files", "tests")


_KIND = "CASE o_orderkey % 9 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(["bug_fix", "feature", "general", "performance", "general", "documentation", "general", "refactor", "general"])) + " END"
_COMMITS = f"""WITH f AS (SELECT l_orderkey, sum(CAST(trunc(l_quantity) AS BIGINT)) AS changes, count(*) AS files, max(CAST(l_linenumber = 3 AS INT)) AS tests FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey, {_KIND} AS kind, o_orderkey % 9 IN (0, 1, 5) AS prefixed, o_orderkey % 9 IN (0, 4) AS weak, o_orderkey % 2 = 0 AS body, f.* FROM orders JOIN f ON l_orderkey = o_orderkey)"""


@registered(_COMMITS + " SELECT o_orderkey, kind, o_orderkey % 9 = 6 AS is_merge, o_orderkey % 9 IN (2, 4) AS is_generic FROM c")
def commit_kind(spark, sf_dir):
    message = F.when(F.col("body") != "", F.concat("subject", F.lit("\n\n"), "body")).otherwise(F.col("subject"))
    return _commits(spark, sf_dir).select("o_orderkey", commits.kind(message).alias("kind"), commits.is_merge(F.col("subject")).alias("is_merge"), commits.is_generic(F.col("subject")).alias("is_generic"))


@registered(_COMMITS + """ SELECT o_orderkey, CAST(30 + CASE WHEN kind <> 'general' THEN 15 ELSE 0 END + CASE WHEN prefixed THEN 5 ELSE 0 END + CASE WHEN body THEN 10 ELSE 0 END + CASE WHEN changes < 100 AND files < 5 THEN 10 ELSE 0 END
 - CASE WHEN changes > 500 OR files > 10 THEN 15 ELSE 0 END + CASE WHEN tests = 1 THEN 10 ELSE 0 END - CASE WHEN weak THEN 10 ELSE 0 END AS INT) AS hundredths FROM c""")
def commit_confidence(spark, sf_dir):
    c = _commits(spark, sf_dir)
    kind = commits.kind(F.when(F.col("body") != "", F.concat("subject", F.lit("\n\n"), "body")).otherwise(F.col("subject")))
    return c.select("o_orderkey", commits.confidence(kind, F.col("subject"), F.col("body"), F.col("changes"), F.col("files"), F.col("tests")).alias("hundredths"))


# Scalars


@registered("SELECT doc_id AS id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(CASE WHEN instr(reverse(text[1:200]), ' ') > 0 AND 200 - instr(reverse(text[1:200]), ' ') > 100 THEN text[1:(200 - instr(reverse(text[1:200]), ' '))] ELSE text[1:200] END, '\\s+$', '') || '...' END AS brief FROM documents")
def brief_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), S.brief(F.col("text")).alias("brief"))


@registered("SELECT doc_id AS id, length(text) // 4 AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), S.token_estimate(F.col("text")).alias("tokens"))


@registered(_with(f"SELECT id, sha256(title || chr(10) || description || chr(10) || content) AS content_hash, sha256(title || {kb.ISO.format('created')})[1:12] AS entry_id, sha256(content)[1:16] AS file_hash FROM kb"))
def content_hash(spark, sf_dir):
    e = kb.entries(spark, sf_dir)
    return e.select("id", S.content_hash(F.col("title"), F.col("description"), F.col("content")).alias("content_hash"), S.entry_id(F.col("title"), S.iso(F.col("created"))).alias("entry_id"), S.file_hash(F.col("content")).alias("file_hash"))


@registered("SELECT doc_id AS id, array_to_string(list_filter(list_transform(string_split(' ' || upper(lang) || ' ,, ' || source || ',A b', ','), lambda x: lower(trim(x))), lambda x: x <> ''), '|') AS tags FROM documents")
def parse_tags(spark, sf_dir):
    text = F.concat(F.lit(" "), F.upper("lang"), F.lit(" ,, "), "source", F.lit(",A b"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array_join(S.parse_tags(text), "|").alias("tags"))


@registered("SELECT doc_id AS id, trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[^\\p{L}\\p{N}_\\s.,!?;:\\-()]', ' ', 'g')) AS clean FROM documents")
def sanitize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), S.sanitized(F.col("text")).alias("clean"))


@registered("SELECT page_id AS id, CASE page_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'cpp' WHEN 3 THEN 'bash' END AS language, page_id % 7 = 0 OR contains(lower(url), 'test') OR contains(lower(url), 'spec') AS is_test FROM pages")
def lang_by_ext(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".py", ".TSX", ".hpp", ".zsh", ".xyz")]), (F.col("page_id") % 5 + 1).cast("int"))
    path = F.concat(F.when(F.col("page_id") % 7 == 0, "tests/").otherwise("src/"), F.regexp_replace("url", r"\.", "_"), F.lit("_f"), ext)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), S.language_of_path(path).alias("language"), S.is_test_path(path).alias("is_test"))


# Usage, in batch and as a stream


@registered("SELECT user_id AS id, count(*) AS usage_count, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_used FROM events WHERE event_type = 'view' GROUP BY 1")
def usage_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("id"), "ts")
    return e.groupBy("id").agg(F.count("*").alias("usage_count"), F.max("ts").alias("last_used")).select("id", "usage_count", _time("last_used"))


@registered("SELECT user_id AS id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL")
def usage_stream_daily(spark, sf_dir):
    return streams.run_once(spark, f"{sf_dir}/events.parquet", streams.daily_usage, "update", ("id", "day"))


@registered("SELECT user_id AS id, event_type AS kind FROM events GROUP BY ALL")
def stream_first_seen(spark, sf_dir):
    return streams.run_once(spark, f"{sf_dir}/events.parquet", streams.first_seen)

