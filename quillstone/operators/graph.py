"""Relationships between entries, and collections of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import scalars as S
from quillstone.tables import durable

TYPES = ("related", "depends-on", "supersedes")
DEPTH, MOST_DEPTH = 3, 10
MAX_NAME, MAX_ABOUT = 200, 2_000


def normalized(edges: DataFrame) -> DataFrame:
    """Edges (source_id, target_id, relationship_type, ...) of known types between two entries; related ones point upwards."""
    swap = (F.col("relationship_type") == "related") & (F.col("source_id") > F.col("target_id"))
    kept = edges.where(F.col("relationship_type").isin(*TYPES) & (F.col("source_id") != F.col("target_id")))
    return kept.withColumns({"source_id": F.when(swap, F.col("target_id")).otherwise(F.col("source_id")), "target_id": F.when(swap, F.col("source_id")).otherwise(F.col("target_id"))})


def link(edges: DataFrame, wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """The edges of wanted that are new: both ends exist, and no such edge does."""
    ids = entries.select("id")
    new = normalized(wanted).dropDuplicates(["source_id", "target_id", "relationship_type"])
    new = new.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return new.join(edges, ["source_id", "target_id", "relationship_type"], "left_anti")


def unlink(edges: DataFrame, a, b, kind: str | None = None) -> DataFrame:
    """The edges that stay when those between a and b go, in both directions or, with a kind, in its own."""
    forth = (F.col("source_id") == a) & (F.col("target_id") == b)
    back = (F.col("source_id") == b) & (F.col("target_id") == a)
    gone = forth | back if kind in (None, "related") else forth
    return edges.where(~(gone & (F.col("relationship_type") == kind)) if kind else ~gone)


def related(edges: DataFrame, entries: DataFrame, ids: DataFrame, kind: str | None = None, direction: str = "both") -> DataFrame:
    """Edges of the entries in ids (id) with the other end's title: (id, other_id, relationship_type, direction, title)."""
    chosen = edges.where(F.col("relationship_type") == kind) if kind else edges
    way = lambda here, there, name: chosen.select(
        F.col(here).alias("id"), F.col(there).alias("other_id"), "relationship_type", F.lit(name).alias("direction")
    )
    ways = {"outgoing": way("source_id", "target_id", "outgoing"), "incoming": way("target_id", "source_id", "incoming")}
    found = ways["outgoing"].unionByName(ways["incoming"]) if direction == "both" else ways[direction]
    return found.join(ids.select("id"), "id", "left_semi").join(entries.select(F.col("id").alias("other_id"), "title"), "other_id", "left")


def between_entries(edges: DataFrame, entry_id) -> DataFrame:
    """All edges that an entry is an end of."""
    return edges.where((F.col("source_id") == entry_id) | (F.col("target_id") == entry_id))


def get_relationship(edges: DataFrame, edge_id) -> DataFrame:
    return edges.where(F.col("id") == edge_id).limit(1)


def dependency_tree(spark: SparkSession, edges: DataFrame, root, depth: int = DEPTH, entries: DataFrame | None = None) -> DataFrame:
    """(id, parent, level, path, circular): what root depends on, by paths. An entry that is on its path already is a leaf
    marked circular; one on several paths appears on each. Ids may be of any type. With entries, a root that isn't among
    them has no tree. A level joins the paths that the last one found to their next edges and is written as a table, so
    plans stay small and no level is worked out twice."""
    depth = max(1, min(MOST_DEPTH, depth))
    kind = edges.schema["source_id"].dataType.simpleString()
    depends = edges.where("relationship_type = 'depends-on'").select(F.col("source_id").alias("id"), F.col("target_id").cast(kind).alias("next"))
    start = spark.range(1) if entries is None else entries.where(F.col("id") == root).limit(1)
    own = F.lit(root).cast(kind)
    levels = [durable(start.select(own.alias("id"), F.lit(None).cast(kind).alias("parent"), F.lit(0).alias("level"), F.array(own).alias("path"), F.lit(False).alias("circular")))]
    while len(levels) <= depth:
        paths = levels[-1].where("not circular").select("id", "path").join(depends, "id")
        found = durable(paths.select(F.col("next").alias("id"), F.col("id").alias("parent"), F.lit(len(levels)).alias("level"), F.array_append("path", F.col("next")).alias("path"), F.array_contains("path", F.col("next")).alias("circular")))
        if found.isEmpty():
            break
        levels.append(found)
    return reduce(DataFrame.unionByName, levels)


def valid_collections(collections: DataFrame) -> DataFrame:
    """Named and described within the limits; the first of a name counts."""
    kept = collections.withColumn("name", S.stripped(F.col("name"))).where(
        (F.length("name").between(1, MAX_NAME)) & (F.length(F.coalesce("description", F.lit(""))) <= MAX_ABOUT)
    )
    first = kept.groupBy("name").agg(F.min_by("id", F.struct("created", "id")).alias("id"))
    return kept.join(first, ["name", "id"], "left_semi").select(collections.columns)


def list_collections(collections: DataFrame, members: DataFrame, limit: int | None = 50) -> DataFrame:
    """Collections with their number of members, by name."""
    counts = members.groupBy(F.col("collection_id").alias("id")).agg(F.count("entry_id").alias("n"))
    found = collections.join(counts, "id", "left").withColumn("member_count", F.coalesce("n", F.lit(0)).cast("long")).drop("n").orderBy("name", "id")
    return found.limit(limit) if limit is not None else found


def get_collection(collections: DataFrame, id_or_name) -> DataFrame:
    return collections.where((F.col("id").cast("string") == str(id_or_name)) | (F.col("name") == str(id_or_name))).limit(1)


def members(entries: DataFrame, membership: DataFrame, collection_id) -> DataFrame:
    """The latest added first."""
    of = membership.where(F.col("collection_id") == collection_id).select(F.col("entry_id").alias("id"), "added_at")
    return entries.join(of, "id").orderBy(F.desc("added_at"), "id")


def collections_of(collections: DataFrame, membership: DataFrame, entry_id) -> DataFrame:
    of = membership.where(F.col("entry_id") == entry_id).select(F.col("collection_id").alias("id"))
    return collections.join(of, "id").orderBy("name", "id")


def add_members(membership: DataFrame, wanted: DataFrame) -> DataFrame:
    """The new rows of wanted (collection_id, entry_id, added_at)."""
    return wanted.dropDuplicates(["collection_id", "entry_id"]).join(membership, ["collection_id", "entry_id"], "left_anti")


def link_counts(edges: DataFrame, membership: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, relationships, collections) of each entry in ids."""
    ends = edges.select(F.array_distinct(F.array("source_id", "target_id")).alias("e")).select(F.explode("e").alias("id"))
    r = ends.groupBy("id").agg(F.count("*").alias("relationships"))
    c = membership.groupBy(F.col("entry_id").alias("id")).agg(F.count("*").alias("collections"))
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    return ids.select("id").join(r, "id", "left").join(c, "id", "left").select("id", zero("relationships"), zero("collections"))


def cascade(child: DataFrame, deleted: DataFrame, *keys: str) -> DataFrame:
    """A child table's rows whose keys name no deleted entry (id)."""
    for key in keys:
        child = child.join(deleted.select(F.col("id").alias(key)), key, "left_anti")
    return child
