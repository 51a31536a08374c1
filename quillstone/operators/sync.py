"""Three-way reconciliation of two replicas against what was last synchronized."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("last-write-wins", "local-wins", "remote-wins", "manual")


def matched(local: DataFrame, remote: DataFrame, base: DataFrame, tombstones: DataFrame, how: str = "left") -> DataFrame:
    """(id, then of local and of remote: _hash, _updated, in_ and other columns by their names; base_hash, deleted_at). local
    and remote: id, content_hash, updated_at; base: id, content_hash; tombstones: id, deleted_at. how: "left", where base and
    tombstones only add columns, or "full"."""

    def side(df: DataFrame, s: str) -> DataFrame:
        others = [F.col(c).alias(f"{s}_{c}") for c in df.columns if c not in ("id", "content_hash", "updated_at")]
        return df.select("id", F.col("content_hash").alias(f"{s}_hash"), F.col("updated_at").alias(f"{s}_updated"), F.lit(True).alias(f"in_{s}"), *others)

    both = side(local, "local").join(side(remote, "remote"), "id", "full")
    return both.join(base.select("id", F.col("content_hash").alias("base_hash")), "id", how).join(tombstones.select("id", "deleted_at"), "id", how)


def decided(both: DataFrame, asked_local: Column | None = None, asked_remote: Column | None = None) -> DataFrame:
    """both (matched) with action; null for what neither side holds. asked: which of a side's entries count; all, if not given."""
    asked = lambda c: F.lit(True) if c is None else F.coalesce(c, F.lit(False))
    has_local, has_remote = F.col("in_local").isNotNull() & asked(asked_local), F.col("in_remote").isNotNull() & asked(asked_remote)
    local_changed, remote_changed = (~F.col(f"{s}_hash").eqNullSafe(F.col("base_hash")) for s in ("local", "remote"))
    action = (
        F.when(has_local & has_remote & (F.col("local_hash") == F.col("remote_hash")), "no_change")
        .when(has_local & has_remote & local_changed & ~remote_changed, "push")
        .when(has_local & has_remote & remote_changed & ~local_changed, "pull")
        .when(has_local & has_remote, "conflict")
        .when(has_local & (F.col("deleted_at") > F.col("local_updated")), "delete_local").when(has_local, "push")
        .when(has_remote & (F.col("deleted_at") > F.col("remote_updated")), "delete_remote").when(has_remote, "pull")
    )
    return both.withColumn("action", action)


def actions(local: DataFrame, remote: DataFrame, base: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(id, action, local_updated, remote_updated). local and remote: id, content_hash, updated_at; base: id, content_hash;
    tombstones: id, deleted_at. One full outer join; base and tombstones only add columns."""
    lean = lambda df: df.select("id", "content_hash", "updated_at")
    return decided(matched(lean(local), lean(remote), base, tombstones)).select("id", "action", "local_updated", "remote_updated")


def resolved(acts: DataFrame, strategy: str = "last-write-wins") -> DataFrame:
    """Conflicts turned into pushes and pulls; manual leaves them. Of equal times the local one stays."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    choice: Column = {
        "last-write-wins": F.when(F.col("remote_updated") > F.col("local_updated"), "pull").otherwise("push"),
        "local-wins": F.lit("push"), "remote-wins": F.lit("pull"), "manual": F.lit("conflict"),
    }[strategy]
    return acts.withColumn("action", F.when(F.col("action") == "conflict", choice).otherwise(F.col("action")))


def goes(push_only: bool = False, pull_only: bool = False) -> Column:
    """Whether an action is carried out."""
    asked = F.lit(True)
    if push_only:
        asked &= F.col("action").isin("push", "delete_remote")
    if pull_only:
        asked &= F.col("action").isin("pull", "delete_local")
    return asked


def one_way(acts: DataFrame, push_only: bool = False, pull_only: bool = False) -> DataFrame:
    return acts.where(goes(push_only, pull_only))


def counts(acts: DataFrame) -> DataFrame:
    return acts.groupBy("action").agg(F.count("*").alias("n"))


def apply_local(local: DataFrame, remote: DataFrame, acts: DataFrame) -> DataFrame:
    """The local entries after acts: pulled ones from remote, deleted ones gone."""
    pulled = remote.join(acts.where("action = 'pull'").select("id"), "id", "left_semi")
    kept = local.join(acts.where("action in ('pull', 'delete_local')").select("id"), "id", "left_anti")
    return kept.unionByName(pulled.select(local.columns))


def relationships(local: DataFrame, remote: DataFrame, local_ids: DataFrame, remote_ids: DataFrame) -> DataFrame:
    """(source_id, target_id, relationship_type, action): edges are only added, where both their ends exist."""
    key = ["source_id", "target_id", "relationship_type"]
    both = local.select(*key, F.lit(True).alias("in_local")).join(remote.select(*key, F.lit(True).alias("in_remote")), key, "full")

    def exist(df: DataFrame, ids: DataFrame) -> DataFrame:
        for end in ("source_id", "target_id"):
            df = df.join(ids.select(F.col("id").alias(end)), end, "left_semi")
        return df.select(key)

    push = exist(both.where("in_remote is null"), remote_ids).withColumn("action", F.lit("push"))
    return push.unionByName(exist(both.where("in_local is null"), local_ids).withColumn("action", F.lit("pull")))


def collections(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(id, action) of collections (id, updated_at): the later one wins, the local one of equal times."""
    both = local.select("id", F.col("updated_at").alias("l")).join(remote.select("id", F.col("updated_at").alias("r")), "id", "full")
    return both.select("id", F.when(F.col("r").isNull() | (F.col("l") > F.col("r")), "push").when(F.col("l").isNull() | (F.col("r") > F.col("l")), "pull").otherwise("no_change").alias("action"))


def collection_members(remote_members: DataFrame, pulled: DataFrame, local_ids: DataFrame) -> DataFrame:
    """Members of pulled collections, as far as their entries exist here."""
    kept = remote_members.join(pulled.select(F.col("id").alias("collection_id")), "collection_id", "left_semi")
    return kept.join(local_ids.select(F.col("id").alias("entry_id")), "entry_id", "left_semi")
