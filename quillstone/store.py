"""The store: append-only logs of entries, relationships, collections, members and usage, and an engine over them.

A log row is a whole image of its row with seq, op ("upsert" or "delete") and at. The current view is the last row of
each key; history is the log itself. Nothing is updated in place, so a writer that dies leaves the last state intact."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quillstone.functions import scalars as S
from quillstone.operators import graph, ledgers, maintenance, retrieval, search, sync, vector_index, versions
from quillstone.sources import readers
from quillstone.tables import durable

TABLES = {
    "entries": (("id",), readers.ENTRY + ", embedding array<float>"),
    "relationships": (("id",), readers.RELATIONSHIP),
    "collections": (("id",), "id string, name string, description string, created timestamp_ntz, updated_at timestamp_ntz"),
    "members": (("collection_id", "entry_id"), "collection_id string, entry_id string, added_at timestamp_ntz"),
    "versions": (("entry_id", "version_number"), "entry_id string, version_number long, title string, description string, content string, brief string, tags array<string>, context array<string>, confidence double, source string, project string, created_at timestamp_ntz, created_by string, change_summary string"),
    "usage": (("id", "ts"), "id string, ts timestamp_ntz"),
    "synced": (("folder", "id"), "folder string, id string, content_hash string"),
    "processed_sessions": (ledgers.SESSION, "session_id string, project_path string, processed_at timestamp_ntz, entries_created long"),
    "processed_commits": (ledgers.COMMIT, "commit_sha string, repo_path string, processed_at timestamp_ntz, entries_created long"),
    "processed_files": (ledgers.FILE, "file_path string, repo_path string, content_hash string, processed_at timestamp_ntz, entries_created long"),
}
#: Ledgers by what they tell of.
LEDGERS = {"sessions": "processed_sessions", "commits": "processed_commits", "files": "processed_files"}
#: What deals a log's rows to buckets, where it isn't the first column of its key.
_BUCKET_KEYS = {"synced": "id"}
_LOG = ", seq long, op string, at timestamp_ntz"
#: Fields that update() changes; others are ignored.
CHANGEABLE = ("title", "description", "content", "tags", "context", "confidence", "project")
_EMBEDDED = ("title", "description", "content")


class Store:
    """Logs as bucketed Parquet tables below path: a row lies in the bucket of its key's hash, so the last row of each key, and
    joins of logs by that key, need no shuffle. A file beside each log names the folder that holds it, and is replaced at once,
    so readers and writers that die always find a whole log. A lock lets one writer at a time number the rows.

    buckets: of logs that this store begins; the session's shuffle partitions, if not given."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _place(self, name: str) -> dict | None:
        """{folder, buckets, before}: where a log is, in how many buckets (0: none), and where it was before it was compacted."""
        told = readers.read_file(self.spark, f"{self.path}/{name}.at")
        if told is not None:
            return json.loads(told)
        # A log of plain files, as earlier stores have it; compact() makes buckets.
        return {"folder": name, "buckets": 0, "before": None} if readers.exists(self.spark, f"{self.path}/{name}") else None

    def _table(self, name: str, place: dict) -> str:
        """The session's name of the table in a folder."""
        folder = f"{self.path}/{place['folder']}"
        table = f"quillstone_{name}_{hashlib.md5(folder.encode()).hexdigest()[:16]}"
        if not self.spark.catalog.tableExists(table):
            quoted = folder.replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({TABLES[name][1]}{_LOG}) USING parquet CLUSTERED BY ({_BUCKET_KEYS.get(name, TABLES[name][0][0])}) INTO {place['buckets']} BUCKETS LOCATION '{quoted}'")
        return table

    def log(self, name: str) -> DataFrame:
        place = self._place(name)
        schema = TABLES[name][1] + _LOG
        if place is None:
            return self.spark.createDataFrame([], schema)
        if not place["buckets"]:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{place['folder']}")
        table = self._table(name, place)
        self.spark.catalog.refreshTable(table)
        return self.spark.table(table)

    def _last(self, name: str) -> DataFrame:
        """The last row of each key, deletions included."""
        w = Window.partitionBy(*TABLES[name][0]).orderBy(F.desc("seq"))
        return self.log(name).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")

    def current(self, name: str) -> DataFrame:
        """The last row of each key, if it isn't a deletion."""
        return self._last(name).where("op = 'upsert'").drop("seq", "op", "at")

    def _write(self, name: str, place: dict, rows: DataFrame) -> None:
        if place["buckets"]:
            # Rows that are dealt as the buckets are make a file for each bucket that gets any.
            dealt = rows.repartition(place["buckets"], _BUCKET_KEYS.get(name, TABLES[name][0][0]))
            self._once(name, dealt).write.mode("append").insertInto(self._table(name, place))
        else:
            self._once(name, rows).write.mode("append").parquet(f"{self.path}/{place['folder']}")

    @staticmethod
    def _once(name: str, rows: DataFrame) -> DataFrame:
        """Rows with each key once, but for events of use. Rows that are dealt by a part of the key already aren't dealt again."""
        return rows if name == "usage" else rows.dropDuplicates(list(TABLES[name][0]))

    def has(self, name: str) -> bool:
        """Whether a log was begun; of one that wasn't no job needs to ask for rows."""
        return self._place(name) is not None

    def append(self, name: str, rows: DataFrame, op: str | Column = "upsert", at: datetime | None = None) -> None:
        """Rows of one append share a number, so a key counts once in it, but for events of use. op: of all rows, or a column
        of them."""
        fields, given = StructType.fromDDL(TABLES[name][1]).fields, rows.columns
        filled = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        with readers.locked(self.spark, self.path) as lock:
            place = self._place(name)
            if place is None:
                place = {"folder": f"{name}-{uuid.uuid4().hex[:8]}", "buckets": self.buckets, "before": None}
                seq = self._next(name, begun=False)
                readers.write_file(self.spark, f"{self.path}/{name}.at", [json.dumps(place)])
            else:
                seq = self._next(name)
            lock.check()
            self._write(name, place, rows.select(*filled, F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), F.lit(at or datetime.now()).cast("timestamp_ntz").alias("at")))

    def _next(self, name: str, begun: bool = True) -> int:
        """The number of the next append, kept in a file before the rows are written, so that none is used twice. begun: the
        log is there, so without that file its rows tell."""
        path = f"{self.path}/{name}.seq"
        told = readers.read_file(self.spark, path)
        last = int(told) if told is not None else (begun and self.log(name).agg(F.max("seq")).first()[0]) or 0
        readers.write_file(self.spark, path, [str(last + 1)])
        return last + 1

    def compact(self, name: str) -> None:
        """Rewrites a log as the last row of each key, deletions included, so that reads rank no more than these. Events of
        use stay as they are. The log before the last compaction is removed, the one before this stays for those who read it."""
        if name == "usage":
            return
        with readers.locked(self.spark, self.path) as lock:
            old = self._place(name)
            if old is None:
                return
            fresh = {"folder": f"{name}-{uuid.uuid4().hex[:8]}", "buckets": old["buckets"] or self.buckets, "before": old["folder"]}
            self._write(name, fresh, self._last(name))
            lock.check()
            readers.write_file(self.spark, f"{self.path}/{name}.at", [json.dumps(fresh)])
            if old["before"]:
                p, files = readers._path(self.spark, f"{self.path}/{old['before']}")
                files.delete(p, True)


class Engine:
    """What a user of a knowledge base calls. Reads give DataFrames; writes append log rows."""

    def __init__(self, spark: SparkSession, path: str, embed=readers.embedded, now=datetime.now):
        self.spark, self.store, self.embed, self.now = spark, Store(spark, path), embed, now

    # Entries

    def entries(self) -> DataFrame:
        """Current entries, their use counted from usage events."""
        return retrieval.with_usage(self.store.current("entries"), self.store.log("usage").select("id", "ts"))

    def capture(self, title: str, description: str, content: str, *, tags=None, context=None, project: str | None = None, source: str = "user", confidence: float = 1.0) -> str:
        return self.capture_all(self.spark.createDataFrame(
            [(title, description, content, _tags(tags), _tags(context), project, source, float(confidence))],
            "title string, description string, content string, tags array<string>, context array<string>, project string, source string, confidence double",
        )).first()["id"]

    def capture_all(self, rows: DataFrame) -> DataFrame:
        """Appends entries that are valid; raises if one isn't, or if rows that bring ids bring one twice. Returns (id, title).
        Every row becomes an entry of its own, whatever its text: the first has an id of its title and the time, and the
        others of a batch have longer ones, of their place in it too."""
        now = self.now()
        at = F.lit(now).cast("timestamp_ntz")
        # Places are written down once, so that an executor that is lost doesn't change them.
        made = durable(rows.withColumn("_place", F.monotonically_increasing_id())).withColumns({"created": at, "updated_at": at, "last_used": F.lit(None).cast("timestamp_ntz"), "usage_count": F.lit(0).cast("long"), "brief": S.brief(F.col("content"))})
        wrong = made.where(~F.coalesce(readers.valid(made), F.lit(False)))
        if not wrong.isEmpty():
            raise ValueError("an entry needs a title, description and content within their limits, and a confidence from 0 to 1")
        if "id" not in rows.columns:
            of_place = F.sha2(F.concat_ws("\n", F.col("title"), S.iso(F.col("created")), F.col("_place").cast("string")), 256)
            made = made.withColumn("id", F.when(F.col("_place") == 0, S.entry_id(F.col("title"), S.iso(F.col("created")))).otherwise(F.substring(of_place, 1, 32)))
        elif not made.groupBy("id").count().where("count > 1 or id is null").isEmpty():
            raise ValueError("each row needs an id of its own")
        made = durable(self.embed(made.drop("_place")))
        if "id" not in rows.columns and not made.limit(2).count() > 1:
            self._refuse_known(made)
        self.store.append("entries", made, at=now)
        self._indexed(made)
        return made.select("id", "title")

    def _refuse_known(self, made: DataFrame) -> None:
        """One title captured twice at one time would take the place of the first entry."""
        if not self.store.current("entries").join(made.select("id"), "id", "left_semi").isEmpty():
            raise ValueError("there is an entry of this title and time")

    # The index of vectors

    def build_index(self) -> vector_index.VectorIndex:
        """A stored index of all current vectors; entries captured or updated later are added to it."""
        current = self.store.current("entries").select("id", "embedding", "project")
        name = f"index-{uuid.uuid4().hex[:8]}"
        made = vector_index.build(current, f"{self.store.path}/{name}")
        readers.write_file(self.spark, f"{self.store.path}/index.at", [name])
        return made

    def index(self) -> vector_index.VectorIndex | None:
        name = readers.read_file(self.spark, f"{self.store.path}/index.at")
        return vector_index.VectorIndex(self.spark, f"{self.store.path}/{name}") if name else None

    def _indexed(self, entries: DataFrame) -> None:
        index = self.index()
        if index is not None:
            index.add(entries.select("id", "embedding", "project" if "project" in entries.columns else F.lit(None).cast("string").alias("project")))

    def get(self, entry_id: str) -> DataFrame:
        return search.get(self.entries(), entry_id)

    def update(self, entry_id: str, create_version: bool = True, by: str = "user", summary: str | None = None, **changes) -> bool:
        """False if there is no such entry. The old image becomes a version first; vectors follow the text."""
        now, old = self.now(), self.store.current("entries").where(F.col("id") == entry_id)
        if old.isEmpty():
            return False
        changes = {k: v for k, v in changes.items() if k in CHANGEABLE and v is not None}
        if not changes:
            return True
        if create_version:
            self._snapshot(entry_id, by, summary)
        new = old.withColumns({k: F.lit(_tags(v) if k in ("tags", "context") else v) for k, v in changes.items()}).withColumn("updated_at", F.lit(now).cast("timestamp_ntz"))
        if set(changes) & set(_EMBEDDED):
            new = self.embed(new.drop("embedding")).withColumn("brief", S.brief(F.col("content")))
        new = durable(new)
        self.store.append("entries", new, at=now)
        self._indexed(new)
        return True

    def delete(self, entry_id: str) -> bool:
        """With its relationships, memberships and versions. The deletion's log row is its tombstone."""
        found = self.store.current("entries").where(F.col("id") == entry_id)
        if found.isEmpty():
            return False
        self._delete(found)
        return True

    def _delete(self, found: DataFrame) -> None:
        """found: entries, one at least."""
        now, ids = self.now(), found.select("id")
        edges, members, past = (self.store.current(n) for n in ("relationships", "members", "versions"))
        ends = edges.select("id", F.explode(F.array("source_id", "target_id")).alias("x"))
        gone = edges.join(ends.join(ids.select(F.col("id").alias("x")), "x", "left_semi").select("id").distinct(), "id", "left_semi")
        for name, rows in (("relationships", gone), ("members", members.join(ids.select(F.col("id").alias("entry_id")), "entry_id", "left_semi")), ("versions", past.join(ids.select(F.col("id").alias("entry_id")), "entry_id", "left_semi"))):
            if self.store.has(name) and not rows.isEmpty():
                self.store.append(name, rows, "delete", now)
        self.store.append("entries", found, "delete", now)

    def purge(self, project: str | None = None) -> int:
        found = search.in_project(self.store.current("entries"), project)
        n = found.count()
        if n:
            self._delete(found)
        return n

    def retrieve(self, query: str, indexed: bool = False, **options) -> DataFrame:
        """Retrieves by meaning, and records the use of what it found. indexed: candidates come from the index, if one was
        built."""
        asked = self.embed(self.spark.createDataFrame([(query, "", "")], "title string, description string, content string"))
        vector = [float(x) for x in asked.first()["embedding"]]
        current = self.entries()
        found = retrieval.retrieve(current.drop("embedding"), current.select("id", "embedding"), vector, index=self.index() if indexed else None, **options)
        rows = found.collect()
        result = self.spark.createDataFrame(rows, found.schema)
        if rows:
            self.store.append("usage", retrieval.usage(result, self.now()))
        return result

    def list(self, **options) -> DataFrame:
        return search.list_entries(self.entries(), **options)

    def search(self, text: str, **options) -> DataFrame:
        return search.search_entries(self.entries(), text, **options)

    def projects(self) -> DataFrame:
        return search.projects(self.entries())

    def stats(self) -> dict[str, DataFrame]:
        return maintenance.stats(self.entries())

    def stale(self, days: int = 90, project: str | None = None) -> DataFrame:
        return maintenance.stale(self.entries(), self.now(), days, project)

    def quality(self, low: int | None = None, high: int | None = None, project: str | None = None) -> DataFrame:
        return maintenance.quality(self.entries(), low, high, project)

    def duplicates(self, threshold: float = 0.85) -> DataFrame:
        """(leader, member, similarity)."""
        current = self.entries().withColumn("n", F.xxhash64("id"))
        named = current.select(F.col("n").alias("id"), "embedding", "created", "last_used")
        groups = maintenance.similar_groups(named, named, threshold)
        names = current.select("n", "id")
        return groups.join(names.select(F.col("n").alias("leader"), F.col("id").alias("a")), "leader").join(names.select(F.col("n").alias("member"), F.col("id").alias("b")), "member").select(F.col("a").alias("leader"), F.col("b").alias("member"), "similarity")

    def merge(self, target: str, source: str, delete_source: bool = True) -> bool:
        current = self.entries()
        found = maintenance.merge(current, self.spark.createDataFrame([(target, source)], "target string, source string"))
        if found.isEmpty():
            return False
        row = found.first()
        self.update(target, by="merge", summary=f"Merged with {source}", content=row["content"], tags=row["tags"], context=row["context"])
        # The source's uses become the target's: an event for each.
        used = current.where((F.col("id") == source) & (F.col("usage_count") > 0)).select(F.explode(F.expr("sequence(1L, usage_count)")), F.coalesce("last_used", "created").alias("ts"))
        if not used.isEmpty():
            self.store.append("usage", used.select(F.lit(target).alias("id"), "ts"))
        return self.delete(source) if delete_source else True

    def export(self, path: str, project: str | None = None) -> None:
        readers.export(self.entries().drop("embedding"), path, project)

    def import_from(self, path: str, skip_duplicates: bool = True) -> dict[str, int]:
        """From JSON lines or a JSON list. Ids, tags and times come back as they were written."""
        return self.import_rows(readers.read_export(self.spark, path), skip_duplicates)

    def import_rows(self, rows: DataFrame, skip_duplicates: bool = True) -> dict[str, int]:
        """Rows of one id count once (readers.classified tells which); those without one are entries of their own. What an
        entry doesn't tell is filled in."""
        now = F.lit(self.now()).cast("timestamp_ntz")
        filled = durable(rows.withColumn("_place", F.monotonically_increasing_id())).withColumn("created", F.coalesce("created", now))
        of_place = F.sha2(F.concat_ws("\n", F.coalesce("title", F.lit("")), S.iso(now), F.col("_place").cast("string")), 256)
        filled = filled.withColumns({
            "id": F.coalesce("id", F.substring(of_place, 1, 32)), "updated_at": F.coalesce("updated_at", "created"),
            "brief": F.coalesce("brief", S.brief(F.col("content"))), "usage_count": F.coalesce("usage_count", F.lit(0)).cast("long"),
            "confidence": F.coalesce("confidence", F.lit(1.0)), "source": F.coalesce("source", F.lit("import")),
            **{c: F.coalesce(c, F.array().cast("array<string>")) for c in ("tags", "context")},
        })
        told = durable(readers.classified(filled.drop("_place"), self.store.current("entries"), skip_duplicates))
        counts = {r["outcome"]: r["count"] for r in told.groupBy("outcome").count().collect()}
        new = told.where("outcome = 'imported'").drop("outcome")
        if counts.get("imported"):
            self.store.append("entries", self.embed(new), at=self.now())
        return {k: counts.get(v, 0) for k, v in (("imported", "imported"), ("skipped", "skipped"), ("errors", "error"))}

    # Versions

    def _snapshot(self, entry_id: str, by: str, summary: str | None) -> None:
        self._snapshots(self.store.current("entries").where(F.col("id") == entry_id), by, summary)

    def _snapshots(self, old: DataFrame, by: str, summary: str | None) -> None:
        """The images of entries as their next versions."""
        now, images = self.now(), old.withColumnRenamed("id", "entry_id")
        last = self.store.log("versions").groupBy("entry_id").agg(F.max("version_number").alias("last"))
        images = images.join(last, "entry_id", "left").withColumns({
            "version_number": F.coalesce("last", F.lit(0)) + 1, "created_at": F.lit(now).cast("timestamp_ntz"), "created_by": F.lit(by), "change_summary": F.lit(summary),
        })
        self.store.append("versions", images, at=now)

    def history(self, entry_id: str, limit: int | None = None) -> DataFrame:
        return versions.history(versions.pruned(self.store.current("versions"), "entry_id"), "entry_id", entry_id, limit)

    def rollback(self, entry_id: str, version: int, by: str = "user") -> bool:
        past = self.store.current("versions").where(F.col("entry_id") == entry_id)
        if past.where(F.col("version_number") == version).isEmpty():
            return False
        self._snapshot(entry_id, by, f"Before rollback to version {version}")
        now, current = self.now(), self.store.current("entries").where(F.col("id") == entry_id).withColumnRenamed("id", "entry_id")
        back = versions.rolled_back(current, past, "entry_id", version).withColumnRenamed("entry_id", "id").withColumn("updated_at", F.lit(now).cast("timestamp_ntz"))
        self.store.append("entries", self.embed(back.drop("embedding")), at=now)
        return True

    def diff(self, entry_id: str, a: int, b: int | None = None) -> DataFrame:
        """Between two versions, or a version and the current image (as version 0)."""
        past = self.store.current("versions").where(F.col("entry_id") == entry_id)
        fields = ["title", "description", "content", "tags", "project", "confidence"]
        images = past.select("entry_id", "version_number", *fields)
        if b is None:
            now = self.store.current("entries").where(F.col("id") == entry_id).select(F.col("id").alias("entry_id"), F.lit(0).cast("long").alias("version_number"), *fields)
            images, b = images.unionByName(now), 0
        if images.where(F.col("version_number").isin(a, b)).select("version_number").distinct().count() < 2:
            raise ValueError("no such version")
        return versions.diff(images, "entry_id", a, b, fields[:3], fields[3:])

    # Relationships and collections

    def link(self, source: str, target: str, kind: str = "related", metadata: dict | None = None) -> bool:
        """True if the relationship is new."""
        if kind not in graph.TYPES or source == target:
            raise ValueError("a relationship has a known type and two entries")
        now = self.now()
        wanted = self.spark.createDataFrame([(source, target, kind, metadata or {})], "source_id string, target_id string, relationship_type string, metadata map<string,string>")
        new = graph.link(self.store.current("relationships").select("source_id", "target_id", "relationship_type"), wanted, self.store.current("entries"))
        new = new.withColumns({"id": F.substring(F.sha2(F.concat_ws("|", "source_id", "target_id", "relationship_type"), 256), 1, 12), "created": F.lit(now).cast("timestamp_ntz")})
        if new.isEmpty():
            return False
        self.store.append("relationships", new, at=now)
        return True

    def unlink(self, a: str, b: str, kind: str | None = None) -> int:
        edges = self.store.current("relationships")
        gone = edges.join(graph.unlink(edges, a, b, kind), "id", "left_anti")
        n = gone.count()
        if n:
            self.store.append("relationships", gone, "delete", self.now())
        return n

    def related(self, entry_id: str, kind: str | None = None, direction: str = "both") -> DataFrame:
        ids = self.spark.createDataFrame([(entry_id,)], "id string")
        return graph.related(self.store.current("relationships"), self.store.current("entries"), ids, kind, direction)

    def relationships_of(self, entry_id: str) -> DataFrame:
        return graph.between_entries(self.store.current("relationships"), entry_id)

    def relationship(self, edge_id: str) -> DataFrame:
        return graph.get_relationship(self.store.current("relationships"), edge_id)

    def dependency_tree(self, entry_id: str, depth: int = graph.DEPTH) -> DataFrame:
        """(id, parent, level, path, circular, title); no rows if there is no such entry."""
        current = self.store.current("entries").select("id", "title")
        return graph.dependency_tree(self.spark, self.store.current("relationships"), entry_id, depth, current).join(current, "id", "left")

    def link_counts(self) -> DataFrame:
        return graph.link_counts(self.store.current("relationships"), self.store.current("members"), self.store.current("entries"))

    def create_collection(self, name: str, description: str = "") -> str:
        now = self.now()
        if not 0 < len(name.strip()) <= graph.MAX_NAME or len(description) > graph.MAX_ABOUT or not self.store.current("collections").where(F.col("name") == name.strip()).isEmpty():
            raise ValueError("a collection needs a new name within its limits")
        row = self.spark.createDataFrame([(name.strip(), description, now, now)], "name string, description string, created timestamp_ntz, updated_at timestamp_ntz")
        row = row.withColumn("id", S.entry_id(F.col("name"), S.iso(F.col("created"))))
        self.store.append("collections", row, at=now)
        return row.first()["id"]

    def collection(self, id_or_name: str) -> DataFrame:
        return graph.get_collection(self.collections(None), id_or_name)

    def update_collection(self, collection_id: str, name: str | None = None, description: str | None = None) -> bool:
        """False if there is no such collection; raises for a name or description that create_collection wouldn't take."""
        current, now = self.store.current("collections"), self.now()
        found = current.where(F.col("id") == collection_id)
        if found.isEmpty():
            return False
        if name is not None:
            name = name.strip()
            if not 0 < len(name) <= graph.MAX_NAME or not current.where((F.col("name") == name) & (F.col("id") != collection_id)).isEmpty():
                raise ValueError("a collection needs a new name within its limits")
            found = found.withColumn("name", F.lit(name))
        if description is not None:
            if len(description) > graph.MAX_ABOUT:
                raise ValueError("a collection's description has a limit")
            found = found.withColumn("description", F.lit(description))
        self.store.append("collections", found.withColumn("updated_at", F.lit(now).cast("timestamp_ntz")), at=now)
        return True

    def _touch(self, collection_id: str, now: datetime) -> None:
        self.store.append("collections", self.store.current("collections").where(F.col("id") == collection_id).withColumn("updated_at", F.lit(now).cast("timestamp_ntz")), at=now)

    def delete_collection(self, collection_id: str) -> bool:
        found = self.store.current("collections").where(F.col("id") == collection_id)
        if found.isEmpty():
            return False
        self.store.append("members", self.store.current("members").where(F.col("collection_id") == collection_id), "delete", self.now())
        self.store.append("collections", found, "delete", self.now())
        return True

    def add_to_collection(self, collection_id: str, entry_id: str) -> bool:
        now = self.now()
        wanted = self.spark.createDataFrame([(collection_id, entry_id, now)], "collection_id string, entry_id string, added_at timestamp_ntz")
        wanted = wanted.join(self.store.current("entries").select(F.col("id").alias("entry_id")), "entry_id", "left_semi")
        new = graph.add_members(self.store.current("members"), wanted)
        if new.isEmpty():
            return False
        self.store.append("members", new, at=now)
        self._touch(collection_id, now)
        return True

    def remove_from_collection(self, collection_id: str, entry_id: str) -> bool:
        found = self.store.current("members").where((F.col("collection_id") == collection_id) & (F.col("entry_id") == entry_id))
        if found.isEmpty():
            return False
        now = self.now()
        self.store.append("members", found, "delete", now)
        self._touch(collection_id, now)
        return True

    def collections_of(self, entry_id: str) -> DataFrame:
        return graph.collections_of(self.store.current("collections"), self.store.current("members"), entry_id)

    def collections(self, limit: int | None = 50) -> DataFrame:
        return graph.list_collections(self.store.current("collections"), self.store.current("members"), limit)

    def collection_members(self, collection_id: str) -> DataFrame:
        return graph.members(self.store.current("entries"), self.store.current("members"), collection_id)

    # Ledgers

    def pending(self, kind: str, items: DataFrame) -> DataFrame:
        """Items (the ledger's key, for files also content_hash) that aren't processed as they are."""
        name = LEDGERS[kind]
        return ledgers.pending(items, self.store.current(name), TABLES[name][0], "content_hash" in items.columns)

    def mark(self, kind: str, items: DataFrame, created: DataFrame) -> None:
        """Marks items as processed; created has the key of an item for each entry made of it."""
        name, now = LEDGERS[kind], self.now()
        self.store.append(name, ledgers.marks(items, TABLES[name][0], created, now), at=now)

    def processed(self, kind: str) -> DataFrame:
        """What was processed, the latest first."""
        return self.store.current(LEDGERS[kind]).orderBy(F.desc("processed_at"), *TABLES[LEDGERS[kind]][0])

    def is_processed(self, kind: str, *key: str, content_hash: str | None = None) -> bool:
        found = self.store.current(LEDGERS[kind])
        for column, value in zip(TABLES[LEDGERS[kind]][0], key, strict=True):
            found = found.where(F.col(column) == value)
        return not (found.where(F.col("content_hash") == content_hash) if content_hash is not None else found).isEmpty()

    # Replicas

    def tombstones(self) -> DataFrame:
        log = self.store.log("entries")
        return log.groupBy("id").agg(F.max_by("op", "seq").alias("op"), F.max("at").alias("deleted_at")).where("op = 'delete'").select("id", "deleted_at")

    def sync_path(self, folder: str | None = None) -> str:
        """The folder given, which is kept for the next time, or the one kept."""
        path = f"{self.store.path}/config.json"
        if folder is None:
            found = self.spark.read.schema("sync_path string").option("multiLine", "true").json(path).first() if readers.exists(self.spark, path) else None
            if found is None or not found["sync_path"]:
                raise ValueError("no folder to synchronize with is known")
            return found["sync_path"]
        readers.write_file(self.spark, path, [json.dumps({"sync_path": folder})])
        return folder

    def _sides(self, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Local entries, remote entries, and deletions that either side tells of."""
        local = readers.with_hash(self.store.current("entries"))
        remote = readers.with_hash(readers.replica(self.spark, folder, "entries", readers.ENTRY + ", content_hash string"))
        told = self.tombstones().unionByName(readers.replica_tombstones(self.spark, folder))
        return local, remote, told.groupBy("id").agg(F.max("deleted_at").alias("deleted_at"))

    def sync_status(self, folder: str | None = None, project: str | None = None) -> DataFrame:
        """(id, action) that a synchronization has before it, against the folder's manifest; nothing is changed."""
        folder = folder or self.sync_path()
        if not readers.exists(self.spark, folder):
            raise ValueError("there is no such folder")
        local, remote, told = self._sides(folder)
        return sync.actions(search.in_project(local, project), search.in_project(remote, project), readers.manifest(self.spark, folder), told).select("id", "action").where("action <> 'no_change'")

    def sync(self, folder: str | None = None, base: DataFrame | None = None, strategy: str = "last-write-wins", *, push_only: bool = False, pull_only: bool = False, dry_run: bool = False, project: str | None = None) -> DataFrame:
        """Actions (id, action) on entries against a replica folder, carried out unless dry_run, relationships and
        collections with them. base (id, content_hash) is what this store last synchronized with the folder, unless given.
        Afterwards the base of an entry is its hash where both sides have that; other entries keep the base they had.
        Deletions go into the folder, so that other replicas hear of them."""
        folder = self.sync_path(folder)
        with readers.locked(self.spark, folder):
            return self._synced(folder, base, strategy, push_only, pull_only, dry_run, project)

    def _synced(self, folder: str, base: DataFrame | None, strategy: str, push_only: bool, pull_only: bool, dry_run: bool, project: str | None) -> DataFrame:
        now, known = self.now(), self.store.current("synced").where(F.col("folder") == folder).select("id", "content_hash")
        local, remote, told = self._sides(folder)
        # The folder's files are opened once for all that follows. What an entry's own text hashes to is what it will have here.
        remote = durable(remote.withColumn("own_hash", S.content_hash(F.col("title"), F.col("description"), F.col("content"))))
        at = ("id", "content_hash", "updated_at", "project")
        both = sync.matched(local.select(*at), remote.select(*at, "own_hash"), known if base is None else base, told, "full")
        both = both.withColumn("known_hash", F.col("base_hash")) if base is None else both.join(known.withColumnRenamed("content_hash", "known_hash"), "id", "full")
        asked = [F.col(f"{s}_project") == project for s in ("local", "remote")] if project else []
        both = sync.resolved(sync.decided(both, *asked), strategy)
        # No action for what isn't asked for: of another project, or the other way.
        both = durable(both.withColumn("action", F.when(sync.goes(push_only, pull_only), F.col("action"))))
        acts = both.where("action is not null").select("id", "action")
        if dry_run:
            return acts
        # How many of each action, and how many of these are here; what none asks for starts no job.
        n = {(r["action"], r["here"]): r["count"] for r in both.groupBy("action", F.col("in_local").isNotNull().alias("here")).count().collect()}
        any_of = lambda action: (action, True) in n or (action, False) in n
        some = lambda action: both.where(F.col("action") == action).select("id")
        # The folder's changes come from this store as it is, and this store's from what was read of the folder.
        gone = durable(local.join(some("delete_local"), "id", "left_semi")) if any_of("delete_local") else None
        readers.make_folder(self.spark, f"{folder}/entries")
        if any_of("push"):
            readers.write_replica(local.join(some("push"), "id", "left_semi").select(remote.drop("own_hash").columns), folder, "entries")
        if any_of("delete_remote"):
            readers.remove_replica(some("delete_remote"), folder, "entries")
        if any_of("pull"):
            if ("pull", True) in n:
                # An entry that is here already keeps the image it had as a version.
                self._snapshots(self.store.current("entries").join(some("pull"), "id", "left_semi"), "sync", "Before synchronization")
            self.store.append("entries", self.embed(remote.join(some("pull"), "id", "left_semi").drop("content_hash", "own_hash")), at=now)
        if gone is not None:
            self._delete(gone)
        if not pull_only:
            dead = both.where("deleted_at is not null").select("id", "deleted_at")
            if gone is not None:
                dead = dead.unionByName(self.tombstones()).groupBy("id").agg(F.max("deleted_at").alias("deleted_at"))
            readers.write_tombstones(dead, folder)
        # The hashes of what either side holds now, null where it holds nothing.
        became = lambda pulled, pushed, was: F.when(F.col("action") == "pull", F.col(pulled)).when(F.col("action") == "push", F.col(pushed)).otherwise(F.col(was))
        state = both.select(
            "id", "known_hash", F.when(F.col("action") == "delete_local", None).otherwise(became("remote_own_hash", "local_hash", "local_hash")).alias("here"),
            F.when(F.col("action") == "delete_remote", None).otherwise(became("remote_hash", "local_hash", "remote_hash")).alias("there"),
            became("remote_updated", "local_updated", "local_updated").alias("updated_at"),
        )
        agreed = state.where("here = there").select("id", F.col("here").alias("content_hash"), "updated_at", "known_hash")
        new = agreed.where(~F.col("content_hash").eqNullSafe(F.col("known_hash"))).select("id", "content_hash", F.lit("upsert").alias("op"))
        lost = state.where("here is null and there is null and known_hash is not null").select("id", F.col("known_hash").alias("content_hash"), F.lit("delete").alias("op"))
        self.store.append("synced", new.unionByName(lost).withColumn("folder", F.lit(folder)), F.col("op"), now)
        if not pull_only:
            readers.write_manifest(agreed.dropDuplicates(["id"]), folder, now.isoformat())
        if not pull_only and not push_only:
            for kind in ("relationships", "collections"):
                readers.make_folder(self.spark, f"{folder}/{kind}")
            # Of those that neither side ever had there is nothing to compare.
            if self.store.has("relationships") or readers.has_documents(self.spark, f"{folder}/relationships"):
                self._sync_relationships(folder, state.where("there is not null").select("id"), now)
            if self.store.has("collections") or readers.has_documents(self.spark, f"{folder}/collections"):
                self._sync_collections(folder, now)
        return acts

    def _sync_relationships(self, folder: str, remote_ids: DataFrame, now: datetime) -> None:
        key = ["source_id", "target_id", "relationship_type"]
        local, remote = self.store.current("relationships"), readers.replica(self.spark, folder, "relationships", readers.RELATIONSHIP)
        acts = sync.relationships(local, remote, self.store.current("entries").select("id"), remote_ids)
        pull = durable(remote.join(acts.where("action = 'pull'"), key, "left_semi"))
        push = durable(local.join(acts.where("action = 'push'"), key, "left_semi").select(remote.columns))
        if not pull.isEmpty():
            self.store.append("relationships", pull, at=now)
        readers.write_replica(push, folder, "relationships")

    def _sync_collections(self, folder: str, now: datetime) -> None:
        members = self.store.current("members").groupBy(F.col("collection_id").alias("id")).agg(F.array_sort(F.collect_list("entry_id")).alias("member_ids"))
        local = self.store.current("collections").join(members, "id", "left")
        remote = readers.replica(self.spark, folder, "collections", readers.COLLECTION)
        acts = sync.collections(local, remote)
        pull = durable(remote.join(acts.where("action = 'pull'"), "id", "left_semi"))
        pushed = acts.where("action = 'push'")
        push = durable(local.join(pushed, "id", "left_semi").select(remote.columns))
        if not pull.isEmpty():
            told = pull.select(F.col("id").alias("collection_id"), F.explode("member_ids").alias("entry_id"))
            fresh = durable(sync.collection_members(told, pull, self.store.current("entries").select("id")).withColumn("added_at", F.lit(now).cast("timestamp_ntz")))
            old = self.store.current("members").join(pull.select(F.col("id").alias("collection_id")), "collection_id", "left_semi")
            self.store.append("members", old, "delete", now)
            self.store.append("collections", pull, at=now)
            self.store.append("members", fresh, at=now)
        readers.write_replica(push, folder, "collections")


def _tags(tags) -> list[str]:
    """Tags as a list, from a list or comma-separated text."""
    parts = tags.split(",") if isinstance(tags, str) else tags or []
    return [t.strip().lower() for t in parts if t.strip()]
