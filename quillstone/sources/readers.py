"""Readers and writers of transcripts, commits, source trees, exports and replica folders."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import re
import shutil
import subprocess
import threading
import time
import urllib.parse
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import islice

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType
from pyspark.sql.window import Window

from quillstone.functions import rules as R
from quillstone.functions import scalars as S
from quillstone.operators.sessions import BLOCK
from quillstone.tables import shared_dir

_LINE = "type string, uuid string, parentUuid string, timestamp string, message struct<role:string, content:string>"
_RAW_BLOCK = "array<struct<type:string,text:string,id:string,name:string,input:struct<file_path:string,old_string:string,new_string:string,content:string,command:string>,content:string>>"


def messages(files: DataFrame, text: str = "value", session: Column | None = None) -> DataFrame:
    """Messages (session_id, seq, type, uuid, parent_uuid, timestamp, blocks) of whole transcripts, a JSON object a line:
    blank and malformed lines, and those that neither user nor assistant wrote, are left out; a text alone is one block.
    Works on streams."""
    session = session if session is not None else F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl$", 1)
    lines = files.select(session.alias("session_id"), F.posexplode(F.split(text, "\n")).alias("seq", "line"))
    parsed = lines.select(F.from_json("line", _LINE).alias("m"), "session_id", F.col("seq").cast("long").alias("seq"))
    kept = parsed.where(F.col("m.type").isin("user", "assistant"))
    content = F.col("m.message.content")
    raw = F.from_json(content, _RAW_BLOCK)
    one = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *[F.lit(None).cast("string").alias(n) for n in ("id", "name")], F.lit(None).cast("struct<file_path:string,old_string:string,new_string:string,content:string,command:string>").alias("input"), F.lit(None).cast("array<string>").alias("result")))

    def block(b):
        inner = F.from_json(b["content"], "array<struct<type:string,text:string>>")
        result = F.when(b["content"].startswith("["), F.transform(F.filter(inner, lambda x: x["type"] == "text"), lambda x: x["text"])).when(b["content"].isNotNull(), F.array(b["content"]))
        return F.struct(b["type"].alias("type"), b["text"].alias("text"), b["id"].alias("id"), b["name"].alias("name"), b["input"].alias("input"), result.alias("result"))

    blocks = F.when(F.ltrim(content).startswith("[") & raw.isNotNull(), F.transform(raw, block)).otherwise(one)
    at = F.coalesce(F.try_to_timestamp("m.timestamp"), F.current_timestamp())
    return kept.select("session_id", "seq", "m.type", "m.uuid", F.col("m.parentUuid").alias("parent_uuid"), at.alias("timestamp"), blocks.cast(f"array<{BLOCK}>").alias("blocks"))


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    return messages(transcripts(spark.read, folder))


def transcripts(reader, folder: str) -> DataFrame:
    """Whole transcript files, from spark.read or spark.readStream."""
    return reader.format("text").option("wholetext", "true").option("pathGlobFilter", "*.jsonl").load(folder).select("value", "_metadata")


def session_index(spark: SparkSession, path: str, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Indexed sessions, the latest modified first; with since those modified after it."""
    schema = "version int, originalPath string, entries array<struct<sessionId:string,fullPath:string,firstPrompt:string,summary:string,messageCount:long,created:string,modified:string,gitBranch:string,projectPath:string>>"
    found = spark.read.json(path, schema=schema, multiLine=True).select("originalPath", F.explode("entries").alias("e")).select("originalPath", "e.*")
    if since:
        found = found.where(F.regexp_replace("modified", r"(Z|[+-]\d\d:?\d\d)$", "") > since)
    found = found.orderBy(F.desc_nulls_last("modified"), "sessionId")
    return found.limit(limit) if limit is not None else found


def projects(spark: SparkSession, folder: str) -> DataFrame:
    """(project, sessions): project folders by the names of their transcripts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -2)
    return files.groupBy(F.translate(name, "-", "/").alias("project")).agg(F.count("*").alias("sessions")).orderBy("project")


def source_files(spark: SparkSession, folder: str, include: list[str] | None = None, exclude: list[str] | None = None, languages: list[str] | None = None) -> DataFrame:
    """(path, content) of files below folder, paths relative to it; patterns hold for paths and for names alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.regexp_replace(F.lit(folder.rstrip("/")), r"^\w+:/*", "/")
    path = F.regexp_replace(F.col("path"), r"^\w+:/*", "/")
    relative = F.substring(path, F.length(root) + 2, F.lit(1 << 30))
    files = files.select(relative.alias("path"), F.decode("content", "UTF-8").alias("content"))
    fits = lambda patterns: _fits(F.col("path"), patterns)
    kept = files.where(~fits(R.EXCLUDES if exclude is None else exclude))
    if include:
        kept = kept.where(fits(include))
    if languages:
        kept = kept.where(S.language_of_path(F.col("path")).isin(*languages))
    return kept


def _fits(path: Column, patterns: list[str]) -> Column:
    name, out = F.element_at(F.split(path, "/"), -1), F.lit(False)
    for p in patterns:
        r = fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$")
        out = out | path.rlike("^" + r) | name.rlike("^" + r)
    return out


_FIELDS = "%H%x00%an%x00%ae%x00%aI%x00%B%x00"


def git_command(repo: str, mark: str, since: str | None = None, until: str | None = None, limit: int | None = None, author: str | None = None, path: str | None = None, branch: str | None = None) -> list[str]:
    """The command whose output, parted by mark, commits() reads; filters are the tool's own, so only matching commits are
    listed."""
    command = ["git", "-C", repo, "log", f"--format={mark}{_FIELDS}", "-p", "--no-color"]
    command += [f"--{k}={v}" for k, v in (("since", since), ("until", until), ("author", author)) if v] + ([f"-n{limit}"] if limit else []) + ([branch] if branch else [])
    return command + (["--", path] if path else [])


def git_log(spark: SparkSession, repo: str, **filters) -> DataFrame:
    """Commits of a repository on this machine. The log goes to a file in the shared folder while it is written, and is read
    from there in parts; the driver holds none of it. Records are parted by a mark of this run, which no difference holds."""
    path, mark = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}", f"commit-{uuid.uuid4().hex}"
    target, files = _path(spark, path)
    out = files.create(target, True)
    try:
        with subprocess.Popen(git_command(repo, mark, **filters), stdout=subprocess.PIPE) as run:
            while part := run.stdout.read(1 << 20):
                out.write(bytearray(part))
        if run.returncode:
            raise subprocess.CalledProcessError(run.returncode, run.args)
    finally:
        out.close()
    files.deleteOnExit(target)
    return commits(spark.read.text(path, lineSep=mark).where("trim(value) <> ''"))


def _git(repo: str, *arguments: str) -> str:
    return subprocess.run(["git", "-C", repo, *arguments], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def git_show(spark: SparkSession, repo: str, sha: str) -> DataFrame:
    """One commit, as git_log gives it."""
    out = _git(repo, "show", f"--format=%x01{_FIELDS}", "-p", "--no-color", sha)
    return commits(spark.createDataFrame([(out.lstrip("\x01"),)], "value string"))


def git_diff(spark: SparkSession, repo: str, base: str, head: str, context: int = 3) -> DataFrame:
    """(diff) between two revisions, to be parsed by commits.with_diffs."""
    return spark.createDataFrame([(f"{base}..{head}", _git(repo, "diff", "--no-color", f"-U{context}", base, head))], "sha string, diff string")


def is_repository(folder: str) -> bool:
    return subprocess.run(["git", "-C", folder, "rev-parse", "--git-dir"], capture_output=True, check=False).returncode == 0


def branch_name(repo: str) -> str | None:
    name = _git(repo, "rev-parse", "--abbrev-ref", "HEAD").strip()
    return None if name == "HEAD" else name


def commits(records: DataFrame, text: str = "value") -> DataFrame:
    """(sha, author, author_email, timestamp, message, diff) of log records, fields parted by NUL."""
    f = F.split(text, "\x00", 6)
    return records.where(F.size(f) == 6).select(
        F.trim(f[0]).alias("sha"), f[1].alias("author"), f[2].alias("author_email"), F.to_timestamp(f[3]).cast("timestamp_ntz").alias("timestamp"),
        F.regexp_replace(f[4], r"\s+$", "").alias("message"), F.ltrim(f[5]).alias("diff"),
    )


def repo_name(url: str) -> str | None:
    m = re.search(r"[:/]([^/:]+?)(?:\.git)?/?$", url)
    return m[1] if m else None


# Exports, imports and replica folders

RELATIONSHIP = "id string, source_id string, target_id string, relationship_type string, created timestamp_ntz, metadata map<string,string>"
COLLECTION = "id string, name string, description string, created timestamp_ntz, updated_at timestamp_ntz, member_ids array<string>"

ENTRY = "id string, title string, description string, content string, brief string, tags array<string>, context array<string>, created timestamp_ntz, updated_at timestamp_ntz, last_used timestamp_ntz, usage_count long, confidence double, source string, project string"


def export(entries: DataFrame, path: str, project: str | None = None) -> None:
    (entries.where(F.col("project") == project) if project else entries).write.mode("overwrite").json(path)


def write_list(entries: DataFrame, path: str) -> int:
    """One file with a JSON list, streamed through the driver; returns the number of entries."""
    out, n = _create(entries.sparkSession, path), 0
    try:
        for line in _documents(entries):
            out.write(bytearray(((",\n" if n else "[\n") + line[1]).encode()))
            n += 1
        out.write(bytearray(b"\n]\n" if n else b"[]\n"))
    finally:
        out.close()
    return n


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON lines (what export() writes), or of a JSON list."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    return spark.read.json(path, schema=ENTRY, multiLine=first is not None and first[0].lstrip().startswith("["))


def parse_export(spark: SparkSession, text: str) -> DataFrame:
    """Entries of a JSON list, as of standard input."""
    if not text.lstrip().startswith("["):
        raise ValueError("JSON must be a list of entries")
    rows = spark.createDataFrame([(text,)], "value string").select(F.from_json("value", f"array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in ENTRY.split(', '))}>>").alias("d"))
    return rows.select(F.explode("d").alias("d")).select("d.*")


def classified(incoming: DataFrame, existing: DataFrame, skip_duplicates: bool = True) -> DataFrame:
    """incoming with outcome: imported, skipped or error. Entries without title, description or content are errors. Of
    several complete ones under one id the latest updated is imported, of equals the one whose text has the least hash."""
    blank = lambda c: S.stripped(F.coalesce(c, F.lit(""))) == ""
    known = existing.select("id", F.lit(True).alias("known"))
    wrong = blank("title") | blank("description") | blank("content")
    order = [F.desc_nulls_last("updated_at")] if "updated_at" in incoming.columns else []
    w = Window.partitionBy("id", wrong).orderBy(*order, S.content_hash(F.col("title"), F.col("description"), F.col("content")))
    again = F.col("known") | (F.col("nth") > 1)
    outcome = F.when(wrong, "error").when(again, "skipped" if skip_duplicates else "error").otherwise("imported")
    return incoming.withColumn("nth", F.row_number().over(w)).join(known, "id", "left").withColumn("outcome", outcome).drop("known", "nth")


def valid(entries: DataFrame) -> Column:
    ok = lambda c, most: (S.stripped(F.coalesce(c, F.lit(""))) != "") & (F.length(c) <= most)
    return ok(F.col("title"), S.MAX_TITLE) & ok(F.col("description"), S.MAX_DESCRIPTION) & ok(F.col("content"), S.MAX_CONTENT) & F.coalesce("confidence", F.lit(1.0)).between(0, 1)


def replica(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    """Documents of a replica folder (entries, relationships, collections), one a file, indented or not; malformed ones
    are left out. Executors open the files, many in a task; in a file system that Arrow doesn't know, Spark's own source does,
    which plans a task for each few."""
    if not exists(spark, f"{folder}/{kind}"):
        return spark.createDataFrame([], schema)
    texts = _texts(spark, f"{folder}/{kind}")
    if texts is None:
        files = spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json")
        return files.json(f"{folder}/{kind}").where("id is not null")
    one = StructType.fromDDL(f"{schema}, _malformed string")
    lists = F.ltrim("value").startswith("[")  # a file of several documents
    parsed = F.when(lists, F.from_json("value", ArrayType(one), {"columnNameOfCorruptRecord": "_malformed"})).otherwise(F.array(F.from_json("value", one, {"columnNameOfCorruptRecord": "_malformed"})))
    return texts.select(F.explode(parsed).alias("d")).select("d.*").where("_malformed is null and id is not null").drop("_malformed")


def _texts(spark: SparkSession, folder: str) -> DataFrame | None:
    """(value): the text of each document's file; None if Arrow doesn't know the folder's file system."""
    p, files = _path(spark, folder)
    uri = p.makeQualified(files.getUri(), files.getWorkingDirectory()).toString()
    try:
        _open_folder(uri)
    except (OSError, ValueError):
        return None

    def listed(batches):
        list(batches)
        system, path = _open_folder(uri)
        names = (n for n in _names(system, path) if n.endswith(".json") and n[0] not in "._")
        while part := list(islice(names, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(part)], names=["name"])

    def opened(batches):
        system, path = _open_folder(uri)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                texts = []
                for name in batch.column(0).slice(i, 500).to_pylist():
                    with system.open_input_stream(f"{path}/{name}", compression=None) as f:
                        raw = f.read()
                    texts.append(raw.decode(json.detect_encoding(raw), "replace"))
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])

    # As many tasks as a shuffle has, however short the names are.
    dealt = spark.range(1).coalesce(1).mapInArrow(listed, "name string").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(opened, "value string")


def has_documents(spark: SparkSession, folder: str) -> bool:
    """Whether there is any document in a folder; names are asked for until the first."""
    p, files = _path(spark, folder)
    if not files.exists(p):
        return False
    listed = files.listStatusIterator(p)
    while listed.hasNext():
        found = listed.next()
        if found.isFile() and (name := found.getPath().getName()).endswith(".json") and name[0] not in "._":
            return True
    return False


def _names(system, path: str) -> Iterator[str]:
    """The names of a folder's files, one after the other."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(path) as found:
            yield from (f.name for f in found if f.is_file())
    else:
        yield from (f.base_name for f in system.get_file_info(fs.FileSelector(path)) if f.is_file)


def replica_entry(spark: SparkSession, folder: str, entry_id: str) -> DataFrame:
    """The document of one entry, from its own file."""
    path = f"{folder}/entries/{file_name(entry_id)}"
    if not exists(spark, path):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path).where("id is not null")


TOMBSTONE = "id string, deleted_at timestamp_ntz"
_STATE = "map<string, struct<content_hash:string,updated_at:timestamp_ntz>>"


def replica_tombstones(spark: SparkSession, folder: str) -> DataFrame:
    """(id, deleted_at) that the folder tells of; none if it has no such file, or a malformed one."""
    path = f"{folder}/tombstones/deleted.json"
    if not exists(spark, path):
        return spark.createDataFrame([], TOMBSTONE)
    told = spark.read.schema("deletions array<struct<id:string,deleted_at:timestamp_ntz>>").option("multiLine", "true").json(path)
    return told.select(F.explode("deletions").alias("d")).select("d.*").where("id is not null").groupBy("id").agg(F.max("deleted_at").alias("deleted_at"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(id, content_hash, updated_at) of what was last synchronized with the folder by anyone."""
    path = f"{folder}/manifest.json"
    if not exists(spark, path):
        return spark.createDataFrame([], "id string, content_hash string, updated_at timestamp_ntz")
    told = spark.read.schema(f"version int, last_sync map<string,string>, entries {_STATE}").option("multiLine", "true").json(path)
    return told.select(F.explode("entries").alias("id", "s")).select("id", "s.*")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, files = _path(spark, path)
    return files.exists(p)


def make_folder(spark: SparkSession, path: str) -> None:
    p, files = _path(spark, path)
    files.mkdirs(p)


def _create(spark: SparkSession, path: str):
    p, files = _path(spark, path)
    return files.create(p, True)


def read_file(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None without such a file."""
    p, files = _path(spark, path)
    if not files.exists(p):
        return None
    stream = files.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def file_name(entry_id: str) -> str:
    """The file of a document: its id, with all but ASCII letters, digits and _.-~ as %-codes, so that no id leads out of the
    folder; a long id is cut and told apart by its hash."""
    name = urllib.parse.quote(entry_id, safe="")
    if name.startswith("."):
        name = "%2E" + name[1:]
    return (name if len(name) <= 180 else f"{name[:100]}-{hashlib.sha256(entry_id.encode()).hexdigest()}") + ".json"


def _shown(rows: DataFrame) -> DataFrame:
    """(id, d): each row's indented JSON, times as ISO texts."""
    times = {f.name: S.iso(F.col(f.name)) for f in rows.schema.fields if f.dataType.typeName().startswith("timestamp")}
    return rows.select(F.col("id").cast("string").alias("id"), F.to_json(F.struct(*[times.get(c, F.col(c)).alias(c) for c in rows.columns]), {"pretty": "true", "ignoreNullFields": "false"}).alias("d"))


def _documents(rows: DataFrame) -> Iterator[tuple[str, str]]:
    """Ids and documents, one after the other."""
    for r in _shown(rows).toLocalIterator():
        yield r["id"], r["d"]


def write_file(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    """Replaces a file at once: readers see the old one or the new one, and a writer that dies leaves the old one."""

    def pour(out) -> None:
        for part in parts:
            out.write(bytearray(part.encode()))

    _replace_file(spark, path, pour)


def _replace_file(spark: SparkSession, path: str, pour: Callable[[object], None]) -> None:
    folder, name = path.rsplit("/", 1)
    out = _create(spark, f"{folder}/.{name}.tmp")
    try:
        pour(out)
    finally:
        out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    (old, _), (new, _) = _path(spark, f"{folder}/.{name}.tmp"), _path(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri() if old.isAbsolute() and old.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(old, new, over)


def _open_folder(uri: str):
    """The file system of a URI, as Arrow knows it, and the path in it."""
    from pyarrow import fs

    local = re.match(r"file:/+", uri)
    return (fs.LocalFileSystem(), "/" + uri[local.end() :]) if local else fs.FileSystem.from_uri(uri)


def _on_executors(rows: DataFrame, folder: str, act: Callable[[object, str, list], None]) -> int | None:
    """Calls act(file system, folder, rows) for the rows of each batch, on executors; returns the number of rows, or None
    if Arrow doesn't know the folder's file system."""
    p, files = _path(rows.sparkSession, folder)
    uri = p.makeQualified(files.getUri(), files.getWorkingDirectory()).toString()
    files.mkdirs(p)
    try:
        _open_folder(uri)
    except (OSError, ValueError):
        return None

    def run(batches):
        for batch in batches:
            system, path = _open_folder(uri)
            act(system, path, list(zip(*[c.to_pylist() for c in batch.columns], strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _forget_checksum(path: str, name: str) -> None:
    """A file that Hadoop wrote to a local folder has a checksum beside it, which doesn't hold for what replaces it."""
    if os.path.exists(old := f"{path}/.{name}.crc"):
        os.remove(old)


def _put(system, path: str, rows: list) -> None:
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        _put_local(path, rows)
        return
    for entry_id, text in rows:
        name = file_name(entry_id)
        fresh = f"{path}/.{name}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(fresh) as out:
            out.write(text.encode())
        system.move(fresh, f"{path}/{name}")


def _put_local(path: str, rows: list) -> None:
    """Texts are written in a folder of this task's own and moved: a folder takes one new name at a time, so tasks that write
    beside each other's files wait for each other."""
    own = f"{path}/.{uuid.uuid4().hex}.tmp"
    os.mkdir(own)
    try:
        for entry_id, text in rows:
            name = file_name(entry_id)
            with open(f"{own}/text", "wb") as out:
                out.write(text.encode())
            _forget_checksum(path, name)
            os.replace(f"{own}/text", f"{path}/{name}")
    finally:
        shutil.rmtree(own, ignore_errors=True)


def _take_away(system, path: str, rows: list) -> None:
    from pyarrow import fs

    local = isinstance(system, fs.LocalFileSystem)
    for (entry_id,) in rows:
        name = file_name(entry_id)
        if local:
            _forget_checksum(path, name)
        if system.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound:
            system.delete_file(f"{path}/{name}")


def write_replica(documents: DataFrame, folder: str, kind: str) -> int:
    """A file for each document, named by its id (file_name) and replaced at once; other documents stay. Executors write
    them; in a file system that Arrow doesn't know the driver does, one by one."""
    shown = _shown(documents).where("id is not null")
    n = _on_executors(shown, f"{folder}/{kind}", _put)
    if n is None:
        n = 0
        for r in shown.toLocalIterator():
            write_file(documents.sparkSession, f"{folder}/{kind}/{file_name(r['id'])}", [r["d"]])
            n += 1
    return n


def remove_replica(ids: DataFrame, folder: str, kind: str) -> None:
    names = ids.select(F.col("id").cast("string").alias("id")).where("id is not null")
    if _on_executors(names, f"{folder}/{kind}", _take_away) is None:
        for r in names.toLocalIterator():
            p, files = _path(ids.sparkSession, f"{folder}/{kind}/{file_name(r['id'])}")
            files.delete(p, False)


def _write_joined(rows: DataFrame, path: str, head: str, tail: str) -> None:
    """Replaces a file by head, the rows' texts (value), commas between, and tail. Executors write the texts; the driver only
    puts their files together, without a call or a Python object for each row."""
    spark = rows.sparkSession
    parts = f"{path.rsplit('/', 1)[0]}/.parts-{uuid.uuid4().hex}"
    rows.select(F.concat(F.lit(","), "value").alias("value")).write.text(parts)
    folder, files = _path(spark, parts)
    copy = spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes

    def pour(out) -> None:
        out.write(bytearray(head.encode()))
        first = True
        for status in sorted(files.listStatus(folder), key=lambda f: f.getPath().getName()):
            if status.getPath().getName().startswith("part-") and status.getLen():
                stream = files.open(status.getPath())
                try:
                    if first:  # no comma before the first
                        stream.read()
                        first = False
                    copy(stream, out, 1 << 20, False)
                finally:
                    stream.close()
        out.write(bytearray(tail.encode()))

    try:
        _replace_file(spark, path, pour)
    finally:
        files.delete(folder, True)


def write_tombstones(tombstones: DataFrame, folder: str) -> None:
    _write_joined(_shown(tombstones.select("id", "deleted_at")).select(F.col("d").alias("value")), f"{folder}/tombstones/deleted.json", '{"deletions": [\n', "]}\n")


_MANIFEST, _ENTRIES = '{"version": 2, "last_sync": ', ', "entries": {'


def last_syncs(spark: SparkSession, folder: str) -> dict[str, str]:
    """When each machine last synchronized with the folder, as its manifest tells."""
    path = f"{folder}/manifest.json"
    if not exists(spark, path):
        return {}
    # The manifests that write_manifest() made tell it in their first line, and all entries after it.
    p, files = _path(spark, path)
    stream = files.open(p)
    try:
        head = bytes(stream.readNBytes(1 << 16)).decode("utf-8", "replace").split("\n", 1)[0]
    finally:
        stream.close()
    if head.startswith(_MANIFEST) and head.endswith(_ENTRIES):
        return json.loads(head.removesuffix(_ENTRIES) + "}")["last_sync"]
    told = spark.read.schema("last_sync map<string,string>").option("multiLine", "true").json(path).first()
    return dict(told["last_sync"] or {}) if told else {}


def write_manifest(state: DataFrame, folder: str, at: str) -> None:
    """state: id, content_hash, updated_at. What other machines wrote of their synchronizations stays."""
    last = last_syncs(state.sparkSession, folder) | {S.machine(): at}

    head = f"{_MANIFEST}{json.dumps(last)}{_ENTRIES}\n"
    # The id as JSON text: a list's only element.
    name = F.to_json(F.array("id"))
    _write_joined(_shown(state.select("id", "content_hash", "updated_at")).where("id is not null").select(F.concat(F.substring(name, 2, F.length(name) - 2), F.lit(": "), "d").alias("value")), f"{folder}/manifest.json", head, "}}\n")


#: Seconds a lock is waited for, between two tries, and after which one that nobody renewed counts as left behind.
LOCK_TIMEOUT, LOCK_POLL, LOCK_STALE = 30.0, 0.1, 600.0


class Lock:
    """A lock file that holds its owner's token."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.path, self.token = spark, f"{folder}/.lock", uuid.uuid4().hex
        self.p, self.files = _path(spark, self.path)

    def _owner(self) -> str | None:
        try:
            return read_file(self.spark, self.path)
        except Py4JJavaError:  # it went meanwhile
            return None

    def check(self) -> None:
        """Raises if another writer has taken the lock."""
        if self._owner() != self.token:
            raise RuntimeError(f"the lock {self.path} was lost to another writer")

    def take(self) -> bool:
        if self.files.exists(self.p):
            if self._age() > LOCK_STALE:
                # Of several who see it only one moves the old file away.
                aside = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}.{self.token}")
                if self._age() > LOCK_STALE and self.files.rename(self.p, aside):
                    self.files.delete(aside, False)
            return False
        try:
            out = self.files.create(self.p, False)
            out.write(bytearray(self.token.encode()))
            out.close()
        except Py4JJavaError:  # another was faster
            return False
        # In file systems that create a file twice, the later token stands.
        time.sleep(LOCK_POLL / 5)
        return self._owner() == self.token

    def _age(self) -> float:
        try:
            return time.time() - self.files.getFileStatus(self.p).getModificationTime() / 1000
        except Py4JJavaError:
            return 0.0

    def renew(self) -> None:
        if self._owner() == self.token:
            self.files.setTimes(self.p, int(time.time() * 1000), -1)

    def give_up(self) -> None:
        if self._owner() == self.token:
            self.files.delete(self.p, False)


@contextmanager
def locked(spark: SparkSession, folder: str, timeout: float = LOCK_TIMEOUT) -> Iterator[Lock]:
    """Holds the folder's lock file and renews it meanwhile; TimeoutError if another holder doesn't give it up in time."""
    lock, until, ended = Lock(spark, folder), time.monotonic() + timeout, threading.Event()
    while not lock.take():
        if time.monotonic() > until:
            raise TimeoutError(f"another writer holds {folder}")
        time.sleep(LOCK_POLL)

    def keep() -> None:
        while not ended.wait(LOCK_STALE / 10):
            lock.renew()

    keeper = threading.Thread(target=keep, daemon=True)
    keeper.start()
    try:
        yield lock
    finally:
        ended.set()
        keeper.join()
        lock.give_up()


def with_hash(entries: DataFrame) -> DataFrame:
    own = S.content_hash(F.col("title"), F.col("description"), F.col("content"))
    return entries.withColumn("content_hash", F.coalesce("content_hash", own) if "content_hash" in entries.columns else own)


def embedded(entries: DataFrame, dimensions: int = 64) -> DataFrame:
    """entries with embedding: hashed words of their text, of unit length; a stand-in wherever no model is at hand."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = F.filter(F.split(F.lower(S.sanitized(S.embedding_text(*[F.coalesce(c, F.lit("")) for c in ("title", "description", "content")]))), r"\s+"), lambda w: w != "")
    hashed = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dimensions).transform(entries.withColumn("_words", words))
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(hashed)
    return unit.withColumn("embedding", vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")


