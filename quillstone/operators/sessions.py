"""Mining of session transcripts: pairs of question and answer, their worth, and the entries made of them.

Confidence is added up in hundredths, so that thresholds compare exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import rules as R
from quillstone.functions import scalars as S
from quillstone.tables import discard, durable

MIN_CONFIDENCE, AHEAD, MIN_CONTENT, MOST_TAGS, LONG_FILE = 30, 2, 20, 5, 2_000

BLOCK = "struct<type:string,text:string,id:string,name:string,input:struct<file_path:string,old_string:string,new_string:string,content:string,command:string>,result:array<string>>"


def matches(text: Column, patterns: list[str], flags: str = "(?iU)") -> Column:
    """Whether any pattern is found: one alternation, so that a text is looked through once."""
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def text_content(blocks: Column) -> Column:
    """Text blocks and the texts in tool results, a line each."""
    parts = F.flatten(F.transform(blocks, lambda b: F.when(b["type"] == "text", F.array(b["text"])).when(b["type"] == "tool_result", F.coalesce(b["result"], F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))))
    return F.array_join(F.filter(parts, lambda t: t.isNotNull() & (t != "")), "\n")


def tool_uses(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["type"] == "tool_use")


def tool_results(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["type"] == "tool_result")


def conversation_pairs(messages: DataFrame) -> DataFrame:
    """(session_id, pair, user_uuid, user_text, assistant_uuid, text, tools) from messages (session_id, seq, type, uuid,
    timestamp, blocks) in order: each user message with the assistant messages that follow it. One without an answer
    makes no pair."""
    w = Window.partitionBy("session_id").orderBy("seq")
    # Texts and tools are taken out of the blocks before rows are dealt by session; what isn't asked for isn't carried along.
    # Turns, pairs and what is said after them are worked out where a session's rows lie then.
    said = messages.select("session_id", "seq", "type", "uuid", "timestamp", F.when(F.col("type") == "user", text_content(F.col("blocks"))).alias("asked"), F.when(F.col("type") == "assistant", text_content(F.col("blocks"))).alias("text"), F.when(F.col("type") == "assistant", tool_uses(F.col("blocks"))).alias("tools"), F.coalesce(F.size("blocks"), F.lit(0)).alias("n"))
    turns = said.withColumn("turn", F.sum(F.when(F.col("type") == "user", 1).otherwise(0)).over(w)).where("turn > 0")
    asked, answer = F.when(F.col("type") == "user", F.col("seq")), F.when(F.col("type") == "assistant", F.col("seq"))
    in_order = lambda c: F.sort_array(F.collect_list(F.when(answer.isNotNull(), F.struct("seq", c))))[c]
    grouped = turns.groupBy("session_id", "turn").agg(
        F.min_by("uuid", asked).alias("user_uuid"), F.min_by("asked", asked).alias("user_text"), F.min_by("uuid", answer).alias("assistant_uuid"),
        in_order("text").alias("texts"), in_order("tools").alias("tools"), F.max(F.when(answer.isNotNull(), F.col("timestamp"))).alias("timestamp"),
        F.sum(F.when(answer.isNotNull(), F.greatest("n", F.lit(0))).otherwise(0)).alias("blocks"),
    )
    found = grouped.where("blocks > 0").select(
        "session_id", "turn", "user_uuid", "user_text", "assistant_uuid", F.array_join(F.filter("texts", lambda t: t != ""), "\n").alias("text"), F.flatten(F.filter("tools", lambda t: t.isNotNull())).alias("tools"), "timestamp",
    )
    return found.withColumn("pair", F.row_number().over(Window.partitionBy("session_id").orderBy("turn")) - 1).drop("turn")


def thread_roots(messages: DataFrame) -> DataFrame:
    """(session_id, uuid, root, level): for each user message itself, and for each assistant message the user message that
    leads its thread and how far above it is. Pointer doubling: every round, a message takes over what the message that it
    points at has reached, so a thread of n messages takes about log2(n) rounds, each a join on message ids. Messages of
    other types, without a parent, or that are their own ancestors without a user between lead nowhere, and neither do
    those below them. Of repeated ids in a session the first message counts."""
    known = messages.where("uuid is not null").groupBy("session_id", "uuid").agg(F.min_by(F.struct("type", "parent_uuid"), "seq").alias("m")).select("session_id", "uuid", "m.*")
    user = F.col("type") == "user"
    state = known.where(F.col("type").isin("user", "assistant")).select(
        "session_id", "uuid", F.when(user, F.col("uuid")).alias("root"), F.when(user, 0).otherwise(1).cast("long").alias("level"), F.when(~user, F.col("parent_uuid")).alias("up")
    )
    state = durable(state.where("root is not null or up is not null"))
    left = state.where("root is null").count()
    # What is still open after so many rounds goes around in a circle.
    for _ in range(left.bit_length() + 1):
        if not left:
            break
        at = state.select("session_id", F.col("uuid").alias("up"), F.col("root").alias("up_root"), F.col("level").alias("up_level"), F.col("up").alias("next"))
        further = state.where("root is null").join(at, ["session_id", "up"]).select("session_id", "uuid", F.col("up_root").alias("root"), (F.col("level") + F.col("up_level")).alias("level"), F.col("next").alias("up"))
        before, state = state, durable(state.where("root is not null").unionByName(further))
        discard(before)
        left = state.where("root is null").count()
    return state.where("root is not null").select("session_id", "uuid", "root", "level")


def threaded_pairs(messages: DataFrame) -> DataFrame:
    """The same of transcripts that branch: a user message's answers are the assistant messages below it by parent_uuid,
    down to the next user messages."""
    rows = thread_roots(messages).join(messages.select("session_id", "uuid", "seq", "type", "timestamp", "blocks"), ["session_id", "uuid"])
    # Each thread reads as a transcript of its own: the question, then its answers by depth.
    order = Window.partitionBy("session_id", "root").orderBy("level", "seq")
    line = rows.select(F.concat_ws("\u0001", "session_id", "root").alias("thread"), "session_id", "root", F.row_number().over(order).alias("seq"), "type", "uuid", "timestamp", "blocks")
    pairs = conversation_pairs(line.select(F.col("thread").alias("session_id"), "seq", "type", "uuid", "timestamp", "blocks"))
    roots = messages.where("type = 'user'").select("session_id", F.col("uuid").alias("user_uuid"), F.col("seq").alias("at"))
    named = pairs.select(F.split("session_id", "\u0001")[0].alias("session_id"), *[c for c in pairs.columns if c not in ("session_id", "pair")])
    placed = named.join(roots, ["session_id", "user_uuid"])
    return placed.withColumn("pair", F.row_number().over(Window.partitionBy("session_id").orderBy("at")) - 1).drop("at")


def with_outcome(pairs: DataFrame, text: str = "user_text", session: str = "session_id", order: str = "pair") -> DataFrame:
    """pairs with acknowledged and corrected: whether a user says so in this pair or the two after it."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(0, AHEAD)
    low = F.lower(F.coalesce(text, F.lit("")))
    return pairs.withColumns({
        "acknowledged": F.coalesce(F.max(matches(low, R.THANKS)).over(w), F.lit(False)), "corrected": F.coalesce(F.max(matches(low, R.CORRECTIONS)).over(w), F.lit(False)),
    })


def confidence(has_code: Column, has_tools: Column, acknowledged: Column, corrected: Column, length: Column) -> Column:
    """In hundredths."""
    add = lambda c, n: F.when(c, n).otherwise(0)
    score = F.lit(40) + add(has_code, 15) + add(has_tools, 10) + add(acknowledged, 20) - add(corrected, 15) + add(length > 500, 5)
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def title(text: Column) -> Column:
    """The first sentence without greeting, cut to 80."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    for p in R.GREETINGS:
        trimmed = F.regexp_replace(trimmed, "(?iU)" + p, "")
    first = F.regexp_replace(F.split(trimmed, r"[.!?\n]")[0], r"(?U)^\s+|\s+$", "")
    return S.capitalized(S.shortened(first))


def description(text: Column, tools: Column) -> Column:
    """The answer's first paragraph, or the tools it used."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    first = F.regexp_replace(F.split(trimmed, "\n\n")[0], r"(?U)^\s+|\s+$", "")
    names = F.array_distinct(F.transform(tools, lambda t: F.coalesce(t["name"], F.lit(""))))
    used = F.concat(F.lit("Solution using "), F.array_join(F.slice(names, 1, 3), ", "), F.lit("."))
    return (
        F.when(trimmed != "", F.when(F.length(first) > 200, F.concat(F.substring(first, 1, 197), F.lit("..."))).otherwise(first))
        .when(F.size(tools) > 0, used).otherwise("Solution to the described problem.")
    )


def content(text: Column, tools: Column) -> Column:
    """The answer's text and what its tools wrote, as Markdown."""
    def block(t):
        i = t["input"]
        path = F.coalesce(i["file_path"], F.lit(""))
        body = F.when(F.length(i["content"]) > LONG_FILE, F.concat(F.substring(i["content"], 1, LONG_FILE), F.lit("\n... (truncated)"))).otherwise(i["content"])
        full = lambda c: F.coalesce(c, F.lit("")) != ""
        return (
            F.when((t["name"] == "Edit") & full(i["new_string"]) & ~i["new_string"].eqNullSafe(i["old_string"]), F.concat(F.lit("\n\nEdit to "), path, F.lit(":\n```\n"), i["new_string"], F.lit("\n```")))
            .when((t["name"] == "Write") & full(i["content"]), F.concat(F.lit("\n\nFile "), path, F.lit(":\n```\n"), body, F.lit("\n```")))
            .when((t["name"] == "Bash") & full(i["command"]), F.concat(F.lit("\n\nCommand:\n```bash\n"), i["command"], F.lit("\n```")))
        )

    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.array_join(F.array_compact(F.concat(F.array(F.when(trimmed != "", trimmed)), F.transform(tools, block))), "\n")


def code_language(c: Column) -> Column:
    out = None
    for language, patterns in R.CODE_LANGUAGES.items():
        test = matches(c, patterns, "(?imU)")
        out = F.when(test, language) if out is None else out.when(test, language)
    return out


def tags(project_path: Column, content_: Column, tools: Column) -> Column:
    names = F.transform(tools, lambda t: F.lower(F.coalesce(t["name"], F.lit(""))))
    project = F.lower(F.element_at(F.split(F.rtrim(F.regexp_replace(F.coalesce(project_path, F.lit("")), "/+$", "")), "/"), -1))
    low = F.lower(content_)
    found = [F.when(project != "", project), code_language(content_), F.when(F.array_contains(names, "bash"), "cli"), F.when(F.arrays_overlap(names, F.array(F.lit("edit"), F.lit("write"))), "code")]
    found += [F.when(low.rlike("(?iU)" + p), t) for t, p in R.TOPICS.items()]
    return F.slice(F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))), 1, MOST_TAGS)


def extract(messages: DataFrame, projects: DataFrame | None = None, min_confidence: int = MIN_CONFIDENCE, kinds: list[str] | None = None) -> DataFrame:
    """Entries (title, description, content, tags, confidence, extraction_type, source_refs, session_id) of messages.
    projects: session_id, project_path; kinds keeps problem solutions, or general entries, alone."""
    pairs = with_outcome(conversation_pairs(messages))
    pairs = pairs.join(projects, "session_id", "left") if projects is not None else pairs.withColumn("project_path", F.lit(None).cast("string"))
    asked = pairs.where(matches(F.lower("user_text"), R.QUESTIONS))
    has_code = F.exists("tools", lambda t: F.coalesce(t["name"].isin(*R.CODE_TOOLS), F.lit(False)))
    scored = asked.withColumn("has_code", has_code).withColumn("hundredths", confidence(F.col("has_code"), F.size("tools") > 0, F.col("acknowledged"), F.col("corrected"), F.length("text")))
    # Rows of their own by explode: the filter on title and content doesn't have them worked out again.
    made = scored.where(F.col("hundredths") >= min_confidence).withColumn("made", F.explode(F.array(F.struct(title(F.col("user_text")).alias("title"), content(F.col("text"), F.col("tools")).alias("content")))))
    made = made.select("*", "made.title", "made.content").drop("made")
    made = made.where((F.col("title") != "") & (F.length(F.regexp_replace("content", r"(?U)^\s+|\s+$", "")) >= MIN_CONTENT))
    entries = made.select(
        "title", description(F.col("text"), F.col("tools")).alias("description"), "content", tags(F.col("project_path"), F.col("content"), F.col("tools")).alias("tags"),
        (F.col("hundredths") / 100).alias("confidence"), F.when(F.col("has_code"), "problem_solution").otherwise("general").alias("extraction_type"),
        F.array("user_uuid", "assistant_uuid").alias("source_refs"), "session_id",
    )
    return entries.where(F.col("extraction_type").isin(*kinds)) if kinds else entries
