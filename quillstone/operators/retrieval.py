"""Semantic retrieval: nearest entries above a score, filtered, and cut to a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import scalars as S

from .search import between, in_project, tagged

#: Candidates for each wanted result, and at most.
OVERFETCH, MOST_CANDIDATES = 3, 50


def nearest(vectors: DataFrame, query: list[float], n: int, min_score: float | None = None) -> DataFrame:
    """(id, score) of the n vectors (id, embedding of unit length) with the largest cosine; a top-k, not a sort of all."""
    score = S.dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]).cast("array<double>"))
    found = vectors.select("id", score.alias("score"))
    if min_score is not None:
        found = found.where(F.col("score") >= min_score)
    return found.orderBy(F.desc("score"), "id").limit(n)


def within_budget(ranked: DataFrame, budget: int, n: int) -> DataFrame:
    """Rows taken in the order of rank while their tokens fit; one that doesn't fit is passed over, but the first one
    is taken alone if it is over the budget. ranked (rank, tokens, ...) has no more than MOST_CANDIDATES rows."""
    names = [c for c in ranked.columns if c != "rank"]
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<int>").alias("taken"), F.lit(False).alias("stop"))

    def take(state, row):
        fits = ~state["stop"] & (F.size(state["taken"]) < n) & (state["total"] + row["tokens"] <= budget)
        alone = ~state["stop"] & (F.size(state["taken"]) == 0) & (row["tokens"] > budget)
        return F.struct(
            F.when(fits | alone, state["total"] + row["tokens"]).otherwise(state["total"]).alias("total"),
            F.when(fits | alone, F.concat(state["taken"], F.array(row["rank"]))).otherwise(state["taken"]).alias("taken"),
            (state["stop"] | alone).alias("stop"),
        )

    # The candidates are few, so they travel as one array: what made them is read once.
    row = F.struct(F.col("rank").cast("int").alias("rank"), F.col("tokens").cast("long").alias("tokens"), F.struct(*names).alias("row"))
    folded = ranked.agg(F.array_sort(F.collect_list(row)).alias("rows")).select("rows", F.aggregate("rows", start, take)["taken"].alias("taken"))
    kept = folded.select(F.explode(F.filter("rows", lambda r: F.array_contains("taken", r["rank"]))).alias("r"))
    return kept.select("r.rank", "r.row.*")


def retrieve(
    entries: DataFrame, vectors: DataFrame, query: list[float], *, n: int = 5, token_budget: int = 2000, project: str | None = None,
    min_score: float = 0.3, tags=None, since: str | None = None, until: str | None = None, date_field: str = "created", fuzzy: bool = False,
    exact: bool = False, index=None, guaranteed: bool = False,
) -> DataFrame:
    """Entries with score, tokens and rank. Tags and dates are looked at after the candidates are cut, unless exact;
    a null date passes. A read only: usage() makes the events that record it. With an index (vector_index.VectorIndex) that
    keeps the column project, candidates come from its cells; vectors, if not None, then give their scores as of now."""
    passes = tagged(tags, fuzzy) & between(date_field, since, until, keep_null=True)
    wanted = min(OVERFETCH * n, MOST_CANDIDATES)
    if index is not None and not exact:
        near = index.search(query, wanted, min_score, guaranteed=guaranteed, where=F.col("project") == project if project else None, vectors=vectors)
    else:
        if project or exact:
            ids = in_project(entries, project)
            ids = (ids.where(passes) if exact else ids).select("id")
            vectors = vectors.join(ids, "id", "left_semi")
        near = nearest(vectors, query, wanted, min_score)
    found = entries.join(F.broadcast(near), "id").where(passes)
    found = found.withColumn("tokens", S.token_estimate(F.coalesce("content", F.lit(""))))
    best_first = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", F.struct(*found.columns).alias("row"))))
    ranked = found.agg(best_first.alias("o")).select(F.posexplode("o").alias("at", "x")).select((F.col("at") + 1).alias("rank"), "x.row.*")
    return within_budget(ranked, token_budget, n)


def context(retrieved: DataFrame) -> DataFrame:
    """(text): the retrieved entries as one Markdown text, best first; at most MOST_CANDIDATES rows travel as one array."""
    shown = S.rendered(F.col("title"), F.col("score"), F.col("description"), F.col("tags"), F.col("content"))
    rows = retrieved.agg(F.array_sort(F.collect_list(F.struct("rank", shown.alias("shown")))).alias("rows"))
    text = F.array_join(F.concat(F.array(F.lit("## Retrieved Knowledge\n")), F.transform("rows", lambda r: r["shown"])), "\n")
    return rows.select(F.when(F.size("rows") > 0, text).otherwise("No relevant knowledge found.").alias("text"))


def usage(retrieved: DataFrame, at) -> DataFrame:
    """Usage events (id, ts) of a retrieval; counts and last uses are aggregates of them."""
    return retrieved.select("id", F.lit(at).cast("timestamp_ntz").alias("ts"))


def with_usage(entries: DataFrame, events: DataFrame) -> DataFrame:
    counts = events.groupBy("id").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))
    return entries.join(counts, "id", "left").select(
        *[c for c in entries.columns if c not in ("usage_count", "last_used")],
        (F.coalesce("usage_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("usage_count"), F.greatest("last_used", "latest").alias("last_used"),
    )
