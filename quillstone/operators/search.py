"""Lists, lookups and searches over entries (id, title, description, content, tags, project, created, last_used, usage_count)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import scalars as S

DATE_FIELDS = ("created", "last_used")
#: Rows that are looked at for each that is wanted when tags are filtered after the limit.
OVERFETCH = 3


def in_project(entries: DataFrame, project: str | None) -> DataFrame:
    return entries.where(F.col("project") == project) if project else entries


def between(field: str, since: str | None, until: str | None, keep_null: bool = False) -> Column:
    """ISO texts compare as texts, so a bare date as until leaves out that day's later times."""
    if field not in DATE_FIELDS:
        raise ValueError(f"date field must be one of {DATE_FIELDS}")
    value, out = S.iso(F.col(field)), F.lit(True)
    for wanted, test in ((since, lambda: value >= since), (until, lambda: value <= until)):
        if wanted:
            out = out & (F.col(field).isNull() | test() if keep_null else test())
    return out


def tagged(tags: Iterable[str] | None, fuzzy: bool) -> Column:
    wanted = list(tags or [])
    return S.has_tags_like(F.col("tags"), wanted) if fuzzy else S.has_tags(F.col("tags"), wanted)


def _limited(entries: DataFrame, order: list[Column], limit: int, tags, fuzzy: bool, exact: bool) -> DataFrame:
    """With tags, as many as OVERFETCH rows for each are ordered and cut before the tags are looked at, unless exact."""
    if not tags:
        return entries.orderBy(*order).limit(limit)
    if exact:
        return entries.where(tagged(tags, fuzzy)).orderBy(*order).limit(limit)
    return entries.orderBy(*order).limit(OVERFETCH * limit).where(tagged(tags, fuzzy)).orderBy(*order).limit(limit)


def list_entries(
    entries: DataFrame, *, project: str | None = None, limit: int = 50, tags=None, fuzzy: bool = False,
    since: str | None = None, until: str | None = None, date_field: str = "created", exact: bool = False,
) -> DataFrame:
    """The most recently used first, then the newest."""
    found = in_project(entries, project).where(between(date_field, since, until))
    return _limited(found, [F.desc_nulls_last("last_used"), F.desc("created"), F.col("id")], limit, tags, fuzzy, exact)


def search_entries(
    entries: DataFrame, text: str, *, project: str | None = None, limit: int = 20, tags=None, fuzzy: bool = False,
    since: str | None = None, until: str | None = None, date_field: str = "created", exact: bool = False, index=None,
) -> DataFrame:
    """Entries with text in title, description or content; the most used first. With an index (text_index.TextIndex) of the
    entries as they are, only candidates' texts are read."""
    found = in_project(entries, project).where(between(date_field, since, until))
    if index is not None:
        found = found.join(index.hits(text), "id", "left_semi")
    else:
        found = found.where(S.has_text(F.col("title"), text) | S.has_text(F.col("description"), text) | S.has_text(F.col("content"), text))
    return _limited(found, [F.desc("usage_count"), F.desc_nulls_last("last_used"), F.col("id")], limit, tags, fuzzy, exact)


def get(entries: DataFrame, entry_id) -> DataFrame:
    return entries.where(F.col("id") == entry_id).limit(1)


def get_many(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """ids: id."""
    return entries.join(ids.select("id").distinct(), "id", "left_semi")


def projects(entries: DataFrame) -> DataFrame:
    return entries.where("project is not null and project <> ''").select("project").distinct().orderBy("project")


def complete(entries: DataFrame, column: str, prefix: str, limit: int = 50) -> DataFrame:
    """Values for completion: ids by latest use, others in order."""
    found = entries.where(F.col(column).startswith(prefix))
    if column == "id":
        return found.orderBy(F.desc_nulls_last(F.coalesce("last_used", "created")), "id").limit(limit).select("id")
    return found.select(column).distinct().orderBy(column).limit(limit)
