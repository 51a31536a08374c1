"""SQL functions for what has no built-in: register(spark) makes unified_diff(a, b), and the table functions
parse_diff(text) and parse_source(language, text)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillstone.operators.code import parse_source
from quillstone.operators.commits import parse_diff
from quillstone.operators.versions import diff_text


class ParseDiff:
    """A row for each file of a difference."""

    def eval(self, text: str) -> Iterator[tuple]:
        for d in parse_diff(text):
            yield d["file_path"], d["change_type"], d["old_path"], d["additions"], d["deletions"], len(d["hunks"])


class ParseSource:
    """A row for each element of a source text."""

    def eval(self, language: str, text: str) -> Iterator[tuple]:
        for e in parse_source(language or "", text or ""):
            yield e["element_type"], e["name"], e["parent"], e["signature"], e["docstring"], e["start_line"]


def register(spark: SparkSession) -> None:
    @F.pandas_udf("string")
    def unified_diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([diff_text(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    spark.udf.register("unified_diff", unified_diff)
    diff = F.udtf(ParseDiff, returnType="file_path string, change_type string, old_path string, additions int, deletions int, hunks int")
    source = F.udtf(ParseSource, returnType="element_type string, name string, parent string, signature string, docstring string, start_line int")
    spark.udtf.register("parse_diff", diff)
    spark.udtf.register("parse_source", source)
