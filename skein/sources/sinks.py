"""Writers: JSON lines, JSON documents, CSV, index tables and fixed-width comparison tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def json_documents(frame: DataFrame, path: str) -> None:
    """One JSON document a row; infinities, which JSON lacks, become null."""
    safe = [F.when(F.abs(c) == float("inf"), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in frame.dtypes]
    frame.select(F.to_json(F.struct(*safe)).alias("value")).write.mode("overwrite").text(path)


def csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def index_table(frame: DataFrame, path: str, by: str) -> None:
    """An index as Parquet, clustered so that lookups by ``by`` skip row groups."""
    frame.repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite").parquet(path)


def fixed_width(frame: DataFrame, widths: dict[str, int]) -> DataFrame:
    """line: each column right-aligned in its width, numbers with three digits."""
    kinds = dict(frame.dtypes)
    cells = [F.lpad(F.format_string("%.3f", F.col(c)) if kinds[c] in ("double", "float") else F.coalesce(F.col(c).cast("string"), F.lit("-")), w, " ") for c, w in widths.items()]
    return frame.select(F.concat_ws(" ", *cells).alias("line"))
