"""Search terms from logs and files, and replay of them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unquote(c: Column) -> Column:
    """Percent escapes decoded; a plus stays one."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def parameter(line: Column, name: str = "searchTerm") -> Column:
    """A parameter's value as it stands in a line, up to the next `&`; null without one."""
    found = F.regexp_extract(line, rf"{name}=([^&]*)&", 1)
    return F.when(line.rlike(rf"{name}=[^&]*&"), found)


def log_terms(lines: DataFrame, column: str = "value", name: str = "searchTerm") -> DataFrame:
    """Distinct terms of a log's lines."""
    return lines.select(unquote(parameter(F.col(column), name)).alias("term")).where("term IS NOT NULL").distinct()


def term_file(spark: SparkSession, path: str) -> DataFrame:
    """Terms of a file, one to a line."""
    return spark.read.text(path).select(F.col("value").alias("term"))


def replay(terms: DataFrame, run: Callable[[str], object]) -> Iterator[tuple[str, float]]:
    """Runs each term's search, one after the other, and gives the seconds it took."""
    for row in terms.toLocalIterator():
        began = time.monotonic()
        run(row["term"])
        yield row["term"], time.monotonic() - began
