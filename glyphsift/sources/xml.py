"""Articles and book chapters from XML files."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, type string, doi string, format string, containerID string, publicationYear string, eqnID string, ord int, source string, error string"


def _text(node: ElementTree.Element | None) -> str | None:
    return None if node is None else "".join(node.itertext()).strip() or None


def _first(node: ElementTree.Element, *names: str) -> ElementTree.Element | None:
    """The first descendant with the first of the names that has one."""
    return next((x for n in names for x in node.iter(n)), None)


def _equations(node: ElementTree.Element) -> list[tuple[str | None, str]]:
    """Ids and sources in TeX: displayed equations, then those in lines; others are dropped."""
    found = []
    for kind in ("Equation", "InlineEquation"):
        for e in node.iter(kind):
            source = next((s for s in e.iter("EquationSource") if s.get("Format") == "TEX"), None)
            if (tex := _text(source)) is not None:
                found.append((e.get("ID"), tex))
    return found


def parse(data: str | bytes) -> list[dict]:
    """Documents of a file: every article, then the chapters of every book, which take its DOI as container and
    its copyright year."""
    root, found = ElementTree.fromstring(data), []
    for a in root.iter("Article"):
        date = _first(a, "PrintDate", "CoverDate", "OnlineDate")
        year = None if date is None else _text(_first(date, "Year"))
        found.append({"doi": _text(_first(a, "ArticleDOI")), "format": "Article", "containerID": _text(_first(a, "JournalID")), "publicationYear": year, "equations": _equations(a)})
    for b in root.iter("Book"):
        copyright_ = _first(b, "BookCopyright")
        year = None if copyright_ is None else _text(_first(copyright_, "CopyrightYear"))
        for c in b.iter("Chapter"):
            found.append({"doi": _text(_first(c, "ChapterDOI")), "format": "Chapter", "containerID": _text(_first(b, "BookDOI")), "publicationYear": year, "equations": _equations(c)})
    return found


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for path, kind, content in zip(batch["path"], batch["type"], batch["content"], strict=True):
            try:
                for d in parse(bytes(content)):
                    head = (path, kind, d["doi"], d["format"], d["containerID"], d["publicationYear"])
                    rows += [(*head, i, k, s, None) for k, (i, s) in enumerate(d["equations"])] or [(*head, None, None, None, None)]
            except ElementTree.ParseError as e:
                rows.append((path, kind, *[None] * 7, str(e)))
        found = pd.DataFrame(rows, columns=columns)
        yield found.assign(ord=found["ord"].astype("Int32"))


def rows(files: DataFrame) -> DataFrame:
    """The rows of files(path, type, content), as read() gives them."""
    return files.select("path", "type", "content").mapInPandas(_rows, SCHEMA)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, type, content) of the files under a folder that end in .xml or .xml.meta in any case, which is their type."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    low = F.lower("path")
    kind = F.when(low.endswith(".xml"), "xml").when(low.endswith(".xml.meta"), "xml.meta")
    return found.select("path", kind.alias("type"), "content").where("type IS NOT NULL")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each equation of each document under a folder, one without an equation for documents that have
    none, and one with just path and error for a file that can't be parsed."""
    return rows(files(spark, folder))


def flat_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles by Spark's own XML reader, a row for each with its elements as columns."""
    return spark.read.format("xml").option("rowTag", "Article").load(path)
