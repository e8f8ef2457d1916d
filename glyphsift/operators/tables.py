"""Maintenance of documents(doi, type, format, containerID, publicationYear, source, content) and of what derives from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A document's stored form, and a change of the feed.
DOCUMENT = "doi STRING, type STRING, format STRING, containerID STRING, publicationYear STRING, source MAP<STRING, STRING>, content MAP<STRING, ARRAY<STRING>>"
FULL, META = "xml", "xml.meta"


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key in the given order, by aggregation: partial maxima go over the network, not rows
    of a key to sort."""
    others = [c for c in rows.columns if c not in keys]
    named = [c.alias(f"_{i}") for i, c in enumerate(order)]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*named)).alias("_row"))
    return best.select(*keys, *(F.col("_row")[c].alias(c) for c in others)).select(*rows.columns)


def dedupe_equations(rows: DataFrame) -> DataFrame:
    """Of a document's equations (doi, eqnID, ord, source) with one source the last by ord stays."""
    return latest(rows, ["doi", "source"], F.col("ord"), F.col("eqnID"))


def stored_document(rows: DataFrame, tokens: Callable[[Column], Column], keys: list[str]) -> DataFrame:
    """Documents from their equations: keys, and the maps source and content. Equations whose tokens come out
    null stay in source only."""
    got = dedupe_equations(rows).withColumn("tokens", tokens(F.col("source")))
    pair = lambda v: F.struct("eqnID", v)
    kept = F.filter(F.collect_list(F.when(F.col("tokens").isNotNull(), pair("tokens"))), lambda x: x.isNotNull())
    return got.groupBy(*keys).agg(F.map_from_entries(F.collect_list(pair("source"))).alias("source"), F.map_from_entries(kept).alias("content"))


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """stored with incoming put in: what is new or replaces a document, but metadata never replace a full
    document. Of several incoming documents with one key a full one stays, else the largest row."""
    incoming = latest(incoming, ["doi"], F.col("type") == FULL, F.struct(*(c for c in incoming.columns if not incoming.schema[c].dataType.typeName() == "map")))
    blocked = incoming.where(F.col("type") == META).join(stored.where(F.col("type") == FULL), "doi", "left_semi").select("doi")
    applied = incoming.join(blocked, "doi", "left_anti")
    return stored.join(applied.select("doi"), "doi", "left_anti").unionByName(applied)


def delete(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """stored without the articles that gone(doi, type) names; a deletion by metadata leaves full documents, and
    chapters always stay."""
    g = gone.select(F.col("doi").alias("gone_doi"), F.col("type").alias("gone_type")).distinct()
    hit = (F.col("doi") == F.col("gone_doi")) & (F.col("format") == "Article") & ~((F.col("gone_type") == META) & (F.col("type") == FULL))
    return stored.join(g, hit, "left_anti")


def newest(rows: DataFrame) -> DataFrame:
    """Of each id of rows(id, key, doc) the one with the highest key; of two with it the one without a document."""
    return latest(rows.select("id", "key", "doc"), ["id"], F.col("key"), F.col("doc").isNull())


def reduced(updates: DataFrame) -> DataFrame:
    """What updates(key, id, deleted, doc) amount to as stored rows; a deletion, and a change without a document, is one
    without a document, which stays as the id's last word."""
    return newest(updates.select("id", "key", F.when(~F.col("deleted"), F.col("doc")).alias("doc")))


def live(rows: DataFrame) -> DataFrame:
    return rows.where("doc IS NOT NULL")


def apply_feed(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """stored(id, key, doc) after updates(key, id, deleted, doc): of each id the change with the highest key
    counts, unless the stored one is later. Removed ids stay without a document, so that an earlier change that
    comes late doesn't bring them back; live() leaves them out."""
    return newest(stored.select("id", "key", "doc").unionByName(reduced(updates)))


def metadata(documents: DataFrame) -> DataFrame:
    """A document's row of metadata, with its number of equations."""
    return documents.select("doi", "containerID", "format", "publicationYear", F.coalesce(F.size(F.map_keys("content")), F.lit(0)).alias("no_eqns"))


def equation_rows(documents: DataFrame) -> DataFrame:
    """(doi, eqnID, tokens) of every equation with content."""
    return documents.select("doi", F.explode("content").alias("eqnID", "tokens"))


def list_all(meta: DataFrame) -> tuple[DataFrame, int]:
    """Documents by key, and the sum of their equations."""
    return meta.select("doi", "containerID", "no_eqns").orderBy("doi"), meta.agg(F.coalesce(F.sum("no_eqns"), F.lit(0))).first()[0]


def list_one(meta: DataFrame, doi: str) -> DataFrame:
    """A document's row; none if it isn't indexed."""
    return meta.where(F.col("doi") == doi).select("doi", "containerID", "no_eqns")


def reprocess(documents: DataFrame, tokens: Callable[[Column], Column]) -> DataFrame:
    """Content anew from source; what can't be processed is left out."""
    content = F.map_filter(F.transform_values("source", lambda _, s: tokens(s)), lambda _, t: t.isNotNull())
    return documents.withColumn("content", content)


def rename_field(documents: DataFrame, old: str = "journalID", new: str = "containerID") -> DataFrame:
    """The old field under the new name, where the new one is null."""
    if old not in documents.columns:
        return documents
    given = F.coalesce(F.col(old), F.col(new)) if new in documents.columns else F.col(old)
    return documents.withColumn(new, given).drop(old)


def check_years(documents: DataFrame, years: DataFrame) -> DataFrame:
    """Documents with the year of years(doi, year) where that is another, and year_status: same, changed, missing."""
    found = documents.join(years.select("doi", F.substring("year", 1, 4).alias("_year")), "doi", "left")
    status = F.when(F.col("_year").isNull(), "missing").when(F.col("_year").eqNullSafe(F.col("publicationYear")), "same").otherwise("changed")
    return found.withColumn("year_status", status).withColumn("publicationYear", F.coalesce("_year", "publicationYear")).drop("_year")


def repair(documents: DataFrame, other: DataFrame) -> DataFrame:
    """Documents with the other store's values where it has the key."""
    o = other.select(*(F.col(c).alias(f"_{c}") if c != "doi" else F.col(c) for c in documents.columns), F.lit(True).alias("_there"))
    return documents.join(o, "doi", "left").select(*(F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c != "doi" else F.col(c) for c in documents.columns))


def monitor(terms: DataFrame, stored: DataFrame, observed: DataFrame) -> DataFrame:
    """(term, before, now, status, baseline) of each term: error where the count fell or there is none now, info
    where it rose, which moves the baseline, else ok; new where nothing was stored."""
    got = terms.select("term").distinct().join(stored.select("term", F.col("n").alias("before")), "term", "left").join(observed.select("term", F.col("n").alias("now")), "term", "left")
    status = F.when(F.col("now").isNull(), "error").when(F.col("before").isNull(), "new").when(F.col("now") < F.col("before"), "error").when(F.col("now") > F.col("before"), "info").otherwise("ok")
    return got.withColumn("status", status).withColumn("baseline", F.when(F.col("status").isin("info", "new"), F.col("now")).otherwise(F.col("before")))
