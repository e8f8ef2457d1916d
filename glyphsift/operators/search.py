"""Exact, approximate and boolean search over equations(doi, eqnID, tokens, canon), and shaping of what it finds."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import decode_doi, encode_doi
from ..functions.tokens import framed
from ..plans import compile as plan
from ..plans.query import Atom, Preprocess, Query, QueryParseError, parse, preprocess, to_string
from ..shared import checkpointed, fresh
from . import postings


class SearchError(Exception):
    """An answer that is an error element."""


class ArgParseError(SearchError):
    pass


class LimitExceeded(SearchError):
    pass


class TimedOut(SearchError):
    pass


class MetadataMissing(KeyError):
    """A document that was found has no metadata: the tables don't belong together."""


#: Equations found, of some 100 bytes, up to which they are broadcast to the metadata.
BROADCAST_HITS = 100_000


def equations(rows: DataFrame, tokens: Column) -> DataFrame:
    """Adds tokens and their framed form. Kept as a table, it is what searches scan: tokenising is paid once."""
    return rows.withColumn("tokens", tokens).withColumn("canon", framed(F.col("tokens")))


def suffixes(eqs: DataFrame) -> DataFrame:
    """A row for each position of each sequence, with the tokens from there on."""
    at = eqs.select("*", F.posexplode("tokens").alias("pos", "token"))
    return at.withColumn("suffix", F.slice("tokens", F.col("pos") + 1, F.size("tokens"))).drop("token")


def find_exact(eqs: DataFrame, tokens: list[str]) -> DataFrame:
    """Sequences that hold the run of tokens, at distance 0. Those without tokens are never found."""
    return eqs.where((F.size("tokens") > 0) & plan.contains_run(F.col("canon"), tokens)).withColumn("distance", F.lit(0))


def find_query(eqs: DataFrame, query: Query, precision: float, method: str = "native", index: DataFrame | None = None) -> DataFrame:
    """Sequences similar to a query, with their distance: candidates first, as those tests are cheap, then the
    distance of what is left. With an index (see postings) only sequences that it doesn't rule out are looked at."""
    if index is not None:
        eqs = postings.narrowed(eqs, index, query, precision)
    near = eqs.where((F.size("tokens") > 0) & plan.gather(query, precision, F.col("canon")))
    return near.withColumn("distance", plan.similar(query, precision, F.col("tokens"), method, F.col("canon"))).where(F.col("distance").isNotNull())


def find_approx(eqs: DataFrame, tokens: list[str], precision: float, method: str = "native") -> DataFrame:
    return find_query(eqs, Atom(tuple(tokens), ""), precision, method)


def collate(hits: DataFrame) -> DataFrame:
    """Hits by document: (doi, count, best, equations), the last ordered by distance, then eqnID. The document
    with the empty key is a dummy and goes."""
    found = hits.where("doi <> ''").groupBy("doi").agg(F.array_sort(F.collect_list(F.struct("distance", "eqnID"))).alias("equations"))
    return found.select("doi", F.size("equations").cast("bigint").alias("count"), F.get("equations", F.lit(0))["distance"].alias("best"), "equations")


def guard(docs: DataFrame, limit: int) -> int:
    """The number of documents; raises LimitExceeded if it is over the limit. docs are counted, so they should be at hand."""
    n = docs.count()
    if n > limit:
        raise LimitExceeded(limit)
    return n


def filters(
    containers: list[str] | None = None, dois: list[str] | None = None, before: str | None = None, after: str | None = None
) -> Column:
    """Condition on documents joined with metadata. Years are strings and compare as such, both bounds
    inclusive; a document without the field that a filter asks for doesn't pass."""
    found = F.lit(True)
    if containers is not None:
        found &= F.col("containerID").isin(containers)
    if dois is not None:
        found &= decode_doi(F.col("doi")).isin(dois)
    if before is not None:
        found &= F.col("publicationYear") <= before
    if after is not None:
        found &= F.col("publicationYear") >= after
    return F.coalesce(found, F.lit(False))


def ranked(docs: DataFrame, start: int = 0, count: int | None = None) -> DataFrame:
    """Documents by best distance, ties by descending key, without the first `start` and at most count."""
    found = docs.orderBy(F.asc("best"), F.desc(encode_doi(F.col("doi")))).offset(start)
    # Spark counts an offset and a limit together in 32 bits.
    return found if count is None or start + count >= 1 << 31 else found.limit(count)


@dataclass(frozen=True)
class Arguments:
    """A search's arguments, with the service's defaults; text is taken for any, as from a query string."""

    searchTerm: str
    searchTimeout: float = 10.0
    limit: int = 1000
    start: int = 0
    count: int = 1 << 31
    precision: float = 0.7
    containerID: str | None = None
    doi: str | None = None
    publishedBefore: str | None = None
    publishedAfter: str | None = None

    @classmethod
    def of(cls, given: dict) -> Arguments:
        try:
            known = {k: given[k] for k in cls.__dataclass_fields__ if k in given}
            kinds = {"searchTimeout": float, "precision": float, "limit": int, "start": int, "count": int}
            return cls(**{k: kinds[k](v) if k in kinds else v for k, v in known.items()})
        except (TypeError, ValueError) as e:
            raise ArgParseError(str(e)) from e


def search(
    eqs: DataFrame, metadata: DataFrame, args: Arguments, preprocess: Preprocess = preprocess, method: str = "native", index: DataFrame | None = None
) -> tuple[Query, DataFrame]:
    """The query, and (doi, format, count, best, equations) of its page of results.

    The corpus is searched once: what is found is checkpointed, and counted against the limit, which holds before filters
    and paging. It is broadcast to the metadata up to BROADCAST_HITS equations, and shuffled beyond. A document
    without metadata is an error, MetadataMissing.
    """
    query = parse(args.searchTerm, preprocess)
    docs = checkpointed(collate(find_query(eqs, query, args.precision, method, index)))
    n = guard(docs, args.limit)
    few = n <= BROADCAST_HITS and (docs.agg(F.sum("count")).first()[0] or 0) <= BROADCAST_HITS
    split = lambda s: None if s is None else s.split(",")
    joined = checkpointed(metadata.select("doi", "containerID", "format", "publicationYear").join(F.broadcast(docs) if few else docs, "doi"))
    if joined.select("doi").distinct().count() < n:
        raise MetadataMissing(docs.join(fresh(joined), "doi", "left_anti").first()["doi"])
    kept = joined.where(filters(split(args.containerID), split(args.doi), args.publishedBefore, args.publishedAfter))
    return query, ranked(kept.select("doi", "format", "count", "best", "equations"), args.start, args.count)


def with_timeout(spark, seconds: float, action):
    """Runs action; its Spark jobs are cancelled after so many seconds (0: never), which raises TimedOut."""
    if seconds <= 0:
        return action()
    sc = spark.sparkContext
    group, late = f"search-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        sc.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    sc.setJobGroup(group, "search", interruptOnCancel=True)
    timer.start()
    try:
        return action()
    except Exception:
        if late.is_set():
            raise TimedOut(seconds) from None
        raise
    finally:
        timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)


def results_xml(query: Query, rows: list) -> str:
    """A page of results as an XML element."""
    found = [f"<results><query>{escape(to_string(query))}</query>"]
    for r in rows:
        key = r["doi"].replace("_", "/", 1)
        hits = "".join(f'<equation distance="{e["distance"]}" id={quoteattr(e["eqnID"])}/>' for e in r["equations"])
        found.append(f'<{r["format"]} doi={quoteattr(key)} count="{r["count"]}">{hits}</{r["format"]}>')
    return "".join(found) + "</results>"


def answer(eqs: DataFrame, metadata: DataFrame, given: dict, preprocess: Preprocess = preprocess, index: DataFrame | None = None) -> dict:
    """What the service answers to a request's arguments: code, headers and an XML body, or just code 500."""
    xml = lambda body: {"code": 200, "headers": {"Content-type": "text/xml"}, "body": body}
    try:
        if "searchTerm" not in given:
            raise ArgParseError("searchTerm")
        args = Arguments.of(given)
        query, rows = with_timeout(eqs.sparkSession, args.searchTimeout, lambda: (lambda q, d: (q, d.collect()))(*search(eqs, metadata, args, preprocess, index=index)))
        return xml(results_xml(query, rows))
    except QueryParseError:
        return xml("<QueryParseError/>")
    except SearchError as e:
        return xml(f"<{type(e).__name__}/>")
    except Exception:
        return {"code": 500}


def with_sources(results: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each equation of the results, of chapters too, with its source where sources(doi, eqnID, source)
    has one."""
    rows = results.select("doi", "format", F.explode("equations").alias("e")).select("doi", "format", "e.eqnID", "e.distance")
    return rows.join(sources, ["doi", "eqnID"], "left")
