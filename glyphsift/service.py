"""Requests and answers as JSON lines: search, preprocessing, and a client's search with sources."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import latex
from .operators import search


def requested(request: dict) -> dict:
    """A search's arguments, from a request's query string or else from the JSON in its body."""
    if "searchTerm" in request.get("query", {}):
        return request["query"]
    try:
        return dict(json.loads(request["body"]))
    except (KeyError, TypeError, ValueError) as e:
        raise search.ArgParseError(str(e)) from e


def answers(lines: Iterable[str], eqs: DataFrame, metadata: DataFrame, index: DataFrame | None = None, preprocess: search.Preprocess = search.preprocess) -> Iterator[str]:
    """An answer in compact JSON for each request, one to a line."""
    for line in lines:
        try:
            given = requested(json.loads(line))
        except (search.ArgParseError, ValueError):
            given = {}
        yield json.dumps(search.answer(eqs, metadata, given, preprocess, index), separators=(",", ":"))


def preprocess(request: dict) -> dict:
    """Nested JSON and canonical text of a request's fragment, in the format json, plain or json-plain. A missing
    argument or another format answers 400, a bad formula or anything else that fails 500."""
    text = lambda code, body: {"code": code, "body": body, "headers": {"Content-type": "text/plain"}}
    try:
        kind, nodes = request["query"]["format"], latex.parse(request["query"]["latex"])
        if kind == "json-plain":
            return {"code": 200, "json": {"json": latex.nested(nodes), "plain": latex.canonical(nodes)}}
        if kind == "json":
            return {"code": 200, "json": latex.nested(nodes)}
        return text(200, latex.canonical(nodes)) if kind == "plain" else text(400, "Error: bad format argument")
    except KeyError as e:
        return text(400, f"Error: {e}")
    except Exception as e:
        return text(500, f"Error: {e}")


def preprocessed(lines: Iterable[str]) -> Iterator[str]:
    """An answer in compact JSON for each request to preprocess, one to a line."""
    for line in lines:
        yield json.dumps(preprocess(json.loads(line)), separators=(",", ":"))


def preprocess_all(requests: DataFrame, column: str = "value") -> DataFrame:
    """(request, answer) of every request to preprocess, by Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"request": b["request"], "answer": list(preprocessed(b["request"]))})

    return requests.select(F.col(column).alias("request")).mapInPandas(run, "request string, answer string")


def client_search(eqs: DataFrame, metadata: DataFrame, sources: DataFrame, searchTerm: str, searchTimeout: float = 20.0, limit: int = 2500, precision: float = 0.7, index: DataFrame | None = None, preprocess: search.Preprocess = search.preprocess) -> dict:
    """Seconds taken, and the results with their equations' sources or the name of the error."""
    args, began = search.Arguments(searchTerm, float(searchTimeout), int(limit), precision=float(precision)), time.monotonic()
    try:
        rows = search.with_timeout(eqs.sparkSession, args.searchTimeout, lambda: search.with_sources(search.search(eqs, metadata, args, preprocess, index=index)[1], sources).collect())
    except (search.SearchError, search.QueryParseError) as e:
        return {"time": time.monotonic() - began, "error": type(e).__name__}
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["distance"], r["doi"], r["eqnID"])):
        found.setdefault(r["doi"], []).append((r["eqnID"], r["distance"], r["source"]))
    return {"time": time.monotonic() - began, "results": [*found.items()]}
