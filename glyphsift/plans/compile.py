"""Queries as column expressions: a cheap filter that loses nothing, and the distance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.sequences import cutoff, distance, fragments
from ..functions.tokens import SEPARATOR
from .query import And, Atom, Query


def contains_run(canon: Column, run: list[str]) -> Column:
    """Whether a run of tokens stands in a framed sequence; any sequence with tokens holds the empty run."""
    return canon.contains(SEPARATOR + SEPARATOR.join(run) + SEPARATOR) if run else F.length(canon) > 2 * len(SEPARATOR)


def gather(q: Query, precision: float, canon: Column) -> Column:
    """Candidates. A query within distance d < k of a sequence, cut into k fragments, leaves one of them whole,
    so that substring tests, which Parquet scans take over, pass all that can match. An atom without tokens
    has no fragment and passes nothing."""
    if isinstance(q, Atom):
        parts = fragments(list(q.tokens), cutoff(precision, len(q.tokens)))
        return reduce(lambda a, b: a | b, (contains_run(canon, p) for p in parts), F.lit(False))
    left, right = gather(q.left, precision, canon), gather(q.right, precision, canon)
    return left & right if isinstance(q, And) else left | right


def similar(q: Query, precision: float, tokens: Column, method: str = "native", canon: Column | None = None) -> Column:
    """Distance of a sequence, null where it isn't similar. AND takes the greater of two that are, OR the lesser
    of those that are. With the framed form a query that must stand there as it is costs just a substring test."""
    if isinstance(q, Atom):
        k = cutoff(precision, len(q.tokens))
        if k == 1 and canon is not None and q.tokens:
            return F.when(contains_run(canon, list(q.tokens)), 0)
        d = distance(list(q.tokens), tokens, method)
        return F.when(d < k, d)
    left, right = similar(q.left, precision, tokens, method, canon), similar(q.right, precision, tokens, method, canon)
    return F.when(left.isNotNull() & right.isNotNull(), F.greatest(left, right)) if isinstance(q, And) else F.least(left, right)


def whole_distance(q: Query, tokens: Column, method: str = "native") -> Column:
    """Distance without cutoff: the greater of both sides for AND, the lesser for OR."""
    if isinstance(q, Atom):
        return distance(list(q.tokens), tokens, method)
    left, right = whole_distance(q.left, tokens, method), whole_distance(q.right, tokens, method)
    return F.greatest(left, right) if isinstance(q, And) else F.least(left, right)
