"""Token sequences as values: order, prefixes, fragments, cutoff and distance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST, MOST = 1, 5


def compare_suffix(a: Column, at_a: Column, b: Column, at_b: Column) -> Column:
    """-1, 0 or 1 as a's tokens from at_a (from 0) on come before, with or after b's from at_b on; a proper
    prefix comes first."""
    x, y = F.slice(a, at_a + 1, F.greatest(F.size(a) - at_a, F.lit(0))), F.slice(b, at_b + 1, F.greatest(F.size(b) - at_b, F.lit(0)))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def is_prefix(query: Column, tokens: Column, at: Column) -> Column:
    """Whether query stands in tokens at position `at` (from 0)."""
    return F.slice(tokens, at + 1, F.size(query)) == query


def cutoff(precision: float, n: int) -> int:
    """What a distance must stay below for a query of n tokens."""
    return max(LEAST, min(MOST, math.ceil((1.0 - precision) * n)))


def cutoff_column(precision: Column, n: Column) -> Column:
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.ceil((F.lit(1.0) - precision.cast("double")) * n))).cast("int")


def fragments(tokens: list, k: int) -> list[list]:
    """k runs of nearly equal lengths, the longer ones first; at most one for each token."""
    size, longer = divmod(len(tokens), k)
    found, at = [], 0
    while at < len(tokens):
        n = size + (len(found) < longer)
        found.append(tokens[at : at + n])
        at += n
    return found


def fragments_column(tokens: Column, k: Column) -> Column:
    n, runs = F.size(tokens), F.least(k, F.size(tokens))
    size, longer = F.floor(n / k).cast("int"), n % k
    start = lambda i: i * size + F.least(i, longer)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.slice(tokens, (start(i) + 1).cast("int"), (size + (i < longer).cast("int")).cast("int")))).otherwise(F.array().cast("array<array<string>>"))


def substring_distance(query: list, tokens: list) -> int:
    """Least edit distance between query and any run of tokens, by dynamic programming."""
    column = list(range(len(query) + 1))
    best = column[-1]
    for t in tokens:
        above, column[0] = column[0], 0
        for j, q in enumerate(query, 1):
            above, column[j] = column[j], min(column[j] + 1, column[j - 1] + 1, above + (q != t))
        best = min(best, column[-1])
    return best


def _bit_parallel(query: list[str], tokens: list[str]) -> int:
    """The same, a query's column of differences in the bits of two integers."""
    m = len(query)
    if not m or not len(tokens):
        return m
    peq: dict[str, int] = {}
    for i, q in enumerate(query):
        peq[q] = peq.get(q, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for t in tokens:
        eq = peq.get(t, 0)
        same = eq | minus
        carry = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(carry | plus) & full, plus & carry
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(same | up) & full, up & same
        best = min(best, score)
    return best


def distance(query: list[str] | Column, tokens: Column, method: str = "native") -> Column:
    """substring_distance() for columns. Native, a row of the table is carried over the tokens by aggregate();
    "arrow" runs a bit-parallel form on Arrow batches, for long queries. Null tokens give null."""
    if method == "arrow":
        pattern = list(query)

        @F.pandas_udf("int")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield s.map(lambda t: None if t is None else _bit_parallel(pattern, t)).astype("Int32")

        return run(tokens)
    q = query if isinstance(query, Column) else F.array(*map(F.lit, query)).cast("array<string>")
    m = len(query) if not isinstance(query, Column) else F.size(query)
    if isinstance(m, int) and not m:
        return F.when(tokens.isNotNull(), 0).cast("int")
    m = F.lit(m) if isinstance(m, int) else m
    row = F.when(m > 0, F.transform(F.sequence(F.lit(0), m), lambda j: j)).otherwise(F.array(F.lit(0)))
    start = F.struct(row.alias("row"), m.cast("int").alias("best"))

    def step(acc: Column, t: Column) -> Column:
        cell = lambda new, j: F.least(F.element_at(new, -1) + 1, F.get(acc["row"], j) + 1, F.get(acc["row"], j - 1) + F.when(F.get(q, j - 1) == t, 0).otherwise(1))
        js = F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
        new = F.aggregate(js, F.array(F.lit(0)), lambda new, j: F.concat(new, F.array(cell(new, j))))
        # One more lambda names the new row, which otherwise would be computed wherever it is used.
        return F.aggregate(F.array(new), acc, lambda a, r: F.struct(r.alias("row"), F.least(a["best"], F.element_at(r, -1)).alias("best")))

    return F.aggregate(tokens, start, step, lambda a: a["best"])
