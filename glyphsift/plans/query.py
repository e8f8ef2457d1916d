"""The query language: quoted fragments, AND, OR and parentheses.

    query := expr end        expr := atom [AND expr | OR expr]        atom := "(" expr ")" | quoted

AND and OR bind alike and to the right. There is no NOT, and words outside quotes are errors.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from ..functions import latex
from ..functions.sequences import cutoff, fragments, substring_distance


class QueryParseError(ValueError):
    """The search term is no query, or a fragment of it can't be turned into tokens."""


@dataclass(frozen=True)
class Atom:
    tokens: tuple[str, ...]
    plain: str


@dataclass(frozen=True)
class And:
    left: Query
    right: Query


@dataclass(frozen=True)
class Or:
    left: Query
    right: Query


Query = Atom | And | Or
Preprocess = Callable[[str], tuple[list[str], str]]


def preprocess(fragment: str) -> tuple[list[str], str]:
    """Tokens and canonical text of a fragment in LaTeX; BadLatex where its braces don't match."""
    nodes = latex.parse(fragment)
    return latex.flat(nodes), latex.canonical(nodes)


def words(text: str) -> list[str]:
    """Quoted strings, parentheses, AND, OR and whatever else isn't just spaces."""
    return [w for w in re.split(r'("[^"]*"|\(|\)|AND|OR)', text) if w.strip(" ")]


def parse(text: str, preprocess: Preprocess = preprocess) -> Query:
    left = words(text)[::-1]

    def atom() -> Query:
        w = left.pop() if left else ""
        if w == "(":
            q = expr()
            if not left or left.pop() != ")":
                raise QueryParseError(f"parenthesis left open: {text}")
            return q
        if len(w) < 2 or w[0] != '"' or w[-1] != '"':
            raise QueryParseError(f"quoted fragment expected: {text}")
        tokens, shown = preprocess(w[1:-1])
        return Atom(tuple(tokens), shown)

    def expr() -> Query:
        q = atom()
        if left and left[-1] in ("AND", "OR"):
            kind = And if left.pop() == "AND" else Or
            return kind(q, expr())
        return q

    try:
        found = expr()
    except QueryParseError:
        raise
    except Exception as e:
        raise QueryParseError(str(e)) from e
    if left:
        raise QueryParseError(f"more after the query: {text}")
    return found


def to_string(q: Query) -> str:
    if isinstance(q, Atom):
        return f'"{q.plain}"'
    return f"({to_string(q.left)} {'AND' if isinstance(q, And) else 'OR'} {to_string(q.right)})"


def distance(q: Query, tokens: list[str]) -> int:
    """Greater of both sides for AND, lesser for OR; without cutoff."""
    if isinstance(q, Atom):
        return substring_distance(list(q.tokens), tokens)
    return (max if isinstance(q, And) else min)(distance(q.left, tokens), distance(q.right, tokens))


def similar(q: Query, precision: float, tokens: list[str]) -> int | None:
    """The distance where it stays below the cutoff of each fragment that counts, else None."""
    if isinstance(q, Atom):
        d = substring_distance(list(q.tokens), tokens)
        return d if d < cutoff(precision, len(q.tokens)) else None
    sides = [similar(q.left, precision, tokens), similar(q.right, precision, tokens)]
    known = [d for d in sides if d is not None]
    if isinstance(q, And):
        return max(known) if len(known) == 2 else None
    return min(known, default=None)


def gathers(q: Query, precision: float, tokens: list[str]) -> bool:
    """Whether some fragment of an atom stands in tokens; for AND of both sides, for OR of either."""
    if isinstance(q, Atom):
        parts = fragments(list(q.tokens), cutoff(precision, len(q.tokens)))
        return any(tokens[i : i + len(p)] == p for p in parts for i in range(len(tokens) - len(p) + 1))
    sides = (gathers(q.left, precision, tokens), gathers(q.right, precision, tokens))
    return all(sides) if isinstance(q, And) else any(sides)
