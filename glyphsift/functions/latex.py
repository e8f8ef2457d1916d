"""Formulae as trees of commands and text, and what clients see of them: tokens, nested JSON, canonical text.

A command has its arguments, braced or not, and an environment what is in it. Braces of their own, `$`, `&` and white
space leave no node; nor do the commands of IGNORED, whose arguments stand for themselves. What the tree differs
in from that of a full TeX engine is told in functions/tokens.py.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import ACTIVE, BRACKETED, COLUMNS, COMMENT, IGNORED, LEXEME, SPACING

#: Fixed values of LaTeX: how many arguments commands have. Those that begin with "text" have one.
ARGUMENTS = {
    2: "frac dfrac tfrac cfrac binom dbinom tbinom stackrel overset underset".split(),
    1: (
        "sqrt xrightarrow xleftarrow hat check breve acute grave tilde bar vec dot ddot dddot widehat widetilde overline underline overbrace underbrace overrightarrow overleftarrow "
        "mathrm mathbf mathit mathcal mathbb mathfrak mathsf mathtt mathscr boldsymbol pmb bm operatorname mbox hbox fbox phantom vphantom hphantom substack"
    ).split(),
}
FORMS = T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("json", T.StringType()), T.StructField("plain", T.StringType())])
ARITY = {name: n for n, names in ARGUMENTS.items() for name in names}


class BadLatex(ValueError):
    """Braces or environments that don't match."""


@dataclass
class Node:
    name: str
    #: Each argument, and an environment's content, as a list of nodes and of strings.
    parts: list[list[Node | str]] = field(default_factory=list)


def _ends(part: str) -> bool:
    return part == "}" or part.startswith("\\end") and part.endswith("}")


def _environment(part: str) -> str:
    return part[part.index("{") + 1 : -1]


class _Reader:
    def __init__(self, text: str) -> None:
        for pattern, to in (COMMENT, COLUMNS, SPACING):
            text = re.sub(pattern, to.replace("$", "\\"), text, flags=re.ASCII)
        self.left = re.findall(LEXEME, text, re.ASCII)[::-1]

    def until(self, brace: bool = False, environment: str | None = None) -> list[Node | str]:
        """Nodes up to the end of a group or an environment, which is taken as well, or of everything."""
        found: list[Node | str] = []
        while self.left:
            part = self.left.pop()
            if _ends(part):
                if brace and part == "}" or environment is not None and part != "}" and _environment(part) == environment:
                    return found
                raise BadLatex(f"{part} ends nothing that is open")
            found += self.item(part)
        if brace or environment is not None:
            raise BadLatex("the formula ends within " + ("braces" if brace else str(environment)))
        return found

    def item(self, part: str) -> list[Node | str]:
        if part == "{":
            return self.until(brace=True)
        if part in ACTIVE:
            return [Node(ACTIVE[part], self.arguments(1 if part in "^_" else 0))]
        if part[0] != "\\":
            return [part]
        if part.startswith("\\text") and "{" in part:
            name, _, run = part[1:].partition("{")
            return self.made(name.strip(), [[run] * bool(run) + self.until(brace=True)])
        if part.startswith("\\begin") and part.endswith("}"):
            return self.made(_environment(part), [self.until(environment=_environment(part))])
        optional = self.bracketed() if part[1:] in BRACKETED else []
        return self.made(part[1:], optional + self.arguments(ARITY.get(part[1:], 0)))

    def made(self, name: str, parts: list[list[Node | str]]) -> list[Node | str]:
        return [x for p in parts for x in p] if name in IGNORED or not name else [Node(name, parts)]

    def arguments(self, n: int) -> list[list[Node | str]]:
        found = []
        while len(found) < n and self.left and not _ends(self.left[-1]):
            found.append(self.item(self.left.pop()))
        return found

    def bracketed(self) -> list[list[Node | str]]:
        """An optional argument, if it is closed before the braces about it are."""
        if not self.left or self.left[-1] != "[":
            return []
        depth = 0
        for k in range(len(self.left) - 2, -1, -1):
            part = self.left[k]
            depth += (part == "{" or part.startswith("\\text") and "{" in part) - (part == "}")
            if depth < 0:
                break
            if part == "]" and not depth:
                inner, self.left = self.left[k + 1 : -1], self.left[:k]
                reader = _Reader("")
                reader.left = inner
                return [reader.until()]
        return []


def parse(text: str | None) -> list[Node | str]:
    """A formula's nodes; BadLatex where braces or environments don't match."""
    return _Reader(text or "").until()


def flat(nodes: list[Node | str]) -> list[str]:
    """Tokens in document order, a command before what it has."""
    found = []
    for x in nodes:
        found += [f"T:{x}"] if isinstance(x, str) else [f"C:{x.name}", *(t for p in x.parts for t in flat(p))]
    return found


def nested(nodes: list[Node | str]) -> list:
    """Strings, and for each command an object with the list of what it has."""
    return [x if isinstance(x, str) else {x.name: [y for p in x.parts for y in nested(p)]} for x in nodes]


def canonical(nodes: list[Node | str]) -> str:
    """Text in which parts are one space apart: commands with a backslash, active characters as they are, and each argument in
    braces; an only one that is empty is left out."""
    names = {v: k for k, v in ACTIVE.items()}

    def shown(nodes: list[Node | str]) -> Iterator[str]:
        for x in nodes:
            if isinstance(x, str):
                yield x
                continue
            yield names.get(x.name, "\\" + x.name)
            for p in x.parts:
                if p or len(x.parts) > 1:
                    yield from ("{", *shown(p), "}")

    return " ".join(shown(nodes))


def lex(text: str | None) -> list[str]:
    """Tokens of a formula, for query strings; tokens.latex_tokens() gives the same for columns."""
    return flat(parse(text))


def _forms(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        try:
            nodes = parse(text)
            rows.append((flat(nodes), json.dumps(nested(nodes), separators=(",", ":"), ensure_ascii=False), canonical(nodes)))
        except (BadLatex, RecursionError):
            rows.append((None, None, None))
    return pd.DataFrame(rows, columns=["tokens", "json", "plain"])


def forms(text: Column) -> Column:
    """Tokens, nested JSON and canonical text of formulae, by Arrow batches; all null where a formula is bad."""
    return F.pandas_udf(_forms, FORMS)(text)
