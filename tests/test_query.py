"""The query language, cutoffs, fragments and distances, without Spark."""

import itertools
import random

import pytest

from glyphsift.functions.latex import BadLatex, canonical, lex, nested
from glyphsift.functions.latex import parse as parse_latex
from glyphsift.functions.sequences import _bit_parallel, cutoff, fragments, substring_distance
from glyphsift.plans.query import And, Atom, Or, QueryParseError, distance, gathers, parse, similar, to_string


def chars(s):
    return [*s], s


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ('"a"', '"a"'),
        ('"a" AND "b"', '("a" AND "b")'),
        ('"a" AND "b" OR "c"', '("a" AND ("b" OR "c"))'),
        ('"a" OR "b" AND "c"', '("a" OR ("b" AND "c"))'),
        ('("a" OR "b") AND "c"', '(("a" OR "b") AND "c")'),
        ('  ( ("a") )', '"a"'),
        ('"a"AND"b"', '("a" AND "b")'),
        ('"x AND (y"', '"x AND (y"'),
    ],
)
def test_parse(text, shown):
    assert to_string(parse(text, chars)) == shown


@pytest.mark.parametrize("text", ["", "a", '"a', '"a" "b"', '"a" and "b"', '("a"', '"a")', '"a" AND', 'AND "a"', '"a"\t', '"a" NOT "b"', "()"])
def test_parse_errors(text):
    with pytest.raises(QueryParseError):
        parse(text, chars)


def test_preprocessor_failure_is_a_parse_error():
    def fail(_):
        raise RuntimeError

    with pytest.raises(QueryParseError):
        parse('"a"', fail)


def test_cutoff():
    assert [cutoff(0.7, n) for n in range(15)] == [1, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4, 4, 5]
    assert cutoff(1.0, 100) == 1
    assert cutoff(-3, 100) == cutoff(0, 100) == 5


def test_fragments():
    assert fragments([*"abcdefg"], 3) == [[*"abc"], [*"de"], [*"fg"]]
    assert fragments([], 3) == []
    assert fragments([*"ab"], 5) == [["a"], ["b"]]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance_is_the_least_over_substrings():
    r = random.Random(1)
    for _ in range(600):
        q, t = ([r.choice("abc") for _ in range(r.randrange(n))] for n in (7, 10))
        least = min(levenshtein(q, t[i:j]) for i, j in itertools.combinations_with_replacement(range(len(t) + 1), 2))
        assert substring_distance(q, t) == _bit_parallel(q, t) == least


def random_query(r):
    x = r.random()
    if x < 1 / 3:
        return (And if x < 1 / 6 else Or)(random_query(r), random_query(r))
    tokens = tuple(str(r.randrange(6)) for _ in range(r.randint(1, 5)))
    return Atom(tokens, " ".join(tokens))


def test_gather_loses_nothing():
    r = random.Random(2)
    for _ in range(3000):
        q, p = random_query(r), r.random()
        t = [str(r.randrange(6)) for _ in range(r.randint(1, 12))]
        if similar(q, p, t) is not None:
            assert gathers(q, p, t)


def test_compound_distance():
    q = parse('"ab" AND ("cd" OR "ef")', chars)
    assert distance(q, [*"abef"]) == 0
    assert distance(q, [*"abxx"]) == 2
    assert similar(q, 1.0, [*"abef"]) == 0
    assert similar(q, 1.0, [*"abxx"]) is None


def test_lexer():
    assert lex(r"{a}{b}") == lex("{ab}") == ["T:a", "T:b"]
    assert lex(r"\sum_{i=0}^n i") == ["C:sum", "C:active::_", "T:i", "T:=", "T:0", "C:active::^", "T:n", "T:i"]
    assert lex(r"\text{} \textit{} \hbox{x}") == ["C:textit", "T:x"]
    assert lex(None) == []


@pytest.mark.parametrize(
    ("formula", "tokens", "shown", "tree"),
    [
        (r"\frac{a}{b}^2", "C:frac T:a T:b C:active::^ T:2", r"\frac { a } { b } ^ { 2 }", [{"frac": ["a", "b"]}, {"active::^": ["2"]}]),
        (r"\frac12", "C:frac T:1 T:2", r"\frac { 1 } { 2 }", [{"frac": ["1", "2"]}]),
        (r"\frac{}{a}\hat{}", "C:frac T:a C:hat", r"\frac { } { a } \hat", [{"frac": ["a"]}, {"hat": []}]),
        (r"\sqrt[3]{x}", "C:sqrt T:3 T:x", r"\sqrt { 3 } { x }", [{"sqrt": ["3", "x"]}]),
        (r"\sqrt [n", "C:sqrt T:[ T:n", r"\sqrt { [ } n", [{"sqrt": ["["]}, "n"]),
        ("a % b {\n c \\% d", "T:a T:c C:% T:d", r"a c \% d", ["a", "c", {"%": []}, "d"]),
        (r"\text{a {b} c}d", "T:a  T:b T:c T:d", "a  b c d", ["a ", "b", "c", "d"]),
        (r"\textbf{if $x$}", "C:textbf T:if  T:x", r"\textbf { if  x }", [{"textbf": ["if ", "x"]}]),
        (r"\begin{array}{cc} x & y \\[2pt] z \end{array}", "T:x T:y C:\\ T:z", "x y \\\\ z", ["x", "y", {"\\": []}, "z"]),
        (r"\begin{pmatrix} 1 \end{pmatrix}_i", "C:pmatrix T:1 C:active::_ T:i", r"\pmatrix { 1 } _ { i }", [{"pmatrix": ["1"]}, {"active::_": ["i"]}]),
        (r"x^\frac a{b}c", "T:x C:active::^ C:frac T:a T:b T:c", r"x ^ { \frac { a } { b } } c", ["x", {"active::^": [{"frac": ["a", "b"]}]}, "c"]),
    ],
)
def test_formulae(formula, tokens, shown, tree):
    nodes = parse_latex(formula)
    assert " ".join(lex(formula)) == tokens
    assert canonical(nodes) == shown
    assert nested(nodes) == tree


@pytest.mark.parametrize("formula", ["{", "}", r"\frac{a}{b", "{a}}", r"\begin{align} x", r"\end{align}", r"\begin{a}\end{b}", r"{\begin{a}}\end{a}", r"\text{x", r"\sqrt[{]}]{x}}"])
def test_bad_formulae(formula):
    with pytest.raises(BadLatex):
        lex(formula)
    with pytest.raises(QueryParseError):
        parse(f'"{formula}"')
