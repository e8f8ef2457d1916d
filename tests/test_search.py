"""Search against brute force, result shaping and the service's answers."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from glyphsift.functions import keys, latex, sequences, tokens
from glyphsift.operators import postings, search
from glyphsift.plans.query import And, Atom, Or, gathers, parse, similar


def random_query(r):
    x = r.random()
    if x < 1 / 3:
        return (And if x < 1 / 6 else Or)(random_query(r), random_query(r))
    t = tuple(str(r.randrange(8)) for _ in range(r.randint(0, 5)))
    return Atom(t, "")


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(3)
    rows = [(i, [str(r.randrange(8)) for _ in range(r.choice([0, 1, 3, 8, 30]))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    return rows, search.equations(df, F.col("t")).drop("t").cache()


def found(df):
    return sorted((r.id, r.distance) for r in df.select("id", "distance").collect())


@pytest.mark.parametrize("seed", range(8))
def test_find_query_is_brute_force(corpus, seed):
    rows, eqs = corpus
    r = random.Random(seed)
    q, p = random_query(r), r.choice([-0.5, 0.0, r.random(), 1.0, 1.5])
    want = sorted((i, d) for i, t in rows if t and gathers(q, p, t) and (d := similar(q, p, t)) is not None)
    assert found(search.find_query(eqs, q, p)) == want
    assert found(search.find_query(eqs, q, p, "arrow")) == want


def test_find_exact(corpus):
    rows, eqs = corpus
    q = rows[-1][1][:2] or ["1"]
    want = sorted((i, 0) for i, t in rows if any(t[k : k + len(q)] == q for k in range(len(t) - len(q) + 1)))
    assert found(search.find_exact(eqs, q)) == want == found(search.find_approx(eqs, q, 1.0))
    assert found(search.find_exact(eqs, [])) == sorted((i, 0) for i, t in rows if t)
    assert found(search.find_approx(eqs, [], 0.7)) == []


def test_every_sequence_finds_itself(corpus):
    rows, eqs = corpus
    for i, t in rows[:12]:
        assert not t or (i, 0) in found(search.find_approx(eqs, t, 0.7))


def test_similarity_join_is_search_for_each(spark, corpus):
    rows, eqs = corpus
    r = random.Random(4)
    queries = [(k, [str(r.randrange(8)) for _ in range(r.randint(0, 6))], r.choice([0.5, 0.7, 1.0])) for k in range(12)]
    df = spark.createDataFrame(queries, "query_id int, tokens array<string>, precision double")
    got = sorted(tuple(x) for x in postings.similarity_join(eqs, df, ["id"]).collect())
    q = lambda t: Atom(tuple(t), "")
    assert got == sorted((k, i, d) for k, t, p in queries for i, s in rows if s and gathers(q(t), p, s) and (d := similar(q(t), p, s)) is not None)


@pytest.mark.parametrize("seed", range(6))
def test_search_through_an_index(spark, corpus, seed):
    rows, eqs = corpus
    index = postings.laid_out(postings.postings(eqs, ["id"])).cache()
    r = random.Random(100 + seed)
    q, p = random_query(r), r.choice([0.0, r.random(), 0.7, 1.0])
    assert found(search.find_query(eqs, q, p, index=index)) == found(search.find_query(eqs, q, p))
    assert {x.id for x in postings.candidates(index, q, p).collect()} >= {i for i, t in rows if t and gathers(q, p, t)}


def test_join_with_long_sequences(spark, monkeypatch):
    r = random.Random(6)
    long = [str(r.randrange(3000)) for _ in range(100_000)]
    rows = [(1, long), (2, long[50_000:50_020]), (3, ["x"]), (4, None), (5, [])]
    eqs = search.equations(spark.createDataFrame(rows, "id int, t array<string>"), F.col("t")).drop("t")
    queries = [(1, long[70_000:70_030], 1.0), (2, [*long[50_002:50_010], "?", *long[50_011:50_015]], 0.7), (3, ["x"], 0.7), (4, [], 0.7), (5, ["none"], 1.0)]
    df = spark.createDataFrame(queries, "query_id int, tokens array<string>, precision double")
    want = [(1, 1, 0), (2, 1, 1), (2, 2, 1), (3, 3, 0)]
    run = lambda: sorted(tuple(x) for x in postings.similarity_join(eqs, df, ["id"]).collect())
    assert run() == want
    monkeypatch.setattr(postings, "BROADCAST_ROWS", 0)
    assert run() == want


def test_distance_of_columns_and_nulls(spark):
    df = spark.createDataFrame([(["a", "b"], ["x", "a", "c", "b"]), ([], ["a"]), (["a"], []), (["a"], None)], "q array<string>, t array<string>")
    assert [x[0] for x in df.select(sequences.distance(F.col("q"), F.col("t"))).collect()] == [1, 0, 1, None]


def random_formula(r, depth=0):
    out = []
    for _ in range(r.randint(0, 6)):
        x = r.random()
        inner = random_formula(r, depth + 1) if depth < 3 else "a"
        if x < 0.4:
            out.append(r.choice(["x", " ", "1", "\\alpha ", "\\{", "\\\\", "&", "$", "~", "%c {\n", "\\%", "[", "]", "\\rm ", "é", "\xa0"]))
        elif x < 0.9:
            out.append(r.choice(["{%s}", "\\frac{%s}{b}", "^{%s}", "_{%s}", "\\text{%s}", "\\textit {so %s}", "\\hat{%s}", "\\begin{align}%s\\end{align}", "\\begin{pmatrix} %s \\end {pmatrix}", "\\begin{array}{c}%s\\end{array}"]).replace("%s", inner))
        else:
            out.append(r.choice(["\\sqrt[3]{x}", "\\sqrt [a{b}]c", "\\\\sqrt[2]", "{", "}", "\\begin{a}", "\\end{a}", "\\frac", "\\\\[3pt]"]))
    return "".join(out)


def test_lexers_agree(spark):
    r = random.Random(5)
    formulae = [r"\frac{a}{b}", r"\text{a b}c\textbf {d}", r"\begin{array}{c} \{ x \} \\ y \end{array}", r"x_1^2~\,z", "", None, r"\mathord a \alpha12", "{" * 50 + "}" * 50]
    formulae += [random_formula(r) for _ in range(1500)]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(formulae)], "i int, f string")
    got = df.select("i", tokens.latex_tokens(F.col("f")).alias("t"), latex.forms(F.col("f")).alias("forms")).orderBy("i").collect()
    bad = 0
    for x in got:
        try:
            nodes = latex.parse(formulae[x.i])
        except latex.BadLatex:
            bad += 1
            assert (x.t, x.forms.tokens, x.forms.json, x.forms.plain) == (None, None, None, None), formulae[x.i]
            continue
        assert x.t == x.forms.tokens == latex.flat(nodes), formulae[x.i]
        assert (json.loads(x.forms.json), x.forms.plain) == (latex.nested(nodes), latex.canonical(nodes))
    assert 50 < bad < len(got) - 500


def test_keys(spark):
    df = spark.createDataFrame([("10.1/a/b_c",), ("x",), (None,), ("a_b/c",)], "k string")
    got = df.select(keys.encode_doi(F.col("k")), keys.decode_doi(F.col("k"))).collect()
    assert [tuple(x) for x in got] == [("10.1_a/b_c", "10.1/a/b/c"), ("x", "x"), (None, None), ("a_b_c", "a/b/c")]


@pytest.fixture(scope="module")
def service(spark):
    rows = [("10.1/a", "e1", "x^2"), ("10.1/a", "e2", "x^3"), ("10.1/b", "e1", "x^2+y"), ("10.1/c", "e1", "z"), ("", "e1", "x^2"), ("10.1/d", "e9", r"\alpha")]
    eqs = search.equations(spark.createDataFrame(rows, "doi string, eqnID string, source string"), tokens.latex_tokens(F.col("source")))
    meta = [("10.1/a", "J", "Article", "999"), ("10.1/b", None, "Chapter", "2001"), ("10.1/c", "K", "Article", None), ("10.1/d", "K", "Article", "2000")]
    return eqs.cache(), spark.createDataFrame(meta, "doi string, containerID string, format string, publicationYear string")


def test_answer(service):
    body = search.answer(*service, {"searchTerm": '"x^2"'})["body"]
    assert body == (
        '<results><query>"x ^ { 2 }"</query><Chapter doi="10.1/b" count="1"><equation distance="0" id="e1"/></Chapter>'
        '<Article doi="10.1/a" count="1"><equation distance="0" id="e1"/></Article></results>'
    )


@pytest.mark.parametrize(
    ("given", "names"),
    [
        ({"containerID": "J,K"}, ["10.1/a"]),
        ({"doi": "10.1/b,10.1/c"}, ["10.1/b"]),
        ({"publishedAfter": "2000"}, ["10.1/b", "10.1/a"]),
        ({"publishedBefore": "2001"}, ["10.1/b"]),
        ({"start": "1"}, ["10.1/a"]),
        ({"count": "1"}, ["10.1/b"]),
        ({"precision": "0.3"}, ["10.1/b", "10.1/a"]),
    ],
)
def test_filters_and_pages(service, given, names):
    _, rows = search.search(*service, search.Arguments.of({"searchTerm": '"x^2"', **given}))
    assert [r.doi for r in rows.collect()] == names


@pytest.mark.parametrize(
    ("given", "error"),
    [({"searchTerm": "x"}, "QueryParseError"), ({}, "ArgParseError"), ({"searchTerm": '"x"', "limit": "many"}, "ArgParseError"), ({"searchTerm": '"x^2"', "limit": "1", "containerID": "none"}, "LimitExceeded")],
)
def test_errors(service, given, error):
    assert search.answer(*service, given)["body"] == f"<{error}/>"


def test_timeout(spark):
    slow = F.udf(lambda x: time.sleep(20) or x, "long")
    with pytest.raises(search.TimedOut):
        search.with_timeout(spark, 1.0, lambda: spark.range(4).select(slow("id")).collect())


def test_missing_metadata_is_an_error(service):
    eqs, meta = service
    with pytest.raises(search.MetadataMissing):
        search.search(eqs, meta.where("doi <> '10.1/b'"), search.Arguments('"x^2"'))
    assert search.answer(eqs, meta.where("doi <> '10.1/b'"), {"searchTerm": '"x^2"'}) == {"code": 500}
    assert search.answer(eqs, meta, {"searchTerm": '"{x"'})["body"] == "<QueryParseError/>"


@pytest.mark.parametrize("bound", [0, 100_000])
def test_the_corpus_is_searched_once(service, spark, monkeypatch, bound):
    monkeypatch.setattr(search, "BROADCAST_HITS", bound)
    eqs, meta = service
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = eqs.mapInArrow(count, eqs.schema)
    _, rows = search.search(counted, meta, search.Arguments('"x^2"', publishedAfter="1"))
    assert [x.doi for x in rows.collect()] == ["10.1/b", "10.1/a"]
    assert seen.value == eqs.count()


def test_sources_of_chapters_too(service, spark):
    _, rows = search.search(*service, search.Arguments('"x^2"'))
    got = search.with_sources(rows, service[0].select("doi", "eqnID", "source")).collect()
    assert {(r.doi, r.eqnID, r.source) for r in got} == {("10.1/a", "e1", "x^2"), ("10.1/b", "e1", "x^2+y")}


def test_empty_corpus(spark):
    eqs = search.equations(spark.createDataFrame([], "doi string, eqnID string, t array<string>"), F.col("t"))
    assert search.find_query(eqs, parse('"x"'), 0.7).count() == 0
