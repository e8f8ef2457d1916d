"""The store, its commands, and requests as JSON lines."""

import json

from glyphsift import cli, queries, service
from glyphsift.store import Store


def test_store_from_files_to_answers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(queries.XML)
    (tmp_path / "in" / "bad.xml").write_text("<R>")
    said, folder = [], str(tmp_path / "store")
    run = lambda *a, lines=(): cli.main([folder, *a], lines, said.append)
    assert run("init") == 0
    assert run("add", str(tmp_path / "in")) == 1
    assert "bad.xml" in said.pop()
    run("update")
    run("list-all")
    assert said == ["10.1/a containerID=J1 no_equations=2", "10.1/b_1 containerID=10.1/b no_equations=0", "Total number of equations: 2"]
    said.clear()
    run("query", lines=['{"query": {"searchTerm": "\\"x^2\\""}}', '{"body": "{\\"searchTerm\\": \\"(\\"}"}', "{}", "no"])
    assert [json.loads(x)["body"] for x in said] == ['<results><query>"x ^ { 2 }"</query><Article doi="10.1/a" count="1"><equation distance="0" id="E1"/></Article></results>', "<QueryParseError/>", "<ArgParseError/>", "<ArgParseError/>"]
    store = Store(spark, folder)
    sources = store.documents().selectExpr("doi", "explode(source) AS (eqnID, source)")
    got = service.client_search(store.equations(), store.metadata(), sources, '"x^2"')
    assert got["results"] == [("10.1/a", [("E1", 0, "x^2")])]
    assert service.client_search(store.equations(), store.metadata(), sources, "x")["error"] == "QueryParseError"
    (tmp_path / "years.csv").write_text("10.1/a,2003-05\n")
    said.clear()
    run("check-dates", str(tmp_path / "years.csv"))
    assert sorted(said) == ["10.1/a: changed", "10.1/b_1: missing"]
    run("reprocess")
    run("convert")
    assert store.get("10.1/a").first().publicationYear == "2003"
    run("del", str(tmp_path / "in"))
    run("update")
    said.clear()
    run("list", "10.1/a")
    run("list", "10.1/b_1")
    assert said == ["DOI not indexed", "10.1/b_1 containerID=10.1/b no_equations=0"]


def test_preprocess():
    of = lambda **q: service.preprocess({"query": q})
    assert of(format="json-plain", latex=r"\frac{a}2")["json"] == {"json": [{"frac": ["a", "2"]}], "plain": r"\frac { a } { 2 }"}
    assert of(format="json", latex="")["json"] == []
    assert of(format="plain", latex="x_1")["body"] == "x _ { 1 }"
    assert (of(format="xml", latex="")["code"], of(latex="x")["code"], service.preprocess({"query": 1})["code"]) == (400, 400, 500)
    assert of(format="json", latex="{x")["code"] == of(format="plain", latex=r"\begin{a}")["code"] == 500
    assert [json.loads(x)["code"] for x in service.preprocessed(['{"query": {"format": "plain", "latex": "x"}}', '{"query": {}}'])] == [200, 400]
