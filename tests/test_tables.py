"""Maintenance, ingest, snapshots and the change feed."""

import pytest
from pyspark.sql import functions as F

from glyphsift import queries
from glyphsift.functions import tokens
from glyphsift.operators import tables
from glyphsift.sources import logs, snapshot, xml
from glyphsift.streaming import feed

SHORT = "doi string, type string, format string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upsert_and_delete(spark):
    stored = spark.createDataFrame([("a", "xml", "Article"), ("b", "xml.meta", "Article"), ("c", "xml", "Chapter")], SHORT)
    new = spark.createDataFrame([("a", "xml.meta", "N"), ("b", "xml", "N"), ("c", "xml", "N"), ("d", "xml.meta", "N"), ("d", "xml", "F")], SHORT)
    assert rows(tables.upsert(stored, new)) == [("a", "xml", "Article"), ("b", "xml", "N"), ("c", "xml", "N"), ("d", "xml", "F")]
    assert rows(tables.delete(stored, new.select("doi", "type"))) == [("a", "xml", "Article"), ("c", "xml", "Chapter")]


def test_dedupe_and_documents(spark):
    eqs = spark.createDataFrame([("a", "e1", 0, "x"), ("a", "e2", 1, "x"), ("a", "e3", 2, "y"), ("b", "e1", 0, "x")], "doi string, eqnID string, ord int, source string")
    assert {r[:2] for r in rows(tables.dedupe_equations(eqs))} == {("a", "e2"), ("a", "e3"), ("b", "e1")}
    docs = tables.stored_document(eqs, lambda c: F.when(c != "y", tokens.latex_tokens(c)), ["doi"])
    got = {r.doi: (r.source, r.content) for r in docs.collect()}
    assert got["a"] == ({"e2": "x", "e3": "y"}, {"e2": ["T:x"]})
    meta = tables.metadata(docs.withColumns({c: F.lit(None).cast("string") for c in ("containerID", "format", "publicationYear")}))
    assert {r.doi: r.no_eqns for r in meta.collect()} == {"a": 1, "b": 1}
    assert tables.list_all(meta)[1] == 2
    assert tables.list_one(meta, "none").count() == 0


CHANGES = [(1, "a", False, "v1"), (2, "b", False, "v1"), (3, "a", False, "v2"), (4, "b", True, None), (5, "c", False, None), (6, "d", False, "v1"), (7, "d", True, "v1")]


def test_feed_in_any_order(spark, tmp_path):
    whole = spark.createDataFrame(CHANGES, feed.UPDATE)
    want = [("a", 3, "v2")]
    assert rows(tables.live(tables.apply_feed(spark.createDataFrame([], feed.STORED), whole))) == want
    for n, order in enumerate([range(7), range(6, -1, -1), [3, 1, 6, 5, 2, 0, 4, 4, 2]]):
        folder = str(tmp_path / f"batches{n}")
        for k in order:
            feed.apply(spark, spark.createDataFrame([CHANGES[k]], feed.UPDATE), folder)
        assert rows(feed.documents(spark, folder)) == want
        assert snapshot.offset(spark, folder) == 7
    for k in range(6, -1, -1):
        spark.createDataFrame([CHANGES[k]], feed.UPDATE).coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
    go = lambda: feed.start(spark, str(tmp_path / "changes"), str(tmp_path / "index"), str(tmp_path / "progress")).awaitTermination()
    go()
    assert rows(feed.documents(spark, str(tmp_path / "index"))) == want
    # A change of a removed id that comes late, and one that is the newest.
    spark.createDataFrame([(3, "b", False, "late"), (9, "d", False, "back")], feed.UPDATE).coalesce(1).write.mode("append").parquet(str(tmp_path / "changes"))
    go()
    assert rows(feed.documents(spark, str(tmp_path / "index"))) == [*want, ("d", 9, "back")]


def test_feed_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "FANOUT", 3)
    folder, updates = str(tmp_path / "s"), spark.createDataFrame(CHANGES, feed.UPDATE)
    assert feed.run(spark, updates, folder, 2) == 7
    assert rows(feed.documents(spark, folder)) == [("a", 3, "v2")]
    assert feed.run(spark, updates, folder, 2) == 7
    for k in range(12):
        feed.apply(spark, spark.createDataFrame([(10 + k, f"n{k % 5}", False, str(k))], feed.UPDATE), folder)
    assert len(rows(feed.documents(spark, folder))) == 6
    names = [p.name for p in (tmp_path / "s").iterdir() if not p.name.startswith(".")]
    assert sum(n.startswith("current-") for n in names) == snapshot.KEEP
    # Of every level there are fewer runs than are merged, in each of the versions that stay.
    assert sum((tmp_path / "s" / n / "documents").exists() for n in names) <= 3 * snapshot.KEEP + 3
    feed.apply(spark, updates.limit(0), folder)
    assert snapshot.offset(spark, folder) == 21


def test_one_of_two_writers(spark, tmp_path):
    folder = str(tmp_path / "s")
    snapshot.init(spark, folder, {"t": "a int"})
    with snapshot.writer(spark, folder):
        with pytest.raises(snapshot.Taken), snapshot.writer(spark, folder):
            pass
    (tmp_path / "s" / "writer").write_text(f"{__import__('socket').gethostname()} 999999999")
    with snapshot.writer(spark, folder):
        pass
    version = snapshot.current(spark, folder)
    snapshot._claim(spark, f"{folder}/current-{version + 1:010d}", '{"tables": {}, "offset": null}')
    with pytest.raises(snapshot.Taken):
        snapshot._claim(spark, f"{folder}/current-{version + 1:010d}", "other")
    assert not [p for p in (tmp_path / "s").iterdir() if p.name.startswith("_") or p.name == "writer"]


def test_snapshot_is_whole_or_not_there(spark, tmp_path):
    folder = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        snapshot.load(spark, folder, "t")
    assert snapshot.init(spark, folder, {"t": "a int"}) == 1
    bad = spark.range(1).select(F.raise_error(F.lit("no")).cast("int").alias("a"))
    with pytest.raises(Exception):
        snapshot.save({"t": bad}, folder, 5)
    assert snapshot.current(spark, folder) == 1
    assert snapshot.load(spark, folder, "t").count() == 0


def test_xml_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.XML").write_text(queries.XML)
    (tmp_path / "b.xml.meta").write_text("<R>")
    (tmp_path / "c.txt").write_text("no")
    got = xml.read(spark, str(tmp_path)).collect()
    assert sorted((r.type, r.doi, r.eqnID) for r in got if r.error is None) == [("xml", "10.1/a", "E1"), ("xml", "10.1/a", "I1"), ("xml", "10.1/b_1", None)]
    assert [r.path.rpartition("/")[2] for r in got if r.error] == ["b.xml.meta"]


def test_logs(spark):
    df = spark.createDataFrame([("GET /?searchTerm=a%20%2B+b&x",), ("searchTerm=open",), ("searchTerm=&",), ("searchTerm=a%20%2B+b&y",)], "value string")
    assert rows(logs.log_terms(df)) == [("",), ("a ++b",)]
    assert [t for t, s in logs.replay(df.limit(1).select(F.lit("q").alias("term")), lambda t: None) if s >= 0] == ["q"]


def test_years_fields_and_repair(spark):
    docs = spark.createDataFrame([("a", "1990", None), ("b", "1991", "k"), ("c", None, None)], "doi string, publicationYear string, containerID string")
    years = spark.createDataFrame([("a", "1990-05"), ("b", "2000")], "doi string, year string")
    assert rows(tables.check_years(docs, years).select("doi", "publicationYear", "year_status")) == [("a", "1990", "same"), ("b", "2000", "changed"), ("c", None, "missing")]
    assert rows(tables.repair(docs, docs.where("doi = 'b'").withColumn("containerID", F.lit(None).cast("string")))) == [("a", "1990", None), ("b", "1991", None), ("c", None, None)]
    assert tables.rename_field(docs.withColumn("journalID", F.lit("j"))).where("containerID = 'j'").count() == 3


def test_monitor(spark):
    t = lambda *x: spark.createDataFrame([*x], "term string, n long")
    got = tables.monitor(spark.createDataFrame([(x,) for x in "abcde"], "term string"), t(("a", 3), ("b", 3), ("c", 3), ("d", 3)), t(("a", 2), ("b", 5), ("c", 3), ("e", 1)))
    assert {r.term: (r.status, r.baseline) for r in got.collect()} == {"a": ("error", 3), "b": ("info", 5), "c": ("ok", 3), "d": ("error", 3), "e": ("new", 1)}
