"""The registered queries of the search engine, and their SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import service, shared
from .functions import keys, latex, sequences, tokens
from .functions.sequences import cutoff
from .operators import postings, search, tables
from .plans import compile as plan
from .plans.query import And, Atom, Query, parse, to_string
from .sources import logs, xml
from .store import Store
from .streaming import feed

PRECISION = 0.7
#: Search terms over part names, some with an error, and the years between which a page of results lies.
EXACT, NEAR = "bolt", "redwidgat"
AND, OR, NESTED = '"red" AND "widgit"', '"blue" OR "gaer"', '("smal" OR "hot") AND ("gear" OR "ring")'
FROM, TO = "1996", "1999"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _characters(fragment: str) -> tuple[list[str], str]:
    return [f"T:{c}" for c in fragment if c != " "], fragment


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as sequences of characters."""
    return search.equations(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name"), tokens.character_tokens(F.col("p_name")))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as equations of their order: the part's name. Tests on it reach the part table's scan."""
    lines = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("10.1000/"), "l_orderkey").alias("doi"), F.concat_ws(".", "l_linenumber", "l_partkey", "l_suppkey").alias("eqnID"), F.col("l_partkey").alias("id"))
    return lines.join(_parts(spark, sf_dir), "id").select("doi", "eqnID", "tokens", "canon", "p_name")


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(
        F.concat(F.lit("10.1000/"), "o_orderkey").alias("doi"), F.col("o_orderpriority").alias("containerID"), F.col("o_orderstatus").alias("format"), F.date_format("o_orderdate", "yyyy").alias("publicationYear")
    )


# The same in SQL.
PARTS = "parts AS (SELECT p_partkey AS id, p_name, replace(p_name, ' ', '') AS s FROM part)"
CORPUS = f"{PARTS}, corpus AS (SELECT '10.1000/' || l_orderkey AS doi, l_linenumber || '.' || l_partkey || '.' || l_suppkey AS eqnID, s, p_name FROM lineitem JOIN parts ON l_partkey = id)"
META = "meta AS (SELECT '10.1000/' || o_orderkey AS doi, o_orderpriority AS containerID, o_orderstatus AS format, strftime(o_orderdate, '%Y') AS publicationYear FROM orders)"


def _sql_distance(q: str, s: str = "s") -> str:
    """Least Levenshtein distance over all substrings."""
    return f"list_min(flatten(list_transform(range(1, length({s}) + 2), lambda i: list_transform(range(0, length({s}) - i + 2), lambda n: levenshtein({q}, substr({s}, i, n))))))"


def _sql_similar(q: Query, precision: float = PRECISION) -> str:
    if isinstance(q, Atom):
        d = _sql_distance(f"'{q.plain}'")
        return f"(CASE WHEN {d} < {cutoff(precision, len(q.tokens))} THEN {d} END)"
    a, b = _sql_similar(q.left, precision), _sql_similar(q.right, precision)
    return f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN greatest({a}, {b}) END)" if isinstance(q, And) else f"least({a}, {b})"


def _sql_query(term: str) -> str:
    # Names repeat, so each is compared once.
    similar = _sql_similar(parse(term, _characters))
    return f"WITH {PARTS}, d AS (SELECT s, CAST({similar} AS INTEGER) AS distance FROM (SELECT DISTINCT s FROM parts)) SELECT id, distance FROM parts JOIN d USING (s) WHERE distance IS NOT NULL"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _registered(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@_registered(f"SELECT p_partkey AS id, 0 AS distance FROM part WHERE contains(replace(p_name, ' ', ''), '{EXACT}')")
def exact_find(spark, sf_dir):
    return search.find_exact(_parts(spark, sf_dir), _characters(EXACT)[0]).select("id", "distance")


@_registered(_sql_query(f'"{NEAR}"'))
def approx_find(spark, sf_dir):
    return search.find_approx(_parts(spark, sf_dir), _characters(NEAR)[0], PRECISION).select("id", "distance")


@_registered(_sql_query(f'"{NEAR}"'))
def approx_find_arrow(spark, sf_dir):
    return search.find_approx(_parts(spark, sf_dir), _characters(NEAR)[0], PRECISION, "arrow").select("id", "distance")


def _boolean(term: str):
    return lambda spark, sf_dir: search.find_query(_parts(spark, sf_dir), parse(term, _characters), PRECISION).select("id", "distance")


for _name, _term in {"bool_and": AND, "bool_or": OR, "bool_nested": NESTED}.items():
    QUERIES[_name], SQL[_name] = _boolean(_term), _sql_query(_term)

PRECISIONS = [0.0, 0.5, 0.66, 0.7, 0.9, 1.0]
SQL_CUTOFF = "CAST(greatest(1, least(5, ceil((CAST(1.0 AS DOUBLE) - p) * n))) AS INTEGER)"


@_registered(f"WITH t AS (SELECT p_partkey AS id, length(replace(p_name, ' ', '')) AS n, CAST(unnest({PRECISIONS}) AS DOUBLE) AS p FROM part) SELECT id, p, {SQL_CUTOFF} AS cutoff FROM t")
def cutoff_table(spark, sf_dir):
    rows = _parts(spark, sf_dir).select("id", F.size("tokens").alias("n"), F.explode(F.array(*map(F.lit, PRECISIONS))).alias("p"))
    return rows.select("id", "p", sequences.cutoff_column(F.col("p"), F.col("n")).alias("cutoff"))


@_registered(
    f"""WITH t AS (SELECT p_partkey AS id, replace(p_name, ' ', '') AS s, length(replace(p_name, ' ', '')) AS n, CAST({PRECISION} AS DOUBLE) AS p FROM part),
    k AS (SELECT *, {SQL_CUTOFF} AS k FROM t), i AS (SELECT *, CAST(unnest(range(least(k, n))) AS INTEGER) AS i FROM k)
    SELECT id, i, substr(s, CAST(i * (n // k) + least(i, n % k) + 1 AS BIGINT), CAST(n // k + (CASE WHEN i < n % k THEN 1 ELSE 0 END) AS BIGINT)) AS fragment FROM i"""
)
def fragments_table(spark, sf_dir):
    k = sequences.cutoff_column(F.lit(PRECISION), F.size("tokens"))
    rows = _parts(spark, sf_dir).select("id", F.posexplode(sequences.fragments_column(F.col("tokens"), k)).alias("i", "f"))
    return rows.select("id", "i", F.replace(F.array_join("f", ""), F.lit("T:"), F.lit("")).alias("fragment"))


@_registered(f"WITH {PARTS}, p AS (SELECT id, s, CAST(unnest(range(length(s))) AS INTEGER) AS pos FROM parts) SELECT id, pos, substr(s, pos + 1) AS suffix FROM p")
def suffix_expand(spark, sf_dir):
    return search.suffixes(_parts(spark, sf_dir)).select("id", "pos", F.replace(F.array_join("suffix", ""), F.lit("T:"), F.lit("")).alias("suffix"))


@_registered(
    """WITH p AS (SELECT n_nationkey AS id, n_name AS s, CAST(unnest(range(length(n_name))) AS INTEGER) AS pos FROM nation)
    SELECT id, pos, CAST(row_number() OVER (PARTITION BY substr(s, pos + 1, 1) ORDER BY substr(s, pos + 1), id, pos) AS INTEGER) AS rank FROM p"""
)
def suffix_order(spark, sf_dir):
    """Each suffix's place among those that start with its token, in the order of a suffix array."""
    eqs = search.equations(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name"), tokens.character_tokens(F.col("n_name")))
    place = Window.partitionBy(F.get("suffix", F.lit(0))).orderBy("suffix", "id", "pos")
    return search.suffixes(eqs).select("id", "pos", F.row_number().over(place).alias("rank"))


@_registered(
    f"""WITH {PARTS}, pos AS (SELECT a.id, a.s, b.s AS t, CAST(unnest(range(length(a.s))) AS INTEGER) AS pos FROM parts a JOIN parts b ON a.id + 1 = b.id)
    SELECT id, pos, CASE WHEN substr(s, pos + 1) < substr(t, pos + 1) THEN -1 WHEN substr(s, pos + 1) > substr(t, pos + 1) THEN 1 ELSE 0 END AS cmp, starts_with(substr(t, pos + 1), substr(s, pos + 1)) AS prefix FROM pos"""
)
def suffix_compare(spark, sf_dir):
    """Every suffix of a name against the next name from that place on."""
    n = _parts(spark, sf_dir).select("id", F.col("tokens").alias("t"))
    pairs = n.alias("a").join(n.alias("b"), F.col("a.id") + 1 == F.col("b.id")).select("a.id", F.col("a.t").alias("a"), F.col("b.t").alias("b"))
    at = pairs.select("id", "a", "b", F.posexplode("a").alias("pos", "x"))
    here, suffix = F.col("pos"), F.slice("a", F.col("pos") + 1, F.size("a"))
    return at.select("id", "pos", sequences.compare_suffix(F.col("a"), here, F.col("b"), here).alias("cmp"), F.coalesce(sequences.is_prefix(suffix, F.col("b"), here), F.lit(False)).alias("prefix"))


HITS = f"hits AS (SELECT doi, eqnID, distance, p_name FROM corpus JOIN (SELECT s, CAST({_sql_similar(parse(AND, _characters))} AS INTEGER) AS distance FROM (SELECT DISTINCT s FROM parts)) USING (s) WHERE distance IS NOT NULL)"
DOCS = "docs AS (SELECT doi, count(*) AS count, min(distance) AS best, string_agg(distance || ':' || eqnID, ',' ORDER BY distance, eqnID) AS equations FROM hits GROUP BY doi)"


def _hits(spark, sf_dir):
    return search.find_query(_corpus(spark, sf_dir), parse(AND, _characters), PRECISION)


def _shown(docs: DataFrame) -> DataFrame:
    return docs.withColumn("equations", F.array_join(F.transform("equations", lambda e: F.concat(e["distance"], F.lit(":"), e["eqnID"])), ","))


@_registered(f"WITH {CORPUS}, {HITS}, {DOCS} SELECT doi, count, best, equations FROM docs")
def search_collate(spark, sf_dir):
    return _shown(search.collate(_hits(spark, sf_dir)))


@_registered(
    f"""WITH {CORPUS}, {HITS}, {DOCS}, {META}, r AS (SELECT doi, format, count, best, equations, CAST(row_number() OVER (ORDER BY best, replace(doi, '/', '_') DESC) AS INTEGER) AS rank
    FROM docs JOIN meta USING (doi) WHERE publicationYear BETWEEN '{FROM}' AND '{TO}') SELECT doi, format, count, best, equations, CAST(rank - 5 AS INTEGER) AS rank FROM r WHERE rank BETWEEN 6 AND 25"""
)
def search_rank_page(spark, sf_dir):
    args = search.Arguments(AND, limit=1_000_000, start=5, count=20, publishedAfter=FROM, publishedBefore=TO)
    _, page = search.search(_corpus(spark, sf_dir), _metadata(spark, sf_dir), args, _characters)
    # A page has `count` rows at most.
    return _shown(page).withColumn("rank", F.row_number().over(Window.orderBy("best", F.desc(keys.encode_doi(F.col("doi"))))))


def _filter(**given):
    return lambda spark, sf_dir: _metadata(spark, sf_dir).where(search.filters(**given)).select("doi", "format")


QUERIES["filter_container"] = _filter(containers=["1-URGENT", "5-LOW"])
SQL["filter_container"] = f"WITH {META} SELECT doi, format FROM meta WHERE containerID IN ('1-URGENT', '5-LOW')"
QUERIES["filter_doi"] = _filter(dois=["10.1000/7", "10.1000/77"])
SQL["filter_doi"] = f"WITH {META} SELECT doi, format FROM meta WHERE doi IN ('10.1000/7', '10.1000/77')"
QUERIES["filter_year"] = _filter(after=FROM, before=TO)
SQL["filter_year"] = f"WITH {META} SELECT doi, format FROM meta WHERE publicationYear BETWEEN '{FROM}' AND '{TO}'"

LIMITS = [1, 100, 1_000_000]


@_registered(f"WITH {CORPUS}, {HITS} SELECT CAST(unnest({LIMITS}) AS INTEGER) AS doc_limit, (SELECT count(DISTINCT doi) FROM hits) > unnest({LIMITS}) AS exceeded")
def limit_guard(spark, sf_dir):
    docs, found = shared.checkpointed(search.collate(_hits(spark, sf_dir))), []
    for limit in LIMITS:
        try:
            search.guard(docs, limit)
            found.append((limit, False))
        except search.LimitExceeded:
            found.append((limit, True))
    return spark.createDataFrame(found, "doc_limit int, exceeded boolean")


def _lines(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doi"), F.posexplode(F.split("text", "\n")).alias("ord", "source"), F.col("source").alias("containerID"))
    return rows.withColumn("eqnID", F.concat(F.lit("E"), "ord"))


LINES = "lines AS (SELECT CAST(doc_id AS VARCHAR) AS doi, source AS containerID, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents)"


@_registered(f"WITH {LINES} SELECT doi, 'E' || max(ord) AS eqnID, line AS source FROM lines GROUP BY doi, line")
def ingest_dedupe(spark, sf_dir):
    return tables.dedupe_equations(_lines(spark, sf_dir).select("doi", "eqnID", "ord", "source")).select("doi", "eqnID", "source")


@_registered(f"WITH {LINES}, u AS (SELECT DISTINCT doi, line FROM lines) SELECT doi, count(*) AS n_source, count(*) FILTER (WHERE regexp_matches(line, '[\\p{{L}}\\p{{N}}]')) AS n_content FROM u GROUP BY doi")
def document_build(spark, sf_dir):
    words = lambda c: F.nullif(tokens.word_tokens(c), F.array().cast("array<string>"))
    docs = tables.stored_document(_lines(spark, sf_dir).select("doi", "eqnID", "ord", "source"), words, ["doi"])
    return docs.select("doi", F.size(F.map_keys("source")).cast("bigint").alias("n_source"), F.size(F.map_keys("content")).cast("bigint").alias("n_content"))


def _stored(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "xml.meta").otherwise("xml")
    form = F.when(F.col("doc_id") % 7 == 0, "Chapter").otherwise("Article")
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doi"), kind.alias("type"), form.alias("format"), F.col("source").alias("containerID"), F.lit("1990").alias("publicationYear"))


def _incoming(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 5 == 0, "xml").otherwise("xml.meta")
    return _table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doi"), kind.alias("type"), F.lit("Article").alias("format"), F.lit("labels").alias("containerID"), F.concat(F.lit("200"), "quality").alias("publicationYear"))


STORED = """stored AS (SELECT CAST(doc_id AS VARCHAR) AS doi, CASE WHEN doc_id % 3 = 0 THEN 'xml.meta' ELSE 'xml' END AS type, CASE WHEN doc_id % 7 = 0 THEN 'Chapter' ELSE 'Article' END AS format, source AS containerID, '1990' AS publicationYear FROM documents),
incoming AS (SELECT CAST(doc_id AS VARCHAR) AS doi, CASE WHEN doc_id % 5 = 0 THEN 'xml' ELSE 'xml.meta' END AS type, 'Article' AS format, 'labels' AS containerID, '200' || quality AS publicationYear FROM labels)"""
TAKEN = "(i.doi IS NOT NULL AND NOT (s.doi IS NOT NULL AND i.type = 'xml.meta' AND s.type = 'xml'))"
_put = ", ".join(f"CASE WHEN {TAKEN} THEN i.{c} ELSE s.{c} END AS {c}" for c in ("doi", "type", "format", "containerID", "publicationYear"))


@_registered(f"WITH {STORED} SELECT {_put} FROM stored s FULL JOIN incoming i ON s.doi = i.doi")
def upsert_precedence(spark, sf_dir):
    return tables.upsert(_stored(spark, sf_dir), _incoming(spark, sf_dir))


@_registered(f"WITH {STORED} SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.doi = s.doi AND s.format = 'Article' AND NOT (i.type = 'xml.meta' AND s.type = 'xml'))")
def delete_precedence(spark, sf_dir):
    return tables.delete(_stored(spark, sf_dir), _incoming(spark, sf_dir))


def _updates(spark, sf_dir):
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), F.col("user_id").cast("string").alias("id"), (F.col("event_type") == "error").alias("deleted"), F.col("props").alias("doc"))


FEED = "WITH l AS (SELECT CAST(user_id AS VARCHAR) AS id, max(event_id) AS key, arg_max(props, event_id) AS doc, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id) SELECT id, key, doc FROM l WHERE kind <> 'error' AND doc IS NOT NULL"


@_registered(FEED)
def change_feed_apply(spark, sf_dir):
    return tables.live(tables.apply_feed(spark.createDataFrame([], feed.STORED), _updates(spark, sf_dir)))


@_registered(FEED)
def change_feed_stream(spark, sf_dir):
    """The same by a stream over files of changes that come in the reverse of their order, into a snapshot."""
    base = f"{shared.folder(spark)}/feed-{uuid.uuid4().hex}"
    updates, top = _updates(spark, sf_dir), _table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] or 0
    for k in (2, 1, 0):
        part = updates.where((F.col("key") > k * top / 3) & (F.col("key") <= (k + 1) * top / 3) | ((k == 0) & (F.col("key") <= 0)))
        part.coalesce(1).write.mode("append").parquet(f"{base}/changes")
    feed.start(spark, f"{base}/changes", f"{base}/index", f"{base}/progress").awaitTermination()
    shared.remove(spark, f"{base}/changes")
    return feed.documents(spark, f"{base}/index")


@_registered(FEED)
def change_feed_batches(spark, sf_dir):
    """The same in batches by key."""
    folder = f"{shared.folder(spark)}/feed-{uuid.uuid4().hex}"
    updates = _updates(spark, sf_dir)
    feed.run(spark, updates, folder, max(feed.BATCH, -(-updates.count() // 4)))
    return feed.documents(spark, folder)


@_registered(f"WITH {LINES}, m AS (SELECT doi, any_value(containerID) AS containerID, count(DISTINCT line) AS no_eqns FROM lines GROUP BY doi) SELECT doi, containerID, no_eqns FROM m UNION ALL SELECT '*', NULL, CAST(sum(no_eqns) AS BIGINT) FROM m")
def index_stats(spark, sf_dir):
    docs = tables.stored_document(_lines(spark, sf_dir).select("doi", "eqnID", "ord", "source", "containerID"), tokens.word_tokens, ["doi"])
    docs = docs.join(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doi"), F.col("source").alias("containerID")), "doi")
    rows, total = tables.list_all(tables.metadata(docs.withColumns({"format": F.lit("Article"), "publicationYear": F.lit(None).cast("string")})))
    whole = spark.range(1).select(F.lit("*").alias("doi"), F.lit(None).cast("string").alias("containerID"), F.lit(total).cast("bigint").alias("no_eqns"))
    return rows.withColumn("no_eqns", F.col("no_eqns").cast("bigint")).unionByName(whole)


@_registered(f"WITH {LINES} SELECT doi, any_value(containerID) AS containerID, count(DISTINCT line) AS no_eqns FROM lines WHERE doi = '7' GROUP BY doi")
def index_lookup(spark, sf_dir):
    """One document's row of the index; the test of its key reaches the scan."""
    rows = _lines(spark, sf_dir)
    docs = tables.stored_document(rows.select("doi", "eqnID", "ord", "source"), tokens.word_tokens, ["doi"])
    docs = docs.join(rows.select("doi", "containerID").distinct(), "doi")
    meta = tables.metadata(docs.withColumns({"format": F.lit("Article"), "publicationYear": F.lit(None).cast("string")}))
    return tables.list_one(meta, "7").withColumn("no_eqns", F.col("no_eqns").cast("bigint"))


@_registered(f"WITH {CORPUS}, {HITS}, {META} SELECT doi, eqnID, format, distance, p_name AS source FROM hits JOIN meta USING (doi)")
def source_enrich(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    results = search.collate(hits).join(_metadata(spark, sf_dir), "doi")
    sources = _corpus(spark, sf_dir).select("doi", "eqnID", F.col("p_name").alias("source")).distinct()
    return search.with_sources(results, sources)


def _sql_first(c: str, old: str, new: str) -> str:
    return f"CASE WHEN instr({c}, '{old}') > 0 THEN substr({c}, 1, instr({c}, '{old}') - 1) || '{new}' || substr({c}, instr({c}, '{old}') + 1) ELSE {c} END"


@_registered(f"SELECT url, {_sql_first('url', '/', '_')} AS encoded, {_sql_first('url', '_', '/')} AS decoded FROM pages")
def doi_encode(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("url", keys.encode_doi(F.col("url")).alias("encoded"), keys.decode_doi(F.col("url")).alias("decoded"))


@_registered("SELECT DISTINCT url_decode(regexp_extract(url, 'page=([^&]*)&', 1)) AS term FROM pages WHERE regexp_matches(url, 'page=[^&]*&')")
def log_terms(spark, sf_dir):
    return logs.log_terms(_table(spark, sf_dir, "pages"), "url", "page")


@_registered(
    """WITH t AS (SELECT DISTINCT p_brand AS term FROM part), b AS (SELECT p_brand AS term, count(*) AS n FROM part WHERE p_size < 25 GROUP BY 1), o AS (SELECT p_brand AS term, count(*) AS n FROM part WHERE p_size > 24 GROUP BY 1),
    s AS (SELECT term, b.n AS before, o.n AS now, CASE WHEN o.n IS NULL THEN 'error' WHEN b.n IS NULL THEN 'new' WHEN o.n < b.n THEN 'error' WHEN o.n > b.n THEN 'info' ELSE 'ok' END AS status FROM t LEFT JOIN b USING (term) LEFT JOIN o USING (term))
    SELECT term, before, now, status, CASE WHEN status IN ('info', 'new') THEN now ELSE before END AS baseline FROM s"""
)
def monitor_compare(spark, sf_dir):
    parts = _table(spark, sf_dir, "part").withColumnRenamed("p_brand", "term")
    counts = lambda c: parts.where(c).groupBy("term").agg(F.count("*").alias("n"))
    return tables.monitor(parts, counts("p_size < 25"), counts("p_size > 24"))


@_registered(
    """WITH d AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: w <> ''), ' ') || ' ' AS s FROM documents),
    i AS (SELECT item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS q FROM benchmark)
    SELECT item_id AS query_id, doc_id, 0 AS distance FROM i JOIN d ON contains(s, q)"""
)
def benchmark_passages(spark, sf_dir):
    """Documents that hold an item word for word: a similarity join of precision 1."""
    words = tokens.word_tokens(F.col("text"))
    docs = search.equations(_table(spark, sf_dir, "documents").select("doc_id", "text"), words)
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("tokens"), F.lit(1.0).alias("precision"))
    return postings.similarity_join(docs, items, ["doc_id"])


_names = "SELECT DISTINCT replace(p_name, ' ', '') AS s FROM part"


@_registered(
    f"""WITH e AS ({_names}), q AS (SELECT substr(s, 1, length(s) - 2) || 'x' || substr(s, length(s)) AS query_id FROM e),
    d AS (SELECT query_id, s, CAST({_sql_distance("query_id")} AS INTEGER) AS distance, length(query_id) AS n, CAST({PRECISION} AS DOUBLE) AS p FROM q CROSS JOIN e) SELECT query_id, s, distance FROM d WHERE distance < {SQL_CUTOFF}"""
)
def similarity_join(spark, sf_dir):
    """Names with an error against all names."""
    names = _table(spark, sf_dir, "part").select(F.replace("p_name", F.lit(" "), F.lit("")).alias("s")).distinct()
    n = F.length("s")
    wrong = names.select(F.concat(F.substring("s", F.lit(1), n - 2), F.lit("x"), F.substring("s", n, F.lit(1))).alias("query_id")).distinct()
    wrong = wrong.select("query_id", tokens.character_tokens(F.col("query_id")).alias("tokens"), F.lit(PRECISION).alias("precision"))
    return postings.similarity_join(search.equations(names, tokens.character_tokens(F.col("s"))), wrong, ["s"])


# Formulae made of parts: sizes, brands, types and names in them, every seventh with a brace too many.
FORMULA = "concat('\\\\frac{', p_size, '}{\\\\text{', p_brand, '}} % ', p_type, '\\n^', substr(p_name, 1, 1), '\\\\sqrt[', p_size, ']{', substr(p_name, 1, 2), '}', CASE WHEN p_partkey % 7 = 0 THEN '}' ELSE '' END)"
_spread = lambda c, sep: f"array_to_string(list_transform(string_split({c}, ''), lambda c: {sep} || c), ' ')"
_digits, _two = "CAST(p_size AS VARCHAR)", "substr(p_name, 1, 2)"
SQL_TOKENS = f"""'C:frac ' || {_spread(_digits, "'T:'")} || ' T:' || p_brand || ' C:active::^ T:' || substr(p_name, 1, 1) || ' C:sqrt ' || {_spread(_digits, "'T:'")} || ' ' || {_spread(_two, "'T:'")}"""
SQL_PLAIN = f"""'\\frac {{ ' || {_spread(_digits, "''")} || ' }} {{ ' || p_brand || ' }} ^ {{ ' || substr(p_name, 1, 1) || ' }} \\sqrt {{ ' || {_spread(_digits, "''")} || ' }} {{ ' || {_spread(_two, "''")} || ' }}'"""
_quoted = lambda c: f"""array_to_string(list_transform(string_split({c}, ''), lambda c: '"' || c || '"'), ',')"""
SQL_JSON = f"""'[{{"frac":[' || {_quoted(_digits)} || ',"' || p_brand || '"]}},{{"active::^":["' || substr(p_name, 1, 1) || '"]}},{{"sqrt":[' || {_quoted(_digits)} || ',' || {_quoted(_two)} || ']}}]'"""
_good = "p_partkey % 7 <> 0"


def _formulae(spark, sf_dir):
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(FORMULA).alias("latex"))


@_registered(f"SELECT p_partkey AS id, CASE WHEN {_good} THEN {SQL_TOKENS} END AS tokens FROM part")
def latex_tokenize(spark, sf_dir):
    """Tokens of formulae, null for bad ones."""
    return _formulae(spark, sf_dir).select("id", F.array_join(tokens.latex_tokens(F.col("latex")), " ").alias("tokens"))


@_registered(f"SELECT p_partkey AS id, {SQL_PLAIN} AS plain FROM part WHERE {_good}")
def latex_plain(spark, sf_dir):
    """Canonical text of formulae; bad ones are dropped, as on ingest."""
    return _formulae(spark, sf_dir).select("id", latex.forms(F.col("latex"))["plain"].alias("plain")).where("plain IS NOT NULL")


@_registered(f"SELECT p_partkey AS id, {SQL_JSON} AS json FROM part WHERE {_good}")
def latex_json(spark, sf_dir):
    return _formulae(spark, sf_dir).select("id", latex.forms(F.col("latex"))["json"].alias("json")).where("json IS NOT NULL")


XML = """<R><Article><ArticleDOI>10.1/a</ArticleDOI><JournalID>J1</JournalID><CoverDate><Year>2001</Year></CoverDate><PrintDate><Year>2002</Year></PrintDate>
<InlineEquation ID="I1"><EquationSource Format="TEX">y</EquationSource></InlineEquation><Equation ID="E1"><EquationSource Format="MATHML">m</EquationSource><EquationSource Format="TEX">x^2</EquationSource></Equation>
<Equation ID="E2"><EquationSource Format="MATHML">m</EquationSource></Equation></Article><Book><BookDOI>10.1/b</BookDOI><BookCopyright><CopyrightYear>1999</CopyrightYear></BookCopyright><Chapter><ChapterDOI>10.1/b_1</ChapterDOI></Chapter></Book></R>"""


# An order is a file: an article if it is finished, a chapter of a book if it is open, and else one that breaks off. Its lines are
# displayed and inline equations by turns, of which those with a quantity over 45 have no source in TeX.
_ORDERS = """(SELECT o_orderkey, o_orderstatus, o_orderpriority, date_format(o_orderdate, 'yyyy') AS year, concat_ws('', transform(array_sort(collect_list(struct(l_linenumber, l_quantity, l_partkey))),
    l -> concat('<', if(l.l_linenumber % 2 = 0, 'Equation', 'InlineEquation'), ' ID="E', l.l_linenumber, '"><EquationSource Format="', if(l.l_quantity > 45, 'MATHML', 'TEX'), '"> x_', l.l_partkey, ' &lt; 1</EquationSource></', if(l.l_linenumber % 2 = 0, 'Equation', 'InlineEquation'), '>'))) AS e
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""
_FILES = f"""SELECT concat(o_orderkey, if(o_orderkey % 2 = 0, '.xml', '.xml.meta')) AS path, if(o_orderkey % 2 = 0, 'xml', 'xml.meta') AS type, CAST(CASE o_orderstatus
    WHEN 'F' THEN concat('<R><Article><ArticleDOI>10.2/', o_orderkey, '</ArticleDOI><JournalID>', o_orderpriority, '</JournalID><OnlineDate><Year>1900</Year></OnlineDate><CoverDate><Year>', year, '</Year></CoverDate>', e, '</Article></R>')
    WHEN 'O' THEN concat('<Book><BookDOI>10.3/b</BookDOI><BookCopyright><CopyrightYear>', year, '</CopyrightYear></BookCopyright><Chapter><ChapterDOI>10.3/b_', o_orderkey, '</ChapterDOI>', e, '</Chapter></Book>')
    ELSE concat('<R><Article>', e) END AS BINARY) AS content FROM {_ORDERS}"""


@_registered(
    """WITH o AS (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'xml' ELSE 'xml.meta' END AS type FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
    e AS (SELECT l_orderkey, 'E' || l_linenumber AS eqnID, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2, l_linenumber, l_quantity, l_partkey) - 1 AS INTEGER) AS ord, 'x_' || l_partkey || ' < 1' AS source FROM lineitem WHERE l_quantity <= 45)
    SELECT type, CASE o_orderstatus WHEN 'F' THEN '10.2/' || o_orderkey WHEN 'O' THEN '10.3/b_' || o_orderkey END AS doi, CASE o_orderstatus WHEN 'F' THEN 'Article' WHEN 'O' THEN 'Chapter' END AS format,
    CASE o_orderstatus WHEN 'F' THEN o_orderpriority WHEN 'O' THEN '10.3/b' END AS containerID, CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y') END AS publicationYear, eqnID, ord, source, o_orderstatus = 'P' AS failed
    FROM o LEFT JOIN e ON o_orderkey = l_orderkey AND o_orderstatus <> 'P'"""
)
def xml_ingest(spark, sf_dir):
    """Articles, chapters of books and files that break off, made of all orders and their lines."""
    for name in ("orders", "lineitem"):
        _table(spark, sf_dir, name).createOrReplaceTempView(name)
    return xml.rows(spark.sql(_FILES)).select("type", "doi", "format", "containerID", "publicationYear", "eqnID", "ord", "source", F.col("error").isNotNull().alias("failed"))


@_registered(
    """WITH d AS (SELECT n_nationkey, '10.4/' || n_nationkey AS doi, 'R' || n_regionkey AS containerID, s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 5 <> 4),
    m AS (SELECT doi, any_value(containerID) AS containerID, count(s_suppkey) AS no_eqns FROM d GROUP BY doi)
    SELECT 'listed' AS step, doi, containerID, no_eqns FROM m UNION ALL SELECT 'stored', doi, containerID, no_eqns FROM m WHERE doi = '10.4/2' UNION ALL SELECT 'total', NULL, NULL, CAST(sum(no_eqns) AS BIGINT) FROM m
    UNION ALL SELECT 'new', NULL, NULL, 0 UNION ALL SELECT 'failed', NULL, NULL, count(*) FROM nation WHERE n_nationkey % 5 = 4 UNION ALL SELECT 'deleted', NULL, NULL, count(*) FROM m WHERE doi = '10.4/1'
    UNION ALL SELECT 'found', doi, NULL, count(*) FROM d WHERE s_suppkey % 2 = 0 GROUP BY doi"""
)
def store_commands(spark, sf_dir):
    """A store from empty: files in a folder are put in and indexed; then what it lists, has and finds, and what a deletion leaves."""
    base = f"{shared.folder(spark)}/store-{uuid.uuid4().hex}"
    nations, suppliers = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "supplier")
    lines = suppliers.select(F.col("s_nationkey").alias("n_nationkey"), F.expr("concat('<Equation ID=\"S', s_suppkey, '\"><EquationSource Format=\"TEX\">', if(s_suppkey % 2 = 0, '\\\\alpha', '\\\\beta'), '_{', s_suppkey, '}</EquationSource></Equation>')").alias("e"))
    content = nations.join(lines, "n_nationkey", "left").groupBy("n_nationkey", "n_regionkey").agg(F.concat_ws("", F.collect_list("e")).alias("e"))
    content = content.select("n_nationkey", F.concat(F.lit("<Article><ArticleDOI>10.4/"), "n_nationkey", F.lit("</ArticleDOI><JournalID>R"), "n_regionkey", F.lit("</JournalID>"), "e", F.when(F.col("n_nationkey") % 5 == 4, "").otherwise("</Article>")).alias("value"))
    content.repartition("n_nationkey").write.partitionBy("n_nationkey").text(f"{base}/in")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(f"{base}/in")
    store = Store(spark, f"{base}/store")
    store.init()
    rows = [("new", None, None, store.documents().count() + store.postings().count())]
    errors = store.add_files(files.select("path", F.lit("xml").alias("type"), "content"))
    store.update()
    listed, total = tables.list_all(store.metadata())
    rows += [("failed", None, None, len(errors)), ("total", None, None, total)]
    kept = F.col("no_eqns").cast("bigint").alias("no_eqns")
    got = store.get("10.4/2").select(F.lit("stored").alias("step"), "doi", "containerID", F.size(F.map_keys("source")).cast("bigint").alias("no_eqns"))
    hits = search.find_query(store.equations(), parse('"\\alpha"'), 1.0, index=store.postings())
    found = search.collate(hits).select(F.lit("found").alias("step"), "doi", F.lit(None).cast("string").alias("containerID"), F.col("count").alias("no_eqns"))
    shown = shared.checkpointed(listed.select(F.lit("listed").alias("step"), "doi", "containerID", kept).unionByName(got).unionByName(found))
    before = store.documents().count()
    store.delete_files(files.where(F.col("path").contains("/n_nationkey=1/")).select("path", F.lit("xml").alias("type"), "content"))
    rows.append(("deleted", None, None, before - store.documents().count()))
    shared.remove(spark, base)
    return shown.unionByName(spark.createDataFrame(rows, "step string, doi string, containerID string, no_eqns bigint"))


# Brands as documents, with their parts' names as equations.
BRANDS = f"WITH {PARTS}, eq AS (SELECT '10.5/' || p_brand AS doi, CAST(p_partkey AS VARCHAR) AS eqnID, s, p_part.p_name FROM part p_part JOIN parts ON p_partkey = id)"
BRAND_HITS = f"hits AS (SELECT doi, eqnID, distance, p_name FROM eq JOIN (SELECT s, CAST({_sql_similar(parse(AND, _characters))} AS INTEGER) AS distance FROM (SELECT DISTINCT s FROM parts)) USING (s) WHERE distance IS NOT NULL)"


def _brands(spark, sf_dir):
    eqs = search.equations(_table(spark, sf_dir, "part").select(F.concat(F.lit("10.5/"), "p_brand").alias("doi"), F.col("p_partkey").cast("string").alias("eqnID"), "p_name"), tokens.character_tokens(F.col("p_name")))
    meta = eqs.select("doi").distinct().select("doi", F.lit("B").alias("containerID"), F.lit("Article").alias("format"), F.lit("2000").alias("publicationYear"))
    return eqs, meta


_SHOWN = """'<' || 'Article doi="' || replace(doi, '_', '/') || '" count="' || count || '">' || equations || '</Article>'"""
_AND_TEXT = '(&quot;red&quot; AND &quot;widgit&quot;)'.replace("&quot;", '"')


@_registered(
    f"""{BRANDS}, {BRAND_HITS}, d AS (SELECT doi, count(*) AS count, min(distance) AS best, string_agg('<equation distance="' || distance || '" id="' || eqnID || '"/>', '' ORDER BY distance, eqnID) AS equations FROM hits GROUP BY doi),
    r AS (SELECT *, row_number() OVER (ORDER BY best, replace(doi, '/', '_') DESC) AS rank FROM d)
    SELECT 1 AS request, 200 AS code, '<results><query>{_AND_TEXT}</query>' || coalesce((SELECT string_agg({_SHOWN}, '' ORDER BY rank) FROM r WHERE rank BETWEEN 3 AND 6), '') || '</results>' AS body
    UNION ALL SELECT 2, 200, CASE WHEN (SELECT count(*) FROM d) > 1 THEN '<LimitExceeded/>' ELSE '<results><query>{_AND_TEXT}</query>' || coalesce((SELECT string_agg({_SHOWN}, '' ORDER BY rank) FROM r), '') || '</results>' END
    UNION ALL SELECT 3, 200, '<QueryParseError/>' UNION ALL SELECT 4, 200, '<ArgParseError/>' UNION ALL SELECT 5, 200, '<ArgParseError/>' UNION ALL SELECT 6, CASE WHEN (SELECT count(*) FROM d) > 0 THEN 500 ELSE 200 END, NULL"""
)
def service_answers(spark, sf_dir):
    """Request lines with a query string or a body, and their answers: results, and each kind of error."""
    eqs, meta = _brands(spark, sf_dir)
    term = json.dumps(AND)
    requests = [f'{{"query": {{"searchTerm": {term}, "start": "2", "count": "4"}}}}', f'{{"query": {{}}, "body": {json.dumps(json.dumps({"searchTerm": AND, "limit": "1"}))}}}', '{"query": {"searchTerm": "red"}}', "no JSON", f'{{"query": {{"searchTerm": {term}, "count": "all"}}}}']
    got = [*service.answers(requests, eqs, meta, preprocess=_characters), *service.answers([requests[0]], eqs, meta.limit(0), preprocess=_characters)]
    rows = [(n, json.loads(x)["code"], json.loads(x).get("body")) for n, x in enumerate(got, 1)]
    return spark.createDataFrame(rows, "request int, code int, body string")


@_registered(f"{BRANDS}, {BRAND_HITS} SELECT doi, eqnID, distance, p_name AS source FROM hits")
def client_search(spark, sf_dir):
    """A client's search, with the sources of what it finds."""
    eqs, meta = _brands(spark, sf_dir)
    got = service.client_search(eqs, meta, eqs.select("doi", "eqnID", F.col("p_name").alias("source")), AND, searchTimeout=300, limit=1_000_000, preprocess=_characters)
    return spark.createDataFrame([(d, *e) for d, found in got["results"] for e in found], "doi string, eqnID string, distance int, source string")


@_registered(f"{BRANDS}, {BRAND_HITS} SELECT doi, eqnID, distance FROM hits")
def indexed_search(spark, sf_dir):
    """A boolean search through postings."""
    eqs, _ = _brands(spark, sf_dir)
    index = shared.checkpointed(postings.laid_out(postings.postings(eqs, ["doi", "eqnID"])))
    return search.find_query(eqs, parse(AND, _characters), PRECISION, index=index).select("doi", "eqnID", "distance")


def _sql_whole(q: Query) -> str:
    if isinstance(q, Atom):
        return _sql_distance(f"'{q.plain}'")
    return f"{'greatest' if isinstance(q, And) else 'least'}({_sql_whole(q.left)}, {_sql_whole(q.right)})"


@_registered(f"WITH {PARTS}, d AS (SELECT s, CAST({_sql_whole(parse(NESTED, _characters))} AS INTEGER) AS distance FROM (SELECT DISTINCT s FROM parts)) SELECT id, '{to_string(parse(NESTED, _characters))}' AS query, distance FROM parts JOIN d USING (s)")
def compound_distance(spark, sf_dir):
    """A query's canonical text, and its distance from every name without a cutoff."""
    q = parse(NESTED, _characters)
    return _parts(spark, sf_dir).select("id", F.lit(to_string(q)).alias("query"), plan.whole_distance(q, F.col("tokens")).alias("distance"))


_escaped = lambda c: f"replace({c}, chr(92), chr(92) || chr(92))"
_text_answer = lambda code, body: f"""'{{"code":{code},"body":"' || {body} || '","headers":{{"Content-type":"text/plain"}}}}'"""


@_registered(
    f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 4 THEN {_text_answer(400, "'Error: ' || chr(39) || 'format' || chr(39)")} WHEN p_partkey % 7 = 0 THEN {_text_answer(500, "'Error: ' || chr(125) || ' ends nothing that is open'")}
    WHEN p_partkey % 5 = 3 THEN {_text_answer(400, "'Error: bad format argument'")} WHEN p_partkey % 5 = 0 THEN '{{"code":200,"json":' || {SQL_JSON} || '}}' WHEN p_partkey % 5 = 1 THEN {_text_answer(200, _escaped(SQL_PLAIN))}
    ELSE '{{"code":200,"json":{{"json":' || {SQL_JSON} || ',"plain":"' || {_escaped(SQL_PLAIN)} || '"}}}}' END AS answer FROM part"""
)
def preprocess_requests(spark, sf_dir):
    """Requests to preprocess as JSON lines, in each format, without one, in one that doesn't exist, and with bad formulae."""
    kind = F.try_element_at(F.array(*map(F.lit, ("json", "plain", "json-plain", "xml"))), (F.col("id") % 5 + 1).cast("int"))
    query = F.to_json(F.struct(F.struct(kind.alias("format"), "latex", "id").alias("query")))
    got = service.preprocess_all(_formulae(spark, sf_dir).select(query.alias("value")))
    return got.select(F.get_json_object("request", "$.query.id").cast("bigint").alias("id"), "answer")


@_registered(f"WITH {PARTS}, t AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS term FROM part) SELECT term, (SELECT count(*) FROM parts WHERE contains(s, term)) AS n FROM t")
def term_replay(spark, sf_dir):
    """Terms from a file, one to a line, replayed one after the other."""
    path = f"{shared.folder(spark)}/terms-{uuid.uuid4().hex}"
    _table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1))).distinct().write.text(path)
    found, eqs = {}, _parts(spark, sf_dir)
    for term, _ in logs.replay(logs.term_file(spark, path), lambda t: found.update({t: search.find_exact(eqs, _characters(t)[0]).count()})):
        assert term in found
    shared.remove(spark, path)
    return spark.createDataFrame([*found.items()], "term string, n bigint")


@_registered(f"WITH {CORPUS} SELECT doi, count(*) AS count FROM corpus WHERE contains(s, '{EXACT}') AND CAST(substr(doi, 9) AS BIGINT) % 3 <> 0 GROUP BY doi")
def collate_dummy(spark, sf_dir):
    """Documents of hits, where a third of the orders have the dummy's key."""
    eqs = _corpus(spark, sf_dir)
    eqs = eqs.withColumn("doi", F.when(F.substring("doi", 9, 20).cast("bigint") % 3 == 0, "").otherwise(F.col("doi")))
    return search.collate(search.find_exact(eqs, _characters(EXACT)[0])).select("doi", "count")


@_registered(
    f"""WITH {STORED}, y AS (SELECT doi, publicationYear AS year FROM incoming) SELECT doi, coalesce(year, publicationYear) AS publicationYear, CASE WHEN year IS NULL THEN 'missing' WHEN year = publicationYear THEN 'same' ELSE 'changed' END AS year_status FROM stored LEFT JOIN y USING (doi)"""
)
def years_check(spark, sf_dir):
    years = _incoming(spark, sf_dir).select("doi", F.concat("publicationYear", F.lit("-01-01")).alias("year"))
    return tables.check_years(_stored(spark, sf_dir), years).select("doi", "publicationYear", "year_status")


@_registered(f"WITH {STORED} SELECT s.doi, coalesce(i.type, s.type) AS type, coalesce(i.containerID, s.containerID) AS containerID FROM stored s LEFT JOIN incoming i USING (doi)")
def store_repair(spark, sf_dir):
    return tables.repair(_stored(spark, sf_dir), _incoming(spark, sf_dir)).select("doi", "type", "containerID")


@_registered("SELECT CAST(doc_id AS VARCHAR) AS doi, source AS containerID FROM documents")
def field_rename(spark, sf_dir):
    old = _stored(spark, sf_dir).select("doi", F.col("containerID").alias("journalID"), F.lit(None).cast("string").alias("containerID"))
    return tables.rename_field(old).select("doi", "containerID")


@_registered("SELECT CAST(conv_id AS VARCHAR) AS doi, 'T' || turn AS eqnID, CAST(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS INTEGER) AS n FROM conversations")
def reprocess(spark, sf_dir):
    """Content anew from a source of conversations' turns."""
    pairs = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("T"), "turn"), "text")))
    docs = _table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("doi")).agg(pairs.alias("source"))
    return tables.equation_rows(tables.reprocess(docs, tokens.word_tokens)).select("doi", "eqnID", F.size("tokens").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a boolean search over orders' parts."""
    return search_rank_page(spark, sf_dir)
