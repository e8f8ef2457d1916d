"""Benchmark decontamination by template windows. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, without
from .jaccard import node_of
from .windows import window_hash

#: Words of a window (items with fewer words have one window of them all), and literal ones that a window
#: with placeholders must have.
WINDOW, LITERAL = 8, 4
#: An item is in a document where its windows cover this many of its words, or this share of a shorter item.
RUN, SHARE = 13, 0.8
#: Windows of the benchmark, of some 100 bytes each, up to which their table is broadcast.
BROADCAST_ROWS = 500_000

#: Words for numbers and units.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers mg g kg gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees mph kph".split()
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"


#: Stands between the parts of a value of several tokens: a letter, so that the value is one token.
JOIN = "\ua78f"
_START, _END, _WORD = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])", f"(?i:{'|'.join(sorted(NUMBERS, key=len, reverse=True))})"
_CAPITAL = r"[\p{Lu}\p{Lt}](?:[\p{L}\p{N}&&[^\p{Lu}\p{Lt}]])*+"
_JOINED = [
    (rf"{_START}([0-9]+)[.,'’](?=[0-9])", f"$1{JOIN}"),
    (rf"{_START}([0-9][\p{{L}}\p{{N}}]*+|{_WORD}{_END})(?:[\s-]+|(?<=(?i:hundred|thousand|million|billion))\s+and\s+)(?={_WORD}{_END})", f"$1{JOIN}"),
    (rf"{_START}(?!{_WORD}{_END})({_CAPITAL})(?:[ \t]+|['’-])(?=(?!{_WORD}{_END}){_CAPITAL}{_END})", f"$1{JOIN}"),
]


def whole_values(text: Column) -> Column:
    """text with the parts of numbers (decimals, thousands, number words in a row) and of runs of capitalised
    words put together by JOIN."""
    text = F.translate(text, JOIN, " ")
    for pattern, to in _JOINED:
        text = F.regexp_replace(text, pattern, to)
    return text


def tokens(text: Column) -> Column:
    """Runs of letters and digits, as written."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+"), "")


def canonical(token: Column, joined: bool = False) -> Column:
    """A token's place in a template: a typed placeholder for what starts with a digit or is a number in words,
    for units, and for capitalised words; else the token in lower case. With joined, whole_values() are one."""
    first, low = F.substring(token, 1, 1), F.lower(token)
    rest = F.substring(token, 2, 1 << 30)
    if joined:
        value = F.when(first.between("0", "9") | F.substring_index(low, JOIN, 1).isin(NUMBERS), NUM).otherwise(NAME)
        return F.when(token.contains(JOIN), value).otherwise(canonical(token))
    return (
        F.when(first.between("0", "9") | low.isin(NUMBERS), NUM)
        .when(low.isin(UNITS), UNIT)
        .when((first != F.lower(first)) & (rest == F.lower(rest)), NAME)
        .otherwise(low)
    )


def _hashed(rows: DataFrame, joined: bool) -> DataFrame:
    """Adds the hashes of the words in lower case, and of canonical() of them, from which the former are spared."""
    of = lambda *xs: [F.xxhash64(F.lit(x)) for x in xs]
    rows = rows.withColumn("low", F.transform("w", F.lower)).withColumn("raw", F.transform("low", lambda t: F.xxhash64(t)))

    def hashed(t: Column, i: Column) -> Column:
        low, raw, rest = F.get("low", i), F.get("raw", i), F.substring(t, 2, 1 << 30)
        # What isn't in lower case as a whole and is so without its first letter is capitalised.
        name = (low != t) & (rest == F.lower(rest))
        if joined:
            of_first = F.xxhash64(F.substring_index(low, JOIN, 1)).isin(of(*NUMBERS))
            value = F.when(((t >= "0") & (t < ":")) | of_first, of(NUM)[0]).otherwise(of(NAME)[0])
        found = F.when(((t >= "0") & (t < ":")) | raw.isin(of(*NUMBERS)), of(NUM)[0]).when(raw.isin(of(*UNITS)), of(UNIT)[0]).when(name, of(NAME)[0]).otherwise(raw)
        return F.when(t.contains(JOIN), value).otherwise(found) if joined else found

    return rows.withColumn("tpl", F.transform("w", hashed)).drop("low")


def _windows(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds position and window, the hashes of the windows there: one over words as they are, and one over the
    template where it has placeholders and enough literal words besides."""
    # The outer form, as Spark would repeat the tokenisation in a filter on the array's size for the inner one.
    at = rows.select("*", F.posexplode_outer("raw").alias("at", "x")).drop("x")
    marks = [F.xxhash64(F.lit(x)) for x in (NUM, UNIT, NAME)]
    found = []
    for k in lengths:
        slots = sum((F.coalesce(F.get("tpl", F.col("at") + i).isin(*marks), F.lit(False)).cast("int") for i in range(k)), F.lit(0))
        found.append(F.struct(window_hash("raw", "at", k, F.lit(0), F.lit(k)).alias("window"), F.lit(k).alias("k"), F.lit(False).alias("template")))
        able = (slots > 0) & (slots <= k - min(LITERAL, k - 1))
        found.append(F.struct(F.when(able, window_hash("tpl", "at", k, F.lit(1), F.lit(k))).alias("window"), F.lit(k).alias("k"), F.lit(True).alias("template")))
    return at.withColumn("v", F.explode(F.array(*found))).select("*", "v.*").drop("v").where("window IS NOT NULL")


def leaks(docs: DataFrame, items: DataFrame, joined: bool = False) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, coverage, kind) for every document that holds an item.

    Windows of words and of templates are joined by hash with those of the items and compared by their words.
    The matches of a document and an item that lie on one diagonal, the document's position less the item's,
    form a passage. Its kind is verbatim where the windows of words alone cover RUN of the item's words (SHARE
    of a shorter item); else it is reparameterised where those and template windows do, and the slots agree:
    whatever stands in one of the item's slots is replaced by one thing throughout. n_words counts the item's
    words that are covered, coverage is their share. Of several passages the longest is given, then the first.

    Null and empty texts and items give no rows; neither do empty tables. Rows with one doc_id or one item_id
    are taken together. Other columns play no part.

    With joined, whole_values() count as one word, in documents and items alike: a value of another number of
    tokens then leaves the diagonal as it is.
    """
    words = lambda: tokens(whole_values(F.col("text")) if joined else F.col("text"))
    place = lambda t: canonical(t, joined)
    parts = _hashed(items.select("item_id", words().alias("w")).where(F.size("w") > 0).withColumn("n", F.size("w")), joined)
    lengths = [r[0] for r in parts.select(F.least("n", F.lit(WINDOW))).distinct().collect()] or [WINDOW]
    mine = _windows(parts, lengths).where(F.col("k") == F.least("n", F.lit(WINDOW)))
    mine = mine.select("window", "item_id", "n", "k", "template", F.col("at").alias("item_at"), F.slice("w", F.col("at") + 1, F.col("k")).alias("item_w"))
    small = mine.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    theirs = _windows(_hashed(docs.select("doc_id", words().alias("w")), joined), lengths).select("doc_id", "at", "window", "w")
    if not small:
        # Windows that no item has go before words are attached to the rest.
        theirs = theirs.select("doc_id", "at", "window", F.slice("w", F.col("at") + 1, max(lengths)).alias("w"), F.lit(0).alias("from"))
    else:
        theirs = theirs.withColumn("from", F.col("at"))
    joined = theirs.join(F.broadcast(mine) if small else mine, "window")
    joined = joined.select("doc_id", "at", "item_id", "n", "k", "template", "item_at", "item_w", F.slice("w", F.col("from") + 1, F.col("k")).alias("doc_w"))
    form = lambda w: F.when(F.col("template"), F.transform(w, place)).otherwise(F.transform(w, F.lower))
    pairs = F.filter(F.arrays_zip(F.transform("item_w", F.lower).alias("i"), F.transform("doc_w", F.lower).alias("d"), F.transform("item_w", place).alias("c")), lambda p: p["c"].isin(NUM, UNIT, NAME))
    # As a value, not a filter: a filter would become a condition of the join and take it out of generated code.
    same = form(F.col("item_w")) == form(F.col("doc_w"))
    met = joined.withColumn("diagonal", F.col("at") - F.col("item_at")).withColumn("slots", F.transform(pairs, lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d")))).withColumn("same", same)
    spread = lambda c: F.size(F.array_distinct(F.flatten(F.transform(c, lambda p: F.sequence(p, p + F.col("k") - 1)))))
    passages = met.groupBy("doc_id", "item_id", "n", "k", "diagonal").agg(
        F.collect_set(F.when(F.col("same") & ~F.col("template"), F.col("item_at"))).alias("plain"),
        F.collect_set(F.when(F.col("same"), F.col("item_at"))).alias("every"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("same"), F.col("slots"))))).alias("slots"),
        F.min(F.when(F.col("same"), F.col("at"))).alias("first_word"),
    )
    need = F.least(F.lit(RUN), F.ceil(F.col("n") * SHARE))
    agree = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["i"])))
    passages = passages.withColumn("plain_words", spread(F.col("plain"))).withColumn("every_words", spread(F.col("every")))
    passages = passages.withColumn("kind", F.when(F.col("plain_words") >= need, "verbatim").when((F.col("every_words") >= need) & agree, "reparameterised")).where("kind IS NOT NULL")
    words = F.when(F.col("kind") == "verbatim", F.col("plain_words")).otherwise(F.col("every_words")).cast("bigint")
    best = F.max(F.struct(words.alias("n_words"), (-F.col("first_word")).alias("at"), "kind", (words / F.col("n")).alias("coverage"))).alias("b")
    return passages.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("b.at")).cast("bigint").alias("first_word"), "b.n_words", "b.coverage", "b.kind")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with its tokens as they are or with whole_values() as one word.

    Rows are told apart by doc_id and text, so that those without a doc_id, or with one that others have, go by
    their own text; rows with both alike stay or go together. Null and empty texts hold nothing; empty tables
    of documents give no rows, those of items leave all. Other columns are kept, whatever their names.
    """
    own = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(docs.columns)]
    rows = docs.select(*own, "text", node_of(docs).alias("doc_id"))
    held = leaks(rows, items).select("doc_id").union(leaks(rows, items, joined=True).select("doc_id"))
    return kept(without(rows, held, "doc_id"), docs)
