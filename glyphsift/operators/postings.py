"""An index of short runs of tokens, and search through it for one query or for many at once.

A posting is the hash of a run and its sequence's keys, never the sequence. What meets by hash is verified on the
sequences, each of which is fetched once for a query.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import cutoff, cutoff_column, distance, fragments, fragments_column
from ..functions.tokens import framed
from ..plans.query import And, Atom, Query
from ..shared import checkpointed, fresh

#: Tokens of the longest run in a stored index; lengths of runs for a join, which makes its postings as it goes; and the
#: length from which on a run is taken to be rare, so that its sequences needn't be counted.
GRAM, LENGTHS, RARE = 3, (1, 2, 3, 5, 8), 5
#: Rows, of some 100 bytes, up to which a side is broadcast.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """A checkpointed df, marked for broadcast if it has up to BROADCAST_ROWS rows, which are counted."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _run_hash(hashes: Column, at: Column | int, n: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.xxhash64(F.lit(n), *(F.get(hashes, at + i) for i in range(n)))


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _run_hashes(hashes: Column, n: int) -> Column:
    """Hashes of all runs of n tokens, of sequences that have as many."""
    return F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: _run_hash(hashes, i, n))


def run_hash(tokens: list[str]) -> Column:
    """Hash of a run that the index has."""
    return F.xxhash64(F.lit(len(tokens)), *(F.xxhash64(F.lit(t)) for t in tokens))


def postings(eqs: DataFrame, keys: list[str]) -> DataFrame:
    """(gram, keys) of each run of 1 to GRAM tokens, once for each sequence. Null and empty sequences have none."""
    hashed = eqs.where(F.size("tokens") > 0).select(*keys, _hashes(F.col("tokens")).alias("_h"))
    h = F.col("_h")
    each = lambda n: F.when(F.size(h) >= n, _run_hashes(h, n)).otherwise(F.array().cast("array<bigint>"))
    return hashed.select(F.explode(F.concat(*(F.array_distinct(each(n)) for n in range(1, GRAM + 1)))).alias("gram"), *keys)


def occurrences(eqs: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """(gram, keys) of each run of the given lengths, as often as it stands there, in generated code throughout."""
    at = eqs.where(F.size("tokens") > 0).select(*keys, _hashes(F.col("tokens")).alias("_h")).select(*keys, "_h", F.posexplode("_h").alias("_at", "_x"))
    found = [F.when(F.col("_at") <= F.size("_h") - n, _run_hash(F.col("_h"), F.col("_at"), n)) for n in lengths]
    grams = at.select(found[0].alias("gram"), *keys) if len(found) == 1 else at.select(F.explode(F.array(*found)).alias("gram"), *keys)
    return grams.where("gram IS NOT NULL")


def laid_out(rows: DataFrame) -> DataFrame:
    """An index in the order of its runs, so that a scan for some of them skips the rest; a common run is split by keys."""
    order = ["gram", *(c for c in rows.columns if c != "gram")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def candidates(index: DataFrame, query: Query, precision: float) -> DataFrame:
    """Keys of the sequences that may match: those that for some fragment of an atom have all its runs of GRAM tokens, or
    the fragment itself if it is shorter; AND and OR as with plans.compile.gather()."""
    keys, grams = [c for c in index.columns if c != "gram"], []

    def condition(q: Query) -> Column:
        if not isinstance(q, Atom):
            left, right = condition(q.left), condition(q.right)
            return left & right if isinstance(q, And) else left | right
        found = F.lit(False)
        for part in fragments(list(q.tokens), cutoff(precision, len(q.tokens))):
            n, here = min(GRAM, len(part)), []
            for i in range(len(part) - n + 1):
                if part[i : i + n] not in grams:
                    grams.append(part[i : i + n])
                here.append(F.col(f"g{grams.index(part[i : i + n])}"))
            found = found | reduce(lambda a, b: a & b, here)
        return found

    wanted = condition(query)
    if not grams:
        return index.select(*keys).limit(0)
    met = index.where(reduce(lambda a, b: a | b, (F.col("gram") == run_hash(g) for g in grams)))
    flags = [F.max(F.col("gram") == run_hash(g)).alias(f"g{i}") for i, g in enumerate(grams)]
    return met.groupBy(*keys).agg(*flags).where(wanted).select(*keys)


def narrowed(eqs: DataFrame, index: DataFrame, query: Query, precision: float) -> DataFrame:
    """The sequences that the index doesn't rule out."""
    found = checkpointed(candidates(index, query, precision))
    return eqs.join(small(fresh(found)), found.columns, "left_semi")


def similarity_join(eqs: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """(query_id, keys, distance) of each query (query_id, tokens, precision) and each sequence similar to it.

    Of each fragment of a query one run looks up the sequences' postings: of its longest runs the one that
    occurs least, or any if it is long. A pair that meets there is kept if a whole fragment stands in the sequence, and then if the
    distance is below the cutoff. It is an equi-join of hashes and keys, whose skew Spark's adaptive execution splits, in
    place of all pairs; the sequences are joined once, to the distinct pairs. Queries without tokens find nothing.
    """
    cut = queries.select("query_id", F.col("tokens").alias("q"), cutoff_column(F.col("precision"), F.size("tokens")).alias("k"))
    cut = checkpointed(cut.withColumn("parts", fragments_column(F.col("q"), F.col("k"))))
    size = lambda f: reduce(lambda a, n: F.when(F.size(f) >= n, n).otherwise(a), LENGTHS[1:], F.lit(LENGTHS[0]))
    parts = cut.select("query_id", F.posexplode("parts").alias("part", "f")).withColumn("n", size(F.col("f")))
    lengths = sorted(r[0] for r in parts.select("n").distinct().collect())
    if not lengths:
        return cut.join(eqs.select(*keys).limit(0), F.lit(False)).select("query_id", *keys, F.lit(0).alias("distance"))
    h = F.col("_h")
    of = [F.when(F.col("n") == n, _run_hashes(h, n)) for n in lengths]
    runs = checkpointed(parts.withColumn("_h", _hashes(F.col("f"))).select("query_id", "part", "n", F.explode(F.array_distinct(F.coalesce(*of))).alias("gram")))
    # A short run that no sequence has rules its fragment out; of long ones any does, and the least hash is taken.
    short = checkpointed(runs.where(F.col("n") < RARE))
    wanted = fresh(runs.where(F.col("n") >= RARE)).withColumn("count", F.lit(1).cast("bigint"))
    if not short.isEmpty():
        some = occurrences(eqs, keys, [n for n in lengths if n < RARE])
        common = some.join(small(fresh(short.select("gram").distinct())), "gram", "left_semi").groupBy("gram").count()
        wanted = wanted.unionByName(fresh(short).join(common, "gram"))
    best = wanted.groupBy("query_id", "part").agg(F.min(F.struct("count", "gram")).alias("b"))
    lookups = checkpointed(best.select("query_id", F.col("b.gram").alias("gram")).distinct())
    theirs = occurrences(eqs, keys, lengths)
    pairs = checkpointed(theirs.join(small(fresh(lookups)), "gram").select("query_id", *keys).distinct())
    full = pairs.select(*keys).distinct()
    met = fresh(pairs).join(eqs.join(small(fresh(checkpointed(full))), keys, "left_semi").select(*keys, "tokens", "canon"), keys).join(small(fresh(cut)), "query_id")
    held = met.where(F.exists("parts", lambda f: F.contains("canon", framed(f))))
    # With a cutoff of 1 a query stands in a sequence as it is, or is not similar.
    d = F.when(F.col("k") == 1, F.when(F.contains("canon", framed(F.col("q"))), 0).otherwise(1)).otherwise(distance(F.col("q"), F.col("tokens")))
    return held.withColumn("distance", d).where(F.col("distance") < F.col("k")).select("query_id", *keys, "distance")
