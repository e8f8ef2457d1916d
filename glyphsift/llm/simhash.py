"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import checkpointed, fresh
from . import jaccard
from .common import kept, map_rows, once, without
from .components import components

#: Bits of a segment, of which a fingerprint has two; and differing bits of linked fingerprints, of which
#: by the pigeonhole principle one segment has one at most.
SEGMENT, MOST = 32, 3
#: Fingerprints of one table slot beyond which it is divided further.
BLOCK = 64
#: Fingerprints of the near-duplicate stage, of two segments each. Sets of similarity 0.8 have a given segment alike with a
#: probability of 0.27 (measured; 0.25 for sets of 9 and 0.226 for sets of 5 and 4, the smallest there are), so that none is
#: alike for fewer than 2 pairs in a million, and more similar ones more often.
FINGERPRINTS = 26
#: What draws a byte's votes, one row for each byte of the fingerprints; and the votes of a byte's values.
DRAWS = np.random.default_rng(20).integers(0, 1 << 64, (8 * FINGERPRINTS, 1), np.uint64)
SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little") * 2.0 - 1


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """64 bits: bit j is 1 if it is set in over half of the shingles' hashes.

    Words are what ASCII white space separates after A-Z are lower-cased; shingles are runs of `words` words,
    repeats included, joined by a space (all words, if fewer); the hash is XXH64 with seed 42. Null and
    wordless texts have fingerprint 0.
    """
    found = (text or b"").lower().split()
    if not found:
        return 0
    joined, ends, at = b" ".join(found), [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = min(words, len(ends)) - 1
    votes, n = np.zeros(64, np.int64), len(ends) - last
    for k in range(0, n, 1 << 16):
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[k : min(n, k + (1 << 16))], ends[k + last :], strict=False)], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def segments(hashes: np.ndarray) -> list[int]:
    """The 32-bit segments, as signed integers, of FINGERPRINTS weighted fingerprints of a set of shingles' hashes; none of
    an empty set.

    Bit j is 1 if the shingles that vote for it outweigh the others. At a similarity of 0.8 a fingerprint of equal votes
    has some 10 of 64 bits changed, wherever it is drawn, and a ball of that radius can't be looked up. With a weight
    of 1 / u ** 2 for each shingle, u being drawn uniformly for each byte anew, a byte's few heaviest shingles settle it:
    where both sets have these, the byte is mostly the same, and of all segments some are, however few shingles there are.
    """
    if not len(hashes):
        return []
    votes = np.zeros(len(DRAWS) * 256)
    first = np.arange(0, len(votes), 256)[:, None]
    for k in range(0, len(hashes), 512):
        # In place, as new arrays of this size cost more than the arithmetic. The mixing is SplitMix64's.
        x = hashes[k : k + 512] + DRAWS
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        weight = (x >> np.uint64(11)).astype(np.float64)
        weight += 1
        weight *= weight
        np.divide(1, weight, out=weight)
        x &= np.uint64(255)
        at = x.view(np.int64)
        at += first
        votes += np.bincount(at.ravel(), weight.ravel(), len(votes))
    return np.packbits(votes.reshape(-1, 256) @ SIGNS > 0, axis=1, bitorder="little").ravel().view("<i4").tolist()


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp bigint) of every row; other columns play no part."""

    def make():
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return lambda ids, texts: (ids, [signed(fingerprint(t, words)) for t in texts])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_rows(docs, ["doc_id", "text"], "doc_id bigint, fp bigint", make)


def _slots(fp: Column) -> Column:
    """A fingerprint's two table slots: the segment's number above its bits."""
    return F.array(fp.bitwiseAND(F.lit((1 << SEGMENT) - 1)), F.shiftrightunsigned(fp, SEGMENT).bitwiseOR(F.lit(1 << SEGMENT)))


def _balls(bits: int, most: int) -> np.ndarray:
    """Masks of up to `most` of so many bits."""
    masks = [0]
    for k in range(1, most + 1):
        masks += [sum(1 << b for b in c) for c in itertools.combinations(range(bits), k)]
    return np.array(masks)


def _forest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Edges that connect whatever the links between two sets connect, whose fingerprints are equal within each but
    for 16 bits: each with the least of those it is connected to, found by passing minima over the Hamming ball until
    nothing changes. Work and memory are bounded by the 2 ** 16 values, not by the number of pairs."""
    if not len(a) or not len(b):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    none, free = np.iinfo(np.int64).max, int(a["free"].iloc[0])
    sides = []
    for rows in (a, b):
        value = (rows["fp"].to_numpy() >> free) & 0xFFFF
        label = np.full(1 << 16, none)
        label[value] = rows["rep"].to_numpy()
        sides.append((value, rows["rep"].to_numpy(), label))
    (va, ra, la), (vb, rb, lb) = sides
    masks, there = _balls(16, MOST - int(a["spent"].iloc[0])), (la != none, lb != none)
    while True:
        before = la.copy(), lb.copy()
        for own, other, label, ok in ((va, vb, la, there[1]), (vb, va, lb, there[0])):
            source = lb if label is la else la
            for m in masks:
                met = ok[own ^ m]
                label[own[met]] = np.minimum(label[own[met]], source[own[met] ^ m])
        if (la == before[0]).all() and (lb == before[1]).all():
            break
    found = pd.DataFrame({"a": np.r_[ra, rb], "b": np.r_[la[va], lb[vb]]})
    return found[found["a"] != found["b"]]


def links(reps: DataFrame) -> DataFrame:
    """Edges (a, b) between rows (fp, rep), fp and rep distinct, that connect what links of MOST differing bits connect.

    A row is in the table of each segment at that segment's value. It looks up, in each, the ball of radius
    one about its value; of two values a bit apart, the one with the bit at 0 looks up the other, so that
    half a ball does. Whatever is fetched is verified over all 64 bits.

    A slot of over BLOCK rows is divided by the halves of the other segment, one of which differs in one bit at most
    as well: its rows are in a table of each half, and its lookups look up the ball there. Where over BLOCK rows
    have 48 bits in common still, the 16 others are searched by their Hamming balls, and give a forest (_forest()) in
    place of all links. So no slot's work grows with the square of its rows.
    """
    slots = reps.select("fp", "rep", F.explode(_slots(F.col("fp"))).alias("slot"))
    masks = F.array(*(F.lit(m).cast("bigint") for m in [0, *(1 << k for k in range(SEGMENT))]))
    ball = F.transform(F.filter(masks, lambda m: F.col("slot").bitwiseAND(m) == 0), lambda m: F.col("slot").bitwiseXOR(m))
    lookups = slots.select(F.explode(ball).alias("slot"), F.col("fp").alias("fp_a"), F.col("rep").alias("a"), F.col("slot").alias("own"))
    found = slots.select("slot", F.col("fp").alias("fp_b"), F.col("rep").alias("b"))
    near = (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= MOST) & ((F.col("own") != F.col("slot")) | (F.col("fp_a") < F.col("fp_b")))
    large = checkpointed(slots.groupBy("slot").count().where(F.col("count") > BLOCK).select("slot"))
    if large.isEmpty():
        return lookups.join(found, "slot").where(near).select("a", "b")
    plain = lookups.join(found.join(large, "slot", "left_anti"), "slot").where(near).select("a", "b")
    # The other segment is the upper one for slots of the lower one's table.
    lower = F.shiftright("slot", SEGMENT) == 0
    half = lambda fp, k: F.when(lower, F.shiftrightunsigned(fp, SEGMENT + 16 * k)).otherwise(F.shiftrightunsigned(fp, 16 * k)).bitwiseAND(F.lit(0xFFFF).cast("bigint"))
    halves = lambda fp: F.explode(F.array(*(F.struct(F.lit(k).alias("half"), half(fp, k).alias("value")) for k in (0, 1))))
    rows = found.join(large, "slot").select("slot", "fp_b", "b", halves(F.col("fp_b")).alias("h")).select("slot", "h.*", "fp_b", "b")
    small_ball = F.array(*(F.lit(m).cast("bigint") for m in [0, *(1 << k for k in range(16))]))
    seek = lookups.join(large, "slot").select("slot", "own", "fp_a", "a", halves(F.col("fp_a")).alias("h")).select("slot", "own", "fp_a", "a", "h.half", F.col("h.value").alias("own_value"))
    seek = seek.select("*", F.explode(F.transform(small_ball, lambda m: F.col("own_value").bitwiseXOR(m))).alias("value"))
    key = ["slot", "half", "value"]
    dense = checkpointed(rows.groupBy(*key).count().where(F.col("count") > BLOCK).select(*key))
    if dense.isEmpty():
        return plain.union(seek.join(rows, key).where(near).select("a", "b"))
    divided = seek.join(rows.join(fresh(dense), key, "left_anti"), key).where(near).select("a", "b")
    # Both sides of a task have 48 bits in common each, and 65,536 rows at most.
    within = [*key, "own", "own_value"]
    # Between two slots, or two values, a bit apart the other direction is looked up as well, or is the same.
    spent = F.bit_count(F.col("own").bitwiseXOR(F.col("slot"))) + F.bit_count(F.col("own_value").bitwiseXOR(F.col("value")))
    free = F.when(lower, SEGMENT).otherwise(0) + F.when(F.col("half") == 0, 16).otherwise(0)
    left = seek.join(fresh(dense), key).where(spent <= MOST).select(*within, F.col("fp_a").alias("fp"), F.col("a").alias("rep"), spent.cast("int").alias("spent"), free.cast("int").alias("free"))
    pairs = left.select(*within).distinct()
    right = fresh(rows).join(pairs, key).select(*within, F.col("fp_b").alias("fp"), F.col("b").alias("rep"))
    trees = left.groupBy(*within).cogroup(fresh(right).groupBy(*within)).applyInPandas(_forest, "a bigint, b bigint")
    return plain.union(divided).union(trees)


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable over links.

    Equal fingerprints meet in an aggregation; only distinct ones are looked up and linked, each for its
    smallest doc_id. Empty tables give no rows. Repeated rows each get one. Rows with a null doc_id get a
    component only through others with the same fingerprint.
    """
    prints = checkpointed(fingerprints(docs))
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(reps.where("rep IS NOT NULL")))
    of = reps.join(roots, reps.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first, by doc_id, of their group of near copies (see jaccard), and once each.

    Texts that share a segment of a weighted fingerprint (see segments()) are looked up in tables and verified on their
    shingles. The query's links at MOST bits of a fingerprint of equal votes play no part, as most near copies lie further
    apart. Rows are told apart by doc_id and text: those that share the former keep all their texts, and of rows with both
    alike one stays. Rows without a doc_id stay, as none of their group can be told from the others; null and wordless
    texts are copies of one another. Of texts with as small an id the one with the smaller hash is the first. An empty
    table gives no rows; other columns are kept, whatever their names.
    """
    gone, repeated = jaccard.decisions(docs, segments)
    own = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(docs.columns)]
    rows = docs.where(F.col("doc_id").isNotNull()).select(*own, jaccard.node_of(docs).alias("node"))
    stay = once(without(rows, gone, "node"), repeated, "node")
    return kept(stay, docs).union(docs.where(F.col("doc_id").isNull()))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
