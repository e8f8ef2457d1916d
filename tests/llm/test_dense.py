"""Groups that are dense: fingerprints with much in common, and rows that share an id, a text or both."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphsift.llm import common, components, simhash
from tests.llm.test_operators import DOCS, clashing, prose


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def frame(spark, prints):
    return spark.createDataFrame([(signed(p), k) for k, p in enumerate(prints)], "fp bigint, rep bigint")


def roots(prints):
    x = np.array(prints, np.uint64)
    label = np.arange(len(x))
    near = [np.flatnonzero(np.bitwise_count(x ^ v) <= simhash.MOST) for v in x]
    while True:
        new = np.array([label[n].min() for n in near])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label.tolist()
        label = new


def kinds():
    r = random.Random(3)
    flip = lambda p, bits: p ^ sum({1 << b for b in bits})
    centre = r.getrandbits(64)
    yield "one slot", [7 << 32 | r.getrandbits(32) for _ in range(1500)] + [r.getrandbits(32) << 32 | 9 for _ in range(700)]
    yield "beside a large slot", [7 << 32 | r.getrandbits(32) for _ in range(700)] + [5 << 32 | r.getrandbits(32) for _ in range(60)]
    yield "a ball", [flip(centre, (r.randrange(64) for _ in range(r.randint(0, 5)))) for _ in range(1500)]
    yield "48 bits in common", [centre & ~(0xFFFF << 16) | v << 16 for v in r.sample(range(1 << 16), 900)] + [flip(centre, (40,)) & ~(0xFFFF << 16) | v << 16 for v in r.sample(range(1 << 16), 300)]


@pytest.mark.parametrize(("kind", "prints"), [(k, sorted(set(p))) for k, p in kinds()])
def test_links_are_brute_force(spark, kind, prints):
    got = {x.node: x.root for x in components.components(simhash.links(frame(spark, prints))).collect()}
    assert [got.get(k, k) for k in range(len(prints))] == roots(prints)


def test_links_of_a_slot_grow_with_its_rows(spark):
    r, took = random.Random(4), []
    for n in (15_000, 60_000):
        reps = frame(spark, {7 << 32 | r.getrandbits(32) for _ in range(n)}).cache()
        reps.count()
        began = time.monotonic()
        simhash.links(reps).count()
        took.append(time.monotonic() - began)
    assert took[1] < 10 * max(took[0], 1)


@pytest.mark.parametrize("bound", [0, 500_000])
def test_near_dedup_decides_by_row(spark, monkeypatch, bound):
    monkeypatch.setattr(common, "BROADCAST_KEYS", bound)
    a, b, c = (prose(60, k) for k in (1, 2, 3))
    run = lambda rows: sorted((x.doc_id, x.text) for x in simhash.near_dedup(clashing(spark.createDataFrame(rows, DOCS))).collect())
    assert run([(1, a), (3, a), (3, b), (5, c)]) == sorted([(1, a), (3, b), (5, c)])
    assert run([(7, a), (7, b)]) == sorted([(7, a), (7, b)])
    assert run([(7, a), (7, b)] * 3 + [(9, b)]) == sorted([(7, a), (7, b)])


def test_once_is_the_same_in_any_order(spark):
    rows = [(1, "x", k) for k in range(6)] + [(2, "y", 0)]
    pick = lambda rows: sorted(tuple(x) for x in common.once(spark.createDataFrame(rows, "k int, t string, n int").repartition(3), spark.range(1, 2).select(F.col("id").cast("int").alias("k")), "k").collect())
    assert len(pick(rows)) == 2
    assert pick(rows) == pick(rows[::-1])
