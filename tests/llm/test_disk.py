"""What is left on disk of steps that are over."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from glyphsift import shared
from glyphsift.llm import components, jaccard, simhash
from tests.llm.test_operators import DOCS, prose


def shuffle_files(spark):
    of = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {name for top in of for _, _, names in os.walk(top) for name in names if name.startswith("shuffle_")}


def checkpoints(spark):
    return {name for name in os.listdir(shared.folder(spark).removeprefix("file:")) if name.startswith("rdd-")}


def gone(files):
    """Whether nothing is left soon, as executors delete in their own time."""
    end = time.time() + 20
    while files() and time.time() < end:
        time.sleep(0.1)
    return not files()


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    counts = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = shuffle_files(spark), spark.conf.get(shared.CLEANUP)
    rows = shared.checkpointed(counts)
    assert gone(lambda: shuffle_files(spark) - before)
    assert spark.conf.get(shared.CLEANUP) == setting
    want = sorted((k, len(range(k, 100, 7))) for k in range(7))
    # What it was made of can be read again and again, as can what was kept of it.
    for df in (counts, rows, counts, rows):
        assert sorted(map(tuple, df.collect())) == want


def test_rounds_of_components_leave_no_files(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    kept, shuffled = checkpoints(spark), shuffle_files(spark)
    roots = components.components(edges)
    assert len(checkpoints(spark) - kept) == 1
    assert gone(lambda: shuffle_files(spark) - shuffled)
    assert sorted(map(tuple, roots.collect())) == [(k, 0) for k in range(1, 61)]


@pytest.mark.parametrize("block", [1, 64])
def test_steps_of_near_duplicates_leave_few_files(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "DENSE", 3)
    r, texts = random.Random(3), []
    for k in range(12):
        base = prose(150, 2000 + k).split()
        for changes in (0, 2, 5, 8, 11):
            at = set(r.sample(range(150), changes))
            texts.append(" ".join("changed" if i in at else w for i, w in enumerate(base)))
    docs = spark.createDataFrame([*enumerate(texts)], DOCS)
    kept, shuffled = checkpoints(spark), shuffle_files(spark)
    went, _ = jaccard.decisions(docs, simhash.segments)
    # Links, roots and keys of up to three passes, the dense slots' texts, and what is returned: nothing that holds segments or sets.
    assert len(checkpoints(spark) - kept) <= 10
    assert gone(lambda: shuffle_files(spark) - shuffled)
    assert 0 < went.count() < len(texts)
