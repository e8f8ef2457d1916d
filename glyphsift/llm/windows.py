"""Hashed word windows as native expressions.

Word arrays stay whole in their row; a generator gives the positions, and a window's hash is put together
from the hashes of its words by array access in generated code, so that no window's text is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_hashes(words: str | Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hash(hashes: str, at: str, k: int, *seed: Column) -> Column:
    """Hash of the k words from position `at` (from 0) on; null where fewer are left."""
    parts = [F.get(F.col(hashes), F.col(at) + i) for i in range(k)]
    return F.when((F.col(at) >= 0) & (F.col(at) <= F.size(hashes) - k), F.xxhash64(*seed, *parts))
