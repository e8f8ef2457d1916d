"""Document keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first(c: Column, old: str, new: str) -> Column:
    at = F.instr(c, old)
    return F.when(at > 0, F.overlay(c, F.lit(new), at, F.lit(1))).otherwise(c)


def encode_doi(c: Column) -> Column:
    """The first `/` becomes `_`; null stays null."""
    return _first(c, "/", "_")


def decode_doi(c: Column) -> Column:
    """The first `_` becomes `/`, which undoes encode_doi unless an `_` stood before the first `/`, or none did."""
    return _first(c, "_", "/")
