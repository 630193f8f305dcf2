import ctypes
import weakref
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from runledger.llm import shared


class Cache(dict):
    pass


def test_workers_give_memory_back_once_caches_are_gone(monkeypatch):
    seen, at_trim = [], []

    @shared.lean
    def doubled(batches):
        known = Cache()
        seen.append(weakref.ref(known))
        for b in batches:
            yield b * 2

    class Libc:
        malloc_trim = staticmethod(lambda pad: at_trim.append(seen[0]()))

    monkeypatch.setattr(ctypes, "CDLL", lambda name: Libc)
    assert list(doubled(iter([1, 2]))) == [2, 4] and at_trim == [None]


def test_a_lean_function_is_a_column_function(spark):
    @F.pandas_udf("long")
    @shared.lean
    def doubled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b * 2

    assert [r.d for r in spark.range(3).select(doubled("id").alias("d")).collect()] == [0, 2, 4]
