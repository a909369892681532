"""Bounded samples for fitting: chosen by hash at a rate that follows from the row count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 1 << 30


def sampled(frame: DataFrame, about: int, *keys: str) -> DataFrame:
    """One row of each of about ``about`` distinct keys; of each of all keys, if rows are no more than ``about``.

    The choice hangs on the hash of the key columns, so reruns agree, and repeated rows cannot fill the sample.
    Every key is taken with one chance, ``about`` over the rows, so the number of keys taken strays from its
    mean, at most ``about``, by a few square roots of it. What is chosen is shuffled by key, the rest stays.
    """
    rows = frame.count()
    if rows > about:
        frame = frame.filter(F.pmod(F.xxhash64(*keys), F.lit(STEPS)) < int(STEPS * about / rows))
    return frame.dropDuplicates(list(keys))
