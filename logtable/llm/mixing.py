"""Mixing sources to target weights by entropy balancing.

Sources, ordered by code point with the null source last, weigh 1, 2, 3, 1, ... and share all words;
a target stops at ``MAX_COPIES`` times the source's words and the excess is shared again by weight.
Inside a source the document rates are those closest to 1 (in relative entropy) that meet the target:
``rate = min(MAX_COPIES, exp(lambda * size / mean size))`` with one dual variable per source. The duals of
all sources are found together by safeguarded Newton iterations, each one aggregation of the (source, size)
histogram. Rates become copies from the longest document down, the rounding error being carried on, in
buckets of about ``BUCKET_ROWS`` documents, so that no source is rounded in one task.

Defined cases: a null or empty text has size 0 and takes nothing; a source of no words has target 0; no
documents give no rows; repeated rows are rows of their own. Extra columns are ignored. The bucket of a
document follows from its id and size, so reruns agree on any partitioning.
"""

from __future__ import annotations

import bisect
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtable.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
MAX_COPIES = 3
WEIGHTS = 3
BUCKET_ROWS = 8192
MAX_STEPS = 100
#: Newton ends when every source's rates meet its target to this part of it.
TOLERANCE = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _stored(frame: DataFrame, label: str) -> DataFrame:
    spark = frame.sparkSession
    path = shared_dir(spark, label)
    frame.write.parquet(path)
    return spark.read.parquet(path)


def _numbered(sources: DataFrame) -> DataFrame:
    """``source_no``: the place of a source (from 0) by code point, nulls last, with no global window."""
    order = F.col("source").asc_nulls_last()
    parts = sources.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = _stored(sources.repartitionByRange(int(parts), order).withColumn("part", F.spark_partition_id()), "mix-order")
    # one row per shuffle partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return placed.join(before, "part").withColumn("source_no", F.col("before") + inside - 1).drop("part", "before")


def targets(sources: DataFrame) -> DataFrame:
    """``source, source_size`` -> also ``source_no, weight, target``."""
    rows = _stored(
        _numbered(sources).withColumn("weight", (F.col("source_no") % WEIGHTS + 1).cast("bigint")), "mix-sources"
    )
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    cap = (F.col("source_size") * MAX_COPIES).cast("decimal(38,0)")
    share, over, capped = total, max(1, rows.agg(F.sum("weight")).first()[0] or 1), 0
    while True:
        # above: weight * share / over > cap, in whole numbers
        above = F.col("weight").cast("decimal(20,0)") * F.lit(share).cast("decimal(18,0)") > cap * F.lit(over).cast("decimal(18,0)")
        n, held, weight = rows.agg(
            F.count_if(above),
            F.sum(F.when(above, F.col("source_size") * MAX_COPIES).otherwise(0)),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))),
        ).first()
        if n == capped:
            break
        capped, share, over = n, total - held, max(1, weight)
    fair = (F.col("weight") * share).cast("double") / F.lit(float(over))
    return rows.withColumn("target", F.when(above, cap.cast("double")).otherwise(fair))


def _newton(histogram: DataFrame, sources: DataFrame) -> DataFrame:
    """``source_no, target, source_size, mean, tilt``: the tilt of every source at the dual's optimum."""
    state = _stored(
        sources.select(
            "source_no",
            "target",
            "source_size",
            "n_docs",
            (F.col("source_size") / F.greatest(F.col("n_docs"), F.lit(1))).alias("mean"),
            F.lit(0.0).alias("tilt"),
            F.lit(-math.inf).alias("low"),
            F.lit(math.inf).alias("high"),
            F.lit(0.0).alias("miss"),
        ),
        "mix-state",
    )
    tilted = F.col("tilt") * F.col("size") / F.col("mean")
    rate = F.exp(F.least(tilted, F.lit(math.log(MAX_COPIES))))
    slope = F.when(tilted < math.log(MAX_COPIES), F.col("size") * F.col("size") / F.col("mean") * rate).otherwise(0.0)
    # a source at its cap, or without words, needs no tilt
    open_ = (F.col("target") > 0) & (F.col("target") < MAX_COPIES * F.col("source_size"))
    for _ in range(MAX_STEPS):
        sums = (
            histogram.join(state.filter(open_).select("source_no", "mean", "tilt"), "source_no")
            .groupBy("source_no")
            .agg(
                F.sum(F.col("n") * F.col("size") * rate).alias("got"),
                F.sum(F.col("n") * slope).alias("slope"),
            )
        )
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        step = F.col("tilt") - F.try_divide(gap, F.col("slope"))
        outward = F.when(gap < 0, F.greatest(F.col("tilt") * 2, F.lit(1.0))).otherwise(F.least(F.col("tilt") * 2, F.lit(-1.0)))
        halved = F.when(F.abs(F.col("low2")) + F.abs(F.col("high2")) < math.inf, (F.col("low2") + F.col("high2")) / 2)
        inside = (step > F.col("low2")) & (step < F.col("high2")) & (F.abs(step - F.col("tilt")) <= 4 + 2 * F.abs(F.col("tilt")))
        state = _stored(
            state.join(sums, "source_no", "left")
            .withColumn("low2", low)
            .withColumn("high2", high)
            .withColumn("new", F.when(gap.isNull() | (gap == 0), F.col("tilt")).when(inside, step).otherwise(F.coalesce(halved, outward)))
            .select(
                "source_no", "target", "source_size", "n_docs", "mean",
                F.col("new").alias("tilt"), F.col("low2").alias("low"), F.col("high2").alias("high"),
                F.coalesce(F.abs(gap) / F.col("target"), F.lit(0.0)).alias("miss"),
            ),
            "mix-state",
        )
        if (state.agg(F.max("miss")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state


def rounded(sizes: list[int], rates: list[float]) -> list[int]:
    """Copies of documents given longest first: what rounding one gave or took is made up by the next."""
    copies, owed = [], 0.0
    for size, rate in zip(sizes, rates):
        owed += rate * size
        n = min(MAX_COPIES, max(0, round(owed / size))) if size else 0
        owed -= n * size
        copies.append(n)
    _settled(sizes, copies, owed)
    return copies


def _settled(sizes: list[int], copies: list[int], owed: float) -> None:
    """Where the last documents are too long to even out what is owed, one copy more of a document and one
    fewer of another, or one of both alone, come closer."""
    more = sorted({0: -1, **{n: i for i, n in enumerate(sizes) if copies[i] < MAX_COPIES}}.items())
    fewer = {0: -1, **{n: i for i, n in enumerate(sizes) if copies[i] > 0}}
    best, change = abs(owed), None
    for n, j in fewer.items():
        at = bisect.bisect_left(more, (owed + n, -2))
        for m, i in more[max(0, at - 1) : at + 1]:
            if abs(owed - m + n) < best and i != j:
                best, change = abs(owed - m + n), (i, j)
    if change:
        for place, step in zip(change, (1, -1)):
            if place >= 0:
                copies[place] += step


def mix(rows: DataFrame) -> DataFrame:
    """``row_key, source, size`` rows -> also ``source_size, target, copies`` (and the key's columns).

    ``row_key`` names the row: any type that hashes and sorts. Everything else is dropped.
    """
    rows = rows.select("row_key", "source", F.col("size").cast("bigint").alias("size"))
    counted = _stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    sources = counted.groupBy("source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs")
    )
    known = _stored(targets(sources), "mix-targets")
    numbers = known.select(F.col("source").alias("known"), "source_no")
    histogram = _stored(
        counted.join(numbers, F.col("source").eqNullSafe(F.col("known"))).select("source_no", "size", "n"), "mix-numbered"
    )
    solved = _newton(histogram, known)
    per_source = known.select(F.col("source").alias("known"), "source_no").join(
        solved.select("source_no", "source_size", "target", "n_docs", "mean", "tilt"), "source_no"
    )
    whole = F.col("target") >= MAX_COPIES * F.col("source_size")
    rate = (
        F.when(F.col("target") <= 0, 0.0)
        .when(whole, float(MAX_COPIES))
        .otherwise(F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(math.log(MAX_COPIES)))))
    )
    buckets = F.ceil(F.col("n_docs") / BUCKET_ROWS)
    dealt = rows.join(per_source, F.col("source").eqNullSafe(F.col("known"))).select(
        "row_key",
        "size",
        "source_no",
        "source_size",
        "target",
        rate.alias("rate"),
        F.pmod(F.xxhash64("row_key", "size"), buckets).alias("bucket"),
    )

    def copies(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "row_key"], ascending=[False, True], kind="stable", na_position="last")
        frame["copies"] = rounded(frame["size"].tolist(), frame["rate"].tolist())
        return frame[["row_key", "size", "source_size", "target", "copies"]]

    kind = dealt.schema["row_key"].dataType.simpleString()
    shape = f"row_key {kind}, size bigint, source_size bigint, target double, copies bigint"
    return dealt.groupBy("source_no", "bucket").applyInPandas(copies, shape)
