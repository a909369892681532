"""Previous-value lookup along an ordered key, safe when one key holds much of the data.

A plain ``last(...) over (partition by key order by position)`` puts a whole key into one task.
Here the position axis is cut into buckets: each row looks back inside its own (key, bucket), and
one small row per (key, bucket) carries the value in from earlier buckets. Only that small table
is ever ordered over a whole key, and it has at most one row per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtable.session import shared_dir

_BUCKET = "carry_bucket"
_CARRIED = "carry_in"
_UPDATE = "carry_update"


def in_equal_buckets(rows: DataFrame, order: Sequence[str], rows_per_bucket: int, name: str) -> DataFrame:
    """``rows`` with a bucket that grows with ``order`` and holds about as many rows each time, whatever the
    distances between them. Rows of one place share a bucket.

    The edges are those of Spark's range partitioning, from a sample of the rows. The result is a written table, so
    that all that is made of it sees the same buckets.
    """
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession, "in-order")
    rows.write.parquet(path)
    kept = spark.read.schema(rows.schema).parquet(path)
    buckets = max(1, -(-kept.count() // rows_per_bucket))
    bucketed = kept.repartitionByRange(buckets, *order).withColumn(name, F.spark_partition_id())
    path = shared_dir(spark, "in-buckets")
    bucketed.write.parquet(path)
    return spark.read.parquet(path)


def with_previous_value(
    rows: DataFrame, key: str, bucket: Column, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Adds ``name``: the last non-null ``value`` of the same ``key`` strictly before each row.

    ``bucket`` must grow with ``order``. Rows with a null ``key`` get null.
    """
    prepared = rows.withColumn(_BUCKET, bucket).withColumn(_UPDATE, value)
    position = F.struct(*order)
    per_bucket = (
        prepared.filter(F.col(key).isNotNull())
        .groupBy(key, _BUCKET)
        .agg(F.max_by(_UPDATE, F.when(F.col(_UPDATE).isNotNull(), position)).alias(_UPDATE))
    )
    earlier = Window.partitionBy(key).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(
        key, _BUCKET, F.last(_UPDATE, ignorenulls=True).over(earlier).alias(_CARRIED)
    ).filter(F.col(_CARRIED).isNotNull())
    within = (
        Window.partitionBy(key, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    looked_back = prepared.withColumn(name, F.last(_UPDATE, ignorenulls=True).over(within))
    return (
        looked_back.join(carried, [key, _BUCKET], "left")
        .withColumn(name, F.when(F.col(key).isNotNull(), F.coalesce(name, _CARRIED)))
        .drop(_BUCKET, _CARRIED, _UPDATE)
    )
