"""Running totals and blocks of near equal size along an order, without a task that sees a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyledger.session import cut


def running(df: DataFrame, keys: list[str], order: list[str], value: str, into: str) -> DataFrame:
    """df with `into`: the sum of `value` over the rows of the same keys that come before in `order`.

    Rows are range-partitioned and sorted, so a hot key is spread over many
    partitions; sums run inside each partition and start from the totals of
    the key's partitions before, of which there is one row each. The order
    must tell a key's rows apart.
    """
    placed = cut(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)).withColumn("_p", F.spark_partition_id())
    total = placed.groupBy(*keys, "_p").agg(F.sum(value).alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], F.col("_p").alias("_bp"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn(into, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    # null is a key like any other
    same = [F.col(k).eqNullSafe(F.col(f"_b{i}")) for i, k in enumerate(keys)]
    met = summed.join(base, [*same, F.col("_p") == F.col("_bp")])
    return met.withColumn(into, F.col(into) + F.col("_base")).drop("_p", "_bp", "_base", *[f"_b{i}" for i in range(len(keys))])


def blocks(df: DataFrame, key: str, item: str, rows: int) -> DataFrame:
    """key, bucket, block, n: of each bucket of `item` (see `bucket`) its block, and its rows.

    Blocks are numbered from 0 along each key without a gap and hold about
    `rows` rows, however the items are spread: one far outlier is one more
    bucket. Rows that share a bucket stay together.
    """
    counted = df.groupBy(key, bucket(item, rows).alias("bucket")).agg(F.count("*").alias("n"))
    counted = counted.withColumn("_w", F.least("n", F.lit(rows)))
    placed = running(counted, [key], ["bucket"], "_w", "_before")
    return placed.select(key, "bucket", F.floor(F.col("_before") / rows).alias("block"), "n", F.pmod("_before", F.lit(rows)).alias("start"))


def bucket(item: str, rows: int):
    return F.floor(F.col(item) / F.lit(max(1, rows // 16)))


def numbered(df: DataFrame, keys: list[str], order: list[str], into: str) -> DataFrame:
    """df with `into`: the place from 1 of each row among those of the same keys, in `order`, which must tell them apart."""
    return running(df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, "_one", into).withColumn(into, F.col(into) + 1).drop("_one")
