"""Order-based work split evenly over tasks, however the keys are distributed.

``Window.partitionBy(key)`` and ``collect_list`` put a whole key into one task, so one source that
holds a third of all rows decides the run time of the job. Range partitioning on key *and* order
cuts such a key into consecutive pieces of ordinary size instead. What a piece needs to know about
the pieces before it is a summary whose size does not depend on the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from logvigil.session import reliable_checkpoint


def sorted_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  partitions: int | None = None) -> DataFrame:
    """Rows globally sorted by keys and order, with their partition number in ``chunk``.

    ``order`` must be unique within a key for the pieces to be of even size. Range bounds come from
    a sample, so the result is materialised once; later passes then see the same pieces.
    """
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [*keys, *order]
    placed = df.repartitionByRange(count, *columns).sortWithinPartitions(*columns)
    return reliable_checkpoint(placed.withColumn("chunk", F.spark_partition_id()))


def running_number(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``row_number`` over keys and order that never sorts a whole key in one task."""
    pieces = sorted_pieces(df, keys, order)
    within = Window.partitionBy("chunk", *keys).orderBy(*order)
    numbered = pieces.withColumn("_local", F.row_number().over(within).cast("bigint"))
    # One row per key and piece: a key has at most as many pieces as there are partitions.
    sizes = pieces.groupBy("chunk", *keys).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "chunk", *keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return (
        numbered.join(offsets, ["chunk", *keys])
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("chunk", "_local", "_offset")
    )


def dense_number(df: DataFrame, order: Sequence[str], name: str, first: int = 1, partitions: int | None = None) -> DataFrame:
    """Numbers from ``first`` over the whole table in a unique order, with one shuffle.

    A row's number is its place in its sorted piece and the rows of the pieces before. The rows of each
    piece, one figure a partition, are counted, summed and broadcast.
    """
    pieces = sorted_pieces(df, [], order, partitions)
    spark, start, offsets = df.sparkSession, first, []
    for chunk, rows in sorted(map(tuple, pieces.groupBy("chunk").agg(F.count(F.lit(1))).collect())):
        offsets.append((chunk, start))
        start += rows
    known = F.broadcast(spark.createDataFrame(offsets, "chunk int, _offset long"))  # a row for each partition
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within the partition
    return pieces.withColumn("_place", place).join(known, "chunk").withColumn(name, F.col("_place") + F.col("_offset")).drop("chunk", "_place", "_offset")


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row aggregates of different tables side by side without a join."""
    combined = frames[0]
    for frame in frames[1:]:
        combined = combined.unionByName(frame, allowMissingColumns=True)
    return combined.agg(*[F.max(c).alias(c) for c in combined.columns])


def count_if(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")
