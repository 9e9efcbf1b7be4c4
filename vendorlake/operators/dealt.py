"""Equi-joins whose frequent keys are dealt over many groups, and rows numbered in one order without one task for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: A key with more than 1 in SHARE of the rows is dealt over as many groups as it has such shares; at most SHARE keys are that frequent.
SHARE = 1024
_PLACE = (1 << 33) - 1  # monotonically_increasing_id: the partition, then 33 bits for the row within it


def dealt(many: DataFrame, few: DataFrame, key: list[str], spread: Column, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """many and few with column salt_, to be joined on key and salt_: a frequent key's rows of many are dealt by spread, and its rows of few are copied to each group.

    many is read twice more, for its counts, so that it should be a table. Rows of either side with a null in the key keep salt 0.
    """
    total = many.count()
    parts = F.ceil(F.col("n") * share / F.lit(max(total, 1))).cast("int")
    hot = many.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") * share > total).select(*key, parts.alias("parts_"))
    hot = F.broadcast(hot)  # at most `share` rows
    n = F.coalesce("parts_", F.lit(1))
    salted = many.join(hot, key, "left").withColumn("salt_", F.pmod(F.xxhash64(spread), n).cast("int")).drop("parts_")
    copied = few.join(hot, key, "left").withColumn("salt_", F.explode(F.sequence(F.lit(0), n - 1))).drop("parts_")
    return salted, copied


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """df with column name: each row's number from 1 in the given order; rows that are alike in it are numbered in any order.

    The rows are dealt by ranges of the order and sorted within each; a range's first number comes from the sizes of those
    before it, one row a partition, so that no task sees more than its range.
    """
    at = "at_"
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    ordered = written(ordered, "ordered")
    part = F.shiftrightunsigned(at, 33)
    begins, total = [], 0
    for p, n in sorted((r["part"], r["n"]) for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        begins.append((p, total))
        total += n
    begins = F.broadcast(df.sparkSession.createDataFrame(begins, "part_ long, begin_ long"))
    ordered = ordered.withColumn("part_", part).join(begins, "part_").withColumn(name, F.col("begin_") + F.col(at).bitwiseAND(_PLACE) + 1)
    return ordered.select(*df.columns, name)
