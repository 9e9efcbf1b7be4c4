"""Values joined to bands that are rows of a table (F15): half-open intervals [lo, hi), a null edge being open.

Values are cut into BUCKETS buckets of about equal numbers by their own quantiles. A band stands in each bucket that it
reaches into, so that a value meets, by an equi-join on its bucket, only the bands near it; the edges decide. Bands may leave
gaps, overlap, and differ by owner (a brief's own bands, say): the columns of `by` are part of the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .dealt import SHARE, dealt

BUCKETS = 64
#: Values of a task of the join, about, up to so many tasks: Spark alone would choose their number by the bytes that go in, which are few.
VALUES, TASKS = 4096, 2048


def edges_of(values: DataFrame, value: str, buckets: int = BUCKETS) -> list[float]:
    """Rising numbers that cut the values into buckets of about equal numbers; fewer where many values are alike."""
    at = [i / buckets for i in range(1, buckets)]
    v = F.col(value).cast("double")
    found = values.where(v.isNotNull() & ~F.isnan(v)).agg(F.percentile_approx(v, at, 10_000)).first()[0]
    return sorted(set(found or []))


def bucket(value: Column, edges: list[float]) -> Column:
    """How many edges are not above the value."""
    return reduce(lambda n, e: n + (value >= F.lit(e)).cast("int"), edges, F.lit(0))


def band_join(
    values: DataFrame, bands: DataFrame, value: str, lo: str, hi: str, by: list[str] | None = None, how: str = "inner", buckets: int = BUCKETS, share: int = SHARE
) -> DataFrame:
    """Each row of values with each band (a row of bands) of the same `by` that its value lies in; how="left" keeps values in no band, with nulls.

    by names columns that both have. A null or NaN value lies in no band, nor does any in a band whose lo is not below its hi.
    """
    by = by or []
    edges = edges_of(values, value, buckets)
    v = F.col(value).cast("double")
    many = written(values.withColumn("bucket_", F.when(v.isNotNull() & ~F.isnan(v), bucket(v, edges))), "values")
    low, high = F.col(lo).cast("double"), F.col(hi).cast("double")
    reach = F.sequence(F.when(low.isNull(), 0).otherwise(bucket(low, edges)), F.when(high.isNull(), len(edges)).otherwise(bucket(high, edges)))
    few = bands.where(low.isNull() | high.isNull() | (low < high)).withColumn("bucket_", F.explode(reach))
    key = [*by, "bucket_"]
    tasks = min(TASKS, 1 + many.count() // VALUES)
    many, few = (t.repartition(tasks, *key, "salt_") for t in dealt(many, few, key, F.struct(*values.columns), share))
    m, b = many.alias("m"), few.alias("b")
    inside = (F.col(f"b.{lo}").isNull() | (F.col(f"m.{value}") >= F.col(f"b.{lo}"))) & (F.col(f"b.{hi}").isNull() | (F.col(f"m.{value}") < F.col(f"b.{hi}")))
    on = reduce(lambda a, c: a & (F.col(f"m.{c}") == F.col(f"b.{c}")), [*key, "salt_"], inside)
    return m.join(b, on, how).select(*(f"m.{c}" for c in values.columns), *(f"b.{c}" for c in bands.columns if c not in by))
