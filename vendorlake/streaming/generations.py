"""Tables that a stream in update mode keeps current: changes by micro-batch, folded into generations as they add up.

Under a table's folder, changes/batch=N holds the rows that micro-batch N changed, generations/upto=N every key's row as of
batch N, and manifest/upto=N says that this generation is whole. A reader takes the last manifest, its generation and the
changes after it, so that what it reads is the table and at most `every` batches, however long the stream has run.

Every step can be done again: a replayed batch overwrites its own changes, a generation without its manifest is overwritten
by the next try, and a batch that a manifest covers already is passed over by readers. What a manifest has replaced is
removed when the next one is out, so that a reader who took the one before still finds its files.

A key's row is the last one that a batch wrote, or, where a batch writes only what is new of a key, what the given
aggregates make of its rows; they must give the same in any order and for rows that are merged already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVERY = 16
#: The batch before the stream's: rows that the table begins with.
FIRST = -1


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, folder: str, label: str) -> list[int]:
    """N of each folder label=N that was written to its end."""
    place, fs = _fs(spark, folder)
    if not fs.exists(place):
        return []
    names = [s.getPath() for s in fs.listStatus(place)]
    whole = [p.getName() for p in names if p.getName().startswith(f"{label}=") and fs.exists(_fs(spark, f"{p}/_SUCCESS")[0])]
    return sorted(int(n.split("=")[1]) for n in whole)


def _remove(spark: SparkSession, path: str) -> None:
    place, fs = _fs(spark, path)
    fs.delete(place, True)


def covered(spark: SparkSession, out_dir: str) -> int:
    """The last batch that a whole generation holds; one before the first if there is none."""
    return max(_numbers(spark, f"{out_dir}/manifest", "upto"), default=FIRST - 1)


def _publish(spark: SparkSession, out_dir: str, upto: int) -> None:
    spark.range(1).select(F.lit(upto).alias("upto")).coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/manifest/upto={upto}")


def latest(spark: SparkSession, out_dir: str, key: list[str], upto: int | None = None, merge: list[Column] | None = None) -> DataFrame:
    """The last row of each key (or its rows merged), as of batch upto (if given, one not before the last manifest)."""
    done = covered(spark, out_dir)
    parts = [(done, f"{out_dir}/generations/upto={done}")] if done >= FIRST else []
    parts += [(n, f"{out_dir}/changes/batch={n}") for n in _numbers(spark, f"{out_dir}/changes", "batch") if n > done and (upto is None or n <= upto)]
    if not parts:
        raise ValueError(f"no batch has been written under {out_dir}")
    frames = [spark.read.parquet(path).withColumn("batch_", F.lit(n)) for n, path in parts]
    df = frames[0]
    for more in frames[1:]:
        df = df.unionByName(more)
    if merge is not None:
        return df.groupBy(*key).agg(*merge)
    rest = [c for c in df.columns if c not in (*key, "batch_")]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_").alias("r")).select(*key, "r.*")


def compact(spark: SparkSession, out_dir: str, key: list[str], upto: int, merge: list[Column] | None = None) -> None:
    """Folds all changes up to a batch into a generation of their own, and removes what the manifest before the last one needed."""
    last = covered(spark, out_dir)
    if upto <= last:
        return
    latest(spark, out_dir, key, upto, merge).write.mode("overwrite").parquet(f"{out_dir}/generations/upto={upto}")
    _publish(spark, out_dir, upto)
    for n in _numbers(spark, f"{out_dir}/changes", "batch"):
        if n <= last:
            _remove(spark, f"{out_dir}/changes/batch={n}")
    for n in _numbers(spark, f"{out_dir}/generations", "upto"):
        if n < last:
            _remove(spark, f"{out_dir}/manifest/upto={n}")
            _remove(spark, f"{out_dir}/generations/upto={n}")


def write_first(df: DataFrame, out_dir: str) -> DataFrame:
    """Rows that the table begins with, written before the stream's first start; a later start leaves the table as it is.

    Gives them as they were written, or df where they have gone into a generation since.
    """
    spark = df.sparkSession
    if covered(spark, out_dir) < FIRST and FIRST not in _numbers(spark, f"{out_dir}/changes", "batch"):
        df.write.mode("overwrite").parquet(f"{out_dir}/changes/batch={FIRST}")
    there = FIRST in _numbers(spark, f"{out_dir}/changes", "batch")
    return spark.read.schema(df.schema).parquet(f"{out_dir}/changes/batch={FIRST}") if there else df


def write_changes(batch: DataFrame, batch_id: int, out_dir: str, key: list[str], every: int = EVERY, merge: list[Column] | None = None) -> None:
    """For foreachBatch: the rows that a micro-batch changed; after each `every` of them a generation."""
    # Written even if a generation covers it already: a stream's state is kept only by batches that are computed.
    batch.write.mode("overwrite").parquet(f"{out_dir}/changes/batch={batch_id}")
    if (batch_id + 1) % every == 0:
        compact(batch.sparkSession, out_dir, key, batch_id, merge)
