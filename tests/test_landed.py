"""Tables landed as files for a stream."""

from pyspark.sql import functions as F

from vendorlake.plans import queries


def test_each_micro_batch_has_files_for_all_cores(spark):
    seen = []

    def note(batch, batch_id):
        seen.append((batch.count(), batch.select(F.input_file_name().alias("f")).distinct().count(), sorted(r["id"] for r in batch.collect())))

    stream = queries._landed(spark.range(4000), "landed")
    stream.writeStream.foreachBatch(note).option("checkpointLocation", queries.new_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == queries.BATCHES and [n for _, n, _ in seen] == [spark.sparkContext.defaultParallelism] * queries.BATCHES
    assert sorted(x for _, _, ids in seen for x in ids) == list(range(4000))


def test_an_empty_table_lands(spark):
    stream = queries._landed(spark.range(0), "landed", "json")
    rows = []
    stream.writeStream.foreachBatch(lambda batch, batch_id: rows.extend(batch.collect())).option("checkpointLocation", queries.new_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert rows == []
