"""Files in and out, plug-in recognisers, and streams that agree with batches."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmill.sources import files, schemas
from quillmill.streaming import jobs

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_uploads_are_gated(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    found = {r["path"].rsplit("/", 1)[1]: r["status"] for r in files.uploads(spark, str(tmp_path)).collect()}
    assert found == {"a.pdf": 200, "b.pdf": 415}


def test_recognisers_plug_in(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 hello")

    @files.register("fake")
    def fake(batches):
        for pdf in batches:
            yield pd.DataFrame([{"doc_id": 1, "page": 1, "word_no": k, "text": w.decode(), "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "conf": 0.9, "block_num": 1, "par_num": 1, "line_num": 1} for c in pdf["content"] for k, w in enumerate(c.split())])

    words = files.recognize(files.uploads(spark, str(tmp_path)), "fake")
    assert [r["text"] for r in words.orderBy("word_no").collect()] == ["%PDF-1.7", "hello"]
    with pytest.raises(KeyError):
        files.recognizer("missing")


@pytest.mark.parametrize("form", ["parquet", "json"])
def test_tables_round_trip(spark, tmp_path, form):
    rows = spark.createDataFrame([(1, "b1", None, 0, 1, "paragraph", 1, "ar", "Arabic", "rtl", 0.9, ["A"], False, None, "نص", None, [], None)], schemas.BLOCKS)
    files.write_table(rows, str(tmp_path / "t"), form)
    assert files.read_table(spark, str(tmp_path / "t"), "blocks", form).collect() == rows.collect()


def test_schemas_parse(spark):
    for ddl in schemas.TABLES.values():
        assert spark.createDataFrame([], ddl).columns


def events(spark):
    return spark.read.parquet(EVENTS).select(F.col("user_id").alias("job_id"), "event_id", (F.floor("value").cast("long") % 101).alias("progress"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"))


def test_stream_of_jobs_agrees_with_batch(spark, tmp_path):
    rows = events(spark)
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = jobs.job_states(stream).writeStream.format("memory").queryName("states").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(spark.table("states").collect()) == sorted(jobs.job_states(rows).collect())


def test_arriving_files_go_through_a_batch(spark, tmp_path):
    rows = events(spark)
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    jobs.follow(spark, str(tmp_path / "in"), rows.schema, lambda batch, k: seen.append(batch.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == rows.count()


def test_windows_count_every_event(spark):
    rows = events(spark)
    assert jobs.event_windows(rows, "ts").agg(F.sum("n")).first()[0] == rows.filter("ts is not null").count()
