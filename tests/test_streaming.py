from garimpo.sources.sinks import read_index
from garimpo.streaming.ingest import ingest, windowed_counts


def test_ingest_adds_each_chunk_once(spark, tmp_path):
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    schema = "doc_id string, titulo string, categoria string, text string"
    rows = spark.createDataFrame([("a", "T", "agua", "um dois três"), ("b", "U", None, "quatro\n\ncinco")], schema)
    rows.write.parquet(source)
    run = lambda name: ingest(spark.readStream.schema(schema).parquet(source), index, str(tmp_path / name)).awaitTermination()
    run("c1")
    first = read_index(spark, index).count()
    run("c2")  # the same documents again, without the memory of the first run
    assert read_index(spark, index).count() == first == 2
    spark.createDataFrame([("c", "V", "x", "seis")], schema).write.mode("append").parquet(source)
    run("c1")
    assert read_index(spark, index).count() == 3


def test_windows_in_batch(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    assert windowed_counts(events, "ts", "event_type", "1 day").agg({"n": "sum"}).first()[0] == events.where("ts is not null").count()
