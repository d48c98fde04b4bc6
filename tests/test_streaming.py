from tallyloom.sources import generator
from tallyloom.streaming.candidates import candidates


def test_stream_gives_the_batch_candidates(spark, tmp_path):
    data = generator.generate(spark, generator.Config(200, 7, "stress"))
    for name, df in (("events", data.batch.ledger), ("lines", data.batch.detail)):
        df.write.parquet(str(tmp_path / name))
    batch = {(r.detail_id, r.event_id) for r in candidates(*(spark.read.parquet(str(tmp_path / n)) for n in ("events", "lines"))).collect()}
    streams = [spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n)) for n in ("events", "lines")]
    q = candidates(*streams).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "at")).start()
    q.processAllAvailable()
    q.stop()
    assert batch and {(r.detail_id, r.event_id) for r in spark.sql("select * from found").collect()} == batch


def test_report_renders(spark, tmp_path, capsys):
    from tallyloom.plans import report

    generator.write(generator.generate(spark, generator.Config(200, 7, "primary")), str(tmp_path / "b"))
    assert report.main([str(tmp_path / "b"), "--score", "--html", str(tmp_path / "r.html"), "--queue", str(tmp_path / "q")]) == 0
    assert "By scenario" in capsys.readouterr().out and "<table>" in (tmp_path / "r.html").read_text()
