import json
import random

import pytest
from pyspark.sql import functions as F

from cindertrail.sources import demo, logfiles, simulation
from cindertrail.streaming import detector

TXT = "2026-09-13T00:00:0{}Z | INFO | api | 10.0.0.1 | GET | /x | 200 | {} | r | - | ok"


def test_text_files_load_in_order(spark, tmp_path):
    lines = [TXT.format(i % 10, i) for i in range(50)]
    lines.insert(3, "broken line")
    lines.insert(0, "   ")
    (tmp_path / "a.txt").write_text("\n".join(lines))
    got = logfiles.load(spark, str(tmp_path / "a.txt"), " ")
    assert got.name == "imported-logs" and tuple(got.counts.first()) == (51, 50, 1)
    assert [(r.id, r.response_ms) for r in got.events.orderBy("id").collect()] == [(i, i) for i in range(50)]
    (bad,) = got.failures.collect()
    assert (bad.line_no, bad.raw_message, bad.reason) == (4, "broken line", "columns")
    logfiles.install(got)
    assert logfiles.current(spark).count() == 50 and logfiles.clear(spark)
    with pytest.raises(LookupError):
        logfiles.current(spark)


def test_json_lines_are_detected(spark, tmp_path):
    (tmp_path / "b.log").write_text("\n" + json.dumps({"timestamp": "2026-09-13T00:00:00Z", "message": "m", "z": 1, "a": "x"}) + "\n{}\n")
    got = logfiles.load(spark, str(tmp_path / "b.log"))
    assert json.loads(logfiles.wire_projection(got.events).first().attributes) == {"a": "x", "z": "1"}
    assert [r.reason for r in got.failures.collect()] == ["timestamp"]


def test_samples_and_guards(spark, tmp_path):
    (tmp_path / "s.txt").write_text(TXT.format(1, 1))
    (tmp_path / "README.md").write_text("x")
    (tmp_path / "bad.txt").write_text("nothing")
    (tmp_path / "empty.txt").write_text("\n \n")
    assert logfiles.available_samples(str(tmp_path)) == ["bad.txt", "empty.txt", "s.txt"]
    assert logfiles.load_sample(spark, str(tmp_path), "s.txt").events.count() == 1
    for name, error in (("../x", ValueError), ("none.txt", LookupError), ("empty.txt", ValueError)):
        with pytest.raises(error):
            logfiles.load_sample(spark, str(tmp_path), name)
    with pytest.raises(ValueError):
        logfiles.load(spark, str(tmp_path / "bad.txt"), require_events=True)


def test_demo_events(spark):
    df = demo.demo_events(spark, 4000)
    assert df.count() == 4000 and df.exceptAll(demo.demo_events(spark, 4000)).isEmpty()
    share = df.where("level = 'ERROR'").count() / 4000
    assert 0.38 < share < 0.46 and df.select("service").distinct().count() == 8
    assert df.agg(F.max("ts").cast("long") - F.min("ts").cast("long")).first()[0] <= 86_400


def test_simulation_follows_the_curve(spark):
    fleet = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "service string, base_share double")
    e = simulation.simulate(spark, "traffic-surge", fleet).cache()
    per = {r.tick: r for r in e.groupBy("tick").agg(F.count("*").alias("n"), F.first("phase").alias("phase"), F.avg((F.col("status") == 500).cast("int")).alias("bad")).collect()}
    assert per[0].phase == "healthy" and per[50].phase == "peak" and per[250].phase == "healthy" and per[50].n > 2 * per[0].n and per[0].n == 12
    assert e.exceptAll(simulation.simulate(spark, "traffic-surge", fleet)).isEmpty() and {r.service for r in e.select("service").distinct().collect()} == {"a", "b"}
    assert len(simulation.SCENARIOS) == 7


def test_tick_source(spark, tmp_path):
    spark.dataSource.register(simulation.TickSource)
    q = spark.readStream.format("ticks").option("ticks", 12).option("perBatch", 5).load().writeStream.format("memory").queryName("ticks_out").option("checkpointLocation", str(tmp_path)).start()
    try:
        q.processAllAvailable()
        assert sorted(r.tick for r in spark.table("ticks_out").collect()) == list(range(12))
    finally:
        q.stop()


def test_detector_marks_bursts():
    d = detector.Detector()
    quiet = [d.close(i, 10, 1, [10] + [0] * 59) for i in range(6)]
    burst = d.close(6, 10, 9, [10] + [0] * 59)
    assert not any(r[4] for r in quiet[1:]) and burst[4] and burst[3] == 1.0 and burst[5] == 200


def test_stream_readings_equal_batch(spark, logs, tmp_path):
    rng = random.Random(3)
    rows = sorted(({"ts": rng.randrange(0, 400) / 10, "service": rng.choice("ab"), "level": rng.choice(["INFO", "ERROR"]), "response_ms": rng.choice([0, 50, 900, None])} for _ in range(300)), key=lambda r: r["ts"])
    for i in range(3):
        logs(rows[i * 100 : i * 100 + 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    logs([{"ts": 1000, "service": "z"}]).coalesce(1).write.parquet(str(tmp_path / "in/9"))
    stream = spark.readStream.schema(logs([]).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    detector.to_memory(detector.stream_readings(stream, lateness="10 minutes"), "readings_out", str(tmp_path / "cp"))
    got = {tuple(r) for r in spark.table("readings_out").collect()}
    assert got == {tuple(r) for r in detector.batch_readings(logs(rows)).collect()}


def test_sample_files_parse(spark, tmp_path):
    from cindertrail.sources import samples

    samples.write_sample(samples.sample_lines(spark, 400, malformed=True), f"file://{tmp_path}/bad.txt")
    got = logfiles.ingest(spark, f"file://{tmp_path}/bad.txt")
    counts = got.counts.first()
    assert counts.total == 400 and 0.08 < counts.failure / 400 < 0.25
    assert {r.reason for r in got.failures.collect()} == {"timestamp", "columns", "level"}
    samples.write_sample(samples.sample_lines(spark, 300, hops=3), f"file://{tmp_path}/good.txt")
    good = logfiles.load(spark, f"file://{tmp_path}/good.txt")
    assert good.counts.first().failure == 0 and good.events.groupBy("request_id").count().where("count = 3").count() == 100


def test_ingest_refuses_empty_large_and_useless_files(spark, tmp_path):
    for name, text in (("empty", ""), ("useless", "x\ny\n"), ("large", "x" * 2000)):
        (tmp_path / name).write_text(text)
    for name, most in (("empty", 0), ("useless", 0), ("large", 1000)):
        with pytest.raises(ValueError):
            logfiles.ingest(spark, f"file://{tmp_path}/{name}", max_bytes=most)


def test_scratch_removes_its_tables(spark):
    import os

    from cindertrail import session

    with session.scratch():
        table = session.materialise(spark.range(5))
        path = table.inputFiles()[0].removeprefix("file://").removeprefix("file:")
        assert table.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)


def test_answers_name_what_was_asked():
    from cindertrail.registry import answer

    got = answer("pattern_search", "naive", "abab", "ab", notes=("demo",))
    assert (got.query_type, got.algorithm, got.input_size, got.result, got.notes) == ("PATTERN_SEARCH", "NAIVE", 4, [0, 2], ("demo",)) and got.seconds >= 0
