"""Logs followed as a stream give what the batch gives."""

from geofold.streaming import logs


def test_windows_of_a_followed_log(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        rows = [f"r{k % 2},2024-01-01 00:{10 * i + k:02d}:00,{10 * i + k},{k}.5" for k in range(10)]
        (source / f"{i}.csv").write_text("run,ts,iteration,value\n" + "\n".join(rows) + "\n")
    out = logs.windowed(logs.follow(spark, str(source), files_per_batch=1))
    q = out.writeStream.outputMode("update").format("memory").queryName("log_windows").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.run, r["from"].minute): (r.rows, r.mean, r.last_iteration) for r in spark.table("log_windows").collect()}
    batch = logs.windowed(spark.read.schema(logs.SCHEMA).option("header", True).csv(str(source))).collect()
    assert got == {(r.run, r["from"].minute): (r.rows, r.mean, r.last_iteration) for r in batch} and len(got) == 6
