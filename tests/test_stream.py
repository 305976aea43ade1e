from __future__ import annotations

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from credtrail import default_rules
from credtrail.functions.keywords import keyword_name
from credtrail.operators import scan
from credtrail.operators.dedup import first_findings
from credtrail.queries import CHANGE_SCHEMA, STREAM_SCHEMA
from credtrail.streaming import findings as streams

R = default_rules()
SCHEMA = "seq BIGINT, commit STRING, author STRING, date TIMESTAMP, file STRING, sign STRING, line STRING"


def put(spark, path, rows):
    data = [(i, f"c{i}", "ann", datetime.datetime(2024, 1, d), "x.env", "+", x)
            for i, (d, x) in enumerate(rows)]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def folders(tmp_path):
    return {n: str(tmp_path / n) for n in ("in", "out", "state")}


def run(spark, folders, watermark=None):
    lines = spark.readStream.schema(SCHEMA).parquet(folders["in"])
    found = streams.first_in_stream(streams.history_stream(lines, R), watermark)
    streams.write_findings_stream(found, folders["out"], folders["state"]).awaitTermination()
    rows = spark.read.schema(STREAM_SCHEMA).json(folders["out"]).collect()
    return sorted((r.key, r.value, r.type) for r in rows)


def test_values_are_seen_once_over_restarts(spark, folders):
    put(spark, folders["in"], [(1, "password=abc"), (1, "password=abc"), (2, "token=xyz")])
    first = run(spark, folders)
    assert first == [("password", "abc", "password"), ("token", "xyz", "token")]
    put(spark, folders["in"], [(3, "password=abc"), (3, "pwd=new1")])
    assert run(spark, folders) == sorted([*first, ("pwd", "new1", "pwd")])


def test_with_a_watermark_old_values_come_again(spark, folders):
    put(spark, folders["in"], [(1, "password=abc")])
    run(spark, folders, "1 day")
    put(spark, folders["in"], [(20, "pwd=later1")])
    run(spark, folders, "1 day")
    put(spark, folders["in"], [(25, "password=abc")])
    rows = run(spark, folders, "1 day")
    assert [r for r in rows if r[1] == "abc"] == [("password", "abc", "password")] * 2


def test_bad_lines_in_a_findings_stream(spark, folders, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"file":"f","key":"k","value":"v","author":"a"}\n{bad\n')
    counts = streams.running_counts(streams.read_findings_stream(spark, folders["in"]), "author")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("counted")
    query.trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("counted").collect()] == [("a", 1)]


def test_stream_and_batch_agree(spark, folders):
    put(spark, folders["in"], [(i % 27 + 1, f"password=val{i % 40}") for i in range(300)])
    got = {v for _, v, _ in run(spark, folders)}
    batch = scan.scan_history(spark.read.parquet(folders["in"]), R)
    assert got == {r.value for r in batch.select("value").distinct().collect()}


def test_current_and_history_in_one_stream(spark, folders, tmp_path):
    put(spark, folders["in"], [(1, "password=abc")])
    files = str(tmp_path / "files")
    spark.createDataFrame(
        [("x.env", "password=abc"), ("y.env", "token=live1")], "file STRING, line STRING"
    ).write.parquet(files)
    history = streams.history_stream(spark.readStream.schema(SCHEMA).parquet(folders["in"]), R)
    when = F.lit(datetime.datetime(2030, 1, 1))
    current = streams.current_stream(
        spark.readStream.schema("file STRING, line STRING").parquet(files), when, R)
    both = streams.first_in_stream(streams.both_stream(history, current))
    streams.write_findings_stream(both, folders["out"], folders["state"]).awaitTermination()
    rows = spark.read.schema(STREAM_SCHEMA).json(folders["out"]).collect()
    assert sorted((r.file, r.value) for r in rows) == [("x.env", "abc"), ("y.env", "live1")]


def test_days_do_not_depend_on_the_number_of_triggers(spark):
    from credtrail import queries

    sf_dir = "/root/testdata/sf0.001"
    lines = queries.commit_lines(spark, sf_dir).repartition(6)
    path = queries.new_path(spark, "lines")
    lines.withColumn("date", F.col("date").cast("timestamp")).write.parquet(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    stream = reader.option("maxFilesPerTrigger", 1).parquet(path)
    got = {tuple(r) for r in queries.days_of(spark, streams.history_stream(stream)).collect()}
    assert got == {tuple(r) for r in queries.stream_days(spark, sf_dir).collect()}


def changes(spark, folders, files_per_trigger=None):
    reader = spark.readStream.schema(SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    found = streams.least_in_stream(streams.history_stream(reader.parquet(folders["in"]), R))
    streams.write_findings_stream(found, folders["out"], folders["state"]).awaitTermination()
    return spark.read.schema(CHANGE_SCHEMA).json(folders["out"])


@pytest.mark.parametrize("files_per_trigger", [None, 1, 3])
def test_first_rows_do_not_depend_on_triggers(spark, folders, files_per_trigger):
    """Files in any order: what holds at the end is the first finding of each value, in all columns."""
    rng = random.Random(4)
    rows = [(i, f"c{i}", f"dev{i % 7}", datetime.datetime(2024, 1, i % 28 + 1), f"f{i % 2}.env", "+",
             rng.choice(["password=val", "token=val", "my_token_auth=val"]) + str(rng.randrange(12))) for i in range(200)]
    rng.shuffle(rows)
    for i in range(0, 200, 40):
        spark.createDataFrame(rows[i : i + 40], SCHEMA).coalesce(1).write.mode("append").parquet(folders["in"])
    log = changes(spark, folders, files_per_trigger)
    names = ["file", "key", "value", "type", "commit", "author", "date"]
    got = sorted(map(tuple, streams.latest_versions(log).select(*names).collect()))
    batch = first_findings(scan.scan_history(spark.read.parquet(folders["in"]), R))
    batch = batch.withColumn("type", keyword_name(F.col("kw_first"), R))
    assert got == sorted(map(tuple, batch.select(*names).collect())) and len(got) > 30
    versions = log.groupBy("file", "key", "value").agg(F.count("*").alias("n"), F.max("version").alias("last"))
    assert versions.where("n <> last").count() == 0


def test_an_earlier_row_is_one_more_version(spark, folders):
    def add(seq):
        row = (seq, f"c{seq}", "ann", datetime.datetime(2024, 1, 1), "x.env", "+", "password=abc")
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(folders["in"])
        return sorted((r.version, r.commit) for r in changes(spark, folders).collect())

    assert add(5) == [(1, "c5")]
    assert add(9) == [(1, "c5")]
    assert add(2) == [(1, "c5"), (2, "c2")]


def test_current_files_come_first_in_one_stream(spark, folders, tmp_path):
    put(spark, folders["in"], [(1, "password=abc"), (2, "token=only1")])
    files = str(tmp_path / "files")
    spark.createDataFrame([("x.env", "password=abc")], "file STRING, line STRING").write.parquet(files)
    history = streams.history_stream(spark.readStream.schema(SCHEMA).parquet(folders["in"]), R)
    current = streams.current_stream(
        spark.readStream.schema("file STRING, line STRING").parquet(files), F.lit(datetime.datetime(2030, 1, 1)), R)
    found = streams.least_in_stream(streams.both_stream(history, current))
    streams.write_findings_stream(found, folders["out"], folders["state"]).awaitTermination()
    rows = streams.latest_versions(spark.read.schema(CHANGE_SCHEMA).json(folders["out"])).collect()
    assert sorted((r.value, r.commit) for r in rows) == [("abc", "current"), ("only1", "c1")]


def test_counts_of_batches_run_again(spark, tmp_path):
    """A replayed batch changes nothing, before and after foldings."""
    out = str(tmp_path / "counts")
    batches = [spark.createDataFrame([(f"a{i % 3}", "f" if i % 2 else None)] * (i + 1), "author STRING, file STRING") for i in range(7)]
    save, want = streams.counts_upsert(out, ["author", "file"], every=3), Counter()
    for epoch, batch in enumerate(batches):
        save(batch, epoch)
        save(batch, epoch)
        for r in batch.collect():
            want.update([("author", r.author), ("file", r.file), ("total", "")])
        got = {(r.section, r.name): r["count"] for r in streams.read_counts(spark, out).collect()}
        assert got == dict(want)
    assert sorted(p.name for p in (tmp_path / "counts" / "folded=1").iterdir()) == ["epoch=2", "epoch=5"]


def test_counts_over_restarts(spark, folders, tmp_path):
    """One query stopped and started again adds up what came in between."""
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        (source / f"{i}.json").write_text('{"file":"f","key":"k","value":"v","author":"a%d"}\n{bad\n' % (i % 2))
        stream = streams.read_findings_stream(spark, folders["in"])
        writer = stream.writeStream.foreachBatch(streams.counts_upsert(folders["out"], ["author"], every=2))
        writer.option("checkpointLocation", folders["state"]).trigger(availableNow=True).start().awaitTermination()
    rows = streams.read_counts(spark, folders["out"]).where("section = 'author'").collect()
    assert sorted((r.name, r["count"]) for r in rows) == [("a0", 2), ("a1", 1)]
