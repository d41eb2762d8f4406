"""Streams with keyed state: several uploads, a restart, late rows and the state's size."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from keyloom.streaming import streams

DAY = lambda n: dt.datetime(2024, 1, n)
SCHEMA = "project_id long, upload timestamp, fingerprint string"


def add(spark, folder, project, day, *names):
    spark.createDataFrame([(project, DAY(day), n) for n in (*names, None)], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def changes(spark, folder):
    rows = spark.read.parquet(f"{folder}/out").collect()
    return sorted(((r.project_id, r.fingerprint, r.upload.day, r.old_status, r.new_status, r.reopen_count) for r in rows), key=repr)


UPLOADS = [(1, 1, "a", "b"), (2, 1, "a"), (1, 2, "b"), (1, 3), (1, 4, "a", "c"), (2, 5, "a")]
WANT = sorted([(1, "a", 1, None, "open", 0), (1, "b", 1, None, "open", 0), (2, "a", 1, None, "open", 0), (1, "a", 2, "open", "resolved", 0), (1, "b", 3, "open", "resolved", 0), (1, "a", 4, "resolved", "open", 1), (1, "c", 4, None, "open", 0)], key=repr)


@pytest.mark.parametrize("at_once", [True, False])
def test_changes_are_the_same_at_once_and_over_restarts(spark, tmp_path, at_once):
    source = tmp_path / "in"
    source.mkdir()
    queries = []
    for u in UPLOADS:
        add(spark, source, *u)
        if not at_once or u == UPLOADS[-1]:
            stream = spark.readStream.schema(SCHEMA).parquet(str(source))
            queries.append(streams.run_available(streams.lifecycle_changes(stream, buckets=3), str(tmp_path / "out"), str(tmp_path / "cp")))
    assert changes(spark, tmp_path) == WANT
    assert streams.state_rows(queries[-1]) == 2 * 3  # a key for each project and share, however many findings
    add(spark, source, 1, 2, "a", "z")  # behind the watermark: dropped and counted, the sign of the upload in each share
    stream = spark.readStream.schema(SCHEMA).parquet(str(source))
    late = streams.run_available(streams.lifecycle_changes(stream, buckets=3), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert streams.dropped_rows(late) == 5 and changes(spark, tmp_path) == WANT


def test_late_uploads_before_the_watermark_change_nothing(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for u in ((1, 4, "a"), (1, 2, "a", "z"), (1, 5)):
        add(spark, source, *u)
        streams.run_available(streams.lifecycle_changes(spark.readStream.schema(SCHEMA).parquet(str(source)), late="60 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert changes(spark, tmp_path) == [(1, "a", 2, None, "late", 0), (1, "a", 4, None, "open", 0), (1, "a", 5, "open", "resolved", 0), (1, "z", 2, None, "late", 0)]


def test_state_of_a_silent_project_goes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    run = lambda: streams.run_available(streams.lifecycle_changes(spark.readStream.schema(SCHEMA).parquet(str(source)), keep_days=3, buckets=1), str(tmp_path / "out"), str(tmp_path / "cp"))
    for u in ((1, 1, "a"), (2, 1, "a"), (2, 20, "a"), (2, 21, "a"), (1, 22, "a")):
        add(spark, source, *u)
        last = run()
    assert streams.state_rows(last) == 2
    assert [c[2:] for c in changes(spark, tmp_path) if c[0] == 1] == [(1, None, "open", 0), (22, None, "open", 0)]


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    schema = "event_id long, project_id long, service_name string, tls_version string, observed_at timestamp"
    source = tmp_path / "in"
    source.mkdir()
    dropped = []
    for n, day in enumerate((1, 10, 11, 2, 12)):
        spark.createDataFrame([(n, 1, "s", "1.2", DAY(day))], schema).coalesce(1).write.mode("append").parquet(str(source))
        query = streams.run_available(streams.daily(spark.readStream.schema(schema).parquet(str(source))), str(tmp_path / "out"), str(tmp_path / "cp"))
        dropped.append(streams.dropped_rows(query))
    assert dropped == [0, 0, 0, 1, 0]
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == 2  # the days 1 and 10, which are closed


def test_uploads_are_applied_in_their_order():
    known: dict = {}
    last, out = streams.apply_uploads(known, 5, {9: {"b"}, 7: {"a", "b"}, 5: {"z"}, 11: {"a"}, 12: set()})
    assert last == 12 and known == {"a": [False, 1], "b": [False, 0]}
    assert out == [("z", 5, None, "late", 0), ("a", 7, None, "open", 0), ("b", 7, None, "open", 0), ("a", 9, "open", "resolved", 0), ("b", 11, "open", "resolved", 0), ("a", 11, "resolved", "open", 1), ("a", 12, "open", "resolved", 1)]
