"""Requests that come twice, and late ones."""

from datetime import datetime, timedelta

import pytest

from caseloom.sources.requests import TIMED_SCHEMA, distinct_requests, read_request_stream, unscored

START = datetime(2024, 1, 1)


def request(key, minutes, drug="a", age=50.0):
    return (key, drug, "oral", "x", None, age, 70.0, "F", None, "QD", 3.0, None if minutes is None else START + timedelta(minutes=minutes))


def run(spark, tmp_path, batches, late="30 minutes"):
    """Every batch of requests as a file, taken one after the other."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, TIMED_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # One batch a run: the order of the files is that of the requests.
        (distinct_requests(read_request_stream(spark, str(tmp_path / "in"), timed=True), late).writeStream.format("parquet")
         .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(TIMED_SCHEMA).parquet(str(tmp_path / "out"))


def ids(df):
    return sorted((r.primaryid or 0, r.drugname) for r in df.collect())


def test_stream_equals_table(spark, tmp_path):
    batches = [[request(1, 0), request(2, 1), request(1, 2)], [request(2, 5), request(3, 6), request(1, 7, drug="b")],
               [request(3, 20), request(4, 25), request(None, 26), request(None, 27), request(None, 28, drug="c")]]
    streamed = run(spark, tmp_path, batches)
    table = distinct_requests(spark.createDataFrame([r for b in batches for r in b], TIMED_SCHEMA))
    assert ids(streamed) == ids(table) == [(0, "a"), (0, "c"), (1, "a"), (1, "b"), (2, "a"), (3, "a"), (4, "a")]
    assert table.columns == TIMED_SCHEMA.names


def test_late_and_forgotten(spark, tmp_path):
    """Behind the newest by more than the limit is dropped; so are repeats no longer remembered, which are late too."""
    batches = [[request(1, 0), request(2, 100)], [request(3, 101)], [request(4, 20), request(1, 0), request(5, 90), request(6, None)], [request(7, 300)],
               [request(2, 299)]]
    streamed = run(spark, tmp_path, batches)
    got = ids(streamed)
    # Request 2 came again after 199 minutes and counts as new.
    assert got.count((2, "a")) == 2 and (4, "a") not in got and (1, "a") in got and (5, "a") in got
    everything = spark.createDataFrame([r for b in batches for r in b], TIMED_SCHEMA)
    assert [k for k, _ in ids(unscored(everything, streamed))][:1] == [4]


def test_empty(spark):
    assert distinct_requests(spark.createDataFrame([], TIMED_SCHEMA)).collect() == []
    with pytest.raises(Exception):
        distinct_requests(spark.createDataFrame([(1,)], "primaryid long"))
