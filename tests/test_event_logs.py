"""Logs as a stream: truncation between batches, half lines, restarts after a failed batch, and ranges."""

from __future__ import annotations

import pytest

from lexmill.sources import event_logs
from lexmill.storage import shared_path


@pytest.fixture
def root(spark):
    spark.dataSource.register(event_logs.EventLogs)
    return shared_path(spark, "logs")


def start(spark, root, log, values, generation=1):
    rows = spark.createDataFrame([(log, k, v) for k, v in enumerate(values)], "log string, seq long, value string")
    event_logs.write_generation(rows, root, generation)


def drain(spark, root, out, **options):
    stream = spark.readStream.format("event_logs").options(**options).load(root)
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.log, r.value) for r in spark.read.schema(event_logs.SCHEMA).parquet(f"{out}/rows").collect())


def test_truncation_between_batches(spark, root):
    out = shared_path(spark, "logs-out")
    start(spark, root, "a", ["1", "2", "3", "4", "é5"])
    start(spark, root, "b", ["x"])
    assert drain(spark, root, out) == [("a", v) for v in ("1", "2", "3", "4", "é5")] + [("b", "x")]
    event_logs.append(root, "a", ["6", "7"])
    more = spark.createDataFrame([("a", 1, "8"), ("a", 2, "9"), ("c", 1, "new")], "log string, seq long, value string")
    event_logs.write_generation(more.filter("log = 'a'"), root, 2, folded=0.4)  # keeps lines that were read, and 6 and 7
    event_logs.write_generation(more.filter("log = 'c'"), root, 5)
    event_logs.append(root, "a", ["10", "half"], whole=False)
    got = drain(spark, root, out, prune="true")
    assert got == sorted([("a", v) for v in ("1", "2", "3", "4", "é5", "6", "7", "8", "9", "10")] + [("b", "x"), ("c", "new")])
    event_logs.append(root, "a", ["", "11"])
    got = drain(spark, root, out, prune="true")
    assert ("a", "half") in got and ("a", "11") in got and len(got) == 14
    assert event_logs.generations(root) == {"a": [2], "b": [1], "c": [5]}


def test_truncation_before_a_reader_was_there(spark, root):
    """What nobody had read comes from the generation before; a generation without a note is read from its header."""
    out = shared_path(spark, "logs-out")
    start(spark, root, "a", ["1", "2"])
    drain(spark, root, out)
    event_logs.append(root, "a", ["3", "4", "5"])
    event_logs.write_generation(spark.createDataFrame([("a", 1, "6")], "log string, seq long, value string"), root, 2, folded=1.0)
    assert [v for _, v in drain(spark, root, out)] == list("123456")
    start(spark, root, "a", ["7", "8"], generation=3)
    assert [v for _, v in drain(spark, root, out)] == list("12345678")


def test_a_failed_batch_comes_again(spark, root):
    out, seen, fail = shared_path(spark, "logs-out"), [], [True]
    start(spark, root, "a", list("12345"))

    def sink(batch, number):
        rows = sorted(r.value for r in batch.collect())
        if fail[0]:
            raise RuntimeError("lost")
        seen.append((number, rows))

    def go():
        stream = spark.readStream.format("event_logs").load(root)
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="lost"):
        go()
    event_logs.append(root, "a", ["6"])
    event_logs.write_generation(spark.createDataFrame([("a", 1, "7")], "log string, seq long, value string"), root, 2, folded=0.5)
    fail[0] = False
    go()
    go()
    assert [v for _, rows in seen for v in rows] == list("1234567") and seen[0] == (0, list("12345"))


def test_ranges_cut_lines_once(spark, root):
    values = ["x" * (k % 17) + str(k) for k in range(300)] + ["é" * 50]
    start(spark, root, "a", values)
    start(spark, root, "b", [])
    for size in (5, 64, 10**6):
        rows = spark.read.format("event_logs").option("rangeBytes", size).load(root).collect()
        assert [r.value for r in sorted(rows, key=lambda r: r.at)] == values
    assert spark.read.format("event_logs").load(shared_path(spark, "no-logs")).count() == 0
