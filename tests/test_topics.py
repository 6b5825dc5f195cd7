from __future__ import annotations

import pytest

from nearfield.functions.sampling import sample_rows, shuffled
from nearfield.sources.topics import BATCH, TopicLog


def test_append_and_read(spark, tmp_path):
    log = TopicLog(spark, str(tmp_path))
    assert log.read_next("t") is None and log.entry_count("t") == 0 and log.size("t") == 0
    log.append("t", b"one")
    log.batch_append("t", [b"two", b"", b"three"])
    log.batch_append("t", [])
    log.append("other", b"x")
    assert log.entry_count("t") == 4 and log.size("t") == 11
    assert log.read_next("t", checkpoint=False) == b"one" == log.read_next("t")
    assert log.entry_count("t") == 3
    assert log.batch_read("t", 4, start_offset=3) == [b"two", b""]
    assert log.batch_read("t", 4) == [b"two", b""]
    again = TopicLog(spark, str(tmp_path))
    assert again.batch_read("t", 1) == [b"three"] and again.batch_read("t", 1) == []
    with pytest.raises(ValueError):
        log.batch_append("t", [b""] * (BATCH + 1))
    q = log.stream("t").writeStream.format("memory").queryName("topic").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [bytes(r["data"]) for r in spark.sql("select data from topic order by seq").collect()] == [b"one", b"two", b"", b"three"]


def test_torn_batches(spark, tmp_path):
    log = TopicLog(spark, str(tmp_path))
    log.batch_append("t", [b"a", b"", b"bc"])
    (tmp_path / "t/entries/first=3/_temporary").mkdir(parents=True)  # a writer that ended before its batch was whole
    assert log.entry_count("t") == 3 and log.size("t") == 3
    log.append("t", b"d")
    assert log.batch_read("t", 100) == [b"a", b"", b"bc", b"d"] and log.size("t") == 4
    log._tail = lambda topic: (3, 3)  # as read before another writer's batch was there
    with pytest.raises(Exception, match="already exists"):
        log.append("t", b"lost")
    assert [r["seq"] for r in log.entries("t").orderBy("seq").collect()] == [0, 1, 2, 3]


def test_samples(spark):
    rows = spark.range(100)
    a = [r["id"] for r in sample_rows(rows, 10, 3, "id").collect()]
    assert a == [r["id"] for r in sample_rows(rows.repartition(7), 10, 3, "id").collect()] and len(set(a)) == 10
    assert a != [r["id"] for r in sample_rows(rows, 10, 4, "id").collect()]
    assert sample_rows(rows, 1000, 3, "id").count() == 100
    assert sorted(r["id"] for r in shuffled(rows, 1, "id").collect()) == list(range(100))
