"""Notices of changes: none is lost or repeated over restarts and kills."""

from __future__ import annotations

import os

import pytest
from pyspark.errors import StreamingQueryException

from lodeweave.streaming.watch import NOTICES, kept_running, watch_interval, write_notices

LOG = "version long, uri string, change string"


def test_a_kill_neither_loses_nor_repeats_a_notice(spark, tmp_path):
    log, out, check = (str(tmp_path / n) for n in ("log", "out", "check"))
    wanted = spark.createDataFrame([("ann", "a"), ("ann", "b"), ("bob", "a"), ("bob", "a")], "subscriber string, uri string")

    def commit(version, *uris):
        spark.createDataFrame([(version, u, "written") for u in uris], LOG).coalesce(1).write.mode("append").parquet(log)

    def run():
        kept_running(lambda: write_notices(spark.readStream.schema(LOG).parquet(log), wanted, out, check))
        return sorted((r.subscriber, r.uri, r.version) for r in spark.read.schema(NOTICES).parquet(out).collect())

    commit(1, "a", "a", "c")
    first = [("ann", "a", 1), ("bob", "a", 1)]
    assert run() == first == run()
    commit(2, "a", "b", "b")
    commit(2, "b")  # told again
    second = sorted([*first, ("ann", "a", 2), ("bob", "a", 2), ("ann", "b", 2)])
    assert run() == second
    # as if it was killed before the last batch was known to be done: it is run again
    last = max((n for n in os.listdir(f"{check}/commits") if n.isdigit()), key=int)
    os.remove(f"{check}/commits/{last}")
    for n in os.listdir(f"{check}/commits"):
        if n == f".{last}.crc":
            os.remove(f"{check}/commits/{n}")
    assert run() == second
    commit(3, "b", "c")
    assert run() == sorted([*second, ("ann", "b", 3)])


def test_streams_are_started_again(spark, tmp_path):
    spark.createDataFrame([(1, "a", "written")], LOG).write.parquet(str(tmp_path / "log"))
    waits, starts = [], []

    def start(fails):
        starts.append(1)

        def told(batch, _):
            if len(starts) <= fails:
                raise ValueError("no")

        stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "log")).writeStream.foreachBatch(told)
        return stream.option("checkpointLocation", str(tmp_path / f"c{fails}")).trigger(availableNow=True).start()

    assert kept_running(lambda: start(2), wait=waits.append) == 3 and waits == [0.5, 1.0]
    starts.clear()
    with pytest.raises(StreamingQueryException):
        kept_running(lambda: start(9), attempts=2, wait=waits.append)
    assert len(starts) == 2 and watch_interval() == "3000 milliseconds"
