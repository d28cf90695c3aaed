"""Changes of the corpus as a stream over the store's append-only log."""

from __future__ import annotations

import time
from collections.abc import Callable, Collection, Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodeweave import config
from lodeweave.schemas import CHANGES
from lodeweave.store import Store

PAGE = 500


def watch_for_changes(store: Store, on_change: Callable[[list[str]], None], checkpoint: str | Path, interval: str | None = None, page: int = PAGE) -> StreamingQuery:
    """Calls on_change with changed addresses, `page` at a time; an empty list if there were deletions only.

    The checkpoint makes each change come once, also over restarts.  Without an interval the stream ends when it has
    read what is there.
    """
    store.files.mkdirs("changes")

    def told(batch: DataFrame, _: int) -> None:
        kept = batch.where("change <> 'deleted'").select("uri").distinct().orderBy("uri")
        if batch.isEmpty():
            return
        uris: list[str] = []
        empty = True
        for row in kept.toLocalIterator():
            uris.append(row.uri)
            if len(uris) == page:
                on_change(uris)
                uris, empty = [], False
        if uris or empty:
            on_change(uris)

    stream = store.spark.readStream.schema(CHANGES).parquet(store.files.at("changes"))
    writer = stream.writeStream.foreachBatch(told).option("checkpointLocation", str(checkpoint))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def watch_interval() -> str:
    """The time between looks at the log, from the settings."""
    return f"{int(config.number('watch_ms'))} milliseconds"


NOTICES = "subscriber string, uri string, version long, change string"


def notices_of(changes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(subscriber, uri, version, change) from a stream of changes and a table (subscriber, uri): one for each version of an address.

    What was told last is state by subscriber and address, so a change that is read again, or told twice in a version, gives
    no second notice.  No state is larger than a number, and a very busy address has one notice a version.
    """

    def told(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        rows = pd.concat(list(frames))
        fresh = rows[rows["version"] > last].sort_values(["version", "change"]).drop_duplicates("version")
        if len(fresh):
            state.update((int(fresh["version"].max()),))
            yield fresh.assign(subscriber=key[0], uri=key[1])[["subscriber", "uri", "version", "change"]]

    # one row a version before rows of a key meet
    wanted = changes.join(subscriptions.select("subscriber", "uri").distinct(), "uri").select("subscriber", "uri", "version", "change")
    return wanted.groupBy("subscriber", "uri").applyInPandasWithState(told, NOTICES, "last long", "append", GroupStateTimeout.NoTimeout)


def write_notices(changes: DataFrame, subscriptions: DataFrame, folder: str, checkpoint: str | Path, interval: str | None = None) -> StreamingQuery:
    """notices_of() appended to a table of files.  With the checkpoint, a kill between batches neither loses nor repeats one."""
    writer = notices_of(changes, subscriptions).writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", str(checkpoint))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def change_stream(store: Store, **options: Any) -> DataFrame:
    """The store's log as a stream."""
    store.files.mkdirs("changes")
    return store.spark.readStream.schema(CHANGES).options(**options).parquet(store.files.at("changes"))


def kept_running(start: Callable[[], StreamingQuery], attempts: int = 6, first_ms: int = 500, most_ms: int = 60_000, wait: Callable[[float], None] = time.sleep) -> int:
    """Waits for a stream to end, and starts it again after a failure, each time after twice the wait; how many starts it took.

    A stream that ran longer than the longest wait begins anew with the first.
    """
    failures = 0
    starts = 0
    while True:
        began = time.monotonic()
        starts += 1
        try:
            start().awaitTermination()
            return starts
        except StreamingQueryException:
            failures = 0 if time.monotonic() - began > most_ms / 1000 else failures
            if failures + 1 == attempts:
                raise
            wait(min(most_ms, first_ms << failures) / 1000)
            failures += 1


def subscribed(on_list: Callable[[], None], on_uri: Callable[[str], None], uris: Collection[str]) -> Callable[[list[str]], None]:
    """A listener that always says that the list has changed, and of each address that is subscribed."""

    def told(changed: list[str]) -> None:
        on_list()
        for uri in changed:
            if uri in uris:
                on_uri(uri)

    return told


def changed_since(changes: DataFrame, version: int, after: str = "", limit: int = PAGE) -> DataFrame:
    """A page of addresses that changed after a version, by address."""
    found = changes.where((F.col("version") > version) & (F.col("uri") > after)).select("uri").distinct()
    return found.orderBy("uri").limit(limit)
