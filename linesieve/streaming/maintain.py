"""An index kept by a stream of changed documents."""

from __future__ import annotations

import json
import os
import time
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linesieve.functions import paths
from linesieve.operators.incremental import apply_changes
from linesieve.operators.index import Index

CHANGES = "doc_id long, path string, relpath string, text string, length long, mtime timestamp, removed boolean"


def changes_of_files(files: DataFrame) -> DataFrame:
    """Rows of the file source as changes; binary and empty files are removals, as they hold no lines."""
    empty = (F.col("length") == 0) | paths.is_binary(F.col("content"), F.col("path"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "relpath", F.when(~empty, paths.lossy_text(F.col("content"))).alias("text"), "length", "mtime", empty.alias("removed"))


def maintain(index: Index, changes: DataFrame, checkpoint: str, available_now: bool = False, every: str = "3 seconds") -> StreamingQuery:
    """Applies a stream of changes batch by batch. A batch that is done again after a failure gives the same index."""

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            apply_changes(index, batch)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).queryName(f"maintain-{zlib.crc32(index.path.encode()):08x}")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return writer.start()


def flush(query: StreamingQuery) -> None:
    """All that has come is in the index when this returns; for searches that must see it."""
    query.processAllAvailable()


def status(query: StreamingQuery) -> dict:
    return {"running": query.isActive, "dirty": bool(query.isActive and query.status["isDataAvailable"]), **query.status}


#: Seconds between looks at what is asked of a daemon, and without a sign of life after which it counts as dead.
LOOK, DEAD = 0.5, 30.0


def serve(index: Index, query: StreamingQuery, out: Callable[[str], None] = print) -> None:
    """Keeps a stream running and answers what is asked through files in the index's folder, until it is asked to stop."""
    beat = 0.0
    try:
        while query.isActive:
            if time.time() - beat > DEAD / 6:
                beat = time.time()
                index._put("daemon", json.dumps({"pid": os.getpid(), "beat": beat, "dirty": status(query)["dirty"]}))
            if index._read("flush") is not None:
                flush(query)
                index._remove("flush")
            if index._read("stop") is not None:
                break
            query.awaitTermination(LOOK)
    except KeyboardInterrupt:
        out("interrupted")
    finally:
        query.stop()
        for name in ("daemon", "stop", "flush"):
            index._remove(name)


def daemon_of(index: Index) -> dict | None:
    """pid, beat and dirty of the daemon that keeps the index; None if there is none, or no sign of life."""
    said = json.loads(index._read("daemon") or "null")
    return said if said and time.time() - said["beat"] < DEAD else None


def ask(index: Index, what: str, wait: float = 60.0) -> bool:
    """what: stop or flush. True when the daemon has done so; False without a daemon, or if it doesn't in time."""
    if daemon_of(index) is None:
        return False
    index._put(what, "")
    until = time.monotonic() + wait
    while index._read(what) is not None and time.monotonic() < until:
        time.sleep(LOOK / 2)
    return index._read(what) is None


def debounced(events: DataFrame, gap: str = "3 seconds", late: str = "10 seconds") -> DataFrame:
    """events (path, ts) -> begin, end, paths: a group ends when nothing has come for the gap, which each event restarts."""
    grouped = events.withWatermark("ts", late) if events.isStreaming else events
    return grouped.groupBy(F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_set("path")).alias("paths"), F.count("*").alias("events")).select(F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "paths", "events")
