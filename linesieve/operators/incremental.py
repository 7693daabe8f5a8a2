"""Keeping an index up to date. A delta store holds all documents that differ from main; main's own copies are marked
deleted. Both follow from main and the documents of now, so an update that is done twice changes nothing."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesieve.operators.index import DOCS, Index, repacked, unpacked, write_postings, write_store
from linesieve.sources.corpus import Corpus


@dataclass
class UpdateStats:
    added: int
    modified: int
    deleted: int
    unchanged: int
    duration_ms: float = 0.0


def diff(saved: DataFrame, now: DataFrame) -> DataFrame:
    """Two snapshots (path, mtime, length) -> path, status: added, modified, deleted or unchanged. Times count in full, and
    a changed length is a change even at the same time."""
    a = saved.select("path", F.struct("mtime", "length").alias("was"))
    b = now.select("path", F.struct("mtime", "length").alias("is"))
    same = F.col("was.mtime").eqNullSafe(F.col("is.mtime")) & F.col("was.length").eqNullSafe(F.col("is.length"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def is_stale(index: Index, corpus: Corpus) -> bool:
    return not diff(index.docs(), corpus.docs).filter("status != 'unchanged'").limit(1).isEmpty()


def update(index: Index, corpus: Corpus) -> UpdateStats:
    """Brings the index to the corpus of now."""
    begin = time.perf_counter()
    with index.lock() as lock:
        if lock.waited:
            index.meta = Index.load(index.spark, index.path).meta
        counts = dict(diff(index.docs(), corpus.docs).groupBy("status").count().collect())
        stats = UpdateStats(*(int(counts.get(k, 0)) for k in ("added", "modified", "deleted", "unchanged")))
        if stats.added or stats.modified or stats.deleted:
            since = diff(index.main.table("docs"), corpus.docs)
            changed = since.filter("status IN ('added', 'modified')").select("path")
            gone = since.filter("status IN ('deleted', 'modified')").select("path")
            replace_delta(index, corpus.docs.join(changed, "path", "left_semi"), index.main.table("docs").join(gone, "path", "left_semi").select("doc_id"))
    stats.duration_ms = (time.perf_counter() - begin) * 1e3
    return stats


def replace_delta(index: Index, docs: DataFrame, deleted: DataFrame) -> None:
    run = uuid.uuid4().hex[:12]
    write_store(docs.select("doc_id", "path", "relpath", "text", "length", "mtime"), f"{index.path}/delta-{run}", bool(index.meta["case_insensitive"]), index.meta["slots"])
    deleted.distinct().write.parquet(f"{index.path}/deleted-{run}")
    index._commit(delta=f"delta-{run}", deleted=f"deleted-{run}")


def apply_changes(index: Index, changes: DataFrame) -> None:
    """changes (path, relpath, doc_id, text, length, mtime, removed): the last change of a path counts. Delta keeps what it
    has of other paths; their postings are carried over as they are."""
    with index.lock():
        index.meta = Index.load(index.spark, index.path).meta
        order = F.struct("mtime", F.col("removed").cast("int"), "length", "doc_id", "relpath", "text", "removed")
        last = changes.groupBy("path").agg(F.max(order).alias("c")).select("path", "c.*")
        run = uuid.uuid4().hex[:12]
        paths = last.select("path")
        fresh = last.filter("NOT removed").select("doc_id", "path", "relpath", "text", "length", "mtime")
        store, ci = f"{index.path}/delta-{run}", bool(index.meta["case_insensitive"])
        write_store(fresh, store, ci, index.meta["slots"])
        old = index.delta
        if old.path:
            stale = old.table("docs").join(paths, "path", "left_semi").select("doc_id")
            old.table("docs").join(paths, "path", "left_anti").select(*DOCS).write.mode("append").parquet(f"{store}/docs")
            for mark in ("", "_ci") if ci else ("",):
                write_postings(repacked(unpacked(old.table(f"postings{mark}")).join(stale, "doc_id", "left_anti"), index.meta["slots"]), f"{store}/postings{mark}", index.meta["slots"])
        gone = index.main.table("docs").join(paths, "path", "left_semi").select("doc_id").unionByName(index.deleted()).distinct()
        gone.write.parquet(f"{index.path}/deleted-{run}")
        index._commit(delta=f"delta-{run}", deleted=f"deleted-{run}")


def compact(index: Index, corpus: Corpus) -> Index:
    """A new main of the corpus of now."""
    return Index.build(corpus, index.path, bool(index.meta["case_insensitive"]), **index.meta.get("options", {}))
