"""What the operators of this subpackage share: scratch tables, row splits, word rules."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesieve.plans.storage import scratch_path

#: ASCII white space, which alone separates words.
WS = r"[\x20\x09-\x0D]+"
WS_CHARS = " \t\n\x0b\x0c\r"


def remainder(doc_id: Column, m: int) -> Column:
    """crc32(doc_id as text) mod m; -1 for a null id, which therefore is in no fold of its own."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % m, F.lit(-1).cast("long"))


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is heavy if it has more than a share of one in so many of the rows: there are fewer such keys than that.
HEAVY = 4096


def join_counted(rows: DataFrame, found: DataFrame, key: str, n: str, total: int | None = None) -> DataFrame:
    """rows joined with found, which has each key once with the number n of its rows. Null keys join nothing.

    Keys with more than 1/HEAVY of all rows are broadcast (by that rule there are fewer than HEAVY), so that their rows stay
    where they are; the others are joined as Spark sees fit, none with more than that share in one task. total: the number
    of rows, counted if not given.
    """
    least = (rows.count() if total is None else total) / HEAVY
    heavy = F.broadcast(found.filter(F.col(n) > least))
    light = rows.join(heavy.select(key), key, "left_anti").join(found.filter(F.col(n) <= least), key)
    return light.unionByName(rows.join(heavy, key))


def drop(df: DataFrame) -> None:
    """Deletes the files of a table made by materialise()."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        if "/linesieve/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WS), "")


def process_cache(name: str, make):
    """One object per worker process, kept across tasks."""
    kept = sys.__dict__.setdefault("_linesieve_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def utf8(text: str | bytes | None) -> bytes:
    return b"" if text is None else text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")


def sorted_runs(frames: Iterator[pd.DataFrame], keys: list[str], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of each run of equal keys, in batches that are sorted by them; a run may span batches."""
    held: list[list[np.ndarray]] = []
    last = None

    def whole() -> list[np.ndarray]:
        return held[0] if len(held) == 1 else [np.concatenate(x) for x in zip(*held, strict=True)]

    for frame in frames:
        n = len(frame)
        if not n:
            continue
        by, have = [frame[k].to_numpy() for k in keys], [frame[c].to_numpy() for c in columns]
        new = np.zeros(n, dtype=bool)
        for k in by:
            new[1:] |= k[1:] != k[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), n]
        for a, z in zip(edges, edges[1:]):
            key = [k[a] for k in by] if a == 0 else None
            if held and (key is None or key != last):
                yield whole()
                held = []
            held.append([c[a:z] for c in have])
        last = [k[-1] for k in by]
    if held:
        yield whole()


def columns_like(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The named columns with the given types; a missing one is null. Other columns are left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{n}`") if n in have else F.lit(None)).cast(t).alias(n) for n, t in names.items()])


def own_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


__all__ = ["WS", "WS_CHARS", "columns_like", "drop", "join_counted", "materialise", "own_name", "process_cache", "remainder", "scratch_path", "sorted_runs", "utf8", "words_of"]
