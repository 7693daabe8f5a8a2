"""Files as rows: a Python data source for batch and streams, and a plain fallback.

Spark's own file sources pass over names that start with a dot or an underscore, and know no ignore files; this source lists
by itself, on the driver, and reads in tasks.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from linesieve.sources import gitignore

SCHEMA = "path string, relpath string, content binary, length long, mtime timestamp"
FORMAT = "linesieve_files"
#: Bytes and files of one task.
SPLIT_BYTES, SPLIT_FILES = 32 << 20, 2000


def walk(root: str, hidden: bool = False, no_ignore: bool = False, skip: tuple[str, ...] = ()) -> Iterator[tuple[str, str, int, int]]:
    """(path, relative path, length, mtime in ns) of regular files; links are not followed; a file may be the root."""
    if os.path.isfile(root):
        s = os.stat(root)
        yield root, os.path.basename(root), s.st_size, s.st_mtime_ns
        return
    skip = tuple(os.path.abspath(x) for x in skip)
    stack = [(root, [] if no_ignore else gitignore.above(root))]
    while stack:
        folder, rules = stack.pop()
        if not no_ignore and (own := gitignore.load(folder)):
            rules = [*rules, own]
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            is_dir = e.is_dir(follow_symlinks=False)
            if e.name.startswith(".") and not hidden or e.name == ".git" and is_dir or os.path.abspath(e.path) in skip:
                continue
            if not no_ignore and gitignore.ignored(e.path, is_dir, rules):
                continue
            if is_dir:
                stack.append((e.path, rules))
            elif e.is_file(follow_symlinks=False):
                try:
                    s = e.stat(follow_symlinks=False)
                except OSError:
                    continue
                yield e.path, os.path.relpath(e.path, root).replace(os.sep, "/"), s.st_size, s.st_mtime_ns


class Split(InputPartition):
    def __init__(self, files: list[tuple[str, str]], gone: bool = False):
        self.files, self.gone = files, gone


def splits(files: Iterator[tuple[str, str, int, int]]) -> list[Split]:
    out, now, size = [], [], 0
    for path, rel, length, _ in files:
        now.append((path, rel))
        size += length
        if size >= SPLIT_BYTES or len(now) >= SPLIT_FILES:
            out.append(Split(now))
            now, size = [], 0
    return [*out, Split(now)] if now or not out else out


def rows(split: Split) -> Iterator[tuple]:
    """Files that can't be read are passed over; of those known to be gone there is an empty row."""
    for path, rel in split.files:
        if split.gone:
            yield path, rel, b"", 0, datetime.now(UTC).replace(tzinfo=None)
            continue
        try:
            with open(path, "rb") as f:
                content = f.read()
            s = os.stat(path)
        except OSError:
            continue
        yield path, rel, content, s.st_size, datetime.fromtimestamp(s.st_mtime_ns / 1e9, UTC).replace(tzinfo=None)


class Options:
    def __init__(self, options: dict):
        self.root = options.get("path") or options["root"]
        yes = lambda k: str(options.get(k, "false")).lower() == "true"
        self.args = {"hidden": yes("hidden"), "no_ignore": yes("no_ignore") or yes("noignore"), "skip": tuple(x for x in options.get("skip", "").split("\n") if x)}

    def files(self) -> Iterator[tuple[str, str, int, int]]:
        return walk(self.root, **self.args)


class FilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = Options(options)

    def partitions(self) -> list[Split]:
        return splits(self.options.files())

    def read(self, partition: Split) -> Iterator[tuple]:
        return rows(partition)


class FilesStreamReader(DataSourceStreamReader):
    """What differs between one listing and the next, by time and length: files that are new, changed or back with an older
    time, and an empty row for each that is gone. An offset is the number of a listing; listings that are still needed lie in
    the state folder, so a stream that is started again goes on from there. Like all listing it is the driver's work."""

    def __init__(self, options: dict):
        self.options, self.state = Options(options), options.get("state") or tempfile.mkdtemp(prefix="linesieve-listing-")
        os.makedirs(self.state, exist_ok=True)
        self.at = max([0, *(int(n) for n in os.listdir(self.state) if n.isdigit())])

    def known(self, n: int) -> dict[str, list]:
        if not n:
            return {}
        with open(os.path.join(self.state, str(n)), encoding="utf-8", errors="surrogateescape") as f:
            return json.load(f)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        now = {path: [rel, length, ns] for path, rel, length, ns in self.options.files()}
        if now != self.known(self.at):
            path = os.path.join(self.state, str(self.at + 1))
            with open(path + ".new", "w", encoding="utf-8", errors="surrogateescape") as f:
                json.dump(now, f, ensure_ascii=False)
            os.replace(path + ".new", path)
            self.at += 1
        return {"listing": self.at}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        was, now = self.known(start["listing"]), self.known(end["listing"])
        gone = [(path, x[0]) for path, x in was.items() if path not in now]
        return [*splits((path, *x) for path, x in now.items() if was.get(path) != x), Split(gone, True)]

    def read(self, partition: Split) -> Iterator[tuple]:
        return rows(partition)

    def commit(self, end: dict) -> None:
        for n in os.listdir(self.state):
            if n.isdigit() and int(n) < end["listing"]:
                os.remove(os.path.join(self.state, n))


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)

    def streamReader(self, schema) -> FilesStreamReader:
        return FilesStreamReader(self.options)


def read_files(spark: SparkSession, root: str, hidden: bool = False, no_ignore: bool = False, skip: tuple[str, ...] = ()) -> DataFrame:
    spark.dataSource.register(FilesSource)
    return spark.read.format(FORMAT).option("root", root).option("hidden", hidden).option("no_ignore", no_ignore).option("skip", "\n".join(skip)).load()


def stream_files(spark: SparkSession, root: str, hidden: bool = False, no_ignore: bool = False, skip: tuple[str, ...] = (), state: str | None = None) -> DataFrame:
    """state: the folder of listings, for a stream that may be started again; without one a temporary folder."""
    spark.dataSource.register(FilesSource)
    options = {"root": root, "hidden": hidden, "no_ignore": no_ignore, "skip": "\n".join(skip)} | ({"state": state} if state else {})
    return spark.readStream.format(FORMAT).options(**options).load()


def read_binary_files(spark: SparkSession, root: str) -> DataFrame:
    """For stores that only Spark reaches: no ignore files, and names with a dot or an underscore in front are not seen."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
    path = F.regexp_replace("path", r"^file:/*(?=/)", "")
    return raw.select(path.alias("path"), path.substr(F.lit(len(root.rstrip("/")) + 2), F.length(path)).alias("relpath"), "content", "length", F.col("modificationTime").alias("mtime"))
