"""A corpus: documents with doc_id, path, relpath, text, length and mtime, from a table or from files."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linesieve.functions import paths
from linesieve.sources import files
from linesieve.spec import SearchSpec


@dataclass(frozen=True)
class Corpus:
    docs: DataFrame
    root: str = ""

    @classmethod
    def from_table(cls, df: DataFrame, path: Column | str, text: str = "text", doc_id: str | None = "doc_id", mtime: Column | None = None, root: str = "") -> Corpus:
        """Rows of a table; null texts hold no lines. path is also the relative path."""
        p = F.col(path) if isinstance(path, str) else path
        key = F.col(doc_id).cast("long") if doc_id else F.xxhash64(p)
        t = F.col(text).cast("string")
        return cls(df.select(key.alias("doc_id"), p.alias("path"), p.alias("relpath"), t.alias("text"), F.octet_length(t).cast("long").alias("length"), (mtime if mtime is not None else F.lit(None)).cast("timestamp").alias("mtime")), root)

    @classmethod
    def from_files(cls, spark: SparkSession, root: str, hidden: bool = False, no_ignore: bool = False, skip: tuple[str, ...] = (), simple: bool = False) -> Corpus:
        """Files below root, or root itself: empty and binary ones hold no lines and are left out."""
        raw = files.read_binary_files(spark, root) if simple else files.read_files(spark, root, hidden, no_ignore, skip)
        return cls.from_contents(raw, root)

    @classmethod
    def from_contents(cls, raw: DataFrame, root: str = "") -> Corpus:
        kept = raw.filter((F.col("length") > 0) & ~paths.is_binary(F.col("content"), F.col("path")))
        return cls(kept.select(F.xxhash64("path").alias("doc_id"), "path", "relpath", paths.lossy_text(F.col("content")).alias("text"), "length", "mtime"), root)

    def where(self, spec: SearchSpec) -> Corpus:
        """The documents whose paths pass: all conditions are on columns, so a stored path is filtered in the scan."""
        keep = paths.has_type(F.col("path"), spec.types) & paths.passes_globs(F.col("relpath"), spec.include, spec.exclude)
        if not spec.hidden:
            keep = keep & ~paths.is_hidden(F.col("relpath"))
        if spec.path and spec.path.rstrip("/") != self.root.rstrip("/"):
            keep = keep & paths.under(F.col("path"), spec.path)
        return replace(self, docs=self.docs.filter(keep))
