"""A trigram index in Parquet tables. It only ever narrows a search: indexed and full answers are equal.

Layout of an index folder: CURRENT names the version in use and holds its meta data, main's name and delta's name; a store
(main or delta) has docs/, postings/ and, with case-insensitive indexes, postings_ci/; deleted/ lists documents of main that
no longer count. New data are written beside the old and taken into use by one small file, so a lost executor or driver
leaves the index as it was.

postings has one row for each trigram of a block of documents, with those that hold it and, in another column, their lines,
packed by functions/packing.py: what is asked of documents doesn't read the lines. Where lines begin is told by docs alone.
Trigrams are numbers, three characters of 21 bits. Rows are dealt by a hash of the trigram and of the block, so that a very
common trigram is in many tasks, and lie in folders by that hash of the trigram, in order: a look-up opens the folders of
its trigrams only and reads few row groups in them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from linesieve.functions import packing, regex
from linesieve.functions.casefold import fold_column
from linesieve.operators.lines import line_array
from linesieve.operators.search import lines_of, shown
from linesieve.plans.planner import buffer_is_lines, plan
from linesieve.plans.storage import scratch_path
from linesieve.sources.corpus import Corpus
from linesieve.spec import SearchSpec

VERSION = 3
#: Documents of main for each folder of postings, and folders at most.
SLOT_DOCS, MAX_SLOTS = 512, 256
#: Up to this share of the documents, or this number, documents are read whole rather than by candidate lines.
DOCS_SHARE, DOCS_LEAST, DENSE = 0.007, 500, 10
#: A look-up asks for so many of a term's trigrams, the rarest; what is found is verified in any case.
RAREST = 4
#: Candidates that are broadcast, of a few bytes each, and that are named in the scan's own filter, at most.
BROADCAST_IDS, SCAN_IDS = 1_000_000, 1000
TABLES = {"docs": "doc_id long, path string, relpath string, length long, mtime timestamp, line_bytes array<int>", "postings": f"{packing.ROWS}, slot int"}
DOCS = [x.split()[0] for x in TABLES["docs"].split(", ")]
#: Postings of one batch that leaves a worker; characters, or postings, of a block; rows of a batch of blocks' rows.
_BATCH, BLOCK_CHARS, BLOCK_POSTINGS, _ROWS = 1 << 18, 1 << 22, 1 << 21, 1 << 14


def gram(trigram: str) -> int:
    """A trigram's number."""
    a, b, c = map(ord, trigram)
    return a << 42 | b << 21 | c


def trigram_of(number: Column) -> Column:
    """The three characters of a number; character trigrams serve as byte trigrams do, as every text that holds another
    holds its trigrams."""
    chars = [F.lpad(F.hex(F.shiftright(number, k).bitwiseAND((1 << 21) - 1)), 8, "0") for k in (42, 21, 0)]
    return F.decode(F.unhex(F.concat(*chars)), "UTF-32")


def grams_of(text: str, shown: str | None, only: np.ndarray | None, positions: bool) -> tuple[np.ndarray, ...]:
    """The distinct trigrams within the lines of a text, in order; with positions also where the lines of each begin among the
    lines and the offsets that come with it. Offsets are those of shown, which has a character for each of text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    empty = np.zeros(0, np.int64)
    if len(c) < 3:
        return empty, empty, empty, empty
    end = c == 10
    key = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    inside = ~(end[:-2] | end[1:-1] | end[2:])
    if only is not None:
        inside &= np.isin(key, only)
    key = key[inside]
    if not positions:
        return np.unique(key), empty, empty, empty
    line = np.cumsum(end)[:-2][inside]
    order = np.argsort(key, kind="stable")
    key, line = key[order], line[order]
    first = np.append(True, key[1:] != key[:-1])[: len(key)]
    fresh = first | np.append(True, line[1:] != line[:-1])[: len(key)]
    key, line, first = key[fresh], line[fresh], first[fresh]
    c = c if shown is None else np.frombuffer(shown.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    begins = np.append(0, np.cumsum(size)[end])
    return key[first], np.flatnonzero(first), line + 1, begins[line]


def _extract(docs: DataFrame, folded: bool, only: list[str] | None, positions: bool) -> DataFrame:
    """docs (doc_id, text) -> gram, doc_id and, with positions, lines and offsets. One pass over the texts, no shuffle."""
    wanted = None if only is None else np.array(sorted(map(gram, only)), dtype=np.int64)
    schema = "gram long, doc_id long" + (", lines array<int>, offsets array<long>" if positions else "")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put() -> pa.RecordBatch:
            ids = np.repeat(np.array([x[0] for x in held], dtype=np.int64), [len(x[1]) for x in held])
            columns = {"gram": pa.array(np.concatenate([x[1] for x in held])), "doc_id": pa.array(ids)}
            if positions:
                lines, offsets = (np.concatenate([x[k] for x in held]) for k in (3, 4))
                base = np.cumsum([0, *[len(x[3]) for x in held]])
                ends = pa.array(np.append(np.concatenate([x[2] + b for x, b in zip(held, base)]), base[-1]).astype(np.int32))
                columns |= {"lines": pa.ListArray.from_arrays(ends, pa.array(lines.astype(np.int32))), "offsets": pa.ListArray.from_arrays(ends, pa.array(offsets.astype(np.int64)))}
            return pa.RecordBatch.from_pydict(columns)

        held, size = [], 0
        for b in batches:
            for i, text, seen in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("shown"), strict=True):
                found = grams_of(text.as_py(), seen.as_py(), wanted, positions)
                if len(found[0]):
                    held.append((i, *found))
                    size += len(found[2]) if positions else len(found[0])
                if size >= _BATCH:
                    yield put()
                    held, size = [], 0
        if held:
            yield put()

    texts = docs.filter("text IS NOT NULL")
    text = F.col("text")
    x = texts.select("doc_id", (fold_column(text) if folded else text).alias("text"), (text if folded and positions else F.lit(None).cast("string")).alias("shown"))
    return x.mapInArrow(make, schema)


def postings(docs: DataFrame, folded: bool = False, only: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text) -> gram, doc_id, lines, offsets: one row per trigram and document. Offsets are of the text as it
    is. only: no other trigrams are made into rows."""
    return _extract(docs, folded, only, True)


def document_trigrams(docs: DataFrame, folded: bool = False, only: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text) -> gram, doc_id: each once."""
    return _extract(docs, folded, only, False)


def doc_frequency(docs: DataFrame, folded: bool = False) -> DataFrame:
    """trigram, df."""
    return document_trigrams(docs, folded).groupBy("gram").agg(F.count("*").alias("df")).select(trigram_of(F.col("gram")).alias("trigram"), "df")


def terms_of(spec: SearchSpec, folded: bool) -> list[frozenset[str]] | None:
    return regex.trigram_terms(regex.requirements(spec.parsed, folded))


def term_table(spark: SparkSession, terms: list[frozenset[str]]) -> DataFrame:
    """alt, gram, need: a few rows that come from the pattern."""
    rows = [(i, gram(t), len(term)) for i, term in enumerate(terms) for t in sorted(term)]
    return spark.createDataFrame(rows, "alt int, gram long, need int")


def _hits(pairs: DataFrame, terms: list[frozenset[str]]) -> DataFrame:
    wanted = F.broadcast(term_table(pairs.sparkSession, terms))
    return pairs.filter(F.col("gram").isin(sorted({gram(t) for term in terms for t in term}))).join(wanted, "gram")


def matching_documents(pairs: DataFrame, terms: list[frozenset[str]]) -> DataFrame:
    """pairs (gram, doc_id), each once -> doc_id of documents with all trigrams of an alternative."""
    if len(terms) == 1 and len(terms[0]) == 1:
        return pairs.filter(F.col("gram") == gram(*terms[0])).select("doc_id")
    found = _hits(pairs.select("gram", "doc_id"), terms).groupBy("alt", "doc_id", "need").agg(F.count("*").alias("n")).filter("n = need").select("doc_id")
    return found if len(terms) == 1 else found.distinct()


def matching_lines(posts: DataFrame, terms: list[frozenset[str]]) -> DataFrame:
    """postings -> doc_id, line_no and, if they have offsets, byte_offset of lines with all trigrams of an alternative.

    The lists of lines of a document meet in its row, as many as the alternative has trigrams, and only of documents that
    have all of them; only what is in every list becomes rows.
    """
    columns = [x for x in ("lines", "offsets") if x in posts.columns]
    lists = _hits(posts.select("gram", "doc_id", F.arrays_zip(*columns).alias("at")), terms).groupBy("alt", "doc_id", "need").agg(F.collect_list("at").alias("ls"))
    both = F.aggregate(F.slice("ls", 2, F.size("ls")), F.get("ls", 0), F.array_intersect)
    found = lists.filter(F.size("ls") == F.col("need")).select("doc_id", F.explode(both).alias("x")).select("doc_id", *[F.col(f"x.{x}").alias({"lines": "line_no", "offsets": "byte_offset"}[x]) for x in columns])
    return found if len(terms) == 1 else found.distinct()


@dataclass
class Timing:
    lookup_ms: float = 0.0
    verify_ms: float = 0.0
    candidates: int = 0
    matches: int = 0
    strategy: str = ""
    density: float = 0.0

    def row(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(self.__dict__.values())], "lookup_ms double, verify_ms double, candidates long, matches long, strategy string, density double")


class Store:
    """main or delta."""

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        schema = TABLES[name.removesuffix("_ci")]
        if self.path is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")


def write_store(corpus: DataFrame, path: str, case_insensitive: bool, slots: int) -> None:
    """corpus (doc_id, path, relpath, text, length, mtime) -> the tables of a store."""
    corpus.withColumn("line_bytes", F.transform(F.split("text", "\n", -1), F.octet_length)).select(*DOCS).write.parquet(f"{path}/docs")
    for mark in ("", "_ci") if case_insensitive else ("",):
        write_postings(packed(corpus, bool(mark), slots), f"{path}/postings{mark}", slots)


_CHUNKS = "slot int, base long, chunk binary"


def _put(found: tuple[np.ndarray, np.ndarray, np.ndarray], slots: int) -> Iterator[pa.RecordBatch]:
    made = list(packing.chunks(*found, slots))
    if made:
        slot, base, chunk = zip(*made, strict=True)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slot, pa.int32()), "base": pa.array(base, pa.int64()), "chunk": pa.array(chunk, pa.binary())})


def packed(docs: DataFrame, folded: bool, slots: int) -> DataFrame:
    """docs (doc_id, text) -> slot, base, chunk: the postings of blocks of texts, cut by folder. One pass, no shuffle."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids.append(i)
                texts.append(text.as_py())
                size += len(texts[-1]) + 1
                if size >= BLOCK_CHARS:
                    yield from _put(packing.block_postings(np.array(ids, np.int64), texts, folded), slots)
                    ids, texts, size = [], [], 0
        if ids:
            yield from _put(packing.block_postings(np.array(ids, np.int64), texts, folded), slots)

    return docs.filter("text IS NOT NULL").select("doc_id", "text").mapInArrow(make, _CHUNKS)


def repacked(rows: DataFrame, slots: int) -> DataFrame:
    """gram, doc_id, lines -> slot, base, chunk."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put() -> Iterator[pa.RecordBatch]:
            gram, doc, line = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((line, doc, gram))
            return _put((gram[order], doc[order], line[order]), slots)

        held, size = [], 0
        for b in batches:
            lists = b.column("lines")
            n, line = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
            held.append((*(np.repeat(b.column(x).to_numpy(zero_copy_only=False), n) for x in ("gram", "doc_id")), line.astype(np.int64)))
            size += len(line)
            if size >= BLOCK_POSTINGS:
                yield from put()
                held, size = [], 0
        if size:
            yield from put()

    return rows.select("gram", "doc_id", "lines").mapInArrow(make, _CHUNKS)


def write_postings(chunks: DataFrame, path: str, slots: int) -> None:
    """Chunks are what is shuffled. A trigram's are dealt by block, too: to about two deals a task in all."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        held, size = [], 0
        for b in batches:
            for slot, base, chunk in zip(b.column("slot").to_pylist(), b.column("base").to_pylist(), b.column("chunk"), strict=True):
                rows = packing.rows_of(base, chunk.as_py())
                held.append(rows.append_column("slot", pa.array(np.full(rows.num_rows, slot, np.int32))))
                size += rows.num_rows
                if size >= _ROWS:
                    yield put()
                    held, size = [], 0
        if held:
            yield put()

    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = F.pmod(F.xxhash64("base", F.lit(3)), F.lit(max(1, -(-2 * tasks // slots))))
    rows = chunks.repartition("slot", deal).mapInArrow(make, TABLES["postings"])
    rows.sortWithinPartitions("slot", "gram", "base").write.mode("append").option("compression", "zstd").option("parquet.block.size", 16 << 20).partitionBy("slot").parquet(path)


def unpacked(rows: DataFrame, lines: bool = True) -> DataFrame:
    """Rows of a store's postings -> gram, doc_id and lines, or without those: a row for each document of a trigram."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from map(packing.postings_of, packing.some(b))

    return rows.select("gram", "base", "n", "docs", *["lines"] * lines).mapInArrow(make, "gram long, doc_id long" + ", lines array<int>" * lines)


@F.pandas_udf(ArrayType(LongType()))
def begins(line_bytes: pd.Series) -> pd.Series:
    """Where the lines of these lengths begin, each with a line end."""
    return line_bytes.map(lambda n: np.append(0, np.cumsum(np.asarray(n, np.int64)[:-1] + 1)))


@dataclass
class Index:
    spark: SparkSession
    path: str
    meta: dict = field(default_factory=dict)

    # ---- files ----

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read(self, name: str) -> str | None:
        fs, p = self._fs(f"{self.path}/{name}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        """Written beside and renamed, so a reader sees the old or the new."""
        fs, tmp = self._fs(f"{self.path}/.{name}.{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        _, p = self._fs(f"{self.path}/{name}")
        context = self.spark.sparkContext
        over = context._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = context._gateway.new_array(context._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = over
        context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), context._jsc.hadoopConfiguration()).rename(fs.makeQualified(tmp), fs.makeQualified(p), options)

    def _remove(self, name: str) -> None:
        fs, p = self._fs(f"{self.path}/{name}")
        fs.delete(p, False)

    def size(self) -> int:
        """Bytes of the stores in use."""
        fs, _ = self._fs(self.path)
        return sum(fs.getContentSummary(self._fs(store.path)[1]).getLength() for store in (self.main, self.delta) if store.path)

    def _commit(self, **changes) -> None:
        self.meta = {**self.meta, **changes}
        self._put("CURRENT", json.dumps(self.meta))

    # ---- life ----

    @classmethod
    def build(cls, corpus: Corpus, path: str, case_insensitive: bool = False, spec: SearchSpec | None = None, **options) -> Index:
        """Indexes all documents of the corpus that pass the options; hidden ones too, which searches leave out."""
        spark = corpus.docs.sparkSession
        index = cls(spark, path.rstrip("/"))
        docs = corpus.docs if spec is None else corpus.where(spec).docs
        with index.lock():
            name = f"main-{uuid.uuid4().hex[:12]}"
            n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
            if n != ids:
                raise ValueError("document ids repeat")
            slots = max(1, min(MAX_SLOTS, n // SLOT_DOCS))
            write_store(docs, f"{index.path}/{name}", case_insensitive, slots)
            index._commit(version=VERSION, main=name, delta=None, deleted=None, case_insensitive=case_insensitive, slots=slots, main_docs=n, root=corpus.root, options=options, built_at=datetime.now(UTC).isoformat())
        return index

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        index = cls(spark, path.rstrip("/"))
        raw = index._read("CURRENT")
        if raw is None:
            raise FileNotFoundError(f"no index at {path}")
        index.meta = json.loads(raw)
        if index.meta.get("version") != VERSION:
            raise ValueError(f"index of version {index.meta.get('version')}; build it anew")
        return index

    @classmethod
    def is_current(cls, spark: SparkSession, path: str) -> bool:
        try:
            cls.load(spark, path)
        except (FileNotFoundError, ValueError):
            return False
        return True

    @classmethod
    def open(cls, corpus: Corpus, path: str, case_insensitive: bool = False) -> Index:
        """The index at path, built first if there is none that can be read."""
        spark = corpus.docs.sparkSession
        return cls.load(spark, path) if cls.is_current(spark, path) else cls.build(corpus, path, case_insensitive)

    def lock(self, wait: float = 60.0):
        return Lock(self, wait)

    # ---- tables ----

    @property
    def main(self) -> Store:
        return Store(self.spark, f"{self.path}/{self.meta['main']}")

    @property
    def delta(self) -> Store:
        return Store(self.spark, f"{self.path}/{self.meta['delta']}" if self.meta.get("delta") else None)

    def deleted(self) -> DataFrame:
        if not self.meta.get("deleted"):
            return self.spark.createDataFrame([], "doc_id long")
        return self.spark.read.schema("doc_id long").parquet(f"{self.path}/{self.meta['deleted']}")

    def live(self, name: str, grams: set[str] | None = None, lines: bool = True) -> DataFrame:
        """A table of main without what was deleted, and of delta; of postings those of the given trigrams, if any, a row for
        each document, with or without its lines."""
        parts = []
        for store, tombs in ((self.main, bool(self.meta.get("deleted"))), (self.delta, False)):
            if store.path is None:
                continue
            t = store.table(name)
            if name.startswith("postings"):
                t = unpacked(t if grams is None else self.only(t, grams), lines)
            parts.append(t.join(self.deleted(), "doc_id", "left_anti").select(*t.columns) if tombs else t)
        return reduce(DataFrame.unionByName, parts)

    def only(self, table: DataFrame, grams: set[str]) -> DataFrame:
        """Postings of these trigrams: their folders, and the row groups in which they may be."""
        wanted = np.array(sorted(map(gram, grams)), np.int64)
        slots = np.unique(packing.slots_of(wanted, self.meta["slots"])).tolist()
        return table.filter(F.col("slot").isin(slots) & F.col("gram").isin(wanted.tolist()))

    def docs(self) -> DataFrame:
        return self.live("docs")

    # ---- search ----

    def routed(self, spec: SearchSpec) -> tuple[str, list[frozenset[str]] | None]:
        """Which postings serve the pattern, and its alternatives. Patterns that ignore case need folded postings."""
        cased = terms_of(spec, False)
        if not _ignores_case(spec.parsed):
            return "", cased
        return ("_ci", terms_of(spec, True)) if self.meta.get("case_insensitive") else ("", cased)

    def document_frequencies(self, mark: str, grams: list[str]) -> dict[str, int]:
        """Of a pattern's trigrams; main's counts will do for choosing a way."""
        rows = self.only(self.main.table(f"postings{mark}"), set(grams)).groupBy("gram").agg(F.sum("n").alias("n")).collect()
        by = {r["gram"]: r["n"] for r in rows}
        return {t: by.get(gram(t), 0) for t in grams}

    def rarest(self, mark: str, terms: list[frozenset[str]], most: int = RAREST) -> list[frozenset[str]]:
        """The terms with their rarest trigrams only, which find no fewer documents and lines."""
        if all(len(t) <= most for t in terms):
            return terms
        df = self.document_frequencies(mark, sorted(set().union(*terms)))
        return list(dict.fromkeys(frozenset(sorted(t, key=lambda g: (df[g], g))[:most]) for t in terms))

    def strategy(self, spec: SearchSpec) -> str:
        """all: no pruning; docs: by document; lines: by line."""
        mark, terms = self.routed(spec)
        if spec.invert or terms is None:
            return "all"
        if spec.mode == "buffer" and not buffer_is_lines(spec):
            return "docs"  # a match may span lines, whose postings say nothing of it
        if len(terms) == 1:
            df = self.document_frequencies(mark, sorted(terms[0]))
            if min((df.get(t, 0) for t in terms[0]), default=0) <= max(DOCS_LEAST, DOCS_SHARE * self.meta["main_docs"]):
                return "docs"
        return "lines"

    def candidate_docs(self, spec: SearchSpec, most: int | None = None) -> DataFrame:
        """doc_id of documents with all trigrams of an alternative, or with its so many rarest."""
        mark, terms = self.routed(spec)
        if spec.invert or terms is None:
            return self.docs().select("doc_id")
        terms = terms if most is None else self.rarest(mark, terms, most)
        return matching_documents(self.live(f"postings{mark}", set().union(*terms), lines=False), terms)

    def candidate_lines(self, spec: SearchSpec, most: int | None = None) -> DataFrame:
        """doc_id, line_no, byte_offset."""
        at = self._numbered(spec, most).groupBy("doc_id").agg(F.collect_list("line_no").alias("at"))
        both = at.join(self.docs().select("doc_id", "line_bytes"), "doc_id").select("doc_id", "at", begins("line_bytes").alias("begins"))
        return both.select("doc_id", "begins", F.explode("at").alias("line_no")).select("doc_id", "line_no", F.get("begins", F.col("line_no") - 1).alias("byte_offset"))

    def _numbered(self, spec: SearchSpec, most: int | None = None) -> DataFrame:
        """doc_id, line_no."""
        mark, terms = self.routed(spec)
        if terms is None:
            raise ValueError("the pattern has no trigrams")
        terms = terms if most is None else self.rarest(mark, terms, most)
        return matching_lines(self.live(f"postings{mark}", set().union(*terms)), terms)

    def picked(self, docs: DataFrame, by: DataFrame, how: str = "left_semi") -> DataFrame:
        """docs joined with a table of candidates (doc_id, ..., one row each), which comes first.

        It is written, so its size is known: up to a million rows are broadcast, and the texts stay where they are read; few
        are named in the filter of the scan. Only what is larger is left to a join that shuffles.
        """
        path = scratch_path(self.spark, "candidates")
        by.write.parquet(path)
        found = self.spark.read.schema(by.schema).parquet(path)
        n = found.count()
        if n <= SCAN_IDS:
            docs = docs.filter(F.col("doc_id").isin([r["doc_id"] for r in found.select("doc_id").collect()]))
            if how == "left_semi":
                return docs
        return docs.join(F.broadcast(found) if n <= BROADCAST_IDS else found, "doc_id", how)

    def search(self, corpus: Corpus, spec: SearchSpec, strategy: str | None = None) -> DataFrame:
        """path, line_no, line: what a full search of the indexed documents gives. Candidates are looked up when this is called."""
        strategy = strategy or self.strategy(spec)
        matcher = plan(spec)
        if strategy == "lines":
            hits = self._numbered(spec, RAREST).groupBy("doc_id").agg(F.collect_set("line_no").alias("at"))
            docs = self.picked(corpus.where(spec).docs, hits, "inner")
            lines = docs.select("doc_id", "path", line_array(F.col("text")).alias("ls"), "at").select("path", "ls", F.explode("at").alias("line_no"))
            found = lines.select("path", "line_no", F.get("ls", F.col("line_no") - 1).alias("line")).filter(matcher.matches(F.col("line")))
        else:
            found = lines_of(self.picked(corpus.where(spec).docs, self.candidate_docs(spec, RAREST)) if strategy == "docs" else self.indexed(corpus, spec), spec, matcher)
        return found.select("path", "line_no", shown(F.col("line"), spec).alias("line"))

    def indexed(self, corpus: Corpus, spec: SearchSpec) -> DataFrame:
        """The corpus's documents that pass and that the index knows."""
        return self.picked(corpus.where(spec).docs, self.docs().select("doc_id"))

    def narrowed(self, corpus: Corpus, spec: SearchSpec) -> Corpus:
        """The corpus cut down to candidates, for every operator that takes a corpus."""
        by = self.docs().select("doc_id") if self.strategy(spec) == "all" else self.candidate_docs(spec, RAREST)
        return Corpus(self.picked(corpus.docs, by), corpus.root)

    def count(self, corpus: Corpus, spec: SearchSpec) -> DataFrame:
        return self.search(corpus, spec).agg(F.count("*").alias("n"))

    def timed(self, corpus: Corpus, spec: SearchSpec) -> tuple[DataFrame, Timing]:
        t = Timing(strategy=self.strategy(spec))
        begin = time.perf_counter()
        t.candidates = self.candidate_docs(spec).count()
        t.lookup_ms, begin = (time.perf_counter() - begin) * 1e3, time.perf_counter()
        found = self.search(corpus, spec, t.strategy)
        t.matches, files = found.agg(F.count("*"), F.count_distinct("path")).first()
        t.verify_ms, t.density = (time.perf_counter() - begin) * 1e3, t.matches / files if files else 0.0
        return found, t

    def false_positives(self, corpus: Corpus, spec: SearchSpec) -> DataFrame:
        """doc_id, path of candidates without a match."""
        docs = self.picked(corpus.where(spec).docs, self.candidate_docs(spec))
        return docs.select("doc_id", "path").join(lines_of(docs, spec).select("doc_id").distinct(), "doc_id", "left_anti")

    def stats(self) -> DataFrame:
        """docs, trigrams, postings, avg_postings: one row. A posting is a line that holds a trigram."""
        # A block's rows have counts of their own; only where documents are deleted are they counted one by one.
        rows = self.live("postings").select("gram", F.size("lines").alias("m")) if self.meta.get("deleted") else reduce(DataFrame.unionByName, [s.table("postings").select("gram", "m") for s in (self.main, self.delta) if s.path])
        per = rows.groupBy("gram").agg(F.sum("m").alias("n"))
        x = per.agg(F.count("*").alias("trigrams"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"), F.avg("n").alias("avg_postings"))
        return self.docs().agg(F.count("*").alias("docs")).crossJoin(x)  # one row and one row


def _ignores_case(node: regex.Node) -> bool:
    flags = getattr(node, "flags", None)
    if flags is not None and flags.i:
        return True
    inner = list(getattr(node, "parts", [])) + [x for x in [getattr(node, "node", None)] if x is not None]
    return any(map(_ignores_case, inner))


#: Seconds after which a lock is taken to be left by a writer that died; no build should take as long.
STALE = 24 * 3600.0


class Lock:
    """One writer at a time: a file that only one can create. waited tells that another was at work before."""

    def __init__(self, index: Index, wait: float):
        self.index, self.wait, self.waited = index, wait, False

    def __enter__(self) -> Lock:
        fs, self.file = self.index._fs(f"{self.index.path}/lock")
        until = time.monotonic() + self.wait
        while True:
            try:
                fs.create(self.file, False).close()
                return self
            except Exception as e:
                if "AlreadyExists" in str(e) and fs.exists(self.file) and time.time() - fs.getFileStatus(self.file).getModificationTime() / 1e3 > STALE:
                    fs.delete(self.file, False)
                    continue
                if "AlreadyExists" not in str(e) or time.monotonic() > until:
                    raise TimeoutError(f"{self.index.path} is locked") from e
                self.waited = True
                time.sleep(0.1)

    def __exit__(self, *_) -> None:
        fs, p = self.index._fs(f"{self.index.path}/lock")
        fs.delete(p, False)
