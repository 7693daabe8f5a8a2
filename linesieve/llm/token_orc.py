"""Token ids in ORC files: a corpus encoded once, in ascending order of document ids.

A data set is a folder with data/ (ORC: part, at, doc_id, n_tokens, ids) and manifest/ (ORC: part, first_doc, last_doc,
docs, tokens, start). ORC's integer run-length encoding packs the ids, stripes are read in parallel, row indexes and Bloom
filters on doc_id prune stripes and row groups. at is a document's offset in its part; the manifest has the offsets of the
parts, so no reader has to see what lies before its stripe. Documents are dealt by ranges of ids before they are encoded,
so ids come out in order and no text is held with its tokens.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linesieve.llm.common import columns_like, process_cache, scratch_path, utf8
from linesieve.llm.pieces import PieceStore

END_ID = 1
SCHEMA = "part int, at long, doc_id long, n_tokens long, ids array<int>"
MANIFEST = "part int, first_doc long, last_doc long, docs long, tokens long, start long"
OPTIONS = {"orc.compress": "LZ4", "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


_ALNUM = {bytes([b]) for b in range(128) if chr(b).isalnum()}


class WordEncoder:
    """Ids of a text, word by word: words between ASCII white space are encoded once and kept, the more used ones for long.

    Right for tokenizers whose pre-tokenizer drops white space and whose normalizer doesn't reach across it: NFC composes
    nothing with a space, and runs of white space become one, which is then dropped. ASCII capitals are folded first, which
    the normalizer does in any case, unless the text may name an added token. New words are encoded together. Words of
    letters alone are one piece each, whose last id tells its end; others have a control character between them that is a
    token of its own, and words that hold that are encoded alone. A mark after an ASCII letter or digit at a word's end is
    a piece by itself, so such a word is put together from its parts. What a tokenizer doesn't do, it isn't trusted with.
    """

    MARK = "\x01"

    def __init__(self, path: str, keep: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.run = getattr(t, "encode_batch_fast", t.encode_batch)
        self.kind = np.dtype("<u2" if t.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        one = lambda x: t.encode(x, add_special_tokens=False).ids
        mark = one(self.MARK)
        self.mark = mark[0] if len(mark) == 1 and one(f"a {self.MARK} a")[1:-1] == mark else None
        self.lower = one("aQ") == one("aq")
        self.marks = {m.encode(): np.array(one(m), dtype=self.kind).tobytes() for m in ".,;:!?" if one("a" + m) == one("a") + one(m) and one("7" + m) == one("7") + one(m)}
        suffix = getattr(t.model, "end_of_word_suffix", None)
        vocabulary = t.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max([0, *vocabulary.values()]) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.store = PieceStore(self.kind, keep)

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        out, kind, size = {}, self.kind, self.kind.itemsize
        plain, mixed, alone = [], [], []
        sure = self.mark is not None
        for w in words:
            s = w.decode("utf-8", "surrogatepass")
            if self.lower and s.isalpha() and (s.isascii() or s.lower() == s and unicodedata.is_normalized("NFC", s)):
                plain.append((w, s))
            elif sure and self.MARK not in s:
                mixed.append((w, s))
            else:
                alone.append((w, s))
        for sep, these in ((" ", plain), (f" {self.MARK} ", mixed)):
            groups = [these[k : k + 500] for k in range(0, len(these), 500)]
            for g, e in zip(groups, self.run([sep.join(s for _, s in g) for g in groups], add_special_tokens=False) if groups else [], strict=True):
                ids = np.array(e.ids, dtype=kind)
                raw, at = ids.tobytes(), 0
                gap = sep != " "
                ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)] if gap else (np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1).tolist()
                if len(ends) != len(g):
                    alone += g
                    continue
                for (w, _), z in zip(g, ends, strict=True):
                    out[w] = raw[at * size : z * size]
                    at = z + gap
        for (w, _), e in zip(alone, self.run([s for _, s in alone], add_special_tokens=False) if alone else [], strict=True):
            out[w] = np.array(e.ids, dtype=kind).tobytes()
        return out

    def encode_flat(self, texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts in a row, exactly those of the tokenizers library, and how many each has; null is empty."""
        store = self.store
        store.shrink()
        words, counts = [], []
        for raw in map(utf8, texts):
            ws = (raw.lower() if self.lower and b"<|" not in raw else raw).split()
            counts.append(len(ws))
            words += ws
        numbers, held = store.numbers, len(store.lengths)
        at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        if numbers.fresh:
            marks, ends = self.marks, _ALNUM
            marked = {w: numbers[w[:-1]] for w in numbers.fresh.copy() if w[-1:] in marks and w[-2:-1] in ends}
            got = self._encode([w for w in numbers.fresh if w not in marked])
            for w, stem in marked.items():
                got[w] = (store.ids_of(stem) if stem < held else got[w[:-1]]) + marks[w[-1:]]
            store.add([got[w] for w in numbers.fresh])
        store.count(at)
        flat, ends = store.gather(at)
        stops = np.append(0, ends)[np.cumsum([0, *counts])]
        return flat, np.diff(stops)

    def encode_batch(self, texts: list[str | bytes | None]) -> list[np.ndarray]:
        flat, n = self.encode_flat(texts)
        return np.split(flat, np.cumsum(n)[:-1]) if len(n) else []


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, parts: int | None = None) -> None:
    """Encodes all texts (null: empty), adds end_id to each, and writes the data set at path.

    Rows are ordered by doc_id (null first), and rows of one id as the table has them; they may lie in several parts. An empty table gives a data set without documents.
    """
    spark = docs.sparkSession
    base = columns_like(docs, {"doc_id": "long", "text": "string"})
    # The row's place among equal ids: it splits an id that is repeated very often, and needs no look at the text.
    keyed = base.select("doc_id", F.monotonically_increasing_id().alias("tie"), "text")
    # As many parts as the input has splits at least: they grow in number with it, not in size.
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = process_cache(f"words:{tokenizer}", lambda: WordEncoder(tokenizer))
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            for k in range(0, b.num_rows, 256):
                g = b.slice(k, 256)
                ids, n = encoder.encode_flat(g.column("text").cast(pa.binary()).to_pylist())
                flat = np.full(len(ids) + len(n), end_id, dtype=np.int32)
                flat[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                n = n + 1
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(at + ends - n), g.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat))],
                    names=["part", "at", "doc_id", "n_tokens", "ids"],
                )
                at += int(ends[-1])

    dealt.select("doc_id", "text").mapInArrow(encode, SCHEMA).write.options(**OPTIONS).orc(f"{path}/data")
    data = spark.read.schema(SCHEMA).orc(f"{path}/data")
    # One row per part: small however large the corpus.
    sums = data.groupBy("part").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long"))).coalesce(1).write.orc(f"{path}/manifest")


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, or of the given ids.

    Given ids, the manifest's ranges say in which parts they may be, and only files of those are read past their footers;
    within them stripes and row groups go by ORC's indexes and Bloom filters. Ids that aren't there have no rows.
    """
    data = spark.read.schema(SCHEMA).orc(f"{path}/data")
    parts = spark.read.schema(MANIFEST).orc(f"{path}/manifest")
    if doc_ids is not None:
        ids = sorted({int(x) for x in doc_ids})
        within = [(r["part"], r["first_doc"], r["last_doc"]) for r in parts.filter("last_doc IS NOT NULL").select("part", "first_doc", "last_doc").toLocalIterator()]
        some = [p for p, a, z in within if bisect_left(ids, a) < bisect_right(ids, z)]
        data = data.filter(F.col("part").isin(some) & F.col("doc_id").isin(ids))
    parts = parts.select("part", "start")
    # A row per part, of which a corpus has at most as many as its writer had tasks.
    x = data.join(F.broadcast(parts), "part")
    return x.select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids")


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from what read() gives."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            ends, values = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4", copy=False)
            crcs = [zlib.crc32(values[a:z].tobytes()) for a, z in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """documents -> (doc_id, start, n_tokens, ids_crc32), one row per row, written to path and read back; nulls, repeated ids
    and empty tables as in write(). Other columns are ignored."""
    path = path or scratch_path(docs.sparkSession, "token-orc")
    write(docs, path, tokenizer, end_id)
    return digests(read(docs.sparkSession, path))
