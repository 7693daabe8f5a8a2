"""Byte-level BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the last 32 bytes cuts texts into chunks, so passages that documents share fall into equal chunks
wherever they stand. A worker encodes a chunk once, while it is kept, and a document's ids are put together from its
chunks'. Where two chunks meet their ids need not be those of the whole text, so the join is re-encoded: from one of the
last places in the left chunk to one of the first in the right at which the pre-tokenizer must cut, whatever stands on
either side. Such places are between a visible character of any script and ASCII white space, and between an ideograph or
kana and a full-width stop or comma: no token reaches over either. The re-encoded stretch takes one piece of each side
with it, and counts only if it gives that piece the ids that its chunk has; otherwise the whole text is encoded. A chunk
without two such places is not encoded by itself but goes into the join, as does the next, until both sides agree: every
text is encoded once, and in time that follows its length. Within what is encoded, the pieces between white space are
looked up among those that the worker has met before the tokenizer is asked.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from linesieve.llm.common import columns_like, process_cache, utf8
from linesieve.llm.pieces import PieceStore

MIN_CHUNK, MAX_CHUNK, CHUNK_BITS = 256, 8192, 10
#: Bytes of chunks and ids that one worker keeps.
CACHE_BYTES = 24 << 20
#: Pieces that one worker keeps.
PIECES = 120_000
#: Rows and bytes of text that are encoded in one go.
STEP_ROWS, STEP_BYTES = 256, 1 << 19
_PIECE = re.compile(rb"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: White space that isn't ASCII, or not everyone's, and what may begin an added token: such texts have no pieces.
_ODD = re.compile(rb"[\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f-\xaf]|\xe3\x80\x80|\xef\xbb\xbf|<\|")
#: Sure places to cut at, as empty matches. White space that isn't ASCII, or not everyone's, is nothing visible.
_SURE = re.compile(
    rb"(?<=[!-~\x80-\xbf])(?<!\xc2[\x85\xa0])(?<!\xe1\x9a\x80)(?<!\xe1\xa0\x8e)(?<!\xe2\x80[\x80-\x8f\xa8-\xaf])(?<!\xe2\x81[\x9f-\xaf])(?<!\xe3\x80\x80)(?<!\xef\xbb\xbf)(?=[ \t\n\r])"
    rb"|(?:(?<=\xe4[\xb8-\xbf][\x80-\xbf])|(?<=[\xe5-\xe8][\x80-\xbf]{2})|(?<=\xe3\x81[\x81-\xbf]))(?=\xe3\x80[\x81\x82]|\xef\xbc[\x81\x8c\x9f])"
)
_GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
_BLOCK = 1 << 20


def _marks(raw: bytes, bits: int) -> list[int]:
    """Places after which the hash of the last 32 bytes has so many leading zeros."""
    out: list[int] = []
    for begin in range(0, len(raw), _BLOCK):
        lead = min(begin, 31)
        h = _GEAR[np.frombuffer(raw, np.uint8, min(len(raw), begin + _BLOCK) - begin + lead, begin - lead)]
        for k in (1, 2, 4, 8, 16):
            if k < len(h):
                h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        at = np.flatnonzero(h >> np.uint32(32 - bits) == 0)
        out += (at[at >= lead] + (begin - lead + 1)).tolist()
    return out


def cuts(raw: bytes, bits: int = CHUNK_BITS, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of a UTF-8 string, none within a character."""
    n = len(raw)
    if n <= least:
        return [n] if n else []
    out, start = [], 0

    def whole(at: int) -> int:
        while at < n and raw[at] & 0xC0 == 0x80:
            at += 1
        return at

    for at in [*_marks(raw, bits), n]:
        while at - start > most:
            start = whole(start + most)
            out.append(start)
        if at - start >= least and at < n:
            start = whole(at)
            if start < n:
                out.append(start)
    if not out or out[-1] < n:
        out.append(n)
    return out


def sure_places(raw: bytes) -> tuple[int, int, int, int] | None:
    """The first two and the last two sure places; None if there are fewer than two."""
    found = _SURE.finditer(raw)
    first = [m.start() for m, _ in zip(found, range(2))]
    if len(first) < 2:
        return None
    back = 64
    while True:
        last = [m.start() for m in _SURE.finditer(raw, max(0, len(raw) - back))][-2:]
        if len(last) == 2:
            return *first, *last
        back *= 4


class Chunk:
    """A chunk's ids, and for its sure places (bytes) the numbers of ids before them."""

    __slots__ = ("ids", "places", "at")

    def __init__(self, ids: np.ndarray, places: tuple[int, int, int, int], at: tuple[int, int, int, int]):
        self.ids, self.places, self.at = ids, places, at


class ChunkEncoder:
    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.run = getattr(t, "encode_batch_fast", t.encode_batch)
        self.cache_bytes = cache_bytes
        self.kept: dict[bytes, Chunk] = {}
        self.size = 0
        #: Bytes that went through the tokenizer as chunks and as joins, and that were reused.
        self.encoded = self.joined = self.reused = 0
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        split, added = made.get("pre_tokenizer") or {}, made.get("added_tokens") or []
        #: Sure places hold for the byte-level pre-tokenizer, and if no added token reaches beyond itself.
        self.divides = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not made.get("normalizer")
        self.divides &= all(not a.get(k) for a in added for k in ("lstrip", "rstrip", "single_word")) and not any(re.search(r"\s", a["content"]) for a in added)
        del made
        # Byte-level tokens have one character a byte; added tokens stand for themselves.
        contents = {i: a.content for i, a in t.get_added_tokens_decoder().items()}
        vocabulary = t.get_vocab(with_added_tokens=True)
        byte_of = self._bytes()
        self.pieces = [b""] * (max([*vocabulary.values(), 0]) + 1)
        for token, i in vocabulary.items():
            self.pieces[i] = contents[i].encode() if i in contents else bytes(byte_of[c] for c in token)
        self.lengths = np.array([len(x) for x in self.pieces], dtype=np.int32)
        self.store = PieceStore(np.dtype("<i4"), PIECES)

    @staticmethod
    def _bytes() -> dict[str, int]:
        """The byte-level alphabet: printable Latin-1 characters are themselves, the other bytes are numbered from 256."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in set(own)]
        return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}

    def encode_whole(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each text by itself, through the tokenizers library, some at a time."""
        out: list[np.ndarray] = []
        group, size = [], 0
        for k, t in enumerate(texts):
            group.append(t.decode("utf-8", "surrogatepass"))
            size += len(t)
            if size >= STEP_BYTES or k == len(texts) - 1:
                out += [np.array(e.ids, dtype=np.int32) for e in self.run(group, add_special_tokens=False)]
                group, size = [], 0
        return out

    def encode_raw(self, texts: list[bytes]) -> list[np.ndarray]:
        """The same by pieces: white space and what follows it, up to the next white space."""
        out: list = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if not self.divides or _ODD.search(t)]
        for i, ids in zip(whole, self.encode_whole([texts[i] for i in whole]), strict=True):
            out[i] = ids
        rest = [i for i, x in enumerate(out) if x is None]
        self.store.shrink()
        numbers, pieces, counts = self.store.numbers, [], []
        for i in rest:
            found = _PIECE.findall(texts[i])
            counts.append(len(found))
            pieces += found
        at = np.fromiter(map(numbers.__getitem__, pieces), np.int64, len(pieces))
        if numbers.fresh:
            self.store.add(self._encode_pieces(numbers.fresh))
        self.store.count(at)
        flat, ends = self.store.gather(at)
        stops = np.append(0, ends)[np.cumsum([0, *counts])]
        for k, i in enumerate(rest):
            out[i] = flat[stops[k] : stops[k + 1]].copy()
        return out

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """New pieces, many in one text: those that begin with one ASCII white space and end without any may stand side by side
        as they would alone. Where the ids' lengths say otherwise each piece is encoded by itself."""
        out: dict[int, bytes] = {}
        side = [i for i, w in enumerate(pieces) if w[:1] in (b" ", b"\n") and w[-1:] not in (b" ", b"\t", b"\n", b"\r")]
        alone = set(range(len(pieces))).difference(side)
        groups = [side[k : k + 400] for k in range(0, len(side), 400)]
        for g, ids in zip(groups, self.encode_whole([b"".join([pieces[i] for i in g]) for g in groups]), strict=True):
            ends, stops = np.cumsum(self.lengths[ids]), np.cumsum([len(pieces[i]) for i in g])
            last = np.searchsorted(ends, stops)
            if not len(ends) or last[-1] >= len(ends) or not np.array_equal(ends[last], stops):
                alone.update(g)
                continue
            raw, a = ids.tobytes(), 0
            for i, z in zip(g, (last + 1).tolist(), strict=True):
                out[i] = raw[4 * a : 4 * z]
                a = z
        rest = sorted(alone)
        for i, ids in zip(rest, self.encode_whole([pieces[i] for i in rest]), strict=True):
            out[i] = ids.tobytes()
        return [out[i] for i in range(len(pieces))]

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_whole([utf8(t) for t in texts])

    def decode(self, ids: np.ndarray) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids.tolist()])

    def _chunk(self, ids: np.ndarray, places: tuple[int, int, int, int]) -> Chunk | None:
        """None if the ids don't end where the places are: then the chunk is left to the join."""
        ends = np.cumsum(self.lengths[ids])
        at = np.searchsorted(ends, places)
        if at[-1] >= len(ends) or not np.array_equal(ends[at], places):
            return None
        return Chunk(ids, places, tuple((at + 1).tolist()))

    def _look_up(self, texts: list[bytes]) -> tuple[list[list[bytes]], dict[bytes, Chunk | None]]:
        """The chunks of each text, and what is known of each chunk; new ones are encoded together, once."""
        docs, seen, new, kept = [], {}, {}, self.kept
        for raw in texts:
            chunks, a = [], 0
            for z in cuts(raw):
                c = raw[a:z]
                a = z
                chunks.append(c)
                if c in seen or c in new:
                    self.reused += len(c) * (c in new or seen[c] is not None)
                elif c in kept:
                    self.reused += len(c)
                    seen[c] = kept[c] = kept.pop(c)  # the last used are evicted last
                elif places := sure_places(c):
                    new[c] = places
                else:
                    seen[c] = None
            docs.append(chunks)
        fresh = list(new)
        for c, ids in zip(fresh, self.encode_raw(fresh), strict=True):
            self.encoded += len(c)
            seen[c] = x = self._chunk(ids, new[c])
            if x:
                kept[c] = x
                self.size += len(c) + ids.nbytes + 500
        return docs, seen

    def _evict(self) -> None:
        while self.size > self.cache_bytes:
            for c in list(self.kept)[: max(1, len(self.kept) // 4)]:
                self.size -= len(c) + self.kept.pop(c).ids.nbytes + 500

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of whole texts, exactly those of the tokenizers library; null is empty."""
        raws = [utf8(t) for t in texts]
        out: list = [None] * len(raws)
        large = [i for i, r in enumerate(raws) if self.divides and len(r) > MIN_CHUNK]
        docs, seen = self._look_up([raws[i] for i in large])
        # A plan has spans of ids, and joins with what they must agree with: (text, ids on the left, ids on the right).
        plans, joins = {}, {}
        for i, chunks in zip(large, docs, strict=True):
            plan, raw, left = [], [], None
            for c in chunks:
                x = seen[c]
                if x is None:
                    raw.append(c)
                    continue
                first, second, _, _ = x.places
                n1, n2, _, n4 = x.at
                if left is None and not raw:
                    plan.append(x.ids[:n4])
                else:
                    tail, agreed = left or (b"", x.ids[:0])
                    join = b"".join([tail, *raw, c[:second]])
                    joins.setdefault(join, len(joins))
                    plan += [(join, agreed, x.ids[n1:n2]), x.ids[n1:n4]]
                left, raw = (c[x.places[2] :], x.ids[x.at[2] : n4]), []
            if raw and left is None:
                continue  # no sure place at all
            if raw:
                join = b"".join([left[0], *raw])
                joins.setdefault(join, len(joins))
                plan.append((join, left[1], left[1][:0]))
            else:
                plan.append(seen[chunks[-1]].ids[seen[chunks[-1]].at[3] :])
            plans[i] = plan
        self.joined += sum(map(len, joins))
        mended = self.encode_raw(list(joins))
        for i, plan in plans.items():
            spans = []
            for p in plan:
                if isinstance(p, tuple):
                    ids, (_, a, z) = mended[joins[p[0]]], p
                    if len(ids) < len(a) + len(z) or ids[: len(a)].tobytes() != a.tobytes() or ids[len(ids) - len(z) :].tobytes() != z.tobytes():
                        break  # no agreement: the whole text is encoded
                    p = ids[len(a) : len(ids) - len(z)]
                spans.append(p)
            else:
                out[i] = np.concatenate(spans)
        whole = [i for i, x in enumerate(out) if x is None]
        for k in range(0, len(whole), STEP_ROWS):
            some = whole[k : k + STEP_ROWS]
            for i, ids in zip(some, self.encode_raw([raws[i] for i in some]), strict=True):
                out[i] = ids
        self._evict()
        return out


def encoder(path: str) -> ChunkEncoder:
    return process_cache(f"chunks:{path}", lambda: ChunkEncoder(path))


def slices(b: pa.RecordBatch, column: str, rows: int = STEP_ROWS, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of so many rows and, unless a row is larger, of so many bytes or values of the column."""
    kind = b.column(column).type
    n = (pc.list_value_length if pa.types.is_list(kind) else pc.binary_length)(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, x in enumerate(n.tolist()):
        if i > start and (i - start >= rows or held + x > size):
            yield b.slice(start, i - start)
            start, held = i, 0
        held += x
    if b.num_rows > start:
        yield b.slice(start)


def _map(df: DataFrame, source: str, target: str, kind: pa.DataType, sql: str, fn) -> DataFrame:
    """df with target instead of source; fn gets some values and gives an Arrow array."""
    others = [c for c in df.columns if c != source]
    if target in others:
        raise ValueError(f"{target} is a column already")
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others], f"`{target}` {sql}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, source):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], fn(part.column(source))], names=[*others, target])

    return df.select(*[f"`{c}`" for c in others], f"`{source}`").mapInArrow(run, schema)


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with ids (array of int) in place of the text column. Null and empty texts have no ids; other columns stay."""

    def fn(column: pa.Array) -> pa.Array:
        rows = encoder(tokenizer).encode_batch(column.to_pylist())
        ends = np.cumsum([0, *[len(x) for x in rows]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))

    return _map(df, text, ids, pa.list_(pa.int32()), "array<int>", fn)


def flat_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The rows of a list column without copies; null rows are empty."""
    ends, values = np.asarray(column.offsets), np.asarray(column.values)
    valid = np.asarray(column.is_valid())
    for i in range(len(column)):
        yield values[ends[i] : ends[i + 1]] if valid[i] else values[:0]


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """df with the text in place of ids; what isn't UTF-8 becomes U+FFFD. Null ids give an empty text."""

    def fn(column: pa.Array) -> pa.Array:
        e = encoder(tokenizer)
        return pa.array([e.decode(x).decode("utf-8", "replace") for x in flat_rows(column)], pa.string())

    return _map(df, ids, text, pa.string(), "string", fn)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """documents -> (doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row of the input: ids and the decoded text as
    encode() and decode() give them, in one pass, of which only digests leave the worker.

    Null and empty texts have no ids, and the digests of nothing. Null ids and rows that repeat keep a row each. An empty
    table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for b in batches:
            for part in slices(b, "text"):
                n, ids, back = [], [], []
                for x in e.encode_batch(part.column("text").to_pylist()):
                    n.append(len(x))
                    ids.append(sha256(x.astype("<u4", copy=False).tobytes()).hexdigest())
                    back.append(sha256(e.decode(x).decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return columns_like(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
