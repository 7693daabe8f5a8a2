"""Postings as bytes: numbers of seven bits a byte, differences where there is an order.

A block is a few thousand documents. It has a row for each of its trigrams: docs holds the differences of the ids of the
documents that have it, from base on; lines the differences of their line numbers, each with a bit that tells the last of a
document. A chunk holds those rows of a block that go to one folder, compressed, as they are shuffled.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from linesieve.functions.casefold import _classes

#: What the rows of a block have, and their order in a chunk's head.
ROWS = "gram long, base long, n int, m int, docs binary, lines binary"
CODEC = "zstd"
_HEAD = struct.Struct("<qq")
_LIMITS = [np.uint64(1 << k) for k in range(7, 64, 7)]


def varints(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers -> bytes, the lowest seven bits first, and how many each takes."""
    v = v.astype(np.uint64)
    sizes = np.ones(len(v), np.int64)
    for limit in _LIMITS:
        over = v >= limit
        if not over.any():
            break
        sizes += over
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    while len(v):
        more = v > np.uint64(127)
        out[at] = (v & np.uint64(127)).astype(np.uint8) | more.astype(np.uint8) << 7
        v, at = v[more] >> np.uint64(7), at[more] + 1
    return out, sizes


def numbers(b: np.ndarray) -> np.ndarray:
    """The bytes of varints() -> numbers."""
    if not len(b):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(b < 128)
    if len(last) == len(b):
        return b.astype(np.uint64)
    first = np.append(0, last[:-1] + 1)
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.uint64) << (7 * place).astype(np.uint64), first)


def slots_of(grams: np.ndarray, slots: int) -> np.ndarray:
    """The folders of trigrams: a mix of their bits, as look-ups and workers need the same."""
    x = grams.astype(np.uint64)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((x ^ x >> np.uint64(31)) % np.uint64(slots)).astype(np.int32)


@cache
def _folds() -> np.ndarray:
    """By code point, the least of its class: fold() of arrays."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c, least in _classes()[0].items():
        table[ord(c)] = ord(least)
    return table


def block_postings(ids: np.ndarray, texts: list[str], folded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts of a block -> trigram, document and line of each line that holds a trigram, once and in that order."""
    empty = np.zeros(0, np.int64)
    order = np.argsort(ids, kind="stable")
    ids, texts = ids[order], [texts[i] for i in order.tolist()]
    c = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) < 3:
        return empty, empty, empty
    if folded:
        c = _folds()[c]
    end = c == 10
    inside = ~(end[:-2] | end[1:-1] | end[2:])
    line = np.cumsum(end)[:-2][inside]  # among all lines of the block
    seen = np.zeros(0x110000, bool)
    seen[c] = True
    letters = np.flatnonzero(seen)
    rank = np.empty(0x110000, np.uint32)
    rank[letters] = np.arange(len(letters), dtype=np.uint32)
    r, bits = rank[c].astype(np.int64), len(letters).bit_length()
    key = (r[:-2] << 2 * bits | r[1:-1] << bits | r[2:])[inside]
    del r, end, inside, seen, rank, c
    counts = np.array([t.count("\n") + 1 for t in texts])
    width = int(counts.sum()).bit_length()
    if 3 * bits + width <= 63:
        found = None
    else:  # so many letters and lines that trigrams are numbered first
        found, key = np.unique(key, return_inverse=True)
    key = key << width | line
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
    line, key = key & (1 << width) - 1, key >> width
    if found is not None:
        key = found[key]
    least = (1 << bits) - 1
    gram = letters[key >> 2 * bits] << 42 | letters[key >> bits & least] << 21 | letters[key & least]
    document = np.repeat(np.arange(len(ids)), counts)[line]
    return gram, ids[document], line - (np.cumsum(counts) - counts)[document] + 1


def _gather(data: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of the given sizes in another order, and where each ends."""
    begins, sizes = (np.cumsum(sizes) - sizes)[order], sizes[order]
    ends = np.cumsum(sizes)
    return data[np.arange(len(data)) + np.repeat(begins - (ends - sizes), sizes)], ends


def chunks(gram: np.ndarray, doc: np.ndarray, line: np.ndarray, slots: int) -> Iterator[tuple[int, int, bytes]]:
    """Postings of a block, each once, in order -> slot, base and chunk for each folder that gets some."""
    if not len(gram):
        return
    new_gram = np.append(True, gram[1:] != gram[:-1])
    new_doc = new_gram | np.append(True, doc[1:] != doc[:-1])
    step = line - 1 - np.where(new_doc, 0, np.append(0, line[:-1]))
    lines, line_sizes = varints(step << 1 | np.append(new_doc[1:], True))
    first_line = np.flatnonzero(new_gram)
    doc, first, base = doc[new_doc], np.flatnonzero(new_gram[new_doc]), int(doc.min())
    before = np.append(0, doc[:-1])
    before[first] = base
    docs, doc_sizes = varints(doc.view(np.uint64) - before.view(np.uint64))  # modulo 2^64, so any ids will do
    gram = gram[new_gram]
    doc_bytes, line_bytes = np.add.reduceat(doc_sizes, first), np.add.reduceat(line_sizes, first_line)
    n, m = np.diff(np.append(first, len(doc))), np.diff(np.append(first_line, len(line)))
    slot = slots_of(gram, slots)
    order = np.argsort(slot, kind="stable")
    docs, doc_ends = _gather(docs, doc_bytes, order)
    lines, line_ends = _gather(lines, line_bytes, order)
    slot, gram = slot[order], gram[order]
    begins = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
    before = np.append(0, gram[:-1])
    before[begins] = 0
    rows = np.stack([gram - before, n[order], m[order], doc_bytes[order], line_bytes[order]], 1)
    head, head_sizes = varints(rows.ravel())
    head_ends = np.cumsum(head_sizes)[4::5]
    cut = lambda data, ends, a, b: data[ends[a - 1] if a else 0 : ends[b - 1]]
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(slot)]):
        h = cut(head, head_ends, a, b)
        raw = np.concatenate([h, cut(docs, doc_ends, a, b), cut(lines, line_ends, a, b)])
        yield int(slot[a]), base, _HEAD.pack(len(raw), len(h)) + pa.compress(raw, codec=CODEC, asbytes=True)


def _pieces(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def rows_of(base: int, chunk: bytes) -> pa.RecordBatch:
    """A chunk -> its rows, as ROWS has them."""
    size, head = _HEAD.unpack_from(chunk)
    raw = np.frombuffer(pa.decompress(memoryview(chunk)[_HEAD.size :], size, CODEC), np.uint8)
    step, n, m, doc_bytes, line_bytes = numbers(raw[:head]).astype(np.int64).reshape(-1, 5).T
    docs = head + int(doc_bytes.sum())
    return pa.RecordBatch.from_pydict({
        "gram": pa.array(np.cumsum(step)), "base": pa.array(np.full(len(n), base, np.int64)), "n": pa.array(n.astype(np.int32)), "m": pa.array(m.astype(np.int32)),
        "docs": _pieces(raw[head:docs], doc_bytes), "lines": _pieces(raw[docs:], line_bytes),
    })


def _bytes(column: pa.Array) -> np.ndarray:
    """All bytes of a column's values, one after the other."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)


def postings_of(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (gram, base, n, docs and perhaps lines) -> gram, doc_id and perhaps lines: a row for each document."""
    n = rows.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
    gram, base = (rows.column(x).to_numpy(zero_copy_only=False) for x in ("gram", "base"))
    step = numbers(_bytes(rows.column("docs")))
    total, first = np.cumsum(step), np.cumsum(n) - n
    doc = total + np.repeat(base.view(np.uint64) - (total - step)[first], n)
    out = {"gram": pa.array(np.repeat(gram, n)), "doc_id": pa.array(doc.view(np.int64))}
    if "lines" in rows.schema.names:
        coded = numbers(_bytes(rows.column("lines"))).astype(np.int64)
        ends = np.flatnonzero(coded & 1) + 1
        begins = np.append(0, ends[:-1])
        total = np.cumsum((coded >> 1) + 1)
        before = np.repeat(np.append(0, total[ends[:-1] - 1]), ends - begins)
        out["lines"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array((total - before).astype(np.int32)))
    return pa.RecordBatch.from_pydict(out)


def some(rows: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows by stretches of about so many postings."""
    group = np.cumsum(rows.column("n").to_numpy(zero_copy_only=False).astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), rows.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield rows.slice(a, b - a)
