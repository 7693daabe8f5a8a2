"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Texts come in blocks; a block's distinct n-grams are dealt by hash range with their counts in the block's training texts.
A range adds the counts up exactly and fills its own segment of the filter: an n-gram with quantised count q is entered as
(n-gram, 1) ... (n-gram, q), and is read back by probing 1, 2, ... until one is missing. No n-gram is left out: segments
grow with their entries, and ranges with the input. As a segment stays where its range is, so do the probes: each block's
n-grams are answered there, in their order, and the answers go back to the block's texts. Neither is any n-gram a row of
its own nor any part of the model broadcast.
A text's probability interpolates orders: p_k = (c_k + kappa * p_(k-1)) / (c_context + slack + kappa), down to the unigram
estimate. Counts are read as the lower edge of their class, and slack is what false positives add over the whole
vocabulary, so probabilities sum to 1 at most, as far as the filter's false positives are what is expected of them.

Counts of words are exact, for both scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesieve.llm.common import columns_like, materialise, remainder, utf8

FOLDS, HELD_OUT = 5, 1
ORDER, KAPPA, LOG_BASE = 2, 300.0, 1.3
#: Bits of the filter for an entry: the most, unless segment() is given a bound; then as many as there is room for.
LEAST_BITS, MOST_BITS = 16, 24
#: Probes for the first class, which tells whether an n-gram is there at all, and for each further one.
FIRST_PROBES, MORE_PROBES = 6, 3
#: Rows of a block, as a power of two, and bytes of text after which a part of it is counted by itself.
BLOCK_BITS, PIECE_BYTES = 11, 12 << 20
#: Tasks that score at most; as many as there are blocks below that, so that none grows with the input.
MOST_TASKS = 1 << 15
#: Bytes whose words, and tokens whose probabilities, are in memory as such at a time.
STEP_BYTES, STEP_TOKENS = 1 << 20, 1 << 18
END, START = b"\n", b"\n\n"  # no word has white space
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_K = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary(dict):
    """Words to numbers in order of appearance, with their hashes; a word that is asked for is entered."""

    def __init__(self):
        super().__init__()
        self.fresh: list[int] = []
        self.hashes = np.zeros(0, np.uint64)
        self[START], self[END]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(xxhash.xxh64_intdigest(word))
        return n

    def grown(self) -> np.ndarray:
        """Hashes of the words that came since the last call, after they have been added to hashes."""
        new = np.array(self.fresh, dtype=np.uint64)
        self.hashes, self.fresh = np.concatenate([self.hashes, new]), []
        return new


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time, however long it is."""
    at = 0
    while at < len(raw):
        found = _SPACE.search(raw, at + STEP_BYTES) if len(raw) - at > STEP_BYTES else None
        end = found.start() if found else len(raw)
        yield raw[at:end].lower().split()
        at = end


def sequences(texts: list[str | None], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of START, words, END for each text in a row, and where each text begins."""
    parts, starts, at, held = [], [], 0, []

    def put() -> None:
        parts.append(np.fromiter(map(vocabulary.__getitem__, held), np.int32, len(held)))
        held.clear()

    for t in texts:
        starts.append(at)
        held.append(START)
        at += 2
        for w in _words(utf8(t)):
            held += w
            at += len(w)
            if len(held) > STEP_TOKENS:
                put()
        held.append(END)
    put()
    return np.concatenate(parts), np.array(starts, dtype=np.int64)


def keys_by_order(h: np.ndarray, starts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: the key of the n-gram that ends at each place, and whether it lies within its text."""
    place = np.arange(len(h), dtype=np.int32) - np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(h))))
    out, key = [], h
    for k in range(1, order + 1):
        if k > 1:
            before = np.empty_like(key)
            before[1:], before[:1] = key[:-1], 0
            before *= _K
            before += h
            key = mix(before)
        out.append((key, place >= k - 1))
    return out


def levels(counts: np.ndarray, base: float = LOG_BASE) -> np.ndarray:
    """Quantised counts: 1 + floor(log(count) / log(base)); 0 for 0."""
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(base) + 1e-9), 0).astype(np.int64)


def lower_edges(most: int, base: float = LOG_BASE) -> np.ndarray:
    """The least count of each class."""
    return np.array([0.0] + [math.ceil(base ** (q - 1) - 1e-9) for q in range(1, most + 1)])


def probe_places(keys: np.ndarray, level: int, i: int, bits: np.ndarray) -> np.ndarray:
    a = mix(keys + np.uint64(level * int(_K) % (1 << 64)))
    return (a + np.uint64(i) * (mix(a) | np.uint64(1))) % bits


def segment(keys: np.ndarray, counts: np.ndarray, most_bits: int | None = None, base: float = LOG_BASE) -> tuple[bytes, int, float]:
    """The filter of one hash range, the least count that it holds (1 without a bound), and its rate of false positives."""
    q, least = levels(counts, base), 1
    while most_bits is not None and q.sum() * LEAST_BITS > most_bits and len(keys):
        least += 1
        keep = counts >= least
        keys, counts, q = keys[keep], counts[keep], q[keep]
    bits = int(q.sum()) * MOST_BITS
    bits = max(64, bits if most_bits is None else min(bits, most_bits))
    flags = np.zeros((bits + 7) // 8 * 8, dtype=bool)
    size = np.uint64(len(flags))
    for level in range(1, int(q.max(initial=0)) + 1):
        keys, q = keys[q >= level], q[q >= level]
        for i in range(FIRST_PROBES if level == 1 else MORE_PROBES):
            flags[probe_places(keys, level, i, size)] = True
    return np.packbits(flags, bitorder="little").tobytes(), least, float(flags.mean() ** FIRST_PROBES)


def probe(keys: np.ndarray, ranges: np.ndarray, bits: np.ndarray, offsets: np.ndarray, filter: np.ndarray) -> np.ndarray:
    """Quantised counts, by repeated membership probes of each key's range."""
    q = np.zeros(len(keys), dtype=np.int64)
    at = np.arange(len(keys))
    level = 0
    while len(at):
        level += 1
        for i in range(FIRST_PROBES if level == 1 else MORE_PROBES):
            k, r = keys[at], ranges[at]
            place = probe_places(k, level, i, bits[r])
            byte = filter[offsets[r] + (place >> np.uint64(3)).astype(np.int64)]
            at = at[(byte >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        q[at] = level
    return q


def range_of(keys: np.ndarray, shift: int) -> np.ndarray:
    return (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)


class Estimates:
    """What probabilities are made of, whoever holds the counts."""

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1))


@dataclass
class Model(Estimates):
    """A whole model in one piece."""

    order: int
    kappa: float
    shift: int  # a key's range is key >> shift
    bits: np.ndarray  # of each range's segment
    offsets: np.ndarray  # bytes before each segment
    filter: np.ndarray
    words: np.ndarray  # sorted hashes
    word_counts: np.ndarray
    tokens: int
    distinct: int
    texts: int
    false_rate: float = 0.0
    base: float = LOG_BASE

    def counts(self, keys: np.ndarray, order: int = 0) -> np.ndarray:
        """Lower edges of the counts."""
        q = probe(keys, range_of(keys, self.shift), self.bits, self.offsets, self.filter)
        return lower_edges(int(q.max(initial=0)), self.base)[q]

    def exact(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of words."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.word_counts[at], 0)


@dataclass
class Answers(Estimates):
    """The same for one piece of a block, of which all n-grams of an order must be asked for at once."""

    order: int
    kappa: float
    tokens: int
    distinct: int
    texts: int
    false_rate: float
    base: float
    by_order: dict[int, tuple[np.ndarray, np.ndarray]]  # sorted keys with the words' exact counts, the levels of other n-grams

    def counts(self, keys: np.ndarray, order: int) -> np.ndarray:
        some, q = self.by_order[order]
        return lower_edges(int(q.max(initial=0)), self.base)[q[np.searchsorted(some, keys)]]

    def exact(self, hashes: np.ndarray) -> np.ndarray:
        """Counts of words; START, which is a context only, has none."""
        some, n = self.by_order[1]
        at = np.minimum(np.searchsorted(some, hashes), len(some) - 1)
        return np.where(some[at] == hashes, n[at], 0).astype(np.int64)


class Scorer:
    def __init__(self, model: Model | Answers):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.words = Vocabulary()
        self.exact = np.zeros(0, np.int64)
        self.about = np.zeros(0)

    def batch(self, texts: list[str | None]) -> list[tuple]:
        """(tokens, known, base, score) of each text."""
        if len(self.words) > 250_000:
            self.reset()
        ids, starts = sequences(texts, self.words)
        self.enter()
        return self.score(ids, starts)

    def enter(self) -> None:
        """Counts of the words that came since the last call."""
        m, new = self.model, self.words.grown()
        if len(new):
            exact = m.exact(new)
            self.exact, self.about = np.concatenate([self.exact, exact]), np.concatenate([self.about, exact.astype(float)])
            self.exact[0], self.about[0] = 0, m.texts  # START

    def score(self, ids: np.ndarray, starts: np.ndarray) -> list[tuple]:
        m = self.model
        h = self.words.hashes[ids]
        first = np.zeros(len(ids), dtype=bool)
        first[starts] = True
        c = self.exact[ids]
        base = np.where(first, 0.0, np.log10(m.unigram(c)))
        p, context = m.unigram(self.about[ids]), self.about[ids]
        for k, (key, inside) in enumerate(keys_by_order(h, starts, m.order), 1):
            if k == 1:
                continue
            use = np.flatnonzero(inside & ~first)
            seen = context[use - 1]
            n = np.minimum(m.counts(key[use], k), seen)
            p[use] = (n + m.kappa * p[use]) / (seen + m.distinct * m.false_rate + m.kappa)
            context = np.zeros(len(ids))
            context[use] = n
        logp = np.where(first, 0.0, np.log10(p))
        tokens = np.diff(np.append(starts, len(ids))) - 1
        known = np.add.reduceat((c > 0) & ~first, starts, dtype=np.int64)
        return list(zip(tokens.tolist(), known.tolist(), np.add.reduceat(base, starts).tolist(), np.add.reduceat(logp, starts).tolist(), strict=True))


def score_piece(piece: list[str | None], order: int, answers: dict[int, np.ndarray], sums: dict) -> list[tuple]:
    """What Scorer.batch() gives, from the answers to the sorted keys of all distinct n-grams of the texts."""
    words = Vocabulary()
    ids, starts = sequences(piece, words)
    hashes = words.grown()
    by_order = {1: np.unique(hashes[1:])}
    for k, (key, inside) in enumerate(keys_by_order(hashes[ids], starts, order)[1:], 2):
        by_order[k] = np.unique(key[inside])
    answers = {k: answers.get(k, np.zeros(0, np.uint8)) for k in by_order}
    for k, keys in by_order.items():
        if len(keys) != len(answers[k]):
            raise RuntimeError(f"{len(answers[k])} answers for {len(keys)} n-grams of order {k}")
    scorer = Scorer(Answers(order, by_order={k: (keys, answers[k]) for k, keys in by_order.items()}, **sums))
    scorer.words, words.fresh = words, hashes.tolist()
    words.hashes = hashes[:0]
    scorer.enter()
    out, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + STEP_TOKENS)))
        end = starts[j] if j < len(starts) else len(ids)
        out += scorer.score(ids[starts[i] : end], starts[i:j] - starts[i])
        i = j
    return out


def count_piece(texts: list[str | None], train: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: the sorted keys of all distinct n-grams, and how often each is in the training texts."""
    words = Vocabulary()
    ids, starts = sequences(texts, words)
    words.grown()
    learn = np.repeat(train, np.diff(np.append(starts, len(ids))))
    keys, at = np.unique(words.hashes[1:], return_inverse=True)  # START is a context, not a token
    n = np.bincount(ids[learn], minlength=len(words))[1:]
    out = [(keys, np.bincount(at, n, minlength=len(keys)).astype(np.uint32))]
    for key, inside in keys_by_order(words.hashes[ids], starts, order)[1:]:
        learned, times = np.unique(key[inside & learn], return_counts=True)
        keys = np.union1d(learned, key[inside & ~learn])
        n = np.zeros(len(keys), np.uint32)
        n[np.searchsorted(keys, learned)] = times
        out.append((keys, n))
    return out


def count_ngrams(rows: DataFrame, order: int, ranges: int) -> DataFrame:
    """rows (block, rid, train, text) -> (block, first, last, range, ord, keys, counts): sorted keys and their counts, as bytes.

    first and last are the rids of a piece: rows of one block that lie together.
    """
    shift = 64 - int(math.log2(ranges))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, bool, str | None]] = []
        block, size = -1, 0

        def flush() -> Iterator[pd.DataFrame]:
            if not held:
                return
            rids, train, texts = zip(*held)
            held.clear()
            for k, (keys, n) in enumerate(count_piece(list(texts), np.array(train, dtype=bool), order), 1):
                of = range_of(keys, shift)
                edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
                for i in range(0, len(edges) - 1, 64):
                    spans = list(zip(edges[i : i + 64], edges[i + 1 : i + 65]))
                    yield pd.DataFrame({
                        "block": block, "first": rids[0], "last": rids[-1], "range": [int(of[a]) for a, _ in spans], "ord": k,
                        "keys": [keys[a:z].tobytes() for a, z in spans], "counts": [n[a:z].tobytes() for a, z in spans],
                    })

        for f in frames:
            for b, rid, train, text in zip(f["block"].tolist(), f["rid"].tolist(), f["train"].tolist(), f["text"], strict=True):
                if b != block or size >= PIECE_BYTES:
                    yield from flush()
                    block, size = b, 0
                held.append((rid, train, text))
                size += len(text or "")
        yield from flush()

    return rows.select("block", "rid", "train", "text").mapInPandas(count, "block long, first long, last long, range int, ord int, keys binary, counts binary")


@dataclass
class Range:
    """A hash range: for each order its distinct keys, their counts and the place of each piece's keys among them."""

    by_order: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    segment: bytes
    false_rate: float

    @classmethod
    def of(cls, part: pd.DataFrame, order: int, base: float) -> Range:
        by_order = [_merge(part[part["ord"] == k]) for k in range(1, order + 1)]
        keys, counts = (np.concatenate(x) for x in zip(*[(k[n > 0], n[n > 0]) for k, n, _ in by_order], strict=True))
        raw, _, false_rate = segment(keys, counts, None, base)
        return cls(by_order, raw, false_rate)

    def sums(self) -> tuple[int, int, int]:
        """Tokens, distinct words and texts."""
        keys, counts, _ = self.by_order[0]
        return int(counts.sum()), int((counts > 0).sum()), int(counts[keys == np.uint64(xxhash.xxh64_intdigest(END))].sum())


def _merge(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sums of their counts, and for each key of the rows, in order, its place among the distinct ones."""
    keys = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(b, np.uint64) for b in part["keys"]]])
    counts = np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(b, np.uint32) for b in part["counts"]]])
    if not len(keys):
        return keys, counts.astype(np.int64), np.zeros(0, np.int64)
    at = np.argsort(keys, kind="stable")
    keys, counts = keys[at], counts[at].astype(np.int64)
    new = np.append(True, keys[1:] != keys[:-1])
    place = np.empty(len(at), np.int64)
    place[at] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return keys[first], np.add.reduceat(counts, first), place


def _ranges(docs: DataFrame) -> int:
    """As many hash ranges as grow with the input's partitions, so that one range always fits one task."""
    return 1 << max(2, math.ceil(math.log2(max(1, docs.rdd.getNumPartitions()) * 4)))


def _blocks(rows: DataFrame) -> DataFrame:
    """rows with a number each, and that of its block; written, so both stay with the row."""
    x = materialise(rows.withColumn("rid", F.monotonically_increasing_id()), "lm-rows")
    return x.withColumn("block", F.shiftright("rid", BLOCK_BITS))


def train(docs: DataFrame, order: int = ORDER, kappa: float = KAPPA, base: float = LOG_BASE) -> tuple[Model, DataFrame]:
    """docs (text) -> the model in one piece, for a table whose model fits the driver, and its ranges."""
    ranges = _ranges(docs)

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        r = Range.of(part, order, base)
        keys, counts, _ = r.by_order[0]
        return pd.DataFrame({"range": part["range"].iloc[:1].to_numpy(), "words": [keys.tobytes()], "counts": [counts.tobytes()], "segment": [r.segment], "false_rate": [r.false_rate]})

    counted = count_ngrams(_blocks(docs.select("text", F.lit(True).alias("train"))), order, ranges)
    merged = materialise(counted.groupBy("range").applyInPandas(whole, "range int, words binary, counts binary, segment binary, false_rate double"), "lm-merged")
    bits, offsets = np.full(ranges, 64, np.uint64), np.zeros(ranges, np.int64)
    blobs, size, words, counts, rates = [bytes(8)], 8, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
    for r in merged.orderBy("range").toLocalIterator():
        bits[r["range"]], offsets[r["range"]] = 8 * len(r["segment"]), size
        blobs.append(bytes(r["segment"]))
        size += len(r["segment"])
        words.append(np.frombuffer(r["words"], np.uint64))
        counts.append(np.frombuffer(r["counts"], np.int64))
        rates.append(r["false_rate"])
    words, counts = np.concatenate(words), np.concatenate(counts)
    texts = int(counts[words == np.uint64(xxhash.xxh64_intdigest(END))].sum())
    return Model(order, kappa, 64 - int(math.log2(ranges)), bits, offsets, np.frombuffer(b"".join(blobs), np.uint8), words, counts, int(counts.sum()), len(words), texts, float(np.mean(rates)) if rates else 0.0, base), merged


ANSWERS = "block long, first long, last long, range int, ord int, answers binary, tokens long, distinct long, texts long, false_rate double"


def answer(counted: DataFrame, order: int, base: float) -> DataFrame:
    """What count_ngrams() gives -> its rows with answers in place of keys, and a row without block for each range's sums.

    Words are answered with exact counts, longer n-grams with the levels that probes of the range's segment find.
    """

    def ask(part: pd.DataFrame) -> pd.DataFrame:
        r = Range.of(part, order, base)
        bits, flags = np.array([8 * len(r.segment)], np.uint64), np.frombuffer(r.segment, np.uint8)
        out = [pd.DataFrame([[-1, 0, 0, int(part["range"].iloc[0]), 0, b"", *r.sums(), r.false_rate]], columns=[c.split()[0] for c in ANSWERS.split(", ")])]
        for k, (keys, counts, place) in enumerate(r.by_order, 1):
            rows = part.loc[part["ord"] == k, ["block", "first", "last", "range", "ord"]]
            found = counts.astype(np.uint32) if k == 1 else probe(keys, np.zeros(len(keys), np.int64), bits, np.zeros(1, np.int64), flags).astype(np.uint8)
            ends = np.cumsum([len(b) // 8 for b in part.loc[part["ord"] == k, "keys"]], dtype=np.int64)
            pieces = [found[place[a:z]].tobytes() for a, z in zip([0, *ends[:-1]], ends)]
            out.append(rows.assign(answers=pieces, tokens=0, distinct=0, texts=0, false_rate=0.0))
        return pd.concat(out, ignore_index=True)

    return counted.groupBy("range").applyInPandas(ask, ANSWERS)


def score_documents(docs: DataFrame, order: int = ORDER, kappa: float = KAPPA, base: float = LOG_BASE, max_filter_bytes: int | None = None, max_hot_words: int | None = None) -> DataFrame:
    """documents -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs.

    Learns from rows outside the held-out fold; a null id is never held out. Null and empty texts have one token, the end.
    Words are compared by a 64-bit hash. Repeated rows keep a row each. An empty table gives an empty result. Other columns
    are ignored. The last two options bounded the model once; they are accepted, and nothing is bounded.
    """
    source = columns_like(docs, {"doc_id": "long", "text": "string"})
    held = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    rows = _blocks(source.select(F.col("doc_id").cast("string"), held.alias("held_out"), "text"))
    counted = count_ngrams(rows.withColumn("train", ~F.col("held_out")), order, _ranges(source))
    answers = materialise(answer(counted, order, base), "lm-answers")
    sums = answers.filter("block < 0").agg(F.sum("tokens"), F.sum("distinct"), F.sum("texts"), F.avg("false_rate")).first()
    tokens, distinct, texts, false_rate = int(sums[0] or 0), int(sums[1] or 0), int(sums[2] or 0), float(sums[3] or 0)

    sums = {"kappa": kappa, "tokens": tokens, "distinct": distinct, "texts": texts, "false_rate": false_rate, "base": base}

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("rid"), right.sort_values(["first", "ord", "range"])
        out = []
        for (first, last), piece in right.groupby(["first", "last"]):
            by_order = {k: np.frombuffer(b"".join(x["answers"]), np.uint32 if k == 1 else np.uint8) for k, x in piece.groupby("ord")}
            g = left[(left["rid"] >= first) & (left["rid"] <= last)]
            got = score_piece(list(g["text"]), order, by_order, sums)
            out.append(pd.DataFrame({"doc_id": g["doc_id"].to_numpy(), "held_out": g["held_out"].to_numpy(), "n_tokens": [x[0] for x in got], "n_known": [x[1] for x in got], "base_score": [x[2] for x in got], "score": [x[3] for x in got]}))
        return pd.concat(out, ignore_index=True)

    asked = answers.filter("block >= 0").select("block", "first", "last", "range", "ord", "answers")
    tasks = min(MOST_TASKS, source.rdd.getNumPartitions() + (texts * FOLDS // (FOLDS - 1) >> BLOCK_BITS))
    dealt = lambda x: x.repartition(max(1, tasks), "block").groupBy("block")
    table = dealt(rows).cogroup(dealt(asked)).applyInPandas(score, "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return table.select(F.col("doc_id").cast("long"), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
