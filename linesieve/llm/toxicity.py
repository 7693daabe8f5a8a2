"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts count as labelled; all other text is unlabelled, toxic texts among it. With the class prior p,
the risk of calling the unlabelled negative, less p times the risk of calling the positives negative, estimates the risk
on negatives; where a batch makes that estimate negative it counts as zero and has no gradient, so the classifier cannot
fit the toxic texts hidden among the unlabelled. The model is linear, in numpy, in the words of a text and in its families
of words: how many different words begin with the same characters. Families are what rare forms of a word share.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesieve.llm.common import columns_like, materialise, remainder, utf8

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Bounds of the training sample, the documented parameters of the fit: rows with the least hash of their id are taken.
MAX_POSITIVE, MAX_UNLABELLED = 12_000, 36_000
HASH_BITS = 24
FEATURES = 4096
#: Lengths of the beginnings, in characters, that make a family, and the numbers of its words that are told apart.
BEGINNINGS, STEPS = (4, 5, 6, 7), (1, 2, 3, 4, 6)
#: Weight of the squared weights in the risk, which keeps features that tell little small.
DECAY = 1e-3
#: Least log-likelihood ratio of a feature that is used.
MIN_GAIN = 8.0
_EDGE = re.compile(rb"^[^0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+$")
_MASK = (1 << HASH_BITS) - 1


def family_slot(family: int, step: int) -> int:
    return zlib.crc32(bytes([step]), family) & _MASK


def word_features(word: bytes, known: dict[int, float] | None = None) -> tuple[int, tuple[int, ...]] | None:
    """The word's slot and its families; of those in known only, if it is given, and None if there are none."""
    word = _EDGE.sub(b"", word)
    slot, u = zlib.crc32(word) & _MASK, word.decode("utf-8", "replace")
    families = tuple(zlib.crc32(f"^{n} {u[:n]}".encode()) for n in BEGINNINGS if len(u) > n)
    if known is not None:
        families = tuple(f for f in families if any(family_slot(f, k) in known for k in STEPS))
        if slot not in known and not families:
            return None
    return slot, families


def word_slots(text: str | None, cache: dict, known: dict[int, float] | None = None) -> set[int]:
    """Hash slots of the distinct words, lower-cased in A-Z, without marks at their ends, and of their families' sizes."""
    out, forms = set(), {}
    for w in set(utf8(text).lower().split()):
        x = cache.get(w, False)
        if x is False:
            if len(cache) > 500_000:
                cache.clear()
            x = cache[w] = word_features(w, known)
        if x:
            out.add(x[0])
            for f in x[1]:
                forms.setdefault(f, set()).add(x[0])
    for f, of in forms.items():
        out.update(family_slot(f, k) for k in STEPS if len(of) >= k)
    return out


@dataclass
class Model:
    slots: np.ndarray  # feature -> hash slot
    weights: np.ndarray
    bias: float

    def table(self) -> dict[int, float]:
        return dict(zip(self.slots.tolist(), self.weights.tolist(), strict=True))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def nnpu(x_p: list[np.ndarray], x_u: list[np.ndarray], features: int, prior: float, epochs: int = 250, rate: float = 0.1, decay: float = 1e-5, beta: float = 0.0, seed: int = 3) -> tuple[np.ndarray, float]:
    """Logistic loss, Adam, sparse 0/1 rows given as arrays of feature numbers -> weights, bias."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(features), math.log(prior / (1 - prior))
    m, v, step = np.zeros(features + 1), np.zeros(features + 1), 0
    size = 16_384
    batches = max(1, math.ceil(len(x_u) / size))

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows) if rows else np.zeros(0, int)

    for _ in range(epochs):
        p_at, u_at = rng.permutation(len(x_p)), rng.permutation(len(x_u))
        for k in range(batches):
            ps = [x_p[i] for i in np.take(p_at, range(k * size // 2, (k + 1) * size // 2), mode="wrap")]
            us = [x_u[i] for i in u_at[k * size : (k + 1) * size]]
            (pr, pc), (ur, uc) = flat(ps), flat(us)
            gp = np.bincount(pr, w[pc], minlength=len(ps)) + b
            gu = np.bincount(ur, w[uc], minlength=len(us)) + b
            soft = lambda z: np.logaddexp(0, z)
            negative = soft(gu).mean() - prior * soft(gp).mean()
            # Derivatives of the losses by the scores.
            d_pos = -prior * sigmoid(-gp) / len(ps)
            d_pn, d_un = -prior * sigmoid(gp) / len(ps), sigmoid(gu) / len(us)
            if negative < -beta:
                dp, du = d_pos, np.zeros(len(us))
            else:
                dp, du = d_pos + d_pn, d_un
            g = np.bincount(pc, dp[pr], minlength=features) + np.bincount(uc, du[ur], minlength=features) + decay * w
            g = np.append(g, dp.sum() + du.sum())
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Learns from ids outside the held-out fold. The class prior is the share of label 1 among the labelled ids there.

    Two passes over a bounded sample: document frequencies by hash slot pick the features that tell most, then each sampled
    text becomes the numbers of those features. An id with several labels counts by their mean, one with several rows by the
    least of their texts. Without any toxic example
    there is nothing to learn, and every text scores the bias, a half percent.
    """
    base = columns_like(docs, {"doc_id": "long", "text": "string"}).filter(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
    y = columns_like(labels, {"doc_id": "long", label: "double"}).filter(f"doc_id IS NOT NULL AND {label} IS NOT NULL")
    y = y.filter(remainder(F.col("doc_id"), FOLDS) != HELD_OUT).groupBy("doc_id").agg(F.avg(label).alias("y"))
    n, ones = y.agg(F.count("*"), F.sum((F.col("y") > 0.5).cast("long"))).first()
    if not ones:
        return Model(np.zeros(0, int), np.zeros(0), math.log(0.005 / 0.995))
    prior = min(0.5, max(0.002, ones / n))
    order = F.xxhash64("doc_id", F.lit(11))
    pos = y.filter("y > 0.5").orderBy(order, "doc_id").limit(MAX_POSITIVE).select("doc_id", F.lit(1).alias("p"))
    unl = base.select("doc_id").distinct().orderBy(order, "doc_id").limit(MAX_UNLABELLED).select("doc_id", F.lit(0).alias("p"))
    # Bounded by the two limits, so it may be broadcast.
    wanted = materialise(pos.unionByName(unl).groupBy("doc_id").agg(F.max("p").alias("pos"), F.min("p").alias("unl")), "pu-ids")

    def slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for f in frames:
            yield pd.DataFrame({"pos": f["pos"], "unl": f["unl"], "slots": [np.fromiter(word_slots(t, cache), np.int32) for t in f["text"]]})

    # One text for each id, the least, so that the sample has no more rows than wanted.
    texts = base.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.first("pos").alias("pos"), F.first("unl").alias("unl"), F.min("text").alias("text"))
    sample = materialise(texts.select("pos", "unl", "text").mapInPandas(slots, "pos int, unl int, slots array<int>"), "pu-sample")
    # A text in both groups counts in both: pos 1 says confirmed, unl 0 says drawn as unlabelled.
    freq = sample.select("pos", (F.col("unl") == 0).cast("int").alias("u"), F.explode("slots").alias("slot")).groupBy("slot").agg(F.sum("pos").alias("p"), F.sum("u").alias("u"))
    n_p, n_u = sample.agg(F.sum("pos"), F.sum((F.col("unl") == 0).cast("int"))).first()
    # By likelihood ratio of a feature's share in confirmed texts against the one in all. Among so many, most with a small
    # ratio merely look more frequent there by chance: MIN_GAIN leaves out those, and the decay keeps the weak ones small.
    top = []
    if n_p and n_u:
        p, u, np_, nu_ = F.col("p"), F.col("u"), F.lit(float(n_p)), F.lit(float(n_u))
        share = (p + u) / (np_ + nu_)
        part = lambda x, n: F.when(x > 0, x * F.log(x / (n * share))).otherwise(0.0) + F.when(x < n, (n - x) * F.log((n - x) / (n * (1 - share)))).otherwise(0.0)
        gain = 2 * (part(p, np_) + part(u, nu_))
        chosen = freq.filter(p / np_ > u / nu_).select("slot", gain.alias("gain")).filter(F.col("gain") > MIN_GAIN)
        top = [r["slot"] for r in chosen.orderBy(F.desc("gain"), "slot").limit(FEATURES).collect()]
    if not n_u or not top:
        return Model(np.zeros(0, int), np.zeros(0), math.log(prior / (1 - prior)))
    names = np.array(sorted(top))

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for x in f["slots"]:
                x = np.sort(np.asarray(x))
                at = np.minimum(np.searchsorted(names, x), len(names) - 1)
                rows.append(at[names[at] == x].astype(np.int32))
            yield pd.DataFrame({"pos": f["pos"], "unl": f["unl"], "features": rows})

    x_p, x_u = [], []
    for r in sample.mapInPandas(number, "pos int, unl int, features array<int>").toLocalIterator():
        x = np.array(r["features"], dtype=np.int64)
        if r["pos"]:
            x_p.append(x)
        if r["unl"] == 0:
            x_u.append(x)
    if not x_p:
        return Model(np.zeros(0, int), np.zeros(0), math.log(prior / (1 - prior)))
    w, b = nnpu(x_p, x_u, len(names), prior, decay=DECAY)
    return Model(names, w, b)


def scorer(model: Model):
    """A function from a text column to the probability that the text is toxic."""
    table, bias = model.table(), model.bias

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict = {}
        for s in texts:
            out = np.empty(len(s))
            for i, t in enumerate(s):
                out[i] = bias + sum(table[k] for k in sorted(word_slots(t, cache, table)) if k in table)
            yield pd.Series(sigmoid(out))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """documents, labels -> (doc_id, held_out, score, predicted), one row per row of docs.

    Null and empty texts score the bias. A null id is never held out and never learned from. Repeated rows get equal
    scores; an empty table gives an empty result. Other columns are ignored.
    """
    model = fit(docs, labels, label)
    base = columns_like(docs, {"doc_id": "long", "text": "string"})
    held = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    out = base.select("doc_id", held.alias("held_out"), scorer(model)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
