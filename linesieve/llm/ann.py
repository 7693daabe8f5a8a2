"""Nearest neighbours over learned partitions.

A bounded sample's neighbour graph is cut into balanced parts with few edges between them; a small network then learns
from the sample to tell a vector's part, so parts follow neighbourhoods, not cells around centres. Where the table is too
large for as many parts as one network tells apart, the vectors of each part are divided in the same way, by a network of
its own that a task fits to a bounded sample of them: the number of leaves grows with the table. All vectors are filed
under their most probable leaf. A query is sent to its most probable leaves, as many as the sample needed for the wanted
recall, and its candidates there are reranked by exact distance.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linesieve.llm.common import columns_like, materialise

#: Bounds of the samples that the index learns from, its documented parameters: of the table, and of each part of it.
SAMPLE, PART_SAMPLE, GRAPH_K = 16_000, 4_096, 12
#: Vectors of a leaf, wanted; parts that one network tells apart, at most. A table of up to PART_ROWS vectors is one leaf.
PART_ROWS, MAX_PARTS = 200, 256
#: Share of the true neighbours in the sample that the probes of held-out vectors of the sample reach.
RECALL = 0.93
#: Vectors in one task's block, and rows of queries against it.
BLOCK, QUERY_BLOCK = 4096, 16_384


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v): rows with an id whose vector is not null, empty or zero, and whose components are finite doubles.

    Vectors of another length than most have (the shorter length, on a tie) cannot be compared and take no part.
    """
    x = columns_like(rows, {"vec_id": "long", "embedding": "array<double>"}).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    x = x.filter(F.forall("embedding", good) & F.exists("embedding", lambda c: c != 0)).select("vec_id", F.col("embedding").alias("v"))
    lengths = x.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return x.filter(F.size("v") == (lengths["n"] if lengths else 0))


def neighbours(x: np.ndarray, q: np.ndarray, k: int, skip_self: bool = False) -> np.ndarray:
    """Places in x of the k nearest to each row of q, in blocks."""
    k = min(k, len(x) - skip_self)
    out = np.zeros((len(q), max(k, 0)), dtype=np.int64)
    norms = (x**2).sum(1)
    for a in range(0, len(q), 1024):
        d = norms - 2 * (q[a : a + 1024] @ x.T)
        if skip_self:
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        if k > 0:
            at = np.argpartition(d, k - 1, axis=1)[:, :k]
            out[a : a + 1024] = np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, 1), axis=1, kind="stable"), 1)
    return out


def balanced_parts(graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1, seed: int = 5) -> np.ndarray:
    """graph (n, k): neighbours -> part of each node; parts differ little in size and cut few edges.

    Parts are grown breadth-first from spread seeds up to their size, then nodes move to the part of most of their
    neighbours while the sizes allow it.
    """
    n = len(graph)
    if parts <= 1 or n <= parts:
        return np.arange(n) % max(parts, 1)
    rng = np.random.default_rng(seed)
    target = int(np.ceil(n / parts))
    back: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(graph):
        for j in row:
            back[j].append(i)
    part = np.full(n, -1)
    order = rng.permutation(n)
    at = 0
    frontier: list[int] = []
    for p in range(parts):
        size = 0
        queue = [x for x in frontier if part[x] < 0][:1]
        while size < target:
            if not queue:
                while at < n and part[order[at]] >= 0:
                    at += 1
                if at == n:
                    break
                queue = [int(order[at])]
            nxt = []
            for i in queue:
                if part[i] < 0 and size < target:
                    part[i] = p
                    size += 1
                    nxt += [int(j) for j in graph[i] if part[j] < 0]
                    nxt += [j for j in back[i][:16] if part[j] < 0]
            queue = nxt
        frontier = queue
    most = int(target * slack) + 1
    sizes = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n).tolist():
            near = np.bincount(part[np.append(graph[i], back[i][:16]).astype(np.int64)], minlength=parts)
            here = part[i]
            near_ok = np.where(sizes < most, near, -1)
            near_ok[here] = near[here]
            best = int(near_ok.argmax())
            if near_ok[best] > near[here] and sizes[here] > target // 2:
                sizes[here] -= 1
                sizes[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


@dataclass
class Router:
    """One hidden layer; log-probabilities of the parts. Weights are in single precision, for a small broadcast."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logs(self, x: np.ndarray) -> np.ndarray:
        z = (np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2).astype(np.float64)
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    @classmethod
    def single(cls, d: int) -> Router:
        return cls(*(np.zeros(s, np.float32) + o for s, o in ((d, 0), (d, 1), ((d, 1), 0), (1, 0), ((1, 1), 0), (1, 0))))


@dataclass
class Tree:
    """A router for the whole table and, where there are more leaves than it has parts, one for each part."""

    top: Router
    below: list[Router] = field(default_factory=list)
    probes: int = 1

    @property
    def leaves(self) -> int:
        return sum(r.parts for r in self.below) if self.below else self.top.parts

    def logs(self, x: np.ndarray) -> np.ndarray:
        top = self.top.logs(x)
        return np.hstack([top[:, [i]] + r.logs(x) for i, r in enumerate(self.below)]) if self.below else top

    def _parts(self, x: np.ndarray, step: int = 256):
        return (self.logs(x[a : a + step]) for a in range(0, len(x), step))

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the most probable part, and in it the most probable one below."""
        part = self.top.logs(x).argmax(1)
        if not self.below:
            return part.astype(np.int32)
        out, first = np.zeros(len(x), np.int32), np.cumsum([0, *[r.parts for r in self.below]])
        for p in np.unique(part):
            at = part == p
            out[at] = first[p] + self.below[p].logs(x[at]).argmax(1)
        return out

    def ask(self, x: np.ndarray) -> list[np.ndarray]:
        """The leaves to be searched for each vector, the most probable first."""
        return [row for z in self._parts(x) for row in np.argsort(-z, axis=1, kind="stable")[:, : self.probes].astype(np.int32)]

    def tune(self, base: np.ndarray, test: np.ndarray, recall: float, k: int = 10) -> None:
        """As many probes as reach that share of the test vectors' nearest among the base."""
        filed, near = self.file(base), neighbours(base, test, k)
        need = []
        for a, z in zip(range(0, len(test), 256), self._parts(test)):
            ranks = np.argsort(np.argsort(-z, axis=1, kind="stable"), axis=1, kind="stable")
            need.append(np.take_along_axis(ranks, filed[near[a : a + 256]], 1).ravel())
        need = np.sort(np.concatenate(need)) if need else np.zeros(1, int)
        self.probes = int(min(self.leaves, need[min(len(need) - 1, int(np.ceil(recall * len(need))))] + 1))


def train_router(x: np.ndarray, soft: np.ndarray, hidden: int = 128, epochs: int = 30, rate: float = 2e-3, seed: int = 9) -> Router:
    """x (n, d), soft (n, parts): shares of the parts among a vector's own and its neighbours' -> a network, by Adam."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    parts = soft.shape[1]
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for e in range(epochs):
        step = rate * (1 - e / epochs) + 1e-5
        order = rng.permutation(n)
        for a in range(0, n, 256):
            b = order[a : a + 256]
            h = np.maximum(z[b] @ p[0] + p[1], 0)
            o = h @ p[2] + p[3]
            o = np.exp(o - o.max(1, keepdims=True))
            g = (o / o.sum(1, keepdims=True) - soft[b]) / len(b)
            gh = (g @ p[2].T) * (h > 0)
            t += 1
            for k, grad in enumerate((z[b].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                p[k] -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Router(*(np.asarray(a, np.float32) for a in (mean, scale, *p)))


def learn(base: np.ndarray, parts: int, k: int = GRAPH_K, seed: int = 5) -> Router:
    """base (n, d) -> a router to so many parts; to a single one if there are too few vectors to tell them apart."""
    n, d = base.shape if base.ndim == 2 else (0, 1)
    parts = min(parts, n // 16)
    if parts <= 1:
        return Router.single(d)
    graph = neighbours(base, base, k, skip_self=True)
    part = balanced_parts(graph, parts, seed=seed)
    soft = np.zeros((n, parts))
    for col in range(graph.shape[1]):
        np.add.at(soft, (np.arange(n), part[graph[:, col]]), 0.5 / graph.shape[1])
    soft[np.arange(n), part] += 0.5
    return train_router(base, soft)


def build(x: DataFrame, n: int, sample: int = SAMPLE, part_sample: int = PART_SAMPLE, part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS, recall: float = RECALL) -> Tree:
    """x (vec_id, v), n rows -> the index. The sample has the rows with the least hash of their id; a fifth of it is kept
    from the training and tells how many leaves to probe. The tree is at most max_parts + 1 networks."""
    spark = x.sparkSession
    h = F.xxhash64("vec_id", F.lit(5))
    drawn = x.select("v", h.alias("h")).orderBy("h", "v").limit(sample)
    flat = [np.array(r["v"]) for r in drawn.toLocalIterator()]
    whole = np.stack(flat) if flat else np.zeros((0, 1))
    test, base = whole[::5], whole[np.arange(len(whole)) % 5 != 0]
    parts = int(min(max_parts, max(1, round(n / part_rows))))
    tree = Tree(learn(base, parts))
    more = int(min(max_parts, round(n / (tree.top.parts * part_rows))))
    if tree.top.parts == max_parts and more > 1:
        top = spark.sparkContext.broadcast(tree.top)

        @F.pandas_udf("int")
        def part_of(v: pd.Series) -> pd.Series:
            return pd.Series(top.value.logs(np.stack(v.to_numpy())).argmax(1).astype(np.int32) if len(v) else np.zeros(0, np.int32))

        def fit(rows: pd.DataFrame) -> pd.DataFrame:
            own = np.stack(rows.sort_values("h")["v"].to_numpy())
            return pd.DataFrame({"part": rows["part"].iloc[:1], "router": [pickle.dumps(learn(own, more))]})

        # Rows of a part by hash, so many on average: no part is ordered or held whole.
        placed = materialise(x.select("v", part_of("v").alias("part"), F.pmod(F.xxhash64("vec_id", F.lit(6)), F.lit(1 << 30)).alias("h")), "ann-parts")
        share = placed.groupBy("part").agg(F.least(F.lit(1.0), F.lit(float(part_sample)) / F.count("*")).alias("share"))
        some = placed.join(F.broadcast(share), "part").filter(F.col("h") < F.col("share") * (1 << 30)).select("part", "h", "v")
        fitted = {r["part"]: pickle.loads(bytes(r["router"])) for r in some.groupBy("part").applyInPandas(fit, "part int, router binary").toLocalIterator()}
        tree.below = [fitted.get(p) or Router.single(base.shape[1]) for p in range(tree.top.parts)]
    if len(test) and len(base):
        tree.tune(base, test, recall)
    return tree


def search(rows: DataFrame, every: int = 100, k: int = 10, **options) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by every.

    Nearness is the Euclidean distance in double precision on the vectors as they are; ties go to the smaller vec_id, and a
    query is no candidate of itself. Rows that usable() drops neither ask nor answer. Rows that repeat an id are
    candidates each; several queries with one id are one (the least vector). Leaves are searched some at a time, and large
    ones, such as many copies of a vector, in blocks. Options are those of build(). An empty table gives an empty result;
    other columns are ignored.
    """
    spark = rows.sparkSession
    x = materialise(usable(rows), "ann-vectors")
    n = x.count()
    tree = build(x, n, **options)
    shared = spark.sparkContext.broadcast(tree)

    @F.pandas_udf("int")
    def file_under(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.file(np.stack(v.to_numpy())) if len(v) else np.zeros(0, np.int32))

    @F.pandas_udf("array<int>")
    def ask(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.ask(np.stack(v.to_numpy())) if len(v) else [], dtype=object)

    # Leaves go to tasks in groups of about a block of vectors, so a query has one list of candidates for each group.
    groups = max(1, min(tree.leaves, -(-n // BLOCK)))
    group = F.pmod(F.col("leaf"), F.lit(groups)).cast("int").alias("g")
    filed = materialise(x.select("vec_id", "v", file_under("v").alias("leaf")).select("*", group), "ann-filed")
    queries = filed.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = materialise(queries.select("vec_id", "v", F.explode(ask("v")).alias("leaf")).select("*", group).groupBy("g", "vec_id", "v").agg(F.sort_array(F.collect_list("leaf")).alias("leaves")), "ann-asked")
    # Counts by group, a row each, say into how many blocks a group's vectors and queries go.
    sizes = filed.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = sizes.join(asked.groupBy("g").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks")), "g")
    block = lambda name, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(name)).cast("int")
    every_of = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = filed.join(F.broadcast(sizes), "g").select("g", block("blocks", 1).alias("b"), every_of("query_blocks").alias("q"), "leaf", "vec_id", "v")
    right = asked.join(F.broadcast(sizes), "g").select("g", every_of("blocks").alias("b"), block("query_blocks", 2).alias("q"), "leaves", "vec_id", "v")

    def nearest(base: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(base) and len(qs):
            base = base.sort_values(["leaf", "vec_id"])
            leaf, ids, b = base["leaf"].to_numpy(), base["vec_id"].to_numpy(), np.stack(base["v"].to_numpy())
            norms = (b**2).sum(1)
            for qid, v, leaves in zip(qs["vec_id"].to_numpy(), qs["v"], qs["leaves"], strict=True):
                v = np.asarray(v)
                spans = zip(np.searchsorted(leaf, leaves).tolist(), np.searchsorted(leaf, leaves, "right").tolist(), strict=True)
                at = np.concatenate([np.arange(a, z) for a, z in spans])
                at = at[ids[at] != qid]
                if not len(at):
                    continue
                rough = norms[at] - 2 * (b[at] @ v) + v @ v
                # Exact distances for all that rounding might bring among the nearest.
                last = min(k, len(at)) - 1
                at = at[rough <= np.partition(rough, last)[last] + 1e-9 * (norms[at] + v @ v + 1e-300)]
                d = np.sqrt(((b[at] - v) ** 2).sum(1))
                best = np.lexsort((ids[at], d))[:k]
                out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[at][best], "score": d[best]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    found = left.groupBy("g", "b", "q").cogroup(right.groupBy("g", "b", "q")).applyInPandas(nearest, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
