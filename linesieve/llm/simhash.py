"""SimHash near-duplicates, found by BK-trees over shards of the fingerprints.

Fingerprints within 3 bits of each other agree in one of four blocks of 16 bits at least. A shard is the set of distinct
fingerprints with one value in the low bits of one block: as many bits as leave 64 to 128 fingerprints to a tree on
average, and all 16 beyond four million. Each shard has BK-trees, whose children are keyed by the integer Hamming
distance to the parent, and a search follows only edges within the radius. Shards that are too large for one tree are
divided by a second block in the same way (the other 48 bits, in four blocks of 12), and if they still are, into several
trees by a hash; each tree then goes to all probes of its shard. Trees go to their own shard's probes rather than
to all workers: all trees together grow with the corpus, and a broadcast must not. A tree's task reports what it links as
a forest, so a group of copies costs as many rows as it has fingerprints, not pairs. Rows find the class of their
fingerprint, and fingerprints that of their root, by join_counted, which keeps heavy keys out of the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linesieve.llm.common import columns_like, join_counted, materialise, own_name, sorted_runs, utf8
from linesieve.llm.components import components

RADIUS = 3
SHINGLE = 3
#: Fingerprints in one tree at most.
TREE = 1024
#: Fingerprints that a tree should have on average, at least; up to twice as many.
MEAN = 64
SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: each is 1 if set in more than half of the XXH64 of the text's word shingles, repeats included.

    Words are lower-cased in A-Z only. Fewer words than a shingle give one shingle; a text without words gives 0.
    """
    words = utf8(text).lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: n - shingle]]]
    digest = xxhash.xxh64_intdigest
    ones, total = np.zeros(64, np.int64), n - shingle + 1
    for k in range(0, total, _CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + _CHUNK], ends[k + shingle - 1 : k + shingle - 1 + _CHUNK])], dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > total, bitorder="little")
    return int(bits.view(np.uint64)[0])


class BKTree:
    """Distinct fingerprints; a child hangs on the edge that is its distance to the parent."""

    def __init__(self, values: list[int]):
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []
        for v in values:
            self.add(v)

    def add(self, v: int) -> None:
        self.values.append(v)
        self.edges.append({})
        new, at = len(self.values) - 1, 0
        while at != new:
            d = (v ^ self.values[at]).bit_count()
            if d == 0:
                self.values.pop()
                self.edges.pop()
                return
            at = self.edges[at].setdefault(d, new)

    def search(self, v: int, radius: int) -> list[int]:
        """Places of all values within the radius."""
        found, stack = [], [0] if self.values else []
        values, edges = self.values, self.edges
        while stack:
            at = stack.pop()
            d = (v ^ values[at]).bit_count()
            if d <= radius:
                found.append(at)
            below = edges[at]
            if below:
                if len(below) > 2 * radius:
                    stack.extend(below[e] for e in range(d - radius, d + radius + 1) if e in below)
                else:
                    stack.extend(c for e, c in below.items() if -radius <= e - d <= radius)
        return found


def forest(tree_values: list[int], probes: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges that connect what is within the radius of each other, without a cycle."""
    tree = BKTree(tree_values)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = []
    for v in probes:
        for at in tree.search(v, radius):
            w = tree.values[at]
            if v != w:
                a, b = root(v), root(w)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((v, w))
    return out


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE):
    """A column of the signed 64-bit fingerprint."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return fp(F.col(f"`{text}`").cast("string"))


def _block_bits(n: int) -> int:
    """Bits of a block that deal n fingerprints to shards of MEAN or more each."""
    return min(16, max(0, (n // MEAN).bit_length() - 1))


def _keys(values: DataFrame, tree: int, bits: int = 16) -> DataFrame:
    """values (fp) -> (shard, part, fp, role): role 0 builds the tree, 1 probes it. part: the tree within the shard."""
    four = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), (F.shiftrightunsigned("fp", 16 * b).bitwiseAND((1 << bits) - 1)).alias("v")) for b in range(4)]))
    first = values.select("fp", four.alias("k")).select("fp", (F.col("k.b") * 65536 + F.col("k.v")).cast("long").alias("shard"))
    sizes = first.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    first = first.join(sizes, "shard")
    small = first.filter(F.col("n") <= tree).select("shard", "fp", F.lit(1).cast("long").alias("trees"))
    # The other 48 bits: the block of the shard is cut out. Three differing bits can't touch all four parts of them.
    b = F.expr("int(shard div 65536)")
    rest = F.when(b == 0, F.shiftrightunsigned("fp", 16))
    for i in range(1, 4):
        low = F.col("fp").bitwiseAND((1 << 16 * i) - 1)
        high = F.shiftleft(F.shiftrightunsigned("fp", 16 * i + 16), 16 * i) if i < 3 else F.lit(0).cast("long")
        rest = F.when(b == i, low.bitwiseOR(high)).otherwise(rest)
    large = first.filter(F.col("n") > tree).select("shard", "fp", rest.alias("rest"))
    sub = F.explode(F.array(*[F.shiftrightunsigned("rest", 12 * j).bitwiseAND(0xFFF) + 4096 * j for j in range(4)]))
    large = large.select("fp", "shard", sub.alias("s")).select("fp", ((F.col("shard") + 1) * (1 << 20) + F.col("s")).cast("long").alias("shard"))
    sizes2 = large.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    large = large.join(sizes2, "shard").select("shard", "fp", F.ceil(F.col("n") / tree).cast("long").alias("trees"))
    every = small.unionByName(large)
    build = every.select("shard", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("trees")).alias("part"), "fp", F.lit(0).alias("role"))
    probe = every.filter("trees > 1").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1)).alias("part"), "fp", F.lit(1).alias("role"))
    return build.unionByName(probe)


def links(values: DataFrame, radius: int = RADIUS, tree: int = TREE, bits: int | None = None) -> DataFrame:
    """values (fp: distinct longs) -> edges (a, b) that connect exactly what chains of links within the radius connect.
    bits: how many of each block's bits name a shard; counted from the table where not given."""
    if not 0 <= radius <= 3:
        raise ValueError("four blocks find up to three differing bits")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[int, int]] = []
        for fp, role in sorted_runs(frames, ["shard", "part"], ["fp", "role"]):
            all_fp = fp.astype(np.int64).view(np.uint64).tolist()
            if len(all_fp) == 2 and not role.any():
                if (all_fp[0] ^ all_fp[1]).bit_count() <= radius:
                    found.append((all_fp[0], all_fp[1]))
            else:
                built = [x for x, r in zip(all_fp, role.tolist(), strict=True) if r == 0]
                found += forest(built, [x for x, r in zip(all_fp, role.tolist(), strict=True) if r] or built, radius)
            if len(found) > 50_000:
                yield pd.DataFrame(np.array(found, dtype=np.uint64).view(np.int64), columns=["a", "b"])
                found = []
        if found:
            yield pd.DataFrame(np.array(found, dtype=np.uint64).view(np.int64), columns=["a", "b"])

    keys = _keys(values, tree, _block_bits(values.count()) if bits is None else bits)
    dealt = keys.repartition("shard", "part").sortWithinPartitions("shard", "part", "role")
    return dealt.mapInPandas(search, "a long, b long")


def classes(rows: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """rows (fp, id) -> (fp, component_id, n): the least id of all rows that links reach, and how many rows have the fp."""
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("id"), F.count("*").alias("n")), "fps")
    comp = components(links(nodes.select("fp"), radius, tree))
    x = materialise(nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", "id", "n", F.coalesce("component", "fp").alias("root")), "roots")
    least = x.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("size"))
    return join_counted(x, least, "root", "size").select("fp", "component_id", "n")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """documents -> (doc_id, fingerprint, component_id), one row per row of the input.

    Null and empty texts have fingerprint zero and are linked to each other like any others. component_id is null where all
    rows of a group have null ids. Rows that share an id keep a row each. Other columns are ignored; an empty table gives an
    empty result.
    """
    base = columns_like(docs, {"doc_id": "long", "text": "string"})
    rows = materialise(base.select("doc_id", fingerprints(base, "text", shingle).alias("fp")), "simhash")
    found = classes(rows.select("fp", F.col("doc_id").alias("id")), radius)
    out = join_counted(rows, found, "fp", "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs of which no other stands for their group: the least doc_id, nulls last, of each group stays, and
    of several rows with that id the first as the table is read. Columns are those of docs."""
    fp, rid = own_name(docs, "ls_fp"), own_name(docs, "ls_rid")
    table = materialise(docs.withColumn(fp, fingerprints(docs, "text", shingle)).withColumn(rid, F.monotonically_increasing_id()), "simhash-docs")
    # An id that orders as (doc_id, row): a struct, so that groups are compared without their texts.
    slim = table.select(F.col(fp).alias("fp"), F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(rid).alias("r")).alias("id"))
    found = classes(slim, radius)
    kept = found.select(F.col("component_id.r").alias("r")).distinct()
    return table.join(kept, F.col(rid) == F.col("r"), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
