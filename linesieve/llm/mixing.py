"""Mixing sources to target weights by hash-threshold histograms.

A source's documents carry a hash of 60 bits. How many words of a source lie below a hash is known from a histogram of
its words by hash bucket; the bucket in which the budget runs out is the only one that is divided further, 12 bits at a
time, until single hashes remain. The threshold found this way filters the documents; nothing is sorted. Thresholds are
nested: a larger budget has a larger threshold, so a smaller mix of the same rows is part of a larger one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linesieve.llm.common import columns_like, drop, materialise, own_name, words_of

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BITS, LEVEL_BITS = 60, 12


def hash60(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """60 bits of the MD5 of seed:doc_id:MD5 of the text (null: empty). Rows that repeat an id, or have none, are told apart by
    their texts; only rows that are equal in both share a hash and are taken together."""
    content = F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), content).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) -> with target: share of all words by weight; what a source's limit leaves over goes to the others.

    The sources come in order of code points, null last, and the weights repeat in that order. The end of the resharing is
    reached in one step: with sources in order of limit / weight, the water level is the first that lies below its source's.
    One row per source, so these windows see aggregated rows only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int"))
    x = sources.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * max_repeats)
    by_ratio = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    upto, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    x = x.withColumn("before", F.coalesce(F.sum("cap").over(upto), F.lit(0)))
    x = x.withColumn("open_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0)))
    x = x.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("before")) / F.col("open_w"))
    below = F.col("level") < F.col("cap") / F.col("w")
    x = x.withColumn("water", F.max(F.when(below, F.col("level"))).over(everything))
    target = F.when(below, F.col("water") * F.col("w")).otherwise(F.col("cap").cast("double"))
    return x.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (source, h, size), plan (source, source_size, target) -> plan with copies, threshold.

    A row is taken copies times, and once more if its hash is at most the threshold (-1: none is).
    """
    size = F.greatest(F.col("source_size"), F.lit(1))
    state = plan.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long"))
    state = state.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    state = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("open", F.col("rest") > 0).withColumn("threshold", F.lit(-1).cast("long"))
    state = materialise(state, "mix-state")
    for level in range(BITS // LEVEL_BITS):
        shift = BITS - LEVEL_BITS * (level + 1)
        last = shift == 0
        bucket = F.shiftright("h", shift)
        act = state.filter("open").select(F.col("source").alias("s"), "prefix", "rest")
        inside = rows.join(act, rows["source"].eqNullSafe(act["s"]) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")))
        histogram = inside.groupBy("s", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.count("*").alias("rows"))
        upto = F.sum("n").over(Window.partitionBy("s").orderBy("bucket"))
        edge = histogram.withColumn("upto", upto).filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
        edge = edge.select("s", "bucket", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("rest2"), F.col("n").alias("edge_n"), F.col("rows").alias("edge_rows"))
        joined = state.join(edge, state["source"].eqNullSafe(edge["s"]), "left")
        # The whole bucket is one step: it is taken if that brings the sum nearer to the target.
        single = F.lit(last) | (F.col("edge_rows") == 1)
        nearer = (F.col("edge_n") - F.col("rest2")) < F.col("rest2")
        found = F.col("open") & F.col("bucket").isNotNull()
        low = F.shiftleft(F.col("bucket"), shift)
        state2 = joined.select(
            "source", "source_size", "target", "copies",
            F.when(found, F.col("rest2")).otherwise(F.col("rest")).alias("rest"),
            F.when(found, F.col("bucket")).otherwise(F.col("prefix")).alias("prefix"),
            (found & ~single).alias("open"),
            F.when(found, F.when(single & nearer, low + F.lit((1 << shift) - 1)).otherwise(low - 1)).otherwise(F.when(F.col("open"), F.lit((1 << BITS) - 1)).otherwise(F.col("threshold"))).alias("threshold"),
        )
        new = materialise(state2, "mix-state")
        drop(state)
        state = new
        if state.filter("open").isEmpty():
            break
    return state.select("source", "source_size", "target", "copies", "threshold")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """documents -> (doc_id, source, size, source_size, target, copies, taken), one row per row of the input.

    Texts are read once, for their sizes. Null or empty texts have size 0 and null sources are a source of their own, the
    last. Rows that share an id and a text share their fate. An empty table gives an empty result. Other columns are ignored.
    """
    base = columns_like(docs, {"doc_id": "long", "source": "string", "text": "string"})
    rows = base.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), hash60(F.col("doc_id"), F.col("text"), seed).alias("h"))
    rows = materialise(rows, "mix-rows")
    plan = thresholds(rows, targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeats))
    plan = plan.withColumnRenamed("source", "s")
    x = rows.join(plan, rows["source"].eqNullSafe(plan["s"]), "left").drop("s")
    copies = F.col("copies") + F.when(F.col("h") <= F.col("threshold"), 1).otherwise(0)
    return x.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """The mixed documents themselves: each row as often as the plan takes it, with the input's columns.

    Documents without words have nothing to take or to lose: they stay once per copy of their source at least if the
    source is taken whole, as any other row.
    """
    n, h, s = own_name(docs, "mix_n"), own_name(docs, "mix_h"), own_name(docs, "mix_s")
    base = columns_like(docs, {"doc_id": "long", "source": "string", "text": "string"})
    rows = materialise(base.select("source", F.size(words_of(F.col("text"))).cast("long").alias("size"), hash60(F.col("doc_id"), F.col("text"), seed).alias("h")), "mix-rows")
    plan = thresholds(rows, targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeats))
    plan = plan.select(F.col("source").alias(s), F.col("copies").alias(n), F.col("threshold").alias(h))
    x = docs.join(plan, F.col("source").cast("string").eqNullSafe(F.col(s)))
    x = x.withColumn(n, F.col(n) + F.when(hash60(F.col("doc_id"), F.col("text"), seed) <= F.col(h), 1).otherwise(0)).filter(F.col(n) > 0)
    return x.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
