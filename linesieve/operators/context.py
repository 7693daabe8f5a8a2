"""Lines around matches.

The wanted line numbers of a document are ranges around its matches, put together in the document's row; only the lines
that are shown become rows. Chunks are runs of neighbouring line numbers, numbered over the shown lines alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linesieve.operators.search import candidates, line_structs, shown
from linesieve.plans.planner import plan
from linesieve.sources.corpus import Corpus
from linesieve.spec import SearchSpec


def with_context(corpus: Corpus, spec: SearchSpec, chunks: bool = True) -> DataFrame:
    """path, line_no, line, kind (match or context) and, if wanted, chunk: from 0 in each document.

    A line that matches is a match, also inside another's context. A new chunk begins where a line number is left out;
    without context there are no chunks to tell apart, and chunk is 0.
    """
    matcher, opts = plan(spec), spec.effective_context
    docs = candidates(corpus, spec, matcher).select("path", line_structs(spec, F.col("text"), matcher).alias("ls"))
    docs = docs.withColumn("hits", F.transform(F.filter("ls", lambda x: x["hit"]), lambda x: x["n"])).filter(F.size("hits") > 0)
    if opts.before or opts.after:
        around = F.flatten(F.transform("hits", lambda n: F.sequence(F.greatest(n - opts.before, F.lit(1)), F.least(n + opts.after, F.size("ls")))))
        docs = docs.withColumn("hits", F.array_sort(F.array_distinct(around)))
    rows = docs.select("path", F.explode(F.transform("hits", lambda n: F.get("ls", n - 1))).alias("x"))
    rows = rows.select("path", F.col("x.n").alias("line_no"), shown(F.col("x.line"), spec).alias("line"), F.when(F.col("x.hit"), "match").otherwise("context").alias("kind"))
    if not chunks:
        return rows
    if not (opts.before or opts.after):
        return rows.withColumn("chunk", F.lit(0).cast("long"))
    order = Window.partitionBy("path").orderBy("line_no")
    gap = F.coalesce((F.col("line_no") - F.lag("line_no").over(order) > 1).cast("long"), F.lit(0))
    return rows.withColumn("gap", gap).withColumn("chunk", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("gap")
