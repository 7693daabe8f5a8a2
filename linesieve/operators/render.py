"""Results as lines of output. Rows have path, ord, sub and out; ordered by them they are the output of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesieve.operators.context import with_context
from linesieve.operators.search import only_matching
from linesieve.plans.planner import Matcher, plan
from linesieve.sources.corpus import Corpus
from linesieve.spec import OutputFormat, SearchSpec

# Terminal codes for paths, line numbers and matches.
PATH, NUMBER, MATCH, RESET = "\x1b[1;35m", "\x1b[32m", "\x1b[1;31m", "\x1b[0m"
SEPARATOR = "--"


def relative(path: Column, root: str) -> Column:
    root = root.rstrip("/")
    cut = F.when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 2**31 - 1)).otherwise(path) if root else path
    return F.replace(cut, F.lit("\\"), F.lit("/"))


def highlight(line: Column, matcher: Matcher) -> Column:
    """Each match between colour codes; empty matches get none."""
    return F.regexp_replace(matcher.marked(line, MATCH, RESET), MATCH.replace("[", r"\[") + RESET.replace("[", r"\["), "")


def render(corpus: Corpus, spec: SearchSpec, format: OutputFormat | str = OutputFormat.GREP, color: bool = False, kinds: bool = False) -> DataFrame:
    """path, ord, sub, out. ord is the line number, 0 for a heading; sub orders what belongs to one line: a separator
    before it (-1), the line or its matches (from 0). kinds adds kind: match, context, or mark for headings and separators."""
    format = OutputFormat(format)
    heading = format is not OutputFormat.GREP
    matcher = plan(spec)
    if spec.substrings:
        hits = only_matching(corpus, spec).select("path", F.col("line_no").alias("ord"), F.col("match_idx").alias("sub"), F.lit("match").alias("kind"), F.col("match").alias("text"), F.lit(0).cast("long").alias("chunk"))
        text = F.when(F.lit(color), F.concat(F.lit(MATCH), "text", F.lit(RESET))).otherwise(F.col("text"))
    else:
        rows = with_context(corpus, spec)
        hits = rows.select("path", F.col("line_no").alias("ord"), F.lit(0).alias("sub"), "kind", F.col("line").alias("text"), "chunk")
        text = F.when((F.col("kind") == "match") & F.lit(color and not spec.invert), highlight(F.col("text"), matcher)).otherwise(F.col("text"))
    name = relative(F.col("path"), corpus.root) if format is OutputFormat.COMPACT else F.col("path")
    paint = lambda c, code: F.concat(F.lit(code), c, F.lit(RESET)) if color else c
    mark = F.when(F.col("kind") == "match", ":").otherwise("-")
    number = paint(F.col("ord").cast("string"), NUMBER)
    out = F.concat(number, mark, text) if heading else F.concat(paint(name, PATH), mark, number, mark, text)
    kind = lambda c: [c.alias("kind")] if kinds else []
    body = hits.select("path", "ord", "sub", out.alias("out"), *kind(F.col("kind")))
    opts = spec.effective_context
    if (opts.before or opts.after) and not spec.substrings:
        first = hits.filter("chunk > 0").groupBy("path", "chunk").agg(F.min("ord").alias("ord"))
        body = body.unionByName(first.select("path", "ord", F.lit(-1).alias("sub"), F.lit(SEPARATOR).alias("out"), *kind(F.lit("mark"))))
    if heading:
        heads = hits.select("path").distinct().select("path", F.lit(0).alias("ord"), F.lit(0).alias("sub"), paint(name, PATH).alias("out"), *kind(F.lit("mark")))
        body = body.unionByName(heads)
    return body


def ordered(rows: DataFrame) -> DataFrame:
    """The output in order of paths."""
    return rows.orderBy("path", "ord", "sub")
