"""Line search over a corpus. Results have path, line_no and line, in no order unless asked for.

Everything about one document happens within its row until lines are needed: counts, lists of files and context need no
shuffle of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesieve.functions import regex
from linesieve.operators.lines import line_array, strip_cr, trim_start
from linesieve.plans.planner import Matcher, buffer_is_lines, plan
from linesieve.sources.corpus import Corpus
from linesieve.spec import SearchSpec

#: Stands before a match in buffer mode; no text has these characters, which Unicode keeps for no one.
MARK = "\ufdd0\ufdd1\ufdd0"


def candidates(corpus: Corpus, spec: SearchSpec, matcher: Matcher | None = None) -> DataFrame:
    """Documents that may hold a wanted line, by path and by what a match needs."""
    docs = corpus.where(spec).docs.filter(F.length("text") > 0)
    need = None if spec.invert else (matcher or plan(spec)).document_condition(F.col("text"))
    return docs if need is None else docs.filter(need)


def line_structs(spec: SearchSpec, text: Column, matcher: Matcher | None = None) -> Column:
    """array of (n, line, hit): the lines of a text; hit is whether a line is wanted."""
    matcher = matcher or plan(spec)
    if spec.mode == "buffer" and not buffer_is_lines(spec):
        marked = F.slice(F.split(matcher.marked(text, MARK), "\n", -1), 1, F.size(line_array(text)))
        shape = lambda line, i: F.struct((i + 1).cast("int").alias("n"), F.replace(line, F.lit(MARK), F.lit("")).alias("line"), _sign(line.contains(MARK), spec).alias("hit"))
        # A match after the last line end is on no line.
        return F.transform(marked, shape)
    return F.transform(matcher.hits(text, line_array(text)), lambda x, i: F.struct((i + 1).cast("int").alias("n"), x["line"].alias("line"), _sign(x["hit"], spec).alias("hit")))


def _sign(hit: Column, spec: SearchSpec) -> Column:
    return ~hit if spec.invert else hit


def lines_of(docs: DataFrame, spec: SearchSpec, matcher: Matcher | None = None) -> DataFrame:
    """docs (doc_id, path, text) -> doc_id, path, line_no, line of the wanted lines."""
    matcher = matcher or plan(spec)
    if spec.mode == "buffer" and not buffer_is_lines(spec):
        hits = docs.select("doc_id", "path", F.explode(F.filter(line_structs(spec, F.col("text"), matcher), lambda x: x["hit"])).alias("x"))
        return hits.select("doc_id", "path", F.col("x.n").alias("line_no"), F.col("x.line").alias("line"))
    # Lines first, then one test over them in generated code.
    x = docs.select("doc_id", "path", F.posexplode(line_array(F.col("text"))).alias("at", "line"))
    return x.filter(_sign(matcher.matches(F.col("line")), spec)).select("doc_id", "path", (F.col("at") + 1).cast("int").alias("line_no"), "line")


def shown(line: Column, spec: SearchSpec) -> Column:
    line = strip_cr(line)
    return trim_start(line) if spec.trim else line


def search(corpus: Corpus, spec: SearchSpec) -> DataFrame:
    """path, line_no, line."""
    matcher = plan(spec)
    found = lines_of(candidates(corpus, spec, matcher), spec, matcher)
    return found.select("path", "line_no", shown(F.col("line"), spec).alias("line"))


def only_matching(corpus: Corpus, spec: SearchSpec) -> DataFrame:
    """path, line_no, match_idx, match: one row per non-overlapping match, in the line without its carriage return."""
    matcher = plan(spec)
    found = lines_of(candidates(corpus, spec, matcher), spec, matcher)
    parts = matcher.extracted(strip_cr(F.col("line")))
    out = found.select("path", "line_no", F.posexplode(parts).alias("match_idx", "match"))
    return out.withColumn("match", trim_start(F.col("match")) if spec.trim else F.col("match"))


def count_by_file(corpus: Corpus, spec: SearchSpec) -> DataFrame:
    """path, n: wanted lines of each document that has some. One row per document all the way."""
    matcher = plan(spec)
    n = F.size(F.filter(line_structs(spec, F.col("text"), matcher), lambda x: x["hit"])).cast("long")
    return candidates(corpus, spec, matcher).select("path", n.alias("n")).filter("n > 0")


def count_total(corpus: Corpus, spec: SearchSpec) -> DataFrame:
    """n: one row; counts are added up in the tasks that read the documents."""
    matcher = plan(spec)
    found = lines_of(candidates(corpus, spec, matcher), spec, matcher)
    return found.agg(F.count("*").cast("long").alias("n"))


def match_totals(corpus: Corpus, spec: SearchSpec) -> DataFrame:
    """lines, matches: lines with a match, and matches in them."""
    matcher = plan(spec)
    found = lines_of(candidates(corpus, spec, matcher), spec, matcher)
    each = F.size(matcher.extracted(strip_cr(F.col("line"))))
    return found.agg(F.count("*").cast("long").alias("lines"), F.coalesce(F.sum(each), F.lit(0)).cast("long").alias("matches"))


def files_with_matches(corpus: Corpus, spec: SearchSpec) -> DataFrame:
    """path: documents with a wanted line, each once."""
    matcher = plan(spec)
    any_line = F.exists(line_structs(spec, F.col("text"), matcher), lambda x: x["hit"])
    if spec.mode == "line" and not matcher.linear:
        any_line = F.exists(line_array(F.col("text")), lambda line: _sign(matcher.matches(line), spec))
    return candidates(corpus, spec, matcher).filter(any_line).select("path").distinct()


def exists(corpus: Corpus, spec: SearchSpec) -> DataFrame:
    """found: one row; the scan stops at the first task with a match."""
    matcher = plan(spec)
    hit = lines_of(candidates(corpus, spec, matcher), spec, matcher).limit(1)
    return hit.agg((F.count("*") > 0).alias("found"))


def any_match(corpus: Corpus, spec: SearchSpec) -> bool:
    return not lines_of(candidates(corpus, spec), spec).limit(1).isEmpty()


def density(corpus: Corpus, spec: SearchSpec) -> DataFrame:
    """line_hits, files, density: hits per document that has some, both after all filters."""
    found = count_by_file(corpus, spec)
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("line_hits"), F.count("*").alias("files")).withColumn("density", F.when(F.col("files") > 0, F.col("line_hits") / F.col("files")).otherwise(0.0))


def escape(text: str) -> str:
    return regex.escape(text)
