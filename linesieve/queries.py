"""The driver's queries: one per operator, over whole tables, with SQL for the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesieve.functions import paths
from linesieve.functions.casefold import fold_column
from linesieve.operators import context, incremental, render, search
from linesieve.operators import index as ix
from linesieve.operators.lines import explode_lines, strip_cr, with_offsets
from linesieve.plans.storage import scratch_path
from linesieve.sources.corpus import Corpus
from linesieve.spec import ContextOpts, OutputFormat, SearchSpec
from linesieve.streaming import maintain

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """documents as source/doc_id.lang."""
    docs = table(spark, sf_dir, "documents")
    return Corpus.from_table(docs, F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang"))


LINES = """d AS (SELECT doc_id, concat(source, '/', doc_id, '.', lang) AS path, text, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no, len(ls) AS n FROM d),
lines AS (SELECT doc_id, path, CAST(line_no AS INT) AS line_no, line FROM e WHERE NOT (line_no = n AND line = ''))"""


def add(name: str, sql: str | None = None, lines: bool = True):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {LINES}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}" if lines else sql
        return f

    return put


def plain(name: str, spec: SearchSpec, condition: str) -> None:
    """A search that gives path, line_no, line."""
    add(name, f"SELECT path, line_no, line FROM lines WHERE {condition}")(lambda spark, d: search.search(corpus(spark, d), spec))


REGEX = SearchSpec("(the|der)[a-z]+ [a-z]*tion")
REGEX_SQL = "regexp_matches(line, '(the|der)[a-z]+ [a-z]*tion')"

plain("literal_search", SearchSpec("thable"), "contains(line, 'thable')")
plain("regex_search", REGEX, REGEX_SQL)
plain("alternation_search", SearchSpec("License|idiot|ouble"), "regexp_matches(line, 'License|idiot|ouble')")
plain("prefilter_regex", SearchSpec("Licensed.*Version"), "regexp_matches(line, 'Licensed.*Version')")
plain("fixed_string", SearchSpec("***", fixed=True), "contains(line, '***')")
plain("ignore_case", SearchSpec("apache license", ignore_case=True), "regexp_matches(line, '(?i)apache license')")
plain("no_unicode_word", SearchSpec(r"\bth\w+\b \d", unicode=False), r"regexp_matches(line, '\bth\w+\b \d')")
plain("unicode_class", SearchSpec(r"[\p{L}&&[À-ɏ]]{4}"), "regexp_matches(line, '[À-ÖØ-öø-ɏ]{4}')")
plain("posix_class", SearchSpec("[[:digit:]]{3}-[[:digit:]]{4}"), "regexp_matches(line, '[[:digit:]]{3}-[[:digit:]]{4}')")
plain("line_anchors", SearchSpec(r"^The .*\.$"), r"regexp_matches(line, '^The .*\.$')")
plain("invert_match", SearchSpec("[aeiou]t", invert=True), "NOT regexp_matches(line, '[aeiou]t')")
plain("optional_quantifier", SearchSpec("erhe?ar"), "regexp_matches(line, 'erhe?ar')")
plain("mixed_alternation", SearchSpec("License|th[ei]nd"), "regexp_matches(line, 'License|th[ei]nd')")
plain("escaped_pattern", SearchSpec(r"2\.0\."), r"regexp_matches(line, '2\.0\.')")


@add("only_matching", r"""+m AS (SELECT path, line_no, regexp_extract_all(line, 'th[a-z]+') AS ms FROM lines WHERE regexp_matches(line, 'th[a-z]+'))
SELECT path, line_no, CAST(generate_subscripts(ms, 1) - 1 AS INT) AS match_idx, unnest(ms) AS match FROM m""")  # fmt: skip
def _only(spark: SparkSession, d: str) -> DataFrame:
    return search.only_matching(corpus(spark, d), SearchSpec("th[a-z]+", only_matching=True))


@add("count_by_file", "SELECT path, count(*) AS n FROM lines WHERE contains(line, 'ing') GROUP BY path")
def _count(spark: SparkSession, d: str) -> DataFrame:
    return search.count_by_file(corpus(spark, d), SearchSpec("ing", count=True))


@add("count_total", f"SELECT count(*) AS n FROM lines WHERE {REGEX_SQL}")
def _total(spark: SparkSession, d: str) -> DataFrame:
    return search.count_total(corpus(spark, d), replace(REGEX, count=True))


@add("count_inverted", "SELECT path, count(*) AS n FROM lines WHERE NOT contains(line, 'ing') GROUP BY path")
def _inverted(spark: SparkSession, d: str) -> DataFrame:
    return search.count_by_file(corpus(spark, d), SearchSpec("ing", count=True, invert=True))


@add("substring_total", "SELECT count(*) AS lines, CAST(sum(len(regexp_extract_all(line, 'th[a-z]+'))) AS BIGINT) AS matches FROM lines WHERE regexp_matches(line, 'th[a-z]+')")
def _substrings(spark: SparkSession, d: str) -> DataFrame:
    return search.match_totals(corpus(spark, d), SearchSpec("th[a-z]+"))


@add("files_with_matches", f"SELECT DISTINCT path FROM lines WHERE {REGEX_SQL}")
def _files(spark: SparkSession, d: str) -> DataFrame:
    return search.files_with_matches(corpus(spark, d), replace(REGEX, files=True))


@add("exists_match", "SELECT count(*) > 0 AS found FROM lines WHERE contains(line, 'Apache')")
def _exists(spark: SparkSession, d: str) -> DataFrame:
    return search.exists(corpus(spark, d), SearchSpec("Apache", quiet=True))


@add("buffer_mode", r"SELECT path, line_no, line FROM lines WHERE regexp_matches(line, 'th[a-z]+tion')")
def _buffer(spark: SparkSession, d: str) -> DataFrame:
    return search.search(corpus(spark, d), SearchSpec("th[a-z]+tion", mode="buffer"))


@add("buffer_spanning", r"""+n AS (SELECT doc_id, path, line_no, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS next FROM lines)
SELECT path, line_no, line FROM n WHERE ends_with(line, '.') AND starts_with(next, 'The ')""")  # fmt: skip
def _spanning(spark: SparkSession, d: str) -> DataFrame:
    return search.search(corpus(spark, d), SearchSpec(r"\.\nThe ", mode="buffer"))


def by_path(name: str, condition: str, **options) -> None:
    plain(name, SearchSpec("tion", **options), f"contains(line, 'tion') AND {condition}")


by_path("type_filter", "regexp_extract(path, '[.]([^./]+)$', 1) = 'fr'", types=("fr",))
by_path("type_multi", "regexp_extract(path, '[.]([^./]+)$', 1) IN ('de', 'es')", types=("de", "es"))
by_path("include_glob", "regexp_matches(path, '^(.*/)?[^/]*7[.]en$')", include=("*7.en",))
by_path("exclude_glob", "NOT regexp_matches(path, '^src1[^/]*/')", exclude=("src1*/",))
by_path("include_exclude", "(path LIKE '%.en' OR path LIKE '%.de') AND NOT regexp_matches(path, '^(.*/)?[^/]*5[^/]*[.]en$')", include=("*.en", "*.de"), exclude=("*5*.en",))
by_path("path_prefix", "starts_with(path, 'src3/')", path="src3")


@add("hidden_filter", "SELECT path, line_no, line FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN '.' ELSE '' END || path AS path, line_no, line FROM lines) WHERE contains(line, 'tion') AND NOT regexp_matches(path, '(^|/)[.][^/]')")
def _hidden(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    dotted = F.concat(F.when(F.col("doc_id") % 3 == 0, ".").otherwise(""), "path")
    return search.search(Corpus(c.docs.withColumn("path", dotted).withColumn("relpath", dotted)), SearchSpec("tion"))


CONTEXT_SQL = """+m AS (SELECT *, contains(line, 'License') AS hit FROM lines),
w AS (SELECT *, coalesce(max(CAST(hit AS INT)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN {b} FOLLOWING AND {B} FOLLOWING), 0) AS ahead,
             coalesce(max(CAST(hit AS INT)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN {A} PRECEDING AND {a} PRECEDING), 0) AS behind FROM m),
k AS (SELECT path, line_no, line, CASE WHEN hit THEN 'match' ELSE 'context' END AS kind FROM w WHERE hit OR ahead = 1 OR behind = 1),
g AS (SELECT *, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY path ORDER BY line_no) > 1 THEN 1 ELSE 0 END AS gap FROM k),
c AS (SELECT path, line_no, line, kind, CAST(sum(gap) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chunk FROM g)
"""


def context_sql(before: int, after: int, select: str = "SELECT * FROM c") -> str:
    # A frame that ends before it begins stands for no lines.
    return CONTEXT_SQL.format(b=1 if before else 2_000_000, B=before or 2_000_001, a=1 if after else 2_000_000, A=after or 2_000_001) + select


def spec_context(before: int, after: int, **options) -> SearchSpec:
    return SearchSpec("License", context=ContextOpts(before, after), **options)


for _name, _b, _a in (("after_context", 0, 2), ("before_context", 2, 0), ("context_both", 1, 2)):
    add(_name, context_sql(_b, _a, "SELECT path, line_no, line, kind FROM c"))(lambda spark, d, b=_b, a=_a: context.with_context(corpus(spark, d), spec_context(b, a), chunks=False))


@add("context_chunks", CONTEXT_SQL.replace("'License'", "'ting'").format(b=1, B=1, a=1, A=1) + "SELECT * FROM c")
def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return context.with_context(corpus(spark, d), SearchSpec("ting", context=ContextOpts(1, 1)))


@add("trim_output", r"SELECT path, line_no, regexp_replace(line, '^[ \t]+', '') AS line FROM (SELECT path, line_no, '  ' || line AS line FROM lines) WHERE contains(line, 'ble')")
def _trim(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    text = F.concat(F.lit("  "), F.regexp_replace("text", "\n(?!$)", "\n  "))
    return search.search(Corpus(c.docs.withColumn("text", text)), SearchSpec("ble", trim=True))


@add("strip_cr", r"SELECT path, line_no, line FROM lines WHERE contains(line, 'ble')")
def _cr(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    return search.search(Corpus(c.docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\r\n")))), SearchSpec("ble"))


RENDER = spec_context(1, 1)
RENDER_SQL = context_sql(1, 1, "")


@add("render_grep", RENDER_SQL + """, o AS (SELECT path, line_no AS ord, 0 AS sub, path || CASE WHEN kind = 'match' THEN ':' ELSE '-' END || line_no || CASE WHEN kind = 'match' THEN ':' ELSE '-' END || line AS out FROM c
UNION ALL SELECT path, min(line_no), -1, '--' FROM c WHERE chunk > 0 GROUP BY path, chunk) SELECT * FROM o""")  # fmt: skip
def _grep(spark: SparkSession, d: str) -> DataFrame:
    return render.render(corpus(spark, d), RENDER)


HEAD_SQL = RENDER_SQL + """, o AS (SELECT path, line_no AS ord, 0 AS sub, line_no || CASE WHEN kind = 'match' THEN ':' ELSE '-' END || line AS out FROM c
UNION ALL SELECT path, min(line_no), -1, '--' FROM c WHERE chunk > 0 GROUP BY path, chunk
UNION ALL SELECT DISTINCT path, 0, 0, {name} FROM c) SELECT * FROM o"""  # fmt: skip


@add("render_heading", HEAD_SQL.format(name="path"))
def _heading(spark: SparkSession, d: str) -> DataFrame:
    return render.render(corpus(spark, d), RENDER, OutputFormat.HEADING)


@add("render_compact", HEAD_SQL.format(name="substr(path, 6)").replace("concat(source, '/', doc_id", "concat('root/', source, '/', doc_id"))
def _compact(spark: SparkSession, d: str) -> DataFrame:
    c = corpus(spark, d)
    return render.render(Corpus(c.docs.withColumn("path", F.concat(F.lit("root/"), "path")), "root"), RENDER, OutputFormat.COMPACT)


ORACLE_SQL["render_compact"] = ORACLE_SQL["render_compact"].replace("concat(source, '/', doc_id", "concat('root/', source, '/', doc_id")


@add("render_color", r"""SELECT path, line_no AS ord, 0 AS sub, chr(27) || '[1;35m' || path || chr(27) || '[0m:' || chr(27) || '[32m' || line_no || chr(27) || '[0m:' || regexp_replace(line, '(License)', chr(27) || '[1;31m' || '\1' || chr(27) || '[0m', 'g') AS out FROM lines WHERE contains(line, 'License')""")
def _color(spark: SparkSession, d: str) -> DataFrame:
    return render.render(corpus(spark, d), SearchSpec("License"), color=True)


@add("line_offsets", r"SELECT doc_id, line_no, CAST(coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM lines")
def _offsets(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d).docs.select("doc_id", "text")
    return with_offsets(explode_lines(docs)).select("doc_id", "line_no", "byte_offset")


GRAMS = """+t AS (SELECT DISTINCT doc_id, line_no, unnest(list_transform(generate_series(1, CAST(length(line) - 2 AS BIGINT)), lambda i: substr(line, i, 3))) AS trigram FROM lines)
"""


@add("trigram_postings", GRAMS + "SELECT trigram, count(*) AS postings, count(DISTINCT doc_id) AS docs FROM t GROUP BY trigram")
def _postings(spark: SparkSession, d: str) -> DataFrame:
    per = ix.postings(corpus(spark, d).docs).groupBy("gram").agg(F.sum(F.size("lines")).alias("postings"), F.count("*").alias("docs"))
    return per.select(ix.trigram_of(F.col("gram")).alias("trigram"), "postings", "docs")


@add("trigram_doc_freq", GRAMS + "SELECT trigram, count(DISTINCT doc_id) AS df FROM t GROUP BY trigram")
def _df(spark: SparkSession, d: str) -> DataFrame:
    return ix.doc_frequency(corpus(spark, d).docs)


_PAIR = [frozenset({"Lic", "cen", "Apa"})]


@add("index_candidates_docs", "SELECT doc_id FROM lines GROUP BY doc_id HAVING max(CAST(contains(line, 'Lic') AS INT)) + max(CAST(contains(line, 'cen') AS INT)) + max(CAST(contains(line, 'Apa') AS INT)) = 3")
def _cand_docs(spark: SparkSession, d: str) -> DataFrame:
    return ix.matching_documents(ix.document_trigrams(corpus(spark, d).docs, only=sorted(_PAIR[0])), _PAIR)


@add("index_candidates_lines", """+o AS (SELECT *, CAST(coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM lines)
SELECT doc_id, line_no, byte_offset FROM o WHERE contains(line, 'Lic') AND contains(line, 'cen') AND contains(line, 'Apa')""")  # fmt: skip
def _cand_lines(spark: SparkSession, d: str) -> DataFrame:
    return ix.matching_lines(ix.postings(corpus(spark, d).docs, only=sorted(_PAIR[0])), _PAIR)


_BUILT: dict[tuple, str] = {}


def built(spark: SparkSession, d: str, **options) -> tuple[Corpus, ix.Index]:
    """The index of the documents, built once for a session, as look-ups are what the queries show."""
    c, key = corpus(spark, d), (spark.sparkContext.applicationId, d, *sorted(options.items()))
    if key not in _BUILT:
        _BUILT[key] = ix.Index.build(c, scratch_path(spark, "index"), **options).path
    return c, ix.Index.load(spark, _BUILT[key])


def indexed(name: str, spec: SearchSpec, condition: str, strategy: str | None = None, **options) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        c, index = built(spark, d, **options)
        return index.search(c, spec, strategy)

    add(name, f"SELECT path, line_no, line FROM lines WHERE {condition}")(run)


indexed("indexed_search", SearchSpec("Licensed under.*Version"), "regexp_matches(line, 'Licensed under.*Version')")
indexed("indexed_lines", SearchSpec("and.*thin"), "regexp_matches(line, 'and.*thin')", strategy="lines")
indexed("indexed_alternation", SearchSpec("Apache|idiot|clown"), "regexp_matches(line, 'Apache|idiot|clown')")
indexed("indexed_ignore_case", SearchSpec("APACHE license", ignore_case=True), "regexp_matches(line, '(?i)APACHE license')", case_insensitive=True)


@add("indexed_count", "SELECT count(*) AS n FROM lines WHERE contains(line, 'Apache')")
def _indexed_count(spark: SparkSession, d: str) -> DataFrame:
    c, index = built(spark, d)
    return index.count(c, SearchSpec("Apache", count=True))


@add("indexed_context", context_sql(1, 1))
def _indexed_context(spark: SparkSession, d: str) -> DataFrame:
    c, index = built(spark, d)
    return context.with_context(index.narrowed(c, RENDER), RENDER)


@add("index_false_positives", """+k AS (SELECT doc_id, path FROM lines GROUP BY ALL HAVING max(CAST(contains(line, 'and') AS INT)) + max(CAST(contains(line, 'thi') AS INT)) + max(CAST(contains(line, 'hin') AS INT)) = 3)
SELECT * FROM k WHERE doc_id NOT IN (SELECT doc_id FROM lines WHERE regexp_matches(line, 'and.*thin'))""")  # fmt: skip
def _false(spark: SparkSession, d: str) -> DataFrame:
    c, index = built(spark, d)
    return index.false_positives(c, SearchSpec("and.*thin"))


@add("index_stats", GRAMS + ", p AS (SELECT trigram, count(*) AS n FROM t GROUP BY trigram) SELECT (SELECT count(*) FROM documents) AS docs, count(*) AS trigrams, CAST(sum(n) AS BIGINT) AS postings, avg(n) AS avg_postings FROM p")
def _stats(spark: SparkSession, d: str) -> DataFrame:
    return built(spark, d)[1].stats()


@add("density", "SELECT CAST(sum(n) AS BIGINT) AS line_hits, count(*) AS files, sum(n) / count(*) AS density FROM (SELECT path, count(*) AS n FROM lines WHERE contains(line, 'ing') GROUP BY path)")
def _density(spark: SparkSession, d: str) -> DataFrame:
    return search.density(corpus(spark, d), SearchSpec("ing"))


def snapshots(c: Corpus) -> tuple[Corpus, Corpus]:
    """Two states of the documents: some are missing in either, and some of the second have another line in front."""
    t = F.timestamp_seconds(F.lit(1_700_000_000))
    old = c.docs.filter("doc_id % 10 != 0").withColumn("mtime", t)
    new = c.docs.filter("doc_id % 10 != 1").withColumn("mtime", F.when(F.col("doc_id") % 10 == 2, F.timestamp_seconds(F.lit(1_700_000_060))).otherwise(t))
    new = new.withColumn("text", F.when(F.col("doc_id") % 10 == 2, F.concat(F.lit("changed License\n"), "text")).otherwise(F.col("text")))
    return Corpus(old), Corpus(new)


@add("incremental_diff", """SELECT concat(source, '/', doc_id, '.', lang) AS path, CASE doc_id % 10 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'modified' ELSE 'unchanged' END AS status FROM documents""", lines=False)
def _diff(spark: SparkSession, d: str) -> DataFrame:
    old, new = snapshots(corpus(spark, d))
    return incremental.diff(old.docs, new.docs)


NEW_SQL = """+x AS (SELECT path, line_no + CASE WHEN doc_id % 10 = 2 THEN 1 ELSE 0 END AS line_no, line FROM lines WHERE doc_id % 10 != 1
UNION ALL SELECT path, 1, 'changed License' FROM d WHERE doc_id % 10 = 2)
SELECT path, line_no, line FROM x WHERE contains(line, 'License')"""


@add("incremental_search", NEW_SQL)
def _incremental(spark: SparkSession, d: str) -> DataFrame:
    old, new = snapshots(corpus(spark, d))
    index = ix.Index.build(old, scratch_path(spark, "index"))
    incremental.update(index, new)
    return index.search(new, SearchSpec("License"))


@add("incremental_ignore_case", NEW_SQL.replace("contains(line, 'License')", "regexp_matches(line, '(?i)license')"))
def _incremental_folded(spark: SparkSession, d: str) -> DataFrame:
    """A delta of folded postings."""
    old, new = snapshots(corpus(spark, d))
    index = ix.Index.build(old, scratch_path(spark, "index"), case_insensitive=True)
    incremental.update(index, new)
    return index.search(new, SearchSpec("LICENSE", ignore_case=True))


@add("streaming_index", NEW_SQL)
def _streaming(spark: SparkSession, d: str) -> DataFrame:
    old, new = snapshots(corpus(spark, d))
    index = ix.Index.build(old, scratch_path(spark, "index"))
    status = incremental.diff(old.docs, new.docs).filter("status != 'unchanged'")
    gone = old.docs.join(status.filter("status = 'deleted'").select("path"), "path", "left_semi").withColumn("mtime", F.timestamp_seconds(F.lit(1_700_000_120)))
    fresh = new.docs.join(status.filter("status != 'deleted'").select("path"), "path", "left_semi")
    columns = ["doc_id", "path", "relpath", "text", "length", "mtime"]
    folder = scratch_path(spark, "changes")
    fresh.select(*columns, F.lit(False).alias("removed")).unionByName(gone.select(*columns, F.lit(True).alias("removed"))).write.parquet(folder)
    query = maintain.maintain(index, spark.readStream.schema(maintain.CHANGES).parquet(folder), scratch_path(spark, "stream"), available_now=True)
    query.awaitTermination()
    return ix.Index.load(spark, index.path).search(new, SearchSpec("License"))


@add("debounce", """WITH e AS (SELECT user_id, CAST(user_id AS VARCHAR) AS path, ts FROM events WHERE user_id IS NOT NULL),
o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 3 SECOND THEN 0 ELSE 1 END AS fresh FROM e),
g AS (SELECT *, sum(fresh) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT min(ts) AS begin, max(ts) + INTERVAL 3 SECOND AS "end", list_aggregate(list_sort(list(DISTINCT path)), 'string_agg', ',') AS paths, count(*) AS events FROM g GROUP BY k""", lines=False)  # fmt: skip
def _debounce(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").filter("user_id IS NOT NULL").select(F.col("user_id").cast("string").alias("path"), "ts")
    return maintain.debounced(events).withColumn("paths", F.array_join("paths", ","))


@add("case_fold", "SELECT doc_id, lower(text) AS folded FROM documents", lines=False)
def _fold(spark: SparkSession, d: str) -> DataFrame:
    # A class's least character is the capital for most letters; lower() makes both sides comparable.
    return table(spark, d, "documents").select("doc_id", F.lower(fold_column(F.col("text"))).alias("folded"))


@add("distinct_trigrams", GRAMS + "SELECT DISTINCT trigram FROM t")
def _trigrams(spark: SparkSession, d: str) -> DataFrame:
    return ix.document_trigrams(corpus(spark, d).docs).select("gram").distinct().select(ix.trigram_of(F.col("gram")).alias("trigram"))


# The checksum bit by bit: of a byte b, eight times c = (c >> 1) ^ (polynomial if c is odd).
CRC_SQL = """+t AS (SELECT DISTINCT unnest(list_transform(generate_series(1, CAST(length(line) - 2 AS BIGINT)), lambda i: substr(line, i, 3))) AS trigram FROM lines),
b AS (SELECT trigram, list_transform(generate_series(0, CAST(octet_length(encode(trigram)) - 1 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(trigram)), 2 * i + 1, 2) AS BIGINT)) AS bytes FROM t),
s AS (SELECT trigram, list_reduce(flatten(list_transform(bytes, lambda x: [x + 256, 0, 0, 0, 0, 0, 0, 0])), lambda c, x: CASE WHEN xor(c, x & 255) % 2 = 1 THEN xor(xor(c, x & 255) >> 1, 3988292384) ELSE xor(c, x & 255) >> 1 END, 4294967295) AS crc FROM b)
SELECT trigram, CAST(xor(crc, 4294967295) AS BIGINT) AS crc FROM s"""


@add("trigram_crc", CRC_SQL)
def _crc(spark: SparkSession, d: str) -> DataFrame:
    """Trigrams with their checksums, which tell ASCII ones apart as well as the trigrams do."""
    return _trigrams(spark, d).select("trigram", paths.trigram_crc(F.col("trigram")).alias("crc"))


@add("mtime_floor", "SELECT event_id, CAST(floor(epoch(ts) / 2) * 2 AS BIGINT) AS mtime FROM events", lines=False)
def _mtime(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", paths.floor_2s(F.col("ts")).alias("mtime"))


@add("pages_search", r"""WITH e AS (SELECT url, string_split(html, chr(10)) AS ls FROM pages), x AS (SELECT url AS path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no, len(ls) AS n FROM e)
SELECT path, CAST(line_no AS INT) AS line_no, regexp_replace(line, '\r$', '') AS line FROM x WHERE NOT (line_no = n AND line = '') AND regexp_matches(line, '<(h1|title)[^>]*>')""", lines=False)  # fmt: skip
def _pages(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus.from_table(table(spark, d, "pages"), F.col("url"), "html", "page_id")
    return search.search(c, SearchSpec("<(h1|title)[^>]*>", hidden=True))


@add("conversation_search", r"""WITH e AS (SELECT conv_id || '/' || turn || '.' || role AS path, string_split(text, chr(10)) AS ls FROM conversations), x AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no, len(ls) AS n FROM e)
SELECT path, CAST(line_no AS INT) AS line_no, line FROM x WHERE NOT (line_no = n AND line = '') AND regexp_matches(line, 'tion[.]') AND path LIKE '%.assistant'""", lines=False)  # fmt: skip
def _conversations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    c = Corpus.from_table(rows, F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("."), "role"), doc_id=None)
    return search.search(c, SearchSpec(r"tion[.]", types=("assistant",)))


_ROOT = os.path.dirname(os.path.abspath(__file__))


@add("file_source", rf"""WITH f AS (SELECT substr(filename, {len(_ROOT) + 2}) AS path, string_split(content, chr(10)) AS ls FROM read_text('{_ROOT}/**/*.py')),
x AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM f)
SELECT path, CAST(line_no AS INT) AS line_no, line FROM x WHERE regexp_matches(line, '^def \w+')""", lines=False)  # fmt: skip
def _file_source(spark: SparkSession, d: str) -> DataFrame:
    """The library's own source files, through the file source."""
    found = search.search(Corpus.from_files(spark, _ROOT), SearchSpec(r"^def \w+", types=("py",)))
    return found.select(F.substring("path", len(_ROOT) + 2, 1000).alias("path"), "line_no", "line")


__all__ = ["ORACLE_SQL", "QUERIES", "corpus", "strip_cr", "table"]
