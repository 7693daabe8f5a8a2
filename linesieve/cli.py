"""Command line: python -m linesieve PATTERN [PATH] [options], or index, update, stats, bench, daemon, status, flush, stop."""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from linesieve.functions import paths
from linesieve.functions.regex import RegexError
from linesieve.operators import incremental, render, search
from linesieve.operators.index import Index
from linesieve.plans.storage import remove, scratch_path
from linesieve.sources.corpus import Corpus
from linesieve.sources.files import stream_files
from linesieve.spec import Action, ContextOpts, SearchSpec, resolve_format
from linesieve.streaming import maintain

COMMANDS = ("index", "update", "stats", "bench", "daemon", "status", "flush", "stop")


def session() -> SparkSession:
    return SparkSession.builder.appName("linesieve").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def search_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="linesieve", description="Search lines of files, with or without an index.")
    p.add_argument("pattern", nargs="?")
    p.add_argument("path", nargs="?", default=".")
    flag = lambda *names, **k: p.add_argument(*names, action="store_true", **k)
    flag("-r", "--recursive", help="always so")
    flag("-c", "--count")
    flag("-l", "--files-with-matches", dest="files")
    flag("-n", "--line-number", help="always so")
    flag("-i", "--ignore-case")
    flag("-v", "--invert-match", dest="invert")
    flag("-o", "--only-matching")
    flag("-q", "--quiet")
    flag("-F", "--fixed-strings", dest="fixed")
    flag("-E", "--extended-regexp", help="always so")
    flag("-U", "--no-unicode")
    flag("-.", "--hidden")
    flag("--no-ignore")
    flag("--heading")
    flag("-N", "--no-heading")
    flag("--trim")
    flag("--color")
    p.add_argument("-A", "--after-context", type=int)
    p.add_argument("-B", "--before-context", type=int)
    p.add_argument("-C", "--context", type=int)
    p.add_argument("--include", action="append", default=[])
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--type", action="append", default=[], dest="types")
    p.add_argument("--format", choices=["grep", "heading", "compact"])
    p.add_argument("--index")
    return p


def spec_of(a: argparse.Namespace) -> SearchSpec:
    return SearchSpec(
        a.pattern, fixed=a.fixed, ignore_case=a.ignore_case, unicode=not a.no_unicode, invert=a.invert, only_matching=a.only_matching, quiet=a.quiet, count=a.count, files=a.files,
        context=ContextOpts.resolve(a.context, a.before_context, a.after_context), types=tuple(a.types), include=tuple(a.include), exclude=tuple(a.exclude), hidden=a.hidden,
        no_ignore=a.no_ignore, trim=a.trim,
    )


def indexable(spark: SparkSession, path: str, output: str, options: dict) -> Corpus:
    """The files that an index of path with these options of its build holds; updates hold to them, too."""
    files = Corpus.from_files(spark, path, hidden=True, no_ignore=options.get("no_ignore", False), skip=(output,))
    return files.where(SearchSpec("", types=tuple(options.get("types", ())), hidden=True))


def run_search(argv: list[str], spark: SparkSession | None = None, out: Callable[[str], None] = print) -> int:
    """2 without a pattern, 1 on errors or if a quiet search finds nothing, else 0."""
    a = search_parser().parse_args(argv)
    if a.pattern is None:
        print("a pattern is needed", file=sys.stderr)
        return 2
    begin = time.perf_counter()
    try:
        spec = spec_of(a)
        spark = spark or session()
        corpus = Corpus.from_files(spark, a.path, hidden=a.hidden, no_ignore=a.no_ignore, skip=(a.index,) if a.index else ())
        use = corpus
        if a.index and not a.invert:
            if not Index.is_current(spark, a.index):
                Index.build(indexable(spark, a.path, a.index, {"no_ignore": a.no_ignore}), a.index, a.ignore_case, no_ignore=a.no_ignore, types=[])
            index = Index.load(spark, a.index)
            # A daemon has what has changed; without one the search catches up by itself.
            if not maintain.ask(index, "flush"):
                incremental.update(index, indexable(spark, a.path, a.index, index.meta["options"]))
            index = Index.load(spark, a.index)
            use = index.narrowed(corpus, spec)
        if spec.action is Action.EXISTS:
            return 0 if search.any_match(use, spec) else 1
        if spec.action is Action.COUNT:
            if a.index and not a.invert:
                out(str(search.count_total(use, spec).first()["n"]))
            else:
                for r in search.count_by_file(use, spec).orderBy("path").toLocalIterator():
                    out(f"{r['path']}:{r['n']}")
            return 0
        if spec.action is Action.FILES:
            for r in search.files_with_matches(use, spec).orderBy("path").toLocalIterator():
                out(r["path"])
            return 0
        format = resolve_format(a.format, a.no_heading, a.heading, os.environ.get("LINESIEVE_FORMAT"), sys.stdout.isatty())
        n = 0
        # Always sorted: rows without an order would be fetched task by task, each scanned when it is asked for.
        for r in render.ordered(render.render(use, spec, format, a.color, kinds=True)).toLocalIterator():
            out(r["out"])
            n += r["kind"] == "match"
        print(f"Searched in {(time.perf_counter() - begin) * 1e3:.1f}ms, {n} matches", file=sys.stderr)
        return 0
    except (RegexError, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


def run_command(argv: list[str], spark: SparkSession | None = None, out: Callable[[str], None] = print) -> int:
    p = argparse.ArgumentParser(prog=f"linesieve {argv[0]}")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--output", "-o", default=".linesieve")
    p.add_argument("-i", "--ignore-case", action="store_true")
    p.add_argument("--no-ignore", action="store_true")
    p.add_argument("--daemon", "-D", action="store_true")
    p.add_argument("--pattern", action="append", default=[])
    p.add_argument("--type", action="append", default=[], dest="types")
    a = p.parse_args(argv[1:])
    spark = spark or session()
    options = {"no_ignore": a.no_ignore, "types": a.types}

    corpus = indexable(spark, a.path, a.output, options)
    if argv[0] == "index":
        begin = time.perf_counter()
        index = Index.build(corpus, a.output, a.ignore_case, **options)
        out(f"indexed {index.meta['main_docs']} documents in {time.perf_counter() - begin:.2f}s")
        return daemon(spark, index, a.path, out) if a.daemon else 0
    if argv[0] == "bench":
        whole = corpus
        index = Index.build(whole, scratch_path(spark, "bench"), a.ignore_case)
        for pattern in a.pattern or ["TODO", "import", "function"]:
            spec, times, counts = SearchSpec(pattern, ignore_case=a.ignore_case), [], []
            for run in (lambda s=spec: search.search(whole, s).count(), lambda s=spec: index.search(whole, s).count()):
                begin = time.perf_counter()
                counts.append(run())
                times.append(time.perf_counter() - begin)
            out(f"{pattern}: scan {times[0]:.2f}s, indexed {times[1]:.2f}s, {counts[0]} and {counts[1]} lines")
        remove(spark, index.path)
        return 0
    if not Index.is_current(spark, a.output):
        if argv[0] == "stats":
            index = Index.build(corpus, scratch_path(spark, "stats"), a.ignore_case)
            out(", ".join(f"{k}={v}" for k, v in (index.stats().first().asDict() | {"bytes": index.size()}).items()))
            remove(spark, index.path)
            return 0
        print(f"no index at {a.output}", file=sys.stderr)
        return 1
    index = Index.load(spark, a.output)
    if argv[0] in ("status", "flush", "stop"):
        if (said := maintain.daemon_of(index)) is None:
            print("no daemon", file=sys.stderr)
            return 1
        done = argv[0] == "status" or maintain.ask(index, argv[0])
        out(f"running, pid {said['pid']}, {'changes are waiting' if said['dirty'] else 'up to date'}" if argv[0] == "status" else "done" if done else "no answer")
        return 0 if done else 1
    now = indexable(spark, a.path, a.output, index.meta["options"])
    if argv[0] == "update":
        s = incremental.update(index, now)
        out(f"added={s.added} modified={s.modified} deleted={s.deleted} unchanged={s.unchanged} in {s.duration_ms:.0f}ms")
    elif argv[0] == "stats":
        row = index.stats().first().asDict() | {"root": index.meta["root"], "built_at": index.meta["built_at"], "stale": incremental.is_stale(index, now), "bytes": index.size()}
        out(", ".join(f"{k}={v}" for k, v in row.items()))
    else:
        return daemon(spark, index, a.path, out)
    return 0


def daemon(spark: SparkSession, index: Index, root: str, out: Callable[[str], None]) -> int:
    """Catches up, then follows changes of the files that the index was built of, until it is asked to stop."""
    if maintain.daemon_of(index):
        print("a daemon is running", file=sys.stderr)
        return 1
    options = index.meta["options"]
    incremental.update(index, indexable(spark, root, index.path, options))
    files = stream_files(spark, root, hidden=True, no_ignore=options.get("no_ignore", False), skip=(index.path,), state=f"{index.path}/stream-files")
    files = files.filter(paths.has_type(F.col("path"), tuple(options.get("types", ()))))
    query = maintain.maintain(index, maintain.changes_of_files(files), f"{index.path}/stream")
    out("watching")
    maintain.serve(index, query, out)
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    return run_command(argv) if argv and argv[0] in COMMANDS else run_search(argv)
