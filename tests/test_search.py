import re

import pytest
from pyspark.sql import functions as F

from linesieve.operators import context, render, search
from linesieve.operators.lines import explode_lines, with_offsets
from linesieve.plans.planner import plan
from linesieve.sources.corpus import Corpus
from linesieve.spec import Action, ContextOpts, OutputFormat, SearchSpec, resolve_format


def corpus(spark, files):
    rows = [(i, p, t) for i, (p, t) in enumerate(files.items())]
    return Corpus.from_table(spark.createDataFrame(rows, "doc_id long, path string, text string"), "path")


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


ONE = {"f.txt": "alpha\nbeta hit\ngamma\ndelta hit\nepsilon\n"}


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\nbé\n\n"), (2, ""), (3, None), (4, "x"), (5, "\n")], "doc_id long, text string")
    assert got(with_offsets(explode_lines(df)), "doc_id", "line_no", "line", "byte_offset") == [(1, 1, "a", 0), (1, 2, "bé", 2), (1, 3, "", 6), (4, 1, "x", 0), (5, 1, "", 0)]


def test_basic_results(spark):
    c = corpus(spark, ONE)
    assert got(search.search(c, SearchSpec("hit")), "line_no") == [(2,), (4,)]
    assert got(search.search(c, SearchSpec("hit", invert=True)), "line_no") == [(1,), (3,), (5,)]
    assert got(search.count_by_file(c, SearchSpec("hit")), "path", "n") == [("f.txt", 2)]
    assert got(search.count_by_file(c, SearchSpec("nothing")), "n") == []
    assert got(search.count_total(c, SearchSpec("hit")), "n") == [(2,)]
    assert got(search.exists(c, SearchSpec("hit")), "found") == [(True,)]
    assert got(search.exists(c, SearchSpec("none")), "found") == [(False,)]
    assert search.any_match(c, SearchSpec("gamma"))
    assert got(search.files_with_matches(c, SearchSpec("a")), "path") == [("f.txt",)]


def test_only_matching(spark):
    c = corpus(spark, {"m": "fn a fn b\nno\nfn\r\n"})
    assert got(search.only_matching(c, SearchSpec("fn", only_matching=True)), "line_no", "match_idx", "match") == [(1, 0, "fn"), (1, 1, "fn"), (3, 0, "fn")]
    assert got(search.match_totals(c, SearchSpec("fn")), "lines", "matches") == [(2, 3)]


def test_no_line_after_the_last_end(spark):
    c = corpus(spark, {"a": "x\n", "b": "x"})
    assert got(search.search(c, SearchSpec(r"\s*")), "path", "line_no") == [("a", 1), ("b", 1)]
    assert got(search.count_total(c, SearchSpec(r"\s*", mode="buffer")), "n") == [(2,)]


def test_carriage_returns(spark):
    c = corpus(spark, {"a": "one\r\ntwo\r\r\n"})
    assert got(search.search(c, SearchSpec("o")), "line") == [("one",), ("two\r",)]
    assert got(search.search(c, SearchSpec("e$")), "line") == []
    assert got(search.search(c, SearchSpec(r"e\r$")), "line") == [("one",)]


def test_buffer_mode(spark):
    c = corpus(spark, {"a": "foo\nbar\nfoo bar foo\n"})
    assert got(search.search(c, SearchSpec(r"foo\sbar", mode="buffer")), "line_no") == [(1,), (3,)]
    assert got(search.search(c, SearchSpec("^foo", mode="buffer")), "line_no") == [(1,)]
    assert got(search.search(c, SearchSpec("^foo")), "line_no") == [(1,), (3,)]
    assert got(search.search(c, SearchSpec("foo", mode="buffer", invert=True)), "line_no") == [(2,)]


FILES = {"a.rs": "hit", "b.txt": "hit", "c.md": "hit", "d.py": "hit", "src/b.ts": "hit", "src/deep/notes.txt": "hit", ".h/x.rs": "hit", "src/.y.rs": "hit", "Makefile": "hit", ".rs": "hit"}


@pytest.mark.parametrize(
    ("options", "expected"),
    [
        ({"types": ("rs",)}, ["a.rs"]), ({"types": ("rs", "py")}, ["a.rs", "d.py"]), ({"types": ("RS",)}, []), ({"types": ("rs",), "hidden": True}, [".h/x.rs", "a.rs", "src/.y.rs"]),
        ({"include": ("*.txt",)}, ["b.txt", "src/deep/notes.txt"]), ({"include": ("src/*",)}, ["src/b.ts", "src/deep/notes.txt"]), ({"exclude": ("src",)}, ["Makefile", "a.rs", "b.txt", "c.md", "d.py"]),
        ({"include": ("*.txt", "*.rs"), "exclude": ("b.*",)}, ["a.rs", "src/deep/notes.txt"]), ({"path": "src"}, ["src/b.ts", "src/deep/notes.txt"]), ({"path": "sr"}, []), ({"path": "a.rs"}, ["a.rs"]),
        ({"include": ("[ab].{rs,txt}",)}, ["a.rs", "b.txt"]), ({"include": ("**/notes.*",)}, ["src/deep/notes.txt"]), ({"include": ("?.md",)}, ["c.md"]),
    ],
)
def test_path_filters(spark, options, expected):
    assert [x for (x,) in got(search.search(corpus(spark, FILES), SearchSpec("hit", **options)), "path")] == expected


def reference_context(text, pattern, before, after):
    """The plain way: a set of wanted lines, chunks where a number is left out."""
    lines = text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    hits = {i for i, x in enumerate(lines, 1) if re.search(pattern, x)}
    wanted = sorted({j for i in hits for j in range(max(1, i - before), min(len(lines), i + after) + 1)})
    out, chunk = [], 0
    for k, j in enumerate(wanted):
        chunk += bool((before or after) and k and j - wanted[k - 1] > 1)
        out.append((j, lines[j - 1], "match" if j in hits else "context", chunk))
    return out


@pytest.mark.parametrize(("before", "after"), [(0, 0), (1, 0), (0, 2), (2, 2), (5, 1), (100, 100)])
def test_context(spark, before, after):
    text = "\n".join("hit" if i in (1, 2, 6, 11, 14, 30) else f"l{i}" for i in range(1, 31))
    c = corpus(spark, {"t": text, "none": "x\ny"})
    found = got(context.with_context(c, SearchSpec("hit", context=ContextOpts(before, after))), "line_no", "line", "kind", "chunk")
    assert found == reference_context(text, "hit", before, after)


def output(c, spec, format=OutputFormat.GREP, **options):
    return [r["out"] for r in render.ordered(render.render(c, spec, format, **options)).collect()]


def test_layouts(spark):
    c = Corpus(corpus(spark, {"r/a": "x\n  hit\ny\nz\nw\nhit\n", "r/b": "hit"}).docs, "r")
    spec = SearchSpec("hit", context=ContextOpts(1, 0))
    assert output(c, spec) == ["r/a-1-x", "r/a:2:  hit", "--", "r/a-5-w", "r/a:6:hit", "r/b:1:hit"]
    assert output(c, SearchSpec("hit", trim=True)) == ["r/a:2:hit", "r/a:6:hit", "r/b:1:hit"]
    assert output(c, spec, OutputFormat.HEADING)[:3] == ["r/a", "1-x", "2:  hit"]
    assert output(c, SearchSpec("hit"), OutputFormat.COMPACT) == ["a", "2:  hit", "6:hit", "b", "1:hit"]
    assert output(c, SearchSpec("nope"), OutputFormat.HEADING) == []
    assert output(c, SearchSpec("hit", only_matching=True, context=ContextOpts(2, 2))) == ["r/a:2:hit", "r/a:6:hit", "r/b:1:hit"]
    assert output(c, SearchSpec("h.t"), color=True)[2] == "\x1b[1;35mr/b\x1b[0m:\x1b[32m1\x1b[0m:\x1b[1;31mhit\x1b[0m"


def test_options():
    assert ContextOpts.resolve(3) == ContextOpts(3, 3)
    assert ContextOpts.resolve(before=2) == ContextOpts(2, 0)
    assert ContextOpts.resolve(3, 1, 5) == ContextOpts(1, 5)
    assert SearchSpec("a", quiet=True, count=True).action is Action.EXISTS
    assert SearchSpec("a", count=True, files=True).action is Action.COUNT
    assert not SearchSpec("a", count=True, only_matching=True).substrings
    assert SearchSpec("a", invert=True, context=ContextOpts(1, 1)).effective_context == ContextOpts()
    assert resolve_format("compact", no_heading=True) is OutputFormat.COMPACT
    assert resolve_format(no_heading=True, heading=True) is OutputFormat.GREP
    assert resolve_format(heading=True) is OutputFormat.HEADING
    assert resolve_format(tty=True) is OutputFormat.HEADING
    assert resolve_format() is OutputFormat.GREP


def test_planner():
    assert plan(SearchSpec("abc")).kind == "literal"
    assert plan(SearchSpec("a.c", fixed=True)).texts == ("a.c",)
    assert plan(SearchSpec("ab|cd")).kind == "literals"
    assert plan(SearchSpec("static.*inline")).kind == "prefiltered"
    assert plan(SearchSpec(".")).kind == "regex"
    assert plan(SearchSpec("abc", ignore_case=True)).kind == "prefiltered"


def test_prefilter_reaches_the_scan(spark):
    c = corpus(spark, ONE)
    text = search.search(c, SearchSpec("hi."))._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate") < text.index("Contains")  # the test on documents lies below the making of lines


def test_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, None, None, 1, "z"), (1, "p", "hit\n", 2, "y")], "doc_id long, path string, text string, line_no int, line string")
    c = Corpus.from_table(df, "path")
    assert got(search.search(c, SearchSpec("hit")), "path", "line_no", "line") == [("p", 1, "hit")]
    empty = Corpus.from_table(df.filter("false"), "path")
    assert search.count_total(empty, SearchSpec("a")).first()["n"] == 0
    assert search.density(empty, SearchSpec("a")).first()["density"] == 0.0
    assert context.with_context(empty, SearchSpec("a", context=ContextOpts(1, 1))).count() == 0


def test_marker_of_buffer_mode(spark):
    c = corpus(spark, {"a": "$1 costs\n\\x\n$1\n"})
    assert got(search.search(c, SearchSpec(r"\$1\s", mode="buffer")), "line_no", "line") == [(1, "$1 costs"), (3, "$1")]
    assert F is not None
