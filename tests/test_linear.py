"""The linear-time engine against Java's and Python's, and patterns that Java can't run."""

import pickle
import random
import re
import time

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from linesieve.functions import linear, regex
from linesieve.functions.automaton import Automaton
from linesieve.operators import context, render, search
from linesieve.plans.planner import plan
from linesieve.sources.corpus import Corpus
from linesieve.spec import ContextOpts, SearchSpec


def some_pattern(r: random.Random, depth: int = 3) -> str:
    if depth == 0 or r.random() < 0.25:
        return r.choice(["a", "b", "c", ".", "[ab]", "[^a]", "é", r"\d", "x", "^", "$", "ab"])
    kind = r.randint(0, 3)
    if kind == 0:
        return "".join(some_pattern(r, depth - 1) for _ in range(r.randint(1, 3)))
    if kind == 1:
        return "(?:" + "|".join(some_pattern(r, depth - 1) for _ in range(r.randint(1, 3))) + ")"
    return f"(?:{some_pattern(r, depth - 1)})" + r.choice(["*", "+", "?", "{1,2}", "{2}", "*?", "+?", "??", "{0,3}"])


def test_engines_agree_on_random_patterns(spark):
    r = random.Random(11)
    rows, want = [], []
    for _ in range(400):
        p = some_pattern(r)
        node, py = regex.parse(p), re.compile(p.replace("$", r"\Z"))
        made, java = linear.re2(node), regex.java(node)
        texts = ["".join(r.choice("abcxé1 ") for _ in range(r.randint(0, 12))) for _ in range(6)]
        want += [bool(py.search(t)) for t in texts]
        assert pc.match_substring_regex(pa.array(texts), made).to_pylist() == want[-6:], p
        assert list(map(Automaton(node).search, texts)) == want[-6:], p
        rows += [(len(rows) + k, t, java) for k, t in enumerate(texts)]
    got = spark.createDataFrame(rows, "i int, t string, p string").select("i", F.regexp_like("t", F.col("p")).alias("hit")).collect()
    assert [x["hit"] for x in sorted(got)] == want


# name, pattern, options, texts that match, texts that don't
CASES = [
    ("group", "(foo|ba)+c", {}, ["xfoobac", "bac"], ["c", "foo", ""]),
    ("unicode class", r"(?:\w\s)+$", {}, ["é\u2003", "a b "], ["a b", "!! "]),
    ("case", "(?:k|ß)+z", {"ignore_case": True}, ["KẞZ", "\u212aßz"], ["ssz"]),
    ("ascii case", "(?:k1|s)+z", {"ignore_case": True, "unicode": False}, ["K1Sz"], ["\u212a1z"]),
    ("intersection", r"(?:[\p{L}&&[^a-z]]\d)+", {}, ["É1"], ["e1", "1"]),
    ("difference", r"(?:[\w--\d]-)+", {}, ["a-"], ["1-"]),
    ("both", r"(?:[a-f~~d-z]+!)+", {}, ["a!", "z!"], ["d!", "e!"]),
    ("script", r"(?:\p{Greek}\.)+", {}, ["α."], ["a."]),
    ("negated", r"(?:[^\d\s]\d)+", {}, ["a1"], ["11", " 1"]),
    ("anchors", r"^(?:ab|c)*$", {}, ["", "abc"], ["abd"]),
    ("multi line", r"(?m)^(?:ab)+$", {}, ["abab"], ["aba"]),
    ("ascii word", r"\b(?:ab|c)+\b", {"unicode": False}, ["x ab", "abc"], ["xab"]),
    ("nested", "(a+)+b", {}, ["aab"], ["aac"]),
    ("counted", "(?:ab|c){2,}d", {}, ["abcd"], ["abd"]),
    ("wide", "a.*b.*c.*d", {}, ["axbxcxd"], ["abdc"]),
    ("astral", "(?:🙂|\U0001f600x)+!", {}, ["🙂\U0001f600x!"], ["x!"]),
    ("dot", "(?:.\\n?)+x", {}, ["ax"], ["a", "x"]),
]


@pytest.mark.parametrize(("name", "pattern", "options", "yes", "no"), CASES, ids=[c[0] for c in CASES])
def test_cases(name, pattern, options, yes, no):
    node = regex.parse(pattern, options.get("ignore_case", False), options.get("unicode", True))
    made = linear.pattern(node)
    assert made is not None
    assert pc.match_substring_regex(pa.array(yes + no), made).to_pylist() == [True] * len(yes) + [False] * len(no)


def test_what_goes_where():
    kind = lambda p: plan(SearchSpec(p)).kind
    assert kind("foo(?:a|b)c") == "prefiltered" and kind("[a-z]+x.*") == "prefiltered" and kind("(?:a|bc){1,9}") != "linear"
    assert kind("(?:a|bc)*d") == "linear" and kind("(a+)+b") == "linear"
    assert isinstance(plan(SearchSpec(r"(?-u:\bfoo|a)+")).linear, str)
    assert isinstance(plan(SearchSpec(r"(?:\bfoo|a)+")).linear, Automaton)  # a Unicode word boundary
    with pytest.raises(regex.RegexError):
        plan(SearchSpec(r"(?:\b(?:ab|c){30000})+"))


def docs(spark, texts):
    return Corpus(spark.createDataFrame([(i, f"p{i}", f"p{i}", t) for i, t in enumerate(texts)], "doc_id long, path string, relpath string, text string"))


def test_deep_and_nested_repeats(spark):
    long = "foo" * 3000 + "c"
    c = docs(spark, [f"first\n{long}\nlast", "none", None, "", "a" * 40_000, "bac\n"])
    spec = SearchSpec("(?:foo|ba)*c")
    assert sorted((r["path"], r["line_no"], len(r["line"])) for r in search.search(c, spec).collect()) == [("p0", 2, 9001), ("p5", 1, 3)]
    begin = time.perf_counter()
    assert search.search(c, SearchSpec("(a+)+b")).count() == 0
    assert search.search(c, SearchSpec("(?:a|a)+(?:a|a)*b", mode="buffer")).count() == 0
    assert time.perf_counter() - begin < 60


def test_operators_with_linear_patterns(spark):
    c = docs(spark, ["xabab ab\r\nno\n\nab", "no", "ba\nab\n", None, ""])
    spec = SearchSpec("(?:ab|zz)+")
    assert plan(spec).kind == "linear"
    assert sorted(map(tuple, search.count_by_file(c, spec).collect())) == [("p0", 2), ("p2", 1)]
    assert search.count_total(c, spec).first()[0] == 3
    assert tuple(search.match_totals(c, spec).first()) == (3, 4)
    assert sorted(r["path"] for r in search.files_with_matches(c, spec).collect()) == ["p0", "p2"]
    assert sorted(map(tuple, search.only_matching(c, spec).collect())) == [("p0", 1, 0, "abab"), ("p0", 1, 1, "ab"), ("p0", 4, 0, "ab"), ("p2", 2, 0, "ab")]
    inverted = SearchSpec("(?:ab|zz)+", invert=True)
    assert sorted((r["path"], r["line_no"]) for r in search.search(c, inverted).collect()) == [("p0", 2), ("p0", 3), ("p1", 1), ("p2", 1)]
    assert search.exists(c, spec).first()[0]
    ctx = SearchSpec("(?:ab|zz)+", context=ContextOpts(1, 0))
    assert sorted((r["path"], r["line_no"], r["kind"]) for r in context.with_context(c, ctx).collect() if r["path"] == "p2") == [("p2", 1, "context"), ("p2", 2, "match")]
    painted = [r["out"] for r in render.ordered(render.render(docs(spark, ["zab$"]), spec, color=True)).collect()]
    assert painted == ["\x1b[1;35mp0\x1b[0m:\x1b[32m1\x1b[0m:z\x1b[1;31mab\x1b[0m$"]
    buffer = SearchSpec(r"(?:o\n|q)+\n", mode="buffer")
    assert plan(buffer).kind == "linear"
    assert [(r["path"], r["line_no"]) for r in search.search(c, buffer).collect()] == [("p0", 2)]


def test_automaton_finds_what_python_finds():
    """Spans, with Unicode word boundaries. Python lets an empty match follow a match; the dialect doesn't."""
    r = random.Random(12)
    for _ in range(600):
        p = some_pattern(r) + r.choice(["", r"\b", r"\B"]) + some_pattern(r, 2)
        made, py = Automaton(regex.parse(p)), re.compile(p.replace("$", r"\Z"))
        for _ in range(5):
            t = "".join(r.choice("abcxé1 ") for _ in range(r.randint(1, 12)))
            assert made.search(t) == bool(py.search(t)), (p, t)
            first = py.search(t)
            assert made.find(t) == (first.span() if first else None), (p, t)


# pattern, text, the spans of all matches
SPANS = [
    (r"\b\w+\b", "né à 1_x", [(0, 2), (3, 4), (5, 8)]), (r"(?-u:\b)\w", "éa", [(1, 2)]), (r"\B", "ab", [(1, 1)]), (r"\b", "ab c", [(0, 0), (2, 2), (3, 3), (4, 4)]), (r"\<a|b\>", "ab ba", [(0, 1), (1, 2)]),
    (r"\b{start}.", "éa b", [(0, 1), (3, 4)]), (r".\b{end}", "éa b", [(1, 2), (3, 4)]), (r"\b{start-half}a", "a-a ba", [(0, 1), (2, 3)]), (r"a\b{end-half}", "ab a", [(3, 4)]),
    ("a*", "aab", [(0, 2), (3, 3)]), ("a*?", "aa", [(0, 0), (1, 1), (2, 2)]), ("a+?", "aa", [(0, 1), (1, 2)]), ("a|ab", "abab", [(0, 1), (2, 3)]), ("ab|a", "aba", [(0, 2), (2, 3)]), ("(?:a|ab)(?:c|bcd)", "abcd", [(0, 4)]),
    ("a{2}", "aaaaa", [(0, 2), (2, 4)]), ("a{2,}", "aaaaa", [(0, 5)]), ("a{1,3}?b", "aaab", [(0, 4)]), ("(?:a?){3}", "aa", [(0, 2)]), ("", "ab", [(0, 0), (1, 1), (2, 2)]), ("|a", "a", [(0, 0), (1, 1)]),
    (r"(?m)^.*$", "a\nb", [(0, 1), (2, 3)]), (r"(?m)^$", "a\n\nb", [(2, 2)]), (r"(?mR)^.*$", "a\r\nb", [(0, 1), (3, 4)]), (r"(?mR)$", "a\r\nb\rc", [(1, 1), (4, 4), (6, 6)]), (r"\Aa|b\z", "abab", [(0, 1), (3, 4)]),
    (r"(?s).+", "a\nb", [(0, 3)]), (".+", "a\nb", [(0, 1), (2, 3)]), ("(?R).+", "a\rb", [(0, 1), (2, 3)]), ("(?i)straße", "STRAẞE", [(0, 6)]), ("(?i)k+", "kK\u212a", [(0, 3)]), ("(?i-u)k+", "kK\u212a", [(0, 2)]),
    (r"[\p{L}--[a-z]]+", "aÉbñ", [(1, 2), (3, 4)]), (r"[^\W\d]+", "a1é_", [(0, 1), (2, 4)]), (r"\p{Greek}+", "aαβ", [(1, 3)]), (r"\S+", "a\u2003b", [(0, 1), (2, 3)]), ("🙂+", "x🙂🙂", [(1, 3)]), ("(?U)a+", "aa", [(0, 1), (1, 2)]),
    ("(?:(?:a*)*)*b", "aab", [(0, 3)]), ("(?:a*)+", "b", [(0, 0), (1, 1)]), ("(?:a|b)*?c", "abcab", [(0, 3)]), ("[a-c&&[^b]]+", "abc", [(0, 1), (2, 3)]), (r"(?:\bab)+", "abab ab", [(0, 2), (5, 7)]), (r"(?:\w\b ?)+", "a b cd", [(0, 4), (5, 6)]),
]


@pytest.mark.parametrize(("pattern", "text", "spans"), SPANS, ids=[f"{p}-{i}" for i, (p, *_) in enumerate(SPANS)])
def test_spans(pattern, text, spans):
    node = regex.parse(pattern)
    made = Automaton(node)
    assert list(made.spans(text)) == spans
    assert pickle.loads(pickle.dumps(made)).search(text) == made.search(text) == bool(spans)
    try:
        other = linear.re2(node)
    except linear.Unknown:
        return
    assert pc.match_substring_regex(pa.array([text]), other).to_pylist() == [bool(spans)]


def test_spans_in_java(spark):
    """Java agrees, but that it lets an empty match follow a match."""
    rows = [(i, t, f"(?:{regex.java(regex.parse(p))})") for i, (p, t, _) in enumerate(SPANS)]
    got = spark.createDataFrame(rows, "i int, t string, p string").select("i", F.regexp_extract_all("t", F.col("p"), F.lit(0)).alias("found")).collect()
    for r in got:
        p, t, spans = SPANS[r["i"]]
        assert [x for x in r["found"] if x] == [t[a:z] for a, z in spans if a < z], p


def test_word_boundaries_in_long_lines(spark):
    """Java overflows its stack here."""
    c = docs(spark, ["é " + "foo-" * 20_000 + "c", "a\nfoo-c é\n", None, "", "xfoo-c", "été " * 5_000])
    spec = SearchSpec(r"(?:\bfoo-|ba)+c\b")
    assert sorted((r["path"], r["line_no"]) for r in search.search(c, spec).collect()) == [("p0", 1), ("p1", 2)]
    assert sorted((r["path"], r["match"][-5:]) for r in search.only_matching(c, spec).collect()) == [("p0", "foo-c"), ("p1", "foo-c")]
    assert sorted(map(tuple, search.count_by_file(c, SearchSpec(r"(?:\bét\w\b\s*)+$")).collect())) == [("p5", 1)]
    begin = time.perf_counter()
    assert search.search(c, SearchSpec(r"(?:\w*\b-?)+!", mode="buffer")).count() == 0
    assert time.perf_counter() - begin < 60
