import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from linesieve.functions import packing
from linesieve.functions.casefold import fold
from linesieve.operators import incremental, search
from linesieve.operators import index as ix
from linesieve.plans.storage import scratch_path
from linesieve.sources import files
from linesieve.sources.corpus import Corpus
from linesieve.spec import SearchSpec
from linesieve.streaming import maintain

TREE = {
    "app.ts": "import { x } from './utils';\nfunction main() {}\nconst colour = 1; // Kelvin\n", "utils.ts": "export function hello() { return 'Hello localhost'; }\nfoo\tbar\n",
    "config.json": '{"host": "localhost",\n "color": 1}\n', "nested/deep/module.ts": "constructor() {}\nfooaa\nthe bar baz", "kfile.txt": "\u212aelvin line\nothers\n", "tiny": "ab", "empty": "",
}
PATTERNS = [
    ("function", {}), ("import|export", {}), ("colou?r", {}), ("foo|ba[rz]", {}), ("(foo)?bar", {}), (r"foo\tbar", {}), ("kelvin", {"ignore_case": True}), ("h.llo.*host", {}), ("ab", {}), (".", {}),
    ("zzz", {}), ("constructor", {"invert": True}), ("(?i)HELLO|x", {}), ("fo+.*b", {}), (r"foo[^x]*bar", {"mode": "buffer"}),
]


def corpus(spark, tree, mtime=None):
    rows = [(i, p, t, (mtime or {}).get(p, 0)) for i, (p, t) in enumerate(tree.items())]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string, m long")
    return Corpus.from_table(df, "path", mtime=F.timestamp_seconds("m"))


def found(df):
    return sorted((r["path"], r["line_no"], r["line"]) for r in df.collect())


@pytest.fixture(scope="module")
def built(spark):
    c = corpus(spark, TREE)
    return c, ix.Index.build(c, scratch_path(spark, "t"), case_insensitive=True), ix.Index.build(c, scratch_path(spark, "t"))


@pytest.mark.parametrize(("pattern", "options"), PATTERNS)
def test_indexed_equals_full(built, pattern, options):
    c, folded, cased = built
    spec = SearchSpec(pattern, **options)
    expected = found(search.search(c, spec))
    for index in (folded, cased):
        assert found(index.search(c, spec)) == expected
        assert found(search.search(index.narrowed(c, spec), spec)) == expected
        if ix.terms_of(spec, False) and not options.get("invert") and options.get("mode") != "buffer" and "(?i)" not in pattern and not options.get("ignore_case"):
            assert found(index.search(c, spec, "lines")) == expected


def test_stats_timing_and_false_positives(spark, built):
    c, folded, _ = built
    s = folded.stats().first()
    assert s["docs"] == len(TREE)
    grams = [{x[i : i + 3] for i in range(len(x) - 2)} for t in TREE.values() for x in t.split("\n")]
    assert s["postings"] == sum(map(len, grams)) and s["trigrams"] == len(set().union(*grams))
    rows, timing = folded.timed(c, SearchSpec("localhost"))
    assert timing.matches == rows.count() == 2 and timing.candidates == 2 and timing.density == 1.0
    assert timing.row(spark).count() == 1
    assert [r["path"] for r in folded.false_positives(c, SearchSpec("foo.*foo")).collect()] != ["app.ts"]


def test_versions_and_lock(spark, built):
    _, index, _ = built
    assert ix.Index.is_current(spark, index.path) and not ix.Index.is_current(spark, index.path + "-none")
    with index.lock(), pytest.raises(TimeoutError), index.lock(wait=0.2):
        pass
    with index.lock() as lock:
        assert not lock.waited
    with pytest.raises(RuntimeError), index.lock():
        raise RuntimeError
    with index.lock(wait=0.1):
        pass
    index._commit(version=99)
    assert not ix.Index.is_current(spark, index.path)
    index._commit(version=ix.VERSION)


def test_update(spark):
    old = corpus(spark, TREE)
    index = ix.Index.build(old, scratch_path(spark, "t"), case_insensitive=True)
    tree = {k: v for k, v in TREE.items() if k != "config.json"} | {"app.ts": "function other() {}\nlocalhost\n", "new.ts": "function fresh() {}\nKELVIN\n"}
    new = corpus(spark, tree, {"app.ts": 5})
    new = Corpus(new.docs.withColumn("doc_id", F.xxhash64("path")))
    new = Corpus(new.docs.join(old.docs.select("path", F.col("doc_id").alias("o")), "path", "left").withColumn("doc_id", F.coalesce("o", "doc_id")).drop("o"))
    assert incremental.is_stale(index, new)
    s = incremental.update(index, new)
    assert (s.added, s.modified, s.deleted) == (1, 1, 1)
    again = incremental.update(index, new)
    assert (again.added, again.modified, again.deleted) == (0, 0, 0) and not incremental.is_stale(index, new)
    for pattern, options in PATTERNS:
        spec = SearchSpec(pattern, **options)
        assert found(index.search(new, spec)) == found(search.search(new, spec)), pattern
    # A document that comes back, and one that changes again.
    incremental.update(index, old)
    assert found(index.search(old, SearchSpec("localhost"))) == found(search.search(old, SearchSpec("localhost")))
    assert incremental.compact(index, old).stats().first()["docs"] == len(TREE)


def test_same_time_other_length_is_a_change(spark):
    a, b = corpus(spark, {"f": "abc"}), corpus(spark, {"f": "abcd"})
    assert [r["status"] for r in incremental.diff(a.docs, b.docs).collect()] == ["modified"]


def test_stream(spark):
    index = ix.Index.build(corpus(spark, TREE), scratch_path(spark, "t"))
    folder = scratch_path(spark, "c")
    t = F.timestamp_seconds(F.lit(9))
    rows = [(100, "app.ts", "app.ts", "function z() {}", 15, False), (1, "utils.ts", "utils.ts", None, 0, True)]
    spark.createDataFrame(rows, "doc_id long, path string, relpath string, text string, length long, removed boolean").withColumn("mtime", t).write.parquet(folder)
    stream = spark.readStream.schema(maintain.CHANGES).parquet(folder)
    q = maintain.maintain(index, stream, scratch_path(spark, "cp"), available_now=True)
    q.awaitTermination()
    rows = [(101, "app.ts", "app.ts", "function y() {}", 15, False), (102, "k.ts", "k.ts", "function k() {}", 15, False)]
    spark.createDataFrame(rows, "doc_id long, path string, relpath string, text string, length long, removed boolean").withColumn("mtime", F.timestamp_seconds(F.lit(10))).write.mode("append").parquet(folder)
    maintain.maintain(index, spark.readStream.schema(maintain.CHANGES).parquet(folder), scratch_path(spark, "cp"), available_now=True).awaitTermination()
    index = ix.Index.load(spark, index.path)
    now = Corpus(spark.createDataFrame([(101, "app.ts", "app.ts", "function y() {}"), (102, "k.ts", "k.ts", "function k() {}")], "doc_id long, path string, relpath string, text string"))
    assert [r[0] for r in found(index.search(now, SearchSpec("function")))] == ["app.ts", "k.ts"]
    assert index.docs().filter("path = 'utils.ts'").count() == 0 and index.docs().filter("path = 'app.ts'").count() == 1


def write(root, tree):
    for p, t in tree.items():
        path = os.path.join(root, p)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(t if isinstance(t, bytes) else t.encode())


def test_file_source(spark, tmp_path):
    root = str(tmp_path)
    write(root, {
        "a.txt": "hit\n", "_b.txt": "hit", ".hid": "hit", "sub/c.log": "hit", "sub/keep.log": "hit", ".gitignore": "*.log\n!keep.log\n/build/\n", "build/x.txt": "hit", "sub/build/x.txt": "hit",
        "bin.dat": b"hit\0", "text.md": b"hit\0", "late.dat": b"hit" + b"x" * 600 + b"\0", "bad.txt": b"hit \xff\n", "empty": "", "sub/.ignore": "skip.txt\n", "sub/skip.txt": "hit",
    })
    os.symlink(f"{root}/a.txt", f"{root}/link.txt")
    names = lambda **o: sorted(r["relpath"] for r in Corpus.from_files(spark, root, **o).docs.collect())
    assert names() == ["_b.txt", "a.txt", "bad.txt", "late.dat", "sub/build/x.txt", "sub/keep.log", "text.md"]
    assert set(names(no_ignore=True)) - set(names()) == {"build/x.txt", "sub/c.log", "sub/skip.txt"}
    assert set(names(hidden=True)) - set(names()) == {".gitignore", ".hid", "sub/.ignore"}
    c = Corpus.from_files(spark, root)
    assert [r["line"] for r in search.search(c, SearchSpec("hit", include=("bad.txt",))).collect()] == ["hit \ufffd"]
    assert Corpus.from_files(spark, f"{root}/a.txt").docs.count() == 1
    assert "a.txt" in {r["relpath"] for r in files.read_binary_files(spark, root).collect()}


def test_ignore_files_of_parents(tmp_path):
    top = str(tmp_path)
    write(top, {
        ".ignore": "top.txt\n", ".gitignore": "a.txt\n", "repo/.git/info/exclude": "ex.txt\nback.txt\n", "repo/.gitignore": "*.log\n/in/sub/x.txt\n!back.txt\n",
        **{f"repo/in/{x}": "" for x in ("a.txt", "top.txt", "ex.txt", "back.txt", "b.log", "sub/x.txt", "sub/keep.log", "sub/y.txt")}, "repo/in/sub/.ignore": "!keep.log\n", "a.txt": "", "other/a.txt": "",
    })
    names = lambda root, **o: sorted(x[1] for x in files.walk(f"{top}/{root}", **o))
    assert names("repo/in") == ["a.txt", "back.txt", "sub/keep.log", "sub/y.txt"]
    assert names("repo/in/sub") == ["keep.log", "y.txt"]
    assert names("repo") == ["in/" + x for x in names("repo/in")]
    assert names("other") == ["a.txt"]
    assert len(names("repo/in", no_ignore=True)) == 8


def test_file_stream(spark, tmp_path):
    root, state = str(tmp_path / "in"), str(tmp_path / "listings")
    write(root, {"a.txt": "one\n", "b.txt": "two\n", "late.txt": "two\n"})
    os.utime(f"{root}/late.txt", (4e9, 4e9))  # a date in the future hides nothing
    index = ix.Index.build(Corpus.from_files(spark, root), str(tmp_path / "idx"))
    now = lambda: sorted(r["relpath"] for r in ix.Index.load(spark, index.path).docs().collect())

    def begin():
        return maintain.maintain(index, maintain.changes_of_files(files.stream_files(spark, root, state=state)), str(tmp_path / "cp"), every="0 seconds")

    def until(wanted):
        deadline = time.time() + 90
        while now() != wanted and time.time() < deadline:
            maintain.flush(q)
            time.sleep(0.3)
        assert now() == wanted

    q = begin()
    write(root, {"b.txt": "three\n", "c.txt": "four\n", "old.txt": "five\n"})
    os.utime(f"{root}/old.txt", (1e9, 1e9))  # moved in, with an old date
    until(["a.txt", "b.txt", "c.txt", "late.txt", "old.txt"])
    os.remove(f"{root}/a.txt")
    until(["b.txt", "c.txt", "late.txt", "old.txt"])
    assert maintain.status(q)["running"]
    q.stop()
    # What happens meanwhile is seen when it starts again.
    os.remove(f"{root}/c.txt")
    write(root, {"d.txt": "t\n"})
    q = begin()
    until(["b.txt", "d.txt", "late.txt", "old.txt"])
    q.stop()
    index = ix.Index.load(spark, index.path)
    assert found(index.search(Corpus.from_files(spark, root), SearchSpec("t|four")))[0][2] == "three"


def test_daemon_answers(spark, tmp_path):
    import threading

    from linesieve import cli

    root, idx, out = str(tmp_path / "in"), str(tmp_path / "idx"), []
    write(root, {"a.rs": "fn one\n", "b.txt": "fn two\n"})
    run = lambda *a: cli.run_command([*a, root, "-o", idx], spark, out.append)
    assert run("index", "--type", "rs") == 0 and run("status") == 1 and run("stop") == 1
    t = threading.Thread(target=run, args=("daemon",))
    t.start()
    deadline = time.time() + 60
    while run("status") and time.time() < deadline:
        time.sleep(0.3)
    write(root, {"c.rs": "fn three\n", "d.txt": "fn four\n"})
    assert run("flush") == 0
    # The build's filter holds for updates.
    assert sorted(r["relpath"] for r in ix.Index.load(spark, idx).docs().collect()) == ["a.rs", "c.rs"]
    assert run("stop") == 0
    t.join(60)
    assert not t.is_alive() and run("status") == 1
    write(root, {"e.txt": "fn\n", "f.rs": "fn\n"})
    out.clear()
    assert cli.run_search(["fn", root, "-l", "--index", idx], spark, out.append) == 0
    assert [os.path.basename(x) for x in out] == ["a.rs", "c.rs", "f.rs"]


def test_lock_of_the_dead(spark, built, monkeypatch):
    _, index, _ = built
    index.lock(0.1).__enter__()
    monkeypatch.setattr(ix, "STALE", 0.0)
    time.sleep(1.1)
    with index.lock(wait=0.1):
        pass


def test_cli(spark, tmp_path, capsys):
    from linesieve import cli

    root, out = str(tmp_path / "t"), []
    write(root, {"a.rs": "fn x\n fn y\n", "b.txt": "fn z\n"})
    run = lambda *a: (out.clear(), cli.run_search([*a], spark, out.append), [x.replace(root + "/", "") for x in out])[1:]
    assert run("fn", root, "-N") == (0, ["a.rs:1:fn x", "a.rs:2: fn y", "b.txt:1:fn z"])
    assert run("fn", root, "-c") == (0, ["a.rs:2", "b.txt:1"])
    assert run("fn", root, "-c", "--index", str(tmp_path / "i")) == (0, ["3"])
    assert run("fn", root, "-l", "--type", "rs") == (0, ["a.rs"])
    assert run("nope", root, "-q")[0] == 1 and run("fn", root, "-q")[0] == 0
    assert run("fn", root, "--format", "compact", "--trim", "--exclude", "*.txt") == (0, ["a.rs", "1:fn x", "2:fn y"])
    assert run("(?=a)", root)[0] == 1
    assert cli.run_search([], spark) == 2
    for c in (["index", root, "-o", str(tmp_path / "j")], ["update", root, "-o", str(tmp_path / "j")], ["stats", root, "-o", str(tmp_path / "j")], ["bench", root, "-o", str(tmp_path / "k"), "--pattern", "fn"]):
        assert cli.run_command(c, spark, out.append) == 0
    assert "3 and 3 lines" in out[-1]
    assert cli.run_command(["stats", root, "-o", str(tmp_path / "none")], spark, out.append) == 0
    assert "docs=" in out[-1] and int(out[-1].split("bytes=")[1]) > 0
    assert sorted(os.listdir(tmp_path)) == ["i", "j", "t"]  # indexes for one question are gone
    capsys.readouterr()
    cli.run_search(["fn", root, "-C", "1", "--heading"], spark, out.append)
    assert "3 matches" in capsys.readouterr().err  # neither headings nor context count


def test_trigram_numbers(spark):
    for t in ("abc", "é日🙂", "\t\r ", "\U0010ffffz"):
        assert spark.range(1).select(ix.trigram_of(F.lit(ix.gram(t)).cast("long")).alias("t")).first()["t"] == t


def test_postings_against_plain_python(spark):
    texts = [None, "", "ab", "abc", "abcabc\nxabc\n\nabc", "é日🙂é日🙂\nab\né日🙂", "a\r\nbc\r\n" * 3, "x" * 5000, "\n" * 50, "K ſ ß İ\nKSS"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        at = 0
        for n, line in enumerate((t or "").split("\n"), 1):
            for g in {line[k : k + 3] for k in range(len(line) - 2)}:
                want.setdefault((ix.gram(g), i), []).append((n, at))
            at += len(line.encode()) + 1
    got = {(r["gram"], r["doc_id"]): list(zip(r["lines"], r["offsets"])) for r in ix.postings(docs).collect()}
    assert got == want
    assert {tuple(r) for r in ix.document_trigrams(docs).collect()} == set(want)
    only = [(r["gram"], r["doc_id"]) for r in ix.postings(docs, only=["abc"]).collect()]
    assert sorted(only) == sorted(k for k in want if k[0] == ix.gram("abc"))
    # Folded trigrams stand where the text's own do.
    folded = {(n, o) for r in ix.postings(docs, True).filter("doc_id = 9").collect() for n, o in zip(r["lines"], r["offsets"])}
    assert folded == {(1, 0), (2, len("K ſ ß İ\n".encode()))}
    assert ix.postings(docs.filter("false")).count() == 0


MANY_LETTERS = "\n".join("".join(map(chr, range(a, a + 13))) for a in range(0x20000, 0x20000 + 70_200, 13))


@pytest.mark.parametrize("folded", [False, True])
def test_packed_postings_against_plain_python(folded):
    texts = ["", "ab", "abc", "abcabc\nxabc\n\nabc", "é日🙂é日🙂\nab\né日🙂", "a\r\nbc\r\n" * 3, "x" * 5000, "\n" * 50, "K ſ ß İ\nKSS", "\n".join(["abc"] * 300), MANY_LETTERS]
    for ids, texts in ((range(len(texts)), texts), ([5, 3, 900, -7, 2**63 - 1, -(2**63), 1, 2, 8, 127], texts[:-1])):
        want = {(ix.gram(x[k : k + 3]), i, n) for i, t in zip(ids, texts) for n, x in enumerate((fold(t) if folded else t).split("\n"), 1) for k in range(len(x) - 2)}
        found = packing.block_postings(np.array(ids), texts, folded)
        assert len(found[0]) == len(want) and set(zip(*(x.tolist() for x in found))) == want
        for slots in (1, 7):
            rows = [(slot, packing.rows_of(base, chunk)) for slot, base, chunk in packing.chunks(*found, slots)]
            assert all((packing.slots_of(b.column("gram").to_numpy(), slots) == slot).all() for slot, b in rows)
            got = [r for _, b in rows for part in packing.some(b, 5) for r in packing.postings_of(part).to_pylist()]
            assert {(r["gram"], r["doc_id"], n) for r in got for n in r["lines"]} == want and sum(len(r["lines"]) for r in got) == len(want)
            assert sum(b.column("m").to_numpy().sum() for _, b in rows) == len(want) and sum(b.column("n").to_numpy().sum() for _, b in rows) == len(got)
            assert [r["doc_id"] for _, b in rows for r in packing.postings_of(b.select(["gram", "base", "n", "docs"])).to_pylist()] == [r["doc_id"] for r in got]


def test_small_blocks_and_offsets(spark, monkeypatch):
    """However texts are cut into blocks, the stored postings are those of the texts, and lines begin where they do."""
    monkeypatch.setattr(ix, "BLOCK_CHARS", 60)
    monkeypatch.setattr(ix, "BLOCK_POSTINGS", 40)
    tree = TREE | {f"n{i}": f"é{i}\nthe function é\n\nxyz function\n" * (i % 4) for i in range(30)}
    old = corpus(spark, {k: v for k, v in tree.items() if k != "n3"})
    index = ix.Index.build(old, scratch_path(spark, "t"), case_insensitive=True)
    changes = [(1000 + i, p, p, t, len(t), t == "") for i, (p, t) in enumerate([("n3", tree["n3"]), ("n5", ""), ("n6", "a function\n")])]
    for part in (changes[:2], changes[2:]):  # the second carries over what delta has
        incremental.apply_changes(index, spark.createDataFrame(part, "doc_id long, path string, relpath string, text string, length long, removed boolean").withColumn("mtime", F.timestamp_seconds(F.lit(9))))
    now = [(r["doc_id"], r["path"], r["text"]) for r in old.docs.collect() if r["path"] not in ("n5", "n6")] + [(1000, "n3", tree["n3"]), (1002, "n6", "a function\n")]
    c = Corpus.from_table(spark.createDataFrame(now, "doc_id long, path string, text string"), "path")
    for mark in ("", "_ci"):
        want = {(r["gram"], r["doc_id"]): r["lines"] for r in ix.postings(c.docs, bool(mark)).collect()}
        got = [tuple(r) for r in index.live(f"postings{mark}").collect()]
        assert len(got) == len(want) and {(g, d): n for g, d, n in got} == want
        assert sorted(tuple(r) for r in index.live(f"postings{mark}", lines=False).collect()) == sorted(want)
    spec = SearchSpec("function")
    want = sorted(tuple(r) for r in ix.matching_lines(ix.postings(c.docs), ix.terms_of(spec, False)).collect())
    assert sorted(tuple(r) for r in index.candidate_lines(spec).collect()) == want and any(x[2] for x in want)
    assert index.stats().first()["postings"] == sum(len(r["lines"]) for r in ix.postings(c.docs).collect())


def test_disk_of_a_build(spark):
    """What a build shuffles and what it keeps are together less than four times the texts, folded postings among them and
    though words are random letters."""
    at = random.Random(1)
    words = ["".join(at.choices("abcdefghijklmnopqrstuvwxyz", k=at.randint(2, 9))).capitalize() for _ in range(2000)]
    texts = [" ".join(w + "\n" * (at.random() < 0.05) for w in at.choices(words, k=400)) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    written = lambda: (lambda x: sum(x.apply(i).totalShuffleWrite() for i in range(x.size())))(spark.sparkContext._jsc.sc().statusStore().executorList(False))
    before = written()
    index = ix.Index.build(Corpus.from_table(docs, F.col("doc_id").cast("string")), scratch_path(spark, "t"), case_insensitive=True)
    time.sleep(1)
    shuffled = written() - before
    assert shuffled > 0 and shuffled + index.size() < 4 * sum(map(len, texts)), (shuffled, index.size(), sum(map(len, texts)))


def test_look_up_moves_no_texts(spark, built):
    """However it is searched, texts are not shuffled, and folders of other trigrams are not read."""
    c, index, _ = built
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for strategy in ("docs", "lines"):
            p = index.search(c, SearchSpec("function main"), strategy)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange hashpartitioning" not in p and "SortMergeJoin" not in p, p
        p = index.candidate_docs(SearchSpec("function"))._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(slot" in p or "PartitionFilters: [slot" in p, p
        assert "lines" not in p.split("ReadSchema")[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rare = index.rarest("", [frozenset(ix.regex.trigram_terms(("lit", "function main"))[0])])
    assert len(rare) == 1 and len(rare[0]) == ix.RAREST


def test_scratch_folder_must_be_shared():
    from types import SimpleNamespace

    from linesieve.plans import storage

    fake = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId="a"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            storage.scratch_root(fake(master))
    assert storage.scratch_root(fake("local[4]")).startswith("file://")
