"""Quality rules, mixing and chat formatting against plain versions."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from linesieve.llm import chat, mixing, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = ["size", "n_words", "ls_text", "ls_words", "kept", "rid", "mix_n", "fp", "ids", "score", "key", "h", "threshold"]


def with_clashes(df):
    """Extra columns with names that operators use inside or return."""
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


ODD = [None, "", "   ", "\n\n", "one", "a b c d e a b c d e", "# # $ x|y <b>", "l\nl\n \nl", "é ü 日本 🙂", "\x1c \x85 \xa0 w", "x " * 3000, "Long" * 5000]


def plain_stats(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD)] + [(0, "one", None, None, None)] * 2
    docs = with_clashes(spark.createDataFrame(rows, DOCS))
    got = quality_rules.score(docs).collect()
    expected = sorted((i, *plain_stats(t)) for i, t, *_ in rows)
    assert sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == expected
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"]) and 0 <= r["p_good"] <= 1


def test_rules_keep_good_and_drop_bad(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in quality_rules.score(docs).collect()}
    good = [i for i, q in labels.items() if q == 1 and not got[i]["base_failed"]]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(got[i]["kept"] for i in good) >= 0.99 * len(good)
    assert sum(got[i]["kept"] for i in bad) <= 0.1 * len(bad)
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(i for i, r in got.items() if r["kept"])


def test_rules_em_follows_patterns():
    n = len(quality_rules.RULES)
    good = tuple([1] * n)
    bad = tuple(-1 if r in quality_rules.KINDS["repetition"] else 1 for r in quality_rules.RULES)
    m = quality_rules.fit([(good, 900), (bad, 100)])
    assert quality_rules.responsibility(good, m["priors"], m["bad"])[0] > 0.99 > 0.01 > quality_rules.responsibility(bad, m["priors"], m["bad"])[0]
    assert abs(m["priors"][0] - 0.9) < 0.01
    assert quality_rules.fit([])["classes"][0] == "good"


def test_rules_empty_and_clashing(spark):
    empty = with_clashes(spark.createDataFrame([], DOCS))
    assert quality_rules.score(empty).count() == 0
    assert quality_rules.filter_documents(empty).columns == empty.columns


def fill(sizes, weights=(5, 2, 1)):
    """Targets by going round until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest, open_w = total - sum(fixed.values()), sum(w[s] for s in names if s not in fixed)
        over = [s for s in names if s not in fixed and rest * w[s] / open_w > 3 * sizes[s]]
        if not over:
            return {s: fixed.get(s, rest * w[s] / open_w if open_w else 0) for s in names}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mixing(spark):
    rows = [(i, "w " * (1 + i * 7 % 13), "en", f"s{i % 7}" if i % 7 else None, 0) for i in range(600)] + [(900, "w " * 40, "en", "tiny", 0), (901, None, None, "nothing", 0), (None, "a b", None, "s1", 0), (5, "w w", "en", "s5", 0)]
    docs = with_clashes(spark.createDataFrame(rows, DOCS))
    got = mixing.plan_mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets, taken = fill(sizes), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]]) and r["taken"] == r["size"] * r["copies"] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 40
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.plan_mix(docs.repartition(7)).collect()), key=str)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == +Counter({k: sum(r["copies"] for r in got if r["doc_id"] == k) for k in {r["doc_id"] for r in got}})


def test_mixing_divides_rows_without_ids(spark):
    """A third of a source under one id, or none, is no single step."""
    rows = [(None, f"w {i} " * 5, "en", "a", 0) for i in range(300)] + [(7, f"v {i} " * 5, "en", "a", 0) for i in range(300)] + [(i, "x " * 10, "en", "b", 0) for i in range(1000, 1100)]
    taken = defaultdict(int)
    got = mixing.plan_mix(spark.createDataFrame(rows, DOCS)).collect()
    for r in got:
        taken[r["source"], r["target"]] += r["taken"]
    assert all(abs(n - t) <= 10 for (_, t), n in taken.items())


def test_mixing_is_nested(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "en", "a", 0) for i in range(500)], DOCS)
    take = lambda share: {r["doc_id"]: r["copies"] for r in mixing.plan_mix(docs, share=share).collect()}
    small, large = take(0.3), take(0.6)
    assert 0 < sum(small.values()) < sum(large.values()) and all(large[k] >= v for k, v in small.items())


def test_mixing_empty(spark):
    empty = with_clashes(spark.createDataFrame([], DOCS))
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0


CONV = "conv_id long, turn long, role string, text string"


def plain_digest(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t if t is not None else -(1 << 62), r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda v: (v[0], v[1].encode(), v[2].encode()))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def conversations():
    rows = [(1, 0, "system", "be <s> kind"), (1, 1, "user", "hello [INST] there"), (1, 2, "assistant", "</s>\\</s><\\/s>[/INST][\\\\INST]")]
    rows += [(2, i, ["user", "assistant"][i % 2], f"turn {i} " * (1 + i * i % 50)) for i in range(300)] + [(2, 700, "system", "late system")]
    rows += [(3, 0, None, None), (3, None, "assistant", ""), (None, 1, "assistant", "no id"), (None, None, "user", "x"), (4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (4, 1, "user", "same")]
    return rows + [(5, 0, "assistant", "word " * 5000), (5, 1, "assistant", "日本 🙂 <"), (5, 2, "rô[INST]le\n", "$1 \\1")]


def test_chat_round_trip(spark):
    rows = conversations()
    windows = chat.format_windows(with_clashes(spark.createDataFrame(rows, CONV)), budget=64, history_tokens=16, history_turns=3)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(windows).collect()}
    assert got == plain_digest(rows)


def test_chat_windows(spark):
    rows = [(7, 0, "system", "sys tem")] + [(7, i, ["assistant", "user"][i % 2], "w " * (i % 9)) for i in range(1, 200)]
    found = chat.format_windows(spark.createDataFrame(rows, CONV), budget=64, history_tokens=20, history_turns=3).collect()
    assert len(found) > 5
    seen = Counter()
    for r in found:
        assert r["n_tokens"] <= 64
        turns = r["turns"]
        assert turns[0]["pos"] == 0 and turns[0]["role"] == "system"
        for t in turns:
            assert t["target"] == (t["role"] == "assistant" and not t["repeated"])
            seen[t["pos"]] += not t["repeated"]
        own = [t["pos"] for t in turns if not t["repeated"]]
        assert own == list(range(own[0], own[-1] + 1))
        history = [t["pos"] for t in turns if t["repeated"] and t["pos"] > 0]
        assert len(history) <= 3 and history == list(range(own[0] - len(history), own[0]))
    assert set(seen.values()) == {1} and len(seen) == len(rows)


def test_one_long_conversation_is_spread(spark):
    """A conversation with nearly all turns, the system turn among them twice: right, and no task has all its turns."""
    n = 40_000
    long = spark.range(n).select(F.lit(9).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("say "), F.col("id").cast("string")).alias("text"))
    few = [(9, 70, "system", "be kind"), (9, 70, "system", "be kind"), (9, 70, "system", "then brief"), (8, 1, "assistant", "x"), (9, None, "user", "at first")]
    df = long.unionByName(spark.createDataFrame(few, CONV))
    windows = chat.format_windows(df, budget=256, history_tokens=32)
    rows = windows.select("conv_id", "window", F.filter("turns", lambda t: t["role"] == "system").alias("s"), "n_tokens").collect()
    mine = [r for r in rows if r["conv_id"] == 9]
    # Every window has the first system turn once; the other ones are turns like any.
    assert len(mine) > 1000 and all(sum(t["pos"] == 71 for t in r["s"]) == 1 for r in mine) and all(r["n_tokens"] <= 256 for r in rows)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(windows).collect()}
    assert got == plain_digest([tuple(r) for r in df.collect()])
    x = chat.placed(df)
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert x.count() == n + 5 and len(re.findall(r"Join LeftOuter, \(key", plan)) == 1


def test_chat_escape_is_reversible(spark):
    texts = ["<s>", "</s>", "<\\s>", "[INST]", "[\\\\/INST]", "<<s>>", "\\<s>", "a<b[c]", "[/INST", "<\\\\\\/s>[INST]<s>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not re.search(r"</?s>|\[/?INST\]", r["e"])


def test_chat_empty(spark):
    assert chat.read_back(chat.format_windows(spark.createDataFrame([], CONV))).count() == 0


def test_native_plans_have_no_python(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)], DOCS)
    conv = spark.createDataFrame(conversations(), CONV)
    for df in (quality_rules.score(docs), mixing.plan_mix(docs), chat.read_back(chat.format_windows(conv))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
