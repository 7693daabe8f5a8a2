"""Each stage of the pipeline against a plain version without Spark, each on what its predecessor kept."""

import math
import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5, sha256

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from linesieve.llm import quality_classifier, quality_rules, simhash
from linesieve.llm.features import NAMES, statistics
from linesieve.plans.storage import scratch_path
from tests.llm.test_native import CLASH, DOCS, ODD, WORD, fill, plain_stats, with_clashes
from tests.llm.test_python import plain_classes

SF = "/root/testdata/sf0.001"


def plain_rules(rows):
    """Votes by the rules' own conditions over statistics counted here; EM on the counted patterns."""
    tables = []
    for r in rows:
        t = r["text"] or ""
        w = WORD.findall(t)
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = plain_stats(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        tables.append({
            "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words, "n_lines": len(lines),
            "n_symbol_runs": len(re.findall("[#*$%&|<>]+", t)), "n_end_lines": sum(x.rstrip(" ")[-1:] in set(".!?:;\"')]。") for x in lines), "n_distinct": len(set(w)), "n_echo": sum(a == b for a, b in zip(w, w[1:])),
        })

    def true(condition, s):
        condition = re.sub(r"(\w+) BETWEEN (.+) AND (.+)$", r"(\2) <= \1 <= (\3)", condition) if "BETWEEN" in condition else condition
        return eval(condition.replace(" AND ", " and ").replace(" OR ", " or ").replace(" = ", " == "), {}, s)

    votes = [tuple(-1 if true(bad, s) else 1 if true(good, s) else 0 for bad, good in quality_rules.RULES.values()) for s in tables]
    m = quality_rules.fit(sorted(Counter(votes).items()))
    good = [quality_rules.responsibility(v, m["priors"], m["bad"])[0] >= quality_rules.KEEP_AT for v in votes]
    return [r for r, s, g in zip(rows, tables, good, strict=True) if g and s["n_words"] >= 10 and 100 * s["n_repeat_words"] <= 20 * s["n_words"]]


def plain_classifier(rows, labels, features=256, gamma=0.05, ridge=1e-3):
    """One dense system over all labelled rows."""
    y = defaultdict(list)
    for r in labels:
        if r["doc_id"] is not None and r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            y[r["doc_id"]].append(r["quality"])
    y = {i: float(np.mean(v) > 0.5) for i, v in y.items() if np.mean(v) != 0.5}
    x = np.array([statistics(r["text"]) for r in rows]).reshape(-1, len(NAMES))
    known = [k for k, r in enumerate(rows) if r["doc_id"] in y]
    a, b = x[known], np.array([y[rows[k]["doc_id"]] for k in known])
    mean, scale = a.mean(0), a.std(0) + 1e-3
    rng = np.random.default_rng(7)
    w, phase = rng.normal(0, math.sqrt(2 * gamma), (len(NAMES), features)), rng.uniform(0, 2 * math.pi, features)
    lift = lambda v: np.hstack([np.cos(np.clip((v - mean) / scale, -6, 6) @ w + phase) * math.sqrt(2 / features), np.ones((len(v), 1))])
    z = lift(a)
    beta = np.linalg.solve(z.T @ z + ridge * len(a) * np.eye(features + 1) / features, z.T @ b)
    s = z @ beta
    at = np.clip(((s + 0.5) / 2 * quality_classifier.BINS).astype(int), 0, quality_classifier.BINS - 1)
    have = np.unique(at)
    cuts, values = np.array([s[at == k].mean() for k in have]), quality_classifier.pool(np.array([(at == k).sum() for k in have]), np.array([b[at == k].sum() for k in have]))
    return [r for r, p in zip(rows, np.interp(lift(x) @ beta, cuts, values), strict=True) if p >= quality_classifier.THRESHOLD]


def plain_dedup(rows):
    """All pairs of fingerprints; of each group the least id, nulls last, counts: its (id, text) as rows of one id are alike to a caller."""
    fps = [simhash.fingerprint(r["text"]) for r in rows]
    root = plain_classes(fps)
    least = {}
    for r, f in zip(rows, fps, strict=True):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        least[root[f]] = min(least.get(root[f], key), key)
    return Counter(least.values())


def plain_mix(rows):
    """A sort by hash in each source, and words added up."""
    size = [len(WORD.findall(r["text"] or "")) for r in rows]
    h = [int(md5(f"mix:{'null' if r['doc_id'] is None else r['doc_id']}:{md5((r['text'] or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16) for r in rows]
    total, out = defaultdict(int), Counter()
    for r, n in zip(rows, size, strict=True):
        total[r["source"]] += n
    for s, target in fill(total).items():
        copies = int(target // total[s]) if total[s] else 0
        rest, upto, limit = target - copies * total[s], 0, -1
        mine = [(h[k], size[k], rows[k]) for k in range(len(rows)) if rows[k]["source"] == s]
        if rest > 0:
            for x in sorted({a for a, _, _ in mine}):
                n = sum(c for a, c, _ in mine if a == x)
                if upto + n >= rest:
                    limit = x if upto + n - rest < rest - upto else x - 1
                    break
                upto += n
            else:
                limit = 1 << 60
        for a, _, r in mine:
            if copies + (a <= limit):
                out[r["doc_id"], r["text"]] += copies + (a <= limit)
    return out


def plain_encode(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = Counter()
    for r in rows:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        out[r["doc_id"], len(ids), sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    return out


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = docs.filter("doc_id % 7 = 0").limit(12)
    odd = spark.createDataFrame([(100_000 + i, t, None, None, None) for i, t in enumerate(ODD)], DOCS)
    docs = docs.unionByName(odd).unionByName(good.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(good.withColumn("source", F.lit(None).cast("string")))
    now = with_clashes(docs)
    columns = now.columns
    steps = dict(corpus_pipeline.STAGES)
    ids = lambda rows: Counter((r["doc_id"], r["text"]) for r in rows)

    def stage(name):
        path = scratch_path(spark, "plain")
        steps[name](spark, now, SF).write.parquet(path)
        return spark.read.parquet(path)

    before, now = now.collect(), stage("quality rules")
    assert now.columns == columns and set(CLASH) <= set(columns)
    assert ids(now.collect()) == ids(plain_rules(before))
    before, now = now.collect(), stage("quality classifier")
    assert now.columns == columns and ids(now.collect()) == ids(plain_classifier(before, labels)) and len(before) > 50
    before, now = now.collect(), stage("SimHash near-dedup")
    assert now.columns == columns and Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in now.collect()) == plain_dedup(before)
    before, now = now.collect(), stage("mixing sources")
    assert now.columns == columns and ids(now.collect()) == plain_mix(before)
    before, now = now.collect(), stage("BPE encoding")
    assert Counter(map(tuple, now.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == plain_encode(before)


def test_stages_on_an_empty_table(spark):
    empty = with_clashes(spark.createDataFrame([], DOCS))
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, empty, SF)
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF).count() == 0
