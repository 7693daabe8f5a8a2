"""Quality rules under weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Each rule votes 1 (good), -1 (bad) or 0 (abstains) on statistics of the whole text. The votes of all documents are
counted by pattern - at most 3 ** len(RULES) rows, whatever the input - and EM on these counts estimates how often a rule
that votes is right on good documents and on each kind of bad ones. A document stays if the posterior probability that it is good reaches
the threshold; no rule has to pass by itself. All work on rows is built-in expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linesieve.llm.common import columns_like, materialise, own_name, words_of

SYMBOLS = "[#*$%&|<>]"
NON_WS = r"[^\x20\x09-\x0D]"
WINDOW = 5
KEEP_AT = 0.5

#: name -> (bad, good): conditions on the columns of stats(). Neither true: the rule abstains.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 3", "n_words >= 10"),
    "symbols": ("n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    "repeat_lines": ("n_dup_lines > 0.4 * n_lines", "n_lines >= 2 AND n_dup_lines <= 0.1 * n_lines"),
    "repeat_words": ("n_repeat_words > 0.2 * n_words", "n_words >= 20 AND n_repeat_words <= 0.05 * n_words"),
    "word_length": ("n_words > 0 AND (word_chars > 12 * n_words OR word_chars < 2 * n_words)", "word_chars BETWEEN 3 * n_words AND 8 * n_words"),
    "variety": ("n_words >= 20 AND n_distinct < 0.25 * n_words", "n_words >= 20 AND n_distinct >= 0.45 * n_words"),
    "line_ends": ("n_lines >= 2 AND n_end_lines < 0.3 * n_lines", "n_lines > 0 AND n_end_lines >= 0.7 * n_lines"),
    "echo": ("n_words >= 20 AND n_echo > 0.15 * n_words", "n_words >= 20 AND n_echo <= 0.05 * n_words"),
    "symbol_runs": ("n_symbol_runs > 0.05 * n_words", "n_symbol_runs <= 0.01 * n_words"),
}
#: Ways of being bad, with the rules that tell of each.
KINDS: dict[str, tuple[str, ...]] = {
    "markup": ("symbols", "symbol_runs", "line_ends"),
    "repetition": ("repeat_lines", "repeat_words", "variety", "echo"),
    "gibberish": ("word_length", "length", "line_ends"),
}


def stats(docs: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_symbol_runs, n_dup_lines, n_repeat_words, n_lines, n_end_lines, n_distinct, n_echo.

    keep: the columns of docs that stay; all by default. The result columns carry the prefix of own_name() if taken, so
    callers that pass tables with clashing names get them through stat_names(). Null texts count as empty; empty texts
    have zeros. Windows of five words are compared by a 64-bit hash within one text, and every step is a scan or a sort of
    the text's own arrays, so long texts cost in proportion to their length (times a logarithm if windows repeat).
    """
    names = stat_names(docs)
    cols = list(docs.columns if keep is None else keep)
    base = [F.col(f"`{c}`") for c in cols]
    t, w, x, s, d, ln = (own_name(docs, n) for n in ("ls_text", "ls_words", "ls_win", "ls_sorted", "ls_spots", "ls_lines"))
    one = docs.select(*base, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(t))
    two = one.select(*[F.col(f"`{c}`") for c in cols], t, words_of(F.col(t)).alias(w), F.filter(F.split(F.col(t), "\n"), lambda q: q.rlike(NON_WS)).alias(ln))
    # Hashes of the words, then of the windows by place: each is a look-up in the row's own array.
    h = own_name(docs, "ls_hash")
    three = two.select(
        *[F.col(f"`{c}`") for c in cols],
        F.size(w).cast("long").alias(names["n_words"]),
        F.length(F.array_join(w, "")).cast("long").alias(names["word_chars"]),
        F.regexp_count(F.col(t), F.lit(SYMBOLS)).cast("long").alias(names["n_symbols"]),
        F.regexp_count(F.col(t), F.lit(SYMBOLS + "+")).cast("long").alias(names["n_symbol_runs"]),
        F.size(ln).cast("long").alias(names["n_lines"]),
        (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias(names["n_dup_lines"]),
        F.size(F.filter(F.col(ln), lambda q: F.rtrim(q).rlike("[.!?:;\"')\\]。]$"))).cast("long").alias(names["n_end_lines"]),
        F.size(F.array_distinct(w)).cast("long").alias(names["n_distinct"]),
        F.transform(F.col(w), lambda q: F.xxhash64(q)).alias(h),
    )
    stat = lambda *ns: [F.col(names[n]) for n in ns]
    first = ("n_words", "word_chars", "n_symbols", "n_symbol_runs", "n_lines", "n_dup_lines", "n_end_lines", "n_distinct")
    n = F.size(h)
    at = lambda a, i: F.get(F.col(a), i)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(h, i + k) for k in range(WINDOW)]))
    echo = F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: at(h, i) == at(h, i - 1)))
    four = three.select(
        *[F.col(f"`{c}`") for c in cols], *stat(*first),
        F.when(n >= 2, echo).otherwise(0).cast("long").alias(names["n_echo"]),
        F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias(x),
    )
    placed = F.sort_array(F.transform(F.col(x), lambda q, i: F.struct(q.alias("h"), i.alias("i"))))
    five = four.select(*[F.col(f"`{c}`") for c in cols], *stat(*first, "n_echo"), F.when(F.size(F.array_distinct(x)) < F.size(x), placed).alias(s))
    m = F.size(s)
    same = lambda i, j: at(s, i)["h"] == at(s, j)["h"]
    spots = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), m - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))), lambda i: at(s, i)["i"]))
    six = five.select(*[F.col(f"`{c}`") for c in cols], *stat(*first, "n_echo"), F.when(F.col(s).isNotNull(), spots).alias(d))
    # A window covers five words from its spot on, or as many as come before the next spot.
    covered = F.aggregate(F.transform(F.col(d), lambda q, i: F.least(F.coalesce(at(d, i + 1) - q, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return six.select(*[F.col(f"`{c}`") for c in cols], *stat(*first, "n_echo"), F.when(F.col(d).isNotNull(), covered).otherwise(0).cast("long").alias(names["n_repeat_words"]))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = ("n_words", "word_chars", "n_symbols", "n_symbol_runs", "n_lines", "n_dup_lines", "n_end_lines", "n_distinct", "n_echo", "n_repeat_words")


def stat_names(docs: DataFrame) -> dict[str, str]:
    return {n: own_name(docs, n) for n in STATS}


def votes(names: dict[str, str], rules: dict[str, tuple[str, str]] = RULES) -> list[Column]:
    """One column per rule: -1, 0 or 1."""

    def on(condition: str) -> Column:
        for n in sorted(names, key=len, reverse=True):
            condition = condition.replace(n, f"\0{list(names).index(n)}\0")
        for i, n in enumerate(names):
            condition = condition.replace(f"\0{i}\0", f"`{names[n]}`")
        return F.expr(condition)

    return [F.when(on(bad), -1).when(on(good), 1).otherwise(0).cast("int") for bad, good in rules.values()]


def base_failed(names: dict[str, str]) -> Column:
    return (F.col(names["n_words"]) < 10) | (100 * F.col(names["n_repeat_words"]) > 20 * F.col(names["n_words"]))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> dict:
    """EM on counted vote patterns: {classes, priors, bad}; bad[k][r]: how often rule r, when it votes, votes bad in class k.

    Class 0 is good; there is one class for each of KINDS, since documents are bad in different ways and mostly break the
    rules of one kind only: with a single bad class EM would settle on the most uniform kind and call the others good.
    Rules vote independently within a class, and as often in each. On good documents a rule votes bad in at most 45 of 100
    cases; a rule votes bad in its own kind in at least 10 of 100, so that none is read upside down. Without patterns the
    start values stand.
    """
    names = list(RULES)
    classes = ["good", *KINDS]
    own = [set(), *({names.index(r) for r in rs} for rs in KINDS.values())]
    bad = [[0.6 if r in mine else 0.001 for r in range(len(names))] for mine in own]
    priors = [1 - 0.03 * len(KINDS), *[0.03] * len(KINDS)]
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        share = [responsibility(v, priors, bad) for v, _ in patterns]
        weight = [sum(q[k] * n for q, (_, n) in zip(share, patterns, strict=True)) for k in range(len(classes))]
        new = []
        for k in range(len(classes)):
            row = []
            for r in range(len(names)):
                voted = sum(q[k] * n for q, (v, n) in zip(share, patterns, strict=True) if v[r])
                against = sum(q[k] * n for q, (v, n) in zip(share, patterns, strict=True) if v[r] < 0)
                row.append(min(0.45 if k == 0 else 0.98, max(0.1 if r in own[k] else 0.0005, (against + 10 * bad[k][r]) / (voted + 10))))
            new.append(row)
        moved = max(abs(x - y) for p, q in zip(new, bad, strict=True) for x, y in zip(p, q, strict=True))
        bad, priors = new, [max(0.001, w / total) for w in weight]
        if moved < 1e-6:
            break
    return {"classes": classes, "priors": priors, "bad": bad}


def log_terms(priors: list[float], bad: list[list[float]]) -> list[tuple[float, list[tuple[float, float]]]]:
    """For each class: log prior, and per rule what a good and a bad vote add."""
    return [(math.log(p), [(math.log(1 - x), math.log(x)) for x in row]) for p, row in zip(priors, bad, strict=True)]


def responsibility(v: tuple[int, ...], priors: list[float], bad: list[list[float]]) -> list[float]:
    z = [c + sum(up if x > 0 else down if x < 0 else 0 for x, (up, down) in zip(v, row, strict=True)) for c, row in log_terms(priors, bad)]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def posterior(model: dict, cast: list[Column]) -> Column:
    """The probability of class 0 given the votes."""
    z = []
    for c, row in log_terms(model["priors"], model["bad"]):
        x = F.lit(c)
        for v, (up, down) in zip(cast, row, strict=True):
            x = x + F.when(v > 0, up).when(v < 0, down).otherwise(0.0)
        z.append(x)
    terms = [F.exp(F.least(x - z[0], F.lit(60.0))) for x in z[1:]]
    others = terms[0]
    for x in terms[1:]:
        others = others + x
    return 1 / (1 + others)


def counted(table: DataFrame, cast: list[Column]) -> list[tuple[tuple[int, ...], int]]:
    """The vote patterns of a table, a few thousand rows at most, in a fixed order."""
    names = [f"v{i}" for i in range(len(cast))]
    rows = table.select(*[c.alias(n) for c, n in zip(cast, names, strict=True)]).groupBy(*names).count().collect()
    return sorted((tuple(r[:-1]), r[-1]) for r in rows)


def score(docs: DataFrame, keep_at: float = KEEP_AT, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: columns, n_words, the base statistics, base_failed, kept, p_good (the posterior), the others.

    kept is false where base_failed; otherwise p_good >= keep_at. Repeated rows get equal results, null and empty texts
    fail the base rules, an empty table gives an empty result.
    """
    base = columns_like(docs, {**{c: t for c, t in docs.select(*columns).dtypes}, "text": "string"})
    names = {n: n for n in STATS}
    table = materialise(stats(base, keep=columns), "rule-stats")
    cast = votes(names)
    model = fit(counted(table, cast))
    p = posterior(model, cast)
    failed = base_failed(names)
    return table.select(*columns, *BASE, failed.alias("base_failed"), (~failed & (p >= keep_at)).alias("kept"), p.alias("p_good"), *[n for n in STATS if n not in BASE])


def filter_documents(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of docs that score() keeps, with the columns of docs.

    The statistics are written beside the rows once, as the votes of all rows are needed before the first can be judged.
    """
    names = stat_names(docs)
    table = materialise(stats(docs), "rule-docs")
    cast = votes(names)
    model = fit(counted(table, cast))
    return table.filter(~base_failed(names) & (posterior(model, cast) >= keep_at)).select(*[F.col(f"`{c}`") for c in docs.columns])
