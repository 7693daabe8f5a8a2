"""Unicode simple case folding: characters are equal without regard to case if their folds are."""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of Unicode's simple folding that lower() and casefold() of single characters don't give.
EXTRA = {"\ufb05": "\ufb06", "\u1fd3": "\u0390", "\u1fe3": "\u03b0"}


def simple_fold(c: str) -> str:
    """The folded character: the full folding where that is one character, else the lower-case form where that is."""
    if c in EXTRA:
        return EXTRA[c]
    full = c.casefold()
    if len(full) == 1:
        return full
    low = c.lower()
    return low if len(low) == 1 else c


@cache
def _classes() -> tuple[dict[str, str], dict[str, tuple[str, ...]]]:
    groups: dict[str, list[str]] = {}
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        f = simple_fold(c)
        if f != c:
            groups.setdefault(f, [f]).append(c)
    least = {c: min(g) for g in groups.values() for c in g}
    return {c: m for c, m in least.items() if c != m}, {c: tuple(sorted(g)) for g in groups.values() for c in g}


def equal_chars(c: str) -> tuple[str, ...]:
    """All characters that fold as c does, itself among them."""
    return _classes()[1].get(c, (c,))


def fold(text: str) -> str:
    """Each character by the least one of its class."""
    table = _classes()[0]
    return "".join(table.get(c, c) for c in text)


def fold_column(text: Column) -> Column:
    """fold() as a built-in expression: one translation table, so it stays in generated code."""
    table = _classes()[0]
    return F.translate(text, "".join(table), "".join(table.values()))
