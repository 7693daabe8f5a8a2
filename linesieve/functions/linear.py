"""Patterns that Java's engine must not run, for one that takes linear time.

Java matches a repeated group by recursion, a few thousand repeats of which end in a stack overflow that takes the executor
with it, and may try nested repeats in exponentially many ways. Such patterns go to RE2, through Arrow's kernels over
batches of texts. RE2 knows neither Unicode's classes as this dialect has them nor their intersections, so every class is
worked out to ranges of characters. What it can't express, Unicode word boundaries above all, goes to an automaton of this
library (functions.automaton), which is slower, but linear too.
"""

from __future__ import annotations

import re as std
from functools import cache
from typing import TYPE_CHECKING, Union

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from linesieve.functions.casefold import equal_chars
from linesieve.functions.regex import Alt, Assertion, Char, CharSet, Concat, Dot, Group, Node, RegexError, Repeat

if TYPE_CHECKING:
    from linesieve.functions.automaton import Automaton

#: Repeats of a group, or wide repeats in a row, from which on Java is not asked.
MANY, WIDE = 100, 3
_SIZE = 0x110000
#: Stand around a match; no text has these characters, which Unicode keeps for no one.
_OPEN, _SHUT = "\ufdd0\ufdd2", "\ufdd2\ufdd0"


class Unknown(ValueError):
    """RE2 can't express it."""


def _single(node: Node) -> bool:
    while isinstance(node, Group) or isinstance(node, Concat) and len(node.parts) == 1:
        node = node.node if isinstance(node, Group) else node.parts[0]
    return isinstance(node, Char | CharSet | Dot)


def risky(node: Node) -> bool:
    """Whether Java may recurse or go back without a bound: many repeats of more than one character, or several repeats of any
    character."""
    wide = 0

    def walk(n: Node) -> bool:
        nonlocal wide
        if isinstance(n, Repeat):
            if (n.high is None or n.high > MANY) and not _single(n.node):
                return True
            wide += n.high is None and (isinstance(n.node, Dot) or isinstance(n.node, CharSet) and n.node.negated)
            return walk(n.node)
        if isinstance(n, Group):
            return walk(n.node)
        return any(map(walk, n.parts)) if isinstance(n, Concat | Alt) else False

    return walk(node) or wide >= WIDE


@cache
def _everything() -> tuple[str, np.ndarray]:
    cps = np.array([c for c in range(_SIZE) if not 0xD800 <= c < 0xE000])
    return "".join(map(chr, cps)), cps


@cache
def _named(java: str) -> np.ndarray:
    """The characters of the inside of a Java class without brackets."""
    try:
        import regex
    except ImportError as e:
        raise Unknown("classes need the regex module") from e
    body = std.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: "\\U%08x" % int(m[1], 16), java)
    body = std.sub(r"\\p\{Is(\w+)\}", r"\\p{\1}", body)
    text, cps = _everything()
    out = np.zeros(_SIZE, dtype=bool)
    try:
        for m in regex.finditer(f"[{body}]+", text):
            out[cps[m.start() : m.end()]] = True
    except regex.error as e:
        raise Unknown(str(e)) from e
    return out


def members(s: CharSet) -> np.ndarray:
    """Which characters a class has, by code point."""
    if s.op:
        a, b = map(members, s.sides)
        return a & b if s.op == "&&" else a & ~b if s.op == "--" else a ^ b
    out = np.zeros(_SIZE, dtype=bool)
    for item in s.items:
        if isinstance(item, CharSet):
            out |= members(item)
            continue
        own = np.zeros(_SIZE, dtype=bool)
        if isinstance(item, str):
            own |= _named(item)
        else:
            own[ord(item[0]) : ord(item[1]) + 1] = True
        if s.flags.i:
            for c in map(chr, np.flatnonzero(own).tolist()):
                if len(equal := equal_chars(c)) > 1:
                    own[[ord(x) for x in equal if s.flags.u or x.isascii()]] = True
        out |= own
    return ~out if s.negated else out


def _ranges(mask: np.ndarray) -> str:
    mask = mask.copy()
    mask[0xD800:0xE000] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    if not len(edges):
        return r"[^\x{0}-\x{10FFFF}]"
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{z - 1:x}}}" for a, z in edges.reshape(-1, 2).tolist()) + "]"


def re2(node: Node) -> str:
    """The pattern for RE2; Unknown if there is none."""
    if isinstance(node, Char):
        if node.byte:
            raise Unknown("a byte")
        equal = [node.c] if not node.flags.i else [x for x in equal_chars(node.c) if node.flags.u or x.isascii()] or [node.c]
        hexed = [rf"\x{{{ord(c):x}}}" for c in equal]
        return hexed[0] if len(hexed) == 1 else f"[{''.join(hexed)}]"
    if isinstance(node, CharSet):
        return _ranges(members(node))
    if isinstance(node, Dot):
        return "(?s:.)" if node.flags.s else r"[^\r\n]" if node.flags.R else r"[^\n]"
    if isinstance(node, Assertion):
        known = {"text_start": r"\A", "text_end": r"\z"} | ({} if node.flags.R else {"line_start": "(?m:^)", "line_end": "(?m:$)"}) | ({} if node.flags.u else {"word": r"\b", "not_word": r"\B"})
        if node.kind not in known:
            raise Unknown(node.kind)
        return known[node.kind]
    if isinstance(node, Concat):
        return "".join(f"(?:{re2(p)})" if isinstance(p, Alt) else re2(p) for p in node.parts)
    if isinstance(node, Alt):
        return "|".join(map(re2, node.parts))
    if isinstance(node, Group):
        return f"(?:{re2(node.node)})"
    if isinstance(node, Repeat):
        if max(node.low, node.high or 0) > 1000:
            raise Unknown("so many repeats")
        count = {(0, 1): "?", (0, None): "*", (1, None): "+"}.get((node.low, node.high)) or ("{%d}" % node.low if node.low == node.high else "{%d,%s}" % (node.low, "" if node.high is None else node.high))
        return f"(?:{re2(node.node)}){count}{'?' if node.lazy else ''}"
    raise TypeError(node)


#: A pattern for RE2, or the automaton that takes its place.
Engine = Union[str, "Automaton"]


def pattern(node: Node) -> Engine | None:
    """What runs a node that Java should not run; None for one that it may. RegexError if nothing can."""
    if not risky(node):
        return None
    try:
        made = re2(node)
        pc.match_substring_regex(pa.array([""]), made)
        return made
    except (Unknown, pa.ArrowInvalid):
        pass
    from linesieve.functions.automaton import Automaton

    try:
        return Automaton(node)
    except Unknown as e:
        raise RegexError(f"no engine takes this pattern in linear time: {e}") from e


def _tested(texts: pa.Array, made: Engine) -> pa.Array:
    if isinstance(made, str):
        return pc.match_substring_regex(texts, made)
    return pa.array([None if t is None else made.search(t) for t in texts.to_pylist()], pa.bool_())


def _around(texts: pa.Array, made: Engine, before: str, after: str) -> pa.Array:
    """Texts with before and after around each match."""
    if isinstance(made, str):
        return pc.replace_substring_regex(texts, f"({made})", before.replace("\\", r"\\") + r"\1" + after.replace("\\", r"\\"))

    def one(t: str) -> str:
        out, at = [], 0
        for a, z in made.spans(t):
            out += (t[at:a], before, t[a:z], after)
            at = z
        return "".join([*out, t[at:]])

    return pa.array([None if t is None else one(t) for t in texts.to_pylist()], pa.string())


def matches(text: Column, made: Engine) -> Column:
    """Whether a text has a match."""

    @F.arrow_udf("boolean")
    def test(texts: pa.Array) -> pa.Array:
        return _tested(texts, made)

    return test(text)


def line_hits(text: Column, made: Engine) -> Column:
    """array<boolean>: for what lies between line ends, in order, whether it has a match."""

    @F.arrow_udf("array<boolean>")
    def test(texts: pa.Array) -> pa.Array:
        parts = pc.split_pattern(texts, "\n")
        return pa.ListArray.from_arrays(parts.offsets, _tested(parts.values, made), mask=parts.is_null())

    return test(text)


def marked(text: Column, made: Engine, before: str, after: str) -> Column:
    """The text with before and after around each match."""

    @F.arrow_udf("string")
    def mark(texts: pa.Array) -> pa.Array:
        return _around(texts, made, before, after)

    return mark(text)


def extracted(text: Column, made: Engine) -> Column:
    """array<string>: the matches, which don't overlap."""
    between = std.compile(f"{_OPEN}(.*?){_SHUT}", std.S)

    @F.arrow_udf("array<string>")
    def extract(texts: pa.Array) -> pa.Array:
        held = _around(texts, made, _OPEN, _SHUT)
        return pa.array([None if t is None else between.findall(t) for t in held.to_pylist()], pa.list_(pa.string()))

    return extract(text)
