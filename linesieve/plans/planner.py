"""From a search to column conditions: how a pattern is tested, and what a text must hold before its lines are looked at."""

from __future__ import annotations

import re as std
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from linesieve.functions import linear, regex
from linesieve.spec import SearchSpec


@dataclass(frozen=True)
class Matcher:
    """kind: literal, literals, prefiltered, regex or linear; java: the pattern for extraction and for tests that need one;
    linear: what takes linear time where Java's engine doesn't, used wherever there is one."""

    kind: str
    texts: tuple[str, ...]
    java: str
    needed: tuple
    linear: linear.Engine | None = None

    def matches(self, line: Column) -> Column:
        if self.linear:
            return linear.matches(line, self.linear)
        if self.kind == "literal":
            return line.contains(self.texts[0])
        if self.kind == "literals" and len(self.texts) <= 8:
            return _any([line.contains(t) for t in self.texts])
        return line.rlike(self.java)

    def hits(self, text: Column, lines: Column) -> Column:
        """array of (line, hit) of a text and its lines."""
        if self.linear:
            # Python expressions have no place in lambdas: the hits of all lines come in one array.
            return F.slice(F.zip_with(lines, linear.line_hits(text, self.linear), lambda x, hit: F.struct(x.alias("line"), hit.alias("hit"))), 1, F.size(lines))
        return F.transform(lines, lambda x: F.struct(x.alias("line"), self.matches(x).alias("hit")))

    def marked(self, text: Column, before: str, after: str = "") -> Column:
        """The text with before and after around each match."""
        if self.linear:
            return linear.marked(text, self.linear, before, after)
        return F.regexp_replace(text, f"({self.java})", std.sub(r"([\\$])", r"\\\1", before) + "$1" + std.sub(r"([\\$])", r"\\\1", after))

    def extracted(self, text: Column) -> Column:
        """array<string>: the matches, which don't overlap."""
        return linear.extracted(text, self.linear) if self.linear else F.regexp_extract_all(text, F.lit(f"(?:{self.java})"), 0)

    def document_condition(self, text: Column) -> Column | None:
        """Holds of every text with a match; None: of no use. Tested before lines are made, as no filter on lines can be
        moved below the making of them."""
        return _condition(self.needed, text)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _condition(q, text: Column, most: int = 6) -> Column | None:
    if q[0] == "lit":
        return text.contains(q[1])
    if q[0] == "or":
        parts = [_condition(x, text, most) for x in q[1]]
        return _any(parts) if len(parts) <= most and all(p is not None for p in parts) else None
    # The longest texts say most.
    ranked = sorted(q[1], key=_weight, reverse=True)
    parts = [p for p in (_condition(x, text, most) for x in ranked[:2]) if p is not None]
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def _weight(q) -> int:
    return len(q[1]) if q[0] == "lit" else min(map(_weight, q[1]), default=0)


def plan(spec: SearchSpec) -> Matcher:
    """The cheapest sound test: a text, a choice of texts, a needed text before the pattern, the pattern alone, or an engine that takes linear
    time where Java's doesn't."""
    node = spec.parsed
    needed, java = regex.requirements(node), regex.java(node)
    if (one := regex.literal(node)) is not None and one:
        return Matcher("literal", (one,), java, needed)
    if texts := regex.literals(node):
        return Matcher("literals", tuple(texts), java, needed)
    if (safe := linear.pattern(node)) is not None:
        return Matcher("linear", (), java, needed, safe)
    return Matcher("prefiltered" if needed != regex.TRUE else "regex", (), java, needed)


def buffer_is_lines(spec: SearchSpec) -> bool:
    """Whether matching a whole text and matching its lines come to the same: no match can hold a line end, and no anchor
    asks for the ends of the text."""

    def text_anchor(n) -> bool:
        if isinstance(n, regex.Assertion):
            return n.kind in ("text_start", "text_end")
        return any(map(text_anchor, getattr(n, "parts", []) or ([n.node] if hasattr(n, "node") else [])))

    return not regex.spans_lines(spec.parsed) and not text_anchor(spec.parsed) and regex.requirements(spec.parsed) != regex.TRUE
