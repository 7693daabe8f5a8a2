"""What a search asks for, and the precedence of its options."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from linesieve.functions import regex


class OutputFormat(Enum):
    GREP = "grep"
    HEADING = "heading"
    COMPACT = "compact"


class Action(Enum):
    EXISTS = "exists"
    COUNT = "count"
    FILES = "files"
    LINES = "lines"


@dataclass(frozen=True)
class ContextOpts:
    before: int = 0
    after: int = 0

    @classmethod
    def resolve(cls, context: int | None = None, before: int | None = None, after: int | None = None) -> ContextOpts:
        """-C for both sides; -B and -A say more for their own side."""
        both = context or 0
        return cls(both if before is None else before, both if after is None else after)


@dataclass(frozen=True)
class SearchSpec:
    """Options as given. pattern is of the dialect of functions.regex, or plain text with fixed."""

    pattern: str
    fixed: bool = False
    ignore_case: bool = False
    unicode: bool = True
    invert: bool = False
    only_matching: bool = False
    quiet: bool = False
    count: bool = False
    files: bool = False
    context: ContextOpts = ContextOpts()
    types: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    hidden: bool = False
    no_ignore: bool = False
    path: str | None = None
    trim: bool = False
    #: "line": each line by itself; "buffer": the whole text, each match belongs to the line of its start.
    mode: str = "line"
    parsed: regex.Node = field(init=False, repr=False, compare=False, default=None)

    def __post_init__(self):
        if self.mode not in ("line", "buffer"):
            raise ValueError("mode is line or buffer")
        text = regex.escape(self.pattern) if self.fixed else self.pattern
        object.__setattr__(self, "parsed", regex.parse(text, self.ignore_case, self.unicode))

    @property
    def java(self) -> str:
        return regex.java(self.parsed)

    @property
    def action(self) -> Action:
        """Quiet comes before counts, counts before file lists, those before lines."""
        return Action.EXISTS if self.quiet else Action.COUNT if self.count else Action.FILES if self.files else Action.LINES

    @property
    def effective_context(self) -> ContextOpts:
        """Inverted searches, counts, lists and existence have no context."""
        return ContextOpts() if self.invert or self.action is not Action.LINES else self.context

    @property
    def substrings(self) -> bool:
        """Inverted searches have no substrings to show; counts count lines."""
        return self.only_matching and not self.invert and self.action is Action.LINES


def resolve_format(format: str | OutputFormat | None = None, no_heading: bool = False, heading: bool = False, env: str | None = None, tty: bool = False) -> OutputFormat:
    """An explicit format, then --no-heading, then --heading, then the environment, then headings on a terminal."""
    if format is not None:
        return OutputFormat(format)
    if no_heading:
        return OutputFormat.GREP
    if heading:
        return OutputFormat.HEADING
    if env:
        return OutputFormat(env)
    return OutputFormat.HEADING if tty else OutputFormat.GREP
