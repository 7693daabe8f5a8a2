"""Conditions on paths, and small functions of the reference tables."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of files that are text without a look at their bytes.
TEXT_EXTENSIONS = (
    "rs", "ts", "tsx", "js", "jsx", "py", "go", "rb", "java", "c", "h", "cpp", "cc", "hpp", "cs", "swift", "kt", "scala", "php", "html", "css", "scss", "less", "json",
    "toml", "yaml", "yml", "md", "txt", "sh", "bash", "zsh", "fish", "vim", "lua", "r", "sql", "xml", "svg", "tf", "hcl", "nix", "ex", "exs", "erl", "hrl", "ml", "mli",
    "hs", "clj", "cljs", "lisp", "el", "dart", "zig", "v", "proto", "graphql", "gql",
)


def extension(path: Column) -> Column:
    """What follows the last dot of the name; '' for names without one or with one at the start only."""
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


def has_type(path: Column, types: tuple[str, ...]) -> Column:
    """Exact, case-sensitive; any of the types; true without types."""
    return extension(path).isin(*types) if types else F.lit(True)


def is_hidden(relative: Column) -> Column:
    return relative.rlike(r"(^|/)\.[^/]")


def under(path: Column, prefix: str) -> Column:
    """The path itself or anything below it, by whole components."""
    prefix = prefix.rstrip("/")
    return F.lit(True) if prefix in ("", ".") else (path == prefix) | path.startswith(prefix + "/")


def glob_regex(glob: str, anywhere: bool | None = None) -> str:
    """A Java pattern for a gitignore-style glob over relative paths; a glob without a slash matches a name at any depth."""
    body = glob[1:] if glob.startswith("/") else glob
    anywhere = "/" not in glob.rstrip("/") if anywhere is None else anywhere
    body, out, i = body.rstrip("/"), "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("**", i) and (i == 0 or body[i - 1] == "/") and i + 2 == len(body):
            out, i = out + ".+", i + 2
        elif c == "*":
            while i + 1 < len(body) and body[i + 1] == "*":
                i += 1
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (m := re.compile(r"\[([!^]?)(\]?[^\]]*)\]").match(body, i)):
            inner = m[2].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("&", "\\&")
            out, i = out + f"(?!/)[{'^' if m[1] else ''}{inner}]", m.end()
        elif c == "{" and "}" in body[i:]:
            end = body.index("}", i)
            out, i = out + "(?:" + "|".join(glob_regex(x, False)[1:-1] for x in body[i + 1 : end].split(",")) + ")", end + 1
        else:
            if c == "\\" and i + 1 < len(body):
                i += 1
                c = body[i]
            out, i = out + (c if c.isalnum() or c in "_/-" else f"\\x{{{ord(c):x}}}"), i + 1
    return f"^{'(?:.*/)?' if anywhere else ''}{out}$"


def passes_globs(relative: Column, include: tuple[str, ...], exclude: tuple[str, ...]) -> Column:
    """Any include (all paths without one) and no exclude; what matches a folder holds for all below it."""
    below = lambda g: glob_regex(g)[:-1] + "(?:/.*)?$"
    out = F.lit(True)
    if include:
        out = relative.rlike("|".join(f"(?:{below(g)})" for g in include))
    for g in exclude:
        out = out & ~relative.rlike(below(g))
    return out


def is_binary(content: Column, path: Column) -> Column:
    """A NUL among the first 512 bytes, unless the name says text."""
    head = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    return ~extension(path).isin(*TEXT_EXTENSIONS) & (F.instr(head, "\x00") > 0)


def lossy_text(content: Column) -> Column:
    """UTF-8 with U+FFFD for what isn't."""
    return F.make_valid_utf8(content.cast("string"))


def floor_2s(mtime: Column) -> Column:
    """Seconds since the epoch, in steps of two."""
    return (F.unix_timestamp(mtime) - F.pmod(F.unix_timestamp(mtime), F.lit(2))).cast("long")


def grouped_number(n: Column) -> Column:
    return F.format_number(n, 0)


def duration(ms: Column) -> Column:
    """1.23s from a second on, else 12.3ms."""
    return F.when(ms >= 1000, F.format_string("%.2fs", ms / 1000)).otherwise(F.format_string("%.1fms", ms.cast("double")))


def trigram_crc(trigram: Column) -> Column:
    return F.crc32(F.encode(trigram, "UTF-8"))
