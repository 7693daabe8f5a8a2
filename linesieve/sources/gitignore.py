"""Ignore files: rules of the nearest folder win, later rules win over earlier ones, a leading ! takes back."""

from __future__ import annotations

import os
import re

from linesieve.functions.paths import glob_regex


class Rules:
    def __init__(self, folder: str, lines: list[str]):
        self.folder = folder
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for raw in lines:
            line = raw.rstrip("\n").rstrip("\r")
            line = line if line.endswith("\\ ") else line.rstrip(" ")
            if not line or line.startswith("#"):
                continue
            back = line.startswith("!")
            line = line[1:] if back else line[1:] if line.startswith(("\\#", "\\!")) else line
            if line.strip("/"):
                pattern = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), glob_regex(line))
                self.rules.append((re.compile(pattern), back, line.endswith("/")))

    def decide(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored, False: taken back, None: no rule says anything."""
        rel = os.path.relpath(path, self.folder).replace(os.sep, "/")
        out = None
        for pattern, back, dirs_only in self.rules:
            if (is_dir or not dirs_only) and pattern.match(rel):
                out = not back
        return out


def _lines(folder: str, names: tuple[str, ...]) -> list[str]:
    lines: list[str] = []
    for name in names:
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                lines += f.readlines()
        except OSError:
            continue
    return lines


def load(folder: str) -> Rules | None:
    """The rules of a folder's .ignore and .gitignore files; .ignore wins."""
    lines = _lines(folder, (".gitignore", ".ignore"))
    return Rules(folder, lines) if lines else None


def above(root: str) -> list[Rules]:
    """The rules that hold for a folder from those over it, outermost first: all their .ignore files, and, if the folder is in
    a repository, the .gitignore files up to the one that holds .git and its .git/info/exclude, which gives way to the rest."""
    chain = [os.path.abspath(root)]
    while os.path.dirname(chain[-1]) != chain[-1]:
        chain.append(os.path.dirname(chain[-1]))
    repo = next((i for i, x in enumerate(chain) if os.path.exists(os.path.join(x, ".git"))), -1)
    out = []
    for i, folder in reversed(list(enumerate(chain))):
        if i == repo:
            out.append(Rules(folder, _lines(folder, (os.path.join(".git", "info", "exclude"),))))
        if i:
            out.append(Rules(folder, _lines(folder, (".gitignore", ".ignore") if i <= repo else (".ignore",))))
    return [x for x in out if x.rules]


def ignored(path: str, is_dir: bool, stack: list[Rules]) -> bool:
    for rules in reversed(stack):
        if (found := rules.decide(path, is_dir)) is not None:
            return found
    return False
