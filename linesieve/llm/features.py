"""Document statistics for classifiers, over whole texts."""

from __future__ import annotations

from operator import eq

import numpy as np

from linesieve.llm.common import utf8

NAMES = ("log_words", "log_lines", "variety", "symbols", "echo", "repeat_lines", "line_ends", "word_length", "digits", "capitals", "non_ascii", "commas", "alone", "rare_breaks")
_SYMBOLS, _DIGITS, _CAPITALS, _MARKS = b"#*$%&|<>{}[]=_~^\\@/", b"0123456789", bytes(range(65, 91)), b",.;:!?"
_HIGH = bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """One number per name; zeros for texts without words. Sums and ratios only, so text of any length is one pass."""
    raw = utf8(text)
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    size = sum(map(len, words))
    count = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    distinct = len(set(words))
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines)
    return [
        float(np.log1p(n)), float(np.log1p(len(lines))), np.log(distinct) / np.log(n) if n > 1 else 1.0, count(_SYMBOLS), sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines), ends / len(lines), min(size / n, 40.0) / 10, count(_DIGITS), count(_CAPITALS), count(_HIGH), count(_MARKS),
        distinct / n, len(lines) / n,
    ]
