"""Statistics of whole texts shared by the quality operators.

Words are runs of anything but ASCII white space.  Null text is the empty text,
for which every statistic is 0.
"""

from __future__ import annotations

from operator import eq

import numpy as np

WINDOW = 8
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word", "symbols_per_word", "dup_line_share", "repeat_word_share", "unique_word_share", "upper_share",
          "digit_share", "punct_share", "bang_share", "pipe_share", "words_per_line", "non_ascii_share",
          "log_words", "long_line_share", "twin_share")
ALL = COUNTS + RATIOS


def repeat_words(words: list[bytes]) -> int:
    """Words inside an 8-word window that occurs at least twice in the text, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        w = h[:n].copy()
        for k in range(1, WINDOW):
            w *= np.uint64(0x9E3779B97F4A7C15)
            w ^= w >> np.uint64(29)
            w += h[k:k + n]
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    edge[:n] += twice
    edge[WINDOW:WINDOW + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple:
    """The values of ``ALL`` for one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, sum(raw.count(bytes([c])) for c in _SYMBOLS), 0, 0) + (0.0,) * len(RATIOS)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    spaces = int(seen[list(_SPACE)].sum())
    chars = len(text) - spaces
    symbols = int(seen[list(_SYMBOLS)].sum())
    lines, known, dup, used, long_lines = raw.split(b"\n"), set(), 0, 0, 0
    for line in lines:
        if line and not line.isspace():
            used += 1
            long_lines += len(line) > 400
            if line in known:
                dup += 1
            else:
                known.add(line)
    rep = repeat_words(words)
    upper, lower, digit = int(seen[65:91].sum()), int(seen[97:123].sum()), int(seen[48:58].sum())
    ascii_all = int(seen[:128].sum())
    punct = ascii_all - upper - lower - digit - spaces
    return (n, chars, symbols, dup, rep,
            chars / n, symbols / n, dup / used, rep / n, len(set(words)) / n, upper / max(1, upper + lower),
            digit / chars, punct / chars, int(seen[33]) / n, int(seen[124]) / n, n / used,
            (len(raw) - ascii_all) / chars, float(np.log1p(n)), long_lines / used,
            sum(map(eq, words, words[1:])) / n)
