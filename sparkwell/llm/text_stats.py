"""Structure statistics of whole texts, shared by the quality rules and the quality classifier.

Words are runs of bytes other than ASCII white space (space and 0x09 to 0x0D).
"""

from __future__ import annotations

from operator import eq

SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "distinct_ratio", "stutter_ratio", "upper_ratio", "bang_ratio", "digit_ratio", "stop_ratio", "comma_ratio", "words_per_line", "high_ratio"]


def repeated_words(words: list) -> int:
    """Words inside three-word windows that the list holds twice or more, first ones included."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    seen: set = set()
    add, twice = seen.add, set()
    if len(set(windows)) == len(windows):
        return 0
    for w in windows:
        if w in seen:
            twice.add(w)
        else:
            add(w)
    total, end = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def stats(text: str | None) -> tuple:
    """The values of BASE and RATIOS; a null text counts as an empty one."""
    import numpy as np

    b = (text or "").encode()
    words = b.split()
    n = len(words)
    if not n:
        return (0,) * len(BASE) + (0.0,) * len(RATIOS)
    joined = b"".join(words)
    raw = np.frombuffer(joined, np.uint8)
    tally = np.bincount(raw, minlength=256)
    chars = int(len(joined) - tally[0x80:0xC0].sum())
    symbols = int(sum(tally[c] for c in SYMBOLS))
    n_lines, dup = 1, 0
    if b"\n" in b:
        lines = [x for x in b.split(b"\n") if x.strip()]
        n_lines, dup = len(lines), len(lines) - len(set(lines))
    again = repeated_words(words)
    upper, digit = int(tally[65:91].sum()), int(tally[48:58].sum())
    letters = upper + int(tally[97:123].sum())
    return (
        n, chars, symbols, dup, again,
        chars / n, symbols / chars, dup / n_lines, again / n, len(set(words)) / n, sum(map(eq, words, words[1:])) / n,
        upper / max(letters, 1), int(tally[33]) / n, digit / chars, int(tally[46]) / n, int(tally[44]) / n, n / n_lines, int(tally[0x80:].sum()) / chars,
    )
