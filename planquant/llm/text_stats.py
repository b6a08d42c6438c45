"""Counts over whole texts that the quality operators share.

Words are runs of characters other than ASCII white space. A null text has no words and counts as empty.
"""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_ENDS = (b".", b"!", b"?", b'"', b":")

#: Names of what `text_stats` returns, in its order.
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_ended_lines", "n_distinct_words")


def repeated_window_words(words: list[bytes], size: int = 3) -> tuple[int, int]:
    """Words in windows of `size` words that the text has twice or more (the first included); number of distinct words."""
    known: dict[bytes, int] = {}
    put = known.setdefault
    ids = np.array([put(w, len(known)) for w in words], dtype=np.int64)
    n = len(ids) - size + 1
    if n < 2:
        return 0, len(known)
    code = ids[:n]
    for k in range(1, size):
        code = code * len(known) + ids[k : k + n]
        if len(known) > 2_000_000 and k < size - 1:  # three ids don't fit 64 bits
            code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0, len(known)
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(ids), dtype=bool)
    for k in range(size):
        hit[k : k + n] |= twice
    return int(hit.sum()), len(known)


def text_stats(text: bytes) -> tuple[int, ...]:
    """The counts named in NAMES."""
    words = text.split()
    if not words:
        return (0, 0, len(text) - len(text.translate(None, SYMBOLS))) + (0,) * 9
    length = len(text)
    without = lambda what: length - len(text.translate(None, what))
    body = text.translate(None, _SPACES)
    seen: set[bytes] = set()
    lines = ended = dups = 0
    for line in text.split(b"\n"):
        if line in seen:
            dups += 1
            lines += 1
        elif bare := line.strip(_SPACES):
            lines += 1
            ended += bare.endswith(_ENDS)
            seen.add(line)
    repeats, distinct = repeated_window_words(words)
    chars = len(body) if body.isascii() else len(body.decode("utf-8", "surrogatepass"))
    return len(words), chars, without(SYMBOLS), dups, repeats, lines, without(_UPPER), without(_LOWER), without(_DIGITS), without(_MARKS), ended, distinct


def features(stats: np.ndarray) -> np.ndarray:
    """Ratios by column, from rows in the order of NAMES; see FEATURES."""
    s = dict(zip(NAMES, stats.T.astype(np.float64), strict=True))
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    return np.stack(
        [
            np.log1p(s["n_words"]),
            s["word_chars"] / words,
            s["n_symbols"] / words,
            s["n_dup_lines"] / lines,
            s["n_repeat_words"] / words,
            s["n_upper"] / np.maximum(s["n_upper"] + s["n_lower"], 1),
            s["n_digits"] / chars,
            s["n_marks"] / chars,
            s["n_ended_lines"] / lines,
            s["n_distinct_words"] / words,
        ],
        axis=1,
    )


FEATURES = ("log_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "ended_line_share", "distinct_share")
